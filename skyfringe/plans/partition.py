"""Calibration by model partition: directions with gains of their own are told apart in rounds of expectation and
maximisation. model_id is a key of every step, so one job serves all models; each round ends in written tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfringe.functions import complexmath as cx
from skyfringe.operators import calibration, clean, imaging, joins, skymodel
from skyfringe.operators.images import PIXEL
from skyfringe.operators.tables import discard, materialize
from skyfringe.operators.visibility import KEY


@dataclass
class Partition:
    """Models (model_id), their components, images (pixel, value, mask) and gains after so many rounds, the residual image
    and, for each round, the mean square of what the models left of the visibilities."""

    models: DataFrame
    components: DataFrame | None
    images: DataFrame | None
    gains: DataFrame
    residual: DataFrame | None = None
    left: list[float] = field(default_factory=list)


def identity_gains(vis: DataFrame, models: DataFrame, antennas: int, interval: float, *, cross: bool = True) -> DataFrame:
    """(model_id, time, ant, chan, feed, g_re, g_im, weight) of 1 for every model, interval and channel that has data."""
    slots = vis.select(F.floor(F.col("time") / interval).alias("slot"), "chan").distinct()
    each = slots.withColumn("ant", F.explode(F.sequence(F.lit(0), F.lit(antennas - 1)))).withColumn("feed", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = skymodel.for_models(each, models.select("model_id"))
    return rows.select("model_id", (F.col("slot") * interval + interval / 2).alias("time"), F.col("ant").cast("long").alias("ant"), "chan", F.col("feed").cast("long").alias("feed"), F.lit(1.0).alias("g_re"), F.lit(0.0).alias("g_im"), F.lit(1.0).alias("weight"))


def calibrate_partition(
    vis: DataFrame, start: Partition, antennas: int, interval: float, npixel: int, cellsize: float, *, ra0: float = 0.0, dec0: float = 0.0, flux: Column | None = None, rounds: int = 5, damping: float = 0.5,
    clean_image: bool = True, cross: bool = True, gain: float = 0.1, fraction: float = 0.1, most: int = 50, padding: int = 2,
) -> Partition:
    """``rounds`` of model-partition calibration.

    Expectation: every model's visibilities, with its gains, are predicted, and each model gets the observed ones less
    those of all others. Maximisation: each model's data, corrected by its gains, are imaged; what its own model, seen with the
    same samples, doesn't explain is summed within the masks, deconvolved, and ``damping`` of it added to the images
    (``clean_image``); then each model's data give phases against its predictions, all channels together, and gains turn by
    ``damping`` times those. A solver and a correction share one rule: observed = g1 conj(g2) model.
    """
    now, spent = start, [None, None]
    fixed = {"components": start.components, "ra0": ra0, "dec0": dec0, "flux": flux, "npixel": npixel, "cellsize": cellsize, "cross": cross, "padding": padding}
    psf = materialize(imaging.invert(vis, npixel, cellsize, psf=True, padding=padding)) if clean_image else None
    for _ in range(rounds):
        own = materialize(skymodel.predict_sky_models(vis, now.models, images=now.images, gains=now.gains, interval=interval, first=interval / 2, **fixed))
        data = materialize(joins.cross_subtract(own, vis).join(vis.select(*KEY, "u", "v", "w", "weight", "imaging_weight"), KEY))
        summed = own.groupBy(*KEY).agg(F.sum("m_re").alias("m_re"), F.sum("m_im").alias("m_im"))
        off = imaging.subtract_model(vis, summed).where("weight > 0")
        now.left.append(off.agg(F.sum(F.col("weight") * cx.abs2(cx.pair("vis"))) / F.sum("weight")).first()[0])
        images, residual = now.images, None
        if clean_image and now.images is not None:
            seen = skymodel.invert_models(data, now.images, npixel, cellsize, gains=now.gains, interval=interval, first=interval / 2, cross=cross, padding=padding)
            known = skymodel.convolve_with_psf(vis, now.models, now.images, npixel, cellsize, padding=padding, components=now.components, ra0=ra0, dec0=dec0, flux=flux)
            both = seen.unionByName(known.withColumn("value", -F.col("value")))
            residual = materialize(both.groupBy(*PIXEL).agg(F.sum("value").alias("value")))
            found = clean.clean_facets(residual, psf, npixel, 1, 0, gain=gain, fraction=fraction, most=most)
            images = materialize(skymodel.update_from_image(now.images, found.select(*PIXEL, F.col("model").alias("value")), damping))
        ratios = calibration.point_ratios(data, own, interval, keys=["model_id"], all_channels=True)
        solved = calibration.solve_gains(ratios, antennas, cross=cross, keys=["model_id"], phase_only=True)
        turns = solved.select("model_id", (F.col("slot") * interval + interval / 2).alias("time"), "ant", "feed", F.col("g_re").alias("__re"), F.col("g_im").alias("__im"))
        turn = damping * F.atan2(F.col("__im"), F.col("__re"))
        met = now.gains.join(turns, ["model_id", "time", "ant", "feed"], "left").withColumn("__turn", F.coalesce(turn, F.lit(0.0)))
        re, im = cx.mul(cx.pair("g"), (F.cos("__turn"), F.sin("__turn")))
        gains = materialize(met.withColumns({"g_re": re, "g_im": im}).drop("__re", "__im", "__turn"))
        discard(own, data, *spent, now.residual)
        spent = [gains, images if images is not now.images else None]
        now = Partition(now.models, now.components, images, gains, residual, now.left)
    discard(psf)
    return now
