"""Composed imaging: predict, residual and continuum cycles from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfringe.functions import polarisation
from skyfringe.operators import calibration, clean, imaging, joins, visibility
from skyfringe.operators.tables import materialize


def continuum_imaging(vis: DataFrame, npixel: int, cellsize: float, *, cycles: int = 3, gain: float = 0.1, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(model image, residual image) after so many CLEAN cycles; each cycle ends in written tables."""
    psf = materialize(imaging.invert(vis, npixel, cellsize, psf=True, padding=2))
    image = materialize(imaging.invert(vis, npixel, cellsize, padding=2))
    model = None
    for _ in range(cycles):
        found = clean.clean(image, psf, gain=gain, most=most).select("chan", "pol", "y", "x", F.col("model").alias("value"))
        both = found if model is None else model.unionByName(found)
        model = materialize(both.groupBy("chan", "pol", "y", "x").agg(F.sum("value").alias("value")))
        image = materialize(imaging.residual(vis, model, npixel, cellsize, padding=2)[1])
    return model, image


def self_calibrate(vis: DataFrame, model: DataFrame, antennas: int, interval: float, *, cross: bool = True) -> tuple[DataFrame, DataFrame]:
    """(gains, corrected visibilities): solve against predicted visibilities, then apply the inverse."""
    solved = calibration.solve_gains(calibration.point_ratios(vis, model, interval), antennas, cross=cross)
    gains = solved.select((F.col("slot") * interval + interval / 2).alias("time"), "ant", "chan", "feed", "g_re", "g_im", "weight")
    gains = materialize(gains)
    return gains, joins.apply_gains(vis, gains, interval=interval, first=interval / 2, inverse=True, cross=cross)


def imaging_cycle(vis: DataFrame, npixel: int, cellsize: float, antennas: int, interval: float, *, cycles: int = 2, gain: float = 0.1, most: int = 100, cross: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(model image, residual image, gains) of self-calibration within an imaging cycle: image and clean, predict from
    the model, solve and take off the gains, and again."""
    fixed, gains = vis, None
    for _ in range(cycles):
        model, left = continuum_imaging(fixed, npixel, cellsize, cycles=1, gain=gain, most=most)
        predicted = materialize(imaging.predict(vis, model, npixel, cellsize, padding=2))
        gains, fixed = self_calibrate(vis, predicted, antennas, interval, cross=cross)
        fixed = materialize(fixed)
    return model, left, gains


def spectral_line(vis: DataFrame, npixel: int, cellsize: float, *, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(continuum model, line cube): the continuum is cleaned on all channels together and taken off each, and what is
    left is imaged channel by channel."""
    flat = materialize(vis.withColumn("chan", F.lit(0)))
    # Channels of a sample share its coordinates in wavelengths; together they are one sample of the continuum.
    key = ["time", "a1", "a2", "chan", "pol"]
    total = F.sum("weight")
    mean = lambda c: F.when(total > 0, F.sum(F.col(c) * F.col("weight")) / total).otherwise(F.lit(0.0)).alias(c)
    flat = materialize(flat.groupBy(*key).agg(mean("u"), mean("v"), mean("w"), mean("vis_re"), mean("vis_im"), total.alias("weight"), F.sum("imaging_weight").alias("imaging_weight")))
    model, _ = continuum_imaging(flat, npixel, cellsize, cycles=1, most=most)
    chans = vis.select("chan").distinct()
    cube = model.drop("chan").crossJoin(F.broadcast(chans)).select("chan", "pol", "y", "x", "value")
    return model, imaging.residual(vis, cube, npixel, cellsize, padding=2)[1]


def calibrate_list(vis: DataFrame, model: DataFrame, antennas: int, interval: float, *, together: bool = True, cross: bool = True, **options: object) -> tuple[DataFrame, DataFrame]:
    """(gains, corrected visibilities) of all channels: one solution of all ``together``, applied to each, or one a channel.

    For a common solution the ratios to the model are averaged over channels, by weight, before gains are solved."""
    ratios = calibration.point_ratios(vis, model, interval, all_channels=together)
    solved = calibration.solve_gains(ratios, antennas, cross=cross, **options)
    if together:
        solved = solved.drop("chan").crossJoin(imaging.small(vis.select("chan").distinct()))
    gains = materialize(solved.select((F.col("slot") * interval + interval / 2).alias("time"), "ant", "chan", "feed", "g_re", "g_im", "weight"))
    return gains, joins.apply_gains(vis, gains, interval=interval, first=interval / 2, inverse=True, cross=cross)


def polarisation_cube(first: DataFrame, second: DataFrame, npixel: int, cellsize: float, *, frame: str = "linear", low: float = 0.0, high: float = 1e9, most: int = 100, gain: float = 0.1, fraction: float = 0.1) -> DataFrame:
    """(chan, pol, y, x, model, residual): the linearly polarised sky in every channel of two sets of visibilities.

    The sets are appended, turned to Stokes products, cut to uv distances between ``low`` and ``high``, imaged channel by channel, and Q and U are
    cleaned together; I and V come back as they are, without a model.
    """
    sample = ["time", "a1", "a2", "chan"]
    both = visibility.append(first, second)
    kept = visibility.select_uvrange(both, low, high)
    stokes = polarisation.convert_frame(kept, sample, frame, "stokesIQUV")
    # Products of a sample share its coordinates; a Stokes product weighs as the least of them.
    about = kept.groupBy(*sample).agg(*(F.avg(c).alias(c) for c in "uvw"), F.min("weight").alias("weight"), F.min("imaging_weight").alias("imaging_weight"))
    rows = materialize(stokes.join(about, sample))
    image = materialize(imaging.invert(rows, npixel, cellsize, padding=2))
    psf = materialize(imaging.invert(rows, npixel, cellsize, psf=True, padding=2))
    found = clean.clean_complex(image, psf, gain=gain, fraction=fraction, most=most)
    other = image.where(F.col("pol").isin(0, 3)).select("chan", "pol", "y", "x", F.lit(0.0).alias("model"), F.col("value").alias("residual"))
    return found.unionByName(other)
