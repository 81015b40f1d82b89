"""Sky models: components, masks and images that carry a model_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfringe.functions import complexmath as cx
from skyfringe.functions.coordinates import separation, sky_to_lmn

from . import imaging
from .components import component_visibilities
from .images import PIXEL, insert_components, smooth
from .joins import apply_gains
from .neighbours import lost_neighbours
from .tables import materialize
from .visibility import KEY, with_places


def filter_by_flux(components: DataFrame, flux: Column, low: float, high: float) -> DataFrame:
    return components.where((flux > low) & (flux < high))


def select_by_separation(components: DataFrame, ra: float, dec: float, low: float, high: float) -> DataFrame:
    s = separation(F.lit(ra), F.lit(dec), F.col("ra"), F.col("dec"))
    return components.withColumn("separation", s).where((F.col("separation") >= low) & (F.col("separation") <= high))


def brightest(components: DataFrame, flux: str, k: int) -> DataFrame:
    return components.orderBy(F.desc(flux), "comp_id").limit(k)


def remove_neighbours(components: DataFrame, distance: float, flux: str) -> DataFrame:
    """Components without near neighbours: in the order of comp_id, each that is still there meets the first later one
    that is still there and nearer than ``distance``, and the fainter of the two goes (of equals the earlier)."""
    return components.join(lost_neighbours(components, distance, flux), "comp_id", "left_anti")


def to_lm(components: DataFrame, ra0: float, dec0: float) -> DataFrame:
    l, m, n = sky_to_lmn(F.col("ra"), F.col("dec"), F.lit(ra0), F.lit(dec0))  # noqa: E741
    return components.withColumns({"l": l, "m": m, "n": n})


def partition_by_flux(components: DataFrame, flux: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(bright, weak): flux at the threshold is bright."""
    return components.where(flux >= threshold), components.where(flux < threshold)


def partition_model(components: DataFrame, image: DataFrame, threshold: float, npixel: int, cellsize: float, *, method: str = "nearest") -> tuple[DataFrame, DataFrame]:
    """(bright components, the image with the weak ones in it) of components (chan, pol, l, m, flux)."""
    bright, weak = partition_by_flux(components, F.col("flux"), threshold)
    return bright, insert_components(image, weak, npixel, cellsize, method=method)


def equivalent_image(models: DataFrame) -> DataFrame:
    """Sum over models of mask * value."""
    return models.groupBy(*PIXEL).agg(F.sum(F.col("mask") * F.col("value")).alias("value"))


def update_from_image(models: DataFrame, image: DataFrame, damping: float) -> DataFrame:
    """Each model's value with damping * mask * image added."""
    joined = models.join(image.select(*PIXEL, F.col("value").alias("__v")), PIXEL, "left")
    return joined.withColumn("value", F.col("value") + damping * F.col("mask") * F.coalesce("__v", F.lit(0.0))).drop("__v")


def update_from_gains(model_gains: DataFrame, gains: DataFrame, damping: float) -> DataFrame:
    """Each gain turned by damping times the phase of the new one."""
    keys = ["time", "ant", "chan"]
    joined = model_gains.join(gains.select(*keys, F.col("g_re").alias("__re"), F.col("g_im").alias("__im")), keys)
    turn = damping * F.atan2(F.col("__im"), F.col("__re"))
    re = F.col("g_re") * F.cos(turn) - F.col("g_im") * F.sin(turn)
    im = F.col("g_re") * F.sin(turn) + F.col("g_im") * F.cos(turn)
    return joined.withColumns({"g_re": re, "g_im": im}).drop("__re", "__im")


def expand_by_component(components: DataFrame) -> DataFrame:
    """One model for each component, numbered from 1 by id; 0 is left for the image. Ranges of ids are numbered side by
    side: each counts its own rows, and the counts of those before it (a row a range) are added."""
    spark = components.sparkSession
    ranges = max(components.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = materialize(components.repartitionByRange(ranges, "comp_id").sortWithinPartitions("comp_id").withColumn("__part", F.spark_partition_id()))
    return with_places(parts, ["comp_id"]).withColumnRenamed("place", "model_id")


def predict_models(vis: DataFrame, components: DataFrame, ra0: float, dec0: float, flux: Column) -> DataFrame:
    """(model_id, key, m_re, m_im): component predictions of every model, summed in one pass over the rows."""
    listed = to_lm(components, ra0, dec0).select("model_id", "comp_id", "l", "m", "n", F.col("flux0").alias("flux"))
    return component_visibilities(vis, listed, flux)


def for_models(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Every row with every model_id of ``models`` (a row each), an output that is models times rows by definition."""
    return rows.crossJoin(F.broadcast(models) if models.count() <= 100_000 else models)


def predict_sky_models(
    vis: DataFrame, models: DataFrame, *, components: DataFrame | None = None, ra0: float = 0.0, dec0: float = 0.0, flux: Column | None = None, images: DataFrame | None = None, npixel: int = 0, cellsize: float = 0.0,
    gains: DataFrame | None = None, interval: float = 1.0, first: float = 0.0, cross: bool = True, padding: int = 2,
) -> DataFrame:
    """(model_id, key, m_re, m_im) of every model in ``models`` (model_id): its components, its image within its mask, and
    its own gains applied to both.

    ``images`` has (model_id, pixel, value, mask). A component counts by its model's mask at its nearest pixel where there is an image
    of that model with a mask, and all of it where there isn't. ``gains`` has model_id beside the columns of a gain
    table; models without gains keep their visibilities. One job serves all models: model_id is one more key throughout.
    """
    parts = []
    if components is not None:
        listed = to_lm(components, ra0, dec0)
        if images is not None:
            place = listed.withColumns({"y": F.floor(npixel // 2 + F.col("m") / cellsize + 0.5), "x": F.floor(npixel // 2 - F.col("l") / cellsize + 0.5)})
            masks = images.groupBy("model_id", "y", "x").agg(F.max("mask").alias("__mask"))
            listed = place.join(masks, ["model_id", "y", "x"], "left").withColumn("flux0", F.col("flux0") * F.coalesce("__mask", F.lit(1.0)))
        parts.append(component_visibilities(vis, listed.select("model_id", "comp_id", "l", "m", "n", F.col("flux0").alias("flux")), F.lit(1.0) if flux is None else flux))
    if images is not None:
        shown = images.select("model_id", *PIXEL, (F.col("value") * F.col("mask")).alias("value"))
        lit = shown.where("value <> 0").select("model_id").distinct()
        parts.append(imaging.predict(for_models(vis, lit), shown, npixel, cellsize, keys=["model_id", "chan", "pol"], padding=padding).select("model_id", *KEY, "m_re", "m_im"))
    # A model without anything is 0, so that every model has every row.
    parts.append(for_models(vis.select(*KEY), models.select("model_id")).select("model_id", *KEY, F.lit(0.0).alias("m_re"), F.lit(0.0).alias("m_im")))
    summed = reduce(DataFrame.unionByName, parts).groupBy("model_id", *KEY).agg(F.sum("m_re").alias("m_re"), F.sum("m_im").alias("m_im"))
    if gains is None:
        return summed
    return _with_gains(summed.select("model_id", *KEY, F.col("m_re").alias("vis_re"), F.col("m_im").alias("vis_im"), F.lit(1.0).alias("weight")), gains, interval, first, cross, inverse=False).select(
        "model_id", *KEY, F.col("vis_re").alias("m_re"), F.col("vis_im").alias("m_im")
    )


def _with_gains(rows: DataFrame, gains: DataFrame, interval: float, first: float, cross: bool, *, inverse: bool) -> DataFrame:
    """Visibilities of models (model_id) with each model's gains; those of models without a gain table stay as they are."""
    owners = gains.select("model_id").distinct()
    mine = apply_gains(rows, gains, interval=interval, first=first, inverse=inverse, cross=cross, keys=["model_id"])
    return mine.unionByName(rows.join(owners, "model_id", "left_anti").select(*mine.columns))


def invert_models(vis: DataFrame, models: DataFrame, npixel: int, cellsize: float, *, gains: DataFrame | None = None, interval: float = 1.0, first: float = 0.0, cross: bool = True, padding: int = 1) -> DataFrame:
    """(model_id, chan, pol, y, x, value): the dirty image of each model's own visibilities (model_id and key), corrected by
    the model's ``gains`` where they are given, within the model's mask where ``models`` has one for the pixel."""
    rows = vis if gains is None else _with_gains(vis, gains, interval, first, cross, inverse=True)
    image = imaging.invert(rows, npixel, cellsize, keys=["model_id", "chan", "pol"], padding=padding)
    masked = image.join(models.select("model_id", *PIXEL, "mask"), ["model_id", *PIXEL], "left")
    return masked.withColumn("value", F.col("value") * F.coalesce("mask", F.lit(1.0))).drop("mask")


def convolve_models(models: DataFrame, width: float) -> DataFrame:
    """(model_id, pixel, value): each model's image smoothed by a Gaussian of that width; the mask is applied first."""
    rows = models.select("model_id", *PIXEL, (F.col("value") * F.col("mask")).alias("value"))
    return smooth(rows, width, keys=["model_id", "chan", "pol"])


def convolve_with_psf(vis: DataFrame, models: DataFrame, images: DataFrame, npixel: int, cellsize: float, *, padding: int = 2, **components: object) -> DataFrame:
    """(model_id, pixel, value): each model (its image within its mask, and its components) as the samples of ``vis`` see it: predicted and
    inverted without gains, so convolved with their point-spread function."""
    seen = predict_sky_models(vis, models, images=images, npixel=npixel, cellsize=cellsize, padding=padding, **components)
    named = seen.join(vis.select(*KEY, "u", "v", "w", "weight", "imaging_weight"), KEY).withColumnsRenamed({"m_re": "vis_re", "m_im": "vis_im"})
    return invert_models(named, images, npixel, cellsize, padding=padding)
