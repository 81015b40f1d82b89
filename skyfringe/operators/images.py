"""Image operators on pixel tables (chan, pol, y, x, value). Absent pixels are 0."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfringe.functions.coordinates import lmn_to_sky, sky_to_lmn
from skyfringe.functions.windows import lanczos_kernel, sinc_kernel

from .calibration import linked_groups, materialize
from .fourier import fft_plane
from .visibility import exact_median

PIXEL = ["chan", "pol", "y", "x"]


def normalise(image: DataFrame, weights: DataFrame) -> DataFrame:
    """value by the weight of its (chan, pol), 0 where that is not positive."""
    joined = image.join(weights.select("chan", "pol", F.col("weight").alias("__wt")), ["chan", "pol"])
    return joined.withColumn("value", F.when(F.col("__wt") > 0, F.col("value") / F.col("__wt")).otherwise(F.lit(0.0))).select(*image.columns)


def add_images(first: DataFrame, second: DataFrame) -> DataFrame:
    """The sum; as a union and one aggregation it needs no outer join."""
    return first.select(*PIXEL, "value").unionByName(second.select(*PIXEL, "value")).groupBy(*PIXEL).agg(F.sum("value").alias("value"))


def sum_images(images: DataFrame, weights: DataFrame) -> DataFrame:
    """(image_id, pixels) and (image_id, chan, pol, weight) to the weighted mean over images."""
    joined = images.join(weights, ["image_id", "chan", "pol"])
    total = F.sum("weight")
    return joined.groupBy(*PIXEL).agg(F.when(total > 0, F.sum(F.col("value") * F.col("weight")) / total).otherwise(F.lit(0.0)).alias("value"))


def gradients(image: DataFrame) -> DataFrame:
    """Differences to the pixel before along x and along y, 0 at the first."""
    before = lambda line, place: F.lag("value").over(Window.partitionBy("chan", "pol", line).orderBy(place))
    d = lambda line, place: F.coalesce(F.col("value") - before(line, place), F.lit(0.0))
    return image.select(*PIXEL, d("y", "x").alias("gx"), d("x", "y").alias("gy"))


def smooth(image: DataFrame, width: float, *, keys: list[str] | None = None, whole_reach: int = 16) -> DataFrame:
    """Gaussian convolution of each plane (chan and pol where no keys are given), one axis after the other; the kernel has
    2 * ceil(4 width) + 1 numbers. A kernel that reaches over ``whole_reach`` pixels is held within the image's first and last
    lines, by one aggregation: a width that was fitted has no bound, and what lies outside the image isn't asked for."""
    names = [*(keys or PIXEL[:2]), "y", "x"]
    reach = int(-(-4 * width // 1))
    box = image.agg(*(F.coalesce(f(c), F.lit(0)).alias(f"{f.__name__}_{c}") for c in "yx" for f in (F.min, F.max))).first() if reach > whole_reach else None

    def along(rows: DataFrame, axis: str) -> DataFrame:
        low, high = (None, None) if box is None else (box[f"min_{axis}"], box[f"max_{axis}"])
        far = reach if low is None else min(reach, high - low)
        offsets = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(2.718281828459045 ** (-d * d / (2 * width * width))).alias("k")) for d in range(-far, far + 1)))
        spread = rows.withColumn("o", F.explode(offsets)).withColumns({axis: F.col(axis) + F.col("o.d"), "value": F.col("value") * F.col("o.k")})
        inside = spread if low is None else spread.where(F.col(axis).between(low, high))
        return inside.groupBy(*names).agg(F.sum("value").alias("value"))

    return along(along(image.select(*names, "value"), "x"), "y").join(image.select(*names), names)


def frequency_moments(image: DataFrame, frequency: Column, reference: float, n: int) -> DataFrame:
    """(moment, pol, y, x, value): sums over channels of value * ((f - f0) / f0) ** k for k below n."""
    x = (frequency - reference) / reference
    moments = F.array(*(F.struct(F.lit(k).alias("moment"), (F.col("value") * (F.pow(x, F.lit(float(k))) if k else F.lit(1.0))).alias("value")) for k in range(n)))
    return image.select("pol", "y", "x", F.explode(moments).alias("m")).select("pol", "y", "x", "m.*").groupBy("moment", "pol", "y", "x").agg(F.sum("value").alias("value"))


def from_frequency_moments(moments: DataFrame, channels: DataFrame, reference: float) -> DataFrame:
    """Values on each channel (chan, frequency) of the polynomial that the moments are coefficients of."""
    x = (F.col("frequency") - reference) / reference
    term = F.col("value") * F.when(F.col("moment") == 0, F.lit(1.0)).otherwise(F.pow(x, F.col("moment").cast("double")))
    return moments.crossJoin(F.broadcast(channels)).groupBy(*PIXEL).agg(F.sum(term).alias("value"))


def scatter_facets(image: DataFrame, npixel: int, facets: int, overlap: int) -> DataFrame:
    """Each pixel with every facet (fy, fx) that holds it, and its taper there: 1 on the facet's inner part, falling
    linearly over what it shares with a neighbour, so that overlapping facets can be averaged without an edge."""
    step = npixel // facets
    starts = F.array(*(F.lit(k * step) for k in range(facets)))
    cover = lambda c: F.filter(starts, lambda s: (F.col(c) >= s - overlap) & (F.col(c) < s + step + overlap))
    rows = image.withColumn("sy", F.explode(cover("y"))).withColumn("sx", F.explode(cover("x")))

    def fall(c: str) -> Column:
        if not overlap:
            return F.lit(1.0)
        inside = F.least(F.col(c) - (F.col(f"s{c}") - overlap), F.col(f"s{c}") + step + overlap - 1 - F.col(c)) + 1
        return F.least(F.lit(1.0), inside / (2.0 * overlap + 1))

    return rows.select(*PIXEL, "value", (F.col("sy") / step).cast("long").alias("fy"), (F.col("sx") / step).cast("long").alias("fx"), (fall("y") * fall("x")).alias("taper"))


def gather_facets(facets: DataFrame) -> DataFrame:
    """The mean over facets of each pixel, by their taper where they have one."""
    if "taper" not in facets.columns:
        return facets.groupBy(*PIXEL).agg(F.avg("value").alias("value"))
    return facets.groupBy(*PIXEL).agg((F.sum(F.col("value") * F.col("taper")) / F.sum("taper")).alias("value"))


def map_facets(image: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], npixel: int, facets: int, overlap: int) -> DataFrame:
    """``function`` on each (chan, pol, facet) as pandas (y, x, value), and the gathered result."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = function(pdf[["y", "x", "value"]].reset_index(drop=True))
        return pd.DataFrame({"chan": pdf["chan"].iloc[0], "pol": pdf["pol"].iloc[0], "y": out["y"], "x": out["x"], "value": out["value"]})

    cut = scatter_facets(image, npixel, facets, overlap)
    return gather_facets(cut.groupBy("chan", "pol", "fy", "fx").applyInPandas(one, "chan long, pol long, y long, x long, value double"))


def channel_slabs(image: DataFrame, nchan: int, slabs: int) -> DataFrame:
    return image.withColumn("slab", F.least(F.lit(slabs - 1), F.floor(F.col("chan") / (nchan // slabs))).cast("long"))


def insert_components(image: DataFrame, components: DataFrame, npixel: int, cellsize: float, *, method: str = "nearest", reach: int = 4) -> DataFrame:
    """The image with components (chan, pol, l, m, flux) added; those outside are left out.

    ``nearest`` takes the pixel; ``sinc`` and ``lanczos`` spread a component that lies between pixels over ``reach`` on
    each side, by weights that add up to 1.
    """
    at = {"y": npixel // 2 + F.col("m") / cellsize, "x": npixel // 2 - F.col("l") / cellsize}
    if method != "nearest":
        # Components at one place are one of their summed flux, so that a crowd is spread once.
        components = components.groupBy("chan", "pol", "l", "m").agg(F.sum("flux").alias("flux"))
    place = components.select("chan", "pol", *(F.floor(c + 0.5).alias(n) for n, c in at.items()), *((c - F.floor(c + 0.5)).alias(f"d{n}") for n, c in at.items()), F.col("flux").alias("value"))
    if method != "nearest":
        kernel = sinc_kernel if method == "sinc" else (lambda x: lanczos_kernel(x, reach + 1))
        total = lambda t: F.aggregate(F.col(t), F.lit(0.0), lambda acc, x: acc + x["w"])
        # Weights along both axes are worked out before either is spread, once a place. They are never empty; the outer form keeps
        # Spark from asking that of every component below the sum, which works them out again.
        for n in at:
            off = F.col(f"d{n}")
            place = place.withColumn(f"t{n}", F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.struct(k.alias("k"), kernel(k - off).alias("w"))))  # noqa: B023
        place = place.withColumns({f"s{n}": total(f"t{n}") for n in at})
        for n in at:
            place = place.withColumn("o", F.explode_outer(f"t{n}")).withColumns({n: F.col(n) + F.col("o.k"), "value": F.col("value") * F.col("o.w") / F.col(f"s{n}")}).drop(f"t{n}", f"s{n}", "o")
            place = place.where((F.col(n) >= 0) & (F.col(n) < npixel))
    inside = place.where((F.col("y") >= 0) & (F.col("y") < npixel) & (F.col("x") >= 0) & (F.col("x") < npixel)).select(*PIXEL, "value")
    return add_images(image, inside)


def pad(image: DataFrame, npixel: int, size: int) -> DataFrame:
    """The image of npixel pixels in the middle of one of ``size``; absent pixels are 0."""
    off = size // 2 - npixel // 2
    return image.withColumns({"y": F.col("y") + off, "x": F.col("x") + off})


def extract(image: DataFrame, npixel: int, size: int) -> DataFrame:
    """The middle ``size`` pixels of an image of npixel."""
    off = npixel // 2 - size // 2
    inside = image.where((F.col("y") >= off) & (F.col("y") < off + size) & (F.col("x") >= off) & (F.col("x") < off + size))
    return inside.withColumns({"y": F.col("y") - off, "x": F.col("x") - off})


def bounding_box(image: DataFrame, fraction: float) -> DataFrame:
    """(chan, pol, y_min, y_max, x_min, x_max) of the pixels of each plane above a fraction of its largest; that of a
    convolution kernel is ``kernels.bounding_box``."""
    peak = image.groupBy("chan", "pol").agg((F.max(F.abs("value")) * fraction).alias("__least"))
    seen = image.join(peak, ["chan", "pol"]).where(F.abs("value") > F.col("__least"))
    return seen.groupBy("chan", "pol").agg(*(f(c).alias(f"{c}_{n}") for c in "yx" for n, f in (("min", F.min), ("max", F.max))))


def structure_function(screens: DataFrame, npixel: int, keys: list[str]) -> DataFrame:
    """(keys, dy, dx, value): 1 - a / max(a) for lags of up to a quarter of the screen, a being the autocorrelation summed
    over all screens (times, products) of a key.

    Screens are padded to twice their size and transformed by lines; squares are summed over screens before they are
    transformed back, so nothing is ever joined by lag.
    """
    one = [c for c in screens.columns if c not in ("y", "x", "value")]
    size = 2 * npixel
    cells = screens.select(*one, F.col("y").alias("gv"), F.col("x").alias("gu"), F.col("value").alias("re"), F.lit(0.0).alias("im"))
    power = fft_plane(cells, size, inverse=False, keys=one).groupBy(*keys, "y", "x").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"))
    back = fft_plane(power.select(*keys, F.col("y").alias("gv"), F.col("x").alias("gu"), "re", F.lit(0.0).alias("im")), size, keys=keys)
    top = back.groupBy(*keys).agg(F.max("re").alias("__top"))
    # The zero lag stands in the middle.
    lag = {"dy": F.col("y") - npixel, "dx": F.col("x") - npixel}
    near = back.withColumns(lag).where((F.abs(F.col("dy") + 0.5) <= npixel // 4) & (F.abs(F.col("dx") + 0.5) <= npixel // 4))
    return near.join(top, keys).select(*keys, "dy", "dx", F.when(F.col("__top") > 0, 1 - F.col("re") / F.col("__top")).otherwise(F.lit(0.0)).alias("value"))


def window_mask(image: DataFrame, kind: str, npixel: int, edge: int = 0, threshold: float = 10.0) -> DataFrame:
    """Pixels with mask: ``quarter`` (the inner quarter), ``no_edge`` or ``threshold`` (above so many deviations)."""
    within = lambda low, high: (F.col("y") >= low) & (F.col("y") < high) & (F.col("x") >= low) & (F.col("x") < high)
    if kind == "threshold":
        rows = image.crossJoin(F.broadcast(image.agg(F.stddev_pop("value").alias("__std"))))
        return rows.withColumn("mask", (F.col("value") > threshold * F.col("__std")).cast("double")).drop("__std")
    where = within(npixel // 4, 3 * npixel // 4) if kind == "quarter" else within(edge, npixel - edge)
    return image.withColumn("mask", where.cast("double"))


def statistics(image: DataFrame) -> DataFrame:
    """max, min, maxabs, std, sum, median, medianabs and the mean-free deviation madmed; one row. Medians are found by
    narrowing bins, so no task holds all values."""
    x = image.select(F.col("value").cast("double").alias("x"))
    one = x.agg(F.max("x").alias("max"), F.min("x").alias("min"), F.max(F.abs("x")).alias("maxabs"), F.stddev_pop("x").alias("std"), F.sum("x").alias("sum"))
    middle = exact_median(x, "x")
    off = x.crossJoin(F.broadcast(middle)).select(F.abs(F.col("x") - F.col("median")).alias("x"))
    named = {"median": middle, "medianabs": exact_median(x.select(F.abs("x").alias("x")), "x"), "madmed": exact_median(off, "x")}
    for name, value in named.items():
        one = one.crossJoin(F.broadcast(value.withColumnRenamed("median", name)))
    return one


def voronoi(image: DataFrame, centres: DataFrame, *, array_rows: int = 20_000) -> DataFrame:
    """Each pixel with the id of the nearest centre (id, cy, cx), ties to the smaller id. Of centres at one place only the
    smallest id can be nearest; places of centres go as one array up to ``array_rows`` by count, and beyond in blocks of that size."""
    # Pixels are dealt to all tasks, as a few thousand of them are little to read and much to look up.
    spread = int(image.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = image.select("y", "x").distinct().repartition(spread, "y", "x")
    centres = materialize(centres.groupBy("cy", "cx").agg(F.min("id").alias("id")))
    blocks = max(1, -(-centres.count() // array_rows))
    packed = centres.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("__b")).agg(F.collect_list(F.struct("id", "cy", "cx")).alias("__c")).drop("__b")
    d2 = lambda c: (F.col("y") - c["cy"]) * (F.col("y") - c["cy"]) + (F.col("x") - c["cx"]) * (F.col("x") - c["cx"])
    near = places.crossJoin(F.broadcast(packed) if blocks == 1 else packed).select("y", "x", F.array_min(F.transform("__c", lambda c: F.struct(d2(c).alias("d2"), c["id"].alias("id")))).alias("m"))
    best = near.groupBy("y", "x").agg(F.min("m")["id"].alias("model_id"))
    return image.join(best, ["y", "x"])


def label_sources(image: DataFrame, threshold: float, *, width: float | None = None) -> DataFrame:
    """(pol, y, x, value, label) of the pixels of each product whose mean over channels, smoothed by a Gaussian of ``width``
    pixels where one is given, is above ``threshold``; connected pixels (8 neighbours) share a label. Labels spread to neighbours and
    then jump to the label's own, so rounds grow with the logarithm of a region's width."""
    shown = image if width is None else smooth(image, width).withColumn("value", F.col("value") / (2 * math.pi * width * width))
    mean = shown.groupBy("pol", "y", "x").agg(F.avg("value").alias("value")).where(F.col("value") > threshold)
    cells = materialize(mean.withColumn("id", (F.col("pol") * F.lit(1 << 28) + F.col("y")) * F.lit(1 << 28) + F.col("x")))
    # Half of the neighbours, as a link has no direction; a cell without one links with itself.
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))
    sent = cells.withColumn("o", F.explode(steps)).select(F.col("id").alias("a"), "pol", (F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x"))
    links = sent.join(cells.select("pol", "y", "x", F.col("id").alias("b")), ["pol", "y", "x"]).select("a", "b").union(cells.select("id", "id"))
    return cells.join(linked_groups(links).select(F.col("node").alias("id"), F.col("group").alias("label")), "id").drop("id")


def find_sources(image: DataFrame, threshold: float, least: int, *, width: float | None = None) -> DataFrame:
    """(pol, source_id, pixels, y, x, peak, flux) of the connected regions of ``label_sources`` with at least so many pixels;
    places are weighed by value."""
    weigh = lambda c: (F.sum(F.col(c) * F.col("value")) / F.sum("value")).alias(c)
    cells = label_sources(image, threshold, width=width)
    out = cells.groupBy("pol", F.col("label").alias("source_id")).agg(F.count(F.lit(1)).alias("pixels"), weigh("y"), weigh("x"), F.max("value").alias("peak"), F.sum("value").alias("flux"))
    return out.where(F.col("pixels") >= least)


def source_spectra(image: DataFrame, threshold: float, least: int, *, width: float | None = None) -> DataFrame:
    """(pol, source_id, chan, flux): each source's peak in each channel of the image itself, over the source's pixels."""
    cells = materialize(label_sources(image, threshold, width=width))
    large = cells.groupBy("pol", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("pol", "label")
    met = image.join(cells.join(large, ["pol", "label"]).select("pol", "y", "x", "label"), ["pol", "y", "x"])
    return met.groupBy("pol", F.col("label").alias("source_id"), "chan").agg(F.max("value").alias("flux"))


def clean_threshold(image: DataFrame, fraction: float, least: float) -> DataFrame:
    """max(fraction * peak of the channel mean, least), one row."""
    mean = image.groupBy("pol", "y", "x").agg(F.avg("value").alias("value"))
    return mean.agg(F.greatest(F.max(F.abs("value")) * fraction, F.lit(float(least))).alias("threshold"))


def resample(image: DataFrame, dy: float, dx: float, scale: float, npixel: int) -> DataFrame:
    """Bilinear resampling onto npixel pixels: (y, x) takes the value at (y * scale + dy, x * scale + dx); footprint is
    the sum of the weights of the pixels that are there. Each old pixel is sent to the new ones that it reaches."""
    spark = image.sparkSession
    axis = lambda c, d: spark.range(npixel).select(F.col("id").alias(c), (F.col("id") * scale + d).alias(f"{c}0"))
    new = axis("y", dy).crossJoin(axis("x", dx))
    corner = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    near = new.withColumn("c", F.explode(corner)).withColumns({"__y": F.floor("y0") + F.col("c.a"), "__x": F.floor("x0") + F.col("c.b")})
    weight = (1 - F.abs(F.col("y0") - F.col("__y"))) * (1 - F.abs(F.col("x0") - F.col("__x")))
    near = near.select("y", "x", "__y", "__x", weight.alias("__wt")).where("__wt > 0")
    return _looked_up(image, near)


def _looked_up(image: DataFrame, near: DataFrame) -> DataFrame:
    old = image.select("chan", "pol", F.col("y").alias("__y"), F.col("x").alias("__x"), "value")
    return near.join(old, ["__y", "__x"]).groupBy(*PIXEL).agg(F.sum(F.col("value") * F.col("__wt")).alias("value"), F.sum("__wt").alias("footprint"))


def _cubic(d: Column) -> Column:
    """Weight of a pixel at distance d in cubic convolution; those of four pixels add up to 1."""
    near = (1.5 * d - 2.5) * d * d + 1
    far = ((-0.5 * d + 2.5) * d - 4) * d + 2
    return F.when(d < 1, near).when(d < 2, far).otherwise(F.lit(0.0))


def reproject(image: DataFrame, npixel: int, cellsize: float, centre: tuple[float, float], *, to_npixel: int, to_cellsize: float, to_centre: tuple[float, float]) -> DataFrame:
    """An image about one tangent point of the sky (ra, dec) on the pixels of another, by cubic convolution: (chan, pol, y, x,
    value, footprint).

    Each new pixel becomes a direction, that a place in the old image, and the 16 pixels about it are found by equality.
    Pixels beyond the old image, on the far side of the sky or without a direction have no row; footprint is the weight of
    the pixels that are there, 1 inside. Longitude rises towards smaller x, as for components."""
    spark = image.sparkSession
    axis = lambda c: spark.range(to_npixel).select(F.col("id").alias(c))
    l, m = -(F.col("x") - to_npixel // 2) * to_cellsize, (F.col("y") - to_npixel // 2) * to_cellsize  # noqa: E741
    new = axis("y").crossJoin(axis("x")).withColumns({"__l": l, "__m": m}).where("__l * __l + __m * __m < 1")
    ra, dec = lmn_to_sky(F.col("__l"), F.col("__m"), *(F.lit(float(c)) for c in to_centre))
    sky = new.withColumns({"__ra": ra, "__dec": dec})
    l0, m0, n0 = sky_to_lmn(F.col("__ra"), F.col("__dec"), *(F.lit(float(c)) for c in centre))
    at = sky.withColumns({"y0": npixel // 2 + m0 / cellsize, "x0": npixel // 2 - l0 / cellsize, "__n": n0}).where("__n > -1")
    at = at.where((F.col("y0") >= 0) & (F.col("y0") <= npixel - 1) & (F.col("x0") >= 0) & (F.col("x0") <= npixel - 1))
    taps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-1, 3) for b in range(-1, 3)))
    near = at.select("y", "x", "y0", "x0", F.explode(taps).alias("c")).withColumns({"__y": F.floor("y0") + F.col("c.a"), "__x": F.floor("x0") + F.col("c.b")})
    weight = _cubic(F.abs(F.col("y0") - F.col("__y"))) * _cubic(F.abs(F.col("x0") - F.col("__x")))
    # At the border the pixels that are missing would be 0; the nearest ones stand for them.
    inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(npixel - 1), F.col(c)))
    near = near.select("y", "x", inside("__y").alias("__y"), inside("__x").alias("__x"), weight.alias("__wt")).where("__wt <> 0")
    return _looked_up(image, near)


def fitted_width(psf: DataFrame, npixel: int) -> float:
    """The larger deviation of a Gaussian fitted to the middle 15 x 15 pixels of the first plane of a point-spread function;
    1 pixel where none fits. The logarithm is fitted by a paraboloid, weighed by the square of the value: one
    aggregation of fixed size."""
    first = psf.agg(F.min(F.struct("chan", "pol")).alias("f")).select("f.*")
    y, x = F.col("y") - npixel // 2, F.col("x") - npixel // 2
    rows = psf.join(F.broadcast(first), ["chan", "pol"]).where((F.abs(y) <= 7) & (F.abs(x) <= 7) & (F.col("value") > 0))
    terms = [F.lit(1.0), y, x, y * y, x * x]
    w, g = F.col("value") * F.col("value"), F.log("value")
    sums = [F.sum(w * a * b) for k, a in enumerate(terms) for b in terms[k:]] + [F.sum(w * a * g) for a in terms]
    found = [0.0 if v is None else float(v) for v in rows.agg(*sums).first()]
    matrix, right = np.zeros((5, 5)), np.array(found[15:])
    matrix[np.triu_indices(5)] = found[:15]
    matrix = matrix + np.triu(matrix, 1).T
    if np.linalg.matrix_rank(matrix) < 5:
        return 1.0
    *_, a, b = np.linalg.solve(matrix, right)
    return float(max(1 / math.sqrt(-2 * a), 1 / math.sqrt(-2 * b))) if a < 0 and b < 0 else 1.0


def restore(model: DataFrame, residual: DataFrame | None = None, width: float | None = None, *, psf: DataFrame | None = None, npixel: int | None = None) -> DataFrame:
    """The model convolved with a Gaussian beam of peak 1 and that width, or the one fitted to ``psf``, and the residual added.
    The result has the pixels of the residual, or those of the model where there is none."""
    if width is None:
        if psf is None or npixel is None:
            raise ValueError("a width, or a point-spread function and its pixels, must be given")
        width = fitted_width(psf, npixel)
    if residual is None:
        return smooth(model, width)
    return add_images(smooth(add_images(model, residual.withColumn("value", F.lit(0.0))), width), residual)
