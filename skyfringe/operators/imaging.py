"""Imaging between visibilities and images: kernel gridding with grid correction, w-stacks, time slices and facets.

Everything is a grid of sparse cells, a transform by lines and a few equality joins. A w slice, a time slice or a facet
is one more key of the grid, so all slices are gridded in one pass over the visibilities and spread like planes.
Sizes that are broadcast are parameters, the pixels of an axis, or small by count: slices are counted, and shuffled when
there are many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfringe.functions import complexmath as cx

from .gridding import degrid_visibility, fft_plane, grid_visibility, kernel_axis, spheroidal_kernel
from .images import extract, pad
from .kernels import AWKernel, degrid_with, grid_with, image_taper
from .visibility import KEY, w_slices

PLANE = ["chan", "pol"]
SUPPORT, OVERSAMPLING = 3, 16


def grid_correction(spark: SparkSession, npixel: int, *, support: int = SUPPORT, oversampling: int = OVERSAMPLING) -> DataFrame:
    """(p, correction): what gridding with the kernel multiplies pixel p of an axis by; npixel rows."""
    off = F.col("s") - ((F.col("o") + 0.5) / oversampling - 0.5)
    pixels = spark.range(npixel).select(F.col("id").alias("p"))
    turns = off * (F.col("p") - npixel // 2) / npixel
    return pixels.crossJoin(F.broadcast(kernel_axis(spark, support, oversampling))).groupBy("p").agg((F.sum(F.col("k") * F.cos(turns * cx.TWO_PI)) / oversampling).alias("correction"))


def _corrected(image: DataFrame, npixel: int, columns: list[str], **kernel: int) -> DataFrame:
    """``columns`` by the grid correction of both axes."""
    axis = grid_correction(image.sparkSession, npixel, **kernel)
    side = lambda c: F.broadcast(axis.select(F.col("p").alias(c), F.col("correction").alias(f"__{c}")))
    rows = image.join(side("y"), "y").join(side("x"), "x")
    return rows.withColumns({c: F.col(c) / (F.col("__y") * F.col("__x")) for c in columns}).drop("__y", "__x")


def _offset(c: str, npixel: int, cellsize: float) -> Column:
    return (F.col(c) - npixel // 2) * cellsize


def _n_minus_1(npixel: int, cellsize: float) -> Column:
    """sqrt(1 - l ** 2 - m ** 2) - 1 of a pixel, -1 beyond the horizon."""
    l, m = _offset("x", npixel, cellsize), _offset("y", npixel, cellsize)  # noqa: E741
    return F.sqrt(F.greatest(1 - l * l - m * m, F.lit(0.0))) - 1


def w_beam(image: DataFrame, w: Column, npixel: int, cellsize: float) -> DataFrame:
    """``image`` with beam_re and beam_im: exp(-2 pi i w (n - 1)) at each pixel."""
    re, im = cx.phasor(w * _n_minus_1(npixel, cellsize))
    return image.withColumns({"beam_re": re, "beam_im": im})


def _gridded(vis: DataFrame, npixel: int, cellsize: float, keys: list[str], psf: bool, kernel: dict[str, int]) -> DataFrame:
    rows = vis.withColumns({"vis_re": F.lit(1.0), "vis_im": F.lit(0.0)}) if psf else vis
    k = spheroidal_kernel(vis.sparkSession, kernel.get("support", SUPPORT), kernel.get("oversampling", OVERSAMPLING))
    return grid_visibility(rows, k, npixel, cellsize, kernel.get("oversampling", OVERSAMPLING), keys=keys)


def _normalised(image: DataFrame, grid: DataFrame, npixel: int, keys: list[str], kernel: dict[str, int]) -> DataFrame:
    total = grid.groupBy(*keys).agg(F.sum("weight").alias("total"))
    joined = _corrected(image, npixel, ["value"], **kernel).join(total, keys)
    value = F.when(F.col("total") > 0, F.col("value") * npixel**2 / F.col("total")).otherwise(F.lit(0.0))
    return joined.select(*keys, "y", "x", value.alias("value"))


def invert(vis: DataFrame, npixel: int, cellsize: float, *, psf: bool = False, keys: list[str] | None = None, padding: int = 1, **kernel: int) -> DataFrame:
    """(chan, pol, y, x, value): the dirty image, or the point-spread function, with kernel and grid correction.

    The correction is large near the edge of what is transformed, and so is what folds over there; with ``padding`` 2 a
    field of twice the size is made and its middle kept.
    """
    keys, size = keys or PLANE, npixel * padding
    grid = _gridded(vis, size, cellsize, keys, psf, kernel)
    image = _normalised(fft_plane(grid, size, keys=keys).withColumnRenamed("re", "value"), grid, size, keys, kernel)
    return extract(image, size, npixel) if padding > 1 else image


def predict(vis: DataFrame, image: DataFrame, npixel: int, cellsize: float, *, keys: list[str] | None = None, padding: int = 1, **kernel: int) -> DataFrame:
    """Key, m_re, m_im of every row (and keys beyond chan and pol): the model visibilities of an image (value, or re and
    im), by transform and degridding. Rows off the grid, or whose plane the image lacks, are 0. ``padding`` as for
    ``invert``."""
    keys, size = keys or PLANE, npixel * padding
    rows = image if "re" in image.columns else image.withColumn("re", F.col("value")).withColumn("im", F.lit(0.0))
    cells = _corrected(pad(rows, npixel, size), size, ["re", "im"], **kernel).select(*keys, F.col("y").alias("gv"), F.col("x").alias("gu"), "re", "im")
    grid = fft_plane(cells, size, inverse=False, keys=keys).withColumnRenamed("y", "gv").withColumnRenamed("x", "gu")
    found = degrid_visibility(vis, grid, size, cellsize, support=kernel.get("support", SUPPORT), oversampling=kernel.get("oversampling", OVERSAMPLING), keys=keys)
    return found.withColumnsRenamed({"vis_re": "m_re", "vis_im": "m_im"})


# --- w projection ------------------------------------------------------------------------------------------------------


def _tapered(image: DataFrame, npixel: int, columns: list[str]) -> DataFrame:
    """``columns`` by the taper that the kernels of ``AWKernel`` carry; npixel numbers, joined by broadcast. It is 0 at no
    pixel but may be far down at the edge of the field."""
    axis = image.sparkSession.createDataFrame([(k, float(t)) for k, t in enumerate(image_taper(npixel))], "p long, t double")
    side = lambda c: F.broadcast(axis.select(F.col("p").alias(c), F.col("t").alias(f"__{c}")))
    rows = image.join(side("y"), "y").join(side("x"), "x")
    return rows.withColumns({c: F.col(c) / (F.col("__y") * F.col("__x")) for c in columns}).drop("__y", "__x")


def aw_kernel(npixel: int, cellsize: float, step: float, *, support: int = 8, oversampling: int = 8, beam: Callable | None = None) -> AWKernel:
    return AWKernel(support, oversampling, npixel * cellsize, step, beam, max(128, 8 * (2 * support + 1)))


def aw_invert(vis: DataFrame, npixel: int, cellsize: float, step: float, *, psf: bool = False, padding: int = 2, keys: list[str] | None = None, **kernel: object) -> DataFrame:
    """The dirty image with the w term, and a beam where one is given, in the gridding kernels: one grid for all w.

    ``step`` is the distance of w planes in wavelengths; kernels are conjugated for predicting. A beam multiplies the image."""
    keys, size = keys or PLANE, npixel * padding
    k = aw_kernel(size, cellsize, step, **kernel)
    if psf:
        # The response to a point at the centre, where the w term is 1.
        vis = vis.withColumns({"vis_re": F.lit(1.0), "vis_im": F.lit(0.0)})
    grid = grid_with(vis, k, size, cellsize, keys=keys)
    total = grid.groupBy(*keys).agg(F.sum("weight").alias("total"))
    image = _tapered(fft_plane(grid, size, keys=keys).withColumnRenamed("re", "value"), size, ["value"]).join(total, keys)
    value = F.when(F.col("total") > 0, F.col("value") * size**2 / F.col("total")).otherwise(F.lit(0.0))
    return extract(image.select(*keys, "y", "x", value.alias("value")), size, npixel)


def aw_predict(vis: DataFrame, image: DataFrame, npixel: int, cellsize: float, step: float, *, padding: int = 2, keys: list[str] | None = None, **kernel: object) -> DataFrame:
    """Key, m_re, m_im of every row: model visibilities of an image with the w term, and a beam, in the kernels."""
    keys, size = keys or PLANE, npixel * padding
    rows = image.withColumn("re", F.col("value")).withColumn("im", F.lit(0.0))
    cells = _tapered(pad(rows, npixel, size), size, ["re", "im"]).select(*keys, F.col("y").alias("gv"), F.col("x").alias("gu"), "re", "im")
    grid = fft_plane(cells, size, inverse=False, keys=keys).withColumnRenamed("y", "gv").withColumnRenamed("x", "gu")
    found = degrid_with(vis, grid, aw_kernel(size, cellsize, step, **kernel), size, cellsize, keys=keys)
    return found.withColumnsRenamed({"vis_re": "m_re", "vis_im": "m_im"})


# --- w stacks ---------------------------------------------------------------------------------------------------------


def _with_slices(vis: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """(visibilities with their w slice, (slice, w) of every slice that has rows)."""
    rows = w_slices(vis, width)
    span = vis.agg(F.max(F.abs("w")).alias("most"))
    n = 1 + 2 * F.round(F.col("most") / width)
    slices = rows.select("slice").distinct().crossJoin(F.broadcast(span))
    at = F.when(n > 1, F.col("slice") * (2 * F.col("most") / (n - 1)) - F.col("most")).otherwise(F.lit(0.0))
    return rows, small(slices.select("slice", at.alias("slice_w")))


def small(slices: DataFrame, *, most: int = 100_000) -> DataFrame:
    """A table of slices, marked for broadcast if a count says that it has at most ``most`` rows."""
    return F.broadcast(slices) if slices.count() <= most else slices


def wstack_invert(vis: DataFrame, npixel: int, cellsize: float, width: float, *, psf: bool = False, **kernel: int) -> DataFrame:
    """The dirty image of visibilities in w slices: every slice's image by its w beam, summed."""
    rows, slices = _with_slices(vis, width)
    keys = [*PLANE, "slice"]
    grid = _gridded(rows, npixel, cellsize, keys, psf, kernel)
    image = w_beam(fft_plane(grid, npixel, keys=keys).join(slices, "slice"), F.col("slice_w"), npixel, cellsize)
    re, _ = cx.mul((F.col("re"), F.col("im")), cx.conj(cx.pair("beam")))
    summed = image.withColumn("value", re).groupBy(*PLANE, "y", "x").agg(F.sum("value").alias("value"))
    return _normalised(summed, grid, npixel, PLANE, kernel)


def wstack_predict(vis: DataFrame, image: DataFrame, npixel: int, cellsize: float, width: float, **kernel: int) -> DataFrame:
    """Key, m_re, m_im of an image, each w slice with its w beam."""
    rows, slices = _with_slices(vis, width)
    beamed = w_beam(image.crossJoin(slices), F.col("slice_w"), npixel, cellsize)
    cells = beamed.select(*PLANE, "slice", "y", "x", (F.col("value") * F.col("beam_re")).alias("re"), (F.col("value") * F.col("beam_im")).alias("im"))
    return predict(rows, cells, npixel, cellsize, keys=[*PLANE, "slice"], **kernel).drop("slice")


# --- time slices and facets -------------------------------------------------------------------------------------------


def _time_planes(vis: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """(visibilities with their slice of time, (slice, p, q) of the plane w = p u + q v fitted to each)."""
    rows = vis.withColumn("slice", F.floor(F.col("time") / width).cast("long"))
    s = {a + b: F.sum(F.col("weight") * F.col(a) * F.col(b)) for a, b in ("uu", "uv", "vv", "uw", "vw")}
    det = s["uu"] * s["vv"] - s["uv"] * s["uv"]
    solved = lambda a: F.when(F.abs(det) > 1e-12, a / det).otherwise(F.lit(0.0))
    planes = rows.groupBy("slice").agg(solved(s["uw"] * s["vv"] - s["vw"] * s["uv"]).alias("p"), solved(s["vw"] * s["uu"] - s["uw"] * s["uv"]).alias("q"))
    return rows, small(planes)


def _moved(pixels: DataFrame, npixel: int, cellsize: float) -> DataFrame:
    """(y, x) with slices' planes to the four pixels (__y, __x) about (y, x) moved by (q, p) (n - 1), and their parts."""
    moved = pixels.withColumn("n", _n_minus_1(npixel, cellsize)).withColumns({"y0": F.col("y") + F.col("q") * F.col("n") / cellsize, "x0": F.col("x") + F.col("p") * F.col("n") / cellsize})
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    near = moved.withColumn("c", F.explode(corners)).withColumns({"__y": F.floor("y0") + F.col("c.a"), "__x": F.floor("x0") + F.col("c.b")})
    part = (1 - F.abs(F.col("y0") - F.col("__y"))) * (1 - F.abs(F.col("x0") - F.col("__x")))
    return near.withColumn("part", part).where("part > 0").drop("n", "y0", "x0", "c", "p", "q")


def timeslice_invert(vis: DataFrame, npixel: int, cellsize: float, width: float, *, psf: bool = False, keys: list[str] | None = None, **kernel: int) -> DataFrame:
    """The dirty image of visibilities in slices of time, in each of which w is a plane p u + q v.

    A slice's image has its coordinates moved by (p, q) (n - 1); pixels are looked up there, bilinearly, and the slices
    averaged by weight.
    """
    plane = keys or PLANE
    rows, planes = _time_planes(vis, width)
    keys = [*plane, "slice"]
    grid = _gridded(rows, npixel, cellsize, keys, psf, kernel)
    weights = grid.groupBy(*keys).agg(F.sum("weight").alias("total"))
    image = _corrected(fft_plane(grid, npixel, keys=keys).withColumnRenamed("re", "value"), npixel, ["value"], **kernel).select(*keys, F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("value") * npixel**2)
    image = image.toDF(*keys, "__y", "__x", "value")
    spark = vis.sparkSession
    axis = lambda c: spark.range(npixel).select(F.col("id").alias(c))
    near = _moved(axis("y").crossJoin(axis("x")).crossJoin(planes), npixel, cellsize)
    summed = near.join(image, ["slice", "__y", "__x"]).groupBy(*plane, "y", "x").agg(F.sum(F.col("value") * F.col("part")).alias("value"))
    total = weights.groupBy(*plane).agg(F.sum("total").alias("total"))
    return summed.join(total, plane).select(*plane, "y", "x", F.when(F.col("total") > 0, F.col("value") / F.col("total")).otherwise(F.lit(0.0)).alias("value"))


def timeslice_predict(vis: DataFrame, image: DataFrame, npixel: int, cellsize: float, width: float, **kernel: int) -> DataFrame:
    """Key, m_re, m_im of every row: each pixel of the image goes, bilinearly, to where a slice of time sees it, and each
    slice's image is predicted for its rows; the other way round of ``timeslice_invert``."""
    rows, planes = _time_planes(vis, width)
    seen = _moved(image.where("value <> 0").crossJoin(planes), npixel, cellsize)
    shown = seen.groupBy(*PLANE, "slice", F.col("__y").alias("y"), F.col("__x").alias("x")).agg(F.sum(F.col("value") * F.col("part")).alias("value"))
    inside = shown.where((F.col("y") >= 0) & (F.col("y") < npixel) & (F.col("x") >= 0) & (F.col("x") < npixel))
    return predict(rows, inside, npixel, cellsize, keys=[*PLANE, "slice"], **kernel).drop("slice")


def _facet_centre(npixel: int, cellsize: float, facets: int) -> tuple[Column, Column]:
    """(l, m) of the centre of a row's facet."""
    side = npixel // facets
    at = lambda f: (f * side + side // 2 - npixel // 2) * cellsize
    return at(F.col("facet") % facets), at(F.floor(F.col("facet") / facets))


def _facet_turns(npixel: int, cellsize: float, facets: int) -> Column:
    l, m = _facet_centre(npixel, cellsize, facets)  # noqa: E741
    return F.col("u") * l + F.col("v") * m + F.col("w") * (F.sqrt(1 - l * l - m * m) - 1)


def _w_about_centre(image: DataFrame, npixel: int, cellsize: float, facets: int) -> DataFrame:
    """A facet's pixels (of twice its size, about its centre) with the w beam of a slice less that of the centre, which its
    visibilities were turned by."""
    side = npixel // facets
    l0, m0 = _facet_centre(npixel, cellsize, facets)
    l, m = l0 + (F.col("x") - side) * cellsize, m0 + (F.col("y") - side) * cellsize  # noqa: E741
    n = lambda a, b: F.sqrt(F.greatest(1 - a * a - b * b, F.lit(0.0)))
    re, im = cx.phasor(F.col("slice_w") * (n(l, m) - n(l0, m0)))
    return image.withColumns({"beam_re": re, "beam_im": im})


def facets_invert(vis: DataFrame, npixel: int, cellsize: float, facets: int, *, psf: bool = False, width: float | None = None, **kernel: int) -> DataFrame:
    """The dirty image in facets ** 2 pieces, each imaged about its own centre, where w is small; with ``width`` each facet's
    visibilities are in w slices too, and w within it is exact but for half a slice."""
    side = npixel // facets
    rows = vis.withColumn("facet", F.explode(F.sequence(F.lit(0), F.lit(facets * facets - 1))))
    # A point-spread function is that of each facet's own centre.
    re, im = (F.lit(1.0), F.lit(0.0)) if psf else cx.mul(cx.pair("vis"), cx.conj(cx.phasor(_facet_turns(npixel, cellsize, facets))))
    keys = [*PLANE, "facet"]
    # Twice the facet's size is imaged, so that its edges are free of what folds over.
    if width is None:
        image = invert(rows.withColumns({"vis_re": re, "vis_im": im}), 2 * side, cellsize, keys=keys, **kernel)
    else:
        sliced, slices = _with_slices(rows.withColumns({"vis_re": re, "vis_im": im}), width)
        grid = _gridded(sliced, 2 * side, cellsize, [*keys, "slice"], False, kernel)
        seen = _w_about_centre(fft_plane(grid, 2 * side, keys=[*keys, "slice"]).join(slices, "slice"), npixel, cellsize, facets)
        real, _ = cx.mul((F.col("re"), F.col("im")), cx.conj(cx.pair("beam")))
        summed = seen.withColumn("value", real).groupBy(*keys, "y", "x").agg(F.sum("value").alias("value"))
        image = _normalised(summed, grid, 2 * side, keys, kernel)
    inside = image.withColumns({"y": F.col("y") - (side - side // 2), "x": F.col("x") - (side - side // 2)}).where(f"y >= 0 AND y < {side} AND x >= 0 AND x < {side}")
    place = lambda c, f: (F.col(c) + f * side).cast("long").alias(c)
    return inside.select(*PLANE, place("y", F.floor(F.col("facet") / facets)), place("x", F.col("facet") % facets), "value")


def facets_predict(vis: DataFrame, image: DataFrame, npixel: int, cellsize: float, facets: int, *, width: float | None = None, **kernel: int) -> DataFrame:
    """Key, m_re, m_im of every row: each facet of the image is predicted about its own centre, in w slices with ``width``,
    and turned back to the whole image's; the facets are summed."""
    side = npixel // facets
    facet = lambda c: F.least(F.lit(facets - 1), F.floor(F.col(c) / side))
    cut = image.where("value <> 0").withColumn("facet", (facet("y") * facets + facet("x")).cast("long"))
    local = lambda c, f: (F.col(c) - f * side - side // 2 + side).alias(c)
    cut = cut.select(*PLANE, "facet", local("y", F.floor(F.col("facet") / facets)), local("x", F.col("facet") % facets), "value")
    lit = small(cut.select(*PLANE, "facet").distinct(), most=facets * facets * 10_000)
    rows = vis.join(lit, PLANE)
    keys = [*PLANE, "facet"]
    if width is None:
        found = predict(rows, cut, 2 * side, cellsize, keys=keys, **kernel)
    else:
        sliced, slices = _with_slices(vis, width)
        sliced = sliced.join(lit, PLANE)
        seen = _w_about_centre(cut.crossJoin(slices), npixel, cellsize, facets)
        cells = seen.select(*keys, "slice", "y", "x", (F.col("value") * F.col("beam_re")).alias("re"), (F.col("value") * F.col("beam_im")).alias("im"))
        found = predict(sliced, cells, 2 * side, cellsize, keys=[*keys, "slice"], **kernel).drop("slice")
    turned = found.join(vis.select(*KEY, "u", "v", "w"), KEY)
    re, im = cx.mul(cx.pair("m"), cx.phasor(_facet_turns(npixel, cellsize, facets)))
    summed = turned.select(*KEY, re.alias("m_re"), im.alias("m_im"))
    nothing = vis.select(*KEY, F.lit(0.0).alias("m_re"), F.lit(0.0).alias("m_im"))
    return summed.unionByName(nothing).groupBy(*KEY).agg(F.sum("m_re").alias("m_re"), F.sum("m_im").alias("m_im"))


def predict_list(vis: DataFrame, image: DataFrame, npixel: int, cellsize: float, *, context: str = "2d", facets: int = 1, width: float | None = None, padding: int = 2, **kernel: object) -> DataFrame:
    """Key, m_re, m_im in one of the contexts "2d", "wstack", "timeslice", "wprojection", or each but the last two in facets."""
    if context not in ("2d", "wstack", "timeslice", "wprojection"):
        raise ValueError(f"no context {context}")
    if facets > 1:
        if context not in ("2d", "wstack"):
            raise ValueError("facets go with 2d and wstack")
        return facets_predict(vis, image, npixel, cellsize, facets, width=width if context == "wstack" else None, **kernel)
    if context == "wstack":
        return wstack_predict(vis, image, npixel, cellsize, width, **kernel)
    if context == "timeslice":
        return timeslice_predict(vis, image, npixel, cellsize, width, **kernel)
    if context == "wprojection":
        return aw_predict(vis, image, npixel, cellsize, width, padding=padding, **kernel)
    return predict(vis, image, npixel, cellsize, padding=padding, **kernel)


def invert_list(vis: DataFrame, npixel: int, cellsize: float, *, context: str = "2d", facets: int = 1, width: float | None = None, psf: bool = False, padding: int = 2, **kernel: object) -> DataFrame:
    """The dirty image (or the point-spread function) in the contexts of ``predict_list``."""
    if context not in ("2d", "wstack", "timeslice", "wprojection"):
        raise ValueError(f"no context {context}")
    if facets > 1:
        if context not in ("2d", "wstack"):
            raise ValueError("facets go with 2d and wstack")
        return facets_invert(vis, npixel, cellsize, facets, psf=psf, width=width if context == "wstack" else None, **kernel)
    if context == "wstack":
        return wstack_invert(vis, npixel, cellsize, width, psf=psf, **kernel)
    if context == "timeslice":
        return timeslice_invert(vis, npixel, cellsize, width, psf=psf, **kernel)
    if context == "wprojection":
        return aw_invert(vis, npixel, cellsize, width, psf=psf, padding=padding, **kernel)
    return invert(vis, npixel, cellsize, psf=psf, padding=padding, **kernel)


# --- lists of workflows -----------------------------------------------------------------------------------------------


def residual(vis: DataFrame, model: DataFrame, npixel: int, cellsize: float, *, width: float | None = None, context: str | None = None, **options: object) -> tuple[DataFrame, DataFrame]:
    """(visibilities less those of the model image, their dirty image) in a context of ``predict_list``: "2d", or "wstack" where
    only ``width`` is given."""
    options = {"context": context or ("2d" if width is None else "wstack"), "width": width, "padding": 1} | options
    left = subtract_model(vis, predict_list(vis, model, npixel, cellsize, **options))
    return left, invert_list(left, npixel, cellsize, **options)


def subtract_model(vis: DataFrame, predicted: DataFrame) -> DataFrame:
    """Visibilities less those predicted (m_re, m_im); a row without a prediction stays as it is."""
    zero = F.lit(0.0)
    return vis.join(predicted, KEY, "left").withColumns({"vis_re": F.col("vis_re") - F.coalesce("m_re", zero), "vis_im": F.col("vis_im") - F.coalesce("m_im", zero)}).drop("m_re", "m_im")


def zeroed(vis: DataFrame) -> DataFrame:
    """The same samples with empty visibilities."""
    return vis.withColumns({"vis_re": F.lit(0.0), "vis_im": F.lit(0.0)})
