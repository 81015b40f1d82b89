"""Gridding, weighting and imaging.

Grids are sparse: only touched cells are rows. Gridding is an explode by the kernel's footprint (at most support ** 2
rows a visibility, joined by broadcast to a kernel whose size is a parameter) and one aggregation, whose partial sums
before the shuffle keep what is sent at the size of the grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfringe.functions import complexmath as cx
from skyfringe.functions.windows import spheroidal

from .fourier import fft_plane
from .kernels import Kernel, degrid_with

CELL = ["chan", "pol", "gv", "gu"]


def grid_cells(vis: DataFrame, npixel: int, cellsize: float) -> DataFrame:
    """Nearest cell (gu, gv) of a grid of npixel, centre npixel // 2, and du, dv, the rest in cells. Rows outside go."""
    at = lambda c: F.col(c) * (npixel * cellsize) + npixel // 2
    near = lambda c: F.floor(at(c) + 0.5)
    rows = vis.withColumns({"gu": near("u"), "gv": near("v"), "du": at("u") - near("u"), "dv": at("v") - near("v")})
    return rows.where((F.col("gu") >= 0) & (F.col("gu") < npixel) & (F.col("gv") >= 0) & (F.col("gv") < npixel))


def cell_mapping(vis: DataFrame, npixel: int, cellsize: float, *, oversampling: int, w_step: float | None = None, first: float | None = None, width: float = 1.0, tolerance: float = 1e-8) -> DataFrame:
    """Where each visibility goes: cell (gu, gv), sub-cell of the kernel (ou, ov), w plane about 0 and channel of the grid.

    ``w_step`` is the distance of w planes. With ``first`` and ``width`` the grid's channels are those frequencies, ``grid_chan``
    the nearest and ``aligned`` whether it lies within ``tolerance`` of a channel's width of it."""
    sub = lambda c: F.least(F.lit(oversampling - 1), F.floor((F.col(c) + 0.5) * oversampling)).cast("long")
    rows = grid_cells(vis, npixel, cellsize).withColumns({"ou": sub("du"), "ov": sub("dv"), "w_plane": (F.rint(F.col("w") / w_step) if w_step else F.lit(0)).cast("long")})
    if first is None:
        return rows
    at = (F.col("frequency") - first) / width
    return rows.withColumns({"grid_chan": F.rint(at).cast("long"), "aligned": F.abs(at - F.rint(at)) <= tolerance})


def grid_weights(vis: DataFrame, npixel: int, cellsize: float, *, by_channel: bool = True) -> DataFrame:
    """Imaging weight in each touched cell; without ``by_channel``, over all channels."""
    keys = CELL if by_channel else CELL[1:]
    return grid_cells(vis, npixel, cellsize).groupBy(*keys).agg(F.sum("imaging_weight").alias("weight"))


def weight_uniform(vis: DataFrame, npixel: int, cellsize: float) -> DataFrame:
    """imaging_weight by the weight of the cell, summed over all channels; rows without cell weight stay as they are."""
    rows = grid_cells(vis, npixel, cellsize)
    density = grid_weights(vis, npixel, cellsize, by_channel=False).withColumnRenamed("weight", "__d")
    joined = rows.join(density, CELL[1:])
    return joined.withColumn("imaging_weight", F.when(F.col("__d") != 0, F.col("imaging_weight") / F.col("__d")).otherwise(F.col("imaging_weight"))).select(*vis.columns)


def grid_weights_both_halves(vis: DataFrame, npixel: int, cellsize: float) -> DataFrame:
    """Weights of the cells when each visibility also counts at (-u, -v): the rows twice, one aggregation."""
    return grid_weights(vis.unionByName(vis.withColumns({"u": -F.col("u"), "v": -F.col("v")})), npixel, cellsize, by_channel=False)


def kernel_axis(spark: SparkSession, support: int, oversampling: int) -> DataFrame:
    """(o, s, k): the kernel along one axis by sub-cell and offset in cells; each sub-cell's adds up to 1."""
    one = spark.range(oversampling).select(F.col("id").alias("o")).crossJoin(spark.range(-support, support + 1).select(F.col("id").alias("s")))
    x = F.abs(F.col("s") - ((F.col("o") + 0.5) / oversampling - 0.5)) / (support + 0.5)
    k = one.withColumn("k", F.greatest((1 - x * x) * spheroidal(x), F.lit(0.0)))
    total = k.groupBy("o").agg(F.sum("k").alias("t"))
    return k.join(total, "o").select("o", "s", (F.col("k") / F.col("t")).alias("k"))


def spheroidal_kernel(spark: SparkSession, support: int, oversampling: int) -> DataFrame:
    """(ov, ou, sv, su, kernel): the separable kernel by sub-cell and offset in cells."""
    axis = kernel_axis(spark, support, oversampling)
    v, u = axis.select(F.col("o").alias("ov"), F.col("s").alias("sv"), F.col("k").alias("kv")), axis.select(F.col("o").alias("ou"), F.col("s").alias("su"), F.col("k").alias("ku"))
    return v.crossJoin(u).select("ov", "ou", "sv", "su", (F.col("kv") * F.col("ku")).alias("kernel"))


def _footprint(vis: DataFrame, kernel: DataFrame, npixel: int, cellsize: float, oversampling: int) -> DataFrame:
    sub = lambda c: F.least(F.lit(oversampling - 1), F.floor((F.col(c) + 0.5) * oversampling)).cast("long")
    rows = grid_cells(vis, npixel, cellsize).withColumns({"ou": sub("du"), "ov": sub("dv")})
    # The kernel has (oversampling * (2 support + 1)) ** 2 rows, whatever the data.
    rows = rows.join(F.broadcast(kernel), ["ou", "ov"]).withColumns({"gu": F.col("gu") + F.col("su"), "gv": F.col("gv") + F.col("sv")})
    return rows.where((F.col("gu") >= 0) & (F.col("gu") < npixel) & (F.col("gv") >= 0) & (F.col("gv") < npixel))


def grid_visibility(vis: DataFrame, kernel: DataFrame, npixel: int, cellsize: float, oversampling: int, *, keys: list[str] | None = None) -> DataFrame:
    """(keys, gv, gu, re, im, weight): sums of V * imaging weight * kernel over the footprints; keys are chan and pol
    where none are given."""
    wt = F.col("imaging_weight") * F.col("kernel")
    cells = _footprint(vis, kernel, npixel, cellsize, oversampling).groupBy(*(keys or CELL[:2]), "gv", "gu")
    return cells.agg(F.sum(F.col("vis_re") * wt).alias("re"), F.sum(F.col("vis_im") * wt).alias("im"), F.sum(wt).alias("weight"))


def grid_visibility_fast(vis: DataFrame, npixel: int, cellsize: float) -> DataFrame:
    """The same with a kernel of one cell."""
    iw = F.col("imaging_weight")
    return grid_cells(vis, npixel, cellsize).groupBy(*CELL).agg(F.sum(F.col("vis_re") * iw).alias("re"), F.sum(F.col("vis_im") * iw).alias("im"), F.sum(iw).alias("weight"))


def degrid_visibility(vis: DataFrame, grid: DataFrame, npixel: int, cellsize: float, *, support: int, oversampling: int, keys: list[str] | None = None) -> DataFrame:
    """Key, further keys, vis_re, vis_im of every row: the grid's values under its kernel; absent cells are 0."""
    return degrid_with(vis, grid, Kernel(support, oversampling), npixel, cellsize, keys=keys)


def direct_image(vis: DataFrame, npixel: int, cellsize: float) -> DataFrame:
    """(chan, pol, y, x, value) by the direct sum over all visibilities for each pixel, normalised by weight.

    Exact and slow: pixels (a parameter) times rows, summed before the shuffle. For small images and for tests.
    """
    spark = vis.sparkSession
    axis = lambda c: spark.range(npixel).select(F.col("id").alias(c))
    pixels = axis("y").crossJoin(axis("x"))
    turns = F.col("u") * (F.col("x") - npixel // 2) * cellsize + F.col("v") * (F.col("y") - npixel // 2) * cellsize
    re, _ = cx.mul(cx.pair("vis"), cx.conj(cx.phasor(turns)))
    iw = F.col("imaging_weight")
    total = F.sum(iw)
    return vis.crossJoin(F.broadcast(pixels)).groupBy("chan", "pol", "y", "x").agg(F.when(total > 0, F.sum(re * iw) / total).otherwise(F.lit(0.0)).alias("value"))


def invert(vis: DataFrame, npixel: int, cellsize: float, *, psf: bool = False) -> DataFrame:
    """(chan, pol, y, x, value): the dirty image, or the point-spread function, by gridding to nearest cells."""
    rows = vis.withColumns({"vis_re": F.lit(1.0), "vis_im": F.lit(0.0)}) if psf else vis
    grid = grid_visibility_fast(rows, npixel, cellsize)
    total = grid.groupBy("chan", "pol").agg(F.sum("weight").alias("total"))
    image = fft_plane(grid, npixel).join(total, ["chan", "pol"])
    return image.select("chan", "pol", "y", "x", F.when(F.col("total") > 0, F.col("re") * npixel**2 / F.col("total")).otherwise(F.lit(0.0)).alias("value"))
