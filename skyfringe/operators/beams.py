"""Primary beams of dishes: the transform of a blocked disk, and of a tapered one by a table over the radius."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = 299792458.0
# Dish and blockage diameters in metres.
DISHES = {"MID": (15.0, 0.0), "MEERKAT": (13.5, 0.0), "VLA": (25.0, 1.8), "ASKAP": (12.0, 1.0)}
# The polynomials of Abramowitz and Stegun 9.4.4 and 9.4.6 for the Bessel function of order 1, by rising power: J1(x) / x in
# (x / 3) ** 2 up to 3; beyond it modulus and phase (less x) in 3 / x. Their errors are under 1e-7.
J1_NEAR = (0.5, -0.56249985, 0.21093573, -0.03954289, 0.00443319, -0.00031761, 0.00001109)
J1_MODULUS = (0.79788456, 0.00000156, 0.01659667, 0.00017105, -0.00249511, 0.00113653, -0.00020033)
J1_PHASE = (-2.35619449, 0.12499612, 0.00005650, -0.00637879, 0.00074348, 0.00079824, -0.00029166)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    total = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        total = total * x + c
    return total


def disk_transform(r: Column) -> Column:
    """2 J1(r) / r at any radius, 1 at 0."""
    t = 3 / F.greatest(r, F.lit(3.0))
    far = 2 * _polynomial(J1_MODULUS, t) * F.cos(r + _polynomial(J1_PHASE, t)) / (r * F.sqrt(r))
    return F.when(r < 3, 2 * _polynomial(J1_NEAR, r * r / 9)).otherwise(far)


def voltage_pattern(angle: Column, wavelength: Column, diameter: float, blockage: float = 0.0) -> Column:
    """Voltage of a dish at an angle (radians) from its axis; the part that is blocked is taken off."""
    dish = disk_transform(angle * (math.pi * diameter) / wavelength)
    if not blockage:
        return dish
    return dish - (blockage / diameter) ** 2 * disk_transform(angle * (math.pi * blockage) / wavelength)


def _angle(npixel: int, cellsize: float, py: float | None, px: float | None) -> Column:
    y, x = F.col("y") - (npixel // 2 if py is None else py), F.col("x") - (npixel // 2 if px is None else px)
    return F.sqrt(y * y + x * x) * cellsize


def primary_beam(image: DataFrame, npixel: int, cellsize: float, frequency: Column, telescope: str = "MID", *, py: float | None = None, px: float | None = None, voltage: bool = False) -> DataFrame:
    """``image`` with value the power (or voltage) beam of a telescope pointed at (py, px), or at the middle."""
    # Named first, so that the long expressions refer to columns and are each evaluated once.
    rows = image.drop("value").withColumns({"__angle": _angle(npixel, cellsize, py, px), "__wave": C / frequency})
    v = rows.withColumn("__v", voltage_pattern(F.col("__angle"), F.col("__wave"), *DISHES[telescope]))
    return v.withColumn("value", F.col("__v") if voltage else F.col("__v") * F.col("__v")).drop("__angle", "__wave", "__v")


def tapered_pattern(reach: float, *, edge: float = 10**-0.6, blockage: float = 0.0, steps: int = 1024) -> np.ndarray:
    """Voltages at ``steps`` + 1 radii from 0 to ``reach`` (angle * diameter / wavelength) of a disk whose field falls as a
    Gaussian to ``edge`` at its rim; ``blockage`` is the blocked share of the diameter. Sums over 500 rings."""
    r = (np.arange(500) + 0.5) / 500 / 2
    field = np.exp(4 * math.log(edge) * r * r) * (r >= blockage / 2) * r
    x = np.linspace(0, reach, steps + 1)
    turn = (np.arange(64) + 0.5) * np.pi / 64
    out = np.empty(len(x))
    for k, a in enumerate(x):
        # J0 as a mean over angles; 64 do for the arguments that a table reaches.
        out[k] = (field * np.cos(2 * np.pi * a * np.outer(np.sin(turn), r)).mean(0)).sum()
    return out / out[0]


def tapered_beam(image: DataFrame, npixel: int, cellsize: float, frequency: Column, diameter: float, *, reach: float = 8.0, steps: int = 1024, **dish: float) -> DataFrame:
    """``image`` with value the power beam of a tapered dish, looked up in a table by radius (its size is a parameter) and
    interpolated; 0 beyond ``reach``."""
    table = tapered_pattern(reach, steps=steps, **dish)
    spark = image.sparkSession
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(table, table[1:], strict=False))], "k long, a double, b double")
    at = image.drop("value").withColumn("__r", _angle(npixel, cellsize, None, None) * frequency * (diameter * steps / reach / C))
    met = at.withColumn("k", F.floor("__r")).join(F.broadcast(rows), "k", "left")
    v = F.coalesce(F.col("a") + (F.col("__r") - F.col("k")) * (F.col("b") - F.col("a")), F.lit(0.0))
    return met.withColumn("__v", v).withColumn("value", F.col("__v") * F.col("__v")).drop("k", "a", "b", "__r", "__v")


def mosaic_beam(image: DataFrame, pointings: DataFrame, per_pixel: float, *, array_rows: int = 20_000, task_pairs: int = 4_000_000) -> DataFrame:
    """Root sum of squares of the power beams of all pointings (py, px); a pixel is ``per_pixel`` of a beam's radius wide.

    Pointings go as arrays of at most ``array_rows`` and are taken out in the task that sums them, so only sums of a place
    are sent. Places are dealt so that a task has about ``task_pairs`` pairs, however few bytes they are.
    """
    places = image.select("y", "x").distinct()
    n, m = places.count(), pointings.count()
    blocks = max(1, -(-m // array_rows))
    packed = pointings.groupBy(F.pmod(F.xxhash64("py", "px"), F.lit(blocks)).alias("__b")).agg(F.collect_list(F.struct("py", "px")).alias("__p")).drop("__b")
    spread = places.repartition(max(1, min(n, -(-n * m // task_pairs))), "y", "x")
    pairs = spread.crossJoin(F.broadcast(packed) if blocks == 1 else packed).select("y", "x", F.explode("__p").alias("p"))
    dy, dx = F.col("y") - F.col("p.py"), F.col("x") - F.col("p.px")
    beam = pairs.select("y", "x", (F.sqrt(dy * dy + dx * dx) * per_pixel).alias("r")).select("y", "x", disk_transform(F.col("r")).alias("v"))
    sums = beam.select("y", "x", (F.col("v") * F.col("v")).alias("b")).groupBy("y", "x").agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("value"))
    return image.drop("value").join(sums, ["y", "x"]).select("chan", "pol", "y", "x", "value")
