"""Polarisation frames and conversions between them.

A conversion is a fixed 4 x 4 complex matrix; on long tables it is one aggregation over the four products of a
sample, with the matrix as coefficients, so it needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The products of each frame, in order.
FRAMES = {
    "stokesI": ("I",),
    "stokesIV": ("I", "V"),
    "stokesIQ": ("I", "Q"),
    "stokesIQUV": ("I", "Q", "U", "V"),
    "linear": ("XX", "XY", "YX", "YY"),
    "linearnp": ("XX", "YY"),
    "circular": ("RR", "RL", "LR", "LL"),
    "circularnp": ("RR", "LL"),
}
# Rows of the conversion matrices, complex.
MATRICES: dict[tuple[str, str], tuple[tuple[complex, ...], ...]] = {
    ("stokesIQUV", "linear"): ((1, 1, 0, 0), (0, 0, 1, 1j), (0, 0, 1, -1j), (1, -1, 0, 0)),
    ("linear", "stokesIQUV"): ((0.5, 0, 0, 0.5), (0.5, 0, 0, -0.5), (0, 0.5, 0.5, 0), (0, -0.5j, 0.5j, 0)),
    ("stokesIQUV", "circular"): ((1, 0, 0, 1), (0, -1j, 1, 0), (0, -1j, -1, 0), (1, 0, 0, -1)),
    ("circular", "stokesIQUV"): ((0.5, 0, 0, 0.5), (0, 0.5j, 0.5j, 0), (0, 0.5, -0.5, 0), (0.5, 0, 0, -0.5)),
}


def convert_frame(vis: DataFrame, keys: list[str], source: str, target: str, *, re: str = "vis_re", im: str = "vis_im") -> DataFrame:
    """``keys``, pol, ``re`` and ``im`` in the target frame. A missing product counts as zero."""
    matrix = MATRICES[source, target]

    def row(coefficients: tuple[complex, ...]) -> Column:
        c_re, c_im = (F.element_at(F.array(*(F.lit(float(f(x))) for x in coefficients)), F.col("pol").cast("int") + 1) for f in (lambda x: complex(x).real, lambda x: complex(x).imag))
        return F.struct(F.sum(c_re * F.col(re) - c_im * F.col(im)).alias(re), F.sum(c_re * F.col(im) + c_im * F.col(re)).alias(im))

    rows = F.array(*(F.struct(F.lit(k).alias("pol"), row(c).alias("value")) for k, c in enumerate(matrix)))
    return vis.groupBy(*keys).agg(rows.alias("r")).select(*keys, F.explode("r").alias("r")).select(*keys, "r.pol", f"r.value.{re}", f"r.value.{im}")


def to_stokes_i(vis: DataFrame, keys: list[str]) -> DataFrame:
    """Half the sum of the parallel products (0 and 3), weights added."""
    both = vis.where(F.col("pol").isin(0, 3)).groupBy(*keys)
    return both.agg((F.sum("vis_re") / 2).alias("vis_re"), (F.sum("vis_im") / 2).alias("vis_im"), F.sum("weight").alias("weight"))


def convert_image(image: DataFrame, source: str, target: str) -> DataFrame:
    """An image of one frame in another: (chan, pol, y, x, value, imag). Images of Stokes products are real, and their imaginary
    part, like an absent one, is 0."""
    rows = image if "imag" in image.columns else image.withColumn("imag", F.lit(0.0))
    return convert_frame(rows, ["chan", "y", "x"], source, target, re="value", im="imag")
