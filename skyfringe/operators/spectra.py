"""Spectra between their channels: straight lines, or the cubic spline whose first two and last two pieces are one cubic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spline_matrix(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The matrix that takes values at ``x`` (rising) to those of their spline at ``at``, for every spectrum over ``x``.

    Second derivatives solve three-term equations; at each end the third derivative goes on through the first inner knot.
    Outside of ``x`` the last pieces go on. Two knots give a line and three a parabola.
    """
    n = len(x)
    if n == 1:
        return np.ones((len(at), 1))
    if n < 4:
        return np.stack([np.prod([(at - x[j]) / (x[k] - x[j]) for j in range(n) if j != k], axis=0) for k in range(n)], 1)
    h = np.diff(x)
    left, right = np.zeros((n, n)), np.zeros((n, n))
    for k in range(1, n - 1):
        left[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        right[k, k - 1 : k + 2] = 6 / h[k - 1], -6 / h[k - 1] - 6 / h[k], 6 / h[k]
    left[0, :3] = h[1], -h[0] - h[1], h[0]
    left[-1, -3:] = h[-1], -h[-2] - h[-1], h[-2]
    second = np.linalg.solve(left, right)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    a, b = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    pick = np.eye(n)
    bend = ((a**3 - a)[:, None] * second[k] + (b**3 - b)[:, None] * second[k + 1]) * (h[k] ** 2 / 6)[:, None]
    return a[:, None] * pick[k] + b[:, None] * pick[k + 1] + bend


def line_matrix(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(x)
    if n == 1:
        return np.ones((len(at), 1))
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    b = (at - x[k]) / (x[k + 1] - x[k])
    return (1 - b)[:, None] * np.eye(n)[k] + b[:, None] * np.eye(n)[k + 1]


def interpolate_spectra(rows: DataFrame, keys: list[str], targets: list[float], *, kind: str = "cubic", x: str = "frequency", value: str = "value") -> DataFrame:
    """(keys, x, value) at the targets, from the points of each key, by cubic spline or straight lines.

    The points of a key, its channels, are gathered as one sorted array; all keys of a batch with the same points are one
    matrix product. Points given twice count once, the smaller value; a key without a point has no rows.
    """
    at = np.array(sorted(targets), float)
    matrix = spline_matrix if kind == "cubic" else line_matrix

    @F.pandas_udf("array<double>")
    def values(points: pd.Series, seen: pd.Series) -> pd.Series:
        out = np.empty((len(points), len(at)))
        names = points.map(lambda p: p.tobytes()).to_numpy()
        for name in pd.unique(names):
            which = np.flatnonzero(names == name)
            out[which] = np.stack(seen.iloc[which].to_list()) @ matrix(np.frombuffer(name), at).T
        return pd.Series(list(out))

    once = rows.where(F.col(x).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("__x")).agg(F.min(F.col(value).cast("double")).alias("__y"))
    packed = once.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__x", "__y"))).alias("p")).select(*keys, F.col("p.__x").alias("px"), F.col("p.__y").alias("py"))
    places = F.array(*(F.lit(float(a)) for a in at))
    found = packed.select(*keys, F.arrays_zip(places.alias("a"), values("px", "py").alias("v")).alias("z"))
    return found.select(*keys, F.explode("z").alias("z")).select(*keys, F.col("z.a").alias(x), F.col("z.v").alias(value))
