"""Transforms of planes by lines. A line of a plane, or a block of them, is the unit of work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fft_axis(lines: DataFrame, keys: list[str], line: str, place: str, npixel: int, inverse: bool, *, block: int = 64) -> DataFrame:
    """Centred 1-D transform of each line; ``block`` lines of npixel cells are the unit of work."""
    columns = [*keys, line, place, "re", "im"]

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(pdf[line].to_numpy(np.int64), return_inverse=True)
        a = np.zeros((len(names), npixel), complex)
        np.add.at(a, (at, pdf[place].to_numpy(np.int64)), pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
        f = (np.fft.ifft if inverse else np.fft.fft)(np.fft.ifftshift(a, axes=1), axis=1)
        f = np.fft.fftshift(f, axes=1).reshape(-1)
        out = {c: np.repeat(pdf[c].iloc[0], len(f)) for c in keys} | {line: np.repeat(names, npixel), place: np.tile(np.arange(npixel), len(names))}
        return pd.DataFrame(out | {"re": f.real, "im": f.imag})[columns]

    schema = ", ".join(f"{c} long" for c in [*keys, line, place]) + ", re double, im double"
    rows = lines.select(*(F.col(c).cast("long") for c in [*keys, line, place]), "re", "im")
    return rows.groupBy(*keys, F.floor(F.col(line) / block)).applyInPandas(transform, schema)


def fft_plane(grid: DataFrame, npixel: int, *, inverse: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Centred 2-D transform of each plane (chan and pol where no keys are given), rows first and then columns; a task
    holds 64 lines, so all of a plane only up to that size."""
    keys = keys or ["chan", "pol"]
    rows = _fft_axis(grid, keys, "gv", "gu", npixel, inverse)
    return _fft_axis(rows, keys, "gu", "gv", npixel, inverse).withColumnRenamed("gv", "y").withColumnRenamed("gu", "x")
