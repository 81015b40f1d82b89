"""Gridding with tabulated kernels inside tasks: the spheroidal one, a box, and those that carry w and a beam.

A kernel is known for each of oversampling ** 2 sub-cells as a square of (2 support + 1) ** 2 numbers. It depends on
parameters alone, so each task makes the planes that its rows need and keeps the last of them; nothing is broadcast.
Gridding sums within a batch before anything is sent. For degridding the grid is cut into tiles: a tile with its
margin meets the visibilities whose cell lies in it, once, and each is answered within the task. A tile that many
visibilities share is dealt out by counted salts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfringe.functions.windows import spheroidal_values

from .visibility import KEY

PLANE = ["chan", "pol"]
TILE, MOST_ROWS, AT_ONCE = 32, 200_000, 1 << 21
KINDS = dict.fromkeys(KEY, "long") | {"time": "double"}


def axis_kernel(support: int, oversampling: int) -> np.ndarray:
    """oversampling x (2 support + 1): the spheroidal kernel along one axis by sub-cell; each row adds up to 1."""
    middle = (np.arange(oversampling) + 0.5) / oversampling - 0.5
    x = np.abs(np.arange(-support, support + 1) - middle[:, None]) / (support + 0.5)
    k = np.maximum((1 - x * x) * spheroidal_values(x), 0)
    return k / k.sum(1, keepdims=True)


@dataclass(frozen=True)
class Kernel:
    """The separable spheroidal kernel; one plane."""

    support: int = 3
    oversampling: int = 16

    def make(self, plane: int) -> np.ndarray:
        """sub-cell v x sub-cell u x offset v x offset u."""
        k = axis_kernel(self.support, self.oversampling)
        return k[:, None, :, None] * k[None, :, None, :]


@dataclass(frozen=True)
class BoxKernel(Kernel):
    """All of a visibility into its cell."""

    support: int = 0
    oversampling: int = 1

    def make(self, plane: int) -> np.ndarray:
        return np.ones((1, 1, 1, 1))


def image_taper(npixel: int) -> np.ndarray:
    """What gridding with an ``AWKernel`` multiplies each pixel of an axis by."""
    return spheroidal_values(np.abs(np.arange(npixel) - npixel // 2) / (npixel / 2)) / spheroidal_values(np.zeros(1))


@dataclass(frozen=True)
class AWKernel(Kernel):
    """Kernels by w plane, ``step`` wavelengths apart about 0: the transform of taper times w term times beam.

    ``beam`` is a function of two arrays of direction cosines; ``samples`` across the field must exceed the kernel's
    whole width in cells. ``field`` is npixel * cellsize. Tables are made by partial transforms along both axes at the
    middle of each sub-cell, so that no transform is padded and cropped.
    """

    support: int = 8
    oversampling: int = 8
    field: float = 0.1
    step: float = 1.0
    beam: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    samples: int = 128

    def make(self, plane: int) -> np.ndarray:
        q = self.samples
        at = (np.arange(q) - q // 2) / q
        y, x = np.meshgrid(at * self.field, at * self.field, indexing="ij")
        n = np.sqrt(np.maximum(1 - x * x - y * y, 0)) - 1
        taper = spheroidal_values(np.abs(2 * at)) / spheroidal_values(np.zeros(1))
        plane_image = taper[:, None] * taper[None, :] * np.exp(2j * np.pi * plane * self.step * n)
        if self.beam is not None:
            plane_image = plane_image * self.beam(x, y)
        middle = (np.arange(self.oversampling) + 0.5) / self.oversampling - 0.5
        places = (np.arange(-self.support, self.support + 1) - middle[:, None]).reshape(-1)
        turn = np.exp(-2j * np.pi * np.outer(places, at)) / q
        size = 2 * self.support + 1
        k = (turn @ plane_image @ turn.T).reshape(self.oversampling, size, self.oversampling, size)
        return np.ascontiguousarray(k.transpose(0, 2, 1, 3))


@lru_cache(maxsize=32)
def table(kernel: Kernel, plane: int) -> np.ndarray:
    return kernel.make(plane)


def bounding_box(kernel: Kernel, planes: int, fraction: float = 1e-4) -> int:
    """The support that holds, in all planes up to ``planes`` on each side, every number above a fraction of the largest:
    a box that is symmetric about the middle of the kernel."""
    size = np.max([np.abs(kernel.make(p)).max((0, 1)) for p in range(-planes, planes + 1)], axis=0)
    away = np.abs(np.arange(-kernel.support, kernel.support + 1))
    seen = size > fraction * size.max()
    return int(max(away[seen.any(1)].max(), away[seen.any(0)].max()))


def plane_boxes(kernel: Kernel, planes: int, fraction: float = 1e-4) -> list[tuple[int, tuple[int, int], tuple[int, int]]]:
    """(plane, (first, last offset along v), (first, last along u)) of the numbers above a fraction of the largest of all."""
    tables = {p: np.abs(kernel.make(p)).max((0, 1)) for p in range(-planes, planes + 1)}
    least = fraction * max(t.max() for t in tables.values())
    out = []
    for p, t in tables.items():
        v, u = np.nonzero(t > least)
        if len(v):
            out.append((p, (int(v.min()) - kernel.support, int(v.max()) - kernel.support), (int(u.min()) - kernel.support, int(u.max()) - kernel.support)))
    return out


def _cells(u: np.ndarray, npixel: int, cellsize: float, oversampling: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearest cell, sub-cell) of coordinates in wavelengths."""
    at = u * (npixel * cellsize) + npixel // 2
    near = np.floor(at + 0.5)
    return near.astype(np.int64), np.minimum(oversampling - 1, np.floor((at - near + 0.5) * oversampling)).astype(np.int64)


def with_planes(vis: DataFrame, kernel: Kernel) -> DataFrame:
    """Visibilities with the w plane (a whole number about 0) whose kernel they take."""
    return vis.withColumn("w_plane", F.rint(F.col("w") / kernel.step).cast("long") if isinstance(kernel, AWKernel) else F.lit(0).cast("long"))


def grid_with(vis: DataFrame, kernel: Kernel, npixel: int, cellsize: float, *, keys: list[str] | None = None) -> DataFrame:
    """(keys, gv, gu, re, im, weight): sums of V * imaging weight * kernel; the weight of a row goes whole to its own
    cell, so that a grid's weights add up to those of its rows. Rows off the grid are left out."""
    keys = keys or PLANE
    off = np.arange(-kernel.support, kernel.support + 1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gu, ou = _cells(b["u"].to_numpy(), npixel, cellsize, kernel.oversampling)
            gv, ov = _cells(b["v"].to_numpy(), npixel, cellsize, kernel.oversampling)
            inside = (gu >= 0) & (gu < npixel) & (gv >= 0) & (gv < npixel)
            group, names = pd.factorize(pd.MultiIndex.from_frame(b[keys]))
            value = (b["vis_re"].to_numpy() + 1j * b["vis_im"].to_numpy()) * b["imaging_weight"].to_numpy()
            planes = b["w_plane"].to_numpy()
            for plane in np.unique(planes[inside]):
                rows = np.flatnonzero(inside & (planes == plane))
                k = table(kernel, int(plane))
                step = max(1, AT_ONCE // len(off) ** 2)
                for at in range(0, len(rows), step):
                    r = rows[at : at + step]
                    z = value[r, None, None] * k[ov[r], ou[r]]
                    y, x = gv[r, None, None] + off[:, None], gu[r, None, None] + off[None, :]
                    cell = (group[r, None, None] * npixel + y) * npixel + x
                    on = np.broadcast_to((y >= 0) & (y < npixel) & (x >= 0) & (x < npixel), cell.shape)
                    own = (group[r] * npixel + gv[r]) * npixel + gu[r]
                    found, which = np.unique(np.concatenate([cell[on], own]), return_inverse=True)
                    some = which[: on.sum()]
                    n = len(found)
                    name = names.take(found // npixel**2).to_frame(index=False)
                    name.columns = keys
                    yield name.assign(
                        gv=found // npixel % npixel, gu=found % npixel, re=np.bincount(some, z.real[on], n), im=np.bincount(some, z.imag[on], n),
                        weight=np.bincount(which[on.sum() :], b["imaging_weight"].to_numpy()[r], n),
                    )

    schema = ", ".join(f"{c} long" for c in keys) + ", gv long, gu long, re double, im double, weight double"
    rows = with_planes(vis, kernel).select(*(F.col(c).cast("long").alias(c) for c in keys), "u", "v", "w_plane", "vis_re", "vis_im", "imaging_weight")
    return rows.mapInPandas(partial, schema).groupBy(*keys, "gv", "gu").agg(*(F.sum(c).alias(c) for c in ("re", "im", "weight")))


def degrid_with(vis: DataFrame, grid: DataFrame, kernel: Kernel, npixel: int, cellsize: float, *, keys: list[str] | None = None, tile: int = TILE, most: int = MOST_ROWS) -> DataFrame:
    """Key, further keys, vis_re, vis_im of every row: the grid's values under its kernel, conjugated. Absent cells are 0,
    and so are rows off the grid or without a grid."""
    keys = keys or PLANE
    more = [c for c in keys if c not in KEY]
    names = [*KEY, *more]
    off = np.arange(-kernel.support, kernel.support + 1)
    near = lambda c: F.floor(F.col(c) * (npixel * cellsize) + npixel // 2 + 0.5)
    rows = with_planes(vis, kernel).select(*(F.col(c).cast(KINDS.get(c, "long")).alias(c) for c in names), "u", "v", "w_plane", near("v").alias("cv"), near("u").alias("cu"))
    on = (F.col("cv") >= 0) & (F.col("cv") < npixel) & (F.col("cu") >= 0) & (F.col("cu") < npixel)
    square = [*keys, "ty", "tx"]
    seen = rows.where(on).withColumns({"ty": F.floor(F.col("cv") / tile), "tx": F.floor(F.col("cu") / tile)})
    # Tiles with more rows than a task should hold at once; there are few, as each has so many.
    crowded = seen.groupBy(*square).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("salts")).where("salts > 1")
    salts = F.coalesce(F.col("salts"), F.lit(1))
    dealt = seen.join(crowded, square, "left").withColumn("salt", F.pmod(F.xxhash64(*names), salts).cast("int")).drop("salts")
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - kernel.support) / tile), F.floor((F.col(c) + kernel.support) / tile)))
    cells = grid.select(*(F.col(c).cast("long").alias(c) for c in [*keys, "gv", "gu"]), "re", "im").withColumn("ty", reach("gv")).withColumn("tx", reach("gu"))
    cells = cells.join(crowded, square, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")

    def answer(v: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(v), complex)
        if len(v) and len(g):
            side = tile + 2 * kernel.support
            top, left = int(v["ty"].iloc[0]) * tile - kernel.support, int(v["tx"].iloc[0]) * tile - kernel.support
            values = np.zeros((side, side), complex)
            values[g["gv"].to_numpy() - top, g["gu"].to_numpy() - left] = g["re"].to_numpy() + 1j * g["im"].to_numpy()
            gu, ou = _cells(v["u"].to_numpy(), npixel, cellsize, kernel.oversampling)
            gv, ov = _cells(v["v"].to_numpy(), npixel, cellsize, kernel.oversampling)
            planes = v["w_plane"].to_numpy()
            step = max(1, AT_ONCE // len(off) ** 2)
            for plane in np.unique(planes):
                which = np.flatnonzero(planes == plane)
                k = np.conj(table(kernel, int(plane)))
                for at in range(0, len(which), step):
                    r = which[at : at + step]
                    under = values[gv[r, None, None] - top + off[:, None], gu[r, None, None] - left + off[None, :]]
                    out[r] = (under * k[ov[r], ou[r]]).sum((1, 2))
        return v[names].assign(vis_re=out.real, vis_im=out.imag)

    schema = ", ".join(f"{c} {KINDS.get(c, 'long')}" for c in names) + ", vis_re double, vis_im double"
    group = [*square, "salt"]
    met = dealt.groupBy(*group).cogroup(cells.groupBy(*group)).applyInPandas(answer, schema)
    nothing = rows.where(~on).select(*names, F.lit(0.0).alias("vis_re"), F.lit(0.0).alias("vis_im"))
    return met.unionByName(nothing)
