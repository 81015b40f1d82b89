"""Gains as 2 x 2 matrices, sequences of gain terms, bandpasses and the fit of one component.

A matrix term is a table (time, ant, chan, j00 ... j11 as pairs, weight). Four products of a sample are its matrix of
correlations, feed by feed; solving works on the antenna pairs of one (slot, chan), bounded by the antennas' square.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfringe.functions import complexmath as cx

from .calibration import materialize, point_ratios, solve_gains
from .joins import apply_gains

CELLS = ["00", "01", "10", "11"]
NAMES = [f"j{c}_{p}" for c in CELLS for p in ("re", "im")]
SAMPLE = ["time", "a1", "a2", "chan"]


def _product(a: list[cx.Pair], b: list[cx.Pair]) -> list[cx.Pair]:
    """The product of two 2 x 2 matrices, row by row."""
    return [cx.add(cx.mul(a[2 * r], b[c]), cx.mul(a[2 * r + 1], b[2 + c])) for r in (0, 1) for c in (0, 1)]


def _adjoint(a: list[cx.Pair]) -> list[cx.Pair]:
    return [cx.conj(a[0]), cx.conj(a[2]), cx.conj(a[1]), cx.conj(a[3])]


def _inverse(a: list[cx.Pair]) -> list[cx.Pair]:
    """The inverse; all 0 where there is none."""
    det = cx.sub(cx.mul(a[0], a[3]), cx.mul(a[1], a[2]))
    minus = lambda x: (-x[0], -x[1])
    return [cx.div(x, det) for x in (a[3], minus(a[1]), minus(a[2]), a[0])]


def apply_jones(vis: DataFrame, terms: DataFrame, *, interval: float, first: float, inverse: bool = False) -> DataFrame:
    """J1 V J2^H of each sample's four products, or with the inverses. (key, vis_re, vis_im, weight); products that a
    sample lacks count as 0. Samples whose time is in no interval are left out; weight is 0 where a term has none."""
    number = lambda t: F.round((F.col(t) - first) / interval).cast("long")
    part = lambda c, k: F.coalesce(F.max(F.when(F.col("pol") == k, F.col(c))), F.lit(0.0))
    wide = vis.groupBy(*SAMPLE).agg(*(part(f"vis_{p}", k).alias(f"v{k}_{p}") for k in range(4) for p in ("re", "im")), *(part("weight", k).alias(f"w{k}") for k in range(4)))
    rows = wide.withColumn("__k", number("time")).where(F.abs(F.col("time") - (F.col("__k") * interval + first)) < interval / 2)
    table = terms.withColumn("__k", number("time"))
    side = lambda n: table.select("__k", "chan", F.col("ant").alias(f"a{n}"), *(F.col(x).alias(f"{x[0]}{n}{x[1:]}") for x in NAMES), F.col("weight").alias(f"gw{n}"))
    rows = rows.join(side(1), ["__k", "chan", "a1"]).join(side(2), ["__k", "chan", "a2"])
    j1, j2 = ([cx.pair(f"j{n}{c}") for c in CELLS] for n in (1, 2))
    v = [cx.pair(f"v{k}") for k in range(4)]
    if inverse:
        j1, j2 = _inverse(j1), _inverse(j2)
    out = _product(_product(j1, v), _adjoint(j2))
    good = (F.col("gw1") > 0) & (F.col("gw2") > 0)
    keep = lambda x: F.when(good, x).otherwise(F.lit(0.0))
    cells = F.array(*(F.struct(F.lit(k).alias("pol"), keep(x[0]).alias("vis_re"), keep(x[1]).alias("vis_im"), keep(F.col(f"w{k}")).alias("weight")) for k, x in enumerate(out)))
    return rows.select(*SAMPLE, F.explode(cells).alias("r")).select(*SAMPLE, "r.*")


def as_matrices(gains: DataFrame) -> DataFrame:
    """Gains of the two feeds (time, ant, chan, feed, g_re, g_im, weight) as diagonal matrices."""
    of = lambda c, f: F.coalesce(F.max(F.when(F.col("feed") == f, F.col(c))), F.lit(0.0))
    diagonal = {f"j{f}{f}_{p}": of(f"g_{p}", f) for f in (0, 1) for p in ("re", "im")}
    cells = [diagonal.get(n, F.lit(0.0)).alias(n) for n in NAMES]
    return gains.groupBy("time", "ant", "chan").agg(*(c if n in diagonal else F.max(F.lit(0.0)).alias(n) for n, c in zip(NAMES, cells, strict=True)), F.min("weight").alias("weight"))


def apply_sequence(vis: DataFrame, terms: list[DataFrame], *, interval: float, first: float, inverse: bool = False) -> DataFrame:
    """Several terms, the first nearest to the sky; the inverse takes them off from the last to the first."""
    for term in reversed(terms) if inverse else terms:
        vis = apply_jones(vis, term, interval=interval, first=first, inverse=inverse)
    return vis


def solve_matrices(x: np.ndarray, wt: np.ndarray, *, rounds: int = 200, tolerance: float = 1e-9, damping: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Matrices G and their weights with x[i, j] = G[i] G[j]^H (n x n x 2 x 2, Hermitian as a whole), by alternating
    weighted least squares; the phase of the first antenna's first feed is 0."""
    n = len(x)
    g = np.tile(np.eye(2, dtype=complex), (n, 1, 1))
    for _ in range(rounds):
        top = np.einsum("ij,ijab,jbc->iac", wt, x, g)
        power = np.einsum("jab,jac->jbc", g.conj(), g)
        below = np.einsum("ij,jbc->ibc", wt, power)
        known = wt.sum(1) > 0
        fresh = g.copy()
        fresh[known] = top[known] @ np.linalg.pinv(below[known])
        fresh *= np.exp(-1j * np.angle(fresh[0, 0, 0]))
        fresh = damping * g + (1 - damping) * fresh
        change = np.abs(fresh - g).max()
        g = fresh
        if change < tolerance:
            break
    return g, wt.sum(1)


def solve_jones(ratios: DataFrame, antennas: int, **options: float) -> DataFrame:
    """(slot, chan, ant, matrix, weight) from the ratios of all four products of each (slot, chan)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, wt = np.zeros((antennas, antennas, 2, 2), complex), np.zeros((antennas, antennas))
        i, j, pol = (pdf[c].to_numpy() for c in ("a1", "a2", "pol"))
        x[i, j, pol // 2, pol % 2] = pdf["x_re"] + 1j * pdf["x_im"]
        np.add.at(wt, (i, j), pdf["weight"].to_numpy() / 4)
        x, wt = x + x.conj().transpose(1, 0, 3, 2), wt + wt.T
        g, weight = solve_matrices(x, wt, **options)
        cells = {n: (g[:, int(n[1]), int(n[2])].real if n.endswith("re") else g[:, int(n[1]), int(n[2])].imag) for n in NAMES}
        return pd.DataFrame({"slot": pdf["slot"].iloc[0], "chan": pdf["chan"].iloc[0], "ant": np.arange(antennas), **cells, "weight": weight})

    schema = "slot long, chan long, ant long, " + ", ".join(f"{n} double" for n in NAMES) + ", weight double"
    return ratios.groupBy("slot", "chan").applyInPandas(solve, schema)


@dataclass(frozen=True)
class Term:
    """A kind of gain: how long it holds, whether it is a phase only, and whether one gain does for all channels."""

    name: str
    interval: float
    phase_only: bool = False
    all_channels: bool = False


def calibrate_terms(vis: DataFrame, model: DataFrame, terms: list[Term], antennas: int, *, cross: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """(gains of each term, corrected visibilities): term after term is solved on what those before it left, and taken
    off. Every term ends in written tables."""
    solved: dict[str, DataFrame] = {}
    chans = materialize(vis.select("chan").distinct())
    for term in terms:
        ratios = point_ratios(vis, model, term.interval)
        if term.all_channels:
            total = F.sum("weight")
            mean = lambda c: F.when(total > 0, F.sum(F.col(c) * F.col("weight")) / total).otherwise(F.lit(0.0)).alias(c)  # noqa: E731, B023
            ratios = ratios.groupBy("slot", "a1", "a2", F.lit(0).alias("chan"), "pol").agg(mean("x_re"), mean("x_im"), total.alias("weight"))
        gains = solve_gains(ratios, antennas, cross=cross, phase_only=term.phase_only)
        if term.all_channels:
            gains = gains.drop("chan").crossJoin(F.broadcast(chans))  # a row for each channel of the data
        at = (F.col("slot") * term.interval + term.interval / 2).alias("time")
        solved[term.name] = materialize(gains.select(at, "ant", "chan", "feed", "g_re", "g_im", "weight"))
        vis = materialize(apply_gains(vis, solved[term.name], interval=term.interval, first=term.interval / 2, inverse=True, cross=cross))
    return solved, vis


def bandpass(gains: DataFrame, *, trim: float = 0.25, first: int | None = None, last: int | None = None) -> DataFrame:
    """(slot, feed, ant, chan, b_re, b_im, delay_phase): the bandpass of each antenna, and the phase common to all of them.

    delay_phase adds up, along the channels from ``first`` to ``last``, the mean over antennas of the phase steps from the
    channel before, without the ``trim`` share of the smallest and of the largest; it is the delay's slope, and 0 outside of those
    channels' steps but for what has added up. Gains are divided by the trimmed mean of their
    amplitudes over antennas and turned by the phase of their medians. Steps are put between -pi and pi; antennas are ranked in a
    window of one (slot, feed, chan), nothing else is.
    """
    group = ["slot", "feed", "chan"]
    amp, phase = F.sqrt(F.col("g_re") * F.col("g_re") + F.col("g_im") * F.col("g_im")), F.atan2(F.col("g_im"), F.col("g_re"))
    rows = gains.withColumns({"__a": amp, "__p": phase})
    before = F.lag("__p").over(Window.partitionBy("slot", "feed", "ant").orderBy("chan"))
    turn = 2 * math.pi
    step = F.col("__p") - before
    step = F.when(step > math.pi, step - turn).when(step < -math.pi, step + turn).otherwise(step)
    rows = rows.withColumn("__d", step)

    def ranked(df: DataFrame, value: str) -> DataFrame:
        """Rows in order of a value within their channel, with the channel's number of antennas and how many to leave out."""
        over = Window.partitionBy(*group)
        numbered = df.withColumns({"__k": F.row_number().over(over.orderBy(value, "ant")), "__n": F.count(F.lit(1)).over(over)})
        return numbered.withColumn("__off", F.rint(F.col("__n") * trim))

    kept = (F.col("__k") > F.col("__off")) & (F.col("__k") <= F.col("__n") - F.col("__off"))
    trimmed = lambda value, name: ranked(rows.where(F.col(value).isNotNull()), value).where(kept).groupBy(*group).agg(F.avg(value).alias(name))
    middle = (F.col("__k") == F.floor((F.col("__n") + 1) / 2)) | (F.col("__k") == F.floor(F.col("__n") / 2) + 1)
    median = lambda value, name: ranked(rows, value).where(middle).groupBy(*group).agg(F.avg(value).alias(name))
    common = trimmed("__a", "__amp").join(median("g_re", "__re"), group).join(median("g_im", "__im"), group).join(trimmed("__d", "__slope"), group, "left")
    counted = F.lit(True)
    if first is not None:
        counted = counted & (F.col("chan") > first)
    if last is not None:
        counted = counted & (F.col("chan") < last)
    along = Window.partitionBy("slot", "feed").orderBy("chan")
    common = common.withColumn("delay_phase", F.sum(F.when(counted, F.coalesce("__slope", F.lit(0.0))).otherwise(F.lit(0.0))).over(along))
    met = gains.join(common, group)
    angle = F.atan2(F.col("__im"), F.col("__re"))
    re, im = cx.mul(cx.pair("g"), (F.cos(angle), -F.sin(angle)))
    by = lambda v: F.when(F.col("__amp") > 0, v / F.col("__amp")).otherwise(F.lit(0.0))
    return met.select("slot", "feed", "ant", "chan", by(re).alias("b_re"), by(im).alias("b_im"), "delay_phase")


def fit_component(vis: DataFrame, flux: float, l: float, m: float, *, rounds: int = 6) -> tuple[float, float, float]:  # noqa: E741
    """(flux, l, m) of the point source that fits best, by Gauss-Newton steps; each is one aggregation of six sums."""
    for _ in range(rounds):
        n = math.sqrt(1 - l * l - m * m)
        turns = F.col("u") * l + F.col("v") * m + F.col("w") * (n - 1)
        c, s = F.cos(turns * cx.TWO_PI), F.sin(turns * cx.TWO_PI)
        # Along the source's own phase the residual is real in flux and imaginary in position.
        real = F.col("vis_re") * c - F.col("vis_im") * s - flux
        imag = F.col("vis_re") * s + F.col("vis_im") * c
        dl = -cx.TWO_PI * flux * (F.col("u") - F.col("w") * (l / n))
        dm = -cx.TWO_PI * flux * (F.col("v") - F.col("w") * (m / n))
        total = lambda x: F.sum(F.col("weight") * x)
        w, r, ll, lm, mm, bl, bm = vis.agg(F.sum("weight"), total(real), total(dl * dl), total(dl * dm), total(dm * dm), total(dl * imag), total(dm * imag)).first()
        if not w:
            return flux, l, m
        det = ll * mm - lm * lm
        flux += r / w
        if det > 0:
            l, m = l + (bl * mm - bm * lm) / det, m + (bm * ll - bl * lm) / det  # noqa: E741
    return flux, l, m


def gain_rows(gains: DataFrame, mask: Column) -> DataFrame:
    """The rows of a gain table where ``mask`` holds."""
    return gains.where(mask)


def gain_slices(gains: DataFrame, width: float | None = None) -> DataFrame:
    """Gains with ``slice``: the number of their interval, or of a stretch of ``width`` in time, from 0."""
    lo = gains.agg(F.min("time").alias("__lo"), F.min("interval").alias("__step"))
    rows = gains.crossJoin(F.broadcast(lo))
    step = F.col("__step") if width is None else F.lit(float(width))
    return rows.withColumn("slice", F.floor((F.col("time") - F.col("__lo")) / step + (0.5 if width is None else 0.0)).cast("long")).drop("__lo", "__step")
