"""Calibration of antenna gains.

Observed and model visibilities become point-source ratios by one join and one aggregation. What is left for a solution
interval and channel is a table of antenna pairs, bounded by the square of the antennas, which one Python call solves;
intervals, channels and feeds are the units of work and spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfringe.functions import complexmath as cx

from .joins import product_feeds
from .tables import discard, materialize
from .visibility import exact_median


def linked_groups(links: DataFrame) -> DataFrame:
    """(node, group) for every node of ``links`` (a, b): the least node of those it is linked with, directly or not.

    Each round takes the least label among neighbours and then the label's own, so rounds grow with the logarithm of a
    chain's length; each ends in a written table.
    """
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("group")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("group").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("group").alias("old"), F.least("group", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("group").alias("far"))
        moved = materialize(step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("group")))
        discard(labels)
        labels = moved
        if not moved.where("old <> group").limit(1).count():
            discard(edges)
            return labels.select("node", "group")


def gain_intervals(vis: DataFrame, antennas: DataFrame, timeslice: float) -> DataFrame:
    """Identity gains: intervals by rounded time x antennas x channels."""
    start = vis.agg(F.min("time").alias("__t0"))
    times = vis.select("time").distinct().crossJoin(F.broadcast(start)).select((F.col("__t0") + timeslice * F.round((F.col("time") - F.col("__t0")) / timeslice)).alias("time")).distinct()
    chans = vis.select("chan").distinct()
    rows = times.crossJoin(antennas.select("ant")).crossJoin(chans)
    return rows.select("time", F.lit(float(timeslice)).alias("interval"), "ant", "chan", F.lit(1.0).alias("g_re"), F.lit(0.0).alias("g_im"), F.lit(1.0).alias("weight"))


def point_ratios(vis: DataFrame, model: DataFrame, timeslice: float, *, keys: list[str] | None = None, all_channels: bool = False) -> DataFrame:
    """(keys, slot, a1, a2, chan, pol, x_re, x_im, weight): the weighted mean of V / M over a solution interval, for each
    product, and for all channels together (chan 0) with ``all_channels``. The ratio's weight is |M| ** 2 * weight, so no
    division is needed before the sums. ``keys`` are further columns, such as model_id, that both tables have."""
    keys = keys or []
    slot = F.floor(F.col("time") / timeslice)
    rows = vis.join(model, [*keys, "time", "a1", "a2", "chan", "pol"])
    if all_channels:
        rows = rows.withColumn("chan", F.lit(0))
    v, m = cx.pair("vis"), cx.pair("m")
    re, im = cx.mul(v, cx.conj(m))
    total = F.sum(cx.abs2(m) * F.col("weight"))
    mean = lambda c: F.when(total > 0, F.sum(c * F.col("weight")) / total).otherwise(F.lit(0.0))
    return rows.groupBy(*keys, slot.alias("slot"), "a1", "a2", "chan", "pol").agg(mean(re).alias("x_re"), mean(im).alias("x_im"), total.alias("weight"))


def solve_scalar(x: np.ndarray, wt: np.ndarray, *, rounds: int = 200, tolerance: float = 1e-9, phase_only: bool = False, reference: int = 0, damping: float = 0.5, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gains g and their weights with x[i, j] = g[i] conj(g[j]), by alternating weighted least squares from ``start`` (1 where
    none is given); x is Hermitian."""
    gain = np.ones(len(x), complex) if start is None else start.astype(complex)
    weight = np.zeros(len(x))
    for _ in range(rounds):
        weight = wt @ np.abs(gain) ** 2
        top = (x * wt) @ gain
        fresh = np.divide(top, weight, out=np.zeros_like(gain), where=weight > 0)
        if phase_only:
            size = np.abs(fresh)
            fresh = np.divide(fresh, size, out=np.zeros_like(gain), where=size > 0)
        fresh = fresh * np.exp(-1j * np.angle(fresh[reference]))
        fresh = damping * gain + (1 - damping) * fresh
        change = np.abs(fresh - gain).max()
        gain = fresh
        if change < tolerance:
            break
    return gain, weight


def _with_pol(ratios: DataFrame) -> DataFrame:
    """Ratios without products are those of product 0."""
    return ratios if "pol" in ratios.columns else ratios.withColumn("pol", F.lit(0))


def solve_gains(ratios: DataFrame, antennas: int, *, cross: bool = True, keys: list[str] | None = None, normalise: bool = False, **options) -> DataFrame:
    """(keys, slot, chan, feed, ant, g_re, g_im, weight) from the ratios of each (keys, slot, chan, feed).

    A product of a feed with itself solves that feed: 0 and 3 of four products, 0 and 1 of a frame without cross
    products (``cross=False``). Cross products take no part. With ``normalise``, and unless only phases are solved, gains
    are divided by their mean amplitude. ``keys`` are further whole numbers, such as model_id, that solutions go by.
    """
    keys = keys or []

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, wt = np.zeros((antennas, antennas), complex), np.zeros((antennas, antennas))
        i, j = pdf["a1"].to_numpy(), pdf["a2"].to_numpy()
        x[i, j] = pdf["x_re"] + 1j * pdf["x_im"]
        wt[i, j] = pdf["weight"]
        x, wt = x + x.conj().T, wt + wt.T
        g, weight = solve_scalar(x, wt, **options)
        if normalise and not options.get("phase_only"):
            size = np.abs(g).mean()
            g = g / size if size > 0 else g
        return pd.DataFrame({c: pdf[c].iloc[0] for c in [*keys, "slot", "chan", "feed"]} | {"ant": np.arange(antennas), "g_re": g.real, "g_im": g.imag, "weight": weight})

    f1, f2 = product_feeds(F.col("pol"), cross)
    parallel = _with_pol(ratios).where(f1 == f2).withColumn("feed", f1)
    schema = "".join(f"{k} long, " for k in keys) + "slot long, chan long, feed long, ant long, g_re double, g_im double, weight double"
    return parallel.groupBy(*keys, "slot", "chan", "feed").applyInPandas(solve, schema)


def gain_residual(ratios: DataFrame, gains: DataFrame, *, cross: bool = True) -> DataFrame:
    """(slot, chan, residual): the weighted root mean square of x - g1 conj(g2) over all products, each with the gains
    of its two feeds."""
    side = lambda n: gains.select("slot", "chan", F.col("feed").alias(f"f{n}"), F.col("ant").alias(f"a{n}"), F.col("g_re").alias(f"g{n}_re"), F.col("g_im").alias(f"g{n}_im"))
    rows = _with_pol(ratios).withColumns(dict(zip(("f1", "f2"), product_feeds(F.col("pol"), cross), strict=True)))
    rows = rows.join(side(1), ["slot", "chan", "f1", "a1"]).join(side(2), ["slot", "chan", "f2", "a2"])
    off = cx.abs2(cx.sub(cx.pair("x"), cx.mul(cx.pair("g1"), cx.conj(cx.pair("g2")))))
    total = F.sum("weight")
    return rows.groupBy("slot", "chan").agg(F.when(total > 0, F.sqrt(F.sum(F.col("weight") * off) / total)).otherwise(F.lit(0.0)).alias("residual"))


def station_correlations(signals: DataFrame) -> DataFrame:
    """(time, chan, a1, a2, re, im): products s1 conj(s2) of station signals (time, chan, ant, s_re, s_im), a2 >= a1."""
    side = lambda n: signals.select("time", "chan", F.col("ant").alias(f"a{n}"), F.col("s_re").alias(f"s{n}_re"), F.col("s_im").alias(f"s{n}_im"))
    rows = side(1).join(side(2), ["time", "chan"]).where(F.col("a2") >= F.col("a1"))
    re, im = cx.mul(cx.pair("s1"), cx.conj(cx.pair("s2")))
    return rows.select("time", "chan", "a1", "a2", re.alias("re"), im.alias("im"))


def gain_quality(gains: DataFrame) -> DataFrame:
    """Extremes, deviation and median of amplitude and phase where there is weight, and the largest residual where gains
    have one; one row. Medians are found by narrowing bins, so no task holds all values."""
    g = gains.where(F.col("weight") > 0)
    amp, phase = cx.magnitude(cx.pair("g")), F.atan2(F.col("g_im"), F.col("g_re"))
    figures = {"max": F.max, "min": F.min, "std": F.stddev_pop}
    more = [F.max("residual").alias("residual")] if "residual" in gains.columns else []
    one = g.agg(*(f(c).alias(f"{n}_{k}") for n, c in (("amp", amp), ("phase", phase)) for k, f in figures.items()), *more)
    for n, c in (("amp", amp), ("phase", phase)):
        one = one.crossJoin(F.broadcast(exact_median(g.select(c.alias("x")), "x").withColumnRenamed("median", f"{n}_median")))
    return one
