"""Selection, slicing, averaging and statistics of visibilities.

A visibility table has one row for each (time, a1, a2, chan, pol), with a2 > a1; no weight means no data. Filters are
plain predicates that reach the scan; averages are one aggregation with partial sums before the shuffle; values that
hold for a whole table (extremes) are one-row aggregates joined back by broadcast.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfringe.functions import complexmath as cx
from skyfringe.functions.coordinates import hadec_to_azel, sky_to_lmn, uvw_to_xyz, xyz_to_uvw

from .tables import discard, materialize

KEY = ["time", "a1", "a2", "chan", "pol"]


def _with_one_row(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Every row with the aggregates of all rows (one row, so its broadcast is bounded)."""
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))


# --- selection -------------------------------------------------------------------------------------------------


def select_uvrange(vis: DataFrame, low: float, high: float) -> DataFrame:
    """low < uv distance <= high."""
    d = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    return vis.where((d > low) & (d <= high))


def select_wrange(vis: DataFrame, most: float) -> DataFrame:
    return vis.where(F.abs("w") <= most)


def limit_radius(antennas: DataFrame, most: float) -> DataFrame:
    """Antennas nearer than ``most`` to the mean position."""
    rows = _with_one_row(antennas, *(F.avg(c).alias(f"__{c}") for c in "xyz"))
    d2 = sum((F.col(c) - F.col(f"__{c}")) * (F.col(c) - F.col(f"__{c}")) for c in "xyz")
    return rows.where(F.sqrt(d2) < most).select(*antennas.columns)


def above_elevation(df: DataFrame, ha: Column, dec: Column, latitude: float, limit: float) -> DataFrame:
    """Rows whose direction is higher than ``limit`` (radians)."""
    _, el = hadec_to_azel(ha, dec, F.lit(latitude))
    return df.where(el > limit)


# --- slices ----------------------------------------------------------------------------------------------------


def time_slices(vis: DataFrame, n: int) -> DataFrame:
    """``slice`` from 0 to n - 1 about n equally spaced times; each row is in exactly one."""
    step = (F.col("__hi") - F.col("__lo")) / max(n - 1, 1)
    at = F.when((step > 0) & F.lit(n > 1), F.floor((F.col("time") - F.col("__lo")) / step + 0.5)).otherwise(F.lit(0))
    rows = _with_one_row(vis, F.min("time").alias("__lo"), F.max("time").alias("__hi"))
    return rows.withColumn("slice", F.least(F.lit(n - 1), at).cast("long")).drop("__lo", "__hi")


def w_slices(vis: DataFrame, width: float) -> DataFrame:
    """``slice`` by steps of about ``width`` in w, 1 + 2 * round(max |w| / width) in all, symmetric about 0."""
    n = 1 + 2 * F.round(F.col("__most") / width)
    step = F.when(n > 1, 2 * F.col("__most") / (n - 1)).otherwise(F.lit(1.0))
    at = F.when(n > 1, F.floor((F.col("w") + F.col("__most")) / step + 0.5)).otherwise(F.lit(0))
    rows = _with_one_row(vis, F.max(F.abs("w")).alias("__most"))
    return rows.withColumn("slice", F.least(n - 1, at).cast("long")).drop("__most")


def sort_visibility(vis: DataFrame, order: list[str]) -> DataFrame:
    return vis.orderBy(*order)


def with_places(parts: DataFrame, order: list[str]) -> DataFrame:
    """``place`` from 1 of every row of a written table whose ranges (``__part``) are in order: the place in the range
    and the rows of the ranges before it, of which there is one row each."""
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(F.broadcast(before), "__part").withColumn("place", (within + F.col("__before")).cast("long")).drop("__part", "__before")


# --- set operations --------------------------------------------------------------------------------------------


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both; their columns must be the same."""
    if set(first.columns) != set(second.columns):
        raise ValueError(f"columns differ: {sorted(set(first.columns) ^ set(second.columns))}")
    return first.unionByName(second)


def concatenate(tables: list[DataFrame], order: list[str] | None = None) -> DataFrame:
    out = reduce(append, tables)
    return out.orderBy(*order) if order else out


def concatenate_frequency(first: DataFrame, second: DataFrame) -> DataFrame:
    """The channels of ``second`` after those of ``first``."""
    offset = first.agg((F.coalesce(F.max("chan"), F.lit(-1)) + 1).alias("__offset"))
    moved = second.crossJoin(F.broadcast(offset)).withColumn("chan", F.col("chan") + F.col("__offset")).drop("__offset")
    return append(first, moved)


# --- aggregation -----------------------------------------------------------------------------------------------


def weighted_mean(value: str, weight: str = "weight") -> Column:
    """Sum of weight * value by sum of weight, and 0 without weight."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(F.col(weight) * F.col(value)) / total).otherwise(F.lit(0.0))


def integrate_channels(vis: DataFrame) -> DataFrame:
    """One row for each (time, a1, a2, pol): weighted mean, weights and bandwidths added, mean frequency and uvw."""
    return vis.groupBy("time", "a1", "a2", "pol").agg(
        weighted_mean("vis_re").alias("vis_re"), weighted_mean("vis_im").alias("vis_im"), F.sum("weight").alias("weight"), F.sum("imaging_weight").alias("imaging_weight"),
        *(F.avg(c).alias(c) for c in "uvw"),
        F.avg("frequency").alias("frequency"), F.sum("channel_bandwidth").alias("channel_bandwidth"),
    )


def sum_towards(vis: DataFrame, l: float, m: float) -> DataFrame:  # noqa: E741
    """Flux by (chan, pol): the weighted direct Fourier sum towards direction cosines (l, m)."""
    n = (1 - l * l - m * m) ** 0.5 - 1
    turns = F.col("u") * l + F.col("v") * m + F.col("w") * n
    re, _ = cx.mul(cx.pair("vis"), cx.conj(cx.phasor(turns)))
    total = F.sum("weight")
    flux = F.when(total > 0, F.sum(re * F.col("weight")) / total).otherwise(F.lit(0.0))
    return vis.groupBy("chan", "pol").agg(flux.alias("flux"), total.alias("weight"))


def quality(df: DataFrame, value: Column) -> DataFrame:
    """max, min, population standard deviation and median of a value, one row.

    The median is exact and never sorts all values: they are counted in bins first, and only the bin or two that hold the
    middle are looked at one by one.
    """
    v = df.select(value.cast("double").alias("x")).where("x IS NOT NULL")
    one = v.agg(F.max("x").alias("max"), F.min("x").alias("min"), F.stddev_pop("x").alias("std"))
    return one.crossJoin(F.broadcast(exact_median(v, "x")))


def exact_median(df: DataFrame, column: str, *, bins: int = 4096, few: int = 100_000) -> DataFrame:
    """(median): the mean of the middle one or two values; one row. The column is written once, so that what made it isn't
    made again; each pass then counts it in bins of equal width between two values, ``bins`` rows at most being gathered, and goes on in
    the bin that holds the middle, until it has ``few`` values or one."""
    rows = materialize(df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)"))
    spark = df.sparkSession
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        discard(rows)
        return spark.createDataFrame([(None,)], "median double")

    def at(ranks: list[int], lo: float, hi: float, below: int, here: int) -> dict[int, float]:
        """The values of ranks, all of which lie among the ``here`` values from lo to hi; ``below`` lie under lo."""
        inside = rows.where((F.col("x") >= lo) & (F.col("x") <= hi))
        if here <= few:
            values = sorted(r["x"] for r in inside.collect())
            return {r: values[r - below] for r in ranks}
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return dict.fromkeys(ranks, lo)
        counts = inside.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / width)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        found: dict[int, float] = {}
        for c in sorted(counts, key=lambda c: c["b"]):
            if mine := [r for r in ranks if below <= r < below + c["n"]]:
                same = (c["lo"], c["hi"]) == (lo, hi)
                found |= dict.fromkeys(mine, lo) if same else at(mine, c["lo"], c["hi"], below, c["n"])
            below += c["n"]
        return found

    ranks = sorted({(n - 1) // 2, n // 2})
    found = at(ranks, low, high, 0, n)
    discard(rows)
    return spark.createDataFrame([(sum(found.values()) / len(found),)], "median double")


def visibility_quality(vis: DataFrame) -> DataFrame:
    return quality(vis, cx.magnitude(cx.pair("vis")))


def coalescing(vis: DataFrame, time_factor: float, most_times: int, chan_factor: float, most_chans: int) -> DataFrame:
    """Every row with tchunk and fchunk, the run of times and channels that it is averaged into.

    A baseline's runs are longer the shorter it is: factor * (longest uv distance of all) / (its longest), rounded,
    from 1 to the limit; the limit at distance 0, 1 without weight.
    """
    d = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    per = vis.groupBy("a1", "a2").agg(F.max(d).alias("far"), F.sum("weight").alias("wt"))
    per = _with_one_row(per, F.max("far").alias("farthest"))

    def run(factor: float, most: int) -> Column:
        n = F.least(F.lit(most), F.greatest(F.lit(1), F.round(factor * F.col("farthest") / F.col("far")).cast("int")))
        return F.when(F.lit(factor <= 0) | (F.col("wt") <= 0), F.lit(1)).when(F.col("far") > 0, n).otherwise(F.lit(most))

    runs = per.select("a1", "a2", run(time_factor, most_times).alias("nt"), run(chan_factor, most_chans).alias("nf"))
    # A baseline's rows come together once; the order of its times and channels are windows over that one exchange.
    order = lambda c: F.dense_rank().over(Window.partitionBy("a1", "a2").orderBy(c)) - 1
    placed = vis.join(runs, ["a1", "a2"]).withColumn("t", order("time")).withColumn("f", order("chan"))
    return placed.withColumn("tchunk", F.floor(F.col("t") / F.col("nt"))).withColumn("fchunk", F.floor(F.col("f") / F.col("nf"))).drop("t", "f", "nt", "nf")


def coalesce_visibility(vis: DataFrame, time_factor: float, most_times: int, chan_factor: float, most_chans: int) -> DataFrame:
    """Baseline-dependent averages: weighted means, weights added."""
    chunks = coalescing(vis, time_factor, most_times, chan_factor, most_chans)
    mean = [weighted_mean(c).alias(c) for c in ("time", "frequency", "u", "v", "w", "vis_re", "vis_im")]
    times, width = F.countDistinct("time"), F.max("integration_time")
    return chunks.groupBy("a1", "a2", "tchunk", "fchunk", "pol").agg(
        *mean, F.sum("weight").alias("weight"), F.sum("imaging_weight").alias("imaging_weight"), (times * width).alias("integration_time"), F.count(F.lit(1)).alias("samples")
    )


def decoalesce_visibility(vis: DataFrame, time_factor: float, most_times: int, chan_factor: float, most_chans: int) -> DataFrame:
    """Every sample with the average that it went into; averages are windows over the baselines' own exchange."""
    chunks = coalescing(vis, time_factor, most_times, chan_factor, most_chans)
    over = Window.partitionBy("a1", "a2", "tchunk", "fchunk", "pol")
    total = F.sum("weight").over(over)
    mean = lambda c: F.when(total > 0, F.sum(F.col("weight") * F.col(c)).over(over) / total).otherwise(F.lit(0.0))
    return chunks.withColumns({"vis_re": mean("vis_re"), "vis_im": mean("vis_im")}).drop("tchunk", "fchunk")


def fit_uv_plane(vis: DataFrame) -> DataFrame:
    """(p, q) of the least-squares plane w = p u + q v, weights as they are; one row."""
    s = {a + b: F.sum(F.col("weight") * F.col(a) * F.col(b)) for a, b in ("uu", "uv", "vv", "uw", "vw")}
    det = s["uu"] * s["vv"] - s["uv"] * s["uv"]
    return vis.agg(((s["uw"] * s["vv"] - s["vw"] * s["uv"]) / det).alias("p"), ((s["vw"] * s["uu"] - s["uw"] * s["uv"]) / det).alias("q"))


def remove_uv_plane(vis: DataFrame) -> DataFrame:
    rows = vis.crossJoin(F.broadcast(fit_uv_plane(vis)))
    return rows.withColumn("w", F.col("w") - F.col("p") * F.col("u") - F.col("q") * F.col("v")).drop("p", "q")


def advise_wide_field(vis: DataFrame, diameter: float, *, del_a: float = 0.02, guard: float = 6.0, oversampling: float = 3.0) -> DataFrame:
    """Sizes for imaging; one row. The longest baseline is the largest of |u|, |v| and |w|, in wavelengths; the w
    sampling loses at most ``del_a`` of coherence, in the image's field or in the primary beam's."""
    longest = F.greatest(*(F.max(F.abs(c)) for c in "uvw"))
    one = vis.agg(longest.alias("longest_baseline"), F.max(F.abs("w")).alias("largest_w"), (F.lit(299792458.0) / F.min("frequency")).alias("wavelength"), F.max("frequency").alias("top"))
    pi = 3.141592653589793
    beam = 1 / F.col("longest_baseline")
    primary = F.col("wavelength") / diameter
    fov = primary * guard
    cell = beam / oversampling
    side = F.rint(fov / cell)
    power2 = F.pow(F.lit(2.0), F.ceil(F.log2(side)))
    steps = {"image": F.sqrt(F.lit(2 * del_a)) / (pi * fov * fov), "primary_beam": F.sqrt(F.lit(2 * del_a)) / (pi * primary * primary)}
    return one.select(
        "longest_baseline", "largest_w", "wavelength", beam.alias("synthesised_beam"), primary.alias("primary_beam_fov"), fov.alias("image_fov"), cell.alias("cellsize"), side.alias("npixel"),
        power2.alias("npixel_power_of_2"), F.when(power2 * 3 / 4 >= side, power2 * 3 / 4).otherwise(power2).alias("npixel_power_of_2_3"),
        *(w.alias(f"w_sampling_{n}") for n, w in steps.items()),
        *((86400.0 * w / (pi * F.col("longest_baseline"))).alias(f"time_sampling_{n}") for n, w in steps.items()),
        *((F.col("top") * w / (pi * F.col("longest_baseline"))).alias(f"freq_sampling_{n}") for n, w in steps.items()),
        F.greatest(F.lit(1), F.floor(2 * F.col("largest_w") / steps["primary_beam"])).alias("vis_slices"),
    )


def phase_rotate(vis: DataFrame, ra0: float, dec0: float, ra1: float, dec1: float, *, inverse: bool = False, tangent: bool = True) -> DataFrame:
    """Visibilities about a new phase centre; u, v, w stay those of the old tangent plane, or with ``tangent=False`` become those
    of the new one."""
    l, m, n = sky_to_lmn(*(F.lit(x) for x in (ra1, dec1, ra0, dec0)))  # noqa: E741
    p = cx.phasor(F.col("u") * l + F.col("v") * m + F.col("w") * n)
    re, im = cx.mul(cx.pair("vis"), p if inverse else cx.conj(p))
    out = vis.withColumns({"vis_re": re, "vis_im": im})
    if tangent:
        return out
    xyz = uvw_to_xyz(F.col("u"), F.col("v"), F.col("w"), F.lit(-ra0), F.lit(dec0))
    out = out.withColumns(dict(zip(("__x", "__y", "__z"), xyz, strict=True)))
    return out.withColumns(dict(zip("uvw", xyz_to_uvw(F.col("__x"), F.col("__y"), F.col("__z"), F.lit(-ra1), F.lit(dec1)), strict=True))).drop("__x", "__y", "__z")


def remove_continuum(df: DataFrame, keys: list[str], x: Column, value: str | list[str], weight: Column, *, degree: int = 1) -> DataFrame:
    """``value`` (or each of several) less its weighted polynomial fit of ``degree`` along x within ``keys``: one aggregation,
    joined back. Rows without weight take no part in the fit; where a fit has too few points, the smallest solution is taken.

    For spectra of images the keys are (pol, y, x). x should be scaled to about -1 to 1."""
    values = [value] if isinstance(value, str) else value
    rows = df.withColumn("__x", x).withColumn("__w", weight)
    if degree == 1:
        s = {n: F.sum(F.col("__w") * f) for n, f in {"1": F.lit(1.0), "x": F.col("__x"), "xx": F.col("__x") * F.col("__x")}.items()}
        det = s["1"] * s["xx"] - s["x"] * s["x"]
        fits = [F.when(s["1"] > 0, s["x"] / s["1"]).otherwise(F.lit(0.0)).alias("__mx")]
        for k, v in enumerate(values):
            y, xy = F.sum(F.col("__w") * F.col(v)), F.sum(F.col("__w") * (F.col("__x") * F.col(v)))
            slope = F.when(F.abs(det) > 1e-12, (s["1"] * xy - s["x"] * y) / det).otherwise(F.lit(0.0))
            fits += [slope.alias(f"__b{k}"), F.when(s["1"] > 0, y / s["1"]).otherwise(F.lit(0.0)).alias(f"__m{k}")]
        fitted = lambda k: F.col(f"__m{k}") + F.col(f"__b{k}") * (F.col("__x") - F.col("__mx"))
        out = rows.join(rows.groupBy(*keys).agg(*fits), keys)
        return out.withColumns({v: F.col(v) - fitted(k) for k, v in enumerate(values)}).select(*df.columns)
    power = lambda k: F.pow(F.col("__x"), F.lit(float(k))) if k else F.lit(1.0)
    n = degree + 1
    moments = F.array(*(F.sum(F.col("__w") * power(k)) for k in range(2 * degree + 1)))
    sides = [F.array(*(F.sum(F.col("__w") * power(k) * F.col(v)) for k in range(n))) for v in values]

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series, b: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=object)
        s, b = np.stack(s.to_list()), np.stack(b.to_list())
        normal = s[:, np.add.outer(np.arange(n), np.arange(n))]
        return pd.Series(list(np.einsum("rij,rj->ri", np.linalg.pinv(normal, rcond=1e-12, hermitian=True), b)))

    sums = rows.groupBy(*keys).agg(moments.alias("__s"), *(b.alias(f"__r{k}") for k, b in enumerate(sides)))
    fits = sums.select(*keys, *(solve("__s", f"__r{k}").alias(f"__c{k}") for k in range(len(values))))
    fitted = lambda k: sum((F.col(f"__c{k}")[i] * power(i) for i in range(n)), F.lit(0.0))
    return rows.join(fits, keys).withColumns({v: F.col(v) - fitted(k) for k, v in enumerate(values)}).select(*df.columns)


def to_wavelengths(vis: DataFrame) -> DataFrame:
    """u, v, w from metres to wavelengths of each row's frequency."""
    return vis.withColumns({c: F.col(c) * F.col("frequency") / 299792458.0 for c in "uvw"})


def shift(vis: DataFrame, dl: float, dm: float) -> DataFrame:
    """V exp(-2 pi i (u dl + v dm))."""
    re, im = cx.mul(cx.pair("vis"), cx.phasor(F.col("u") * dl + F.col("v") * dm))
    return vis.withColumns({"vis_re": re, "vis_im": im})


def transform_uv(vis: DataFrame, matrix: tuple[tuple[float, float], tuple[float, float]], dl: float = 0.0, dm: float = 0.0) -> DataFrame:
    """(u, v) by a 2 x 2 matrix, after (u - w dl, v - w dm)."""
    u, v = F.col("u") - F.col("w") * dl, F.col("v") - F.col("w") * dm
    (a, b), (c, d) = matrix
    return vis.withColumns({"u": a * u + b * v, "v": c * u + d * v})


def frequency_map(vis: DataFrame, channels: int) -> DataFrame:
    """image_chan: the place of each row's frequency among the distinct ones, or 0 in an image of one channel."""
    if channels == 1:
        return vis.withColumn("image_chan", F.lit(0))
    known = vis.select("frequency").distinct().withColumn("image_chan", F.dense_rank().over(Window.orderBy(F.round("frequency"))) - 1)
    return vis.join(known, "frequency")


def running_mean(vis: DataFrame, samples: int) -> DataFrame:
    """mean_re: the mean over a sample and the ``samples`` - 1 before it, along time, for each baseline, channel and product."""
    over = Window.partitionBy("a1", "a2", "chan", "pol").orderBy("time").rowsBetween(-(samples - 1), 0)
    return vis.withColumn("mean_re", F.avg("vis_re").over(over))


def scatter(vis: DataFrame, slices: int) -> DataFrame:
    """The time slices of a table as a column; a slice is read alone by a filter on it."""
    return time_slices(vis, slices)


def gather(scattered: DataFrame) -> DataFrame:
    return scattered.drop("slice")


def time_chunks(vis: DataFrame, antennas_latitude: float, dec: float, chunk: float, limit: float, *, day: float = 86_400.0) -> DataFrame:
    """Rows with ``time_chunk``, the number of their stretch of ``chunk`` in time, in chunks during which a source at
    ``dec`` is never below ``limit``; time counts from its culmination."""
    number = F.floor(F.col("time") / chunk)
    _, el = hadec_to_azel(F.col("time") * (6.283185307179586 / day), F.lit(dec), F.lit(antennas_latitude))
    rows = vis.withColumns({"time_chunk": number.cast("long"), "__el": el})
    seen = rows.groupBy("time_chunk").agg(F.min("__el").alias("__least")).where(F.col("__least") >= limit).select("time_chunk")
    return rows.join(seen, "time_chunk", "left_semi").drop("__el")
