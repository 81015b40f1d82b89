"""Streams of visibilities: windowed baseline averages and running antenna statistics.

Rows carry an event time ``ts``. A watermark bounds the state: windows are closed, and late rows left out, once the
stream is ``late`` past their end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfringe.operators.calibration import materialize, solve_scalar

SCHEMA = "ts timestamp, a1 long, a2 long, x_re double, x_im double, weight double"


def read_visibilities(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_ratios(stream: DataFrame, *, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, a1, a2, x_re, x_im, weight): weighted means by window and baseline; works on a stream or a table."""
    return window_means(stream, width=width, late=late).select(F.col("win.start").alias("start"), "a1", "a2", "x_re", "x_im", "weight")


def window_means(stream: DataFrame, *, width: str, late: str) -> DataFrame:
    """(win, a1, a2, x_re, x_im, weight), the window as it is, so that it can be grouped by again."""
    total = F.sum("weight")
    rows = stream.withWatermark("ts", late) if stream.isStreaming else stream
    means = [(F.sum(F.col(c) * F.col("weight")) / total).alias(c) for c in ("x_re", "x_im")]
    return rows.groupBy(F.window("ts", width).alias("win"), "a1", "a2").agg(*means, total.alias("weight"))


def antenna_power(stream: DataFrame, *, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, ant, power, samples): mean |x| ** 2 of all baselines of an antenna in each window."""
    rows = stream.withWatermark("ts", late) if stream.isStreaming else stream
    each = rows.withColumn("ant", F.explode(F.array("a1", "a2")))
    power = F.col("x_re") * F.col("x_re") + F.col("x_im") * F.col("x_im")
    out = each.groupBy(F.window("ts", width).alias("win"), "ant").agg(F.avg(power).alias("power"), F.count(F.lit(1)).alias("samples"))
    return out.select(F.col("win.start").alias("start"), "ant", "power", "samples")


def sliding_counts(stream: DataFrame, *, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, a1, a2, samples) in overlapping windows."""
    rows = stream.withWatermark("ts", late) if stream.isStreaming else stream
    out = rows.groupBy(F.window("ts", width, step).alias("win"), "a1", "a2").agg(F.count(F.lit(1)).alias("samples"))
    return out.select(F.col("win.start").alias("start"), "a1", "a2", "samples")


def scans(stream: DataFrame, *, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """(start, a1, samples): runs of an antenna's rows without a gap, as session windows."""
    rows = stream.withWatermark("ts", late) if stream.isStreaming else stream
    out = rows.groupBy(F.session_window("ts", gap).alias("win"), "a1").agg(F.count(F.lit(1)).alias("samples"))
    return out.select(F.col("win.start").alias("start"), "a1", "samples")


def window_gains(stream: DataFrame, antennas: int, *, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, ant, g_re, g_im): one gain solution for each window, from its weighted mean ratios.

    A window's ratios by baseline are one aggregation, the list of them (bounded by the antennas' square) a second, and
    the solution a function of that list; both aggregations close with the watermark, so it works on a stream too.
    """
    means = window_means(stream, width=width, late=late)
    listed = means.groupBy("win").agg(F.collect_list(F.struct("a1", "a2", "x_re", "x_im", "weight")).alias("rows"))

    @F.pandas_udf("array<struct<ant:long,g_re:double,g_im:double>>")
    def solve(windows: pd.Series) -> pd.Series:
        out = []
        for rows in windows:
            x, wt = np.zeros((antennas, antennas), complex), np.zeros((antennas, antennas))
            for r in rows:
                x[r["a1"], r["a2"]], wt[r["a1"], r["a2"]] = complex(r["x_re"], r["x_im"]), r["weight"]
            g, _ = solve_scalar(x + x.conj().T, wt + wt.T)
            out.append([{"ant": k, "g_re": float(v.real), "g_im": float(v.imag)} for k, v in enumerate(g)])
        return pd.Series(out)

    return listed.select(F.col("win.start").alias("start"), F.explode(solve("rows")).alias("g")).select("start", "g.*")


def late_rows(arrivals: DataFrame, late: str) -> DataFrame:
    """(a1, late): how many rows of a table came more than ``late`` behind the latest time seen before them, in the order
    of event_id; what a watermark of that delay would leave out of windows long closed.

    The latest time so far is found by ranges of event_id: each keeps its own, and starts from the latest of those
    before it (a row a range).
    """
    ranges = int(arrivals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(arrivals.repartitionByRange(ranges, "event_id").withColumn("__part", F.spark_partition_id()))
    most = parts.groupBy("__part").agg(F.max("ts").alias("__most"))
    before = most.select("__part", F.max("__most").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    within = F.max("ts").over(Window.partitionBy("__part").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = parts.withColumn("__own", within).join(F.broadcast(before), "__part").withColumn("seen", F.greatest("__own", "__before"))
    behind = F.col("ts") < F.col("seen") - F.expr(f"INTERVAL {late}")
    return seen.groupBy("a1").agg(F.sum(behind.cast("long")).alias("late"))


def dropped_late(query) -> int:
    """How many rows the watermark of a running or stopped query has left out so far, by its own progress."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])
