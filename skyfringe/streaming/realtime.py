"""Calibration while observing: a stream of visibilities is compared with predicted components and solved window by window.

The state of a channel holds the sums of its open windows, a number for each pair of antennas and feed, and the gains of the last
window that closed, which the next solution starts from. A window closes when the watermark passes its end. State lives in
the checkpoint, so a stopped stream goes on where it was. Running totals need no such state: they are aggregations in
update mode, and their sink writes each batch under its own number, so a batch that is run again overwrites itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyfringe.operators.calibration import solve_scalar
from skyfringe.operators.components import KEY, _arrays, component_visibilities, phasor_sums
from skyfringe.operators.gridding import CELL, grid_visibility_fast

RAW = "ts timestamp, a1 long, a2 long, chan long, pol long, u double, v double, w double, vis_re double, vis_im double, weight double, imaging_weight double"
GAINS = "chan long, start timestamp, feed long, ant long, g_re double, g_im double, weight double"
#: Components that go with every batch or task as arrays.
ARRAY_ROWS = 20_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_raw(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _ratio_rows(rows: DataFrame, components: DataFrame, width: str) -> DataFrame:
    """(chan, start, end, feed, a1, a2, top_re, top_im, under) of parallel products: what a ratio's sums get from a row.

    Components (comp_id, l, m, n, flux) are predicted within the batch, those of one place as one: up to ``ARRAY_ROWS`` places by
    count as arrays by broadcast. More are predicted for a table before, in blocks that meet blocks of its samples."""
    listed = components.select("comp_id", *(F.col(c).cast("double").alias(c) for c in ("l", "m", "n", "flux")))
    listed = listed.groupBy("l", "m", "n").agg(F.min("comp_id").alias("comp_id"), F.sum("flux").alias("flux")).select(F.lit(0).alias("model_id"), "comp_id", "l", "m", "n", "flux")
    if listed.count() > ARRAY_ROWS:
        if rows.isStreaming:
            raise ValueError("more components than go with every batch; predict them into the stream's tables before")
        rows = rows if "time" in rows.columns else rows.withColumn("time", F.col("ts").cast("double"))
        predicted = component_visibilities(rows.where(F.col("pol").isin(0, 3)), listed, F.lit(1.0), array_rows=ARRAY_ROWS)
        return _ratios(rows.join(predicted.select(*KEY, F.struct(F.col("m_re").alias("re"), F.col("m_im").alias("im")).alias("m")), KEY), width)
    known = rows.sparkSession.sparkContext.broadcast(_arrays(listed.toPandas()))

    @F.pandas_udf("re double, im double")
    def model(u: pd.Series, v: pd.Series, w: pd.Series) -> pd.DataFrame:
        _, starts, lmn, flux = known.value
        if not len(starts) or not len(u):
            return pd.DataFrame({"re": np.zeros(len(u)), "im": np.zeros(len(u))})
        found = phasor_sums(np.stack([u, v, w], 1).astype(float), lmn, flux, starts)[:, 0]
        return pd.DataFrame({"re": found.real, "im": found.imag})

    return _ratios(rows.where(F.col("pol").isin(0, 3)).withColumn("m", model("u", "v", "w")), width)


def _ratios(rows: DataFrame, width: str) -> DataFrame:
    """The sums' parts of rows of parallel products with the model ``m``."""
    seen = rows.withColumn("feed", F.floor(F.col("pol") / 3).cast("long")).withColumn("win", F.window("ts", width))
    re, im, w = F.col("vis_re") * F.col("m.re") + F.col("vis_im") * F.col("m.im"), F.col("vis_im") * F.col("m.re") - F.col("vis_re") * F.col("m.im"), F.col("weight")
    under = (F.col("m.re") * F.col("m.re") + F.col("m.im") * F.col("m.im")) * w
    return seen.select("ts", "chan", F.col("win.start").alias("start"), F.col("win.end").alias("end"), "feed", "a1", "a2", (re * w).alias("top_re"), (im * w).alias("top_im"), under.alias("under"))


def _solve(top: np.ndarray, under: np.ndarray, start: np.ndarray | None, phase_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gains from the sums of a window's pairs (antennas x antennas), starting from ``start``."""
    x = np.divide(top, under, out=np.zeros_like(top), where=under > 0)
    full, wt = x + x.conj().T, under + under.T
    return solve_scalar(full, wt, phase_only=phase_only, start=start)


class WindowSolver(StatefulProcessor):
    """Open windows' sums and the last gains of one channel."""

    def __init__(self, antennas: int, phase_only: bool):
        self.antennas, self.phase_only = antennas, phase_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "end_ms long", "start_ms long, top_re array<double>, top_im array<double>, under array<double>")
        self.last = handle.getValueState("last", "g_re array<double>, g_im array<double>")

    def _of(self, row) -> tuple[np.ndarray, np.ndarray]:
        shape = (2, self.antennas, self.antennas)
        return (np.array(row[1]) + 1j * np.array(row[2])).reshape(shape), np.array(row[3]).reshape(shape)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            ends = pdf["end"].astype("datetime64[ms]").astype("int64")
            for end, part in pdf.groupby(ends):
                if end <= mark:  # the window is closed
                    continue
                name = (int(end),)
                if self.sums.containsKey(name):
                    top, under = self._of(self.sums.getValue(name))
                else:
                    top, under = np.zeros((2, self.antennas, self.antennas), complex), np.zeros((2, self.antennas, self.antennas))
                    self.handle.registerTimer(int(end))
                at = (part["feed"].to_numpy(), part["a1"].to_numpy(), part["a2"].to_numpy())
                np.add.at(top, at, part["top_re"].to_numpy() + 1j * part["top_im"].to_numpy())
                np.add.at(under, at, part["under"].to_numpy())
                start = int(part["start"].astype("datetime64[ms]").astype("int64").iloc[0])
                self.sums.updateValue(name, (start, top.real.ravel().tolist(), top.imag.ravel().tolist(), under.ravel().tolist()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        name = (expiredTimerInfo.getExpiryTimeInMs(),)
        if not self.sums.containsKey(name):
            return
        row = self.sums.getValue(name)
        top, under = self._of(row)
        before = None
        if self.last.exists():
            g = self.last.get()
            before = (np.array(g[0]) + 1j * np.array(g[1])).reshape(2, self.antennas)
        out, gains = [], np.ones((2, self.antennas), complex)
        for feed in (0, 1):
            if under[feed].any():
                gains[feed], weight = _solve(top[feed], under[feed], None if before is None else before[feed], self.phase_only)
                out.append(pd.DataFrame({"chan": key[0], "start": pd.Timestamp(row[0], unit="ms"), "feed": feed, "ant": np.arange(self.antennas), "g_re": gains[feed].real, "g_im": gains[feed].imag, "weight": weight}))
            elif before is not None:
                gains[feed] = before[feed]
        self.last.update((gains.real.ravel().tolist(), gains.imag.ravel().tolist()))
        self.sums.removeKey(name)
        yield from out

    def close(self) -> None:
        pass


def stream_gains(stream: DataFrame, components: DataFrame, antennas: int, *, width: str = "1 minute", late: str = "2 minutes", phase_only: bool = True) -> DataFrame:
    """(chan, start, feed, ant, g_re, g_im, weight) of each window and channel of a stream of ``RAW`` rows, in append mode.

    The session's state store must be one that keeps several states a key (``STORE``)."""
    rows = _ratio_rows(stream.withWatermark("ts", late), components, width)
    return rows.groupBy("chan").transformWithStateInPandas(WindowSolver(antennas, phase_only), outputStructType=GAINS, outputMode="append", timeMode="EventTime")


def table_gains(table: DataFrame, components: DataFrame, antennas: int, *, width: str = "1 minute", phase_only: bool = True) -> DataFrame:
    """The same of a table: sums by window and pair are one aggregation; a channel's windows, each of a bounded number of pairs, are
    solved in order of time, as the start of one is the end of the one before."""
    sums = _ratio_rows(table, components, width).groupBy("chan", "start", "feed", "a1", "a2").agg(*(F.sum(c).alias(c) for c in ("top_re", "top_im", "under")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out, last = [], {}
        for (start, feed), part in pdf.groupby(["start", "feed"], sort=True):
            top, under = np.zeros((antennas, antennas), complex), np.zeros((antennas, antennas))
            at = part["a1"].to_numpy(), part["a2"].to_numpy()
            top[at], under[at] = part["top_re"].to_numpy() + 1j * part["top_im"].to_numpy(), part["under"]
            if under.any():
                last[feed], weight = _solve(top, under, last.get(feed), phase_only)
                out.append(pd.DataFrame({"chan": pdf["chan"].iloc[0], "start": start, "feed": feed, "ant": np.arange(antennas), "g_re": last[feed].real, "g_im": last[feed].imag, "weight": weight}))
        return pd.concat(out) if out else pd.DataFrame(columns=["chan", "start", "feed", "ant", "g_re", "g_im", "weight"])

    return sums.groupBy("chan").applyInPandas(solve, GAINS)


# --- running totals -----------------------------------------------------------------------------------------------------


def running_weights(rows: DataFrame) -> DataFrame:
    """(chan, pol, samples, weight, imaging_weight) of all rows so far."""
    return rows.groupBy("chan", "pol").agg(F.count(F.lit(1)).alias("samples"), F.sum("weight").alias("weight"), F.sum("imaging_weight").alias("imaging_weight"))


def running_grid(rows: DataFrame, npixel: int, cellsize: float) -> DataFrame:
    """The grid of all rows so far, by nearest cells; its state has the size of the grid."""
    return grid_visibility_fast(rows, npixel, cellsize)


def write_totals(totals: DataFrame, path: str, checkpoint: str, *, available: bool = True):
    """Start a stream of totals in update mode: what a batch changed goes to its own folder, ``batch=n``, and a batch that is run again
    after a failure replaces that folder."""

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    writer = totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available else writer).start()


def read_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last totals of each key that a stream has written."""
    rows = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/batch=*")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("__n", last).where("__n = 1").drop("__n", "batch")


WEIGHT_KEYS, GRID_KEYS = ["chan", "pol"], CELL
