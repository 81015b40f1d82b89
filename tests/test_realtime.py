"""Real-time calibration and running totals: a stream that stops and resumes equals the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfringe.operators.gridding import grid_visibility_fast
from skyfringe.streaming import realtime as rt

NANT = 5


@pytest.fixture
def observed(spark):
    rng = np.random.default_rng(1)
    rows, comps = [], [(1, 0.01, -0.02, -0.0003, 4.0), (2, -0.03, 0.01, -0.0005, 2.0)]
    phase = np.array([0, 0.3, -0.4, 0.8, -0.9])
    for t in range(30):  # six windows of a minute, phases drift
        g = np.exp(1j * phase * (1 + 0.1 * (t // 5)))
        for i in range(NANT):
            for j in range(i + 1, NANT):
                u, v, w = map(float, rng.uniform(-20, 20, 3))
                for c in (0, 1):
                    for pol in (0, 3):
                        z = sum(f * np.exp(-2j * np.pi * (u * l + v * m + w * n)) for _, l, m, n, f in comps) * g[i] * np.conj(g[j])
                        rows.append((1_700_000_040 + 12 * t, i, j, c, pol, u, v, w, float(z.real), float(z.imag), 1.0, 1.0))
    names = "s long, a1 long, a2 long, chan long, pol long, u double, v double, w double, vis_re double, vis_im double, weight double, imaging_weight double"
    table = spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_seconds("s")).select("ts", *[c.split()[0] for c in rt.RAW.split(", ")][1:])
    return table, spark.createDataFrame(comps, "comp_id long, l double, m double, n double, flux double"), phase


def pieces(table, folder, count, first, last):
    """Some of ``count`` stretches of time as files of a source folder, in order."""
    low, high = table.agg(F.min("ts").cast("long"), F.max("ts").cast("long")).first()
    for k in range(first, last):
        a, b = low + (high - low + 1) * k / count, low + (high - low + 1) * (k + 1) / count
        table.where((F.col("ts").cast("long") >= a) & (F.col("ts").cast("long") < b)).coalesce(1).write.mode("append").parquet(str(folder))


def test_gains_of_a_table_follow_the_windows(spark, observed):
    table, comps, phase = observed
    got = rt.table_gains(table, comps, NANT).toPandas()
    assert len(got) == 6 * 2 * 2 * NANT
    order = {s: k for k, s in enumerate(sorted(got["start"].unique()))}
    for r in got.itertuples():
        assert abs(np.angle(complex(r.g_re, r.g_im) * np.exp(-1j * phase[r.ant] * (1 + 0.1 * order[r.start])))) < 1e-5
    assert rt.table_gains(table.limit(0), comps, NANT).count() == 0


def test_stream_stops_and_goes_on(spark, observed, tmp_path):
    table, comps, _ = observed
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rt.STORE)
    try:
        for first, last in ((0, 3), (3, 6)):
            pieces(table, tmp_path / "in", 6, first, last)
            if last == 6:  # a row far ahead moves the watermark past all windows
                table.limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 HOURS")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            gains = rt.stream_gains(rt.read_raw(spark, str(tmp_path / "in")), comps, NANT, late="30 seconds")
            query = gains.writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            query.awaitTermination()
            seen = spark.read.schema(rt.GAINS).parquet(str(tmp_path / "out")).count()
            assert (0 < seen < 6 * 4 * NANT) if last == 3 else seen == 6 * 4 * NANT
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    key = ["chan", "start", "feed", "ant"]
    a = spark.read.parquet(str(tmp_path / "out")).orderBy(*key).toPandas()
    b = rt.table_gains(table, comps, NANT).orderBy(*key).toPandas()
    assert (a[key] == b[key]).all(axis=None) and np.allclose(a[["g_re", "g_im", "weight"]], b[["g_re", "g_im", "weight"]], atol=1e-6)


def test_running_totals_equal_the_table(spark, observed, tmp_path):
    table, _, _ = observed
    for name, totals, keys, want in (
        ("weights", rt.running_weights, rt.WEIGHT_KEYS, rt.running_weights(table)),
        ("grid", lambda d: rt.running_grid(d, 32, 0.01), rt.GRID_KEYS, grid_visibility_fast(table, 32, 0.01)),
    ):
        out, state, source = str(tmp_path / name / "out"), str(tmp_path / name / "state"), tmp_path / name / "in"
        for first, last in ((0, 2), (2, 4)):
            pieces(table, source, 4, first, last)
            rt.write_totals(totals(rt.read_raw(spark, str(source))), out, state).awaitTermination()
        got, whole = (d.orderBy(*keys).toPandas() for d in (rt.read_totals(spark, out, keys), want))
        assert len(got) == len(whole) and np.allclose(got[whole.columns].astype(float), whole.astype(float))
        batches = len(list((tmp_path / name / "out").glob("batch=*")))
        # A batch that is run again replaces its own folder.
        spark.read.parquet(f"{out}/batch=0").write.mode("overwrite").parquet(str(tmp_path / name / "again"))
        spark.read.parquet(str(tmp_path / name / "again")).write.mode("overwrite").parquet(f"{out}/batch=0")
        again = rt.read_totals(spark, out, keys).orderBy(*keys).toPandas()
        assert batches == len(list((tmp_path / name / "out").glob("batch=*"))) and np.allclose(again[whole.columns].astype(float), whole.astype(float))
