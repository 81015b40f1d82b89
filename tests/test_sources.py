"""Readers and composed imaging on small made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfringe.operators import gridding
from skyfringe.plans import imaging
from skyfringe.sources import tables


@pytest.fixture(scope="module")
def measurement_set(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ms"))
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}")
    put([(0, "A"), (1, "B")], "field_id long, name string", "FIELD")
    put([(0, 0), (1, 0)], "data_desc_id long, spectral_window_id long", "DATA_DESCRIPTION")
    put([(0, [1e8, 1.1e8], [1e6, 1e6])], "spectral_window_id long, chan_freq array<double>, chan_width array<double>", "SPECTRAL_WINDOW")
    data = [[{"re": float(10 * c + p), "im": 1.0} for p in range(2)] for c in range(2)]
    rows = [(f, d, t, 10.0, 0, 1, 3.0, 4.0, 5.0, data, [[1.0, 2.0]] * 2) for f in (0, 1) for d in (0, 1) for t in (5.0, 15.0, 95.0)]
    put(rows, "field_id long, data_desc_id long, time double, interval double, a1 long, a2 long, u double, v double, w double, data array<array<struct<re:double,im:double>>>, weight array<array<double>>", "MAIN")
    return path


def test_measurement_set(spark, measurement_set):
    names, descs = tables.list_fields(spark, measurement_set)
    assert {r.name for r in names.collect()} == {"A", "B"} and descs.count() == 2
    vis = tables.read_measurement_set(spark, measurement_set, fields=["A"], data_descs=[1], channels=(1, 1))
    got = vis.orderBy("time", "pol").collect()
    assert len(got) == 6 and {r.field for r in got} == {"A"} and {r.chan for r in got} == {1}
    assert [r.time for r in got[::2]] == [0.0, 10.0, 90.0] and [r.integration for r in got[::2]] == [0, 0, 1]
    assert [r.vis_re for r in got[:2]] == [10.0, 11.0] and [r.weight for r in got[:2]] == [1.0, 2.0]
    assert abs(got[0].u + 3.0 * 1.1e8 / tables.C) < 1e-12


def test_visibilities_by_channel(spark, measurement_set, tmp_path):
    vis = tables.read_measurement_set(spark, measurement_set)
    tables.write_visibilities(vis, str(tmp_path / "vis"))
    back = spark.read.parquet(str(tmp_path / "vis"))
    assert back.count() == vis.count()
    assert "PartitionFilters: [isnotnull(chan" in back.where("chan = 1")._jdf.queryExecution().toString()


def test_antennas_and_catalogues(spark, tmp_path):
    (tmp_path / "ant.csv").write_text("0,0,0\n10,0,0\n5000,0,0\n")
    got = tables.read_antennas(spark, str(tmp_path / "ant.csv"), site="LOW", most=2000).collect()
    assert [r.ant for r in got] == [0, 1] and got[0].diameter == 35.0
    (tmp_path / "cat.csv").write_text("a,0,0,0,0.1,0.1,0,0,0,1.0,0.5\nb,0,0,0,0.1,0.1,0,0,0,-2.0,-3.0\nc,0,0,0,9,9,0,0,0,1.0,0.5\n")
    got = tables.read_offset_catalogue(spark, str(tmp_path / "cat.csv"), 0.1, -0.5, flux_limit=1.0, radius=0.05).collect()
    assert [r.name for r in got] == ["a"] and abs(got[0].flux - 10) < 1e-9
    bands = spark.createDataFrame([("x", 5.0, -28.0, 9.0, 1.0, 3.0), ("y", 5.0, -28.0, 9.0, None, 3.0)], "Name string, RAJ2000 double, DEJ2000 double, peak_flux_wide double, int_flux_076 double, int_flux_084 double")
    got = tables.read_band_catalogue(bands, [76, 84], [8e7], flux_limit=1.0, ra0=0.09, dec0=-0.49, radius=0.1).collect()
    assert [(r.name, r.flux) for r in got] == [("x", 2.0)]


def test_continuum_cycles_find_a_point(spark):
    n, cell = 16, 0.01
    rng = np.random.default_rng(5)
    uv = [(int(a), int(b)) for a, b in rng.integers(-7, 8, (120, 2))]
    rows = []
    for k, (a, b) in enumerate(uv):
        u, v = a / (n * cell), b / (n * cell)
        phase = -2 * np.pi * (u * 3 * cell + v * -2 * cell)
        rows.append((float(k), 0, 1, 0, 0, u, v, 0.0, 4 * float(np.cos(phase)), 4 * float(np.sin(phase)), 1.0, 1.0))
    vis = spark.createDataFrame(rows, "time double, a1 long, a2 long, chan long, pol long, u double, v double, w double, vis_re double, vis_im double, weight double, imaging_weight double")
    dirty = gridding.invert(vis, n, cell).orderBy(F.desc("value")).first()
    assert (dirty.y, dirty.x) == (n // 2 - 2, n // 2 + 3) and abs(dirty.value - 4) < 1e-9
    model, residual = imaging.continuum_imaging(vis, n, cell, cycles=2, gain=0.3, most=60)
    assert abs(model.where(f"y = {n // 2 - 2} AND x = {n // 2 + 3}").first().value - 4) < 0.5
    assert residual.agg(F.max(F.abs("value"))).first()[0] < 0.5
