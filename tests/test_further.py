"""Measurement sets there and back, polarisation cubes, common solutions and further small operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_interferometry import sky_samples

from skyfringe.operators import calibration, images, imaging, joins, tables as between, visibility
from skyfringe.plans import imaging as cycles
from skyfringe.sources import tables
from skyfringe.sources.fixtures import view

SF = "/root/testdata/sf0.001"


def test_measurement_set_there_and_back(spark, tmp_path):
    rows = [(10.0 * t, 10.0, 0, b, c, p, 1e8 + c * 1e6, 1e6, 3.0 * b * (1 + c / 100), -2.0 * b * (1 + c / 100), 1.0 * (1 + c / 100), float(t + p), float(c), 1.0 + b, 1.0)
            for t in range(3) for b in (1, 2) for c in range(3) for p in range(4) if (t, b, c, p) != (1, 2, 2, 3)]
    vis = spark.createDataFrame(rows, "time double, integration_time double, a1 long, a2 long, chan long, pol long, frequency double, channel_bandwidth double, u double, v double, w double, vis_re double, vis_im double, weight double, imaging_weight double")
    tables.write_measurement_set(vis, str(tmp_path / "ms"))
    back = tables.read_measurement_set(spark, str(tmp_path / "ms"))
    assert back.count() == 72 and back.where("weight = 0").count() == 1
    off = back.join(vis.withColumnsRenamed({c: f"o_{c}" for c in ("u", "v", "w", "vis_re", "vis_im", "weight")}), visibility.KEY)
    assert off.count() == 71
    assert all(off.agg(F.max(F.abs(F.col(c) - F.col(f"o_{c}")))).first()[0] < 1e-9 for c in ("u", "v", "w", "vis_re", "vis_im", "weight"))
    names, descs = tables.list_fields(spark, str(tmp_path / "ms"))
    assert [r.name for r in names.collect()] == ["FIELD"] and descs.count() == 1
    averaged = tables.read_visibility(spark, str(tmp_path / "ms"), time_factor=3.0, chan_factor=3.0)
    assert averaged.count() < 72 and averaged.agg(F.sum("weight")).first()[0] == vis.agg(F.sum("weight")).first()[0]


def test_antenna_texts(spark, tmp_path):
    (tmp_path / "geo").write_text("35.0\t116.7\t-26.8\n12.0\t0.0\t90.0\n")
    a, b = tables.read_antennas(spark, str(tmp_path / "geo"), kind="geographic").orderBy("ant").collect()
    assert a.diameter == 35.0 and b.diameter == 12.0 and abs(b.z - 6356752.314) < 1e-2 and abs(b.x) < 1e-6
    assert 6.37e6 < np.hypot(np.hypot(a.x, a.y), a.z) < 6.378e6
    (tmp_path / "named").write_text("head\nmore\nCS001,1.0,2.0,3.0\nCS002,4.0,5.0,6.0\n")
    got = tables.read_antennas(spark, str(tmp_path / "named"), kind="named", site="LOFAR").orderBy("ant").collect()
    assert [(r.name, r.x, r.z) for r in got] == [("CS001", 1.0, 3.0), ("CS002", 4.0, 6.0)]


def test_polarised_sky_is_found(spark):
    n, cell = 32, 0.01
    sky = {0: 10.0, 1: 3.0, 2: -4.0, 3: 0.0}  # I, Q, U, V at one place
    one = sky_samples(spark, [(1.0, 5 * cell, -4 * cell)], n=300, reach=40.0)
    i, q, u, v = (sky[k] for k in range(4))
    linear = {0: (i + q, 0.0), 1: (u, v), 2: (u, -v), 3: (i - q, 0.0)}
    parts = [one.withColumns({"pol": F.lit(k).cast("long"), "vis_re": F.col("vis_re") * a - F.col("vis_im") * b, "vis_im": F.col("vis_im") * a + F.col("vis_re") * b}) for k, (a, b) in linear.items()]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = cycles.polarisation_cube(both.where("time < 3"), both.where("time >= 3"), n, cell, low=2.0, high=60.0, most=300, fraction=0.02).toPandas()
    assert set(got["pol"]) == {0, 1, 2, 3}
    near = got[(got["y"] - 12).abs().le(1) & (got["x"] - 21).abs().le(1)]
    assert abs(near[near["pol"] == 1]["model"].sum() - q) < 0.4 and abs(near[near["pol"] == 2]["model"].sum() - u) < 0.4
    assert (got[got["pol"].isin([0, 3])]["model"] == 0).all()


def test_one_solution_for_all_channels(spark):
    rng = np.random.default_rng(8)
    g = np.exp(1j * rng.uniform(-1, 1, 6))
    g *= np.exp(-1j * np.angle(g[0]))
    rows, model = [], []
    for t in (5.0, 15.0):
        for i in range(6):
            for j in range(i + 1, 6):
                for c in range(3):
                    for p in (0, 3):
                        m = complex(3 + c, 1)
                        z = m * g[i] * np.conj(g[j])
                        rows.append((t, i, j, c, p, float(z.real), float(z.imag), 1.0 if c != 1 else 0.0))
                        model.append((t, i, j, c, p, m.real, m.imag))
    vis = spark.createDataFrame(rows, "time double, a1 long, a2 long, chan long, pol long, vis_re double, vis_im double, weight double")
    mod = spark.createDataFrame(model, "time double, a1 long, a2 long, chan long, pol long, m_re double, m_im double")
    gains, fixed = cycles.calibrate_list(vis, mod, 6, 20.0, phase_only=True)
    assert gains.count() == 6 * 3 * 2 and gains.groupBy("ant", "feed").agg(F.count_distinct("g_re").alias("n")).where("n > 1").count() == 0
    off = fixed.where("weight > 0").join(mod, visibility.KEY).agg(F.max(F.hypot(F.col("vis_re") - F.col("m_re"), F.col("vis_im") - F.col("m_im")))).first()[0]
    assert off < 1e-6  # channel 1, without weight, has the others' solution
    assert fixed.where("chan = 1").count() == 60
    apart, _ = cycles.calibrate_list(vis, mod, 6, 20.0, together=False, phase_only=True)
    assert apart.where("chan = 1 AND weight > 0").count() == 0
    scaled = calibration.solve_gains(calibration.point_ratios(vis.withColumns({"vis_re": F.col("vis_re") * 9, "vis_im": F.col("vis_im") * 9}), mod, 20.0), 6, normalise=True)
    assert abs(scaled.where("chan = 0").agg(F.avg(F.hypot("g_re", "g_im"))).first()[0] - 1) < 1e-9


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_nearest_by_a_tree_is_nearest(spark, spread):
    rng = np.random.default_rng(9)
    make = lambda n, s, k: spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(np.stack([rng.uniform(0, s, n), rng.uniform(-1.5, -1.5 + min(s, 3.0), n)], 1))], "comp_id long, ra double, dec double").withColumn("comp_id", F.col("comp_id") + k)
    a, b = make(60, 6.2, 0), make(400, spread, 1000)
    b = b.unionByName(b.limit(5).withColumn("comp_id", F.col("comp_id") - 900))  # ties
    one, two = (sorted(map(tuple, joins.nearest(a, b, array_rows=k).collect())) for k in (20_000, 10))
    assert [r[:2] for r in one] == [r[:2] for r in two] and len(two) == 60
    assert joins.nearest_to(b, 0.01, -1.49).first().separation == min(r.separation for r in joins.nearest(spark.createDataFrame([(0, 0.01, -1.49)], "comp_id long, ra double, dec double"), b).collect())
    assert joins.nearest_to(b.limit(0), 0.0, 0.0).count() == 0


def test_phase_rotation_with_uvw_comes_back(spark):
    vis = view(spark, SF, "fx_vis").where("chan = 0")
    there = visibility.phase_rotate(vis, 0.1, -0.5, 0.12, -0.48, tangent=False)
    back = visibility.phase_rotate(there, 0.12, -0.48, 0.1, -0.5, tangent=False).withColumnsRenamed({c: f"b_{c}" for c in ("u", "v", "w")}).join(vis.select(*visibility.KEY, "u", "v", "w"), visibility.KEY)
    assert all(back.agg(F.max(F.abs(F.col(c) - F.col(f"b_{c}")))).first()[0] < 1e-9 for c in "uvw")
    same = there.join(vis.select(*visibility.KEY, F.col("u").alias("o")), visibility.KEY).agg(F.max(F.abs(F.col("u") - F.col("o")))).first()[0]
    assert same > 1e-3


def test_line_cube_leaves_the_line(spark):
    n, cell = 16, 0.01
    one = sky_samples(spark, [(4.0, 0.02, -0.03)], n=200, reach=25.0)
    line = sky_samples(spark, [(4.0, 0.02, -0.03), (3.0, -0.04, 0.02)], n=200, reach=25.0)
    vis = one.unionByName(one.withColumn("chan", F.lit(1).cast("long"))).unionByName(line.withColumn("chan", F.lit(2).cast("long"))).withColumn("frequency", F.lit(1e8))
    _, cube = cycles.spectral_line(vis, n, cell, most=200)
    got = {(r.chan, r.y, r.x): r.value for r in cube.collect()}
    assert got[2, 10, 4] > 1.5 and max(abs(v) for (c, y, x), v in got.items() if c == 0 and 2 <= y < 14 and 2 <= x < 14) < 1.2


def test_tables_are_deleted_after_use(spark):
    table = between.materialize(spark.range(3))
    path = table.inputFiles()[0]
    between.discard(table, None, spark.range(1))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def test_lanczos_spreads_a_component_by_its_weights(spark):
    empty = spark.createDataFrame([(0, 0, 0, 0, 0.0)], "chan long, pol long, y long, x long, value double")
    comp = spark.createDataFrame([(0, 0, -0.0137, 0.0224, 5.0)], "chan long, pol long, l double, m double, flux double")
    got = {(r.y, r.x): r.value for r in images.insert_components(empty, comp, 64, 0.01, method="lanczos").collect()}
    at = {"y": 32 + 2.24, "x": 32 + 1.37}
    lobe = lambda x: np.where(np.abs(x) < 5, np.sinc(x) * np.sinc(x / 5), 0)
    weights = {c: {int(np.floor(v + 0.5)) + k: float(lobe(int(np.floor(v + 0.5)) + k - v)) for k in range(-4, 5)} for c, v in at.items()}
    for y, wy in weights["y"].items():
        for x, wx in weights["x"].items():
            want = 5.0 * wy * wx / sum(weights["y"].values()) / sum(weights["x"].values())
            assert abs(got[y, x] - want) < 1e-9
    assert abs(sum(got.values()) - 5) < 1e-9 and imaging.PLANE == ["chan", "pol"]


def test_self_calibration_cycle_finds_phases(spark):
    """A bright point seen through phase errors: cleaned, predicted and solved, the phases come out."""
    n, cell, nant = 16, 0.01, 7
    rng = np.random.default_rng(10)
    phase = rng.uniform(-0.5, 0.5, nant)
    phase -= phase[0]
    rows = []
    for t in range(8):
        for i in range(nant):
            for j in range(i + 1, nant):
                u, v = map(float, rng.uniform(-30, 30, 2))
                z = 10 * np.exp(-2j * np.pi * (u * 0.02 - v * 0.03)) * np.exp(1j * (phase[i] - phase[j]))
                for pol in (0, 3):
                    rows.append((float(t * 10 + 5), i, j, 0, pol, u, v, 0.0, float(z.real), float(z.imag), 1.0, 1.0))
    vis = spark.createDataFrame(rows, "time double, a1 long, a2 long, chan long, pol long, u double, v double, w double, vis_re double, vis_im double, weight double, imaging_weight double")
    model, left, gains = cycles.imaging_cycle(vis, n, cell, nant, 80.0, cycles=2, most=40)
    got = {(r.ant, r.feed): np.angle(complex(r.g_re, r.g_im)) for r in gains.collect()}
    assert len(got) == 2 * nant and all(abs(got[a, f] - phase[a]) < 0.1 for a, f in got)
    peak = model.where("pol = 0").orderBy(F.desc("value")).first()
    assert (peak.y, peak.x) == (8 - 3, 8 + 2)
    assert left.where("pol = 0 AND y BETWEEN 3 AND 12 AND x BETWEEN 3 AND 12").agg(F.max(F.abs("value"))).first()[0] < 0.3 * peak.value
