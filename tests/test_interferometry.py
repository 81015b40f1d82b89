"""Operators that SQL does not express, held against numpy or against what must hold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyfringe.functions import coordinates as co
from skyfringe.functions import polarisation as po
from skyfringe.functions import windows as wi
from skyfringe.operators import calibration, clean, gridding, images, imaging, jones, joins, skymodel, visibility
from skyfringe.plans.queries import QUERIES
from skyfringe.sources.fixtures import view
from skyfringe.streaming import calibration as streaming

SF = "/root/testdata/sf0.001"


def test_solved_gains_leave_no_residual(spark):
    out = QUERIES["c04_gain_residual"](spark, SF).toPandas()
    ratios = QUERIES["c02_point_ratios"](spark, SF)
    assert len(out) and (out["residual"] >= 0).all()
    g = np.exp(1j * np.linspace(0, 1, 6)) * np.linspace(1, 1.5, 6)
    rows = [(0, 0, i, j, float((g[i] * g[j].conj()).real), float((g[i] * g[j].conj()).imag), 1.0) for i in range(6) for j in range(i + 1, 6)]
    exact = spark.createDataFrame(rows, "slot long, chan long, a1 long, a2 long, x_re double, x_im double, weight double")
    solved = calibration.solve_gains(exact, 6)
    assert calibration.gain_residual(exact, solved).first()["residual"] < 3e-8
    assert ratios.columns[:2] == ["slot", "a1"]


def test_gains_then_inverse_is_identity(spark):
    vis, gains = view(spark, SF, "fx_vis").where("chan = 1"), view(spark, SF, "fx_gain").where("weight > 0")
    there = joins.apply_gains(vis, gains, interval=160.0, first=75.0)
    back = joins.apply_gains(there, gains, interval=160.0, first=75.0, inverse=True).select(*visibility.KEY, F.col("vis_re").alias("r"), F.col("vis_im").alias("i"))
    off = back.join(vis, visibility.KEY).agg(F.max(F.abs(F.col("r") - F.col("vis_re")) + F.abs(F.col("i") - F.col("vis_im")))).first()[0]
    assert off < 1e-9


def test_phase_rotation_round_trip(spark):
    vis = view(spark, SF, "fx_vis").where("chan = 1")
    there = visibility.phase_rotate(vis, 0.1, -0.5, 0.12, -0.49)
    back = visibility.phase_rotate(there, 0.1, -0.5, 0.12, -0.49, inverse=True).select(*visibility.KEY, F.col("vis_re").alias("r"))
    assert back.join(vis, visibility.KEY).agg(F.max(F.abs(F.col("r") - F.col("vis_re")))).first()[0] < 1e-9


@pytest.mark.parametrize("other", ["linear", "circular"])
def test_polarisation_round_trip(spark, other):
    vis = view(spark, SF, "fx_vis").where("chan = 1")
    keys = ["time", "a1", "a2", "chan"]
    full = vis.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n = 4").drop("n")
    vis = vis.join(full, keys, "left_semi")
    back = po.convert_frame(po.convert_frame(vis, keys, "stokesIQUV", other), keys, other, "stokesIQUV").select(*keys, "pol", F.col("vis_re").alias("r"), F.col("vis_im").alias("i"))
    off = back.join(vis, visibility.KEY).agg(F.max(F.abs(F.col("r") - F.col("vis_re")) + F.abs(F.col("i") - F.col("vis_im")))).first()[0]
    assert off < 1e-9


def test_coordinate_inverses(spark):
    df = spark.createDataFrame([(0.3, -0.4, 0.1), (1.2, 0.7, -0.9)], "ha double, dec double, lat double")
    az, el = co.hadec_to_azel(F.col("ha"), F.col("dec"), F.col("lat"))
    ha, dec = co.azel_to_hadec(az, el, F.col("lat"))
    for row in df.select("ha", "dec", ha.alias("h"), dec.alias("d")).collect():
        assert abs(row.ha - row.h) < 1e-9 and abs(row.dec - row.d) < 1e-9
    u, v, w = co.xyz_to_uvw(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.col("ha"), F.col("dec"))
    x, y, z = co.uvw_to_xyz(u, v, w, F.col("ha"), F.col("dec"))
    for row in df.select(x.alias("x"), y.alias("y"), z.alias("z")).collect():
        assert np.allclose([row.x, row.y, row.z], [1, 2, 3])


def test_invert_is_the_direct_sum_on_grid_points(spark):
    n, cell = 16, 0.01
    rng = np.random.default_rng(3)
    rows = [(0.0, 0, k + 1, 0, 0, float(a) / (n * cell), float(b) / (n * cell), 0.0, float(r), float(i), 1.0, 1.0) for k, (a, b, r, i) in enumerate(zip(rng.integers(-6, 6, 30), rng.integers(-6, 6, 30), rng.normal(size=30), rng.normal(size=30), strict=True))]
    vis = spark.createDataFrame(rows, "time double, a1 long, a2 long, chan long, pol long, u double, v double, w double, vis_re double, vis_im double, weight double, imaging_weight double")
    a = gridding.invert(vis, n, cell).select("y", "x", F.col("value").alias("fft"))
    b = gridding.direct_image(vis, n, cell)
    assert a.join(b, ["y", "x"]).agg(F.max(F.abs(F.col("fft") - F.col("value")))).first()[0] < 1e-9


def test_kernel_sums_to_one_and_degrid_recovers_a_constant(spark):
    kernel = gridding.spheroidal_kernel(spark, 2, 4)
    sums = kernel.groupBy("ou", "ov").agg(F.sum("kernel").alias("s")).collect()
    assert len(sums) == 16 and all(abs(r.s - 1) < 1e-12 for r in sums)
    vis = view(spark, SF, "fx_vis").where("pol = 0 AND chan = 0")
    grid = spark.range(64).select(F.col("id").alias("gv")).crossJoin(spark.range(64).select(F.col("id").alias("gu"))).selectExpr("0 AS chan", "0 AS pol", "gv", "gu", "2.0D AS re", "-1.0D AS im")
    out = gridding.degrid_visibility(vis, grid, 64, 0.002, support=2, oversampling=4).toPandas()
    assert len(out) == vis.count()
    assert np.allclose(out["vis_re"], 2) and np.allclose(out["vis_im"], -1)


def test_hogbom_finds_a_point(spark):
    psf = pd.DataFrame([(0, 0, y, x, float(np.exp(-((y - 8) ** 2 + (x - 8) ** 2) / 3))) for y in range(17) for x in range(17)], columns=["chan", "pol", "y", "x", "value"])
    dirty = psf.assign(value=5 * psf["value"])
    out = clean.clean(spark.createDataFrame(dirty), spark.createDataFrame(psf), fraction=0.01, most=500).toPandas()
    assert abs(out["model"].sum() - 5) < 0.1 and out.loc[out["model"].idxmax(), ["y", "x"]].tolist() == [8, 8]


VIS = "time double, a1 long, a2 long, chan long, pol long, u double, v double, w double, vis_re double, vis_im double, weight double, imaging_weight double"


def sky_samples(spark, sources, n=400, w=0.0, seed=3, reach=40.0):
    """Random samples of point sources (flux, l, m)."""
    rng = np.random.default_rng(seed)
    uvw = rng.uniform(-reach, reach, (n, 3)) * [1, 1, w]
    total = sum(f * np.exp(-2j * np.pi * (uvw @ [l, m, np.sqrt(1 - l * l - m * m) - 1])) for f, l, m in sources)
    rows = [(float(k % 7), 0, k + 1, 0, 0, *map(float, uvw[k]), float(total[k].real), float(total[k].imag), 1.0, 1.0) for k in range(n)]
    return spark.createDataFrame(rows, VIS)


def plane(df, n, column="value"):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.y, r.x] = r[column]
    return out


def direct(vis, n, cell):
    """The image by the direct sum with w."""
    rows = vis.toPandas()
    at = (np.arange(n) - n // 2) * cell
    l, m = np.meshgrid(at, at)  # noqa: E741
    turns = rows["u"].to_numpy()[:, None, None] * l + rows["v"].to_numpy()[:, None, None] * m + rows["w"].to_numpy()[:, None, None] * (np.sqrt(1 - l * l - m * m) - 1)
    v = (rows["vis_re"] + 1j * rows["vis_im"]).to_numpy()[:, None, None]
    return (v * np.exp(2j * np.pi * turns)).real.mean(0)


def test_kernel_invert_is_the_direct_sum(spark):
    vis = sky_samples(spark, [(3.0, 0.02, -0.01), (1.0, -0.03, 0.02)])
    got, want = plane(imaging.invert(vis, 32, 0.005), 32), direct(vis, 32, 0.005)
    assert np.abs(got - want)[4:-4, 4:-4].max() < 0.02 * np.abs(want).max()


def test_predict_is_the_direct_sum(spark):
    n, cell = 32, 0.005
    sources = [(3.0, 4 * cell, -2 * cell), (1.0, -6 * cell, 5 * cell)]
    vis = sky_samples(spark, sources)
    image = spark.createDataFrame([(0, 0, n // 2 + round(m / cell), n // 2 + round(l / cell), f) for f, l, m in sources], "chan long, pol long, y long, x long, value double")

    def worst(oversampling):
        got = imaging.predict(vis, image, n, cell, oversampling=oversampling).join(vis, visibility.KEY).toPandas()
        assert len(got) == 400
        return np.hypot(got["m_re"] - got["vis_re"], got["m_im"] - got["vis_im"]).max()

    # A tabulated kernel takes a place for the middle of its sub-cell, half a sub-cell off at most on each axis.
    bound = lambda oversampling: sum(f * np.pi * (abs(l) + abs(m)) / cell / (oversampling * n) for f, l, m in sources)
    assert worst(16) < 1.1 * bound(16) and worst(64) < 1.1 * bound(64) + 0.01
    left, dirty = imaging.residual(vis, image, n, cell)
    assert np.abs(plane(dirty, n))[4:-4, 4:-4].max() < 0.02 and left.count() == 400


def test_w_stack_sees_w(spark):
    n, cell = 32, 0.02
    vis = sky_samples(spark, [(2.0, 0.16, -0.1)], w=2.0, reach=12.0)
    want = direct(vis, n, cell)
    flat, stacked = plane(imaging.invert(vis, n, cell), n), plane(imaging.wstack_invert(vis, n, cell, 1.0), n)
    inner = np.s_[4:-4, 4:-4]
    assert np.abs(stacked - want)[inner].max() < 0.05 * want.max() < np.abs(flat - want)[inner].max()
    image = spark.createDataFrame([(0, 0, 16 - 5, 16 + 8, 2.0)], "chan long, pol long, y long, x long, value double")
    got = imaging.wstack_predict(vis, image, n, cell, 1.0).join(vis, visibility.KEY).toPandas()
    # Half a sub-cell on each axis, and half a slice of w, are what a sample's phase can be off.
    bound = 2.0 * (np.pi * (8 + 5) / (imaging.OVERSAMPLING * n) + 2 * np.pi * 0.5 * abs(np.sqrt(1 - 0.16**2 - 0.1**2) - 1))
    assert np.hypot(got["m_re"] - got["vis_re"], got["m_im"] - got["vis_im"]).max() < 1.1 * bound


def test_time_slices_see_a_plane_of_w(spark):
    n, cell = 64, 0.01  # fine enough for pixels to be looked up between others
    vis = sky_samples(spark, [(2.0, 0.16, -0.1)], reach=12.0).withColumn("w", 0.9 * F.col("u") - 0.5 * F.col("v"))
    l, m = 0.16, -0.1
    turns = F.col("u") * l + F.col("v") * m + F.col("w") * float(np.sqrt(1 - l * l - m * m) - 1)
    vis = vis.withColumns({"vis_re": 2 * F.cos(2 * np.pi * turns), "vis_im": -2 * F.sin(2 * np.pi * turns)})
    want, inner = direct(vis, n, cell), np.s_[8:-8, 8:-8]
    off = lambda got: np.abs(plane(got, n) - want)[inner].max() / want.max()
    assert off(imaging.timeslice_invert(vis, n, cell, 1.0)) < 0.08 < off(imaging.invert(vis, n, cell))


def test_facets_make_the_whole_image(spark):
    vis = sky_samples(spark, [(3.0, 0.02, -0.01), (1.0, -0.03, 0.02)])
    got, want = plane(imaging.facets_invert(vis, 32, 0.005, 2), 32), direct(vis, 32, 0.005)
    assert np.abs(got - want).max() < 0.03 * np.abs(want).max()


def test_clean_scales_and_windows():
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:33, 0:33]
    psf = np.exp(-((y - 16) ** 2 + (x - 16) ** 2) / 4) + 0.02 * rng.normal(size=(33, 33))
    psf[16, 16] = 1.0
    blob = clean.scale_blob(4.0)
    sky = np.zeros((33, 33))
    clean._subtract(sky, blob, 16, 16, (blob.shape[0] // 2,) * 2, -50.0)
    dirty = clean._convolved(sky, psf)
    options = {"gain": 0.3, "threshold": 0.0, "fraction": 0.02, "most": 200}
    model, res = clean.clean_scales(dirty, psf, None, scales=(0.0, 4.0), **options)
    assert abs(model.sum() - 50) < 3 and np.abs(res).max() < 0.05 * dirty.max()
    window = np.zeros_like(dirty)
    window[10:20, 10:20] = 1
    model, _ = clean.clean_plane(dirty, psf, window, **options)
    assert (model[window == 0] == 0).all() and model.any()


def test_hogbom_against_a_plain_loop():
    """A component first, then the check of what is left at its place."""
    rng = np.random.default_rng(2)
    psf = np.zeros((9, 9))
    psf[4, 4], psf[4, 5], psf[3, 4] = 1.0, 0.4, 0.2
    dirty = rng.normal(size=(9, 9))
    model, res = clean.clean_plane(dirty, psf, None, gain=0.2, threshold=0.5, fraction=0.0, most=40)
    left, comps = dirty.copy(), np.zeros((9, 9))
    for _ in range(40):
        ky, kx = divmod(int(np.abs(left).argmax()), 9)
        step = 0.2 * left[ky, kx]
        comps[ky, kx] += step
        for a in range(9):
            for b in range(9):
                if 0 <= a - ky + 4 < 9 and 0 <= b - kx + 4 < 9:
                    left[a, b] -= step * psf[a - ky + 4, b - kx + 4]
        if abs(left[ky, kx]) < 0.9 * 0.5:
            break
    assert np.allclose(model, comps) and np.allclose(res, left)


def test_clean_pair_takes_both(spark):
    psf = pd.DataFrame([(0, p, y, x, float(np.exp(-((y - 8) ** 2 + (x - 8) ** 2) / 3))) for p in (1, 2) for y in range(17) for x in range(17)], columns=["chan", "pol", "y", "x", "value"])
    dirty = psf.assign(value=psf["value"] * psf["pol"].map({1: 3.0, 2: -4.0}))
    out = clean.clean_complex(spark.createDataFrame(dirty), spark.createDataFrame(psf), fraction=0.01, most=500).toPandas()
    assert abs(out[out["pol"] == 1]["model"].sum() - 3) < 0.1 and abs(out[out["pol"] == 2]["model"].sum() + 4) < 0.1
    cut = clean.clean_facets(spark.createDataFrame(dirty[dirty["pol"] == 1]), spark.createDataFrame(psf[psf["pol"] == 1]), 16, 2, 4, fraction=0.01, most=300).toPandas()
    assert abs(cut["model"].sum() - 3) < 0.3 and not cut.duplicated(["y", "x"]).any()


def test_matrix_gains_are_found():
    rng = np.random.default_rng(4)
    g = np.eye(2) + 0.2 * (rng.normal(size=(7, 2, 2)) + 1j * rng.normal(size=(7, 2, 2)))
    x = np.einsum("iab,jcb->ijac", g, g.conj())
    wt = np.ones((7, 7)) - np.eye(7)
    found, _ = jones.solve_matrices(x, wt, rounds=2000)
    # Gains are known up to one unitary matrix that all share; products are not.
    assert np.abs(np.einsum("iab,jcb->ijac", found, found.conj()) - x)[wt > 0].max() < 1e-6


def test_sequence_of_terms_comes_off_again(spark):
    vis = view(spark, SF, "fx_vis").where("chan = 1")
    full = vis.groupBy("time", "a1", "a2", "chan").count().where("count = 4").drop("count")
    vis = vis.join(full, ["time", "a1", "a2", "chan"], "left_semi")
    gains = view(spark, SF, "fx_gain").where("weight > 0")
    rng = np.random.default_rng(6)
    leak = {n: float(v) for n, v in zip(jones.NAMES, (1, 0, *rng.uniform(-0.1, 0.1, 4), 0.9, 0.1), strict=True)}
    d = gains.select("time", "ant", "chan", *(F.lit(v).alias(n) for n, v in leak.items()), "weight")
    g = jones.as_matrices(gains.withColumn("feed", F.explode(F.array(F.lit(0), F.lit(1)))))
    there = jones.apply_sequence(vis, [d, g], interval=160.0, first=75.0)
    back = jones.apply_sequence(there, [d, g], interval=160.0, first=75.0, inverse=True).select(*visibility.KEY, F.col("vis_re").alias("r"), F.col("vis_im").alias("i"))
    n, off = back.join(vis, visibility.KEY).agg(F.count(F.lit(1)), F.max(F.abs(F.col("r") - F.col("vis_re")) + F.abs(F.col("i") - F.col("vis_im")))).first()
    assert n and off < 1e-9


def test_terms_take_gains_off(spark):
    rng = np.random.default_rng(5)
    g = rng.uniform(0.8, 1.3, 6) * np.exp(1j * rng.uniform(-1, 1, 6))
    key = [(float(t), i, j, c, p) for t in (5, 10) for i in range(6) for j in range(i + 1, 6) for c in range(2) for p in (0, 3)]
    seen = {k: (10 + k[3]) * g[k[1]] * np.conj(g[k[2]]) for k in key}
    names = "time double, a1 long, a2 long, chan long, pol long, "
    vis = spark.createDataFrame([(*k, float(v.real), float(v.imag), 1.0) for k, v in seen.items()], names + "vis_re double, vis_im double, weight double")
    model = spark.createDataFrame([(*k, float(10 + k[3]), 0.0) for k in key], names + "m_re double, m_im double")
    gains, fixed = jones.calibrate_terms(vis, model, [jones.Term("T", 20.0, phase_only=True, all_channels=True), jones.Term("G", 20.0)], 6)
    assert set(gains) == {"T", "G"} and all(abs(np.hypot(r.g_re, r.g_im) - 1) < 1e-9 for r in gains["T"].collect())
    assert all(abs(complex(r.vis_re, r.vis_im) - (10 + r.chan)) < 1e-5 for r in fixed.collect()) and fixed.count() == len(key)


def test_a_component_is_fitted(spark):
    vis = sky_samples(spark, [(4.0, 0.011, -0.007)], w=1.0)
    assert np.allclose(jones.fit_component(vis, 3.0, 0.0105, -0.0066), (4.0, 0.011, -0.007), atol=1e-6)


def test_neighbours_go_in_the_order_of_the_list(spark):
    rng = np.random.default_rng(9)
    sky = rng.uniform(0, 0.02, (60, 2))
    flux = rng.integers(1, 6, 60)
    rows_ = [(k, float(a), float(b), float(f)) for k, ((a, b), f) in enumerate(zip(sky, flux, strict=True))]
    got = {r.comp_id for r in skymodel.remove_neighbours(spark.createDataFrame(rows_, "comp_id long, ra double, dec double, flux0 double"), 0.002, "flux0").collect()}

    def apart(i, j):
        d = np.sin((sky[j, 1] - sky[i, 1]) / 2) ** 2 + np.cos(sky[i, 1]) * np.cos(sky[j, 1]) * np.sin((sky[j, 0] - sky[i, 0]) / 2) ** 2
        return 2 * np.arcsin(np.sqrt(d))

    there = [True] * 60
    for i in range(60):
        later = [j for j in range(i + 1, 60) if there[j] and apart(i, j) < 0.002] if there[i] else []
        if later:
            there[later[0] if flux[i] > flux[later[0]] else i] = False
    assert got == {k for k in range(60) if there[k]}


def test_nearest_by_cells_is_nearest_by_array(spark):
    a, b = view(spark, SF, "fx_component"), view(spark, SF, "fx_target")
    one = {(r.comp_id, r.target_id) for r in joins.nearest(a, b).collect()}
    assert one == {(r.comp_id, r.target_id) for r in joins.nearest(a, b, array_rows=0).collect()} and len(one) == a.count()


def test_blocks_of_components_add_up(spark):
    parts, vis = view(spark, SF, "fx_target"), view(spark, SF, "fx_vis").where("chan < 2 AND time < 200")
    whole = joins.predict_components(vis, parts, 0.1, -0.5, F.lit(2.0))
    blocks = joins.predict_components(vis, parts, 0.1, -0.5, F.lit(2.0), array_rows=3)
    assert whole.count() == blocks.count() == vis.count()
    off = whole.join(blocks.withColumnsRenamed({"m_re": "b_re", "m_im": "b_im"}), visibility.KEY).agg(F.max(F.abs(F.col("m_re") - F.col("b_re"))), F.max(F.abs(F.col("m_im") - F.col("b_im")))).first()
    assert max(off) < 1e-9
    assert joins.predict_components(vis, parts.limit(0), 0.1, -0.5, F.lit(2.0)).count() == 0


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [2.0] * 50 + [7.0], list(range(999)), [float(k % 7) for k in range(400)]])
def test_median_is_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert visibility.exact_median(df, "x", bins=8).first()["median"] == np.median(values)


def test_window_gains_and_late_rows(spark, tmp_path):
    rows = view(spark, SF, "fx_stream").select(F.col("ts").cast("timestamp").alias("ts"), *(F.col(c).cast("long").alias(c) for c in ("a1", "a2")), "x_re", "x_im", "weight")
    batch = streaming.window_gains(rows, 15)
    assert batch.count() == 15 * rows.select(F.to_date("ts")).distinct().count()
    rows.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 200).parquet(str(tmp_path / "in"))
    stream = streaming.read_visibilities(spark, str(tmp_path / "in"), 1)
    q = streaming.window_gains(stream, 15).writeStream.outputMode("append").format("memory").queryName("gains").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    dropped = streaming.dropped_late(q)
    q.stop()
    closed = spark.table("gains")
    assert closed.count() and dropped >= 0
    assert closed.join(batch.select("start", "ant", F.col("g_re").alias("r")), ["start", "ant"]).where("abs(g_re - r) > 1e-9").count() == 0


def test_find_sources_sees_regions(spark):
    cells = [(0, 0, y, x, 5.0) for y, x in [(1, 1), (1, 2), (2, 3), (3, 4), (9, 9), (9, 10)]]
    image = spark.createDataFrame(cells, "chan long, pol long, y long, x long, value double")
    assert sorted(r.pixels for r in images.find_sources(image, 1.0, 1).collect()) == [2, 4]
    assert images.find_sources(image, 1.0, 3).count() == 1


def test_continuum_of_a_line_is_nothing(spark):
    vis = view(spark, SF, "fx_vis").withColumn("vis_re", 3.0 + 2.0 * F.col("chan"))
    out = visibility.remove_continuum(vis.where("weight > 0"), ["time", "a1", "a2", "pol"], F.col("chan") / 6, "vis_re", F.col("weight"))
    counts = vis.where("weight > 0").groupBy("time", "a1", "a2", "pol").count().where("count > 1")
    assert out.join(counts, ["time", "a1", "a2", "pol"]).agg(F.max(F.abs("vis_re"))).first()[0] < 1e-9


def test_empty_selection(spark):
    none = view(spark, SF, "fx_vis").where("chan > 99")
    assert visibility.integrate_channels(none).count() == 0
    assert visibility.coalesce_visibility(none, 2.0, 8, 1.0, 4).count() == 0
    assert gridding.grid_visibility_fast(none, 64, 0.002).count() == 0


def test_spheroidal_is_continuous(spark):
    row = spark.range(1).select(wi.spheroidal(F.lit(0.7499999)).alias("a"), wi.spheroidal(F.lit(0.7500001)).alias("b"), wi.spheroidal(F.lit(1.1)).alias("c")).first()
    assert abs(row.a - row.b) < 1e-4 and row.c == 0


def test_stream_closes_windows(spark, tmp_path):
    rows = view(spark, SF, "fx_stream").select(F.col("ts").cast("timestamp").alias("ts"), *(F.col(c).cast("long").alias(c) for c in ("a1", "a2")), "x_re", "x_im", "weight")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    q = streaming.window_ratios(streaming.read_visibilities(spark, str(tmp_path / "in"), 4)).writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    closed = spark.table("closed")
    batch = streaming.window_ratios(rows)
    assert 0 < closed.count() <= batch.count()
    assert closed.join(batch.select("start", "a1", "a2", F.col("weight").alias("w")), ["start", "a1", "a2"]).where("abs(weight - w) > 1e-9").count() == 0
