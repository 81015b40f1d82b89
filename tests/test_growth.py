"""Work that grew faster than the tables: crowds at one place, and pairs that were sent or sorted."""

import numpy as np
from pyspark.sql import functions as F

from skyfringe.operators import images, joins, jones, neighbours, screens, skymodel
from skyfringe.plans.queries import ALL
from skyfringe.sources.fixtures import view
from skyfringe.streaming import realtime


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_centres_at_one_place_are_one(spark):
    image = spark.range(16).selectExpr("0 AS chan", "0 AS pol", "id DIV 4 AS y", "id % 4 AS x", "1.0D AS value")
    centres = spark.range(40).selectExpr("id + 5 AS id", "(id % 2) * 3 AS cy", "(id % 2) * 3 AS cx")
    got = images.voronoi(image, centres, array_rows=4)
    # Two places of centres are one array, where forty centres were ten blocks.
    assert "CartesianProduct" not in _plan(got)
    want = {(y, x): 5 if y * y + x * x <= (y - 3) ** 2 + (x - 3) ** 2 else 6 for y in range(4) for x in range(4)}
    assert {(r.y, r.x): r.model_id for r in got.collect()} == want


def test_all_separations_come_from_many_tasks(spark):
    one = spark.range(3).selectExpr("id AS comp_id", "id * 0.1D AS ra", "-0.5D AS dec").coalesce(1)
    two = spark.range(50).selectExpr("id AS comp_id", "id * 0.01D AS ra", "id * -0.02D AS dec").coalesce(1)
    got = joins.separations(one, two)
    assert got.rdd.getNumPartitions() > 1 and got.count() == 150
    assert joins.all_pairs(two, one, "comp_id", broadcast_rows=1, task_pairs=10).count() == 150
    assert {(r.id1, r.id2): r.separation for r in got.collect()}[1, 0] == 2 * np.arcsin(np.sqrt(np.sin(0.25) ** 2 + np.cos(-0.5) * np.cos(0.0) * np.sin(0.05) ** 2))


def _array(spark):
    rng = np.random.default_rng(3)
    spots = rng.uniform(-5e3, 5e3, (6, 3))
    antennas = spark.createDataFrame([(i, *map(float, spots[i % 6])) for i in range(18)], "ant long, x double, y double, z double")
    components = spark.createDataFrame([(i, 0.1 + 0.01 * (i % 4), -0.5 + 0.02 * (i % 2)) for i in range(12)], "comp_id long, ra double, dec double")
    return antennas, components


def test_gains_are_gridded_by_position_and_direction(spark, monkeypatch):
    antennas, components = _array(spark)
    gains = spark.createDataFrame([(float(t), a, c, float(np.cos(a + t)), float(np.sin(a + t)), 1.0) for t in (0, 10) for a in range(18) for c in range(2)], "time double, ant long, chan long, g_re double, g_im double, weight double")
    frequency = 1e8 + F.col("chan") * 1e6
    met = []
    all_pairs = screens.all_pairs
    monkeypatch.setattr(screens, "all_pairs", lambda *a, **k: met.append(all_pairs(*a, **k)) or met[-1])
    got = {(r.time, r.sy, r.sx): (r.value, r.weight) for r in screens.grid_gains_through(antennas, components, gains, frequency, 3e5, 0.1, -0.5, 4e3, 64).collect()}
    assert met[0].count() == 6 * 4
    want = {(r.time, r.sy, r.sx): (r.value, r.weight) for r in screens.grid_gains(screens.pierce_points(antennas, components, 3e5, 0.1, -0.5), gains, frequency, 4e3, 64).collect()}
    assert got.keys() == want.keys() and len(got) > 2
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in got)


def test_pierce_points_are_neither_sent_nor_sorted(spark):
    antennas, components = _array(spark)
    points = screens.pierce_points(antennas.coalesce(1), components.coalesce(1), 3e5, 0.1, -0.5)
    plan = _plan(points)
    assert "Window" not in plan and "Sort" not in plan
    assert points.rdd.getNumPartitions() > 1
    mean = points.groupBy("comp_id").agg(F.avg("px").alias("x")).collect()
    at = {r.comp_id: r.l for r in components.selectExpr("comp_id", "3e5 * cos(dec) * sin(ra - 0.1) AS l").collect()}
    assert len(mean) == 12 and all(abs(r.x - at[r.comp_id]) < 1e-6 for r in mean)


def test_a_screen_is_sampled_where_points_are(spark):
    antennas, components = _array(spark)
    points = screens.pierce_points(antennas, components, 3e5, 0.1, -0.5)
    screen = spark.range(4).selectExpr("32 + id DIV 2 AS y", "32 + id % 2 AS x", "0.001D * (id + 1) AS value")
    got = screens.sample_screen(points, screen, 1e8, 4e3, 64)
    plan = _plan(got)
    assert "SortMergeJoin" not in plan
    value = {(r.y, r.x): r.value for r in screen.collect()}
    phase = {(r.comp_id, r.ant): value.get((r.py // 4e3 + 32, r.px // 4e3 + 32), 0.0) * screens.TEC_TO_PHASE / 1e8 for r in points.collect()}
    assert any(phase.values()) and not all(phase.values())
    rows = got.collect()
    assert len(rows) == len(phase) and all(abs(r.g_re - np.cos(phase[r.comp_id, r.ant])) + abs(r.g_im - np.sin(phase[r.comp_id, r.ant])) < 1e-9 for r in rows)


def _crowd(spark, n, step, off=0.0):
    return spark.range(n).selectExpr("id + 7 AS comp_id", f"(id % 3) * {step}D + {off}D AS ra", "-0.5D AS dec")


def test_the_nearest_of_a_crowd_is_found_by_place(spark, monkeypatch):
    asked = []
    nearest_places = joins.nearest_places
    monkeypatch.setattr(joins, "nearest_places", lambda c, t, n: asked.append((c.count(), t.count())) or nearest_places(c, t, n))
    got = joins.nearest(_crowd(spark, 300, 0.2), _crowd(spark, 90, 0.2, 0.01)).collect()
    assert asked == [(3, 3)]
    assert {(r.comp_id, r.target_id) for r in got} == {(i + 7, i % 3 + 7) for i in range(300)}


def test_crowds_at_one_place_match_once(spark, monkeypatch):
    met = []
    near_pairs = joins.near_pairs
    monkeypatch.setattr(joins, "near_pairs", lambda *a: met.append(near_pairs(*a)) or met[-1])
    got = joins.matches(_crowd(spark, 300, 0.2), _crowd(spark, 90, 0.2, 0.001), 0.01).collect()
    assert met[0].count() == 3
    assert {(r.id1, r.id2) for r in got} == {(i + 7, i % 3 + 7) for i in range(300)}


def test_baselines_come_from_many_tasks(spark):
    antennas = spark.range(40).selectExpr("id AS ant", "id * 2.0D AS x", "0.0D AS y", "1.0D AS z").coalesce(1)
    got = joins.baselines(antennas)
    assert got.rdd.getNumPartitions() > 1
    assert {(r.a1, r.a2, r.dx) for r in got.collect()} == {(i, j, 2.0 * (j - i)) for i in range(40) for j in range(i + 1, 40)}


def test_weights_of_a_crowd_are_worked_out_once(spark):
    image = spark.range(64).selectExpr("0 AS chan", "0 AS pol", "id DIV 8 AS y", "id % 8 AS x", "0.0D AS value")
    crowd = spark.range(50).selectExpr("0 AS chan", "0 AS pol", "0.0013D AS l", "-0.0021D AS m", "1.0D AS flux")
    got = images.insert_components(image, crowd, 8, 0.005, method="lanczos", reach=2)
    assert "size(transform" not in _plan(got)
    one = images.insert_components(image, crowd.limit(1).withColumn("flux", F.lit(50.0)), 8, 0.005, method="lanczos", reach=2)
    value = lambda df: {(r.y, r.x): r.value for r in df.collect()}
    a, b = value(got), value(one)
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a) and abs(sum(a.values()) - 50) < 1e-9


def _rows_read(spark, name, table):
    """(rows of the view that a query reads in all its jobs, rows of the view)."""
    sf = "/root/testdata/sf0.001"
    rows = view(spark, sf, table).cache()
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    counted = rows.mapInPandas(count, rows.schema)
    ALL[name].plan(lambda n: counted if n == table else view(spark, sf, n)).write.format("noop").mode("overwrite").save()
    n = rows.count()
    rows.unpersist()
    return read.value, n


def test_terms_are_calibrated_on_one_reading(spark):
    read, rows = _rows_read(spark, "c07_calibrate_by_terms", "fx_model")
    assert read == rows > 0


def test_channels_are_calibrated_together_on_one_reading(spark):
    read, rows = _rows_read(spark, "c08_calibrate_together", "fx_model")
    assert read == rows > 0


def test_only_gains_of_antennas_seen_are_made_matrices(spark, monkeypatch):
    made = []
    as_matrices = jones.as_matrices
    monkeypatch.setattr(jones, "as_matrices", lambda g: made.append(g) or as_matrices(g))
    read, rows = _rows_read(spark, "j04_sequence_of_terms", "fx_vis")
    assert read == rows > 0
    assert made[0].select("ant").distinct().count() <= 15 < view(spark, "/root/testdata/sf0.001", "fx_antenna").count()


def test_visibilities_are_restored_on_one_reading(spark):
    read, rows = _rows_read(spark, "i17_restore_fitted", "fx_vis")
    assert read == rows > 0


def test_visibilities_are_self_calibrated_on_one_reading(spark):
    read, rows = _rows_read(spark, "q07_imaging_cycle", "fx_vis")
    assert read == rows > 0


def test_gains_of_a_table_for_any_number_of_components(spark, monkeypatch):
    rng = np.random.default_rng(2)
    key = [(float(t), i, j, 0, p) for t in range(3) for i in range(4) for j in range(i + 1, 4) for p in (0, 3)]
    rows = [(*k, *map(float, rng.uniform(-20, 20, 3)), float(rng.uniform(1, 2)), float(rng.uniform(-1, 1)), 1.0) for k in key]
    table = spark.createDataFrame(rows, "time double, a1 long, a2 long, chan long, pol long, u double, v double, w double, vis_re double, vis_im double, weight double").withColumn("ts", F.timestamp_seconds("time"))
    few = spark.createDataFrame([(1, 0.01, 0.0, 0.0, 10_001.0), (2, 0.0, 0.02, 0.0, 10_000.0)], "comp_id long, l double, m double, n double, flux double")
    many = spark.range(1, 20_002).selectExpr("id AS comp_id", "0.01D * (id % 2) AS l", "0.02D * ((id + 1) % 2) AS m", "0.0D AS n", "1.0D AS flux")
    gains = lambda c: {(r.start, r.feed, r.ant): complex(r.g_re, r.g_im) for r in realtime.table_gains(table, c, 4, width="2 seconds").collect()}
    want = gains(few)
    assert len(want) == 2 * 2 * 4
    same = lambda got: got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert same(gains(many))
    monkeypatch.setattr(realtime, "ARRAY_ROWS", 1)
    assert same(gains(few))


def test_visibilities_are_imaged_on_one_reading(spark):
    read, rows = _rows_read(spark, "q06_continuum_imaging", "fx_vis")
    assert read == rows > 0


def test_visibilities_are_imaged_by_channel_on_one_reading(spark):
    read, rows = _rows_read(spark, "q08_spectral_line", "fx_vis")
    assert read == rows > 0


def _thinned(rows, distance):
    """Ids that stay, one decision after the other."""
    apart = lambda a, b: 2 * np.arcsin(np.sqrt(np.sin((b[2] - a[2]) / 2) ** 2 + np.cos(a[2]) * np.cos(b[2]) * np.sin((b[1] - a[1]) / 2) ** 2))
    there = dict.fromkeys((r[0] for r in rows), True)
    for n, a in enumerate(rows):
        b = next((b for b in rows[n + 1 :] if there[a[0]] and there[b[0]] and apart(a, b) < distance), None)
        if b is not None:
            brighter = a[3] is not None and b[3] is not None and (a[3] > b[3] or (a[3] != a[3] and b[3] == b[3]))
            there[(b if brighter else a)[0]] = False
    return {k for k, v in there.items() if v}


COMPONENTS = "comp_id long, ra double, dec double, flux0 double"


def test_a_crowd_takes_few_rounds(spark, monkeypatch):
    written = []
    for module in (neighbours, skymodel):
        materialize = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, write=materialize: written.append(1) or write(df))
    rng = np.random.default_rng(3)
    rows = [(k, 0.1, -0.5 + 1e-4 * (k % 3), float(f)) for k, f in enumerate(rng.integers(1, 9, 400))]
    got = {r.comp_id for r in skymodel.remove_neighbours(spark.createDataFrame(rows, COMPONENTS), 0.003, "flux0").collect()}
    assert got == _thinned(rows, 0.003) and len(written) < 12


def test_neighbours_in_stretches_and_tiles(spark):
    """Over many tiles and stretches of the list decisions are those of the whole list, with equal, null and NaN fluxes and fluxes that fall."""
    rng = np.random.default_rng(4)
    sky = rng.uniform(-0.02, 0.02, (300, 2))
    odd = {5: None, 60: float("nan"), 61: None, 200: float("nan")}
    for flux in (lambda k: float(rng.integers(1, 6)), lambda k: float(-k // 4)):
        rows = [(3 * k, float(a), float(b), odd.get(k, flux(k))) for k, (a, b) in enumerate(sky)]
        df = spark.createDataFrame([*rows, (None, 0.0, 0.0, 1.0), (2, None, 0.0, 1.0), (4, float("nan"), 0.0, 1.0)], COMPONENTS)
        lost = {r.comp_id for r in neighbours.lost_neighbours(df, 0.004, "flux0", rows=60, tile=4.0).collect()}
        assert {r[0] for r in rows} - lost == _thinned(rows, 0.004) and not lost & {2, 4, None}


def _numbers_met(df) -> float:
    """How many numbers the dictionaries of a file's columns hold for 4,096 rows, in the order in which they are written."""
    rows = df.collect()
    return float(np.median([sum(len({r[c] for r in rows[k : k + 4096]}) for c in range(len(df.columns))) for k in range(0, len(rows) - 4095, 4096)]))


def _repeated_array(spark, positions, directions):
    """Six antennas at each position, and five components in each direction, with ids far apart."""
    antennas = spark.range(6 * positions).selectExpr(f"(id % {positions}) + 1000 * (id DIV {positions}) AS ant", f"CAST(abs(xxhash64(id % {positions})) % 1000000 AS DOUBLE) / 100 AS x", f"40.0D * (id % {positions} % 25) AS y", "10.0D AS z")
    components = spark.range(5 * directions).selectExpr(f"(id % {directions}) + 1000 * (id DIV {directions}) AS comp_id", f"0.1D + 0.001D * (id * 7 % {directions}) AS ra", f"-0.5D + 0.002D * (id % {directions}) AS dec")
    return antennas, components


def test_baselines_are_written_in_tiles(spark):
    antennas, _ = _repeated_array(spark, 100, 1)
    assert _numbers_met(joins.baselines(antennas)) < 600


def test_tiles_hold_every_pair(spark):
    """Odd sizes, one side empty, positions that are null or not a number, many others than are broadcast."""
    rows = spark.createDataFrame([(i, None if i == 3 else float("nan") if i == 4 else float(i % 5)) for i in range(23)], "a long, x double")
    others = spark.createDataFrame([(i, float(i % 3)) for i in range(17)], "b long, y double")
    want = {(i, j) for i in range(23) for j in range(17)}
    for more in ({"tile": 4}, {"tile": 64}, {"tile": 4, "broadcast_rows": 5, "task_pairs": 10}):
        got = [(r.a, r.b) for r in joins.tiled_pairs(rows, others, ["x", "a"], ["y", "b"], **more).collect()]
        assert len(got) == len(want) and set(got) == want
        less = [(r.a, r.b) for r in joins.tiled_pairs(rows, others, ["x", "a"], ["y", "b"], F.col("b") > F.col("a"), **more).collect()]
        assert sorted(less) == sorted((i, j) for i, j in want if j > i)
    assert joins.tiled_pairs(rows, others.where("b < 0"), ["x", "a"], ["y", "b"]).count() == 0
    assert joins.tiled_pairs(rows.where("a < 0"), others, ["x", "a"], ["y", "b"]).count() == 0


def test_pierce_points_are_written_in_tiles(spark):
    antennas, components = _repeated_array(spark, 50, 200)
    assert _numbers_met(screens.pierce_points(antennas, components, 3e5, 0.1, -0.5)) < 600


def test_sampled_gains_are_written_in_tiles(spark):
    antennas, components = _repeated_array(spark, 50, 200)
    screen = spark.range(4096).selectExpr("id DIV 64 AS y", "id % 64 AS x", "0.001D * (id + 1) AS value")
    points = screens.pierce_points(antennas, components, 3e5, 0.1, -0.5)
    assert _numbers_met(screens.sample_screen(points, screen, 1e8, 4e3, 64)) < 400


def test_separations_are_written_in_tiles(spark):
    _, components = _repeated_array(spark, 1, 200)
    assert _numbers_met(joins.separations(components.where("comp_id % 3 > 0"), components)) < 600


def test_a_wide_beam_stays_within_the_image(spark, monkeypatch):
    """A fitted beam may be far wider than the image: neither its kernel nor what it makes is wider."""
    rng = np.random.default_rng(5)
    plane = rng.uniform(0, 1, (5, 8))
    image = spark.createDataFrame([(0, 0, y + 3, x - 2, float(plane[y, x])) for y in range(5) for x in range(8)], "chan long, pol long, y long, x long, value double")
    kernels, explode = [], F.explode
    monkeypatch.setattr(images.F, "explode", lambda c: kernels.append(c) or explode(c))
    for width in (4.25, 30.0, 1e9):
        got = {(r.y - 3, r.x + 2): r.value for r in images.smooth(image, width).collect()}
        ky, kx = (np.exp(-((np.arange(n)[:, None] - np.arange(n)) ** 2) / (2 * width * width)) for n in plane.shape)
        want = ky @ plane @ kx
        assert len(got) == 40 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert [spark.range(1).select(F.size(k)).first()[0] for k in kernels] == 3 * [15, 9]
    assert images.smooth(image.where("y < 0"), 30.0).count() == 0
