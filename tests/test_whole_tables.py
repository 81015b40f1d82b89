"""Queries over whole tables: every product, channel, antenna and target takes part."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from skyfringe.plans.imaging import self_calibrate
from skyfringe.plans.queries import ORACLE_SQL, QUERIES
from skyfringe.sources.fixtures import TABLES, view

SF = "/root/testdata/sf0.001"
LISTED = [
    "f05_limit_radius", "f09_listed_components", "j06_matches", "j07_separations", "j08_nearest_target", "j11_baselines", "j12_predict_components", "x01_xyz_at_latitude", "x02_xyz_to_uvw",
    "a07_gain_quality", "c12_station_correlations", "m06_update_from_gains", "m08_predict_models", "i20_pierce_points", "i18_grid_gains_to_screen", "i20_sample_screen", "g17_direct_image",
    "c02_point_ratios",
]


@pytest.mark.parametrize("name", ["g05_grid_kernel", "g07_degrid", "g13_invert", "d02_hogbom"])
def test_imaging_has_every_plane(spark, name):
    got = {tuple(r) for r in QUERIES[name](spark, SF).select("chan", "pol").distinct().collect()}
    assert got == {(c, p) for c in range(7) for p in range(4)}


@pytest.mark.parametrize("name", LISTED)
def test_whole_tables_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    order = [c for c in columns if "int" in str(a[c].dtype)] or columns
    a, b = (x[columns].sort_values(order).reset_index(drop=True) for x in (a, b))
    assert len(a)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6, rtol=1e-9)


def test_views_hold_whole_tables(spark):
    for name, table in (("fx_antenna", "customer"), ("fx_target", "supplier")):
        assert view(spark, SF, name).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("cross", [True, False])
def test_each_feed_has_its_own_gains(spark, cross):
    feeds = [(0, 0), (0, 1), (1, 0), (1, 1)] if cross else [(0, 0), (1, 1)]
    rng = np.random.default_rng(5)
    g = rng.uniform(0.8, 1.3, (2, 6)) * np.exp(1j * rng.uniform(-1, 1, (2, 6)))
    g[:, 0] = np.abs(g[:, 0])
    key = [(float(t), i, j, c, p) for t in (5, 10) for i in range(6) for j in range(i + 1, 6) for c in range(2) for p in range(len(feeds))]
    model = {k: complex(10 + k[3], 0) if len(set(feeds[k[4]])) == 1 else complex(2, k[4]) for k in key}
    seen = {k: model[k] * g[feeds[k[4]][0], k[1]] * np.conj(g[feeds[k[4]][1], k[2]]) for k in key}
    names = "time double, a1 long, a2 long, chan long, pol long, "
    vis = spark.createDataFrame([(*k, float(v.real), float(v.imag), 1.0) for k, v in seen.items()], names + "vis_re double, vis_im double, weight double")
    mod = spark.createDataFrame([(*k, v.real, v.imag) for k, v in model.items()], names + "m_re double, m_im double")
    gains, fixed = self_calibrate(vis, mod, 6, 20.0, cross=cross)
    got = {(r.feed, r.ant): complex(r.g_re, r.g_im) for r in gains.where("chan = 1").collect()}
    assert len(got) == 12 and all(abs(got[f, a] - g[f, a]) < 1e-6 for f, a in got)
    right = {(r.time, r.a1, r.a2, r.chan, r.pol): complex(r.vis_re, r.vis_im) for r in fixed.collect()}
    assert len(right) == len(model) and all(abs(right[k] - model[k]) < 1e-5 for k in model)


@pytest.mark.parametrize("name", ["c03_solve_gains", "c04_gain_residual"])
def test_solutions_for_every_channel(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert set(got["chan"]) == set(range(7))
    if name == "c03_solve_gains":
        assert set(got["feed"]) == {0, 1}
