"""Kernels in tasks: w projection against direct sums, degridding by tiles, boxes of kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_interferometry import VIS, direct, plane, sky_samples

from skyfringe.operators import gridding, imaging, kernels, visibility


def test_w_projection_is_the_direct_sum_with_w(spark):
    n, cell = 64, 0.0075
    vis = sky_samples(spark, [(2.0, 0.12, -0.075), (1.0, -0.06, 0.09)], w=1.5, reach=12.0)
    want, flat = direct(vis, n, cell), plane(imaging.invert(vis, n, cell, padding=2), n)
    inner = np.s_[4:-4, 4:-4]
    got = plane(imaging.aw_invert(vis, n, cell, 0.2, support=13, oversampling=16), n)
    assert np.abs(got - want)[inner].max() < 5e-3 * want.max() < 0.1 * np.abs(flat - want)[inner].max()


def test_w_projection_predicts_every_row(spark):
    n, cell = 64, 0.0075
    places = [(2.0, 16, -10), (1.0, -8, 12)]
    vis = sky_samples(spark, [(f, x * cell, y * cell) for f, x, y in places], w=1.5, reach=12.0)
    far = spark.createDataFrame([(1.0, 0, 999, 0, 0, 1e4, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0), (1.0, 0, 998, 5, 0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)], VIS)
    image = spark.createDataFrame([(0, 0, n // 2 + y, n // 2 + x, f) for f, x, y in places], "chan long, pol long, y long, x long, value double")
    got = imaging.aw_predict(vis.unionByName(far), image, n, cell, 0.2, support=13, oversampling=16).join(vis.unionByName(far), visibility.KEY).toPandas()
    assert len(got) == 402
    # Half a sub-cell on each axis and half a w step are what a sample's phase can be off.
    bound = sum(f * np.pi * ((abs(x) + abs(y)) * cell / (2 * n * cell) / 16 + 0.2 * (1 - np.sqrt(1 - (x * x + y * y) * cell * cell))) for f, x, y in places)
    assert np.hypot(got["m_re"] - got["vis_re"], got["m_im"] - got["vis_im"]).max() < 1.1 * bound
    lost = got[got["a2"] >= 998]
    assert len(lost) == 2 and not lost[["m_re", "m_im"]].any(axis=None)


def test_beam_in_the_kernel_weighs_the_image(spark):
    half_beam = lambda x, y: np.exp(-(x * x + y * y) / 0.02)  # noqa: E731  sent to tasks by value
    n, cell = 64, 0.01
    vis = sky_samples(spark, [(2.0, 0.06, -0.04)], w=1.0, reach=12.0)
    at = (np.arange(n) - n // 2) * cell
    x, y = np.meshgrid(at, at)
    got = plane(imaging.aw_invert(vis, n, cell, 0.1, oversampling=16, support=10, beam=half_beam), n)
    want = direct(vis, n, cell) * half_beam(x, y)
    assert np.abs(got - want)[4:-4, 4:-4].max() < 0.01 * want.max()


def test_psf_of_w_projection_peaks_at_the_centre(spark):
    vis = sky_samples(spark, [(2.0, 0.06, -0.04)], w=1.0, reach=12.0)
    got = plane(imaging.aw_invert(vis, 32, 0.01, 0.2, psf=True), 32)
    assert np.unravel_index(got.argmax(), got.shape) == (16, 16) and abs(got[16, 16] - 1) < 0.02


@pytest.mark.parametrize("most", [200_000, 7])
def test_degridding_by_tiles_is_the_sum_under_the_kernel(spark, most):
    n, cell, support, over = 64, 0.01, 2, 4
    vis = sky_samples(spark, [(1.0, 0.0, 0.0)], n=120, reach=45.0).unionByName(sky_samples(spark, [(1.0, 0.0, 0.0)], n=40, reach=2.0, seed=5).withColumn("a1", F.lit(1)))
    rng = np.random.default_rng(0)
    grid = np.where(rng.random((n, n)) < 0.7, rng.normal(size=(n, n)) + 1j * rng.normal(size=(n, n)), 0)
    rows = spark.createDataFrame([(0, 0, int(y), int(x), float(grid[y, x].real), float(grid[y, x].imag)) for y, x in np.argwhere(grid)], "chan long, pol long, gv long, gu long, re double, im double")
    got = kernels.degrid_with(vis, rows, kernels.Kernel(support, over), n, cell, tile=8, most=most).join(vis.select(*visibility.KEY, "u", "v"), visibility.KEY).toPandas()
    k = kernels.axis_kernel(support, over)
    assert len(got) == 160
    for r in got.itertuples():
        at = [c * n * cell + n // 2 for c in (r.v, r.u)]
        near = [int(np.floor(a + 0.5)) for a in at]
        want = 0j
        if all(0 <= c < n for c in near):
            sub = [min(over - 1, int((a - c + 0.5) * over)) for a, c in zip(at, near, strict=True)]
            for i in range(-support, support + 1):
                for j in range(-support, support + 1):
                    y, x = near[0] + i, near[1] + j
                    if 0 <= y < n and 0 <= x < n:
                        want += grid[y, x] * k[sub[0], i + support] * k[sub[1], j + support]
        assert abs(complex(r.vis_re, r.vis_im) - want) < 1e-9


def test_gridding_in_tasks_is_gridding_by_joins(spark):
    n, cell = 32, 0.01
    vis = sky_samples(spark, [(3.0, 0.02, -0.01)], n=200, reach=30.0)
    a = kernels.grid_with(vis, kernels.Kernel(3, 8), n, cell).where("re <> 0 OR im <> 0")
    b = gridding.grid_visibility(vis, gridding.spheroidal_kernel(spark, 3, 8), n, cell, 8).where("re <> 0 OR im <> 0")
    x, y = (d.orderBy("gv", "gu").toPandas() for d in (a, b))
    assert len(x) == len(y) and np.allclose(x[["re", "im"]], y[["re", "im"]]) and (x[["gv", "gu"]] == y[["gv", "gu"]]).all(axis=None)
    box = kernels.grid_with(vis, kernels.BoxKernel(), n, cell).orderBy("gv", "gu").toPandas()
    fast = gridding.grid_visibility_fast(vis, n, cell).orderBy("gv", "gu").toPandas()
    assert np.allclose(box[["re", "im", "weight"]], fast[["re", "im", "weight"]])


def test_kernel_boxes():
    k = kernels.AWKernel(support=10, oversampling=2, field=0.6, step=5.0, samples=168)
    box = kernels.bounding_box(k, 1, 0.01)
    size = np.max([np.abs(k.make(p)).max((0, 1)) for p in (-1, 0, 1)], axis=0)
    outside = np.abs(np.indices(size.shape) - 10).max(0) > box
    assert 0 < box < 10 and size[outside].max() <= 0.01 * size.max() < size[~outside].max()
    assert kernels.bounding_box(k, 0, 0.01) < box
    for plane_, (v0, v1), (u0, u1) in kernels.plane_boxes(k, 1, 0.01):
        seen = np.argwhere(np.abs(k.make(plane_)).max((0, 1)) > 0.01 * size.max()) - 10
        assert ((v0, u0), (v1, u1)) == (tuple(seen.min(0)), tuple(seen.max(0)))
