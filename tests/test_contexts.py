"""Imaging contexts: facets, slices and both together, against direct sums; restored and reprojected images."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_interferometry import direct, plane, sky_samples

from skyfringe.operators import images, imaging, visibility


def predicted(spark, vis, sources, n, cell, **how):
    image = spark.createDataFrame([(0, 0, n // 2 + round(m / cell), n // 2 + round(l / cell), f) for f, l, m in sources], "chan long, pol long, y long, x long, value double")
    got = imaging.predict_list(vis, image, n, cell, **how).join(vis, visibility.KEY).toPandas()
    assert len(got) == vis.count()
    return np.hypot(got["m_re"] - got["vis_re"], got["m_im"] - got["vis_im"]).max()


def test_facets_predict_and_invert_with_w(spark):
    n, cell = 32, 0.01
    sources = [(2.0, 10 * cell, -9 * cell), (1.0, -7 * cell, 5 * cell)]
    vis = sky_samples(spark, sources, w=2.0, reach=12.0)
    flat = predicted(spark, vis, sources, n, cell)
    faceted = predicted(spark, vis, sources, n, cell, facets=2)
    both = predicted(spark, vis, sources, n, cell, facets=2, context="wstack", width=2.0)
    assert both < faceted < flat and both < 0.2
    want = direct(vis, n, cell)
    off = lambda **how: np.abs(plane(imaging.invert_list(vis, n, cell, **how), n) - want).max() / want.max()
    assert off(facets=2, context="wstack", width=2.0) < off(facets=2) < off() and off(facets=2, context="wstack", width=2.0) < 0.04


def test_time_slices_predict_a_plane_of_w(spark):
    n, cell, l, m = 64, 0.01, 0.16, -0.1  # noqa: E741
    vis = sky_samples(spark, [(2.0, l, m)], reach=12.0).withColumn("w", 0.9 * F.col("u") - 0.5 * F.col("v"))
    turns = F.col("u") * l + F.col("v") * m + F.col("w") * float(np.sqrt(1 - l * l - m * m) - 1)
    vis = vis.withColumns({"vis_re": 2 * F.cos(2 * np.pi * turns), "vis_im": -2 * F.sin(2 * np.pi * turns)})
    assert predicted(spark, vis, [(2.0, l, m)], n, cell, context="timeslice", width=1.0) < 0.5 * predicted(spark, vis, [(2.0, l, m)], n, cell)


def test_w_projection_and_unknown_contexts(spark):
    n, cell = 32, 0.01
    sources = [(2.0, 5 * cell, -4 * cell)]
    vis = sky_samples(spark, sources, w=1.0, reach=12.0)
    assert predicted(spark, vis, sources, n, cell, context="wprojection", width=0.5, oversampling=16) < 0.06
    for bad in ({"context": "none"}, {"context": "timeslice", "facets": 2, "width": 1.0}):
        with pytest.raises(ValueError):
            imaging.predict_list(vis, vis, n, cell, **bad)
        with pytest.raises(ValueError):
            imaging.invert_list(vis, n, cell, **bad)


def gaussian(n, sy, sx, peak=1.0):
    y, x = np.mgrid[0:n, 0:n] - n // 2
    return peak * np.exp(-(y * y / (2 * sy * sy) + x * x / (2 * sx * sx)))


def as_rows(spark, a, chan=0):
    y, x = np.indices(a.shape)
    return spark.createDataFrame(pd.DataFrame({"chan": chan, "pol": 0, "y": y.ravel(), "x": x.ravel(), "value": a.ravel()}))


def test_beam_is_fitted_from_the_psf(spark):
    psf = as_rows(spark, gaussian(32, 2.0, 1.5))
    assert abs(images.fitted_width(psf, 32) - 2.0) < 1e-6
    rng = np.random.default_rng(1)
    assert abs(images.fitted_width(as_rows(spark, gaussian(32, 2.0, 1.5) + 0.01 * rng.normal(size=(32, 32))), 32) - 2.0) < 0.1
    assert images.fitted_width(as_rows(spark, np.zeros((32, 32))), 32) == 1.0
    assert images.fitted_width(psf.limit(0), 32) == 1.0
    model = np.zeros((32, 32))
    model[10, 12] = 3.0
    rest = as_rows(spark, np.full((32, 32), 0.5))
    a, b = plane(images.restore(as_rows(spark, model), rest, 2.0), 32), plane(images.restore(as_rows(spark, model), rest, psf=psf, npixel=32), 32)
    assert np.allclose(a, b, atol=1e-3) and abs(a[10, 12] - 3.5) < 1e-9
    assert abs(plane(images.restore(as_rows(spark, model), width=2.0), 32)[10, 12] - 3.0) < 1e-9
    with pytest.raises(ValueError):
        images.restore(as_rows(spark, model), rest)


def test_reprojection_there_and_back(spark):
    n, cell = 48, 0.002
    y, x = np.mgrid[0:n, 0:n]
    sky = np.sin(y / 5.0) + np.cos(x / 6.0) + 0.02 * y
    here, there = (0.3, -0.4), (0.31, -0.392)
    options = {"npixel": n, "cellsize": cell}
    out = images.reproject(as_rows(spark, sky), n, cell, here, to_npixel=64, to_cellsize=0.0018, to_centre=there)
    assert out.where("abs(footprint - 1) > 1e-9").count() == 0
    back = images.reproject(out.drop("footprint"), 64, 0.0018, there, to_npixel=n, to_cellsize=cell, to_centre=here).toPandas()
    seen = back[(back["footprint"] - 1).abs() < 1e-9]
    assert len(seen) > 0.6 * n * n and np.abs(seen["value"] - sky[seen["y"], seen["x"]]).max() < 0.01
    same = images.reproject(as_rows(spark, sky), to_npixel=n, to_cellsize=cell, centre=here, to_centre=here, **options).toPandas()
    assert len(same) > 0.95 * n * n and np.abs(same["value"] - sky[same["y"], same["x"]]).max() < 1e-6


def test_structure_function_against_loops(spark):
    n = 8
    rng = np.random.default_rng(2)
    screens = rng.normal(size=(3, n, n))
    t, y, x = np.indices(screens.shape)
    rows = spark.createDataFrame(pd.DataFrame({"chan": 0, "time": t.ravel(), "y": y.ravel(), "x": x.ravel(), "value": screens.ravel()}))
    got = {(r.dy, r.dx): r.value for r in images.structure_function(rows, n, ["chan"]).collect()}
    a = {}
    for dy in range(-n // 4, n // 4):
        for dx in range(-n // 4, n // 4):
            a[dy, dx] = sum(s[p, q] * s[p + dy, q + dx] for s in screens for p in range(n) for q in range(n) if 0 <= p + dy < n and 0 <= q + dx < n)
    assert set(got) == set(a) and all(abs(got[k] - (1 - a[k] / a[0, 0])) < 1e-9 for k in a)


def test_sources_are_smoothed_and_have_spectra(spark):
    n = 32
    cube = [gaussian(n, 1.5, 1.5, 5.0 + c) + np.roll(gaussian(n, 1.5, 1.5, 3.0), (9, 9), (0, 1)) for c in range(3)]
    cube[0][2, 2] = 40.0  # one pixel of one channel
    image = cube_rows = as_rows(spark, cube[0], 0)
    for c in (1, 2):
        image = image.unionByName(as_rows(spark, cube[c], c))
    rough = images.find_sources(image, 1.0, 1).count()
    found = images.find_sources(image, 1.0, 8, width=1.0).orderBy("flux").toPandas()
    assert rough == 3 and len(found) == 2
    assert np.allclose(found[["y", "x"]], [[25, 25], [16, 16]], atol=0.01)
    spectra = images.source_spectra(image, 1.0, 8, width=1.0).toPandas()
    for k, want in zip(found["source_id"], ([3, 3, 3], [5, 6, 7]), strict=True):
        assert np.allclose(spectra[spectra["source_id"] == k].sort_values("chan")["flux"], want, atol=0.01)
    assert images.find_sources(cube_rows.limit(0), 1.0, 1).count() == 0
