"""CLEAN with moments of frequency, and facets with one threshold: known spectra, plain loops and odd planes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyfringe.operators import clean

N, CHANS = 32, 7
FREQ = 1e8 + np.arange(CHANS) * 4e6


def beam(n=2 * N, seed=4):
    y, x = np.mgrid[0:n, 0:n] - n // 2
    rng = np.random.default_rng(seed)
    p = 0.03 * rng.normal(size=(n, n))
    p = (p + p[::-1, ::-1]) / 2 + np.exp(-(y * y + x * x) / 3.0)
    p[n // 2, n // 2] = 1.0
    return p


def convolve(sky, psf):
    out = np.zeros_like(sky)
    c = psf.shape[0] // 2
    for y, x in np.argwhere(sky):
        out += sky[y, x] * psf[c - y : c - y + sky.shape[0], c - x : c - x + sky.shape[1]]
    return out


def table(spark, cube, n=None, name="value"):
    """(chan, pol, y, x, value) of chan x y x x arrays."""
    c, y, x = np.indices(cube.shape)
    return spark.createDataFrame(pd.DataFrame({"chan": c.ravel(), "pol": 0, "y": y.ravel(), "x": x.ravel(), name: cube.ravel()}))


def cube_of(df, column, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.chan, r.y, r.x] = r[column]
    return out


def spectra(kind):
    d = (FREQ - FREQ.mean()) / FREQ.mean()
    return [{"flat": 1 + 0 * d, "linear": 1 + 3 * d, "quadratic": 1 - 2 * d + 40 * d * d}[kind] * f for f in (5.0, -3.0)]


@pytest.mark.parametrize(("kind", "n", "find"), [("linear", 2, "product"), ("quadratic", 3, "product"), ("quadratic", 3, "chi2"), ("linear", 2, "zeroth"), ("flat", 1, "product")])
def test_spectra_come_back(spark, kind, n, find):
    psf = beam(N)
    sky = np.zeros((CHANS, N, N))
    for (y, x), s in zip(((12, 17), (20, 9)), spectra(kind), strict=True):
        sky[:, y, x] = s
    wide = beam(2 * N)
    psf = wide[N // 2 : N // 2 + N, N // 2 : N // 2 + N]
    dirty = np.stack([convolve(s, wide) for s in sky])
    channels = spark.createDataFrame([(k, float(f)) for k, f in enumerate(FREQ)], "chan long, frequency double")
    got = clean.clean_moment_facets(
        table(spark, dirty), table(spark, np.stack([psf] * CHANS)), N, F.lit(1e8) + F.col("chan") * 4e6, float(FREQ.mean()), channels, n=n, scales=(0.0,), find=find, gain=0.3, fraction=0.002, most=400
    )
    model = cube_of(got, "model", sky.shape)
    for (y, x), s in zip(((12, 17), (20, 9)), spectra(kind), strict=True):
        assert np.abs(model[:, y - 1 : y + 2, x - 1 : x + 2].sum((1, 2)) - s).max() < 0.06 * np.abs(s).max()
    assert np.abs(cube_of(got, "residual", sky.shape)[:, 4:-4, 4:-4]).max() < 0.3


def test_moment_clean_against_a_plain_loop():
    """Every place of every scale computed anew at each step, by convolutions summed term by term."""
    rng = np.random.default_rng(7)
    n, size, scales = 2, 12, (0.0, 3.0)
    wide = beam(2 * size, 1)
    x = np.array([-0.2, 0.1, 0.3])
    psf = np.stack([(x**k).sum() * wide for k in range(2 * n)])
    dirty = rng.normal(size=(n, size, size))
    options = {"gain": 0.4, "threshold": 0.0, "fraction": 0.05, "most": 12}
    model, left = clean.clean_moments(dirty, psf, None, scales=scales, **options)
    blobs = [clean.scale_blob(s) for s in scales]
    top = psf.max()
    res = [dirty / top for _ in (0,)][0].copy()
    want = np.zeros_like(dirty)
    stop = 0.05 * np.abs(res[0]).max()
    response = [[np.stack([clean._convolved(clean._convolved(p / top, a), b) for p in psf]) for b in blobs] for a in blobs]
    smooth = [np.stack([clean._convolved(r, b) for r in res]) for b in blobs]
    for _ in range(options["most"]):
        best = None
        for k in range(len(scales)):
            h = np.array([[response[k][k][t + q][size, size] for q in range(n)] for t in range(n)])
            for y in range(size):
                for z in range(size):
                    a = np.linalg.solve(h, smooth[k][:, y, z])
                    if best is None or abs(a[0] * smooth[k][0, y, z]) > best[0] + 1e-12:
                        best = (abs(a[0] * smooth[k][0, y, z]), k, y, z, a)
        _, k, y, z, a = best
        if np.abs(a).max() < stop:
            break
        half = blobs[k].shape[0] // 2
        for t in range(n):
            for v in range(-half, half + 1):
                for u in range(-half, half + 1):
                    if 0 <= y + v < size and 0 <= z + u < size:
                        want[t, y + v, z + u] += 0.4 * a[t] * blobs[k][v + half, u + half]
        for j in range(len(scales)):
            for t in range(n):
                for q in range(n):
                    smooth[j][t] -= 0.4 * a[q] * response[k][j][t + q][size - y : 2 * size - y, size - z : 2 * size - z]
    assert np.allclose(model, want) and np.allclose(left, smooth[0] * top)


def test_moment_clean_needs_its_moments():
    with pytest.raises(ValueError, match="twice"):
        clean.clean_moments(np.ones((3, 4, 4)), np.ones((3, 4, 4)), None, gain=0.1, threshold=0.0, fraction=0.1, most=1)
    model, left = clean.clean_moments(np.ones((2, 4, 4)), np.zeros((4, 4, 4)), None, gain=0.1, threshold=0.0, fraction=0.1, most=1)
    assert not model.any() and (left == 1).all()


def test_moment_clean_of_facets_and_windows(spark):
    wide = beam(2 * N)
    sky = np.zeros((CHANS, N, N))
    sky[:, 8, 9], sky[:, 24, 22] = spectra("linear")
    dirty, psf = np.stack([convolve(s, wide) for s in sky]), np.stack([wide[N // 2 : N // 2 + N, N // 2 : N // 2 + N]] * CHANS)
    channels = spark.createDataFrame([(k, float(f)) for k, f in enumerate(FREQ)], "chan long, frequency double")
    mask = np.zeros((1, N, N))
    mask[:, :16, :16] = 1
    got = clean.clean_moment_facets(
        table(spark, dirty), table(spark, psf), N, F.lit(1e8) + F.col("chan") * 4e6, float(FREQ.mean()), channels, n=2, scales=(0.0,), facets=2, overlap=4, window=table(spark, mask, name="mask"), gain=0.3, fraction=0.05, most=100
    )
    model = cube_of(got, "model", sky.shape)
    assert not model[:, 16:].any() and not model[:, :, 16:].any()
    assert np.abs(model[:, 7:10, 8:11].sum((1, 2)) - sky[:, 8, 9]).max() < 0.5


def test_scales_follow_the_rule():
    """Chosen by value over coupling, ended before a faint step, windows smoothed by scale."""
    size, scales = 16, (0.0, 4.0)
    wide = beam(2 * size, 3)
    dirty = np.random.default_rng(8).normal(size=(size, size))
    model, _ = clean.clean_scales(dirty, wide, None, scales=scales, gain=0.5, threshold=0.0, fraction=0.1, most=9)
    blobs = [clean.scale_blob(s) for s in scales]
    response = [[clean._convolved(clean._convolved(wide / wide.max(), a), b) for b in blobs] for a in blobs]
    smooth = [clean._convolved(dirty / wide.max(), b) for b in blobs]
    want, stop = np.zeros_like(dirty), 0.09 * np.abs(smooth[0]).max()
    for _ in range(9):
        k = max((0, 1), key=lambda k: np.abs(smooth[k]).max() / response[k][k][size, size])
        y, x = np.unravel_index(np.abs(smooth[k]).argmax(), dirty.shape)
        if abs(smooth[k][y, x]) < stop:
            break
        step, half = 0.5 * smooth[k][y, x] / response[k][k][size, size], blobs[k].shape[0] // 2
        clean._subtract(want, blobs[k], y, x, (half, half), -step)
        for j in (0, 1):
            smooth[j] -= step * response[k][j][size - y : 2 * size - y, size - x : 2 * size - x]
    assert np.allclose(model, want)
    mask = np.zeros((size, size))
    mask[4:12, 4:12] = 1
    model, _ = clean.clean_scales(dirty, wide, mask, scales=(4.0,), gain=0.5, threshold=0.0, fraction=0.01, most=30)
    assert np.abs(model[mask == 0]).sum() < 0.15 * np.abs(model).sum()


def test_facets_share_one_threshold_and_keep_the_model(spark):
    wide = beam(2 * N)
    sky = np.zeros((1, N, N))
    sky[0, 7, 8], sky[0, 25, 23] = 10.0, 0.6
    dirty = np.stack([convolve(s, wide) for s in sky])
    dirty[0, 16:] = 0
    dirty[0, 25, 23] = 0.6  # one faint facet, and one without anything
    psf = wide[None, N // 2 : N // 2 + N, N // 2 : N // 2 + N]
    before = np.zeros((1, N, N))
    before[0, 25, 23] = 2.0
    got = clean.clean_facets(table(spark, dirty), table(spark, psf), N, 2, 0, model=table(spark, before), gain=0.2, fraction=0.1, most=200)
    model, left = cube_of(got, "model", dirty.shape), cube_of(got, "residual", dirty.shape)
    assert abs(model[0, 7, 8] - 10) < 1.5 and model[0, 25, 23] == 2.0
    assert (left[0, 16:] == dirty[0, 16:]).all() and np.abs(left[0, :16]).max() < 1.1
    # What a facet with overlap finds is the whole image's, feathered.
    whole = cube_of(clean.clean_facets(table(spark, dirty), table(spark, psf), N, 1, 0, gain=0.2, fraction=0.02, most=500), "model", dirty.shape)
    parts = cube_of(clean.clean_facets(table(spark, dirty), table(spark, psf), N, 2, 8, gain=0.2, fraction=0.02, most=500), "model", dirty.shape)
    assert abs(whole.sum() - parts.sum()) < 0.1 * whole.sum()


def test_psf_support_leaves_the_middle(spark):
    wide = beam(2 * N)
    psf = wide[None, N // 2 : N // 2 + N, N // 2 : N // 2 + N]
    dirty = np.zeros((1, N, N))
    dirty[0, 16, 16] = 1.0
    left = cube_of(clean.clean_facets(table(spark, dirty), table(spark, psf), N, 1, 0, psf_support=3, gain=1.0, fraction=0.9, most=1), "residual", dirty.shape)
    reach = np.abs(np.indices((N, N)) - 16).max(0)
    assert (left[0][reach >= 3] == 0).all() and np.abs(left[0][reach == 2]).max() > 0
