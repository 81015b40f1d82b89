"""Beams at all radii, spectra between channels, continuum of any degree, bandpasses: against plain numerics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfringe.operators import beams, jones, spectra, visibility


def j1(r):
    t = (np.arange(20_000) + 0.5) * np.pi / 20_000
    return np.cos(t - np.outer(r, np.sin(t))).mean(1)


def test_disk_transform_at_all_radii(spark):
    r = np.array([0.0, 1e-6, 0.5, 2.999, 3.0, 3.001, 7.0156, 9.0, 10.0, 12.0, 14.0, 25.0, 50.0, 200.0])
    got = [x.v for x in spark.createDataFrame([(float(x),) for x in r], "r double").select(beams.disk_transform(F.col("r")).alias("v")).collect()]
    want = np.where(r > 0, 2 * j1(r) / np.where(r > 0, r, 1), 1.0)
    assert np.abs(np.array(got) - want).max() < 1e-6


@pytest.mark.parametrize("telescope", ["VLA", "MID"])
def test_primary_beam_against_numpy(spark, telescope):
    rows = spark.createDataFrame([(0, 0, y, x, 1.0, 1.4e9) for y in range(0, 64, 7) for x in range(0, 64, 9)], "chan long, pol long, y long, x long, value double, f double")
    got = beams.primary_beam(rows, 64, 0.003, F.col("f"), telescope, py=30.0, px=20.0).toPandas()
    d, b = beams.DISHES[telescope]
    angle, wave = np.hypot(got["y"] - 30, got["x"] - 20).to_numpy() * 0.003, beams.C / 1.4e9
    disk = lambda r: np.where(r > 0, 2 * j1(r) / np.where(r > 0, r, 1), 1.0)
    v = disk(angle * np.pi * d / wave) - (b / d) ** 2 * disk(angle * np.pi * b / wave)
    assert np.abs(got["value"] - v * v).max() < 1e-6
    volts = beams.primary_beam(rows, 64, 0.003, F.col("f"), telescope, py=30.0, px=20.0, voltage=True).toPandas()
    assert np.allclose(volts["value"] ** 2, got["value"])


def test_tapered_beam_is_the_disk_without_taper(spark):
    rows = spark.createDataFrame([(0, 0, y, x, 1.0) for y in range(16, 48, 3) for x in range(16, 48, 3)], "chan long, pol long, y long, x long, value double")
    a = beams.tapered_beam(rows, 64, 0.004, F.lit(1.4e9), 15.0, edge=1.0).orderBy("y", "x").toPandas()
    b = beams.primary_beam(rows, 64, 0.004, F.lit(1.4e9), "MID").orderBy("y", "x").toPandas()
    assert np.abs(a["value"] - b["value"]).max() < 1e-4
    soft = beams.tapered_beam(rows, 64, 0.004, F.lit(1.4e9), 15.0).orderBy("y", "x").toPandas()
    assert soft["value"].sum() > b["value"].sum()  # a taper widens the beam


@pytest.mark.parametrize("array_rows", [20_000, 3])
def test_mosaic_is_the_root_of_the_sum_of_squares(spark, array_rows):
    image = spark.createDataFrame([(c, 0, y, x, 1.0) for c in (0, 1) for y in range(4) for x in range(5)], "chan long, pol long, y long, x long, value double")
    points = [(0.0, 0.0), (2.5, 3.0), (9.0, -4.0), (1.0, 1.0), (30.0, 2.0)]
    got = beams.mosaic_beam(image, spark.createDataFrame(points, "py double, px double"), 0.9, array_rows=array_rows, task_pairs=7).toPandas()
    r = np.array([[np.hypot(y - py, x - px) * 0.9 for py, px in points] for y, x in zip(got["y"], got["x"], strict=True)])
    power = np.where(r > 0, 2 * j1(r.ravel()).reshape(r.shape) / np.where(r > 0, r, 1), 1.0) ** 2
    assert len(got) == 40 and np.abs(got["value"] - np.sqrt((power**2).sum(1))).max() < 1e-6


def plain_spline(x, y, at):
    """Cubics between knots whose values and two derivatives meet, and third derivatives at the second and the last but one: one
    system for all coefficients."""
    n = len(x) - 1
    a, b, row = np.zeros((4 * n, 4 * n)), np.zeros(4 * n), 0
    for k in range(n):
        for e in (0, 1):
            a[row, 4 * k : 4 * k + 4], b[row] = [(x[k + e] - x[k]) ** p for p in range(4)], y[k + e]
            row += 1
    for k in range(n - 1):
        h = x[k + 1] - x[k]
        for d in (1, 2):
            a[row, 4 * k : 4 * k + 4] = [0, 1, 2 * h, 3 * h * h] if d == 1 else [0, 0, 2, 6 * h]
            a[row, 4 * k + 4 + d] = -1 if d == 1 else -2
            row += 1
    for k in (0, n - 2):
        a[row, 4 * k + 3], a[row, 4 * k + 7] = 1, -1
        row += 1
    c = np.linalg.solve(a, b).reshape(n, 4)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 1)
    return sum(c[k, p] * (at - x[k]) ** p for p in range(4))


def test_splines_against_one_system(spark):
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(0, 10, 9))
    data = {k: rng.normal(size=9) for k in range(5)}
    rows = [(k, float(a), float(b)) for k, y in data.items() for a, b in zip(x, y, strict=True)] + [(0, float(x[2]), 99.0), (7, None, 1.0), (8, 1.0, 4.0)]
    at = [float(v) for v in (x[0] - 0.3, 1.0, 4.4, x[3], 9.9, x[-1] + 0.2)]
    df = spark.createDataFrame(rows, "k long, frequency double, value double")
    got = spectra.interpolate_spectra(df, ["k"], at).toPandas()
    for k, y in data.items():
        assert np.allclose(got[got["k"] == k].sort_values("frequency")["value"], plain_spline(x, y, np.sort(at)))
    assert (got[got["k"] == 8]["value"] == 4.0).all() and not (got["k"] == 7).any()
    lines = spectra.interpolate_spectra(df, ["k"], [1.0, 4.4, 7.9], kind="linear").toPandas()
    assert np.allclose(lines[lines["k"] == 1].sort_values("frequency")["value"], np.interp([1.0, 4.4, 7.9], x, data[1]))
    cubic = x**3 - 2 * x
    assert np.allclose(spectra.spline_matrix(x, np.array(at)) @ cubic, np.array(at) ** 3 - 2 * np.array(at))
    for n in (1, 2, 3):
        assert np.allclose(spectra.spline_matrix(x[:n], x[:n]), np.eye(n))


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_continuum_of_a_polynomial_is_nothing(spark, degree):
    rng = np.random.default_rng(degree)
    rows, line = [], {}
    for k in range(6):
        c, d = rng.normal(size=degree + 1), rng.normal(size=degree + 1)
        for chan in range(9):
            x = chan / 4 - 1
            masked = chan in (3, 4) and k < 3
            rows.append((k, chan, float(np.polyval(c, x)) + 5.0 * masked, float(np.polyval(d, x)), 0.0 if masked else 1.0 + k % 2))
            line[k, chan] = 5.0 * masked
    df = spark.createDataFrame(rows, "k long, chan long, re double, im double, weight double")
    got = visibility.remove_continuum(df, ["k"], F.col("chan") / 4 - 1, ["re", "im"], F.col("weight"), degree=degree).collect()
    assert len(got) == 54 and all(abs(r.re - line[r.k, r.chan]) < 1e-8 and abs(r.im) < 1e-8 for r in got)
    few = visibility.remove_continuum(df.where("chan < 2"), ["k"], F.col("chan") / 4 - 1, "im", F.col("weight"), degree=degree)
    assert all(abs(r.im) < 1e-6 for r in few.collect())


def test_bandpass_finds_a_known_delay(spark):
    rng = np.random.default_rng(4)
    nant, nchan, slope = 9, 16, 0.7
    amp, phase = rng.uniform(0.8, 1.2, (nant, nchan)), rng.uniform(-0.1, 0.1, (nant, 1)) + slope * np.arange(nchan)
    phase[2] += rng.uniform(-1, 1, nchan)  # one bad antenna, which the trimmed mean leaves out
    g = amp * np.exp(1j * phase)
    rows = [(0, 0, a, c, float(g[a, c].real), float(g[a, c].imag), 1.0) for a in range(nant) for c in range(nchan)]
    df = spark.createDataFrame(rows, "slot long, feed long, ant long, chan long, g_re double, g_im double, weight double")
    got = jones.bandpass(df).toPandas()
    delay = got.groupby("chan")["delay_phase"].first().to_numpy()
    assert np.abs(delay - slope * np.arange(nchan)).max() < 0.1
    part = jones.bandpass(df, first=4, last=12).toPandas().groupby("chan")["delay_phase"].first().to_numpy()
    assert (part[:5] == 0).all() and np.allclose(np.diff(part[4:12]), slope, atol=0.05) and np.ptp(part[11:]) == 0
    # The rule by numpy: trimmed amplitudes, the phase of the medians.
    off = round(nant * 0.25)
    size = np.sort(np.abs(g), axis=0)[off : nant - off].mean(0)
    turn = np.arctan2(np.median(g.imag, axis=0), np.median(g.real, axis=0))
    want = g / (size * np.exp(1j * turn))
    seen = np.zeros((nant, nchan), complex)
    seen[got["ant"], got["chan"]] = got["b_re"] + 1j * got["b_im"]
    assert np.allclose(seen, want)
    steps = np.diff(np.angle(g), axis=1)
    steps = np.where(steps > np.pi, steps - 2 * np.pi, np.where(steps < -np.pi, steps + 2 * np.pi, steps))
    assert np.allclose(np.diff(delay), np.sort(steps, axis=0)[off : nant - off].mean(0))


