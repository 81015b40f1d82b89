"""Model-partition calibration: two directions with gains of their own."""

import numpy as np
from pyspark.sql import functions as F

from skyfringe.operators import skymodel
from skyfringe.operators.visibility import KEY
from skyfringe.plans.partition import Partition, calibrate_partition, identity_gains

NANT, N, CELL = 7, 16, 0.01
PLACES = {0: (8.0, 3, -2), 1: (5.0, -4, 3)}  # flux, x, y in pixels about the centre


def observed(spark, with_gains=True):
    rng = np.random.default_rng(6)
    phase = {k: rng.uniform(-0.9, 0.9, NANT) for k in PLACES}
    for p in phase.values():
        p -= p[0]
    rows = []
    for t in range(6):
        for i in range(NANT):
            for j in range(i + 1, NANT):
                u, v = rng.uniform(-30, 30, 2)
                for pol in (0, 3):
                    z = 0
                    for k, (f, x, y) in PLACES.items():
                        turn = np.exp(1j * (phase[k][i] - phase[k][j])) if with_gains else 1
                        z += f * np.exp(-2j * np.pi * (u * x + v * y) * CELL) * turn
                    rows.append((float(t * 10 + 5), i, j, 0, pol, float(u), float(v), 0.0, float(z.real), float(z.imag), 1.0, 1.0))
    names = "time double, a1 long, a2 long, chan long, pol long, u double, v double, w double, vis_re double, vis_im double, weight double, imaging_weight double"
    return spark.createDataFrame(rows, names), phase


def images(spark, values):
    """Each model's half of the field as its mask; ``values`` of the models' own pixels."""
    rows = []
    for k, (f, x, y) in PLACES.items():
        for pol in (0, 3):
            for py in range(N):
                for px in range(N):
                    mine = float((px >= N // 2) == (k == 0))
                    rows.append((k, 0, pol, py, px, f * values if (py, px) == (N // 2 + y, N // 2 + x) else 0.0, mine))
    return spark.createDataFrame(rows, "model_id long, chan long, pol long, y long, x long, value double, mask double")


def test_two_directions_are_told_apart(spark):
    vis, phase = observed(spark)
    models = spark.createDataFrame([(0,), (1,)], "model_id long")
    start = Partition(models, None, images(spark, 1.0), identity_gains(vis, models, NANT, 60.0))
    done = calibrate_partition(vis, start, NANT, 60.0, N, CELL, rounds=8, clean_image=False)
    assert all(b < a for a, b in zip(done.left, done.left[1:], strict=False)) and done.left[-1] < 0.05 * done.left[0]
    for r in done.gains.where("feed = 0").collect():
        off = np.angle(complex(r.g_re, r.g_im) * np.exp(-1j * phase[r.model_id][r.ant]))
        assert abs(off) < 0.1


def test_models_grow_within_their_masks(spark):
    vis, _ = observed(spark, with_gains=False)
    models = spark.createDataFrame([(0,), (1,)], "model_id long")
    start = Partition(models, None, images(spark, 0.5), identity_gains(vis, models, NANT, 60.0))
    done = calibrate_partition(vis, start, NANT, 60.0, N, CELL, rounds=4, damping=0.7, most=60, fraction=0.05)
    assert done.left[-1] < 0.3 * done.left[0] and all(b < a for a, b in zip(done.left, done.left[1:], strict=False))
    got = {(r.model_id, r.y, r.x): r.value for r in done.images.where("pol = 0").collect()}
    for k, (f, x, y) in PLACES.items():
        assert abs(got[k, N // 2 + y, N // 2 + x] - f) < 0.3 * f
    assert done.images.where("mask = 0 AND value <> 0").count() == 0 and done.residual.count() == 2 * N * N


def test_models_with_images_components_and_gains(spark):
    vis, phase = observed(spark)
    models = spark.createDataFrame([(0,), (1,), (2,)], "model_id long")
    rows = [(k, 60 * 0 + 30.0, a, 0, feed, float(np.cos(phase[k][a])), float(np.sin(phase[k][a])), 1.0) for k in PLACES for a in range(NANT) for feed in (0, 1)]
    gains = spark.createDataFrame(rows, "model_id long, time double, ant long, chan long, feed long, g_re double, g_im double, weight double")
    f, x, y = PLACES[1]
    dec = float(np.arcsin(y * CELL))
    comp = spark.createDataFrame([(1, 10, float(np.arcsin(x * CELL / np.cos(dec))), dec, f)], "model_id long, comp_id long, ra double, dec double, flux0 double")
    only = images(spark, 1.0).where("model_id = 0")
    got = skymodel.predict_sky_models(vis, models, components=comp, images=only, npixel=N, cellsize=CELL, gains=gains, interval=60.0, first=30.0).cache()
    assert got.count() == 3 * vis.count() and got.where("model_id = 2 AND (m_re <> 0 OR m_im <> 0)").count() == 0
    summed = got.groupBy(*KEY).agg(F.sum("m_re").alias("re"), F.sum("m_im").alias("im")).join(vis, KEY)
    off = summed.agg(F.max(F.hypot(F.col("re") - F.col("vis_re"), F.col("im") - F.col("vis_im")))).first()[0]
    assert off < 0.5  # the image's part is degridded, the component's exact
    seen = skymodel.invert_models(got.join(vis.drop("vis_re", "vis_im"), KEY).withColumnsRenamed({"m_re": "vis_re", "m_im": "vis_im"}).where("model_id = 0"), only, N, CELL, gains=gains, interval=60.0, first=30.0, padding=2)
    peak = seen.where("pol = 0").orderBy(F.desc("value")).first()
    f, x, y = PLACES[0]
    assert (peak.y, peak.x) == (N // 2 + y, N // 2 + x) and abs(peak.value - f) < 0.1 * f


def test_weak_components_go_into_the_image(spark):
    comp = spark.createDataFrame([(0, 0, 0.0, 0.0, 5.0), (0, 0, -0.02, 0.03, 1.0), (0, 0, 0.01, 0.01, 2.0)], "chan long, pol long, l double, m double, flux double")
    image = spark.createDataFrame([(0, 0, y, x, 0.5) for y in range(8) for x in range(8)], "chan long, pol long, y long, x long, value double")
    bright, full = skymodel.partition_model(comp, image, 2.0, 8, 0.01)
    assert sorted(r.flux for r in bright.collect()) == [2.0, 5.0]
    assert {(r.y, r.x): r.value for r in full.collect()}[7, 6] == 1.5 and full.count() == 64
