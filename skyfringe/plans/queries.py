"""The registered queries of the interferometry operators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfringe.functions import coordinates as co
from skyfringe.functions import polarisation as po
from skyfringe.functions import windows as wi
from skyfringe.operators import beams as be
from skyfringe.operators import calibration as ca
from skyfringe.operators import clean as cl
from skyfringe.operators import gridding as gr
from skyfringe.operators import images as im
from skyfringe.operators import imaging as ig
from skyfringe.operators import jones as jn
from skyfringe.operators import joins as jo
from skyfringe.operators import kernels as ke
from skyfringe.operators import screens as sc
from skyfringe.operators import skymodel as sk
from skyfringe.operators import spectra as ss
from skyfringe.operators import tables as ta
from skyfringe.operators import visibility as vi
from skyfringe.sources import tables as so
from skyfringe.streaming import calibration as st
from skyfringe.streaming import realtime as rt

from . import imaging as cycles
from . import partition as pt
from .registry import ALL, Views, register

KEY = "time a1 a2 chan pol"
K = "time, a1, a2, chan, pol"
NPIXEL, CELL = 64, 0.002
RA0, DEC0 = 0.1, -0.5
PI2 = "6.283185307179586e0"

# --- selection, slices, set operations ---------------------------------------------------------------------------


@register("f02_uvrange", KEY, "u v vis_re", f"SELECT {K}, u, v, vis_re FROM fx_vis WHERE sqrt(u * u + v * v) > 203e-1 AND sqrt(u * u + v * v) <= 607e-1")
def _(t: Views) -> DataFrame:
    return vi.select_uvrange(t("fx_vis"), 20.3, 60.7)


@register("f03_wrange", KEY, "w vis_re", f"SELECT {K}, w, vis_re FROM fx_vis WHERE abs(w) <= 213e-1")
def _(t: Views) -> DataFrame:
    return vi.select_wrange(t("fx_vis"), 21.3)


@register("f01_rows_with_weight", KEY, "vis_re vis_im weight", f"SELECT {K}, vis_re, vis_im, weight FROM fx_vis WHERE weight > 0")
def _(t: Views) -> DataFrame:
    return t("fx_vis").where("weight > 0")


@register("f05_limit_radius", "ant", "x y z", "SELECT a.* FROM fx_antenna a, (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM fx_antenna) m WHERE sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) < 3000")
def _(t: Views) -> DataFrame:
    return vi.limit_radius(t("fx_antenna"), 3000)


@register("f08_flux_range", "comp_id", "flux0", "SELECT comp_id, flux0 FROM fx_component WHERE flux0 > 91e-2 AND flux0 < 96e-2")
def _(t: Views) -> DataFrame:
    return sk.filter_by_flux(t("fx_component"), F.col("flux0"), 0.91, 0.96)


@register("f09_listed_components", "comp_id", "flux0", "SELECT comp_id, flux0 FROM fx_component WHERE comp_id IN (SELECT comp_id FROM fx_target)")
def _(t: Views) -> DataFrame:
    return t("fx_component").join(t("fx_target").select("comp_id"), "comp_id", "left_semi")


SEP = "2 * asin(sqrt(least(pow(sin(({d2} - {d1}) / 2), 2) + cos({d1}) * cos({d2}) * pow(sin(({r2} - {r1}) / 2), 2), 1e0)))"


@register("f10_by_separation", "comp_id", "separation", f"SELECT * FROM (SELECT comp_id, {SEP.format(r1='1e-1', d1='(-5e-1)', r2='ra', d2='dec')} AS separation FROM fx_component) WHERE separation >= 2e-2 AND separation <= 1e-1")
def _(t: Views) -> DataFrame:
    return sk.select_by_separation(t("fx_component"), RA0, DEC0, 0.02, 0.1)


@register("w01_time_slices", KEY + " slice", "weight", f"SELECT {K}, weight, least(8, floor((time - lo) / ((hi - lo) / 8) + 5e-1)) AS slice FROM fx_vis, (SELECT min(time) AS lo, max(time) AS hi FROM fx_vis)")
def _(t: Views) -> DataFrame:
    return vi.time_slices(t("fx_vis"), 9)


@register("w02_w_slices", KEY + " slice", "w", f"SELECT {K}, w, least(n - 1, floor((w + most) / (2 * most / (n - 1)) + 5e-1)) AS slice FROM fx_vis, (SELECT max(abs(w)) AS most, 1 + 2 * round(max(abs(w)) / 1e1) AS n FROM fx_vis)")
def _(t: Views) -> DataFrame:
    return vi.w_slices(t("fx_vis"), 10.0)


@register("a13_distinct_samples", "times chans baselines", "", "SELECT count(DISTINCT time) AS times, count(DISTINCT chan) AS chans, count(DISTINCT a1 * 100 + a2) AS baselines FROM fx_vis")
def _(t: Views) -> DataFrame:
    return t("fx_vis").agg(F.countDistinct("time").alias("times"), F.countDistinct("chan").alias("chans"), F.countDistinct("a1", "a2").alias("baselines"))


@register("u01_append", KEY, "vis_re", f"SELECT {K}, vis_re FROM fx_vis UNION ALL SELECT time + 1e3, a1, a2, chan, pol, -vis_re FROM fx_vis")
def _(t: Views) -> DataFrame:
    v = t("fx_vis")
    return vi.append(v, v.withColumns({"time": F.col("time") + 1e3, "vis_re": -F.col("vis_re")}))


@register("u03_concatenate_frequency", KEY, "vis_re", f"SELECT {K}, vis_re FROM fx_vis UNION ALL SELECT time, a1, a2, chan + (SELECT max(chan) + 1 FROM fx_vis), pol, vis_re FROM fx_vis")
def _(t: Views) -> DataFrame:
    v = t("fx_vis")
    return vi.concatenate_frequency(v, v)


@register("o03_brightest", "comp_id", "flux0", "SELECT comp_id, flux0 FROM fx_component ORDER BY flux0 DESC, comp_id LIMIT 25")
def _(t: Views) -> DataFrame:
    return sk.brightest(t("fx_component"), "flux0", 25)


@register("o02_peak_pixel", "chan y x", "value", "SELECT chan, y, x, value FROM (SELECT *, row_number() OVER (PARTITION BY chan ORDER BY abs(value) DESC, y, x) AS r FROM fx_pixel) WHERE r = 1")
def _(t: Views) -> DataFrame:
    best = t("fx_pixel").groupBy("chan").agg(F.max(F.struct(F.abs("value"), -F.col("y"), -F.col("x"), "value")).alias("m"))
    return best.select("chan", (-F.col("m.col2")).alias("y"), (-F.col("m.col3")).alias("x"), "m.value")


# --- joins -----------------------------------------------------------------------------------------------------------


#: fx_vis with the model's values beside it. The model is a function of the key, so SQL needs no join of the view with itself.
WITH_MODEL = "(SELECT *, CASE WHEN chan = 6 THEN 0e0 ELSE 50e0 + a1 END AS m_re, CASE WHEN chan = 6 THEN 0e0 ELSE CAST(a2 - chan AS DOUBLE) END AS m_im FROM fx_vis)"


@register("j01_subtract", KEY, "vis_re vis_im", f"SELECT {K}, vis_re - m_re AS vis_re, vis_im - m_im AS vis_im FROM {WITH_MODEL}")
def _(t: Views) -> DataFrame:
    return jo.subtract(t("fx_vis"), t("fx_model"))


DIVIDED = f"""SELECT {K}, CASE WHEN wt > 0 THEN (vis_re * m_re + vis_im * m_im) / n ELSE 0 END AS vis_re,
    CASE WHEN wt > 0 THEN (vis_im * m_re - vis_re * m_im) / n ELSE 0 END AS vis_im, CASE WHEN wt > 0 THEN wt ELSE 0 END AS weight
    FROM (SELECT *, m_re * m_re + m_im * m_im AS n, (m_re * m_re + m_im * m_im) * weight AS wt FROM {WITH_MODEL})"""


@register("j02_divide", KEY, "vis_re vis_im weight", DIVIDED)
def _(t: Views) -> DataFrame:
    return jo.divide(t("fx_vis"), t("fx_model"))


def _cmul(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    return f"({a[0]} * {b[0]} - {a[1]} * {b[1]})", f"({a[0]} * {b[1]} + {a[1]} * {b[0]})"


def _cadd(a: tuple[str, str], b: tuple[str, str], sign: str = "+") -> tuple[str, str]:
    return f"({a[0]} {sign} {b[0]})", f"({a[1]} {sign} {b[1]})"


def _divided_matrix() -> str:
    """inverse(M) V of each sample's four products; 0 where M has no inverse or a product is missing."""
    v, m = ([(f"{n}{k}_re", f"{n}{k}_im") for k in range(4)] for n in "vm")
    det = _cadd(_cmul(m[0], m[3]), _cmul(m[1], m[2]), "-")
    size = f"({det[0]} * {det[0]} + {det[1]} * {det[1]})"
    adj = [m[3], (f"(-{m[1][0]})", f"(-{m[1][1]})"), (f"(-{m[2][0]})", f"(-{m[2][1]})"), m[0]]
    out = []
    for r in (0, 1):
        for c in (0, 1):
            x = _cadd(_cmul(adj[2 * r], v[c]), _cmul(adj[2 * r + 1], v[2 + c]))
            q = _cmul(x, (det[0], f"(-{det[1]})"))
            out.append([f"coalesce(CASE WHEN {size} > 0 THEN {p} / {size} ELSE 0 END, 0)" for p in q])
    wide = ", ".join(f"max(CASE WHEN pol = {k} THEN {a} END) AS {n}{k}_{p}" for n, cols in (("v", ("vis_re", "vis_im")), ("m", ("m_re", "m_im"))) for k in range(4) for p, a in zip(("re", "im"), cols, strict=True))
    model = f"SELECT {K}, CASE WHEN pol IN (0, 3) THEN m_re ELSE 1e0 END AS m_re, m_im FROM fx_model"
    return f"SELECT time, a1, a2, chan, unnest([0, 1, 2, 3]) AS pol, unnest([{', '.join(x[0] for x in out)}]) AS vis_re, unnest([{', '.join(x[1] for x in out)}]) AS vis_im FROM (SELECT time, a1, a2, chan, {wide} FROM fx_vis JOIN ({model}) m USING ({K}) GROUP BY time, a1, a2, chan)"


@register("j02_divide_matrix", KEY, "vis_re vis_im", _divided_matrix())
def _(t: Views) -> DataFrame:
    m = t("fx_model").withColumn("m_re", F.when(F.col("pol").isin(0, 3), F.col("m_re")).otherwise(F.lit(1.0)))
    return jo.divide_matrix(t("fx_vis"), m)


def gained(inverse: bool) -> str:
    re, im = "(g1.g_re * g2.g_re + g1.g_im * g2.g_im)", "(g1.g_im * g2.g_re - g1.g_re * g2.g_im)"
    vr, vm = (f"(vis_re * {re} + vis_im * {im}) / ({re} * {re} + {im} * {im})", f"(vis_im * {re} - vis_re * {im}) / ({re} * {re} + {im} * {im})") if inverse else (f"vis_re * {re} - vis_im * {im}", f"vis_re * {im} + vis_im * {re}")
    good = "g1.weight > 0 AND g2.weight > 0"
    return f"""SELECT v.time, a1, a2, v.chan, pol, CASE WHEN {good} THEN {vr} ELSE 0 END AS vis_re, CASE WHEN {good} THEN {vm} ELSE 0 END AS vis_im,
        CASE WHEN {good} THEN v.weight ELSE 0 END AS weight
        FROM fx_vis v JOIN fx_gain g1 ON g1.ant = a1 AND g1.chan = v.chan AND abs(v.time - g1.time) < g1."interval" / 2
        JOIN fx_gain g2 ON g2.ant = a2 AND g2.chan = v.chan AND abs(v.time - g2.time) < g2."interval" / 2"""


@register("j03_apply_gains", KEY, "vis_re vis_im weight", gained(False))
def _(t: Views) -> DataFrame:
    return jo.apply_gains(t("fx_vis"), t("fx_gain"), interval=160.0, first=75.0)


@register("j03_apply_gains_inverse", KEY, "vis_re vis_im weight", gained(True))
def _(t: Views) -> DataFrame:
    return jo.apply_gains(t("fx_vis"), t("fx_gain"), interval=160.0, first=75.0, inverse=True)


PAIR_SEP = SEP.format(r1="a.ra", d1="a.dec", r2="b.ra", d2="b.dec")


@register("j06_matches", "id1 id2", "separation", f"SELECT id1, id2, separation FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY separation, id2) AS r FROM (SELECT a.comp_id AS id1, b.comp_id AS id2, {PAIR_SEP} AS separation FROM fx_component a, fx_target b) WHERE separation < 1e-2) WHERE r = 1")
def _(t: Views) -> DataFrame:
    return jo.matches(t("fx_component"), t("fx_target"), 0.01)


@register("j07_separations", "id1 id2", "separation", f"SELECT a.comp_id AS id1, b.comp_id AS id2, {PAIR_SEP} AS separation FROM fx_target a, fx_component b")
def _(t: Views) -> DataFrame:
    return jo.separations(t("fx_target"), t("fx_component"))


@register("j08_nearest_target", "comp_id target_id", "separation", f"SELECT comp_id, target_id, separation FROM (SELECT a.comp_id, b.comp_id AS target_id, {PAIR_SEP} AS separation, row_number() OVER (PARTITION BY a.comp_id ORDER BY {PAIR_SEP}, b.comp_id) AS r FROM fx_component a, fx_target b) WHERE r = 1")
def _(t: Views) -> DataFrame:
    return jo.nearest(t("fx_component"), t("fx_target"))


@register("j09_masked_image", "chan pol y x", "value", "SELECT chan, pol, y, x, value * mask AS value FROM fx_pixel JOIN (SELECT chan, pol, y, x, mask FROM fx_mask) m USING (chan, pol, y, x)")
def _(t: Views) -> DataFrame:
    return t("fx_pixel").join(t("fx_mask").drop("value"), im.PIXEL).withColumn("value", F.col("value") * F.col("mask"))


@register("j11_baselines", "a1 a2", "dx dy dz", "SELECT a.ant AS a1, b.ant AS a2, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM fx_antenna a JOIN fx_antenna b ON b.ant > a.ant")
def _(t: Views) -> DataFrame:
    return jo.baselines(t("fx_antenna"))


L = "cos(dec) * sin(ra - 1e-1)"
M = "(sin(dec) * cos(-5e-1) - cos(dec) * sin(-5e-1) * cos(ra - 1e-1))"
N = "(sin(dec) * sin(-5e-1) + cos(dec) * cos(-5e-1) * cos(ra - 1e-1) - 1)"
FLUX = "flux0 * pow(frequency / 1e8, -7e-1)"


@register("j12_predict_components", KEY, "m_re m_im", f"SELECT {K}, sum({FLUX} * cos({PI2} * turns)) AS m_re, -sum({FLUX} * sin({PI2} * turns)) AS m_im FROM (SELECT *, u * {L} + v * {M} + w * {N} AS turns FROM fx_vis, fx_target) GROUP BY {K}")
def _(t: Views) -> DataFrame:
    spectrum = F.pow(F.col("frequency") / 1e8, F.lit(-0.7))
    return jo.predict_components(t("fx_vis"), t("fx_target"), RA0, DEC0, spectrum)


# --- aggregation ------------------------------------------------------------------------------------------------------

MEAN = "CASE WHEN sum(weight) > 0 THEN sum(weight * {0}) / sum(weight) ELSE 0e0 END AS {0}"
INTEGRATED = f"SELECT time, a1, a2, pol, {MEAN.format('vis_re')}, {MEAN.format('vis_im')}, sum(weight) AS weight, sum(imaging_weight) AS imaging_weight, avg(u) AS u, avg(v) AS v, avg(w) AS w, avg(frequency) AS frequency, sum(channel_bandwidth) AS channel_bandwidth FROM fx_vis GROUP BY time, a1, a2, pol"


@register("a04_integrate_channels", "time a1 a2 pol", "vis_re vis_im weight imaging_weight u v w frequency channel_bandwidth", INTEGRATED)
def _(t: Views) -> DataFrame:
    return vi.integrate_channels(t("fx_vis"))


@register("a05_sum_towards", "chan pol", "flux weight", f"SELECT chan, pol, CASE WHEN sum(weight) > 0 THEN sum(weight * (vis_re * cos({PI2} * turns) - vis_im * sin({PI2} * turns))) / sum(weight) ELSE 0 END AS flux, sum(weight) AS weight FROM (SELECT *, u * 1e-2 + v * -2e-2 + w * {(1 - 0.01**2 - 0.02**2) ** 0.5 - 1!r} AS turns FROM fx_vis) GROUP BY chan, pol")
def _(t: Views) -> DataFrame:
    return vi.sum_towards(t("fx_vis"), 0.01, -0.02)


@register("a06_visibility_quality", "", "max min std median", "SELECT max(x) AS max, min(x) AS min, stddev_pop(x) AS std, median(x) AS median FROM (SELECT sqrt(vis_re * vis_re + vis_im * vis_im) AS x FROM fx_vis)")
def _(t: Views) -> DataFrame:
    return vi.visibility_quality(t("fx_vis"))


CHUNKED = f"""
    WITH d AS (SELECT *, sqrt(u * u + v * v) AS d FROM fx_vis),
    per AS (SELECT a1, a2, max(d) AS far, sum(weight) AS wt FROM d GROUP BY a1, a2),
    runs AS (SELECT a1, a2,
        CASE WHEN wt <= 0 THEN 1 WHEN far > 0 THEN least(8, greatest(1, round(2e0 * farthest / far))) ELSE 8 END AS nt,
        CASE WHEN wt <= 0 THEN 1 WHEN far > 0 THEN least(4, greatest(1, round(1.5e0 * farthest / far))) ELSE 4 END AS nf
        FROM per, (SELECT max(far) AS farthest FROM per)),
    placed AS (SELECT d.*, dense_rank() OVER (PARTITION BY d.a1, d.a2 ORDER BY time) - 1 AS t, dense_rank() OVER (PARTITION BY d.a1, d.a2 ORDER BY chan) - 1 AS f, nt, nf
        FROM d JOIN runs ON d.a1 = runs.a1 AND d.a2 = runs.a2),
    chunks AS (SELECT *, floor(t / nt) AS tchunk, floor(f / nf) AS fchunk FROM placed)"""
COALESCED = f"SELECT * FROM ({CHUNKED} SELECT a1, a2, tchunk, fchunk, pol, {MEAN.format('time')}, {MEAN.format('frequency')}, {MEAN.format('u')}, {MEAN.format('vis_re')}, {MEAN.format('vis_im')}, sum(weight) AS weight, sum(imaging_weight) AS imaging_weight, count(DISTINCT time) * max(integration_time) AS integration_time, count(*) AS samples FROM chunks GROUP BY a1, a2, tchunk, fchunk, pol)"


@register("a01_coalesce", "a1 a2 tchunk fchunk pol samples", "time frequency u vis_re vis_im weight imaging_weight integration_time", COALESCED)
def _(t: Views) -> DataFrame:
    return vi.coalesce_visibility(t("fx_vis"), 2.0, 8, 1.5, 4)


@register("a03_decoalesce", KEY, "vis_re vis_im", f"SELECT * FROM ({CHUNKED} SELECT time, a1, a2, chan, pol, CASE WHEN sum(weight) OVER p > 0 THEN sum(weight * vis_re) OVER p / sum(weight) OVER p ELSE 0 END AS vis_re, CASE WHEN sum(weight) OVER p > 0 THEN sum(weight * vis_im) OVER p / sum(weight) OVER p ELSE 0 END AS vis_im FROM chunks WINDOW p AS (PARTITION BY a1, a2, tchunk, fchunk, pol))")
def _(t: Views) -> DataFrame:
    return vi.decoalesce_visibility(t("fx_vis"), 2.0, 8, 1.5, 4)


GU, GV = f"floor(u * {NPIXEL * CELL!r} + {NPIXEL // 2} + 5e-1)", f"floor(v * {NPIXEL * CELL!r} + {NPIXEL // 2} + 5e-1)"
CELLS = f"(SELECT * FROM (SELECT *, {GU} AS gu, {GV} AS gv FROM fx_vis) WHERE gu >= 0 AND gu < {NPIXEL} AND gv >= 0 AND gv < {NPIXEL})"


@register("a09_grid_weights", "chan pol gv gu", "weight", f"SELECT chan, pol, gv, gu, sum(imaging_weight) AS weight FROM {CELLS} GROUP BY chan, pol, gv, gu")
def _(t: Views) -> DataFrame:
    return gr.grid_weights(t("fx_vis"), NPIXEL, CELL)


@register("a10_fit_uv_plane", "", "p q", "SELECT (uw * vv - vw * uv) / (uu * vv - uv * uv) AS p, (vw * uu - uw * uv) / (uu * vv - uv * uv) AS q FROM (SELECT sum(weight * u * u) AS uu, sum(weight * u * v) AS uv, sum(weight * v * v) AS vv, sum(weight * u * w) AS uw, sum(weight * v * w) AS vw FROM fx_vis)")
def _(t: Views) -> DataFrame:
    return vi.fit_uv_plane(t("fx_vis"))


IMAGES = "SELECT 0 AS image_id, * FROM fx_pixel UNION ALL SELECT 1, chan, pol, y, x, value * 3 FROM fx_pixel WHERE x < 32"


@register("a11_sum_images", "chan pol y x", "value", f"SELECT chan, pol, y, x, sum(value * (image_id + 1)) / sum(image_id + 1) AS value FROM ({IMAGES}) GROUP BY chan, pol, y, x")
def _(t: Views) -> DataFrame:
    p = t("fx_pixel")
    images = p.withColumn("image_id", F.lit(0)).unionByName(p.where("x < 32").withColumns({"value": F.col("value") * 3, "image_id": F.lit(1)}))
    return im.sum_images(images, images.select("image_id", "chan", "pol", (F.col("image_id") + 1.0).alias("weight")).distinct())


@register("a12_sum_predictions", KEY, "m_re m_im", f"SELECT {K}, sum(m_re) AS m_re, sum(m_im) AS m_im FROM (SELECT * FROM fx_model UNION ALL SELECT {K}, m_re * 2, m_im + 1 FROM fx_model WHERE chan < 3) GROUP BY {K}")
def _(t: Views) -> DataFrame:
    m = t("fx_model")
    both = m.unionByName(m.where("chan < 3").withColumns({"m_re": F.col("m_re") * 2, "m_im": F.col("m_im") + 1}))
    return both.groupBy(*vi.KEY).agg(F.sum("m_re").alias("m_re"), F.sum("m_im").alias("m_im"))


ADVICE = """SELECT *, CASE WHEN p2 * 75e-2 >= npixel THEN p2 * 75e-2 ELSE p2 END AS npixel_power_of_2_3, p2 AS npixel_power_of_2,
    864e2 * w_sampling_image / (PI * longest_baseline) AS time_sampling_image, top * w_sampling_primary_beam / (PI * longest_baseline) AS freq_sampling_primary_beam,
    greatest(1, floor(2 * largest_w / w_sampling_primary_beam)) AS vis_slices
    FROM (SELECT *, pow(2e0, ceil(log2(npixel))) AS p2 FROM (SELECT *, 1 / longest_baseline AS synthesised_beam, wavelength / 35e0 * 6 AS image_fov,
        round_even(wavelength / 35e0 * 6 / (1 / longest_baseline / 3), 0) AS npixel, sqrt(4e-2) / (PI * (wavelength / 35e0 * 6) * (wavelength / 35e0 * 6)) AS w_sampling_image,
        sqrt(4e-2) / (PI * (wavelength / 35e0) * (wavelength / 35e0)) AS w_sampling_primary_beam
        FROM (SELECT greatest(max(abs(u)), max(abs(v)), max(abs(w))) AS longest_baseline, max(abs(w)) AS largest_w, 299792458e0 / min(frequency) AS wavelength, max(frequency) AS top FROM fx_vis)))"""


@register("a14_advise", "npixel npixel_power_of_2 npixel_power_of_2_3 vis_slices", "longest_baseline largest_w wavelength synthesised_beam image_fov w_sampling_image w_sampling_primary_beam time_sampling_image freq_sampling_primary_beam", ADVICE.replace("PI", f"{math.pi!r}"))
def _(t: Views) -> DataFrame:
    return vi.advise_wide_field(t("fx_vis"), 35.0)


X = "(chan / 6e0 - 5e-1)"


@register("i07_remove_continuum", KEY, "vis_re", f"SELECT {K}, vis_re - (my + b * ({X} - mx)) AS vis_re FROM fx_vis JOIN (SELECT time, a1, a2, pol, CASE WHEN s1 > 0 THEN sy / s1 ELSE 0 END AS my, CASE WHEN s1 > 0 THEN sx / s1 ELSE 0 END AS mx, CASE WHEN abs(s1 * sxx - sx * sx) > 1e-12 THEN (s1 * sxy - sx * sy) / (s1 * sxx - sx * sx) ELSE 0 END AS b FROM (SELECT time, a1, a2, pol, sum(weight) AS s1, sum(weight * {X}) AS sx, sum(weight * ({X} * {X})) AS sxx, sum(weight * vis_re) AS sy, sum(weight * ({X} * vis_re)) AS sxy FROM fx_vis GROUP BY time, a1, a2, pol)) f USING (time, a1, a2, pol)", grid=4096.0)
def _(t: Views) -> DataFrame:
    return vi.remove_continuum(t("fx_vis"), ["time", "a1", "a2", "pol"], F.col("chan") / 6 - 0.5, "vis_re", F.col("weight"))


# --- functions on rows ------------------------------------------------------------------------------------------------


@register("x01_xyz_at_latitude", "ant", "x y z", "SELECT ant, x, -y * sin(-47e-2) + z * cos(-47e-2) AS y, y * cos(-47e-2) + z * sin(-47e-2) AS z FROM fx_antenna")
def _(t: Views) -> DataFrame:
    x, y, z = co.xyz_at_latitude(F.col("x"), F.col("y"), F.col("z"), -0.47)
    return t("fx_antenna").select("ant", x.alias("x"), y.alias("y"), z.alias("z"))


@register("x02_xyz_to_uvw", "ant", "u v w", "SELECT ant, x * cos(3e-1) - y * sin(3e-1) AS u, z * cos(-5e-1) + (x * sin(3e-1) + y * cos(3e-1)) * sin(-5e-1) AS v, z * sin(-5e-1) - (x * sin(3e-1) + y * cos(3e-1)) * cos(-5e-1) AS w FROM fx_antenna")
def _(t: Views) -> DataFrame:
    u, v, w = co.xyz_to_uvw(F.col("x"), F.col("y"), F.col("z"), F.lit(0.3), F.lit(-0.5))
    return t("fx_antenna").select("ant", u.alias("u"), v.alias("v"), w.alias("w"))


@register("x04_direction_cosines", "comp_id", "l m n", f"SELECT comp_id, {L} AS l, {M} AS m, {N} AS n FROM fx_component")
def _(t: Views) -> DataFrame:
    return sk.to_lm(t("fx_component"), RA0, DEC0)


@register("x05_azimuth_elevation", "comp_id", "az el pa", "SELECT comp_id, atan2(-cos(dec) * sin(ra) + 0e0, sin(dec) * cos(-47e-2) - cos(dec) * cos(ra) * sin(-47e-2)) AS az, asin(sin(-47e-2) * sin(dec) + cos(-47e-2) * cos(dec) * cos(ra)) AS el, atan2(cos(-47e-2) * sin(ra), sin(-47e-2) * cos(dec) - cos(-47e-2) * sin(dec) * cos(ra)) AS pa FROM fx_component")
def _(t: Views) -> DataFrame:
    lat = F.lit(-0.47)
    az, el = co.hadec_to_azel(F.col("ra"), F.col("dec"), lat)
    return t("fx_component").select("comp_id", az.alias("az"), el.alias("el"), co.parallactic_angle(F.col("ra"), F.col("dec"), lat).alias("pa"))


@register("x07_compass_bearing", "comp_id", "bearing", "SELECT comp_id, CASE WHEN d < 0 THEN d + 360 ELSE d END AS bearing FROM (SELECT comp_id, degrees(atan2(sin(ra - 1e-1) * cos(dec), cos(-5e-1) * sin(dec) - sin(-5e-1) * cos(dec) * cos(ra - 1e-1))) AS d FROM fx_component)")
def _(t: Views) -> DataFrame:
    return t("fx_component").select("comp_id", co.compass_bearing(F.lit(DEC0), F.lit(RA0), F.col("dec"), F.col("ra")).alias("bearing"))


def _towards(ra: float, dec: float) -> str:
    """Turns of a row towards a direction, as SQL."""
    l = math.cos(dec) * math.sin(ra - RA0)  # noqa: E741
    m = math.sin(dec) * math.cos(DEC0) - math.cos(dec) * math.sin(DEC0) * math.cos(ra - RA0)
    n = math.sin(dec) * math.sin(DEC0) + math.cos(dec) * math.cos(DEC0) * math.cos(ra - RA0) - 1
    return f"(u * {l!r} + v * {m!r} + w * {n!r})"


TURNS = _towards(RA0 + 0.01, DEC0 - 0.005)


@register("x11_phase_rotate", KEY, "vis_re vis_im", f"SELECT {K}, vis_re * cos({PI2} * {TURNS}) - vis_im * sin({PI2} * {TURNS}) AS vis_re, vis_im * cos({PI2} * {TURNS}) + vis_re * sin({PI2} * {TURNS}) AS vis_im FROM fx_vis")
def _(t: Views) -> DataFrame:
    return vi.phase_rotate(t("fx_vis"), RA0, DEC0, RA0 + 0.01, DEC0 - 0.005)


@register("x12_linear_to_stokes", KEY, "vis_re vis_im", f"SELECT time, a1, a2, chan, unnest([0, 1, 2, 3]) AS pol, unnest([(r0 + r3) / 2, (r0 - r3) / 2, (r1 + r2) / 2, (i1 - i2) / 2]) AS vis_re, unnest([(i0 + i3) / 2, (i0 - i3) / 2, (i1 + i2) / 2, (r2 - r1) / 2]) AS vis_im FROM (SELECT time, a1, a2, chan, {', '.join(f'sum(CASE WHEN pol = {k} THEN vis_{p} ELSE 0 END) AS {n}{k}' for k in range(4) for p, n in (('re', 'r'), ('im', 'i')))} FROM fx_vis GROUP BY time, a1, a2, chan)")
def _(t: Views) -> DataFrame:
    return po.convert_frame(t("fx_vis"), ["time", "a1", "a2", "chan"], "linear", "stokesIQUV")


@register("x13_stokes_i", "time a1 a2 chan", "vis_re vis_im weight", "SELECT time, a1, a2, chan, sum(vis_re) / 2 AS vis_re, sum(vis_im) / 2 AS vis_im, sum(weight) AS weight FROM fx_vis WHERE pol IN (0, 3) GROUP BY time, a1, a2, chan")
def _(t: Views) -> DataFrame:
    return po.to_stokes_i(t("fx_vis"), ["time", "a1", "a2", "chan"])


@register("x17_gaussian_taper", KEY, "imaging_weight", f"SELECT {K}, imaging_weight * exp({-(math.pi**2) * 0.01**2 / (4 * math.log(2))!r} * (u * u + v * v)) AS imaging_weight FROM fx_vis")
def _(t: Views) -> DataFrame:
    return t("fx_vis").withColumn("imaging_weight", F.col("imaging_weight") * wi.gaussian_taper(F.col("u"), F.col("v"), 0.01))


@register("x18_tukey_taper", KEY, "imaging_weight", f"SELECT {K}, imaging_weight * CASE WHEN x < 15e-2 THEN 5e-1 * (1 + cos({2 * math.pi / 0.3!r} * (x - 15e-2))) WHEN x >= 85e-2 THEN 5e-1 * (1 + cos({2 * math.pi / 0.3!r} * (x - 1 + 15e-2))) ELSE 1 END AS imaging_weight FROM (SELECT *, sqrt(u * u + v * v) / (SELECT max(sqrt(u * u + v * v)) FROM fx_vis) AS x FROM fx_vis)")
def _(t: Views) -> DataFrame:
    d = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    v = t("fx_vis").withColumn("d", d)
    rows = v.crossJoin(F.broadcast(v.agg(F.max("d").alias("most"))))
    return rows.withColumn("imaging_weight", F.col("imaging_weight") * wi.tukey(F.col("d") / F.col("most"), 0.3))


@register("x19_thermal_noise", KEY, "sigma", f"SELECT {K}, {1e26 * math.sqrt(2.0) * wi.BOLTZMANN * 200.0!r} / ({math.pi * 35.0 * 35.0 / 4!r} * 78e-2 * sqrt(channel_bandwidth * integration_time)) AS sigma FROM fx_vis")
def _(t: Views) -> DataFrame:
    return t("fx_vis").withColumn("sigma", wi.thermal_noise(F.col("channel_bandwidth"), F.col("integration_time"), F.lit(35.0)))


# --- gridding and imaging -----------------------------------------------------------------------------------------------


@register("g06_grid_fast", "chan pol gv gu", "re im weight", f"SELECT chan, pol, gv, gu, sum(vis_re * imaging_weight) AS re, sum(vis_im * imaging_weight) AS im, sum(imaging_weight) AS weight FROM {CELLS} GROUP BY chan, pol, gv, gu")
def _(t: Views) -> DataFrame:
    return gr.grid_visibility_fast(t("fx_vis"), NPIXEL, CELL)


def _spheroidal(nu: float) -> float:
    if abs(nu) > 1:
        return 0.0
    k, end = (0, 0.75) if abs(nu) < 0.75 else (1, 1.0)
    d = nu * nu - end * end
    return sum(c * d**i for i, c in enumerate(wi.SPHEROIDAL_P[k])) / sum(c * d**i for i, c in enumerate(wi.SPHEROIDAL_Q[k]))


def _kernel(support: int, oversampling: int) -> list[tuple[int, int, float]]:
    """(sub-cell, offset, weight) along one axis."""
    out = []
    for o in range(oversampling):
        x = [abs(s - ((o + 0.5) / oversampling - 0.5)) / (support + 0.5) for s in range(-support, support + 1)]
        k = [max(0.0, (1 - a * a) * _spheroidal(a)) for a in x]
        out += [(o, s, v / sum(k)) for s, v in zip(range(-support, support + 1), k, strict=True)]
    return out


def _kernel_sql(support: int, oversampling: int) -> str:
    return "(VALUES " + ", ".join(f"({o}, {s}, {k!r}e0)" if "e" not in repr(k) else f"({o}, {s}, {k!r})" for o, s, k in _kernel(support, oversampling)) + ")"


def _footprint_sql(support: int, oversampling: int, rows: str = "fx_vis") -> str:
    """Every row with the cells under its kernel and their weights k."""
    sub = lambda c: f"least({oversampling - 1}, floor(({c} + 5e-1) * {oversampling}))"
    at = lambda c: f"({c} * {NPIXEL * CELL!r} + {NPIXEL // 2})"
    near = f"SELECT *, {GU} AS nu, {GV} AS nv, {at('u')} - {GU} AS du, {at('v')} - {GV} AS dv FROM {rows}"
    ker = _kernel_sql(support, oversampling)
    return f"(SELECT * FROM (SELECT c.*, nu + a.s AS gu, nv + b.s AS gv, a.k * b.k AS k FROM (SELECT *, {sub('du')} AS ou, {sub('dv')} AS ov FROM ({near}) WHERE nu >= 0 AND nu < {NPIXEL} AND nv >= 0 AND nv < {NPIXEL}) c JOIN {ker} a(o, s, k) ON a.o = ou JOIN {ker} b(o, s, k) ON b.o = ov) WHERE gu >= 0 AND gu < {NPIXEL} AND gv >= 0 AND gv < {NPIXEL})"


def _gridded_sql(support: int, oversampling: int) -> str:
    return f"SELECT chan, pol, gv, gu, sum(vis_re * (imaging_weight * k)) AS re, sum(vis_im * (imaging_weight * k)) AS im, sum(imaging_weight * k) AS weight FROM {_footprint_sql(support, oversampling)} GROUP BY chan, pol, gv, gu"


def _transform_sql(grid: str, sign: str, n: int = NPIXEL) -> str:
    """The centred transform of a grid (chan, pol, gv, gu, re, im) by lines: (chan, pol, y, x, re, im), not scaled."""
    turn = lambda a, b: f"({sign}{PI2} * ({a} - {n // 2}) * ({b} - {n // 2}) / {n})"

    def along(source: str, keep: str, old: str, new: str) -> str:
        t = turn(old, new)
        return f"SELECT chan, pol, {keep}, {new}, sum(re * cos{t} - im * sin{t}) AS re, sum(re * sin{t} + im * cos{t}) AS im FROM ({source}), (SELECT unnest(range({n})) AS {new}) GROUP BY chan, pol, {keep}, {new}"

    return f"SELECT chan, pol, y, x, re, im FROM ({along(along(grid, 'gv', 'gu', 'x'), 'x', 'gv', 'y')})"


def _correction_sql(support: int, oversampling: int, n: int = NPIXEL) -> str:
    rows = []
    for p in range(n):
        c = sum(k * math.cos(2 * math.pi * (s - ((o + 0.5) / oversampling - 0.5)) * (p - n // 2) / n) for o, s, k in _kernel(support, oversampling)) / oversampling
        rows.append(f"({p}, {c!r})")
    return "(VALUES " + ", ".join(rows) + ")"


@register("g05_grid_kernel", "chan pol gv gu", "re im weight", _gridded_sql(3, 8), grid=64.0)
def _(t: Views) -> DataFrame:
    v = t("fx_vis")
    return gr.grid_visibility(v, gr.spheroidal_kernel(v.sparkSession, 3, 8), NPIXEL, CELL, 8)


FAST = f"SELECT chan, pol, gv, gu, sum(vis_re * imaging_weight) AS re, sum(vis_im * imaging_weight) AS im, sum(imaging_weight) AS weight FROM {CELLS} GROUP BY chan, pol, gv, gu"


def _every_row(found: str, *figures: str) -> str:
    """All rows of fx_vis with ``figures`` of those that ``found`` answers, 0 for the others."""
    return f"SELECT {K}, {', '.join(f'coalesce({c}, 0e0) AS {c}' for c in figures)} FROM fx_vis LEFT JOIN ({found}) found USING ({K})"


@register("g07_degrid", KEY, "vis_re vis_im", _every_row(f"SELECT f.time, a1, a2, f.chan, f.pol, sum(re * k) AS d_re, sum(im * k) AS d_im FROM {_footprint_sql(2, 4)} f JOIN ({FAST}) g ON g.chan = f.chan AND g.pol = f.pol AND g.gv = f.gv AND g.gu = f.gu GROUP BY f.time, a1, a2, f.chan, f.pol", "d_re", "d_im").replace("AS d_", "AS vis_", 2), grid=64.0)
def _(t: Views) -> DataFrame:
    v = t("fx_vis")
    return gr.degrid_visibility(v, gr.grid_visibility_fast(v, NPIXEL, CELL), NPIXEL, CELL, support=2, oversampling=4)


@register("g08_uniform_weights", KEY, "imaging_weight", f"SELECT {K}, CASE WHEN d <> 0 THEN imaging_weight / d ELSE imaging_weight END AS imaging_weight FROM {CELLS} c JOIN (SELECT pol AS p, gv AS y, gu AS x, sum(imaging_weight) AS d FROM {CELLS} GROUP BY pol, gv, gu) ON pol = p AND gv = y AND gu = x")
def _(t: Views) -> DataFrame:
    return gr.weight_uniform(t("fx_vis"), NPIXEL, CELL)


@register("g13_invert", "chan pol y x", "value", f"SELECT i.chan, i.pol, y, x, CASE WHEN total > 0 THEN re / total ELSE 0 END AS value FROM ({_transform_sql(FAST, '')}) i JOIN (SELECT chan, pol, sum(weight) AS total FROM ({FAST}) GROUP BY chan, pol) t ON t.chan = i.chan AND t.pol = i.pol", grid=1024.0)
def _(t: Views) -> DataFrame:
    return gr.invert(t("fx_vis"), NPIXEL, CELL)


@register("g17_direct_image", "chan pol y x", "value", f"SELECT chan, pol, y, x, CASE WHEN sum(imaging_weight) > 0 THEN sum(imaging_weight * (vis_re * cos({PI2} * turns) - vis_im * sin({PI2} * turns))) / sum(imaging_weight) ELSE 0 END AS value FROM (SELECT *, u * (x - 4) * 1e-2 + v * (y - 4) * 1e-2 AS turns FROM fx_vis, (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x)) GROUP BY chan, pol, y, x")
def _(t: Views) -> DataFrame:
    return gr.direct_image(t("fx_vis"), 8, 0.01)


@register("d02_hogbom", "chan pol y x", "model residual")
def _(t: Views) -> DataFrame:
    v = t("fx_vis")
    return cl.clean(gr.invert(v, 32, 2 * CELL), gr.invert(v, 32, 2 * CELL, psf=True))


# --- images ----------------------------------------------------------------------------------------------------------


@register("i01_normalise", "chan pol y x", "value", "SELECT chan, pol, y, x, value / (chan + 2) AS value FROM fx_pixel")
def _(t: Views) -> DataFrame:
    p = t("fx_pixel")
    return im.normalise(p, p.select("chan", "pol", (F.col("chan") + 2.0).alias("weight")).distinct())


@register("i03_add_images", "chan pol y x", "value", "SELECT chan, pol, y, x, sum(value) AS value FROM (SELECT * FROM fx_pixel UNION ALL SELECT chan, pol, x AS y, y AS x, value FROM fx_pixel) GROUP BY chan, pol, y, x")
def _(t: Views) -> DataFrame:
    p = t("fx_pixel")
    return im.add_images(p, p.select("chan", "pol", F.col("x").alias("y"), F.col("y").alias("x"), "value"))


GK = ", ".join(f"({d}, {math.exp(-d * d / 4.5)!r}e0)" for d in range(-6, 7))


@register("i04_smooth", "chan pol y x", "value", f"SELECT p.chan, p.pol, p.y, p.x, sum(q.value * a.k * b.k) AS value FROM fx_pixel p JOIN (VALUES {GK}) a(d, k) ON true JOIN (VALUES {GK}) b(d, k) ON true JOIN fx_pixel q ON q.chan = p.chan AND q.pol = p.pol AND q.y = p.y + a.d AND q.x = p.x + b.d GROUP BY p.chan, p.pol, p.y, p.x")
def _(t: Views) -> DataFrame:
    return im.smooth(t("fx_pixel"), 1.5)


FREQ = "1e8 + chan * 1e6"


@register("i05_frequency_moments", "moment pol y x", "value", f"SELECT k AS moment, pol, y, x, sum(value * pow(({FREQ} - 50e6) / 50e6, k)) AS value FROM fx_pixel, (SELECT unnest([0, 1, 2]) AS k) GROUP BY k, pol, y, x")
def _(t: Views) -> DataFrame:
    return im.frequency_moments(t("fx_pixel"), 1e8 + F.col("chan") * 1e6, 50e6, 3)


@register("i08_facets", "chan pol y x fy fx", "value", "SELECT chan, pol, y, x, fy, fx, value FROM fx_pixel, (SELECT unnest(range(4)) AS fy), (SELECT unnest(range(4)) AS fx) WHERE y >= fy * 16 - 4 AND y < fy * 16 + 20 AND x >= fx * 16 - 4 AND x < fx * 16 + 20")
def _(t: Views) -> DataFrame:
    return im.scatter_facets(t("fx_pixel"), 64, 4, 4)


@register("p01_map_facets", "chan pol y x", "value", "SELECT chan, pol, y, x, value * 2 + 1 AS value FROM fx_pixel")
def _(t: Views) -> DataFrame:
    return im.map_facets(t("fx_pixel"), lambda pdf: pdf.assign(value=pdf["value"] * 2 + 1), 64, 2, 4)


@register("i09_channel_slabs", "slab", "value pixels", "SELECT least(1, floor(chan / 2)) AS slab, sum(value) AS value, count(*) AS pixels FROM fx_pixel GROUP BY 1")
def _(t: Views) -> DataFrame:
    return im.channel_slabs(t("fx_pixel"), 5, 2).groupBy("slab").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("pixels"))


@register("i11_insert_components", "chan pol y x", "value", f"SELECT chan, pol, y, x, sum(value) AS value FROM (SELECT * FROM fx_pixel UNION ALL SELECT 0, 0, y, x, flux0 FROM (SELECT floor(32 + {M} / 5e-3 + 5e-1) AS y, floor(32 - ({L}) / 5e-3 + 5e-1) AS x, flux0 FROM fx_component) WHERE y >= 0 AND y < 64 AND x >= 0 AND x < 64) GROUP BY chan, pol, y, x")
def _(t: Views) -> DataFrame:
    c = sk.to_lm(t("fx_component"), RA0, DEC0).select(F.lit(0).alias("chan"), F.lit(0).alias("pol"), "l", "m", F.col("flux0").alias("flux"))
    return im.insert_components(t("fx_pixel"), c, 64, 0.005)


@register("f11_window_quarter", "chan pol y x", "mask", "SELECT chan, pol, y, x, CASE WHEN y >= 16 AND y < 48 AND x >= 16 AND x < 48 THEN 1 ELSE 0 END AS mask FROM fx_pixel")
def _(t: Views) -> DataFrame:
    return im.window_mask(t("fx_pixel"), "quarter", 64)


@register("f11_window_threshold", "chan pol y x", "mask", "SELECT chan, pol, y, x, CASE WHEN value > 2 * (SELECT stddev_pop(value) FROM fx_pixel) THEN 1 ELSE 0 END AS mask FROM fx_pixel")
def _(t: Views) -> DataFrame:
    return im.window_mask(t("fx_pixel"), "threshold", 64, threshold=2.0)


@register("a08_image_quality", "", "max min maxabs std sum median medianabs madmed", "SELECT max(value) AS max, min(value) AS min, max(abs(value)) AS maxabs, stddev_pop(value) AS std, sum(value) AS sum, median(value) AS median, median(abs(value)) AS medianabs, median(abs(value - (SELECT median(value) FROM fx_pixel))) AS madmed FROM fx_pixel")
def _(t: Views) -> DataFrame:
    return im.statistics(t("fx_pixel"))


@register("w04_gradients", "chan pol y x", "gx gy", "SELECT chan, pol, y, x, coalesce(value - lag(value) OVER (PARTITION BY chan, pol, y ORDER BY x), 0) AS gx, coalesce(value - lag(value) OVER (PARTITION BY chan, pol, x ORDER BY y), 0) AS gy FROM fx_pixel")
def _(t: Views) -> DataFrame:
    return im.gradients(t("fx_pixel"))


CENTRES = "SELECT ant AS id, (ant * 7) % 64 AS cy, (ant * 13) % 64 AS cx FROM fx_antenna"


@register("i13_voronoi", "chan pol y x model_id", "value", f"SELECT chan, pol, p.y, p.x, value, model_id FROM fx_pixel p JOIN (SELECT y, x, id AS model_id FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY (y - cy) * (y - cy) + (x - cx) * (x - cx), id) AS r FROM (SELECT DISTINCT y, x FROM fx_pixel), ({CENTRES})) WHERE r = 1) n ON n.y = p.y AND n.x = p.x")
def _(t: Views) -> DataFrame:
    c = t("fx_antenna").select(F.col("ant").alias("id"), (F.col("ant") * 7 % 64).alias("cy"), (F.col("ant") * 13 % 64).alias("cx"))
    return im.voronoi(t("fx_pixel"), c)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    total = repr(coefficients[-1])
    for c in coefficients[-2::-1]:
        total = f"({total} * {x} + {c!r}::DOUBLE)"
    return total


def _disk_sql(r: str) -> str:
    """2 J1(r) / r of a column."""
    t = f"(3e0 / greatest({r}, 3e0))"
    return f"CASE WHEN {r} < 3e0 THEN 2 * {_horner(be.J1_NEAR, f'({r} * {r} / 9e0)')} ELSE 2 * {_horner(be.J1_MODULUS, t)} * cos({r} + {_horner(be.J1_PHASE, t)}) / ({r} * sqrt({r})) END"


@register("i16_mosaic_beam", "chan pol y x", "value", f"SELECT chan, pol, p.y, p.x, s AS value FROM fx_pixel p JOIN (SELECT y, x, sqrt(sum(v * v * (v * v))) AS s FROM (SELECT y, x, {_disk_sql('r')} AS v FROM (SELECT y, x, sqrt((y - py) * (y - py) + (x - px) * (x - px)) * 7e-1 AS r FROM (SELECT DISTINCT y, x FROM fx_pixel), (SELECT (ant * 7) % 64 AS py, (ant * 13) % 64 AS px FROM fx_antenna))) GROUP BY y, x) b ON b.y = p.y AND b.x = p.x")
def _(t: Views) -> DataFrame:
    c = t("fx_antenna").select((F.col("ant") * 7 % 64).alias("py"), (F.col("ant") * 13 % 64).alias("px"))
    return be.mosaic_beam(t("fx_pixel"), c, 0.7)


_VLA = f"(1e8 + chan * 1e6) / {be.C!r}"


@register("i15_primary_beam", "chan pol y x", "value", f"SELECT chan, pol, y, x, pow({_disk_sql('d')} - {(1.8 / 25.0) ** 2!r} * {_disk_sql('b')}, 2) AS value FROM (SELECT *, r * {math.pi * 25.0!r} * {_VLA} AS d, r * {math.pi * 1.8!r} * {_VLA} AS b FROM (SELECT *, sqrt((y - 32) * (y - 32) + (x - 32) * (x - 32)) * 45e-3 AS r FROM fx_pixel))")
def _(t: Views) -> DataFrame:
    return be.primary_beam(t("fx_pixel"), 64, 0.045, 1e8 + F.col("chan") * 1e6, "VLA")


@register("i15_tapered_beam", "chan pol y x", "value")
def _(t: Views) -> DataFrame:
    return be.tapered_beam(t("fx_pixel"), 64, 0.01, 1e8 + F.col("chan") * 1e6, 15.0)


LABELLED = """WITH RECURSIVE cell AS (SELECT pol, y, x, avg(value) AS value FROM fx_pixel GROUP BY pol, y, x HAVING avg(value) > 45e-1),
  reach AS (SELECT pol, y, x, y AS ry, x AS rx FROM cell UNION SELECT r.pol, r.y, r.x, c.y, c.x FROM reach r JOIN cell c ON c.pol = r.pol AND abs(c.y - r.ry) <= 1 AND abs(c.x - r.rx) <= 1),
  named AS (SELECT pol, y, x, min((pol * 268435456 + ry) * 268435456 + rx) AS label FROM reach GROUP BY pol, y, x)
  SELECT pol, y, x, value, label FROM cell JOIN named USING (pol, y, x)"""


@register("i12_find_sources", "pol source_id pixels", "y x peak flux", f"SELECT pol, label AS source_id, count(*) AS pixels, sum(y * value) / sum(value) AS y, sum(x * value) / sum(value) AS x, max(value) AS peak, sum(value) AS flux FROM ({LABELLED}) GROUP BY pol, label HAVING count(*) >= 3")
def _(t: Views) -> DataFrame:
    return im.find_sources(t("fx_pixel"), 4.5, 3)


@register("i12_source_spectra", "pol source_id chan", "flux", f"SELECT pol, label AS source_id, chan, max(p.value) AS flux FROM fx_pixel p JOIN (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM ({LABELLED})) c USING (pol, y, x) WHERE n >= 3 GROUP BY pol, label, chan")
def _(t: Views) -> DataFrame:
    return im.source_spectra(t("fx_pixel"), 4.5, 3)


@register("d01_clean_threshold", "", "threshold", "SELECT greatest(max(abs(value)) * 1e-1, 1e-2) AS threshold FROM (SELECT avg(value) AS value FROM fx_pixel GROUP BY pol, y, x)")
def _(t: Views) -> DataFrame:
    return im.clean_threshold(t("fx_pixel"), 0.1, 0.01)


# --- calibration -------------------------------------------------------------------------------------------------------

@register("c02_point_ratios", "slot a1 a2 chan pol", "x_re x_im weight", "SELECT slot, a1, a2, chan, pol, CASE WHEN wt > 0 THEN sr / wt ELSE 0 END AS x_re, CASE WHEN wt > 0 THEN si / wt ELSE 0 END AS x_im, wt AS weight FROM (SELECT floor(time / 16e1) AS slot, a1, a2, chan, pol, sum(weight * (vis_re * m_re + vis_im * m_im)) AS sr, sum(weight * (vis_im * m_re - vis_re * m_im)) AS si, sum(weight * (m_re * m_re + m_im * m_im)) AS wt FROM fx_vis JOIN fx_model USING (time, a1, a2, chan, pol) GROUP BY floor(time / 16e1), a1, a2, chan, pol)")
def _(t: Views) -> DataFrame:
    return ca.point_ratios(t("fx_vis"), t("fx_model"), 160.0)


def _held(t: Views, name: str = "fx_vis") -> DataFrame:
    """A view that is read more than once, so that it is made of its tables once; averaged samples are far fewer than their rows."""
    return ca.materialize(t(name))


def _corrupted(t: Views) -> tuple[DataFrame, DataFrame]:
    """(the model with gains applied, the model)."""
    model = _held(t, "fx_model")
    as_vis = model.select(*vi.KEY, F.col("m_re").alias("vis_re"), F.col("m_im").alias("vis_im"), F.lit(1.0).alias("weight"))
    return ca.materialize(jo.apply_gains(as_vis, jo.gains_of(t("fx_gain"), model), interval=160.0, first=75.0)), model


@register("c03_solve_gains", "slot chan feed ant", "g_re g_im")
def _(t: Views) -> DataFrame:
    return ca.solve_gains(ca.point_ratios(*_corrupted(t), 160.0), 15)


@register("c04_gain_residual", "slot chan", "residual")
def _(t: Views) -> DataFrame:
    ratios = ca.point_ratios(*_corrupted(t), 160.0)
    return ca.gain_residual(ratios, ca.solve_gains(ratios, 15))


@register("c01_gain_intervals", "time ant chan", "interval g_re weight", "SELECT t AS time, ant, chan, 16e1 AS interval, 1 AS g_re, 1 AS weight FROM (SELECT DISTINCT lo + 16e1 * round((time - lo) / 16e1) AS t FROM fx_vis, (SELECT min(time) AS lo FROM fx_vis)), fx_antenna, (SELECT DISTINCT chan FROM fx_vis)")
def _(t: Views) -> DataFrame:
    return ca.gain_intervals(t("fx_vis"), t("fx_antenna"), 160.0)


@register("a07_gain_quality", "", "amp_max amp_min amp_std amp_median phase_max phase_min phase_std phase_median", "SELECT max(a) AS amp_max, min(a) AS amp_min, stddev_pop(a) AS amp_std, median(a) AS amp_median, max(p) AS phase_max, min(p) AS phase_min, stddev_pop(p) AS phase_std, median(p) AS phase_median FROM (SELECT sqrt(g_re * g_re + g_im * g_im) AS a, atan2(g_im, g_re) AS p FROM fx_gain WHERE weight > 0)")
def _(t: Views) -> DataFrame:
    return ca.gain_quality(t("fx_gain"))


@register("c12_station_correlations", "time chan a1 a2", "re im", "SELECT a.time, a.chan, a.ant AS a1, b.ant AS a2, a.s_re * b.s_re + a.s_im * b.s_im AS re, a.s_im * b.s_re - a.s_re * b.s_im AS im FROM fx_signal a JOIN fx_signal b ON a.time = b.time AND a.chan = b.chan AND b.ant >= a.ant")
def _(t: Views) -> DataFrame:
    return ca.station_correlations(t("fx_signal"))


# --- sky models ---------------------------------------------------------------------------------------------------------


@register("m02_remove_neighbours", "comp_id", "flux0")
def _(t: Views) -> DataFrame:
    return sk.remove_neighbours(t("fx_component"), 0.003, "flux0")


@register("m03_partition_by_flux", "comp_id bright", "flux0", "SELECT comp_id, flux0, CASE WHEN flux0 >= 14e-1 THEN 1 ELSE 0 END AS bright FROM fx_component")
def _(t: Views) -> DataFrame:
    bright, weak = sk.partition_by_flux(t("fx_component"), F.col("flux0"), 1.4)
    return bright.withColumn("bright", F.lit(1)).unionByName(weak.withColumn("bright", F.lit(0)))


MODELS = "SELECT *, 0 AS model_id FROM fx_mask UNION ALL SELECT chan, pol, y, x, value * 2, 1 - mask AS mask, 1 FROM fx_mask"


def _models(t: Views) -> DataFrame:
    m = t("fx_mask")
    return m.withColumn("model_id", F.lit(0)).unionByName(m.withColumns({"value": F.col("value") * 2, "mask": 1 - F.col("mask"), "model_id": F.lit(1)}))


@register("m04_equivalent_image", "chan pol y x", "value", f"SELECT chan, pol, y, x, sum(mask * value) AS value FROM ({MODELS}) GROUP BY chan, pol, y, x")
def _(t: Views) -> DataFrame:
    return sk.equivalent_image(_models(t))


@register("m05_update_from_image", "model_id chan pol y x", "value", f"SELECT model_id, chan, pol, y, x, m.value + 5e-1 * mask * p.value AS value FROM ({MODELS}) m JOIN (SELECT chan, pol, y, x, value FROM fx_pixel) p USING (chan, pol, y, x)")
def _(t: Views) -> DataFrame:
    return sk.update_from_image(_models(t), t("fx_pixel"), 0.5)


@register("m06_update_from_gains", "time ant chan", "g_re g_im", "SELECT time, ant, chan, g_re * cos(a) - g_im * sin(a) AS g_re, g_re * sin(a) + g_im * cos(a) AS g_im FROM (SELECT *, 5e-1 * atan2(g_im, g_re) AS a FROM fx_gain)")
def _(t: Views) -> DataFrame:
    return sk.update_from_gains(t("fx_gain"), t("fx_gain"), 0.5)


@register("m10_cross_subtract", "model_id " + KEY, "vis_re vis_im", f"SELECT model_id, {K}, vis_re - (sum(m_re) OVER w - m_re) AS vis_re, vis_im - (sum(m_im) OVER w - m_im) AS vis_im FROM (SELECT *, 0 AS model_id FROM fx_model UNION ALL SELECT {K}, m_re / 2, m_im * 3, 1 FROM fx_model) JOIN (SELECT {K}, vis_re, vis_im FROM fx_vis) v USING ({K}) WINDOW w AS (PARTITION BY {K})")
def _(t: Views) -> DataFrame:
    m = t("fx_model")
    models = m.withColumn("model_id", F.lit(0)).unionByName(m.withColumns({"m_re": F.col("m_re") / 2, "m_im": F.col("m_im") * 3, "model_id": F.lit(1)}))
    return jo.cross_subtract(models, t("fx_vis"))


# --- windows of a stream, over the table of its rows ----------------------------------------------------------------------


@register("t01_window_ratios", "day a1 a2", "x_re x_im weight", "SELECT epoch(date_trunc('day', ts)) / 86400 AS day, a1, a2, sum(x_re * weight) / sum(weight) AS x_re, sum(x_im * weight) / sum(weight) AS x_im, sum(weight) AS weight FROM fx_stream GROUP BY 1, a1, a2")
def _(t: Views) -> DataFrame:
    rows = st.window_ratios(t("fx_stream").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.withColumn("day", F.unix_date(F.col("start").cast("date")))


@register("t02_antenna_power", "day ant samples", "power", "SELECT epoch(date_trunc('day', ts)) / 86400 AS day, ant, count(*) AS samples, avg(x_re * x_re + x_im * x_im) AS power FROM (SELECT *, unnest([a1, a2]) AS ant FROM fx_stream) GROUP BY 1, ant")
def _(t: Views) -> DataFrame:
    rows = st.antenna_power(t("fx_stream").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.withColumn("day", F.unix_date(F.col("start").cast("date")))


# --- further rows, grids and images ------------------------------------------------------------------------------------


@register("f07_above_elevation", "comp_id", "ra dec", "SELECT comp_id, ra, dec FROM fx_component WHERE asin(sin(-47e-2) * sin(dec) + cos(-47e-2) * cos(dec) * cos(ra)) > 14e-1")
def _(t: Views) -> DataFrame:
    return vi.above_elevation(t("fx_component"), F.col("ra"), F.col("dec"), -0.47, 1.4)


@register("a02_to_wavelengths", KEY, "u v w", f"SELECT {K}, u * frequency / 299792458e0 AS u, v * frequency / 299792458e0 AS v, w * frequency / 299792458e0 AS w FROM fx_vis")
def _(t: Views) -> DataFrame:
    return vi.to_wavelengths(t("fx_vis"))


@register("x09_shift", KEY, "vis_re vis_im", f"SELECT {K}, vis_re * cos({PI2} * a) + vis_im * sin({PI2} * a) AS vis_re, vis_im * cos({PI2} * a) - vis_re * sin({PI2} * a) AS vis_im FROM (SELECT *, u * 3e-3 + v * -2e-3 AS a FROM fx_vis)")
def _(t: Views) -> DataFrame:
    return vi.shift(t("fx_vis"), 0.003, -0.002)


@register("x10_transform_uv", KEY, "u v", f"SELECT {K}, 8e-1 * (u - w * 1e-2) + 1e-1 * (v - w * 2e-2) AS u, -1e-1 * (u - w * 1e-2) + 9e-1 * (v - w * 2e-2) AS v FROM fx_vis")
def _(t: Views) -> DataFrame:
    return vi.transform_uv(t("fx_vis"), ((0.8, 0.1), (-0.1, 0.9)), 0.01, 0.02)


@register("x16_frequency_map", KEY + " image_chan", "frequency", f"SELECT {K}, frequency, dense_rank() OVER (ORDER BY round(frequency)) - 1 AS image_chan FROM fx_vis")
def _(t: Views) -> DataFrame:
    return vi.frequency_map(t("fx_vis"), 7)


@register("w05_running_mean", KEY, "mean_re", f"SELECT {K}, avg(vis_re) OVER (PARTITION BY a1, a2, chan, pol ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean_re FROM fx_vis")
def _(t: Views) -> DataFrame:
    return vi.running_mean(t("fx_vis"), 5)


@register("u04_scatter_gather", KEY + " slice", "vis_re", f"SELECT {K}, least(2, floor((time - lo) / ((hi - lo) / 2) + 5e-1)) AS slice, vis_re FROM fx_vis, (SELECT min(time) AS lo, max(time) AS hi FROM fx_vis)")
def _(t: Views) -> DataFrame:
    return vi.scatter(t("fx_vis"), 3)


@register("g09_weights_both_halves", "pol gv gu", "weight", f"SELECT pol, gv, gu, sum(imaging_weight) AS weight FROM (SELECT pol, imaging_weight, {GU.replace('(u', '(s * u')} AS gu, {GV.replace('(v', '(s * v')} AS gv FROM fx_vis, (SELECT unnest([1, -1]) AS s)) WHERE gu >= 0 AND gu < {NPIXEL} AND gv >= 0 AND gv < {NPIXEL} GROUP BY pol, gv, gu")
def _(t: Views) -> DataFrame:
    return gr.grid_weights_both_halves(t("fx_vis"), NPIXEL, CELL)


@register("j10_apply_beam", "comp_id chan y x", "flux", f"SELECT comp_id, chan, c.y, c.x, flux0 * value AS flux FROM (SELECT comp_id, flux0, floor(32 + {M} / 5e-3 + 5e-1) AS y, floor(32 - ({L}) / 5e-3 + 5e-1) AS x FROM fx_component) c JOIN fx_pixel p ON p.y = c.y AND p.x = c.x")
def _(t: Views) -> DataFrame:
    c = sk.to_lm(t("fx_component"), RA0, DEC0).select("comp_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("chan"), F.lit(0).alias("pol"), "l", "m", F.col("flux0").alias("flux"))
    return jo.apply_beam(c, t("fx_pixel"), 64, 0.005)


@register("i06_from_moments", "chan pol y x", "value", f"SELECT c.chan, pol, y, x, sum(value * pow((1e8 + c.chan * 1e6 - 5e7) / 5e7, k)) AS value FROM (SELECT k, pol, y, x, sum(value * pow(({FREQ} - 50e6) / 50e6, k)) AS value FROM fx_pixel, (SELECT unnest([0, 1, 2]) AS k) GROUP BY k, pol, y, x), (SELECT unnest(range(5)) AS chan) c GROUP BY c.chan, pol, y, x")
def _(t: Views) -> DataFrame:
    p = t("fx_pixel")
    channels = p.sparkSession.range(5).select(F.col("id").alias("chan"), (1e8 + F.col("id") * 1e6).alias("frequency"))
    return im.from_frequency_moments(im.frequency_moments(p, 1e8 + F.col("chan") * 1e6, 50e6, 3), channels, 50e6)


@register("i14_resample", "chan pol y x", "value footprint", "SELECT chan, pol, n.y, n.x, sum(value * wt) AS value, sum(wt) AS footprint FROM (SELECT y, x, floor(y0) + a AS oy, floor(x0) + b AS ox, (1 - abs(y0 - floor(y0) - a)) * (1 - abs(x0 - floor(x0) - b)) AS wt FROM (SELECT y, x, y * 75e-2 + 25e-2 AS y0, x * 75e-2 + 5e-1 AS x0 FROM (SELECT unnest(range(48)) AS y), (SELECT unnest(range(48)) AS x)), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)) n JOIN fx_pixel p ON p.y = oy AND p.x = ox WHERE wt > 0 GROUP BY chan, pol, n.y, n.x")
def _(t: Views) -> DataFrame:
    return im.resample(t("fx_pixel"), 0.25, 0.5, 0.75, 48)


@register("i17_restore", "chan pol y x", "value", f"SELECT p.chan, p.pol, p.y, p.x, p.value / 10 + coalesce(s.value, 0) AS value FROM fx_pixel p LEFT JOIN (SELECT p.chan, p.pol, p.y, p.x, sum(q.value * a.k * b.k) AS value FROM fx_pixel p JOIN (VALUES {GK}) a(d, k) ON true JOIN (VALUES {GK}) b(d, k) ON true JOIN (SELECT * FROM fx_pixel WHERE value > 3) q ON q.chan = p.chan AND q.pol = p.pol AND q.y = p.y + a.d AND q.x = p.x + b.d GROUP BY p.chan, p.pol, p.y, p.x) s ON s.chan = p.chan AND s.pol = p.pol AND s.y = p.y AND s.x = p.x")
def _(t: Views) -> DataFrame:
    p = t("fx_pixel")
    return im.restore(p.where("value > 3"), p.withColumn("value", F.col("value") / 10), 1.5)


@register("t03_sliding_counts", "day a1 a2 samples", "", "SELECT epoch(date_trunc('day', ts)) / 86400 - o AS day, a1, a2, count(*) AS samples FROM fx_stream, (SELECT unnest([0, 1]) AS o) GROUP BY 1, a1, a2")
def _(t: Views) -> DataFrame:
    rows = st.sliding_counts(t("fx_stream").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.withColumn("day", F.unix_date(F.col("start").cast("date")))


@register("t03_scans", "second a1 samples", "", "SELECT floor(epoch(min(ts))) AS second, a1, count(*) AS samples FROM (SELECT *, sum(fresh) OVER (PARTITION BY a1 ORDER BY ts) AS scan FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY a1 ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM fx_stream)) GROUP BY a1, scan")
def _(t: Views) -> DataFrame:
    return st.scans(t("fx_stream").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("second", F.unix_seconds("start"))


# --- screens and models ---------------------------------------------------------------------------------------------------

PIERCED = f"""SELECT comp_id, ant, pu - avg(pu) OVER (PARTITION BY comp_id) + 3e5 * l AS px, pv - avg(pv) OVER (PARTITION BY comp_id) + 3e5 * m AS py
    FROM (SELECT comp_id, ant, x * cos(ra) - y * sin(ra) AS pu, z * cos(dec) + (x * sin(ra) + y * cos(ra)) * sin(dec) AS pv, {L} AS l, {M} AS m FROM fx_target, fx_antenna)"""


def _points(t: Views) -> DataFrame:
    return sc.pierce_points(t("fx_antenna"), t("fx_target"), 3e5, RA0, DEC0)


@register("i20_pierce_points", "comp_id ant", "px py", PIERCED)
def _(t: Views) -> DataFrame:
    return _points(t)


@register("i18_grid_gains_to_screen", "time sy sx", "value weight", f"SELECT g.time, sy, sx, CASE WHEN sum(weight) > 0 THEN sum(weight * (1e8 + chan * 1e6) / -8.44797245e9 * atan2(g_im, g_re)) / sum(weight) ELSE 0 END AS value, sum(weight) AS weight FROM (SELECT ant, floor(px / 4e3 + 32) AS sx, floor(py / 4e3 + 32) AS sy FROM ({PIERCED})) p JOIN fx_gain g USING (ant) WHERE sx >= 0 AND sx < 64 AND sy >= 0 AND sy < 64 GROUP BY g.time, sy, sx")
def _(t: Views) -> DataFrame:
    return sc.grid_gains_through(t("fx_antenna"), t("fx_target"), t("fx_gain"), 1e8 + F.col("chan") * 1e6, 3e5, RA0, DEC0, 4e3, 64)


@register("i20_sample_screen", "comp_id ant", "g_re g_im", f"SELECT comp_id, ant, cos(a) AS g_re, sin(a) AS g_im FROM (SELECT comp_id, ant, coalesce(value, 0) * -8.44797245e1 AS a FROM (SELECT comp_id, ant, floor(px / 4e3 + 32) AS sx, floor(py / 4e3 + 32) AS sy FROM ({PIERCED})) p LEFT JOIN (SELECT y, x, sum(value) AS value FROM fx_pixel GROUP BY y, x) s ON s.y = p.sy AND s.x = p.sx)")
def _(t: Views) -> DataFrame:
    return sc.sample_screen(_points(t), t("fx_pixel").groupBy("y", "x").agg(F.sum("value").alias("value")), 1e8, 4e3, 64)


@register("m08_predict_models", "model_id " + KEY, "m_re m_im", f"SELECT model_id, {K}, sum({FLUX} * cos({PI2} * turns)) AS m_re, -sum({FLUX} * sin({PI2} * turns)) AS m_im FROM (SELECT *, u * {L} + v * {M} + w * {N} AS turns, comp_id % 2 AS model_id FROM fx_vis, fx_target) GROUP BY model_id, {K}")
def _(t: Views) -> DataFrame:
    spectrum = F.pow(F.col("frequency") / 1e8, F.lit(-0.7))
    return sk.predict_models(t("fx_vis"), t("fx_target").withColumn("model_id", F.col("comp_id") % 2), RA0, DEC0, spectrum)


@register("m07_expand_by_component", "comp_id model_id", "flux0", "SELECT comp_id, row_number() OVER (ORDER BY comp_id) AS model_id, flux0 FROM fx_component")
def _(t: Views) -> DataFrame:
    return sk.expand_by_component(t("fx_component"))


def _disk_beam(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A beam for kernels: a Gaussian of about that of a 35 m dish at 100 MHz."""
    return np.exp(-(x * x + y * y) / (2 * 0.04**2))


# --- imaging with kernels, w stacks, slices and facets --------------------------------------------------------------------

KSUP, KOVER = 3, 16
GRIDDED = _gridded_sql(KSUP, KOVER)
CORR = _correction_sql(KSUP, KOVER)


@register("g13_invert_kernel", "chan pol y x", "value", f"SELECT i.chan, i.pol, y, x, CASE WHEN total > 0 THEN re / (cy.c * cx.c) / total ELSE 0 END AS value FROM ({_transform_sql(GRIDDED, '')}) i JOIN (SELECT chan, pol, sum(weight) AS total FROM ({GRIDDED}) GROUP BY chan, pol) t ON t.chan = i.chan AND t.pol = i.pol JOIN {CORR} cy(p, c) ON cy.p = y JOIN {CORR} cx(p, c) ON cx.p = x", grid=1024.0)
def _(t: Views) -> DataFrame:
    return ig.invert(t("fx_vis"), NPIXEL, CELL)


IMAGE_CELLS = f"SELECT chan, pol, y AS gv, x AS gu, value / (cy.c * cx.c) AS re, 0e0 AS im FROM fx_pixel JOIN {CORR} cy(p, c) ON cy.p = y JOIN {CORR} cx(p, c) ON cx.p = x"


@register("g14_predict", KEY, "m_re m_im", _every_row(f"SELECT f.time, a1, a2, f.chan, f.pol, sum(re * k) AS m_re, sum(im * k) AS m_im FROM {_footprint_sql(KSUP, KOVER)} f JOIN ({_transform_sql(IMAGE_CELLS, '-')}) g ON g.chan = f.chan AND g.pol = f.pol AND g.y = f.gv AND g.x = f.gu GROUP BY f.time, a1, a2, f.chan, f.pol", "m_re", "m_im"), grid=64.0)
def _(t: Views) -> DataFrame:
    return ig.predict(t("fx_vis"), t("fx_pixel"), NPIXEL, CELL)


@register("g15_wstack_invert", "chan pol y x", "value")
def _(t: Views) -> DataFrame:
    return ig.wstack_invert(t("fx_vis"), 32, 2 * CELL, 10.0)


@register("g15_wstack_predict", KEY, "m_re m_im")
def _(t: Views) -> DataFrame:
    return ig.wstack_predict(t("fx_vis"), t("fx_pixel"), NPIXEL, CELL, 20.0)


@register("g02_w_projection_invert", "chan pol y x", "value")
def _(t: Views) -> DataFrame:
    return ig.aw_invert(t("fx_vis"), 32, 2 * CELL, 10.0)


@register("g02_aw_projection_invert", "chan pol y x", "value")
def _(t: Views) -> DataFrame:
    return ig.aw_invert(t("fx_vis"), 32, 2 * CELL, 10.0, beam=_disk_beam)


@register("g02_w_projection_predict", KEY, "m_re m_im")
def _(t: Views) -> DataFrame:
    return ig.aw_predict(t("fx_vis"), t("fx_pixel"), NPIXEL, CELL, 10.0)


@register("g04_cells_with_w", KEY + " gu gv ou ov w_plane", "", f"SELECT {K}, gu, gv, least(7, floor((u * {NPIXEL * CELL!r} + {NPIXEL // 2} - gu + 5e-1) * 8)) AS ou, least(7, floor((v * {NPIXEL * CELL!r} + {NPIXEL // 2} - gv + 5e-1) * 8)) AS ov, round_even(w / 73e-1, 0) AS w_plane FROM {CELLS}")
def _(t: Views) -> DataFrame:
    return gr.cell_mapping(t("fx_vis"), NPIXEL, CELL, oversampling=8, w_step=7.3)


@register("g01_box_grid", "chan pol gv gu", "re im weight", FAST)
def _(t: Views) -> DataFrame:
    return ke.grid_with(t("fx_vis"), ke.BoxKernel(), NPIXEL, CELL)


@register("g16_timeslice_invert", "chan pol y x", "value")
def _(t: Views) -> DataFrame:
    return ig.timeslice_invert(t("fx_vis"), 32, 2 * CELL, 160.0)


@register("q02_invert_facets", "chan pol y x", "value")
def _(t: Views) -> DataFrame:
    return ig.facets_invert(t("fx_vis"), 32, 2 * CELL, 2)


PREDICTED = f"SELECT f.time, a1, a2, f.chan, f.pol, sum(re * k) AS m_re, sum(im * k) AS m_im FROM {_footprint_sql(KSUP, KOVER)} f JOIN ({_transform_sql(IMAGE_CELLS, '-')}) g ON g.chan = f.chan AND g.pol = f.pol AND g.y = f.gv AND g.x = f.gu GROUP BY f.time, a1, a2, f.chan, f.pol"


def _inverted_sql(rows: str) -> str:
    """The dirty image of rows by kernel and grid correction."""
    grid = f"SELECT chan, pol, gv, gu, sum(vis_re * (imaging_weight * k)) AS re, sum(vis_im * (imaging_weight * k)) AS im, sum(imaging_weight * k) AS weight FROM {_footprint_sql(KSUP, KOVER, rows)} GROUP BY chan, pol, gv, gu"
    return f"SELECT i.chan, i.pol, y, x, CASE WHEN total > 0 THEN re / (cy.c * cx.c) / total ELSE 0 END AS value FROM ({_transform_sql(grid, '')}) i JOIN (SELECT chan, pol, sum(weight) AS total FROM ({grid}) GROUP BY chan, pol) t ON t.chan = i.chan AND t.pol = i.pol JOIN {CORR} cy(p, c) ON cy.p = y JOIN {CORR} cx(p, c) ON cx.p = x"


@register("q03_residual", "chan pol y x", "value", _inverted_sql(f"(SELECT {K}, u, v, w, imaging_weight, vis_re - coalesce(m_re, 0e0) AS vis_re, vis_im - coalesce(m_im, 0e0) AS vis_im FROM fx_vis LEFT JOIN ({PREDICTED}) USING ({K}))"), grid=1024.0)
def _(t: Views) -> DataFrame:
    return ig.residual(t("fx_vis"), t("fx_pixel"), NPIXEL, CELL)[1]


@register("q01_predict_facets", KEY, "m_re m_im")
def _(t: Views) -> DataFrame:
    return ig.predict_list(t("fx_vis"), t("fx_pixel"), NPIXEL, CELL, facets=2)


@register("q01_predict_facet_stacks", KEY, "m_re m_im")
def _(t: Views) -> DataFrame:
    return ig.predict_list(t("fx_vis"), t("fx_pixel"), NPIXEL, CELL, context="wstack", facets=2, width=20.0)


@register("q02_invert_facet_stacks", "chan pol y x", "value")
def _(t: Views) -> DataFrame:
    return ig.invert_list(t("fx_vis"), 32, 2 * CELL, context="wstack", facets=2, width=20.0)


@register("g16_timeslice_predict", KEY, "m_re m_im")
def _(t: Views) -> DataFrame:
    return ig.timeslice_predict(t("fx_vis"), t("fx_pixel"), NPIXEL, CELL, 160.0)


@register("q09_model_partition", "model_id time ant chan feed", "g_re g_im")
def _(t: Views) -> DataFrame:
    return _partition(t).gains


@register("q09_partition_residual", "chan pol y x", "value")
def _(t: Views) -> DataFrame:
    return _partition(t).residual


def _partition(t: Views) -> pt.Partition:
    """Two halves of the sky, each with an image of its own, calibrated apart for one round."""
    v = _held(t)
    half = lambda k: t("fx_pixel").where("y >= 16 AND y < 48 AND x >= 16 AND x < 48").selectExpr(f"{k} AS model_id", "chan", "pol", "y - 16 AS y", "x - 16 AS x", "value", f"CAST((x >= 32) = ({k} = 1) AS DOUBLE) AS mask")
    images = ca.materialize(half(0).unionByName(half(1)))
    models = images.select("model_id").distinct()
    start = pt.Partition(models, None, images, pt.identity_gains(v, models, 15, 160.0))
    return pt.calibrate_partition(v, start, 15, 160.0, 32, 2 * CELL, rounds=1, most=20, padding=1)


@register("q10_polarisation_cube", "chan pol y x", "model residual")
def _(t: Views) -> DataFrame:
    v = _held(t)
    return cycles.polarisation_cube(v.where("time < 320"), v.where("time >= 320"), 32, 2 * CELL, low=5.0, high=90.0, most=30)


@register("c08_calibrate_together", KEY, "vis_re vis_im weight")
def _(t: Views) -> DataFrame:
    return cycles.calibrate_list(*_corrupted(t), 15, 160.0, phase_only=True)[1]


@register("q05_zeroed", KEY, "vis_re vis_im weight", f"SELECT {K}, 0e0 AS vis_re, 0e0 AS vis_im, weight FROM fx_vis")
def _(t: Views) -> DataFrame:
    return ig.zeroed(t("fx_vis"))


@register("q06_continuum_imaging", "chan pol y x", "value")
def _(t: Views) -> DataFrame:
    return cycles.continuum_imaging(_held(t), 32, 2 * CELL, cycles=2, most=30)[1]


@register("q07_imaging_cycle", "time ant chan feed", "g_re g_im")
def _(t: Views) -> DataFrame:
    return cycles.imaging_cycle(_held(t), 32, 2 * CELL, 15, 160.0, cycles=1, most=20)[2]


@register("q08_spectral_line", "chan pol y x", "value")
def _(t: Views) -> DataFrame:
    return cycles.spectral_line(_held(t), 32, 2 * CELL, most=30)[1]


@register("x24_w_beam", "chan pol y x", "beam_re beam_im", f"SELECT chan, pol, y, x, cos({PI2} * turns) AS beam_re, -sin({PI2} * turns) AS beam_im FROM (SELECT *, 25e1 * (sqrt(greatest(1 - (x - 32) * 5e-3 * ((x - 32) * 5e-3) - (y - 32) * 5e-3 * ((y - 32) * 5e-3), 0e0)) - 1) AS turns FROM fx_pixel)")
def _(t: Views) -> DataFrame:
    return ig.w_beam(t("fx_pixel"), F.lit(250.0), 64, 0.005)


# --- CLEAN with windows, products, scales and facets -----------------------------------------------------------------------


def _dirty(t: Views) -> tuple[DataFrame, DataFrame]:
    v = _held(t)
    return ca.materialize(gr.invert(v, 32, 2 * CELL)), ca.materialize(gr.invert(v, 32, 2 * CELL, psf=True))


@register("f12_clean_in_window", "chan pol y x", "model residual")
def _(t: Views) -> DataFrame:
    dirty, psf = _dirty(t)
    return cl.clean(dirty, psf, window=im.window_mask(dirty, "quarter", 32), most=50)


@register("d03_complex_clean", "chan pol y x", "model residual")
def _(t: Views) -> DataFrame:
    dirty, psf = _dirty(t)
    return cl.clean_complex(dirty, psf, most=50)


@register("d04_clean_scales", "chan pol y x", "model residual")
def _(t: Views) -> DataFrame:
    dirty, psf = _dirty(t)
    return cl.clean(dirty, psf, method=cl.clean_scales, most=30)


@register("d07_clean_facets", "chan pol y x", "model residual")
def _(t: Views) -> DataFrame:
    dirty, psf = _dirty(t)
    return cl.clean_facets(dirty, psf, 32, 2, 4, most=30)


@register("d05_clean_moments", "chan pol y x", "model residual")
def _(t: Views) -> DataFrame:
    dirty, psf = _dirty(t)
    channels = t("fx_vis").groupBy("chan").agg(F.max("frequency").alias("frequency"))
    return cl.clean_moment_facets(dirty, psf, 32, 1e8 + F.col("chan") * 1e6, 1.03e8, channels, n=3, facets=2, overlap=4, most=30)


@register("d06_clean_psf_support", "chan pol y x", "model residual")
def _(t: Views) -> DataFrame:
    dirty, psf = _dirty(t)
    return cl.clean_facets(dirty, psf, 32, 1, 0, psf_support=8, most=30)


# --- gain tables, Jones terms and fits -----------------------------------------------------------------------------------


@register("f04_gain_rows", "time ant chan", "g_re g_im", "SELECT time, ant, chan, g_re, g_im FROM fx_gain WHERE time > 1e2 AND weight > 0")
def _(t: Views) -> DataFrame:
    return jn.gain_rows(t("fx_gain"), (F.col("time") > 100.0) & (F.col("weight") > 0))


@register("w03_gain_slices", "time ant chan slice", "g_re", 'SELECT time, ant, chan, floor((time - (SELECT min(time) FROM fx_gain)) / "interval" + 5e-1) AS slice, g_re FROM fx_gain')
def _(t: Views) -> DataFrame:
    return jn.gain_slices(t("fx_gain"))


def _doubled(first: str, second: str) -> str:
    re, im = "(g1.g_re * g2.g_re + g1.g_im * g2.g_im)", "(g1.g_im * g2.g_re - g1.g_re * g2.g_im)"
    r2, i2 = f"({re} * {re} - {im} * {im})", f"(2 * {re} * {im})"
    good = "g1.weight > 0 AND g2.weight > 0"
    return f"""SELECT v.time, a1, a2, v.chan, pol, CASE WHEN {good} THEN vis_re * {r2} - vis_im * {i2} ELSE 0 END AS vis_re, CASE WHEN {good} THEN vis_re * {i2} + vis_im * {r2} ELSE 0 END AS vis_im
        FROM {first} v JOIN {second} g1 ON g1.ant = a1 AND g1.chan = v.chan AND abs(v.time - g1.time) < g1."interval" / 2
        JOIN {second} g2 ON g2.ant = a2 AND g2.chan = v.chan AND abs(v.time - g2.time) < g2."interval" / 2"""


@register("j04_sequence_of_terms", KEY, "vis_re vis_im", f"SELECT s.time, s.a1, s.a2, s.chan, s.pol, coalesce(vis_re, 0) AS vis_re, coalesce(vis_im, 0) AS vis_im FROM (SELECT DISTINCT time, a1, a2, chan, unnest([0, 1, 2, 3]) AS pol FROM ({_doubled('fx_vis', 'fx_gain')})) s LEFT JOIN ({_doubled('fx_vis', 'fx_gain')}) g USING ({K})", grid=4096.0)
def _(t: Views) -> DataFrame:
    v = _held(t)
    both = jo.gains_of(t("fx_gain"), v).withColumn("feed", F.explode(F.array(F.lit(0), F.lit(1))))
    term = ca.materialize(jn.as_matrices(both))
    return jn.apply_sequence(v, [term, term], interval=160.0, first=75.0)


@register("c03_solve_jones", "slot chan ant", " ".join(jn.NAMES))
def _(t: Views) -> DataFrame:
    return jn.solve_jones(ca.point_ratios(*_corrupted(t), 160.0), 15, rounds=60)


def _bandpass_sql() -> str:
    """Trimmed means and medians over antennas by rank."""
    rank = "SELECT time, chan, avg({0}) AS {1} FROM (SELECT *, row_number() OVER (PARTITION BY time, chan ORDER BY {0}, ant) AS k, count(*) OVER (PARTITION BY time, chan) AS n FROM steps{3}) WHERE {2} GROUP BY time, chan"
    kept, middle = "k > round_even(n * 25e-2, 0) AND k <= n - round_even(n * 25e-2, 0)", "k = (n + 1) // 2 OR k = n // 2 + 1"
    return f"""WITH turned AS (SELECT time, ant, chan, g_re * cos(t) - g_im * sin(t) AS g_re, g_im * cos(t) + g_re * sin(t) AS g_im FROM (SELECT *, 3e-1 * chan * (1 + ant % 3) AS t FROM fx_gain)),
      polar AS (SELECT *, sqrt(g_re * g_re + g_im * g_im) AS a, atan2(g_im, g_re) AS p FROM turned),
      stepped AS (SELECT *, p - lag(p) OVER (PARTITION BY time, ant ORDER BY chan) AS d0 FROM polar),
      steps AS (SELECT *, CASE WHEN d0 > pi() THEN d0 - 2 * pi() WHEN d0 < -pi() THEN d0 + 2 * pi() ELSE d0 END AS d FROM stepped),
      amp AS ({rank.format('a', 'amp', kept, '')}), re AS ({rank.format('g_re', 're', middle, '')}), im AS ({rank.format('g_im', 'im', middle, '')}), slope AS ({rank.format('d', 'slope', kept, ' WHERE d IS NOT NULL')}),
      common AS (SELECT *, sum(coalesce(slope, 0)) OVER (PARTITION BY time ORDER BY chan) AS delay_phase, atan2(im, re) AS angle FROM amp JOIN re USING (time, chan) JOIN im USING (time, chan) LEFT JOIN slope USING (time, chan))
      SELECT g.time, 0 AS feed, ant, g.chan, (g_re * cos(angle) + g_im * sin(angle)) / amp AS b_re, (g_im * cos(angle) - g_re * sin(angle)) / amp AS b_im, delay_phase FROM polar g JOIN common USING (time, chan)"""


@register("c05_bandpass", "time feed ant chan", "b_re b_im delay_phase", _bandpass_sql())
def _(t: Views) -> DataFrame:
    # Antennas of three kinds, each with a delay: a phase that turns with the channel.
    turn = 0.3 * F.col("chan") * (1 + F.col("ant") % 3)
    re, im_ = F.col("g_re") * F.cos(turn) - F.col("g_im") * F.sin(turn), F.col("g_im") * F.cos(turn) + F.col("g_re") * F.sin(turn)
    gains = t("fx_gain").withColumns({"slot": F.col("time"), "feed": F.lit(0), "g_re": re, "g_im": im_})
    return jn.bandpass(gains).withColumnRenamed("slot", "time")


@register("c07_calibrate_by_terms", KEY, "vis_re vis_im weight")
def _(t: Views) -> DataFrame:
    terms = [jn.Term("T", 160.0, phase_only=True, all_channels=True), jn.Term("G", 320.0)]
    return jn.calibrate_terms(*_corrupted(t), terms, 15)[1]


@register("c09_fit_component", "", "flux l m")
def _(t: Views) -> DataFrame:
    # The brightest place of the mean dirty image is where the fit to the data starts.
    v = _held(t)
    mean = gr.invert(v, 32, 2 * CELL).groupBy("y", "x").agg(F.avg("value").alias("value"))
    top = mean.orderBy(F.desc("value"), "y", "x").first()
    return v.sparkSession.createDataFrame([jn.fit_component(v, top.value, (top.x - 16) * 2 * CELL, (top.y - 16) * 2 * CELL)], "flux double, l double, m double")


@register("f06_time_chunks", KEY + " time_chunk", "vis_re", f"SELECT {K}, vis_re, floor(time / 5e1) AS time_chunk FROM fx_vis WHERE floor(time / 5e1) IN (SELECT floor(time / 5e1) FROM (SELECT time, asin(sin(-47e-2) * sin(-5e-1) + cos(-47e-2) * cos(-5e-1) * cos(time * {2 * math.pi / 864.0!r})) AS el FROM fx_vis) GROUP BY 1 HAVING min(el) >= 3e-1)")
def _(t: Views) -> DataFrame:
    return vi.time_chunks(t("fx_vis"), -0.47, -0.5, 50.0, 0.3, day=864.0)


@register("x03_baselines_over_hour_angles", "ant step", "u v w", "SELECT ant, step, x * cos(h) - y * sin(h) AS u, z * cos(-5e-1) + (x * sin(h) + y * cos(h)) * sin(-5e-1) AS v, z * sin(-5e-1) - (x * sin(h) + y * cos(h)) * cos(-5e-1) AS w FROM (SELECT *, step * 2e-1 - 6e-1 AS h FROM fx_antenna, (SELECT unnest(range(7)) AS step))")
def _(t: Views) -> DataFrame:
    rows = t("fx_antenna").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(6))))
    u, v, w = co.xyz_to_uvw(F.col("x"), F.col("y"), F.col("z"), F.col("step") * 0.2 - 0.6, F.lit(-0.5))
    return rows.select("ant", "step", u.alias("u"), v.alias("v"), w.alias("w"))


# --- further images and models ---------------------------------------------------------------------------------------------


@register("g11_pad_extract", "chan pol y x", "value", "SELECT chan, pol, y - 16 AS y, x - 16 AS x, value FROM fx_pixel WHERE y >= 16 AND y < 48 AND x >= 16 AND x < 48")
def _(t: Views) -> DataFrame:
    return im.extract(im.pad(t("fx_pixel"), 64, 128), 128, 32)


@register("g03_kernel_boxes", "w_plane support v_first v_last u_first u_last rows", "")
def _(t: Views) -> DataFrame:
    # For each w plane that the visibilities take, the part of its kernel above a ten-thousandth of the largest number.
    v = t("fx_vis")
    kernel = ig.aw_kernel(64, 2 * CELL, 10.0)
    rows = ke.with_planes(v, kernel).groupBy("w_plane").agg(F.count(F.lit(1)).alias("rows"))
    most = max(1, rows.agg(F.max(F.abs("w_plane"))).first()[0] or 0)
    support = ke.bounding_box(kernel, most)
    boxes = v.sparkSession.createDataFrame([(p, support, *a, *b) for p, a, b in ke.plane_boxes(kernel, most)], "w_plane long, support long, v_first long, v_last long, u_first long, u_last long")
    return rows.join(F.broadcast(boxes), "w_plane")


@register("c02_normalised_gains", "slot chan feed ant", "g_re g_im")
def _(t: Views) -> DataFrame:
    return ca.solve_gains(ca.point_ratios(t("fx_vis"), t("fx_model"), 160.0), 15, normalise=True)


@register("g03_bounding_box", "chan pol y_min y_max x_min x_max", "", "SELECT chan, pol, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max FROM fx_pixel p JOIN (SELECT chan AS c, pol AS o, max(abs(value)) * 8e-1 AS least FROM fx_pixel GROUP BY chan, pol) m ON c = chan AND o = pol WHERE abs(value) > least GROUP BY chan, pol")
def _(t: Views) -> DataFrame:
    return im.bounding_box(t("fx_pixel"), 0.8)


CUBIC = "CASE WHEN d{0} < 1 THEN (15e-1 * d{0} - 25e-1) * d{0} * d{0} + 1 WHEN d{0} < 2 THEN ((-5e-1 * d{0} + 25e-1) * d{0} - 4) * d{0} + 2 ELSE 0e0 END"


def _reproject_sql(ra0: float, dec0: float, ra1: float, dec1: float) -> str:
    s0, c0, s1, c1 = (repr(f(d)) for d in (dec0, dec1) for f in (math.sin, math.cos))
    new = "SELECT y, x, -(x - 24) * 4e-3 AS l, (y - 24) * 4e-3 AS m FROM (SELECT unnest(range(48)) AS y), (SELECT unnest(range(48)) AS x)"
    sky = f"SELECT *, {ra1!r} + atan2(l, n * {c1} - m * {s1}) AS ra, asin(m * {c1} + n * {s1}) AS dec FROM (SELECT *, sqrt(1 - l * l - m * m) AS n FROM ({new}))"
    old = f"SELECT y, x, 32 + (sin(dec) * {c0} - cos(dec) * {s0} * cos(ra - {ra0!r})) / 4e-3 AS y0, 32 - cos(dec) * sin(ra - {ra0!r}) / 4e-3 AS x0 FROM ({sky})"
    taps = f"SELECT y, x, floor(y0) + a AS oy, floor(x0) + b AS ox, abs(y0 - floor(y0) - a) AS dy, abs(x0 - floor(x0) - b) AS dx FROM ({old}), (SELECT unnest([-1, 0, 1, 2]) AS a), (SELECT unnest([-1, 0, 1, 2]) AS b) WHERE y0 >= 0 AND y0 <= 63 AND x0 >= 0 AND x0 <= 63"
    near = f"SELECT y, x, greatest(0, least(63, oy)) AS oy, greatest(0, least(63, ox)) AS ox, ({CUBIC.format('y')}) * ({CUBIC.format('x')}) AS wt FROM ({taps})"
    return f"SELECT chan, pol, n.y, n.x, sum(value * wt) AS value, sum(wt) AS footprint FROM ({near}) n JOIN fx_pixel p ON p.y = oy AND p.x = ox WHERE wt <> 0 GROUP BY chan, pol, n.y, n.x"


@register("i14_reproject", "chan pol y x", "value footprint", _reproject_sql(RA0, DEC0, RA0 + 0.02, DEC0 - 0.03))
def _(t: Views) -> DataFrame:
    return im.reproject(t("fx_pixel"), 64, 0.004, (RA0, DEC0), to_npixel=48, to_cellsize=0.004, to_centre=(RA0 + 0.02, DEC0 - 0.03))


@register("i17_restore_fitted", "chan pol y x", "value")
def _(t: Views) -> DataFrame:
    v = _held(t)
    psf = ca.materialize(gr.invert(v, 32, 2 * CELL, psf=True))
    dirty = ca.materialize(gr.invert(v, 32, 2 * CELL))
    found = ca.materialize(cl.clean(dirty, psf, most=30))
    return im.restore(found.select(*im.PIXEL, F.col("model").alias("value")), found.select(*im.PIXEL, F.col("residual").alias("value")), psf=psf, npixel=32)


@register("i19_structure_function", "chan dy dx", "value", "SELECT chan, dy, dx, 1 - a / max(a) OVER (PARTITION BY chan) AS value FROM (SELECT p.chan, q.y - p.y AS dy, q.x - p.x AS dx, sum(p.value * q.value) AS a FROM fx_pixel p JOIN fx_pixel q ON q.chan = p.chan AND q.pol = p.pol WHERE q.y - p.y BETWEEN -16 AND 15 AND q.x - p.x BETWEEN -16 AND 15 GROUP BY p.chan, q.y - p.y, q.x - p.x)", grid=float(1 << 16))
def _(t: Views) -> DataFrame:
    return im.structure_function(t("fx_pixel"), 64, ["chan"])


@register("i07_image_continuum", "chan pol y x", "value", "SELECT p.chan, pol, y, x, value - (my + b * (p.chan / 2e0 - 1 - mx)) AS value FROM fx_pixel p JOIN (SELECT pol, y, x, sy / s1 AS my, sx / s1 AS mx, CASE WHEN abs(s1 * sxx - sx * sx) > 1e-12 THEN (s1 * sxy - sx * sy) / (s1 * sxx - sx * sx) ELSE 0 END AS b FROM (SELECT pol, y, x, count(*) * 1e0 AS s1, sum(chan / 2e0 - 1) AS sx, sum((chan / 2e0 - 1) * (chan / 2e0 - 1)) AS sxx, sum(value) AS sy, sum((chan / 2e0 - 1) * value) AS sxy FROM fx_pixel GROUP BY pol, y, x)) f USING (pol, y, x)", grid=4096.0)
def _(t: Views) -> DataFrame:
    return vi.remove_continuum(t("fx_pixel"), ["pol", "y", "x"], F.col("chan") / 2.0 - 1, "value", F.lit(1.0))


@register("i07_remove_cubic", KEY, "vis_re vis_im")
def _(t: Views) -> DataFrame:
    return vi.remove_continuum(t("fx_vis"), ["time", "a1", "a2", "pol"], F.col("chan") / 3 - 1, ["vis_re", "vis_im"], F.col("weight"), degree=3)


@register("x22_spline_spectra", "vec_id half_chan", "value")
def _(t: Views) -> DataFrame:
    rows = t("fx_spectrum").select("vec_id", F.col("chan").cast("double").alias("frequency"), "value")
    return ss.interpolate_spectra(rows, ["vec_id"], [k + 0.5 for k in range(63)]).withColumn("half_chan", F.floor("frequency"))


@register("x22_linear_spectra", "vec_id below", "value", "SELECT a.vec_id, a.chan AS below, a.value + 31371e-5 * (b.value - a.value) AS value FROM fx_spectrum a JOIN fx_spectrum b ON b.vec_id = a.vec_id AND b.chan = a.chan + 1")
def _(t: Views) -> DataFrame:
    rows = t("fx_spectrum").select("vec_id", F.col("chan").cast("double").alias("frequency"), "value")
    return ss.interpolate_spectra(rows, ["vec_id"], [k + 0.31371 for k in range(63)], kind="linear").withColumn("below", F.floor("frequency"))


def _lanczos_sql(axis: str) -> str:
    """Nine taps of a component along an axis, adding up to 1."""
    x = f"(k - d{axis})"
    lobe = f"CASE WHEN {x} = 0 THEN 1e0 WHEN abs({x}) < 5 THEN sin(pi() * {x}) / (pi() * {x}) * (sin(pi() * ({x} / 5)) / (pi() * ({x} / 5))) ELSE 0e0 END"
    return f"SELECT *, {axis} + k AS p{axis}, w / sum(w) OVER (PARTITION BY comp_id{', px' if axis == 'y' else ''}) AS w{axis} FROM (SELECT *, {lobe} AS w FROM ({{0}}), (SELECT unnest(range(-4, 5)) AS k))"


_PLACED = f"SELECT comp_id, flux0, floor(fy + 5e-1) AS y, floor(fx + 5e-1) AS x, fy - floor(fy + 5e-1) AS dy, fx - floor(fx + 5e-1) AS dx FROM (SELECT comp_id, flux0, 32 + {M} / 5e-3 AS fy, 32 - ({L}) / 5e-3 AS fx FROM fx_component)"
_SPREAD = f"SELECT py AS y, px AS x, flux0 * wx * wy AS value FROM ({_lanczos_sql('y').format('SELECT comp_id, flux0, y, dy, px, wx FROM (' + _lanczos_sql('x').format(_PLACED) + ')')})"


@register("i11_insert_lanczos", "chan pol y x", "value", f"SELECT chan, pol, y, x, sum(value) AS value FROM (SELECT chan, pol, y, x, value FROM fx_pixel UNION ALL SELECT 0, 0, y, x, value FROM ({_SPREAD}) WHERE y >= 0 AND y < 64 AND x >= 0 AND x < 64) GROUP BY chan, pol, y, x")
def _(t: Views) -> DataFrame:
    c = sk.to_lm(t("fx_component"), RA0, DEC0).select(F.lit(0).alias("chan"), F.lit(0).alias("pol"), "l", "m", F.col("flux0").alias("flux"))
    return im.insert_components(t("fx_pixel"), c, 64, 0.005, method="lanczos")


@register("m03_weak_into_image", "chan pol y x", "value", f"SELECT chan, pol, y, x, sum(value) AS value FROM (SELECT chan, pol, y, x, value FROM fx_pixel UNION ALL SELECT 0, 0, y, x, flux0 FROM (SELECT floor(32 + {M} / 5e-3 + 5e-1) AS y, floor(32 - ({L}) / 5e-3 + 5e-1) AS x, flux0 FROM fx_component WHERE flux0 < 14e-1) WHERE y >= 0 AND y < 64 AND x >= 0 AND x < 64) GROUP BY chan, pol, y, x")
def _(t: Views) -> DataFrame:
    c = sk.to_lm(t("fx_component"), RA0, DEC0).select(F.lit(0).alias("chan"), F.lit(0).alias("pol"), "l", "m", F.col("flux0").alias("flux"))
    return sk.partition_model(c, t("fx_pixel"), 1.4, 64, 0.005)[1]


@register("m11_convolve_with_psf", "model_id chan pol y x", "value")
def _(t: Views) -> DataFrame:
    m = _models(t).where("y >= 16 AND y < 48 AND x >= 16 AND x < 48").withColumns({"y": F.col("y") - 16, "x": F.col("x") - 16})
    return sk.convolve_with_psf(t("fx_vis"), m.select("model_id").distinct(), m, 32, 2 * CELL, padding=1)


@register("j05_nearest_to_direction", "comp_id", "separation", "SELECT comp_id, separation FROM (SELECT comp_id, 2 * asin(sqrt(least(pow(sin((dec + 47e-2) / 2), 2) + cos(-47e-2) * cos(dec) * pow(sin((ra - 12e-2) / 2), 2), 1e0))) AS separation FROM fx_component) ORDER BY separation, comp_id LIMIT 1")
def _(t: Views) -> DataFrame:
    return jo.nearest_to(t("fx_component"), 0.12, -0.47)


def _turned_sql(h0: float, d0: float, h1: float, d1: float) -> str:
    """u, v, w of one phase centre as those of another: to axes of the Earth and back."""
    a, b, c, d, e, f, g, h = (repr(z) for z in (math.sin(d0), math.cos(d0), math.sin(h0), math.cos(h0), math.sin(d1), math.cos(d1), math.sin(h1), math.cos(h1)))
    xyz = f"SELECT {K}, vis_re, vis_im, u * {d} + (v * {a} - w * {b}) * {c} AS x, -u * {c} + (v * {a} - w * {b}) * {d} AS y, v * {b} + w * {a} AS z FROM fx_vis"
    return f"SELECT {K}, x * {h} - y * {g} AS u, z * {f} + (x * {g} + y * {h}) * {e} AS v, z * {e} - (x * {g} + y * {h}) * {f} AS w FROM ({xyz})"


@register("x11_phase_rotate_uvw", KEY, "vis_re vis_im u v w", f"SELECT {K}, vis_re * cos({PI2} * {TURNS}) - vis_im * sin({PI2} * {TURNS}) AS vis_re, vis_im * cos({PI2} * {TURNS}) + vis_re * sin({PI2} * {TURNS}) AS vis_im, t.u AS u, t.v AS v, t.w AS w FROM (SELECT {K}, u, v, w, vis_re, vis_im FROM fx_vis) fx_vis JOIN (SELECT {K}, u AS u, v AS v, w AS w FROM ({_turned_sql(-RA0, DEC0, -RA0 - 0.01, DEC0 - 0.005)})) t USING ({K})".replace(TURNS, TURNS.replace("(u *", "(fx_vis.u *").replace("+ v *", "+ fx_vis.v *").replace("+ w *", "+ fx_vis.w *")))
def _(t: Views) -> DataFrame:
    return vi.phase_rotate(t("fx_vis"), RA0, DEC0, RA0 + 0.01, DEC0 - 0.005, tangent=False)


def _frame_sql(source: str, target: str) -> str:
    rows = po.MATRICES[source, target]
    re = ", ".join(" + ".join(f"({complex(c).real!r} * r{k} - {complex(c).imag!r} * i{k})" for k, c in enumerate(r)) for r in rows)
    imag = ", ".join(" + ".join(f"({complex(c).real!r} * i{k} + {complex(c).imag!r} * r{k})" for k, c in enumerate(r)) for r in rows)
    sums = ", ".join(f"sum(CASE WHEN pol = {k} THEN vis_{p} ELSE 0 END) AS {n}{k}" for k in range(4) for p, n in (("re", "r"), ("im", "i")))
    return f"SELECT time, a1, a2, chan, unnest([0, 1, 2, 3]) AS pol, unnest([{re}]) AS vis_re, unnest([{imag}]) AS vis_im FROM (SELECT time, a1, a2, chan, {sums} FROM fx_vis GROUP BY time, a1, a2, chan)"


for _source, _target in (("stokesIQUV", "linear"), ("stokesIQUV", "circular"), ("circular", "stokesIQUV")):

    @register(f"x12_{_source.lower()}_to_{_target.lower()}", KEY, "vis_re vis_im", _frame_sql(_source, _target))
    def _(t: Views, source: str = _source, target: str = _target) -> DataFrame:
        return po.convert_frame(t("fx_vis"), ["time", "a1", "a2", "chan"], source, target)


@register("x14_image_to_stokes", "pol y x", "value imag", "SELECT unnest([0, 1, 2, 3]) AS pol, y, x, unnest([(r0 + r3) / 2, (r0 - r3) / 2, (r1 + r2) / 2, 0]) AS value, unnest([0, 0, 0, (r2 - r1) / 2]) AS imag FROM (SELECT y, x, sum(CASE WHEN chan = 0 THEN value ELSE 0 END) AS r0, sum(CASE WHEN chan = 1 THEN value ELSE 0 END) AS r1, sum(CASE WHEN chan = 2 THEN value ELSE 0 END) AS r2, sum(CASE WHEN chan = 3 THEN value ELSE 0 END) AS r3 FROM fx_pixel WHERE chan < 4 GROUP BY y, x)")
def _(t: Views) -> DataFrame:
    # The first four channels stand for the products of a linear frame.
    image = t("fx_pixel").where("chan < 4").select(F.lit(0).alias("chan"), F.col("chan").alias("pol"), "y", "x", "value")
    return po.convert_image(image, "linear", "stokesIQUV")


_DENSE = f"(SELECT time, a1, a2, c.chan AS chan, p.pol AS pol, avg_u * (1e8 + c.chan * 1e6) / 1e8 AS u, c.chan * 1e6 + 1e8 AS frequency FROM (SELECT time, a1, a2, avg(u) AS avg_u FROM fx_vis GROUP BY time, a1, a2), (SELECT DISTINCT chan FROM fx_vis) c, (SELECT unnest(range(4)) AS pol) p)"


@register("s06_measurement_set", KEY, "u vis_re vis_im weight frequency", f"SELECT {K}, d.u AS u, coalesce(vis_re, 0e0) AS vis_re, coalesce(vis_im, 0e0) AS vis_im, coalesce(weight, 0e0) AS weight, d.frequency AS frequency FROM {_DENSE} d LEFT JOIN (SELECT {K}, vis_re, vis_im, weight FROM fx_vis) USING ({K})")
def _(t: Views) -> DataFrame:
    v = t("fx_vis")
    # One place of a sample for all its channels, as a set has it: its mean, in metres.
    place = v.groupBy("time", "a1", "a2").agg(*(F.avg(c).alias(c) for c in "uvw"))
    rows = v.drop("u", "v", "w").join(place, ["time", "a1", "a2"]).withColumns({c: F.col(c) * F.col("frequency") / 1e8 for c in "uvw"})
    path = ta.new_folder(v.sparkSession)
    so.write_measurement_set(rows, path)
    return so.read_measurement_set(v.sparkSession, path)


@register("s01_list_fields", "data_desc_id rows", "", "SELECT l_linenumber % 2 AS data_desc_id, count(DISTINCT DAYS(l_shipdate) % 64 * 10000 + l_suppkey % 8 * 100 + l_suppkey % 8 + 1 + l_partkey % 7) AS rows FROM {lineitem} GROUP BY l_linenumber % 2")
def _(t: Views) -> DataFrame:
    rows = t("fx_vis").withColumn("data_desc_id", (F.col("chan") + 1) % 2)
    spark, path = rows.sparkSession, ta.new_folder(rows.sparkSession)
    so.write_measurement_set(rows, path)
    _, descs = so.list_fields(spark, path)
    return spark.read.parquet(f"{path}/MAIN").join(descs, "data_desc_id").groupBy("data_desc_id").agg(F.count(F.lit(1)).alias("rows"))


@register("s03_averaged_rows", "a1 a2 pol", "weight", f"SELECT a1, a2, pol, sum(weight) AS weight FROM fx_vis GROUP BY a1, a2, pol")
def _(t: Views) -> DataFrame:
    v = t("fx_vis")
    path = ta.new_folder(v.sparkSession)
    so.write_measurement_set(v, path)
    rows = so.read_visibility(v.sparkSession, path)
    return rows.groupBy("a1", "a2", "pol").agg(F.sum("weight").alias("weight"))


@register("t01_realtime_gains", "chan second feed ant", "g_re g_im")
def _(t: Views) -> DataFrame:
    rows = _held(t).withColumn("ts", F.timestamp_seconds(F.col("time")))
    c = sk.to_lm(t("fx_target"), RA0, DEC0).select("comp_id", "l", "m", "n", F.col("flux0").alias("flux"))
    return rt.table_gains(rows, c, 15, width="160 seconds").withColumn("second", F.unix_seconds("start"))


@register("t04_running_weights", "chan pol samples", "weight imaging_weight", "SELECT chan, pol, count(*) AS samples, sum(weight) AS weight, sum(imaging_weight) AS imaging_weight FROM fx_vis GROUP BY chan, pol")
def _(t: Views) -> DataFrame:
    return rt.running_weights(t("fx_vis"))


@register("m09_invert_models", "model_id chan pol y x", "value", f"SELECT 0 AS model_id, i.chan, i.pol, i.y, i.x, i.value * coalesce(mask, 1) AS value FROM ({_inverted_sql('fx_vis')}) i LEFT JOIN (SELECT chan, pol, y, x, mask FROM fx_mask) m ON m.chan = i.chan AND m.pol = i.pol AND m.y = i.y AND m.x = i.x UNION ALL SELECT 1 AS model_id, i.chan, i.pol, i.y, i.x, i.value * coalesce(1 - mask, 1) AS value FROM ({_inverted_sql(f'(SELECT {K}, u, v, w, imaging_weight, vis_im AS vis_re, vis_im FROM fx_vis)')}) i LEFT JOIN (SELECT chan, pol, y, x, mask FROM fx_mask) m ON m.chan = i.chan AND m.pol = i.pol AND m.y = i.y AND m.x = i.x", grid=1024.0)
def _(t: Views) -> DataFrame:
    v = t("fx_vis")
    both = v.withColumn("model_id", F.lit(0)).unionByName(v.withColumns({"model_id": F.lit(1), "vis_re": F.col("vis_im")}))
    return sk.invert_models(both, _models(t).select("model_id", *im.PIXEL, "mask"), NPIXEL, CELL)


@register("m11_convolve_models", "model_id chan pol y x", "value", f"SELECT model_id, p.chan, p.pol, p.y, p.x, sum(q.value * q.mask * a.k * b.k) AS value FROM (SELECT * FROM ({MODELS})) p JOIN (VALUES {GK}) a(d, k) ON true JOIN (VALUES {GK}) b(d, k) ON true JOIN (SELECT model_id AS qm, chan, pol, y, x, value, mask FROM ({MODELS})) q ON q.qm = p.model_id AND q.chan = p.chan AND q.pol = p.pol AND q.y = p.y + a.d AND q.x = p.x + b.d GROUP BY model_id, p.chan, p.pol, p.y, p.x", grid=4096.0)
def _(t: Views) -> DataFrame:
    return sk.convolve_models(_models(t), 1.5)


@register("o01_sort", "place " + KEY, "vis_re", f"SELECT row_number() OVER (ORDER BY a1, a2, time, chan, pol) AS place, {K}, vis_re FROM fx_vis WHERE weight > 0")
def _(t: Views) -> DataFrame:
    rows = vi.sort_visibility(t("fx_vis").where("weight > 0"), ["a1", "a2", "time", "chan", "pol"])
    # The place of a row in the sorted table: ranges are sorted, so their rows and those before them are counted.
    parts = ca.materialize(rows.withColumn("__part", F.spark_partition_id()))
    return vi.with_places(parts, ["a1", "a2", "time", "chan", "pol"])


@register("u02_concatenate", KEY, "vis_re", f"SELECT {K}, vis_re FROM fx_vis UNION ALL SELECT time + 1e3, a1, a2, chan, pol, vis_re FROM fx_vis UNION ALL SELECT time + 2e3, a1, a2, chan, pol, vis_re FROM fx_vis")
def _(t: Views) -> DataFrame:
    v = t("fx_vis")
    return vi.concatenate([v, *(v.withColumn("time", F.col("time") + k) for k in (1e3, 2e3))])


# --- streams: a solution for each window, and what came late ---------------------------------------------------------------


@register("t01_window_gains", "day ant", "g_re g_im")
def _(t: Views) -> DataFrame:
    rows = st.window_gains(t("fx_stream").withColumn("ts", F.col("ts").cast("timestamp")), 15)
    return rows.withColumn("day", F.unix_date(F.col("start").cast("date")))


@register("t05_late_rows", "a1 late", "", "SELECT a1, sum(CASE WHEN ts < seen - INTERVAL 2 HOUR THEN 1 ELSE 0 END) AS late FROM (SELECT a1, ts, max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM (SELECT event_id, ts, least(user_id % 15, (user_id % 15 + 1 + event_id % 14) % 15) AS a1 FROM {events})) GROUP BY a1")
def _(t: Views) -> DataFrame:
    return st.late_rows(t("fx_arrival").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours")


QUERIES = {name: q.run for name, q in ALL.items()}
ORACLE_SQL = {name: q.oracle for name, q in ALL.items() if q.sql is not None}
