"""CLEAN: Hogbom's, that of two Stokes products together, with several scales, and with several scales and moments of frequency.

The unit of work is one (chan, pol) plane, or one facet of it: ``clean_facets`` cuts large images, so no task holds more
than a facet and the point-spread function. Windows are masks of pixels where components may lie.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfringe.functions.windows import spheroidal_values

from .images import frequency_moments, from_frequency_moments, scatter_facets

PIXEL = ["chan", "pol", "y", "x"]
Cleaned = tuple[np.ndarray, np.ndarray]


def _subtract(res: np.ndarray, beam: np.ndarray, ky: int, kx: int, centre: tuple[int, int], step: float) -> None:
    """res less step * beam, its centre on (ky, kx), where the two overlap."""
    py, px = centre
    top, left = max(0, ky - py), max(0, kx - px)
    bottom, right = min(res.shape[0], ky - py + beam.shape[0]), min(res.shape[1], kx - px + beam.shape[1])
    res[top:bottom, left:right] -= step * beam[top - ky + py : bottom - ky + py, left - kx + px : right - kx + px]


def clean_plane(dirty: np.ndarray, psf: np.ndarray, window: np.ndarray | None, *, gain: float, threshold: float, fraction: float, most: int) -> Cleaned:
    """Model and residual. A component is taken first; then it ends if what is left there is under 0.9 of the threshold."""
    res, model = dirty.copy(), np.zeros_like(dirty)
    peak = psf.max()
    if peak <= 0 or not res.size:
        return model, res
    centre = np.unravel_index(psf.argmax(), psf.shape)
    stop = 0.9 * max(threshold, fraction * np.abs(dirty).max())
    for _ in range(most):
        ky, kx = np.unravel_index(np.abs(res if window is None else res * window).argmax(), res.shape)
        step = gain * res[ky, kx] / peak
        model[ky, kx] += step
        _subtract(res, psf, ky, kx, centre, step)
        if abs(res[ky, kx]) < stop:
            break
    return model, res


def clean_pair(dirty: list[np.ndarray], psf: list[np.ndarray], window: np.ndarray | None, *, gain: float, threshold: float, fraction: float, most: int) -> list[Cleaned]:
    """Q and U together: components where the root of the sum of squares is largest."""
    res, model = [d.copy() for d in dirty], [np.zeros_like(d) for d in dirty]
    peaks = [p.max() for p in psf]
    if min(peaks) > 0:
        centres = [np.unravel_index(p.argmax(), p.shape) for p in psf]
        stop = 0.9 * max(threshold, fraction * np.hypot(*dirty).max())
        for _ in range(most):
            size = np.hypot(*res)
            ky, kx = np.unravel_index((size if window is None else size * window).argmax(), size.shape)
            for r, m, p, peak, centre in zip(res, model, psf, peaks, centres, strict=True):
                step = gain * r[ky, kx] / peak
                m[ky, kx] += step
                _subtract(r, p, ky, kx, centre, step)
            if np.hypot(res[0][ky, kx], res[1][ky, kx]) < stop:
                break
    return list(zip(model, res, strict=True))


def scale_blob(width: float) -> np.ndarray:
    """A tapered parabola of ``width`` pixels across, of sum 1; a point for no width."""
    if width <= 0:
        return np.ones((1, 1))
    reach = int(np.ceil(width / 2))
    y, x = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    r = np.hypot(y, x) / (width / 2)
    blob = np.clip(spheroidal_values(r) * (1 - r * r), 0, None)
    return blob / blob.sum()


def _convolved(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The part of a full convolution that the image covers."""
    shape = [a + b - 1 for a, b in zip(image.shape, kernel.shape, strict=True)]
    full = np.fft.irfft2(np.fft.rfft2(image, shape) * np.fft.rfft2(kernel, shape), shape)
    y, x = (k // 2 for k in kernel.shape)
    return full[y : y + image.shape[0], x : x + image.shape[1]]


def smoothed_windows(window: np.ndarray | None, blobs: list[np.ndarray]) -> list[np.ndarray | None]:
    """A window for each scale: where a component of that size lies inside the window but for a tenth of it."""
    return [None if window is None else _convolved(window, b) > 0.9 for b in blobs]


def clean_scales(dirty: np.ndarray, psf: np.ndarray, window: np.ndarray | None, *, scales: tuple[float, ...] = (0.0, 3.0, 10.0), gain: float, threshold: float, fraction: float, most: int) -> Cleaned:
    """Model and residual of a CLEAN whose components are blobs of several sizes. Each step takes the scale and place of the
    largest value a component would have; it ends before a step whose smoothed residual is under 0.9 of the threshold."""
    model, res = np.zeros_like(dirty), dirty.copy()
    peak = psf.max()
    if peak <= 0 or not dirty.size:
        return model, res
    beam = psf / peak
    blobs = [scale_blob(s) for s in scales]
    windows = smoothed_windows(window, blobs)
    smoothed = [_convolved(dirty / peak, b) for b in blobs]
    responses = [[_convolved(_convolved(beam, a), b) for b in blobs] for a in blobs]
    centre = np.unravel_index(beam.argmax(), beam.shape)
    coupling = [responses[k][k][centre] for k in range(len(scales))]
    stop = 0.9 * max(threshold, fraction * np.abs(smoothed[0]).max())
    for _ in range(most):
        best = []
        for k, image in enumerate(smoothed):
            seen = np.abs(image if windows[k] is None else image * windows[k])
            at = np.unravel_index(seen.argmax(), seen.shape)
            best.append((seen[at] / coupling[k], k, at))
        _, k, (ky, kx) = max(best, key=lambda b: b[0])
        if abs(smoothed[k][ky, kx]) < stop or not smoothed[k][ky, kx]:
            break
        step = gain * smoothed[k][ky, kx] / coupling[k]
        blob = blobs[k]
        _subtract(model, blob, ky, kx, (blob.shape[0] // 2, blob.shape[1] // 2), -step)
        _subtract(res, _convolved(psf, blob), ky, kx, centre, step)
        for j in range(len(scales)):
            _subtract(smoothed[j], responses[k][j], ky, kx, centre, step)
    return model, res


def clean_moments(
    dirty: np.ndarray, psf: np.ndarray, window: np.ndarray | None, *, scales: tuple[float, ...] = (0.0, 3.0, 10.0), gain: float, threshold: float, fraction: float, most: int, find: str = "product"
) -> Cleaned:
    """Coefficients (moments x y x x) of a spectrum in each pixel, and what is left of the dirty moments.

    ``psf`` has twice as many moments as ``dirty`` (or both have one). For each scale the moments of the PSF at its centre are a matrix whose
    inverse turns residual moments into the coefficients that a component there would have. ``find`` says what a place is
    chosen by: the zeroth coefficient ("zeroth"), that times its residual ("product"), or the fall of chi squared
    ("chi2"). All moments of all scales are updated together; it ends when no coefficient of the next component reaches the threshold.
    """
    n = len(dirty)
    model = np.zeros_like(dirty)
    peak = psf.max() if psf.size else 0.0
    if peak <= 0 or not dirty.size:
        return model, dirty.copy()
    if len(psf) < 2 * n - 1:
        raise ValueError("the point-spread function needs twice as many moments as the image")
    beam = psf[: 2 * n - 1] / peak
    blobs = [scale_blob(s) for s in scales]
    windows = smoothed_windows(window, blobs)
    left = np.stack([[_convolved(d / peak, b) for d in dirty] for b in blobs])
    once = [[_convolved(b, blob) for b in beam] for blob in blobs]
    responses = [[np.stack([_convolved(x, b) for x in a]) for b in blobs] for a in once]
    centre = np.unravel_index(beam[0].argmax(), beam[0].shape)
    order = np.add.outer(np.arange(n), np.arange(n))
    hessian = [responses[k][k][order][:, :, centre[0], centre[1]] for k in range(len(scales))]
    inverse = [np.linalg.inv(h) for h in hessian]
    stop = max(threshold, fraction * np.abs(left[0, 0]).max())
    # The coefficients of a component at every place of every scale; only what a step changes is computed again.
    would = np.stack([np.einsum("tq,qyx->tyx", i, x) for i, x in zip(inverse, left, strict=True)])

    def worth(k: int, area: tuple[slice, slice] = (slice(None), slice(None))) -> np.ndarray:
        s, r = would[(k, slice(None), *area)], left[(k, slice(None), *area)]
        if find == "zeroth":
            value = s[0]
        elif find == "chi2":
            value = 2 * (s * r).sum(0) - np.einsum("tyx,tq,qyx->yx", s, hessian[k], s)
        else:
            value = s[0] * r[0]
        return np.abs(value if windows[k] is None else value * windows[k][area])

    seen = [worth(k) for k in range(len(scales))]
    for _ in range(most):
        k = int(np.argmax([x.max() for x in seen]))
        ky, kx = np.unravel_index(seen[k].argmax(), seen[k].shape)
        value = would[k, :, ky, kx].copy()
        if np.abs(value).max() < stop or not value.any():
            break
        blob = blobs[k]
        for t in range(n):
            _subtract(model[t], blob, ky, kx, (blob.shape[0] // 2, blob.shape[1] // 2), -gain * value[t])
        top, under = max(0, ky - centre[0]), min(dirty.shape[1], ky - centre[0] + beam.shape[1])
        first, past = max(0, kx - centre[1]), min(dirty.shape[2], kx - centre[1] + beam.shape[2])
        area = (slice(top, under), slice(first, past))
        for j in range(len(scales)):
            part = responses[k][j][:, top - ky + centre[0] : under - ky + centre[0], first - kx + centre[1] : past - kx + centre[1]]
            left[(j, slice(None), *area)] -= gain * np.einsum("tqyx,q->tyx", part[order], value)
            would[(j, slice(None), *area)] = np.einsum("tq,qyx->tyx", inverse[j], left[(j, slice(None), *area)])
            seen[j][area] = worth(j, area)
    return model, left[0] * peak


def _rows(dirty: DataFrame, psf: DataFrame, window: DataFrame | None) -> DataFrame:
    """Pixels, point-spread function and window as rows of three kinds."""
    image = dirty.select(*PIXEL, "value", F.lit(0).alias("kind")).unionByName(psf.select(*PIXEL, "value", F.lit(1).alias("kind")))
    return image if window is None else image.unionByName(window.select(*PIXEL, F.col("mask").alias("value"), F.lit(2).alias("kind")))


def _planes(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray | None]:
    """(the pixels, their array, the point-spread function, the window) of one plane."""
    d, p, w = (pdf[pdf["kind"] == k] for k in range(3))
    y0, x0 = int(d["y"].min()), int(d["x"].min())
    place = lambda part: (part["y"].to_numpy() - y0, part["x"].to_numpy() - x0)
    dirty = np.zeros((int(d["y"].max()) - y0 + 1, int(d["x"].max()) - x0 + 1))
    dirty[place(d)] = d["value"]
    psf = np.zeros((int(p["y"].max()) + 1, int(p["x"].max()) + 1) if len(p) else (1, 1))
    psf[p["y"].to_numpy(), p["x"].to_numpy()] = p["value"]
    window = None
    if len(w):
        w = w[(w["y"] >= y0) & (w["y"] < y0 + dirty.shape[0]) & (w["x"] >= x0) & (w["x"] < x0 + dirty.shape[1])]
        window = np.zeros_like(dirty)
        window[place(w)] = w["value"]
    return d, dirty, psf, window


def _answer(d: pd.DataFrame, model: np.ndarray, residual: np.ndarray, **more: object) -> pd.DataFrame:
    at = d["y"].to_numpy() - int(d["y"].min()), d["x"].to_numpy() - int(d["x"].min())
    return d[PIXEL].assign(model=model[at], residual=residual[at], **more)


RESULT = "chan long, pol long, y long, x long, model double, residual double"


def clean(
    dirty: DataFrame, psf: DataFrame, *, window: DataFrame | None = None, method: Callable[..., Cleaned] = clean_plane, gain: float = 0.1, threshold: float = 0.0, fraction: float = 0.1, most: int = 100, **options: object
) -> DataFrame:
    """(chan, pol, y, x, model, residual) of each plane; ``method`` is ``clean_plane`` or ``clean_scales``."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if not (pdf["kind"] == 0).any():  # a point-spread function or window without an image
            return pd.DataFrame(columns=[*PIXEL, "model", "residual"])
        d, image, beam, mask = _planes(pdf)
        return _answer(d, *method(image, beam, mask, gain=gain, threshold=threshold, fraction=fraction, most=most, **options))

    return _rows(dirty, psf, window).groupBy("chan", "pol").applyInPandas(work, RESULT)


def clean_complex(dirty: DataFrame, psf: DataFrame, *, q: int = 1, u: int = 2, window: DataFrame | None = None, gain: float = 0.1, threshold: float = 0.0, fraction: float = 0.1, most: int = 100) -> DataFrame:
    """(chan, pol, y, x, model, residual) of the products q and u of each channel, cleaned together."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        planes = [_planes(pdf[pdf["pol"] == pol]) for pol in (q, u) if ((pdf["pol"] == pol) & (pdf["kind"] == 0)).any()]
        if len(planes) < 2 or planes[0][1].shape != planes[1][1].shape:
            return pd.DataFrame(columns=[*PIXEL, "model", "residual"])
        done = clean_pair([p[1] for p in planes], [p[2] for p in planes], planes[0][3], gain=gain, threshold=threshold, fraction=fraction, most=most)
        return pd.concat([_answer(p[0], *x) for p, x in zip(planes, done, strict=True)])

    rows = _rows(dirty, psf, window).where(F.col("pol").isin(q, u))
    return rows.groupBy("chan").applyInPandas(work, RESULT)


# --- facets -----------------------------------------------------------------------------------------------------------


def _every_facet(facets: int) -> Column:
    return F.array(*(F.struct(F.lit(fy).cast("long").alias("fy"), F.lit(fx).cast("long").alias("fx")) for fy in range(facets) for fx in range(facets)))


def _cut(dirty: DataFrame, psf: DataFrame, window: DataFrame | None, npixel: int, facets: int, overlap: int, psf_support: int | None) -> tuple[DataFrame, DataFrame]:
    """(the pixels of each facet with their taper, the parts of point-spread function and window that a facet can see).

    A facet with its overlap is ``reach`` pixels wide, so no further part of the point-spread function ever meets it."""
    reach = min(psf_support or npixel, npixel // facets + 2 * overlap, npixel - npixel // 2)
    image = scatter_facets(dirty, npixel, facets, overlap)
    middle = psf.where((F.abs(F.col("y") - npixel // 2) < reach) & (F.abs(F.col("x") - npixel // 2) < reach))
    beams = middle.select(*PIXEL, "value", F.explode(_every_facet(facets)).alias("f")).select("chan", "pol", (F.col("y") - (npixel // 2 - reach)).alias("y"), (F.col("x") - (npixel // 2 - reach)).alias("x"), "value", "f.fy", "f.fx", F.lit(1).alias("kind"))
    if window is not None:
        masks = scatter_facets(window.select(*PIXEL, F.col("mask").alias("value")), npixel, facets, overlap)
        beams = beams.unionByName(masks.select(*PIXEL, "value", "fy", "fx", F.lit(2).alias("kind")))
    return image, beams


def _gathered(facets: DataFrame) -> DataFrame:
    mean = lambda c: (F.sum(F.col(c) * F.col("taper")) / F.sum("taper")).alias(c)
    return facets.groupBy(*PIXEL).agg(mean("model"), mean("residual"))


def _bright(image: DataFrame, peaks: DataFrame, threshold: float, fraction: float) -> tuple[DataFrame, DataFrame]:
    """(facets worth cleaning with the one threshold of all, those that are not): ``peaks`` has a row for each facet."""
    top = peaks.agg(F.greatest(F.lit(float(threshold)), fraction * F.max("peak")).alias("stop"))
    # A row for each facet, and one: both bounded by a parameter.
    known = F.broadcast(peaks.crossJoin(F.broadcast(top)).withColumn("__bright", F.col("peak") > 1.1 * F.col("stop")))
    rows = image.join(known, ["fy", "fx"])
    return rows.where("__bright").drop("__bright", "peak"), rows.where("NOT __bright").drop("__bright", "peak", "stop")


def _answered(cleaned: DataFrame, faint: DataFrame, model: DataFrame | None) -> DataFrame:
    left = faint.select(*(F.col(c).cast("long") for c in PIXEL), F.lit(0.0).alias("model"), F.col("value").alias("residual"), "taper")
    out = _gathered(cleaned.unionByName(left))
    if model is None:
        return out
    before = model.select(*PIXEL, F.col("value").alias("model"), F.lit(None).cast("double").alias("residual"))
    return out.unionByName(before).groupBy(*PIXEL).agg(F.sum("model").alias("model"), F.coalesce(F.sum("residual"), F.lit(0.0)).alias("residual"))


FACET_RESULT = RESULT + ", taper double"


def clean_facets(
    dirty: DataFrame, psf: DataFrame, npixel: int, facets: int, overlap: int, *, window: DataFrame | None = None, model: DataFrame | None = None, psf_support: int | None = None,
    method: Callable[..., Cleaned] = clean_plane, gain: float = 0.1, threshold: float = 0.0, fraction: float = 0.1, most: int = 100, **options: object,
) -> DataFrame:
    """(chan, pol, y, x, model, residual), a facet of a plane at a time.

    All facets stop at one threshold, ``fraction`` of the peak of the whole middle channel or ``threshold``; a facet whose
    peak there isn't above 1.1 of it keeps what it has. Facets are cleaned with their overlap and feathered together by
    their taper, and ``model`` (value), what was found before, is added.
    """
    image, beams = _cut(dirty, psf, window, npixel, facets, overlap, psf_support)
    middle = dirty.agg(F.sort_array(F.collect_set("chan")).alias("c")).select(F.col("c")[F.floor(F.size("c") / 2).cast("int")].alias("chan"))
    # A facet without a pixel in that channel has no peak there.
    seen = image.join(F.broadcast(middle.withColumn("__middle", F.lit(True))), "chan", "left")
    peaks = seen.groupBy("fy", "fx").agg(F.coalesce(F.max(F.when(F.col("__middle"), F.abs("value"))), F.lit(0.0)).alias("peak"))
    bright, faint = _bright(image, peaks, threshold, fraction)
    rows = bright.withColumn("kind", F.lit(0)).unionByName(beams, allowMissingColumns=True)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if not (pdf["kind"] == 0).any():
            return pd.DataFrame(columns=[*PIXEL, "model", "residual", "taper"])
        d, pixels, beam, mask = _planes(pdf)
        found = method(pixels, beam, mask, gain=gain, threshold=float(d["stop"].iloc[0]), fraction=0.0, most=most, **options)
        return _answer(d, *found, taper=d["taper"])

    return _answered(rows.groupBy("chan", "pol", "fy", "fx").applyInPandas(work, FACET_RESULT), faint, model)


def clean_moment_facets(
    dirty: DataFrame, psf: DataFrame, npixel: int, frequency: Column, reference: float, channels: DataFrame, *, n: int = 3, facets: int = 1, overlap: int = 0, window: DataFrame | None = None, model: DataFrame | None = None,
    psf_support: int | None = None, return_moments: bool = False, gain: float = 0.1, threshold: float = 0.0, fraction: float = 0.1, most: int = 100, **options: object,
) -> DataFrame:
    """(chan, pol, y, x, model, residual) of a multi-scale multi-frequency CLEAN.

    Dirty image and point-spread function become ``n`` and ``2 * n`` frequency moments by one aggregation each; all moments
    of a facet of a product are the unit of work, see ``clean_moments``. The coefficients found are spectra on ``channels``
    (chan, frequency), or with ``return_moments`` chan numbers the moments. Threshold, faint facets and tapers as for
    ``clean_facets``, peaks being those of the mean over channels. Moments of both are divided by the largest of the PSF's.
    """
    named = lambda m: m.withColumnRenamed("moment", "chan")
    moments = named(frequency_moments(dirty, frequency, reference, n))
    beam = named(frequency_moments(psf, frequency, reference, 2 * n if n > 1 else 1))
    top = beam.agg(F.max("value").alias("__top"))
    by_top = lambda m: m.crossJoin(F.broadcast(top)).withColumn("value", F.when(F.col("__top") > 0, F.col("value") / F.col("__top")).otherwise(F.lit(0.0))).drop("__top")
    image, beams = _cut(by_top(moments), by_top(beam), None if window is None else window.withColumn("chan", F.lit(0)), npixel, facets, overlap, psf_support)
    peaks = image.groupBy("fy", "fx").agg(F.coalesce(F.max(F.when(F.col("chan") == 0, F.abs("value"))), F.lit(0.0)).alias("peak"))
    bright, faint = _bright(image, peaks, threshold, fraction)
    rows = bright.withColumn("kind", F.lit(0)).unionByName(beams, allowMissingColumns=True)

    def cube(pdf: pd.DataFrame, count: int, shape: tuple[int, int], y0: int, x0: int) -> np.ndarray:
        out = np.zeros((count, *shape))
        out[pdf["chan"].to_numpy(), pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = pdf["value"]
        return out

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        d, p, w = (pdf[pdf["kind"] == k] for k in range(3))
        if not len(d) or not len(p):
            return d[PIXEL].assign(model=0.0, residual=d["value"], taper=d["taper"])
        y0, x0 = int(d["y"].min()), int(d["x"].min())
        shape = (int(d["y"].max()) - y0 + 1, int(d["x"].max()) - x0 + 1)
        pixels = cube(d, n, shape, y0, x0)
        spread = cube(p, 2 * n if n > 1 else 1, (int(p["y"].max()) + 1, int(p["x"].max()) + 1), 0, 0)
        mask = None
        if len(w):
            inside = w[(w["y"] >= y0) & (w["y"] < y0 + shape[0]) & (w["x"] >= x0) & (w["x"] < x0 + shape[1])]
            mask = cube(inside.assign(chan=0), 1, shape, y0, x0)[0]
        found, left = clean_moments(pixels, spread, mask, gain=gain, threshold=float(d["stop"].iloc[0]), fraction=0.0, most=most, **options)
        at = d["chan"].to_numpy(), d["y"].to_numpy() - y0, d["x"].to_numpy() - x0
        return d[PIXEL].assign(model=found[at], residual=left[at], taper=d["taper"])

    cleaned = _answered(rows.groupBy("pol", "fy", "fx").applyInPandas(work, FACET_RESULT), faint, None)
    if return_moments:
        return cleaned
    spectrum = lambda c: from_frequency_moments(cleaned.select(F.col("chan").alias("moment"), "pol", "y", "x", F.col(c).alias("value")), channels, reference).withColumnRenamed("value", c)
    both = spectrum("model").join(spectrum("residual"), PIXEL)
    if model is None:
        return both
    return both.join(model.select(*PIXEL, F.col("value").alias("__before")), PIXEL, "left").withColumn("model", F.col("model") + F.coalesce("__before", F.lit(0.0))).drop("__before")
