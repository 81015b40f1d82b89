"""Visibilities of lists of components, summed as products of matrices inside tasks.

Visibilities are brought together by sample, so that all products of one are summed once. A counted list of at most
``array_rows`` components is broadcast as arrays; a longer one goes in blocks of that size that meet blocks of
samples, and the sums of a sample over its blocks are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .visibility import KEY

SAMPLE = KEY[:4]
AT_ONCE = 1 << 21
ROW = "time double, a1 long, a2 long, chan long, pol long"


def phasor_sums(uvw: np.ndarray, lmn: np.ndarray, flux: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """rows x lists: the sums of flux * exp(-2 pi i (u l + v m + w n)) over the stretches of components from each start."""
    out = np.zeros((len(uvw), len(starts)), complex)
    step = max(1, AT_ONCE // max(1, len(lmn)))
    for at in range(0, len(uvw), step):
        turns = uvw[at : at + step] @ lmn.T
        turns -= np.rint(turns)
        angle = -2 * np.pi * turns
        terms = np.empty(turns.shape, complex)
        terms.real, terms.imag = np.cos(angle), np.sin(angle)
        terms *= flux
        out[at : at + step] = np.add.reduceat(terms, starts, axis=1) if len(starts) > 1 else terms.sum(1, keepdims=True)
    return out


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names of the lists, their starts, lmn, flux)."""
    rows = rows.sort_values(["model_id", "comp_id"], kind="stable")
    names, starts = np.unique(rows["model_id"].to_numpy(np.int64), return_index=True)
    return names, starts, rows[["l", "m", "n"]].to_numpy(float), rows["flux"].to_numpy(float)


def _answers(b: pd.DataFrame, names: np.ndarray, starts: np.ndarray, lmn: np.ndarray, flux: np.ndarray) -> pd.DataFrame:
    if not len(b) or not len(names):
        return pd.DataFrame(columns=["model_id", *KEY, "m_re", "m_im"])
    uvw, which = np.unique(b[["u", "v", "w"]].to_numpy(float), axis=0, return_inverse=True)
    found = phasor_sums(uvw, lmn, flux, starts)[which.reshape(-1)] * b["__s"].to_numpy()[:, None]
    out = b[KEY].iloc[np.repeat(np.arange(len(b)), len(names))]
    return out.assign(model_id=np.tile(names, len(b)), m_re=found.real.reshape(-1), m_im=found.imag.reshape(-1))[["model_id", *KEY, "m_re", "m_im"]]


def component_visibilities(vis: DataFrame, components: DataFrame, spectrum, *, array_rows: int = 20_000, sample_rows: int = 100_000) -> DataFrame:
    """(model_id, key, m_re, m_im) of components (model_id, comp_id, l, m, n, flux); ``spectrum`` is a column of the
    visibilities that all components' fluxes are multiplied by. Rows go with every model; without components there are none."""
    listed = components.select("model_id", "comp_id", *(F.col(c).cast("double").alias(c) for c in ("l", "m", "n", "flux")))
    n = listed.count()
    rows = vis.select(*(F.col(c).cast(k).alias(c) for c, k in (p.split() for p in ROW.split(", "))), *(F.col(c).cast("double").alias(c) for c in "uvw"), spectrum.cast("double").alias("__s"))
    schema = "model_id long, " + ROW + ", m_re double, m_im double"
    if n <= array_rows:
        known = vis.sparkSession.sparkContext.broadcast(_arrays(listed.toPandas()))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield _answers(b, *known.value)

        return rows.repartition(*SAMPLE).sortWithinPartitions(*SAMPLE).mapInPandas(work, schema)
    blocks = -(-n // array_rows)
    chunks = max(1, -(-rows.count() // sample_rows))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.withColumn("__chunk", F.pmod(F.xxhash64(*SAMPLE), F.lit(chunks)).cast("int")).withColumn("__block", every(blocks))
    right = listed.withColumn("__block", F.pmod(F.xxhash64("comp_id"), F.lit(blocks)).cast("int")).withColumn("__chunk", every(chunks))
    parts = left.groupBy("__chunk", "__block").cogroup(right.groupBy("__chunk", "__block")).applyInPandas(lambda b, c: _answers(b, *_arrays(c)), schema)
    return parts.groupBy("model_id", *KEY).agg(F.sum("m_re").alias("m_re"), F.sum("m_im").alias("m_im"))
