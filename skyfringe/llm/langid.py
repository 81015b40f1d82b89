"""Language identification as inference of a mixture.

Training counts the hashed byte trigrams of labelled texts by language (on a bounded sample of labelled rows: at most
about ``train_rows``, chosen by hash). For a text, expectation-maximisation estimates the shares of all languages from
the trigrams' likelihoods; then language sets of growing size, in the order of these shares, are fitted in the same
way, and the set with the best likelihood less ``penalty`` times the log of the text's length for each language is
chosen. Texts are handled many at a time as ragged arrays; work is one pass over whole texts, without a shuffle. The
model has ``buckets`` numbers for each language and nothing else, so it is small enough to broadcast whatever the
corpus.

Defined results: null text, or text without a letter, is ``und`` with score 0 and no languages; without training rows
every text is ``und``; rows with a null label teach nothing; equal texts get equal results; a tie goes to the language
first by code point; an empty table gives an empty table; very long texts are counted whole, one at a time in memory of
a few dozen bytes a byte; further columns are left behind unless named in ``keep``, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_rows
from .pretoken import portions

_LETTER = regex.compile(r"\p{L}")
# Bytes that are no letters become blanks; bytes of longer characters stay.
_PLAIN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def trigram_counts(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, count) of the distinct hashed trigrams, by text."""
    raw = [f" {t.lower()} ".encode("utf-8", "surrogatepass") for t in texts]
    data = _PLAIN[np.frombuffer(b"".join(raw), np.uint8)]
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    sizes = np.array([len(x) for x in raw])
    owner = np.repeat(np.arange(len(raw)), sizes)
    inside = (owner[2:] == owner[:-2]) & (code != 0x202020)
    bucket = ((code[inside] * np.uint32(2654435761)) >> np.uint32(7)) % np.uint32(buckets)
    key, n = np.unique(owner[:-2][inside].astype(np.uint64) * np.uint64(buckets) + bucket, return_counts=True)
    return (key // np.uint64(buckets)).astype(np.int64), (key % np.uint64(buckets)).astype(np.int64), n


def train(labelled: DataFrame, *, buckets: int = 1 << 16, train_rows: int = 20_000, smooth: float = 0.1) -> tuple[list[str], np.ndarray]:
    """(languages by code point, likelihood of each bucket in each) from ``text`` and ``lang``."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    keep = min(1.0, train_rows / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(keep * (1 << 20)) + 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for some in portions(texts):
                    _, bucket, n = trigram_counts(some, buckets)
                    total = np.bincount(bucket, n, buckets)
                    at = np.flatnonzero(total)
                    yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at].astype(np.int64)})

    # At most ``buckets`` rows for each language.
    table = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique(), key=lambda x: x.encode())
    counts = np.full((buckets, len(langs)), smooth)
    counts[table["bucket"], [langs.index(x) for x in table["lang"]]] += table["n"]
    return langs, (counts / counts.sum(0)).astype(np.float32)


def _fit(likely: np.ndarray, n: np.ndarray, starts: np.ndarray, owner: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages in each text, and the log likelihood under them."""
    share = allowed / allowed.sum(1, keepdims=True)
    total = np.add.reduceat(n, starts)
    for k in range(rounds + 1):
        part = likely * share[owner]
        all_parts = part.sum(1)
        if k < rounds:
            part *= (n / all_parts)[:, None]
            share = np.add.reduceat(part, starts) / total[:, None]
    return share, np.add.reduceat(n * np.log(all_parts), starts)


def mixtures(texts: list[str], likelihood: np.ndarray, *, rounds: int = 8, penalty: float = 3.0) -> np.ndarray:
    """The shares of the chosen language set of each text, 0 for languages outside it. Sets grow up to all languages;
    a text is left once even the likeliest language of each trigram would not pay for a larger set."""
    buckets, langs = likelihood.shape
    owner, bucket, count = trigram_counts(texts, buckets)
    out = np.zeros((len(texts), langs), np.float32)
    if not len(owner) or not langs:
        return out
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    number = owner[starts]
    local = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(owner))))
    likely, n = likelihood[bucket], count.astype(np.float32)
    everything, _ = _fit(likely, n, starts, local, np.ones((len(starts), langs), np.float32), rounds)
    rank = np.argsort(np.argsort(-everything, axis=1, kind="stable"), axis=1, kind="stable")
    price = penalty * np.log(np.add.reduceat(n, starts) + 1)
    alone = np.add.reduceat(n[:, None] * np.log(likely), starts)
    best = np.zeros_like(everything)
    best[np.arange(len(best)), alone.argmax(1)] = 1
    value = alone.max(1) - price
    # No set is likelier than each trigram's likeliest language.
    bound = np.add.reduceat(n * np.log(likely.max(1)), starts)
    for size in range(2, langs + 1):
        open_texts = bound - size * price > value
        if not open_texts.any():
            break
        rows = open_texts[local]
        some = n[rows]
        owners = (np.cumsum(open_texts) - 1)[local[rows]]
        begins = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        share, fit = _fit(likely[rows], some, begins, owners, (rank[open_texts] < size).astype(np.float32), rounds)
        at = np.flatnonzero(open_texts)
        better = fit - size * price[at] > value[at]
        best[at[better]], value[at[better]] = share[better], (fit - size * price[at])[better]
    out[number] = best
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *keep: str, **options) -> DataFrame:
    """``keep``, doc_id, lang_pred, score (the predicted language's share) and languages: array of (lang, share)."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double,languages:array<struct<lang:string,share:double>>>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, likelihood = shared.value
        for s in texts:
            rows = []
            for some in portions(s):
                for text, share in zip(some, mixtures(some, likelihood, **options), strict=True):
                    top = int(share.argmax()) if langs else 0
                    if not langs or not share[top] or not _LETTER.search(text):
                        rows.append(("und", 0.0, []))
                    else:
                        order = sorted(np.flatnonzero(share).tolist(), key=lambda k: -share[k])
                        rows.append((langs[top], min(1.0, float(share[top])), [{"lang": langs[k], "share": float(share[k])} for k in order]))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "languages"])

    return text_rows(docs, *keep).select(*keep, "doc_id", found("text").alias("f")).select(*keep, "doc_id", "f.*")
