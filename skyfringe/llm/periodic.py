"""Runs of repeated words, found by Kruskal's order of suffix classes.

The words of a text are numbered and its suffixes sorted by doubling. Neighbouring suffixes are united from the longest
common prefix (LCP) down, with union-find; every class keeps its positions in order. Where a union makes positions i < j
neighbours whose LCP is L, j - i is a period of the words from i to j + L. The first position of every run of at least two
periods is such a seed, so the least position of all seeds of one period and end is where the run starts. A seed whose
distance is a multiple of a smaller period of the same words names no run of its own and goes.

A run of ``least`` words and ``times`` periods takes an LCP of ``least * (times - 1) / times`` words at least. Smaller LCPs
are never united, and a text in which no window of that many words (rounded down to a power of two) occurs twice is done
after one sort of hashes; a hash that two windows share by chance costs only time.

One pass without a shuffle. A text is split some megabytes at a time; sorting its suffixes holds four bytes a word for
each doubling up to its longest repeat.

Defined results: null and empty texts have no words and no runs; equal texts get equal results; repeated rows get a result each;
an empty table gives an empty table; rows without a doc_id are like any other; texts of any length are taken whole;
further columns are left behind unless named in ``keep``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that are looked at together have about this many words, and a text is split this many bytes at a time.
AT_ONCE, PIECE = 200_000, 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time. bytes.split() splits at the white space of the word class and no other."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, min(at + PIECE, len(data)))
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end + 1


def _numbered(data: bytes, known: dict[bytes, int]) -> np.ndarray:
    parts = [np.fromiter(map(known.__getitem__, w), np.int32, len(w)) for w in _words(data)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def repeated_windows(texts: list[np.ndarray], width: int) -> np.ndarray:
    """Whether each text may hold a window of ``width`` words (a power of two) twice; never wrong where it says no."""
    sizes = np.array([len(t) for t in texts])
    out = np.zeros(len(texts), bool)
    if sizes.sum() < width:
        return out
    ids = np.concatenate(texts).astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), sizes)
    h = (ids + np.uint64(1)) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    step = 1
    while step < width:
        h = (h[:-step] ^ (h[:-step] >> np.uint64(31))) * _ODD[2] + h[step:] * _ODD[3]
        step *= 2
    whole = text[: len(h)] == text[width - 1 :]
    h, text = h[whole], text[: len(h)][whole]
    h = h ^ (text.astype(np.uint64) * _ODD[1])
    order = np.argsort(h)
    same = (h[order[1:]] == h[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    out[text[order[1:][same]]] = True
    return out


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order and the LCP of each with the next."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
    levels, step = [], 1
    while True:
        levels.append(np.append(rank, np.int32(-1)))
        key = rank.astype(np.int64) * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int32)
        new[order] = np.append(0, np.cumsum(key[order[1:]] != key[order[:-1]]))
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            break
    i, j = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # A word more than the whole stands at the end of each level, so equal ranks mean equal words inside the text.
        more = np.where(levels[k][i] == levels[k][j], 1 << k, 0)
        i, j, lcp = i + more, j + more, lcp + more
    return order, lcp


def runs_of(ids: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text, by start and then period."""
    n = len(ids)
    if n < max(2, least):
        return []
    order, lcp = suffix_order(ids)
    shortest = -(-least * (times - 1) // times)
    joins = np.flatnonzero(lcp >= shortest)
    joins = joins[np.argsort(-lcp[joins], kind="stable")]
    places = {int(k): [int(order[k])] for k in np.union1d(joins, joins + 1)}
    above = {k: k for k in places}

    def find(k: int) -> int:
        while above[k] != k:
            above[k] = k = above[above[k]]
        return k

    seeds: dict[tuple[int, int], int] = {}
    for at, common in zip(joins.tolist(), lcp[joins].tolist(), strict=True):
        a, b = find(at), find(at + 1)
        if len(places[a]) < len(places[b]):
            a, b = b, a
        large, small = places[a], places.pop(b)
        above[b] = a
        for x in small:
            k = bisect_left(large, x)
            for i, j in ((large[k - 1], x) if k else (x, x), (x, large[k]) if k < len(large) else (x, x)):
                period = j - i
                if 0 < period <= common and period + common >= max(least, times * period):
                    end = j + common
                    if seeds.get((end, period), n) > i:
                        seeds[end, period] = i
        if len(small) < 8:
            for x in small:
                large.insert(bisect_left(large, x), x)
        else:
            large += small
            large.sort()  # two sorted stretches: a merge
    found: list[tuple[int, int, int]] = []
    here: list[tuple[int, int]] = []
    last = -1
    for (end, period), start in sorted(seeds.items()):
        if end != last:
            here, last = [], end
        if not any(period % p == 0 and s <= start for p, s in here):
            here.append((period, start))
            found.append((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _collapsed(data: bytes, runs: list[tuple[int, int, int]], n: int) -> str:
    """The words outside the repeats of all runs, one blank between them."""
    if not runs:
        return b" ".join(b" ".join(w) for w in _words(data) if w).decode("utf-8", "surrogatepass")
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    keep, at, out = np.cumsum(edge) == 0, 0, []
    for w in _words(data):
        out += [w[k] for k in np.flatnonzero(keep[at : at + len(w)])]
        at += len(w)
    return b" ".join(out).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, *keep: str, least: int = 24, times: int = 3) -> DataFrame:
    """``keep``, doc_id, n_words, runs (start, length, period; word numbers) and collapsed of every text: its words without
    those of a run after the run's first period. A run has ``least`` words and ``times`` periods at least."""
    rows = docs.select(*(F.col(k) for k in keep), "doc_id", F.coalesce(docs["text"], F.lit("")).alias("__text"))
    width = 1 << max(0, (-(-least * (times - 1) // times)).bit_length() - 1)

    def look(some: list[bytes]) -> list[tuple[int, list[tuple[int, int, int]], str]]:
        known: dict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        ids = [_numbered(x, known) for x in some]
        hit = repeated_windows(ids, width)
        runs = [runs_of(x, least, times) if h else [] for x, h in zip(ids, hit, strict=True)]
        return [(len(x), r, _collapsed(d, r, len(x))) for d, x, r in zip(some, ids, runs, strict=True)]

    @F.pandas_udf("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            out, some, size = [], [], 0
            for t in s:
                some.append(t.encode("utf-8", "surrogatepass"))
                size += len(some[-1])
                if size > 6 * AT_ONCE:
                    out += look(some)
                    some, size = [], 0
            out += look(some) if some else []
            runs = [[{"start": a, "length": b, "period": c} for a, b, c in r] for _, r, _ in out]
            yield pd.DataFrame({"n_words": pd.Series([x[0] for x in out], dtype="int64"), "runs": runs, "collapsed": [x[2] for x in out]})

    found = rows.withColumn("__found", search("__text"))
    return found.select(*keep, "doc_id", "__found.*")


def greatest_run(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; ties to the smaller start, then period. Null without runs."""
    first = F.get(runs, F.lit(0))
    return F.aggregate(runs, first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
