"""Token counts by rank-synchronous merging.

Pre-tokens not met before are held together as one flat array of symbols with their sequence numbers. Every round
looks up the rank of all neighbour pairs at once, takes each sequence's lowest rank and merges every place where
that pair stands, in all sequences together; sequences without a mergeable pair leave with their symbol count. Each
token of the vocabulary is made by one merge only, so this order gives what merging one pair at a time gives.

Pre-tokens of more than ``LONGEST`` bytes take many rounds, so theirs touch nothing but the places that merge: places
wait under the rank of their pair, the lowest rank that any of these sequences has is applied wherever it stands, and
only the pairs beside a merge are looked up again. A run of a megabyte without a blank takes seconds.

Counting is one pass without a shuffle. Defined results: null text counts as empty (0 bytes, 0 tokens); the special
string counts as its one token; repeated rows get a result each; an empty table gives an empty table; further columns, whatever
their names, are left behind unless named in ``keep``.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows
from .pretoken import SPECIAL, Memo

#: Inside a chunk only the leading blank is white space, so the pattern's white-space branches aren't needed.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^ \p{L}\p{N}]+")
NONE = np.int64(1 << 40)
SHIFT = 20
LONGEST = 64


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable bytes for themselves,
    the others, in order, from code point 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class RankMerger:
    """The merges of a byte-level BPE file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for letter, byte in _byte_letters().items():
            self.byte_id[byte] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([(vocab[a] << SHIFT) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that survive in each word."""
        lengths = np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(words), np.int64)
        for which, count in ((lengths <= LONGEST, self._short), (lengths > LONGEST, self._long)):
            some = np.flatnonzero(which)
            if len(some):
                ids = self.byte_id[np.frombuffer(b"".join(words[k] for k in some), np.uint8)]
                out[some] = count(ids, np.repeat(np.arange(len(some)), lengths[some]), len(some))
        return out

    def _short(self, ids: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        while len(ids):
            first = np.empty(len(ids), bool)
            first[0], first[1:] = True, seq[1:] != seq[:-1]
            starts = np.flatnonzero(first)
            rank = np.full(len(ids), NONE)
            rank[:-1] = np.where(first[1:], NONE, self._ranks(ids[:-1], ids[1:]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            done = lowest == NONE
            out[seq[starts[done]]] = sizes[done]
            low = np.repeat(lowest, sizes)
            hit = (rank == low) & (low != NONE)
            # Of a run of overlapping places (one letter again and again) every other one merges, from the left.
            place = np.arange(len(ids))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            hit &= (place - run) % 2 == 0
            ids = np.where(hit, self.made[np.where(hit, low, 0)], ids)
            stay = ~np.append(False, hit[:-1]) & np.repeat(~done, sizes)
            ids, seq = ids[stay], seq[stay]
        return out

    def _long(self, ids: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
        out = np.bincount(seq, minlength=n)
        last = len(ids)  # stands for no neighbour
        after, before = np.arange(1, last + 1), np.arange(-1, last)
        after[np.flatnonzero(seq[1:] != seq[:-1])] = last
        after[-1:] = last
        before[0], before[np.flatnonzero(seq[1:] != seq[:-1]) + 1] = last, last
        rank = np.full(last + 1, NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def look_up(places: np.ndarray) -> None:
            places = places[places < last]
            right = after[places]
            rank[places] = np.where(right < last, self._ranks(ids[places], ids[np.minimum(right, last - 1)]), NONE)
            places = places[rank[places] < NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            if len(places):
                r = rank[places]
                cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
                for value, part in zip(r[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                    if value not in waiting:
                        waiting[value] = []
                        heapq.heappush(order, value)
                    waiting[value].append(part)

        look_up(np.arange(last))
        while order:
            low = heapq.heappop(order)
            left = np.unique(np.concatenate(waiting.pop(low)))
            left = left[rank[left] == low]
            # As above: of places that overlap in a run, every other one.
            overlaps = np.append(False, after[left[:-1]] == left[1:])
            place = np.arange(len(left))
            left = left[(place - np.maximum.accumulate(np.where(overlaps, 0, place))) % 2 == 0]
            right = after[left]
            ids[left] = self.made[low]
            rank[right] = NONE
            after[left] = after[right]
            before[after[right]] = left  # the place that stands for no neighbour may take any value
            out -= np.bincount(seq[left], minlength=n)
            look_up(np.union1d(left, before[left]))
        return out


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    merger = RankMerger(path)

    def encode(new: list[str]) -> list[int]:
        pieces = [[] if x == SPECIAL else [x] if x.isspace() else PIECE.findall(x) for x in new]
        words = list(set().union(*pieces))
        n = dict(zip(words, merger.counts([w.encode("utf-8", "surrogatepass") for w in words]).tolist(), strict=True))
        return [1 if x == SPECIAL else sum(map(n.__getitem__, p)) for x, p in zip(new, pieces, strict=True)]

    return Memo(encode)


def count_tokens(docs: DataFrame, path: str, *keep: str, limit: int = 512) -> DataFrame:
    """``keep``, doc_id, n_bytes, n_tokens and over_limit of every text. ``path``: the tokenizer's JSON file."""

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _memo(path)
        for s in texts:
            yield pd.Series([sum(x) for x in memo.of(s)], dtype="int64")

    rows = text_rows(docs, *keep).select(*keep, "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counted("text").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
