"""Best-fit packing by linear grouping.

Lengths are at most the capacity, so the input of the packing problem is a histogram with ``capacity`` counts,
whatever the corpus. On it, the driver: sorts large lengths and cuts them into groups of equal cardinality, rounds
each group up to its largest length, chooses configurations of those few sizes, puts the actual lengths back into
their slots, and best-fits small lengths into what is left. The result is a list of runs: documents of a length with
ranks from a to b go to sequences from s on, at one offset. Ranks are given by Spark within (length, salt) with salts
in proportion to the rows, so no length meets in one task, and runs (a few thousand, bounded by the capacity) are
broadcast.

Defined results: null text counts as empty and is one piece with the end id alone; repeated rows are packed each;
an empty table gives an empty table; columns not asked for are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_rows
from .pretoken import library_memo

#: (length, first rank, how many, first sequence, offset)
Run = tuple[int, int, int, int, int]


def token_pieces(docs: DataFrame, path: str, *, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece: a longer document is cut from its end, so
    that only the first piece may be shorter than the capacity."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, end = library_memo(path), end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc, parts in zip(batch["doc_id"], memo.of(batch["text"]), strict=True):
                raw = b"".join(parts) + end
                n = len(raw) // 4
                first = n % capacity or min(n, capacity)
                start = 0
                for k in range(-(-n // capacity)):
                    size = first if k == 0 else capacity
                    ids = raw[4 * start : 4 * (start + size)]
                    out.append((doc, k, start, size, zlib.crc32(ids), *([ids] if with_ids else [])))
                    start += size
            columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            made = pd.DataFrame(out, columns=columns)
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return text_rows(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, schema)


def _fill(room: int, sizes: list[int], left: list[int]) -> list[int]:
    """How many of each size, none above what is left, to fill ``room`` as far as can be."""
    best: list[tuple[int, int] | None] = [None] * (room + 1)  # the last size used and how many of it
    best[0] = (-1, 0)
    for k, (size, n) in enumerate(zip(sizes, left, strict=True)):
        if not n or size > room:
            continue
        for total in range(room - size, -1, -1):
            if best[total] is not None and best[total][0] != k:
                at, used = total, 0
                while used < n and at + size <= room and best[at + size] is None:
                    at, used = at + size, used + 1
                    best[at] = (k, used)
    total = max(t for t in range(room + 1) if best[t] is not None)
    counts = [0] * len(sizes)
    while total:
        k, used = best[total]
        counts[k] += used
        total -= used * sizes[k]
    return counts


def plan_packing(histogram: dict[int, int], capacity: int, *, groups: int = 512, small_share: float = 1 / 8) -> list[Run]:
    """Runs that place every length of the histogram; sequences are numbered from 0."""
    runs: list[Run] = []
    rank = dict.fromkeys(histogram, 0)
    sequences = 0
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], n, first, offset))
        rank[length] += n

    if n := histogram.get(capacity, 0):
        put(capacity, n, 0, 0)
        sequences = n
    small_most = int(capacity * small_share)
    large = [(x, histogram[x]) for x in sorted(histogram, reverse=True) if small_most < x < capacity and histogram[x]]

    # Groups of equal cardinality over the sorted lengths; a length may lie in two groups.
    total = sum(n for _, n in large)
    quota = max(1, -(-total // groups))
    stock: list[list[list[int]]] = []
    room = 0
    for length, n in large:
        while n:
            if not room:
                stock.append([])
                room = quota
            used = min(n, room)
            stock[-1].append([length, used])
            n, room = n - used, room - used
    sizes = [g[0][0] for g in stock]  # rounded up to the largest of the group
    left = [sum(n for _, n in g) for g in stock]
    while any(left):
        # The largest size that is left, and the others that fill up its sequence best; as often as they last.
        k = next(i for i, n in enumerate(left) if n)
        left[k] -= 1
        counts = _fill(capacity - sizes[k], sizes, left)
        left[k] += 1
        counts[k] += 1
        times = min(n // c for n, c in zip(left, counts, strict=True) if c)
        classes = [(sequences, times, 0)]
        sequences += times
        for g, c in enumerate(counts):
            left[g] -= c * times
            for _ in range(c):  # actual documents for a slot of this configuration
                filled = []
                for first, n, used in classes:
                    while n:
                        length, have = stock[g][0]
                        m = min(n, have)
                        put(length, m, first, used)
                        filled.append((first, m, used + length))
                        first, n = first + m, n - m
                        stock[g][0][1] -= m
                        if not stock[g][0][1]:
                            stock[g].pop(0)
                classes = filled
        for first, n, used in classes:
            open_bins.setdefault(capacity - used, []).append((first, n))

    for length in sorted((x for x in histogram if x <= small_most and histogram[x]), reverse=True):
        n = histogram[length]
        while n:
            fit = min((r for r in open_bins if r >= length and open_bins[r]), default=None)
            if fit is None:
                each = capacity // length
                fresh = -(-n // each)
                open_bins.setdefault(capacity, []).append((sequences, fresh))
                sequences += fresh
                continue
            first, bins = open_bins[fit].pop()
            if not open_bins[fit]:
                del open_bins[fit]
            each = min(fit // length, n)
            use = min(bins, n // each)
            for k in range(each):
                put(length, use, first, capacity - fit + k * length)
            n -= use * each
            if fit - each * length:
                open_bins.setdefault(fit - each * length, []).append((first, use))
            if bins > use:
                open_bins.setdefault(fit, []).append((first + use, bins - use))
    return runs


def pack(pieces: DataFrame, *, capacity: int = 1024, salt_rows: int = 20_000) -> DataFrame:
    """``pieces`` (with doc_id, piece, start, length, ids_crc32) with sequence_id and offset. Their lineage should end
    at a table, as they are read twice."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs = plan_packing(histogram, capacity)
    salts = max(1, sum(histogram.values()) // salt_rows)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1)
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("__before", F.sum("n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("n")).drop("n")
    placed = ranked.join(counts, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    table = spark.createDataFrame(runs, "length long, __first long, __n long, __sequence long, offset long")
    return (
        placed.join(F.broadcast(table), "length")
        .where((F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__n")))
        .withColumn("sequence_id", F.col("__sequence") + F.col("__rank") - F.col("__first"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack; see ``token_pieces`` and ``pack`` for the columns."""
    return pack(materialize(token_pieces(docs, path, capacity=capacity, end_id=end_id, with_ids=with_ids)), capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (little-endian unsigned 32-bit) of packed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
