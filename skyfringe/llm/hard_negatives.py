"""Hard negatives by Four-Russians scoring.

Components are whole numbers. A vector is kept as packed bit planes: for each group of eight dimensions and each binary
place, one byte says which of the eight numbers have that bit (two's complement, so the top place counts negative).
For an anchor and a group there is a table of the sums of all 256 subsets of its eight numbers; each of its entries is an
earlier entry plus one number. A candidate's byte looks up what a place adds, the look-ups of all groups are added, and
doubling from the top place down gives the exact inner product without a multiplication.

Anchors and all rows meet in blocks: every block of anchors with every block of rows, each pair one task's group of at
most about ``anchor_rows`` times ``block_rows`` scores, worked off in strips. First each anchor scores the rows of
its own label and keeps its ``positives`` best of each block; then, their scores known, it scores the rows of other labels
and keeps the first ``negatives`` inside each positive's window. Every pair is scored once. What a block keeps is a few
rows an anchor, ranked after one exchange by anchor. Blocks are dealt by row number, so no label, vector or id that fills
the table makes a large block. Blocks are as even as monotonically increasing ids are within their partitions.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; a shorter vector counts as
filled up with zeros; numbers beyond 64 bits are held at their ends and sums of products wrap as whole numbers do; rows
equal in id, label and vector count once; rows that share an id and differ are rows of their own, but none is another's
positive or negative; ties go to the smaller id; an anchor without another row of its label, or without a row in the
window, gives no rows; further columns are left behind; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

GROUP = 8


def bit_planes(x: np.ndarray, places: int) -> np.ndarray:
    """rows x groups x places bytes of whole numbers (rows x dimensions); dimensions are filled up to full groups."""
    n, d = x.shape
    groups = -(-d // GROUP)
    full = np.zeros((n, groups * GROUP), np.int64)
    full[:, :d] = x
    eight = full.reshape(n, groups, GROUP)
    weight = 1 << np.arange(GROUP)
    return np.stack([(((eight >> k) & 1) * weight).sum(2) for k in range(places)], 2).astype(np.uint8)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """groups x 256 x anchors: the sum of each subset of an anchor's eight numbers in each group."""
    n, d = anchors.shape
    groups = -(-d // GROUP)
    full = np.zeros((n, groups * GROUP), np.int64)
    full[:, :d] = anchors
    table = np.zeros((groups, 1 << GROUP, n), np.int64)
    for k in range(GROUP):
        table[:, 1 << k : 2 << k] = table[:, : 1 << k] + full[:, k::GROUP].T[:, None, :]
    # A place adds at most one entry a group: the narrowest type that holds their sum.
    most = int(np.abs(table.astype(np.float64)).max(axis=(1, 2)).sum()) if n else 0
    return table.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def table_scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """rows x anchors of inner products: look-ups of all groups added, doubled from the top place down."""
    rows, groups, places = planes.shape
    exact = np.iinfo(tables.dtype).bits + places <= 32
    total = np.zeros((rows, tables.shape[2]), np.int32 if exact else np.int64)
    part = np.empty((rows, tables.shape[2]), tables.dtype)
    one = np.empty_like(part)
    for k in range(places - 1, -1, -1):
        np.take(tables[0], planes[:, 0, k], axis=0, out=part, mode="clip")
        for g in range(1, groups):
            np.take(tables[g], planes[:, g, k], axis=0, out=one, mode="clip")
            part += one
        total += total
        if k == places - 1:
            total -= part
        else:
            total += part
    return total


def _numbers(cells: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(c, "<i8") for c in cells]) if len(cells) else np.zeros((0, 0), np.int64)


def _planes(cells: pd.Series, places: int) -> np.ndarray:
    flat = np.stack([np.frombuffer(c, np.uint8) for c in cells])
    return flat.reshape(len(flat), -1, places)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` first of one row of scores, ties to the smaller id; rows with a smaller id stand first."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        above, ties = np.flatnonzero(score > edge), np.flatnonzero(score == edge)
        at = np.concatenate([above, ties[: k - len(above)]])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))]


def _strips(rows: pd.DataFrame, anchors: pd.DataFrame, places: int, own: bool, strip: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(anchors of one label, ids, scores anchors x rows) of a strip of the rows of that label, or of all other labels."""
    rows = rows.sort_values("vec_id", kind="stable")
    ids, label, planes = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _planes(rows["planes"], places)
    for name, some in anchors.groupby("anchor_label", sort=True):
        which = np.flatnonzero((label == name) == own)
        if len(which):
            tables = subset_sums(_numbers(some["numbers"]))
            for at in range(0, len(which), strip):
                part = which[at : at + strip]
                yield some, ids[part], np.ascontiguousarray(table_scores(planes[part], tables).T)


def block_positives(rows: pd.DataFrame, anchors: pd.DataFrame, places: int, k: int, *, strip: int = 4096) -> pd.DataFrame:
    """(anchor_id, row, positive_id, positive_score): for each anchor the ``k`` best of its own label in each strip."""
    out = []
    for some, ids, scores in _strips(rows, anchors, places, True, strip):
        for anchor, row, s in zip(some["anchor_id"], some["row"], scores, strict=True):
            other = np.flatnonzero(ids != anchor)
            at = other[_best(s[other], ids[other], k)]
            out.append(pd.DataFrame({"anchor_id": anchor, "row": row, "positive_id": ids[at], "positive_score": s[at].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor_id", "row", "positive_id", "positive_score")})


def block_negatives(rows: pd.DataFrame, anchors: pd.DataFrame, places: int, k: int, low: int, high: int, *, strip: int = 4096) -> pd.DataFrame:
    """(row, positive_rank, negative_id, negative_score): the ``k`` first rows of another label in each positive's window
    low * positive <= 100 * negative <= high * positive, in each strip. ``anchors`` has the positives' scores as a list."""
    out = []
    for some, ids, scores in _strips(rows, anchors, places, False, strip):
        for anchor, row, positives, s in zip(some["anchor_id"], some["row"], some["positive_scores"], scores, strict=True):
            bounds = [(-(-low * int(p) // 100), high * int(p) // 100) for p in positives]
            bottom, top = min(a for a, _ in bounds), max(b for _, b in bounds)
            near = np.flatnonzero((s >= bottom) & (s <= top) & (ids != anchor))
            if len(near):
                n, names = s[near].astype(np.int64), ids[near]
                for rank, (a, b) in enumerate(bounds):
                    inside = np.flatnonzero((n >= a) & (n <= b))
                    at = inside[_best(n[inside], names[inside], k)]
                    if len(at):
                        out.append(pd.DataFrame({"row": row, "positive_rank": rank, "negative_id": names[at], "negative_score": n[at]}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "positive_rank", "negative_id", "negative_score")})


def hard_negatives(
    vectors: DataFrame, anchors: Column, *, label: Column | None = None, scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, anchor_rows: int = 2048, block_rows: int = 8_192
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``vectors`` has vec_id, embedding and
    label; ``anchors`` is a condition on vec_id, ``label`` an expression that replaces the label."""
    spark = vectors.sparkSession
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    usable = named.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    # Casting a double to long holds it at the ends of a long.
    whole = usable.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long"))).dropDuplicates(["vec_id", "label", "v"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            numbers = [np.asarray(x, "<i8") for x in b["v"]]
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "size": [len(x) for x in numbers], "numbers": [x.tobytes() for x in numbers],
                                "least": [int(x.min()) if len(x) else 0 for x in numbers], "most": [int(x.max()) if len(x) else 0 for x in numbers]})

    packed = whole.mapInPandas(pack, "vec_id long, label long, size long, numbers binary, least long, most long")
    known = materialize(packed.withColumn("row", F.monotonically_increasing_id()))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    is_anchor = anchors
    n, n_anchors, longest, least, most = known.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.max("size"), F.min("least"), F.max("most")).first()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    places = max(int(most).bit_length(), int(-least - 1).bit_length() if least < 0 else 0) + 1
    width = -(-max(1, int(longest)) // GROUP) * GROUP
    row_blocks, anchor_blocks = max(1, -(-n // block_rows)), max(1, -(-n_anchors // anchor_rows))

    def planes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                full = np.zeros((len(b), width), np.int64)
                for k, c in enumerate(b["numbers"]):
                    x = np.frombuffer(c, "<i8")
                    full[k, : len(x)] = x
                # One constant object for all rows that aren't anchors.
                numbers = [f.tobytes() if a else b"" for f, a in zip(full, b["anchor"], strict=True)]
                yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "row": b["row"], "anchor": b["anchor"], "numbers": numbers, "planes": [p.tobytes() for p in bit_planes(full, places)]})

    indexed = materialize(known.withColumn("anchor", is_anchor).select("vec_id", "label", "row", "anchor", "numbers").mapInPandas(planes, "vec_id long, label long, row long, anchor boolean, numbers binary, planes binary"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = indexed.select("vec_id", "label", "planes", F.pmod("row", F.lit(row_blocks)).cast("int").alias("rb"), each(anchor_blocks).alias("ab"))
    asked = indexed.where("anchor").select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), "numbers", "row", F.pmod(F.xxhash64("row"), F.lit(anchor_blocks)).cast("int").alias("ab"))
    spread = asked.withColumn("rb", each(row_blocks))
    unit = ["ab", "rb"]
    # Few bytes make many scores, so blocks are dealt by their number and not left to be merged by their size.
    tasks = min(row_blocks * anchor_blocks, 4096)
    rows, spread = rows.repartition(tasks, *unit), spread.repartition(tasks, *unit)
    found = rows.groupBy(*unit).cogroup(spread.groupBy(*unit)).applyInPandas(lambda r, a: block_positives(r, a, places, positives), "anchor_id long, row long, positive_id long, positive_score long")
    by_anchor = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    best = materialize(found.withColumn("positive_rank", F.row_number().over(by_anchor) - 1).where(F.col("positive_rank") < positives))
    scored = best.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_score"))), lambda p: p["positive_score"]).alias("positive_scores"))
    again = asked.join(scored, "row").withColumn("rb", each(row_blocks)).repartition(tasks, *unit)
    windowed = rows.groupBy(*unit).cogroup(again.groupBy(*unit)).applyInPandas(lambda r, a: block_negatives(r, a, places, negatives, low, high), "row long, positive_rank long, negative_id long, negative_score long")
    place = F.row_number().over(Window.partitionBy("row", "positive_rank").orderBy(F.desc("negative_score"), "negative_id"))
    first = windowed.withColumn("rank", place.cast("int")).where(F.col("rank") <= negatives)
    out = materialize(first.join(best.select("row", "positive_rank", "anchor_id", "positive_id", "positive_score"), ["row", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    discard(known, indexed, best)
    return out
