"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are complete and binary: each node splits along the difference of two random vectors at the median of a sample
of at most ``sample_rows`` vectors; every row is then indexed in every tree. For a query one priority queue over all
trees gives the next leaf, that with the least sum of squared margins on its path. Candidates of visited leaves, and
no others, are scored in double precision; the best of each unit of work, and then of all, are kept, and scored again
term by term, so that a score doesn't depend on who else was in a unit. Inner products are reduced to angles by one more
coordinate, sqrt(max norm ** 2 - norm ** 2).

How many leaves a query visits is measured and not set: up to ``tests`` queries, chosen by hash, are answered exactly
over all rows, and the number of leaves is the least by which ``recall`` of their true neighbours were met. Vectors
with structure take few leaves; vectors without any, whose neighbours are hardly nearer than others, take most of them.

Equal vectors are indexed once, with the ``k + 1`` smallest ids that carry them, which is all that any answer can
hold; so a vector that fills a third of the table costs one entry. A unit of work is a stretch of a tree's leaves
and a salt, of about ``unit_rows`` vectors, so no leaf outgrows a task; large units also mean few partial answers.
A forest has at most ``sample_rows / 8`` leaves a tree, so that its broadcast is bounded; beyond, leaves grow.

Defined results: vectors that are null, zero, or that hold null or non-finite components take no part, nor do rows
without an id; a vector shorter than the longest counts as if filled up with zeros; repeated rows count once; fewer
candidates than ``k`` give fewer rows; ties go to the smaller id; further columns are left behind; an empty table gives
an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass
class Forest:
    """``trees`` complete trees of one depth, nodes numbered as in a heap; the children of i are 2i + 1 and 2i + 2."""

    normals: np.ndarray  # trees x nodes x dimensions
    offsets: np.ndarray  # trees x nodes
    top: float  # the largest norm

    @property
    def depth(self) -> int:
        return int(self.offsets.shape[1] + 1).bit_length() - 1

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        y = self.lift(x)
        out = np.empty((len(x), len(self.normals)), np.int64)
        for t in range(len(self.normals)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = (y * self.normals[t][at]).sum(1) > self.offsets[t][at]
                at = 2 * at + 1 + side
            out[:, t] = at - self.offsets.shape[1]
        return out

    def search(self, x: np.ndarray, visit: int) -> list[list[tuple[int, int]]]:
        """For each query, the (tree, leaf) pairs that the shared queue gives first."""
        y = self.lift(x, query=True)
        inner = self.offsets.shape[1]
        margins = np.stack([y @ n.T - o for n, o in zip(self.normals, self.offsets, strict=True)], 1)
        out = []
        for m in margins.tolist():
            queue = [(0.0, t, 0) for t in range(len(m))]
            found = []
            while queue and len(found) < visit:
                cost, t, node = heapq.heappop(queue)
                row = m[t]
                while node < inner:
                    gap = row[node]
                    near = 2 * node + 1 + (gap > 0)
                    heapq.heappush(queue, (cost + gap * gap, t, 4 * node + 3 - near))
                    node = near
                found.append((t, node - inner))
            out.append(found)
        return out


def grow_forest(sample: np.ndarray, top: float, trees: int, depth: int, seed: int = 5) -> Forest:
    rng = np.random.default_rng(seed)
    forest = Forest(np.zeros((trees, 2**depth - 1, sample.shape[1] + 1)), np.zeros((trees, 2**depth - 1)), top)
    y = forest.lift(sample)
    for t in range(trees):
        members = {0: np.arange(len(y))}
        for node in range(2**depth - 1):
            here = members.pop(node)
            a, b = rng.choice(here if len(here) > 1 else len(y), 2, replace=len(y) < 2)
            normal = y[a] - y[b]
            normal /= np.linalg.norm(normal) or 1.0
            along = y[here] @ normal
            forest.normals[t, node], forest.offsets[t, node] = normal, np.median(along) if len(here) else 0.0
            side = along > forest.offsets[t, node]
            members[2 * node + 1], members[2 * node + 2] = here[~side], here[side]
    return forest


def _matrix(cells) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in cells]) if len(cells) else np.zeros((0, 0))


def _best(query: np.ndarray, cls: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` largest finite scores of each row, ties to the smaller class."""
    parts = [pd.DataFrame({"query": np.zeros(0, np.int64), "cls": np.zeros(0, np.int64), "score": np.zeros(0)})]
    place = max(0, scores.shape[1] - k)
    least = np.partition(scores, place, axis=1)[:, place] if scores.shape[1] else np.zeros(len(scores))
    for name, row, edge in zip(query, scores, least, strict=True):
        near = np.flatnonzero((row >= edge) & np.isfinite(row))
        near = near[np.lexsort((cls[near], -row[near]))][:k]
        parts.append(pd.DataFrame({"query": name, "cls": cls[near], "score": row[near]}))
    return pd.concat(parts)


def score_leaves(members: pd.DataFrame, asked: pd.DataFrame, k: int, *, at_once: int = 64) -> pd.DataFrame:
    """(query, cls, score): for each row of ``asked`` the best of the leaves it names, and nothing else is scored."""
    members = members.sort_values(["leaf", "cls"])
    leaf, cls, m = members["leaf"].to_numpy(), members["cls"].to_numpy(), _matrix(members["v"])
    names, begin = np.unique(leaf, return_index=True)
    end = np.append(begin, len(leaf))[1:]
    # Queries that start in one leaf go together: they share most of what they visit.
    asked = asked.iloc[np.argsort([min(x) for x in asked["leaves"]], kind="stable")]
    parts = []
    for at in range(0, len(asked), at_once):
        some = asked.iloc[at : at + at_once]
        q = _matrix(some["v"])
        opened = np.zeros((len(some), len(names)), bool)
        for n, x in enumerate(some["leaves"]):
            opened[n, np.searchsorted(names, np.intersect1d(x, names))] = True
        used = np.flatnonzero(opened.any(0))
        columns = np.concatenate([np.arange(begin[j], end[j]) for j in used]) if len(used) else np.zeros(0, np.int64)
        scores, at_column = np.full((len(some), len(columns)), -np.inf), 0
        for j in used:
            who, width = np.flatnonzero(opened[:, j]), end[j] - begin[j]
            scores[who, at_column : at_column + width] = q[who] @ m[begin[j] : end[j]].T
            at_column += width
        parts.append(_best(some["cls"].to_numpy(), cls[columns], scores, k))
    return pd.concat(parts)


def exact_nearest(classes: DataFrame, asked: list[tuple[int, bytes]], k: int) -> DataFrame:
    """(query, cls, score): the ``k`` best of all rows for a few queries, one pass with partial answers."""
    shared = classes.sparkSession.sparkContext.broadcast(asked)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = np.array([x for x, _ in shared.value], np.int64), _matrix([v for _, v in shared.value])
        for b in batches:
            if len(b):
                yield _best(names, b["cls"].to_numpy(), q @ _matrix(b["v"]).T, k)

    found = classes.select("cls", "v").mapInPandas(score, "query long, cls long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cls"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def leaves_to_visit(classes: DataFrame, forest: Forest, asked: list[tuple[int, bytes]], k: int, recall: float) -> int:
    """The least number of leaves by which ``recall`` of the true neighbours of some queries are met."""
    if not asked:
        return 1
    true = exact_nearest(classes, asked, k).join(classes.select("cls", "v"), "cls").toPandas()  # k rows a query
    at = forest.leaves(_matrix(true["v"]))
    turn: dict[int, dict[tuple[int, int], int]] = {}
    for (name, _), order in zip(asked, forest.search(_matrix([v for _, v in asked]), len(forest.normals) << forest.depth), strict=True):
        turn[name] = {x: n + 1 for n, x in enumerate(order)}
    met = sorted(min(turn[q][t, int(x)] for t, x in enumerate(row)) for q, row in zip(true["query"], at, strict=True))
    return met[min(len(met), int(np.ceil(recall * len(met)))) - 1]


def nearest(
    vectors: DataFrame, queries: str, *, k: int = 20, trees: int = 3, recall: float = 0.95, tests: int = 64, leaf_rows: int = 32, sample_rows: int = 65_536, unit_rows: int = 65_536
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` candidates of largest inner product for each row where the SQL condition
    ``queries`` on vec_id holds."""
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)"
    )
    longest, top = usable.agg(F.max(F.size("v")), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if longest is None:
        return spark.createDataFrame([], schema)
    rows = usable.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v"))))

    # The filter on row_number keeps k + 1 rows of a vector in each task before anything is sent.
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    some = rows.dropDuplicates(["vec_id", "v"]).withColumn("n", first).where(F.col("n") <= k + 1)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cls": b["cls"], "ids": b["ids"], "v": [np.asarray(x, "<f8").tobytes() for x in b["v"]]})

    grouped = some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(grouped.select(F.element_at("ids", 1).alias("cls"), "ids", "v").mapInPandas(pack, "cls long, ids array<long>, v binary"))
    # Equal queries are searched once, as their class.
    of_query = rows.where(queries).select(F.col("vec_id").alias("query_id"), "v").distinct()
    by_class = materialize(of_query.join(some.where("n = 1").select("v", F.col("vec_id").alias("cls")), "v").select("query_id", "cls"))
    asking = by_class.select("cls").distinct().join(classes, "cls").select("cls", "v")

    total = classes.count()
    share = min(1.0, sample_rows / total)
    drawn = classes.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("cls", "v").toPandas()
    sample = _matrix(drawn.sort_values("cls")["v"])
    depth = max(0, min(int(np.log2(max(1, total / leaf_rows))), int(np.log2(max(1, len(sample) / 8)))))
    grown = grow_forest(sample, float(top), trees, depth)
    forest = spark.sparkContext.broadcast(grown)
    tested = [(r["cls"], bytes(r["v"])) for r in asking.orderBy(F.xxhash64("cls"), "cls").limit(tests).collect()]
    visit = leaves_to_visit(classes, grown, tested, k + 1, recall)
    leaves = 2**depth
    stretch = max(1, int(leaves * unit_rows / total))  # leaves in a unit
    salts = max(1, -(-total * stretch // (leaves * unit_rows)))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at = forest.value.leaves(_matrix(b["v"]))
                n = at.shape[1]
                yield pd.DataFrame({"tree": np.tile(np.arange(n), len(b)), "leaf": at.reshape(-1), "cls": np.repeat(b["cls"].to_numpy(), n), "v": np.repeat(b["v"].to_numpy(), n)})

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = []
                for cls, v, found in zip(b["cls"], b["v"], forest.value.search(_matrix(b["v"]), visit), strict=True):
                    per: dict[tuple[int, int], list[int]] = {}
                    for t, leaf in found:
                        per.setdefault((t, leaf // stretch), []).append(leaf)
                    out += [(t, s, cls, v, x) for (t, s), x in per.items()]
                yield pd.DataFrame(out, columns=["tree", "stretch", "cls", "v", "leaves"])

    members = classes.select("cls", "v").mapInPandas(index, "tree long, leaf long, cls long, v binary")
    members = members.withColumn("stretch", F.floor(F.col("leaf") / stretch)).withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(salts)))
    ask = asking.mapInPandas(probes, "tree long, stretch long, cls long, v binary, leaves array<long>")
    ask = ask.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def score(l_rows: pd.DataFrame, q_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(l_rows) or not len(q_rows):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "cls": np.zeros(0, np.int64), "score": np.zeros(0)})
        return score_leaves(l_rows, q_rows, k + 1)

    unit = ["tree", "stretch", "salt"]
    found = members.groupBy(*unit).cogroup(ask.groupBy(*unit)).applyInPandas(score, "query long, cls long, score double")
    merged = found.groupBy("query", "cls").agg(F.max("score").alias("score"))
    best = merged.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cls"))).where(F.col("r") <= k + 1)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = _matrix(b["v"]), _matrix(b["w"])
                terms = np.zeros(len(b))
                for j in range(x.shape[1]):
                    terms += x[:, j] * y[:, j]
                yield pd.DataFrame({"query": b["query"], "ids": b["ids"], "score": terms})

    vector = classes.select(F.col("cls").alias("query"), F.col("v").alias("w"))
    rescored = best.select("query", "cls").join(classes, "cls").join(vector, "query").select("query", "ids", "v", "w").mapInPandas(again, "query long, ids array<long>, score double")
    pairs = by_class.withColumnRenamed("cls", "query").join(rescored, "query")
    each = pairs.select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
