"""N-gram Jaccard join with PartEnum signatures, and the components of its links.

A document's set holds the 64-bit hashes of its distinct word n-grams. Two sets link when
``den * intersection >= num * union``. The join is exact on those sets:

1. Equal sets are one class, known by a hash of the set; everything below works on one text of each class.
2. PartEnum: sizes fall into bands so that linked sets are in the same band or the next; a set takes part in its own
   band and the one above. In a band, linked sets differ in at most k elements. Elements are dealt by hash into n1
   groups of n2 parts. With more than k // 2 groups, some group differs in at most one part, so two linked sets agree
   on some n2 - 1 parts of some group: these subsets, with their elements' sum, are the signatures. Two of three parts
   make one (n2 = 3), so that texts which only have a passage in common seldom share one. There are more groups than
   needed, so empty subsets, which say nothing, give no signature as long as the groups that have one are too few to
   hold all the agreement; the rare set with more of them gives a signature for emptiness too.
3. Of the texts that share a signature, the one with most such company is the pivot. Every text is compared with the
   pivot that it shares most signatures with, and where that leaves it apart from another of its pivots, with that one.
   Links give first components.
4. Where a signature still has several components, every text outside its largest component is compared with every
   text of the signature, gathered by that component.

Comparing works on blocks: (hub, block of left, block of right) is a unit of work whose rows are sets, so its rows
grow with a group's size and not with its square, and a hot group is spread over many tasks. A block emits no more
links than it takes to connect what it found linked, which is all that components need. Blocks hold sketches first:
a set's size and, for each of 1,024 numbers, whether an odd count of its elements hash to it. Two sets differ in at
least as many elements as their sketches do in bits, so a pair that differs in too many bits can't link; only sets
with a partner left in their block are sent. Written tables are deleted after their last reader.

Words are told apart by 64-bit hashes that mix every eight bytes with their place, so texts made of one another's
pieces don't share them.

Defined results: null or empty text, or text without a word, has an empty set, links with nothing and is its own
component; with fewer than n words the whole sequence is the one n-gram; repeated rows and equal texts share a
component; a null doc_id never names a component unless no other document of it has one; an empty table gives an
empty table; very long texts are sets of all their n-grams; further columns are left behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_small, materialize
from .pretoken import portions

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word, in order; A-Z count as a-z. Each eight bytes of a word are mixed by
    themselves, then with their place, and a word's hash is the mixed sum of those and its length."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    space = _SPACE[data]
    before = np.append(True, space[:-1])
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    lengths = ends - starts
    pieces = (lengths + 7) // 8
    first = np.cumsum(pieces) - pieces
    padded = np.zeros(8 * int(pieces.sum()), np.uint8)
    padded[np.arange(int(lengths.sum())) + np.repeat(8 * first - (np.cumsum(lengths) - lengths), lengths)] = data[~space]
    place = np.arange(len(padded) // 8) - np.repeat(first, pieces)
    terms = mix(mix(padded.view("<u8")) + (place.astype(U) + U(1)) * _P)
    cuts = np.cumsum([len(x) + 1 for x in raw])
    return mix(np.add.reduceat(terms, first) + lengths.astype(U)), np.searchsorted(cuts, starts, "right")


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words, owner = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    factors = np.cumprod(np.full(n, _P, U))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        w, size = words[a:b], min(n, b - a)
        if not size:
            out.append(np.zeros(0, U))
            continue
        total = np.zeros(len(w) - size + 1, U)
        for k in range(size):
            total += w[k : k + len(total)] * factors[k]
        out.append(np.unique(mix(total + U(size))))
    return out


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    return mix(np.array([mix(s).sum(dtype=U) for s in sets], U) + np.array([len(s) for s in sets], U)).view(np.int64)


#: Bits of a set's sketch.
SKETCH = 1024


def _sketch(s: np.ndarray) -> bytes:
    """For each of ``SKETCH`` numbers, whether an odd count of the set's elements hash to it."""
    return np.packbits(np.bincount((mix(s + _P) >> U(54)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


class PartEnum:
    """The signature scheme for ``den * intersection >= num * union``."""

    def __init__(self, num: int, den: int, most: int = 1 << 31):
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] <= most:
            self.lows.append(self.lows[-1] * den // num + 1)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def shape(self, band: int) -> tuple[int, int, int]:
        """(k, n1, n2) of a band; k = 0 needs no signature, as equal sets are one class."""
        top = self.lows[band + 1] - 1
        k = 2 * top * (self.den - self.num) // (self.den + self.num)
        return k, k // 2 + (2 if k <= 8 else 4 + k // 16), 3

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """The 64-bit signatures of a sorted set of hashes."""
        out = [np.zeros(0, U)]
        own = self.band(len(s))
        for band in (own, own + 1):
            k, n1, n2 = self.shape(band)
            if not k:
                continue
            dealt = mix(s + U(band))
            part = (dealt >> U(11)) % U(n1 * n2)
            part = part.astype(np.int64)
            # Sums modulo 2**64 by halves, exact in double precision.
            low = np.bincount(part, (s & U(0xFFFFFFFF)).astype(np.float64), n1 * n2).astype(U)
            high = np.bincount(part, (s >> U(32)).astype(np.float64), n1 * n2).astype(U)
            sums = (low + (high << U(32))).reshape(n1, n2)
            sizes = np.bincount(part, minlength=n1 * n2).reshape(n1, n2)
            without = sizes.sum(1, keepdims=True) - sizes
            values = mix(sums.sum(1, dtype=U)[:, None] - sums + without.astype(U) * _P)
            values = mix(values + (np.arange(n1 * n2, dtype=U).reshape(n1, n2) + U(1)) * U(0xD6E8FEB86659FD93) + U(band * 0xA0761D6478BD642F % 2**64))
            out.append(values[without > 0])
            if (without == 0).any(1).sum() >= n1 - k // 2:
                out.append(mix(np.array([band + 1], U) * U(0xE7037ED1A0B428DB)))
        return np.concatenate(out)


def _class_rows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row, n_shingles and node: the hash that equal sets share."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, at = batch["doc_id"].astype("Int64"), 0
            for some in portions(batch["text"]):
                sets = shingle_sets(some, n)
                yield pd.DataFrame({"doc_id": ids.iloc[at : at + len(some)].array, "row": batch["row"].iloc[at : at + len(some)].array, "n_shingles": [len(s) for s in sets], "node": _fingerprints(sets)})
                at += len(some)

    return docs.mapInPandas(made, "doc_id long, row long, n_shingles long, node long")


def _signature_rows(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(signature, node) of every non-empty set."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scheme = PartEnum(num, den)
        for batch in batches:
            for some in portions(batch["text"]):
                sets = shingle_sets(some, n)
                found = [scheme.signatures(s) if len(s) else np.zeros(0, U) for s in sets]
                yield pd.DataFrame({"signature": np.concatenate(found).view(np.int64), "node": np.repeat(_fingerprints(sets), [len(x) for x in found])})

    return docs.mapInPandas(made, "signature long, node long")


def _sketch_rows(docs: DataFrame, n: int) -> DataFrame:
    """(node, size, sketch) of every set."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in portions(batch["text"]):
                sets = shingle_sets(some, n)
                yield pd.DataFrame({"node": _fingerprints(sets), "size": [len(s) for s in sets], "sketch": [_sketch(s) for s in sets]})

    return docs.mapInPandas(made, "node long, size long, sketch binary")


def _set_rows(docs: DataFrame, n: int) -> DataFrame:
    """(node, elements): the sets themselves, as little-endian unsigned 64-bit integers."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in portions(batch["text"]):
                sets = shingle_sets(some, n)
                yield pd.DataFrame({"node": _fingerprints(sets), "elements": [s.tobytes() for s in sets]})

    return docs.mapInPandas(made, "node long, elements binary")


def _block_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], num: int, den: int) -> list[tuple[int, int]]:
    """Links between two blocks of sets, as many as it takes to connect all that are linked."""
    values = np.concatenate([s for _, s in left])
    owner = np.repeat(np.arange(len(left)), [len(s) for _, s in left])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    sizes = np.array([len(s) for _, s in left])
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for node, s in right:
        lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(owner[at], minlength=len(left))
        for k in np.flatnonzero((den * common >= num * (sizes + len(s) - common)) & (common > 0)).tolist():
            other = left[k][0]
            if other != node and (a := root(other)) != (b := root(node)):
                up[a] = b
                out.append((other, node))
    return out


def _may_link(left: pd.DataFrame, right: pd.DataFrame, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two blocks of sketches have another set on the other side that they may link with."""
    bits = [np.frombuffer(b"".join(x["sketch"]), np.uint64).reshape(len(x), -1) for x in (left, right)]
    size = [x["size"].to_numpy() for x in (left, right)]
    node = [x["node"].to_numpy() for x in (left, right)]
    keep = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for k in range(len(left)):
        both = size[0][k] + size[1]
        apart = np.bitwise_count(bits[0][k] ^ bits[1]).sum(1, dtype=np.int64)
        may = ((den + num) * apart <= (den - num) * both) & (den * np.minimum(size[0][k], size[1]) >= num * np.maximum(size[0][k], size[1])) & (node[0][k] != node[1])
        keep[0][k] = may.any()
        keep[1][may] = True
    return keep


def _possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The (hub, node, shares) whose sketches don't rule a link out."""

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), np.uint64).reshape(len(b), -1) for c in ("sketch", "hub_sketch"))
                apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                least, most = np.minimum(b["size"], b["hub_size"]), np.maximum(b["size"], b["hub_size"])
                may = ((den + num) * apart <= (den - num) * (least + most)) & (den * least >= num * most)
                yield b.loc[may, ["hub", "node", "shares"]]

    rows = pairs.join(sketches, "node").join(sketches.toDF("hub", "hub_size", "hub_sketch"), "hub")
    return rows.mapInPandas(narrow, "hub long, node long, shares long").distinct()


def _compare(left: DataFrame, right: DataFrame, sketches: DataFrame, sets: Callable[[DataFrame], DataFrame], num: int, den: int, *, block: int = 512, unit_rows: int = 1024, broadcast_rows: int = 500_000) -> DataFrame:
    """Links (a, b) among left x right of each hub; both sides have distinct (hub, node). ``sets`` gives the sets of a
    table of nodes."""

    def dealt(side: DataFrame, number: int, own: str, other: str) -> DataFrame:
        """Each row with its own block and every block of the other side."""
        rows = join_small(side, sizes, "hub", "left", rows=broadcast_rows).withColumns({n: F.coalesce(n, F.lit(1)) for n in ("nl", "nr")})
        mine, theirs = ("nl", "nr") if number == 0 else ("nr", "nl")
        every = F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))
        return rows.select("hub", "node", F.pmod(F.xxhash64("node"), F.col(mine)).cast("int").alias(own), F.lit(number).alias("side"), every.alias(other))

    # Only hubs of more than a block need their number of blocks, a row for at least ``block`` rows.
    counted = left.select("hub", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("hub", F.lit(0).alias("l"), F.lit(1).alias("r")))
    blocks = lambda c, name: F.greatest(F.lit(1), F.ceil(F.sum(c) / block)).cast("int").alias(name)
    sizes = counted.groupBy("hub").agg(blocks("l", "nl"), blocks("r", "nr")).where("nl > 1 OR nr > 1")
    rows = dealt(left, 0, "i", "j").unionByName(dealt(right, 1, "j", "i"))
    units = lambda n: F.pmod(F.xxhash64("hub", "i", "j"), F.lit(max(1, -(-n // unit_rows)))).alias("unit")

    def blocks_of(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
        for _, g in pdf.drop_duplicates(["hub", "i", "j", "side", "node"]).groupby(["hub", "i", "j"], sort=False):
            left = (g["side"] == 0).to_numpy()
            yield g[left], g[~left]

    def narrow(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = [side[keep] for pair in blocks_of(pdf) for side, keep in zip(pair, _may_link(*pair, num, den), strict=True)]
        return pd.concat([pdf[:0], *kept])[["hub", "i", "j", "side", "node"]]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for pair in blocks_of(pdf):
            sides = [[(int(x), np.frombuffer(e, "<u8")) for x, e in zip(p["node"], p["elements"], strict=True)] for p in pair]
            if sides[0] and sides[1]:
                found += _block_links(sides[0], sides[1], num, den)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    # Small hubs share a unit; each block pair of a large one goes its own way.
    sketched = rows.join(sketches, "node").withColumn("unit", units(left.count() + right.count()))
    open_rows = materialize(sketched.groupBy("unit").applyInPandas(narrow, "hub long, i int, j int, side int, node long"))
    joined = open_rows.join(sets(open_rows.select("node").distinct()), "node").withColumn("unit", units(open_rows.count()))
    links = materialize(joined.groupBy("unit").applyInPandas(work, "a long, b long").distinct())
    discard(open_rows)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b); comp is the least node of the component.

    Each round takes the least label among neighbours and then the label's own label; rounds grow with the logarithm
    of a chain's length. Every round ends in a written table.
    """
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        moved = materialize(step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("comp")))
        discard(labels)
        labels = moved
        if not moved.where("old <> comp").limit(1).count():
            discard(edges)
            return labels.select("node", "comp")


def row_key(docs: DataFrame) -> Column:
    """A row's own hash, of doc_id and text: the same whenever it is read, and shared by repeated rows only."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["doc_id"].isNull(), F.coalesce(docs["text"], F.lit("")))


def jaccard_rows(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, broadcast_rows: int = 1_000_000, few_components: int = 8) -> DataFrame:
    """doc_id, row (``row_key``), n_shingles, component_id and keeper of every document: the keeper is the row of its
    component with the least (doc_id, row), null ids last; null where a document links with nothing."""
    rows = docs.select(F.col("doc_id").cast("long"), row_key(docs).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    known = materialize(_class_rows(rows, n))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = materialize(known.where("n_shingles > 0").groupBy("node").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("size")))

    # One text of each class: the others are left out by their rows.
    again = known.where("n_shingles > 0").join(classes.where("copies > 1"), "node").where(F.col("row") != F.col("first.row")).select("row")
    alone = join_small(rows, again, "row", "left_anti", rows=broadcast_rows)
    signed = _signature_rows(alone, n, num, den)
    of_one = Window.partitionBy("signature")
    shared = signed.withColumn("lo", F.min("node").over(of_one)).withColumn("hi", F.max("node").over(of_one)).withColumn("company", F.count(F.lit(1)).over(of_one))
    shared = materialize(shared.where("lo < hi").select("signature", "node", "company"))

    wanted = shared.select("node").distinct().join(classes, "node").select("first.row")
    sketches = materialize(_sketch_rows(join_small(rows, wanted, "row", "left_semi", rows=broadcast_rows), n))

    def sets(nodes: DataFrame) -> DataFrame:
        return _set_rows(join_small(rows, nodes.join(classes, "node").select("first.row"), "row", "left_semi", rows=broadcast_rows), n)

    def compare(left: DataFrame, right: DataFrame) -> DataFrame:
        return _compare(left, right, sketches, sets, num, den)

    # First links: everything against the pivot it shares most signatures with, then against others not yet joined.
    company = shared.groupBy("node").agg(F.sum("company").alias("all_company"))
    ranked = shared.select("signature", "node").join(company, "node")
    pivots = ranked.groupBy("signature").agg(F.max(F.struct("all_company", "node"))["node"].alias("hub"))
    star = shared.select("signature", "node").join(pivots, "signature").where("hub <> node").groupBy("hub", "node").agg(F.count(F.lit(1)).alias("shares"))
    star = materialize(_possible(materialize(star), sketches, num, den))
    hubs = lambda some: some.select("hub", F.col("hub").alias("node")).distinct()
    best = materialize(star.groupBy("node").agg(F.max(F.struct("shares", "hub"))["hub"].alias("hub")))
    best_links = compare(hubs(best), best)
    comps = materialize(components(best_links))
    placed_star = star.join(comps, "node", "left").withColumn("own", F.coalesce("comp", "node")).drop("comp")
    placed_star = placed_star.join(comps.select(F.col("node").alias("hub"), "comp"), "hub", "left").withColumn("others", F.coalesce("comp", "hub")).join(best.withColumn("done", F.lit(True)), ["hub", "node"], "left")
    rest = materialize(placed_star.where("own <> others AND done IS NULL").select("hub", "node"))
    rest_links = compare(hubs(rest), rest)
    first_links = materialize(best_links.unionByName(rest_links))
    discard(star, best, best_links, rest, rest_links, comps)

    # The rest: only where a signature still has several components. Of few components, all pairs of components; of many,
    # all against the largest. Either way rows are gathered by the larger component.
    comps = components(first_links)
    placed = materialize(shared.select("signature", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    per = placed.groupBy("signature", "comp").agg(F.count(F.lit(1)).alias("here"))
    several = materialize(per.groupBy("signature").agg(F.max(F.struct("here", "comp"))["comp"].alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    few = per.join(several.where(F.col("n") <= few_components).select("signature"), "signature")
    pairs = few.select("signature", F.col("comp").alias("a")).join(few.select("signature", F.col("comp").alias("b")), "signature").where("a < b")
    pairs = pairs.select("a", "b").distinct()
    members = placed.select("comp", "node").distinct()
    size = members.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    sized = pairs.join(size.select(F.col("comp").alias("a"), F.col("size").alias("na")), "a").join(size.select(F.col("comp").alias("b"), F.col("size").alias("nb")), "b")
    first = F.col("na") >= F.col("nb")
    faced = materialize(sized.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("comp")))
    many = materialize(placed.join(several.where(F.col("n") > few_components).select("signature", "hub"), "signature").select("hub", "node", "comp").distinct())
    outside = faced.join(members, "comp").select("hub", "node").unionByName(many.where("comp <> hub").select("hub", "node")).distinct()
    # A text stays only if its size could link with some size of the hub's component or of the signature's texts.
    sizes = classes.select("node", "size")
    inside = members.join(faced.select("hub").distinct(), F.col("comp") == F.col("hub")).select("hub", "node").unionByName(many.select("hub", "node")).distinct()
    inside = materialize(inside.join(sizes, "node"))
    spans = inside.groupBy("hub").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    placed_sizes = outside.join(sizes, "node")
    fits = (placed_sizes["hub"] == spans["hub"]) & (den * F.col("hi") >= num * F.col("size")) & (den * F.col("size") >= num * F.col("lo"))
    left = materialize(placed_sizes.join(spans, fits, "left_semi").select("hub", "node"))
    right = inside.join(left.select("hub").distinct(), "hub", "left_semi").select("hub", "node")
    right = materialize(right)
    more_links = compare(left, right)
    links = materialize(first_links.unionByName(more_links))
    discard(sketches, shared, placed, several, faced, many, inside, left, right, first_links, more_links)

    comps = components(links)
    least = comps.join(classes, "node").groupBy("comp").agg(F.min("first").alias("first"))
    linked = comps.join(least, "comp").select("node", "first")
    copied = classes.where("copies > 1").join(linked, "node", "left_anti").select("node", "first")
    named = materialize(linked.unionByName(copied).select("node", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keeper")))
    discard(links, classes)
    out = join_small(known, named, "node", "left", rows=broadcast_rows)
    has = F.col("n_shingles") > 0
    component = F.when(has, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.when(has, F.col("keeper")).alias("keeper"))


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return jaccard_rows(docs, **options).select("doc_id", "n_shingles", "component_id")
