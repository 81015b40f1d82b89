"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query. The index lists, for a block of texts and a trigram,
the texts that hold it; a query is answered per block by intersecting and joining those lists, and only the texts
it leaves are searched with the expression. A rule without mandatory trigrams (long runs of hex digits) searches
every text. The index is limited to the trigrams that the rules name, and lists each distinct text once, under a
64-bit hash; two texts that share a hash cost a needless search and lose nothing.

Everything is DataFrame functions. Blocks hold about ``block_rows`` texts whatever the input's size, so a trigram
that all texts share makes one bounded list a block. The table of candidates is broadcast when its counted rows are
at most ``broadcast_rows`` and joined by shuffle otherwise.

Defined results: null text counts as empty and has no spans; each of several equal rows gets its own result; an
empty table gives an empty table; columns not asked for are left behind, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialize, text_rows
from .trigram_query import Query, trigram_query, trigrams


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the spans that match ``pattern`` and whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The rules, base rules first, in the order in which spans that start together are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def trigram_index(docs: DataFrame, vocabulary: list[str], *, block_rows: int = 4096) -> DataFrame:
    """(block, trigram, texts): for each block of texts, the hashes of the texts that hold a trigram, in lower case."""
    blocks = max(1, -(-docs.count() // block_rows))
    low = F.col("__low")
    held = F.filter(F.array(*map(F.lit, vocabulary)), lambda t: low.contains(t))
    return (
        docs.select(text_key(F.col("text")).alias("k"), F.lower("text").alias("__low"))
        .select("k", F.explode(held).alias("trigram"))
        .groupBy(F.pmod("k", F.lit(blocks)).alias("block"), "trigram")
        .agg(F.sort_array(F.collect_set("k")).alias("texts"))
    )


def _answer(query: Query, postings: Column) -> Column:
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(postings, F.lit(query)), F.array().cast("array<bigint>"))
    parts = [_answer(q, postings) for q in query[1]]
    out = parts[0]
    for x in parts[1:]:
        out = F.array_intersect(out, x) if query[0] == "and" else F.array_union(out, x)
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...], *, block_rows: int = 4096) -> DataFrame:
    """(k, kinds): the texts that fulfil the queries of some rules. Rules without a query are in no row."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    vocabulary = sorted(set().union(*map(trigrams, queries.values())))
    index = trigram_index(docs, vocabulary, block_rows=block_rows)
    by_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "texts"))).alias("postings"))
    answers = F.array(*(F.struct(F.lit(kind).alias("kind"), _answer(q, F.col("postings")).alias("texts")) for kind, q in queries.items()))
    found = by_block.select(F.explode(answers).alias("a")).select("a.kind", F.explode("a.texts").alias("k"))
    return found.groupBy("k").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """The spans of one rule, leftmost first and apart: what lies between matches tells where they start."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value")
    )
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(none)


def find_secrets(
    docs: DataFrame, *keep: str, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, block_rows: int = 4096, broadcast_rows: int = 500_000
) -> DataFrame:
    """The columns in ``keep``, doc_id, text and spans: array of (start, number, end, kind) by start, then rule.

    start and end count code points from 0, end exclusive; number is the rule's place in ``rules``.
    """
    rows = text_rows(docs, *keep)
    found = materialize(candidates(rows, rules, block_rows=block_rows))
    joined = join_small(rows.withColumn("k", text_key(F.col("text"))), found, "k", "left", rows=broadcast_rows)
    wanted = lambda r: F.lit(True) if trigram_query(r.pattern) is None else F.array_contains("kinds", r.kind)
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    each = [F.when(wanted(r), _spans(F.col("text"), r, n)).otherwise(none) for n, r in enumerate(rules)]
    return joined.select(*keep, "doc_id", "text", F.sort_array(F.concat(*each)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap are covered once."""

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(before, F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], mark).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1))))
