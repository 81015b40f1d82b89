"""Mixing sources to target weights by weighted sampling with exponential keys.

Sizes are words. Sources, by code point and null last, take the weights in turn and share a budget of all words by
weight; a target stops at ``most`` times its source's size and the excess is shared again by weight. A target's whole
multiples of the source's size are complete epochs of all its documents; what is left is filled in the order of the
keys -ln(u) / quality, u being a hash of the document, as far as the prefix sum stays within it. One last document
beyond the prefix, the one whose size is nearest to what is left then, is taken if that comes nearer to the target.

No source is ever sorted whole: keys fall into narrow bands of their logarithm (about ``band_rows`` documents each),
bands are summed, and only the band where a source's budget ends is sorted. So a source that holds most of the rows is
spread like any other. The result doesn't depend on the bands.

Defined results: null text has size 0 and is never an obstacle; null sources form one source; equal rows have equal
keys and are interchangeable; documents with a null or repeated doc_id are kept apart as rows; an empty table gives an
empty table; very long texts count all their words; further columns are left behind unless named in ``keep``. Reruns
agree, as keys depend on the row and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize, text_rows, word_array

WEIGHTS = (5.0, 2.0, 1.0)


def text_quality(text: Column, size: Column) -> Column:
    """A weight from 0.05 to 1: lower the more symbols a text has for its words."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>{}=~^_]"))
    return F.lit(0.05) + 0.95 * (1 - F.least(F.lit(1.0), symbols / F.greatest(size, F.lit(1))))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size) to these with target: shares by weight, none above ``most`` times its size.

    Works on the table of sources. Each pass fixes the sources above their limit; it ends when no further one is.
    """
    in_turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)) + 1)
    sources = materialize(sizes.withColumn("weight", in_turn))
    level, fixed = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= most * F.col("source_size")
        total, capped, n, free = sources.agg(
            F.sum("source_size"), F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0.0)), F.count_if(full), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == fixed or not free:
            break
        fixed, level = n, ((total or 0) - capped) / free
    level = F.lit(float(level or 0.0))
    return sources.withColumn("target", F.least(F.col("weight") * level, most * F.col("source_size")).cast("double"))


def mix_sources(
    docs: DataFrame, *keep: str, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, quality: Column | None = None, seed: int = 20, band_rows: int = 4_000
) -> DataFrame:
    """``keep``, doc_id, source, size, source_size, target, copies (how often the mix holds the document) and taken."""
    rows = text_rows(docs, "source", *keep).withColumn("size", F.size(word_array(F.col("text"))).cast("long"))
    u = (F.pmod(F.xxhash64("doc_id", "source", "text", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = quality if quality is not None else text_quality(F.col("text"), F.col("size"))
    keyed = rows.select(*keep, "doc_id", "source", "size", (F.log(-F.log(u)) - F.log(weight)).alias("__key"))
    # The row number is written with the rows, so it stays what it is; it tells equal rows apart.
    keyed = materialize(keyed.withColumn("__s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("__row", F.monotonically_increasing_id()))

    per_unit = max(1.0, keyed.count() / band_rows)
    banded = keyed.withColumn("__band", F.floor(F.col("__key") * per_unit))
    targets = source_targets(keyed.groupBy("__s", "source").agg(F.sum("size").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.withColumn("__epochs", epochs).withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size"))

    bands = banded.groupBy("__s", "__band").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("__s").orderBy("__band"))
    running = join_small(bands.withColumn("upto", upto), plan.select("__s", "__rest"), "__s", "inner", rows=100_000)
    ends = (
        running.where((F.col("upto") > F.col("__rest")) & (F.col("upto") - F.col("words") <= F.col("__rest")) & (F.col("words") > 0))
        .groupBy("__s")
        .agg(F.min("__band").alias("__end"), F.min(F.col("upto") - F.col("words")).alias("__before"))
    )
    plan = materialize(plan.select("__s", "source_size", "target", "__epochs", "__rest").join(ends, "__s", "left"))
    planned = join_small(banded, plan, "__s", "left", rows=100_000)
    edge = planned.where("__band = __end").withColumn("__upto", F.col("__before") + F.sum("size").over(Window.partitionBy("__s").orderBy("__key", "__row")))
    inside = materialize(edge.where("__upto <= __rest").select("__s", "__row", "__upto"))
    reached = plan.where("__end IS NOT NULL").join(inside.groupBy("__s").agg(F.max("__upto").alias("__upto")), "__s", "left")
    gaps = reached.select("__s", (F.col("__rest") - F.coalesce("__upto", "__before")).alias("__gap"))
    outside = join_small(planned.where("__band >= __end"), inside.select("__row"), "__row", "left_anti", rows=500_000)
    off = F.abs(F.col("size") - F.col("__gap"))
    last = join_small(outside, gaps, "__s", "inner", rows=100_000).where(off < F.col("__gap")).groupBy("__s").agg(F.min(F.struct(off.alias("off"), "__key", "__row"))["__row"].alias("__row"))
    filled = materialize(inside.select("__row").unionByName(last.select("__row")).withColumn("__in", F.lit(True)))
    chosen = join_small(planned, filled, "__row", "left", rows=500_000)
    # A source whose budget ends in no band has nothing left to fill.
    inside = F.coalesce(F.col("__in"), F.col("__band") < F.col("__end"), F.lit(False))
    copies = (F.col("__epochs") + inside.cast("int")).cast("int")
    return (
        chosen.withColumn("copies", copies)
        .select(*keep, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
    )
