"""The registered queries of this folder, with DuckDB SQL where SQL can express one.

Each query applies its operator with production parameters to its whole table and derives the columns that its
contract names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, hard_negatives, jaccard, langid, lm_mixing, mixing, packing, periodic, quality, secret_scan, token_count, token_file
from .common import materialize, read_table, word_array
from .sql import CHAT_SQL, JACCARD_SQL, NEGATIVES_SQL, QUALITY_SQL, RUNS_SQL, SECRETS_SQL

def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_mixing.score_documents(read_table(spark, sf_dir, "documents"), held_out)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["number"] < len(secret_scan.BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = F.sha2(secret_scan.spans_text(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *(count(r.kind) for r in secret_scan.BASE_RULES), text, secret_scan.spans_text(F.col("spans")).alias("spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")



def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), byte_bpe())


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.withColumn("held_out", held_out)
    model = langid.train(rows.where(~F.col("held_out")))
    return langid.identify(rows, model, "held_out").select("doc_id", "held_out", "lang_pred", "score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), byte_bpe(), capacity=1024, end_id=2)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_file.token_files(read_table(spark, sf_dir, "documents"), byte_bpe(), end_id=2)
    return token_file.read_tokens(spark, path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.when(h % 10 == 0, word_array(F.col("text"))).alias("words"), F.floor(h / 10).cast("long").alias("g"))
    at = docs.withColumn("a", F.col("g") % F.size("words"))
    rows = at.withColumn("p", 1 + F.floor((F.size("words") - F.col("a")) / (3 + F.col("g") % 8)))
    rewritten = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w))
    text = F.when(F.size("words") > 0, F.array_join(rewritten, " ")).otherwise(F.col("text"))
    found = periodic.find_runs(rows.select("doc_id", text.alias("text"))).withColumn("best", periodic.greatest_run(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    best = lambda c: F.col("best")[c]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(best(c).alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), digest(F.array_join(line, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    written = materialize(chat.format_conversations(turns))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chat.read_conversations(written).withColumn("loss", F.array_join("losses", ""))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(told).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), "formatted_chars")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_lm_scoring, op2_secret_scans, op3_quality_rules, op4_token_counts, op5_nearest_neighbours, op6_jaccard_join, op7_language_id, op8_best_fit_packing, op9_source_mixing, op10_token_output, op11_hard_negatives, op12_periodic_runs, op13_chat_formatting)}
ORACLE_SQL: dict[str, str] = {"op2_secret_scans": SECRETS_SQL, "op3_quality_rules": QUALITY_SQL, "op6_jaccard_join": JACCARD_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_periodic_runs": RUNS_SQL, "op13_chat_formatting": CHAT_SQL}
