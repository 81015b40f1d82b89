"""A corpus pipeline of the training-data operators; it belongs to skyfringe.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfringe.llm import jaccard, mixing, packing, quality, secret_scan
from skyfringe.llm.common import join_small, materialize, read_table, where_computed
from skyfringe.llm.queries import byte_bpe


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines; n_chars, where there is one, follows.

    Null and empty texts are rejected; very long ones are judged whole; repeated rows are judged one by one; an empty table
    stays one; every column of the documents is carried in one struct, so no name of theirs clashes with a figure's.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__doc"))
    kept = where_computed(quality.quality_rules(rows, "__doc"), "kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return kept.select(*(new.get(c, F.col("__doc")[c]).alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the least doc_id,
    null ids last, and of repeated rows one.

    Documents without a word stay, null texts among them; a long text is one set like any other; ties go to the smaller
    row hash; an empty table stays one; further columns are carried along untouched.
    """
    known = materialize(jaccard.jaccard_rows(docs, n=5, num=80, den=100))
    copies = known.where("row <> keeper").select(F.col("row").alias("__near_row")).distinct()
    kept = join_small(docs.withColumn("__near_row", jaccard.row_key(docs)), copies, "__near_row", "left_anti", rows=1_000_000)
    again = materialize(known.where("n_shingles > 0 AND row = keeper").groupBy(F.col("row").alias("__near_row")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__near_row"))
    single = join_small(kept, again, "__near_row", "left_anti", rows=1_000_000).drop("__near_row")
    repeated = join_small(kept, again, "__near_row", "left_semi", rows=1_000_000)
    one = repeated.groupBy("__near_row").agg(F.min(F.struct(*docs.columns)).alias("__doc")).select("__doc.*")
    return single.unionByName(one)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark in place of each secret in its text; n_chars, where there is one, follows.

    Null and empty texts have no secret and stay as they are, null as null; repeated rows are each marked; an empty table
    stays one; all columns are carried in one struct.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__doc"))
    found = secret_scan.find_secrets(rows, "__doc").withColumn("__clean", secret_scan.redact(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    text = F.when(changed, F.col("__clean")).otherwise(F.col("__doc")["text"])
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("__clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__doc")["n_chars"])
    return found.select(*(new.get(c, F.col("__doc")[c]).alias(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix holds them, from never to three times.

    Null and empty texts have no words, so they come in with their source's whole epochs or its prefix and change nothing;
    null sources are one source; repeated rows are taken or left one by one; an empty table stays one.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__doc"))
    mixed = mixing.mix_sources(rows, "__doc").where("copies > 0")
    return mixed.select("__doc", F.explode(F.sequence(F.lit(1), "copies"))).select("__doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1,024 tokens.

    Null and empty texts are one piece, the end id; long texts are cut; repeated rows are packed each; an empty table gives
    no pieces; of the documents' columns only doc_id is kept.
    """
    return packing.pack_documents(docs, byte_bpe(), capacity=1024, end_id=2)


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("secret_scans", secrets_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
#: SQL can't express tokenizing or packing; tests hold the operators against brute force, and of the stages only the
#: first two against what must come out.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
