"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java and DuckDB (RE2) character class.
SPACES = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that isn't set, a temporary one will do for a master on this machine
    (tests); on a cluster it is an error, as executors would each write to a folder of their own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/skyfringe-{uuid.uuid4().hex}"


#: Where each table of ``materialize`` was written, for as long as the driver holds it.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at files every executor sees."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read any more; other DataFrames are left alone."""
    for table in tables:
        if path := _written.pop(table, None):
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """The white-space separated words of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(text, f"{SPACES}+"), ""), F.array().cast("array<string>"))


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), with whatever further columns are named; all other columns go."""
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"), *more)


def join_small(df: DataFrame, small: DataFrame, on: str | list[str], how: str, *, rows: int) -> DataFrame:
    """Join with ``small``: broadcast when it has at most ``rows`` rows by count, by shuffle otherwise."""
    return df.join(F.broadcast(small) if small.count() <= rows else small, on, how)


def where_computed(df: DataFrame, condition: str) -> DataFrame:
    """Rows that fulfil a condition on computed columns, each computed once: a filter that can be pushed below them
    would put their expressions in place of their names, as often as they are used."""
    return df.withColumn("__row_id", F.monotonically_increasing_id()).where(f"({condition}) AND __row_id >= 0").drop("__row_id")
