"""Tables between steps: written in the folder that driver and executors share, and deleted after their last reader."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where each table was written, for as long as the driver holds it.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder below spark.checkpoint.dir. Where that isn't set, a temporary one will do for a master on
    this machine (tests); on a cluster it is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/skyfringe-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write in a new folder and read back."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` that nothing will read any more; anything else is left alone."""
    for table in tables:
        if table is not None and (path := _written.pop(table, None)):
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
