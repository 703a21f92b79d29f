"""Shared plumbing: scratch tables in the cluster's shared folder, and word handling.

``scratch_dir`` reads ``spark.checkpoint.dir`` from the session; only where it is unset and the master
is local (tests) does it make a folder of its own; on a cluster an unset folder is an error, since
executors would write to their own disks. Operators run jobs when they are called: each ``cut`` is one. ``cut`` writes a DataFrame there as Parquet and reads
it back, so lineage ends in files that survive the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word class of the contracts: runs of anything but ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def scratch_dir(spark: SparkSession) -> str:
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gneiss-"))
        place = spark.sparkContext.getCheckpointDir()
    return place.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{scratch_dir(spark)}/gneiss/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a reader of it."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that no plan reads any more."""
    for table in tables:
        spark = table.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of plans that are no longer referenced (after a cut)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), without building them: word starts are counted."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long"), F.lit(0).cast("long"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` as a table in the shared folder with a row number ``key`` that rereads alike."""
    return cut(df.withColumn(key, F.monotonically_increasing_id()), name)
