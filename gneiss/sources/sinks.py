"""Writers: chunk and report tables, result files, vector upserts, run logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunk table, one folder per document."""
    chunks.write.mode(mode).partitionBy("document").parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_report(report: DataFrame, path: str, parts: int = 1) -> None:
    """A report is one row per document; it is written in ``parts`` files."""
    report.repartition(parts).write.mode("overwrite").json(path)


def write_results(rows: DataFrame, path: str, parts: int = 1, config: dict[str, str] | None = None) -> None:
    """Metric rows as CSV with a header (its first name behind a byte order mark, for spreadsheets) and as JSON; the
    run's configuration as one JSON line beside them."""
    out = rows.repartition(parts)
    first, *rest = rows.columns
    out.select(F.col(first).alias("\ufeff" + first), *rest).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    out.write.mode("overwrite").json(f"{path}/json")
    if config:
        rows.sparkSession.createDataFrame([(config,)], "config map<string, string>").write.mode("overwrite").json(f"{path}/config")


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``new`` rows and the old rows whose key is not among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


#: A small file in a table's folder that names the folder of its current version.
POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the current version of a versioned table; null where there is none yet."""
    jvm, _, fs = _fs(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    return f"{path}/{spark.read.text(pointer.toString()).first()[0]}" if fs.exists(pointer) else None


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))


def publish(df: DataFrame, path: str) -> None:
    """Write a new version of a table, then let the pointer name it. Until the pointer is renamed into place, which
    is one step of the file system, readers and a failed writer see the version before; that one stays for readers
    under way, older ones go."""
    spark = df.sparkSession
    jvm, root, fs = _fs(spark, path)
    before = current(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}.{name}")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), options)
    for status in fs.listStatus(root):
        old = status.getPath()
        if old.getName().startswith("v-") and old.getName() not in (name, (before or "").rsplit("/", 1)[-1]):
            fs.delete(old, True)


def upsert(new: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Upsert into a versioned table."""
    spark = new.sparkSession
    publish(upserted(read_current(spark, path), new, key) if current(spark, path) else new, path)


def reset(df: DataFrame, path: str) -> None:
    """Empty a collection: an empty version with the same columns."""
    publish(df.limit(0), path)


def build_index(chunks: DataFrame, embed, path: str, expected: int | None = None) -> dict[str, int]:
    """Load, reset, embed, upsert and verify a collection: chunks without id or text are left out, of an id the
    first by ``corpus_pos`` counts, and the stored rows have to be those of the corpus, with one vector length.
    ``embed`` is a Column of ``text``. Returns the counts of the run."""
    kept = chunks.where("chunk_id is not null and text is not null and trim(text) != ''")
    first = kept.groupBy("chunk_id").agg(F.min_by(F.struct(*chunks.columns), "corpus_pos").alias("c")).select("c.*")
    rows = first.withColumn("vec", embed)
    reset(rows, path)
    upsert(rows, path)
    stored = read_current(chunks.sparkSession, path)
    n, widths, blank = stored.agg(F.count("*"), F.countDistinct(F.size("vec")), F.count_if(F.col("vec").isNull() | (F.size("vec") == 0))).first()
    every = chunks.count()
    ids = kept.select("chunk_id").distinct().count()
    if n != ids or widths > 1 or blank or expected not in (None, n):
        raise ValueError(f"index holds {n} of {ids} chunks, {widths} vector lengths, {blank} empty vectors")
    return {"chunks": every, "indexed": n, "left_out": every - kept.count(), "repeated": kept.count() - ids}


def progress_log(path: str):
    """A function (stage, counts) that appends one line of progress to ``path`` and returns the counts."""

    def log(spark: SparkSession, stage: str, counts: dict[str, int]) -> dict[str, int]:
        append_log(spark.createDataFrame([(stage, counts)], "stage string, counts map<string, long>"), path)
        return counts

    return log


def chunk_files(documents: DataFrame, chunk, path: str) -> tuple[int, DataFrame]:
    """Chunk extracted documents and write the good ones: ``documents(document, pages, ...)``, ``chunk`` a function of
    their pages. Returns the number of chunks and the failures (file, reason): documents without pages or text."""
    no_pages = F.col("pages").isNull() | (F.size("pages") == 0)
    empty = F.forall("pages", lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) == "")
    judged = documents.withColumn("reason", F.when(no_pages, "no list of pages").when(empty, "no text"))
    write_chunks(chunk(judged.where("reason is null").drop("reason")), path)
    return documents.sparkSession.read.parquet(path).count(), judged.where("reason is not null").select(F.col("document").alias("file"), "reason")


def append_log(record: DataFrame, path: str) -> None:
    record.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)
