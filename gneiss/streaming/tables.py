"""Structured Streaming over chunk files and token events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import append_log, upsert


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Upsert JSON-lines chunk files that arrive in ``source`` into the versioned table ``target`` (``sinks.publish``: a
    batch that fails leaves the version before); of an id that a batch repeats, the last row by file wins. Each batch
    appends its number and rows to ``target``'s progress log. Returns the started query (available-now trigger)."""

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            append_log(df.agg(F.lit(number).alias("batch"), F.count("*").alias("rows")), f"{target}_progress")
            upsert(df.groupBy("chunk_id").agg(F.max_by(F.struct(*df.columns), "arrived").alias("r")).select("r.*").drop("arrived"), target)

    stream = spark.readStream.schema(schema).json(source).withColumn("arrived", F.col("_metadata.file_modification_time"))
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def token_events(parts: DataFrame) -> DataFrame:
    """``parts(request_id, seq, t_ms, text, done)`` -> request_id, seq, event, elapsed_ms: first_token, token, then
    done, or error where a request ended without text."""
    w = Window.partitionBy("request_id").orderBy("seq")
    rows = parts.withColumn("start", F.first("t_ms").over(w)).withColumn("n_text", F.sum((F.coalesce("text", F.lit("")) != "").cast("int")).over(w))
    has = F.coalesce(F.col("text"), F.lit("")) != ""
    event = F.when(F.col("done") & (F.col("n_text") == 0), "error").when(F.col("done"), "done").when(has & (F.col("n_text") == 1), "first_token").when(has, "token")
    return rows.withColumn("event", event).where("event is not null").select("request_id", "seq", "event", (F.col("t_ms") - F.col("start")).alias("elapsed_ms"))


def request_timing(parts: DataFrame) -> DataFrame:
    """Per request: time to the first text, time from there to the end, number of text parts."""
    has = F.coalesce(F.col("text"), F.lit("")) != ""
    first = F.min(F.when(has, F.col("t_ms")))
    return parts.groupBy("request_id").agg((first - F.min("t_ms")).alias("ttft_ms"), (F.max(F.when(F.col("done"), F.col("t_ms"))) - first).alias("generation_ms"), F.count_if(has).alias("parts"))
