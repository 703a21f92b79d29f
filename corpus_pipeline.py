"""A corpus pipeline of five stages, each one operator of ``gneiss.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs. All but the last keep the columns of ``documents``; columns a stage does not
use, nulls, empty texts, repeated rows and repeated ids pass through as rows of their own, and empty
input gives empty output. Rows are told apart by a row number of the stage's own, not by doc_id; where
a draw depends on a row, it depends on the row's content.

1. ``language_id`` labels every text; texts without a letter (``und``) go, the label becomes ``lang``.
2. ``near_dedup`` keeps one document of each SimHash group, the first by doc_id among those with one. Groups
   are those of five-word shingle sets at a similarity of 0.8 (``nearsets``), not of the two bits of ``op10_simhash``.
3. ``pii`` replaces personal data by its kind in angle brackets and brings ``n_chars`` up to date.
4. ``mixing`` repeats or leaves out documents so that sources come near their target weights.
5. ``packing`` packs the tokens of what is left; it returns pieces with their sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import langid, mixing, nearsets, packing, pii
from gneiss.llm.common import cut, keyed, read

#: Rounding in stage 4 and the tokenizer in stage 5 are beyond SQL.
ORACLE_SQL = None
ROW, KEY = "__row", "__key"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    kept = langid.predict(docs, model, keep=True).where("lang_pred != 'und'")
    return kept.select(*[(F.col("lang_pred") if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs, "dedup-rows", ROW)
    groups = nearsets.near_groups(rows, id_col=ROW).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group"))
    named = rows.select(ROW, "doc_id").join(groups, ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first")
    stays = named.groupBy("group").agg(first).select(F.col(f"first.{ROW}").alias(ROW))
    return rows.join(stays, ROW, "left_semi").select(*docs.columns)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    content = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"`{c}`").isNull() for c in docs.columns])
    rows = keyed(docs.withColumn(KEY, content), "mix-rows", ROW)
    copies = mixing.mix(rows, id_col=KEY).groupBy(F.col("doc_id").alias(KEY)).agg(F.sum("copies").alias("copies")).where("copies > 0")
    # equal rows are interchangeable: the first stands for all of them
    first = rows.groupBy(KEY).agg(F.min(ROW).alias(ROW)).join(copies, KEY).select(ROW, "copies")
    turn, number = mixing.copies_of(F.col("copies"))
    return rows.join(first, ROW).withColumn("_turn", turn).withColumn("_number", number).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", remove_pii), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result cut to a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
