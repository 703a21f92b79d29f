"""Corpus reports, duplicates, links and ids over chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compare_key, norm_key


def quality_report(chunks: DataFrame, short: int = 300, long: int = 4050, orphan_tokens: int = 150) -> DataFrame:
    """Per document of ``chunks(document, text, source_type, estimated_tokens, section, subsection,
    local_heading, completeness)``: sizes over text chunks, coverage over all chunks."""
    size = F.when(F.col("source_type") == "text", F.length("text"))
    tokens = F.when(F.col("source_type") == "text", F.col("estimated_tokens"))
    share = lambda c: F.bround(100.0 * F.count_if(F.coalesce(F.col(c), F.lit("")) != "") / F.count("*"), 1)
    orphan = (F.col("source_type") == "text") & ((F.col("estimated_tokens") < orphan_tokens) | (F.col("completeness") != "complete"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chunks.groupBy("document").agg(
        F.count("*").alias("chunk_count"), F.count_if(F.col("source_type") == "text").alias("text_chunk_count"), F.count_if(F.col("source_type") == "table").alias("table_chunk_count"),
        zero(F.bround(F.avg(size), 1)).alias("average_characters"), zero(F.bround(F.avg(tokens), 1)).alias("average_estimated_tokens"), zero(F.bround(F.median(tokens), 1)).alias("median_estimated_tokens"),
        zero(F.min(size)).alias("min_characters"), zero(F.max(size)).alias("max_characters"), share("section").alias("section_coverage_percent"), share("subsection").alias("subsection_coverage_percent"),
        F.count_if(F.coalesce(F.col("local_heading"), F.lit("")) != "").alias("local_heading_chunks"), F.count_if(orphan).alias("orphan_candidates"),
        F.count_if(size < short).alias("short_chunks"), F.count_if(size > long).alias("long_chunks"),
    )


def corpus_totals(report: DataFrame) -> DataFrame:
    """Sums over documents, with the ratio made from the sums."""
    names = [c for c in ("chunk_count", "text_chunk_count", "table_chunk_count", "local_heading_chunks", "orphan_candidates", "short_chunks", "long_chunks") if c in report.columns]
    sums = report.agg(F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in names])
    return sums.withColumn("short_ratio", F.bround(F.try_divide(F.col("short_chunks"), F.col("text_chunk_count")), 4))


def token_thresholds(chunks: DataFrame, by: str, limits: tuple[int, ...] = (10, 20, 30, 50)) -> DataFrame:
    """Per group: chunks, mean, extremes and how many are under each limit of tokens."""
    t = F.col("estimated_tokens")
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.bround(F.avg(t), 2).alias("mean_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), *[F.count_if(t < n).alias(f"under_{n}") for n in limits])


def orphans(chunks: DataFrame, threshold: int = 150) -> DataFrame:
    """Text chunks that are small or incomplete, with reasons joined by ';'."""
    small, incomplete = F.col("estimated_tokens") < threshold, F.col("completeness") != "complete"
    reason = F.concat_ws(";", F.when(small, "very_small_chunk"), F.when(incomplete, F.concat(F.lit("semantic_"), F.col("completeness"))))
    return chunks.where((F.col("source_type") == "text") & (small | incomplete)).withColumn("reason", reason)


def duplicate_texts(chunks: DataFrame) -> DataFrame:
    """One row: surplus copies over normalised texts."""
    groups = chunks.groupBy(norm_key(F.col("text")).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def first_by_text(chunks: DataFrame, order: str = "corpus_pos") -> DataFrame:
    """The first chunk of each compare key with duplicate_count. Two aggregations with map-side
    combine; no window, so a text that very many rows share is no hot key."""
    keyed = chunks.withColumn("_key", compare_key(F.col("text")))
    firsts = keyed.groupBy("_key").agg(F.min(order).alias("_first"), F.count("*").alias("duplicate_count"))
    return keyed.join(firsts, (keyed["_key"] == firsts["_key"]) & (keyed[order] == firsts["_first"])).select(*[keyed[c] for c in chunks.columns], "duplicate_count")


def collapse(chunks: DataFrame, keys: list[str], order: str, location: str) -> DataFrame:
    """First chunk of each key, duplicate_count and later locations in order."""
    item = F.struct(F.col(order).alias("_order"), F.col(location).alias("_place"))
    packed = chunks.groupBy(*keys).agg(F.min_by(F.struct(*chunks.columns), order).alias("c"), F.array_sort(F.collect_list(item)).alias("all"))
    return packed.select("c.*", F.size("all").alias("duplicate_count"), F.transform(F.slice("all", 2, F.size("all")), lambda x: x["_place"]).alias("duplicate_locations"))


def links(chunks: DataFrame, by: str, order: str, chunk_id: str = "chunk_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return chunks.withColumn("prev_chunk_id", F.lag(chunk_id).over(w)).withColumn("next_chunk_id", F.lead(chunk_id).over(w))


def sequence_ids(chunks: DataFrame, document: str, order: list[str], width: int = 4) -> DataFrame:
    w = Window.partitionBy(document).orderBy(*order)
    return chunks.withColumn("chunk_id", F.format_string(f"%s_chunk_%0{width}d", F.col(document), F.row_number().over(w)))


def occurrences(chunks: DataFrame, keys: list[str], order: str) -> DataFrame:
    return chunks.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def word_gap(source: DataFrame, chunks: DataFrame, most: int = 100) -> DataFrame:
    """Distinct normalised words of a document's source that its chunks lack: the first ``most`` by name."""
    words = lambda df: df.select("document", F.explode(F.split(norm_key(F.col("text")), " ")).alias("word")).where("word != ''").distinct()
    lost = words(source).join(words(chunks), ["document", "word"], "left_anti")
    w = Window.partitionBy("document").orderBy("word")
    return lost.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def selected_counts(picks: DataFrame) -> DataFrame:
    """How many picks of a query each document has, and how many documents a query's picks come from."""
    per = picks.groupBy("query_id", "document_id").agg(F.count("*").alias("picks"))
    return per.join(per.groupBy("query_id").agg(F.count("*").alias("documents")), "query_id")


def suspicious_headings(lines: DataFrame) -> DataFrame:
    """``lines(document, page, line, heading)`` whose heading is numbered yet ends like prose, or is very long: (document,
    page, heading, reason)."""
    title = F.col("heading.text")
    reason = F.when(F.length(title) > 120, "long_heading").when(title.rlike(r"[.,;]$"), "ends_like_prose").when(title.rlike(r"(?U)\b\d{4}\b"), "holds_a_year")
    return lines.where("heading is not null").select("document", "page", title.alias("heading"), reason.alias("reason")).where("reason is not null")


def format_score(score, digits: int = 4):
    """A score as text with a fixed number of digits; a dash for none."""
    return F.coalesce(F.format_string(f"%.{digits}f", score.cast("double")), F.lit("–"))


def top_values(df: DataFrame, by: str, value: str, order: str, k: int = 5) -> DataFrame:
    """Most common values of a group; ties go to the one seen first."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(by).orderBy(F.col("n").desc(), "_first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_first")


def consume_ids(chunks: DataFrame, prior: DataFrame, keys: list[str], order: str, prior_order: str) -> DataFrame:
    """Give each chunk the next unused prior id of its key; chunks beyond the prior ids get null."""
    number = lambda df, o: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(o)))
    right = number(prior, prior_order).select(*keys, "_n", "legacy_chunk_id")
    return number(chunks, order).join(right, [*keys, "_n"], "left").drop("_n")


def manifest_lookup(documents: DataFrame, manifest: DataFrame, key) -> DataFrame:
    """Manifest row by equal file key, else the first manifest key that ends with it. ``manifest(key,
    pos, doc_family, organization, year)``; a manifest is a hand-kept list, checked before its broadcast."""
    if manifest.limit(100_001).count() > 100_000:
        raise ValueError("a manifest of more than 100000 rows is not broadcast")
    docs = documents.withColumn("_key", key)
    m = manifest.select(F.col("key").alias("_mkey"), "pos", "doc_family", "organization", "year")
    hits = docs.join(F.broadcast(m), F.col("_mkey").endswith(F.col("_key")) & (F.col("_key") != ""))
    best = hits.groupBy("_key").agg(F.min_by(F.struct("doc_family", "organization", "year"), F.struct(F.col("_mkey") != F.col("_key"), "pos")).alias("m"))
    return docs.join(best, "_key", "left").select(*documents.columns, "m.doc_family", "m.organization", "m.year", F.col("m").isNotNull().alias("matched"))
