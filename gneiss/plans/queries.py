"""The registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, context, evaluation, fusion, layout, lexical, report
from ..operators.dense import knn, knn_blocks, ranks_of
from ..sources.readers import benchmark_queries, document_chunks, stored_vectors, table
from ..sources.sinks import upserted
from .models import scorer
from .retrieval import BENCHMARK, PRODUCTION, benchmark_run, diversified, hybrid

def _doc_tokens(spark, d):
    return lexical.tokens(document_chunks(spark, d))


def tokenize_stats(spark, d):
    return _doc_tokens(spark, d).select("chunk_id", F.col("dl").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


def postings_df(spark, d):
    return lexical.postings(_doc_tokens(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_corpus_stats(spark, d):
    docs = _doc_tokens(spark, d)
    return lexical.corpus_stats(docs).crossJoin(lexical.postings(docs).agg(F.countDistinct("term").alias("vocabulary"))).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "vocabulary")


def bm25_idf(spark, d):
    docs = _doc_tokens(spark, d)
    return lexical.idf(docs, lexical.corpus_stats(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


def _weights(spark, d):
    return lexical.weigh(document_chunks(spark, d), benchmark_queries(spark, d))


def _lexical(spark, d, n=20, weights=None):
    return lexical.top_lexical(document_chunks(spark, d), benchmark_queries(spark, d), n, weights=weights)


def bm25_top20(spark, d):
    return _lexical(spark, d).select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


def _gold(spark, d):
    """Documents that hold a passage; benchmark is a fixed small table, which every task holds."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return lexical.holders(document_chunks(spark, d), b)


def _held_gold(spark, d):
    """The same, found once (a job) and held by the driver: pairs of two numbers, for queries that look at it more than once."""
    return spark.createDataFrame(_gold(spark, d).toArrow())


def bm25_full_rank_gold(spark, d):
    return lexical.ranks_of(document_chunks(spark, d), benchmark_queries(spark, d), _gold(spark, d)).select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


def _query_vectors(spark, d):
    v = stored_vectors(spark, d).select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    return v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), "query_id")


def _dense(spark, d, n=40):
    return knn_blocks(stored_vectors(spark, d).select("chunk_id", "vec"), _query_vectors(spark, d), n, skip_self=True)


def dense_top40(spark, d):
    return _dense(spark, d).select("query_id", "chunk_id", "rank", F.round("distance", 5).alias("distance"))


def dense_expression_top10(spark, d):
    return knn(stored_vectors(spark, d).select("chunk_id", "vec"), _query_vectors(spark, d), 10, skip_self=True).select("query_id", "chunk_id", "rank", F.round("distance", 5).alias("distance"))


def dense_label_precision(spark, d):
    v = stored_vectors(spark, d)
    hits = _dense(spark, d, 10).join(v.select("chunk_id", F.col("label").alias("found")), "chunk_id").join(v.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return hits.groupBy("query_id").agg(F.round(F.avg((F.col("found") == F.col("own")).cast("double")), 6).alias("precision_at_10"))


def _pool(spark, d, p=BENCHMARK, ranked=None):
    return hybrid(document_chunks(spark, d), benchmark_queries(spark, d), stored_vectors(spark, d).select("chunk_id", "vec"), _query_vectors(spark, d), p, ranked)


def rrf_pool30(spark, d):
    return _pool(spark, d).withColumn("rrf_score", F.round("rrf_score", 9))


def rrf_production_penalty(spark, d):
    return _pool(spark, d, PRODUCTION).withColumn("rrf_score", F.round("rrf_score", 9))


def pool_gold_ceiling(spark, d):
    return evaluation.pool_ceiling(_pool(spark, d), _held_gold(spark, d))


def missing_gold_anti(spark, d):
    return evaluation.missing_gold(_gold(spark, d), stored_vectors(spark, d))


def index_symmetric_diff(spark, d):
    return evaluation.index_difference(document_chunks(spark, d), stored_vectors(spark, d))


def _methods(spark, d):
    ranked = _lexical(spark, d, BENCHMARK.lexical_n)
    lex = ranked.select("query_id", "chunk_id", "rank", F.lit("bm25").alias("method"))
    return lex.unionByName(_pool(spark, d, ranked=ranked).select("query_id", "chunk_id", F.col("rrf_rank").alias("rank"), F.lit("rrf").alias("method")))


def _metric_rows(spark, d, gold=None):
    methods = spark.createDataFrame([("bm25",), ("rrf",)], "method string")
    return evaluation.metrics_hit(_methods(spark, d), _held_gold(spark, d) if gold is None else gold, methods)


def metrics_hit_per_query(spark, d):
    rows = _metric_rows(spark, d)
    return rows.select("query_id", "method", "hit_at_1", "recall_at_5", "recall_at_10", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg_at_5", "ndcg_at_10")], "first_rank")


def metrics_fraction_per_query(spark, d):
    return evaluation.metrics_fraction(_lexical(spark, d), _held_gold(spark, d)).select("query_id", "gold_count", "recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "mrr")


def metrics_method_summary(spark, d):
    return evaluation.method_summary(_metric_rows(spark, d)).select("method", "questions", F.round("hit_at_1", 6).alias("hit_at_1"), F.round("recall_at_10", 6).alias("recall_at_10"), F.round("mrr", 6).alias("mrr"), "any_gold", "top_1", "top_3", "top_5", "top_10")


def metrics_by_source_pivot(spark, d):
    """Categories are the source of each question's first gold document."""
    gold = _held_gold(spark, d)
    first = gold.groupBy("query_id").agg(F.min("chunk_id").alias("chunk_id"))
    category = first.join(document_chunks(spark, d), "chunk_id").select("query_id", F.col("document_id").alias("category"))
    p = evaluation.category_pivot(_metric_rows(spark, d, gold), category, ["bm25", "rrf"])
    return p.select("category", *[F.round(c, 6).alias(c) for c in ("bm25_mrr", "bm25_hit_at_1", "rrf_mrr", "rrf_hit_at_1")])


def paired_win_tie_loss(spark, d):
    pair = evaluation.paired(_metric_rows(spark, d), "rrf", "bm25")
    return pair.withColumn("p_value", F.round(evaluation.sign_test(F.col("wins"), F.col("losses")), 9))


def _trace(spark, d):
    weights, gold = _weights(spark, d), _held_gold(spark, d)
    full = lexical.ranks_of(document_chunks(spark, d), benchmark_queries(spark, d), gold, weights)
    dense = ranks_of(stored_vectors(spark, d).select("chunk_id", "vec"), _query_vectors(spark, d), gold, skip_self=True)
    return evaluation.gold_trace(gold, dense, full, _pool(spark, d, ranked=_lexical(spark, d, BENCHMARK.lexical_n, weights)))


def gold_trace(spark, d):
    return _trace(spark, d)


def gold_diagnosis(spark, d):
    return evaluation.gold_diagnosis(_trace(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"))


def dedupe_first_wins(spark, d):
    return report.first_by_text(document_chunks(spark, d)).select("chunk_id", "duplicate_count")


def duplicate_text_groups(spark, d):
    return report.duplicate_texts(document_chunks(spark, d).withColumn("text", F.translate("text", "-", " ")))


def _chunk_table(spark, d):
    t = document_chunks(spark, d).withColumn("c", T.completeness(F.col("text")))
    none = F.lit(None).cast("string")
    return t.select(F.col("document_id").alias("document"), "chunk_id", "corpus_pos", "text", F.lit("text").alias("source_type"), T.estimate_tokens(F.col("text")).alias("estimated_tokens"), F.col("lang").alias("section"), none.alias("subsection"), none.alias("local_heading"), F.col("c.status").alias("completeness"), F.size("c.issues").alias("n_issues"), F.col("c.score").alias("score"))


def chunk_quality_report(spark, d):
    return report.quality_report(_chunk_table(spark, d)).select("document", "chunk_count", "text_chunk_count", "average_characters", "min_characters", "max_characters", "median_estimated_tokens", "section_coverage_percent", "orphan_candidates", "short_chunks", "long_chunks")


def corpus_quality_totals(spark, d):
    return report.corpus_totals(report.quality_report(_chunk_table(spark, d))).select("documents", "chunk_count", "orphan_candidates", "short_chunks", "long_chunks", "short_ratio")


def short_chunk_thresholds(spark, d):
    return report.token_thresholds(_chunk_table(spark, d), "document")


def orphan_reasons(spark, d):
    return report.orphans(_chunk_table(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


def semantic_completeness(spark, d):
    return _chunk_table(spark, d).select("chunk_id", "completeness", "score", "n_issues")


def text_quality_flags(spark, d):
    return document_chunks(spark, d).select("chunk_id", F.array_join(T.quality_flags(F.col("text")), ",").alias("flags"))


def chunk_role(spark, d):
    return document_chunks(spark, d).groupBy(T.chunk_role(F.col("text")).alias("role")).agg(F.count("*").alias("n"))


def reference_only_filter(spark, d):
    return document_chunks(spark, d).select("chunk_id", T.is_reference_only(F.col("text")).alias("reference_only"))


def token_estimate_bins(spark, d):
    t = T.estimate_tokens(F.col("text"))
    return document_chunks(spark, d).groupBy((F.floor(t / 100) * 100).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.sum(t).alias("tokens"))


def _pages(spark, d):
    """Documents as the pages of their source."""
    return document_chunks(spark, d).select(F.col("document_id").alias("document"), F.col("chunk_id").alias("page"), "text")


def repeated_line_detection(spark, d):
    return chunking.repeated_edge_lines(_pages(spark, d), share=0.02)


def heading_classification(spark, d):
    return chunking.with_heading(chunking.lines_of(document_chunks(spark, d))).select("heading.kind").groupBy("kind").agg(F.count("*").alias("n"))


def page_line_filter(spark, d):
    return chunking.page_lines(_pages(spark, d)).groupBy("document").agg(F.count("*").alias("lines"), F.countDistinct("page").alias("pages"))


def prev_next_links(spark, d):
    return report.links(document_chunks(spark, d), "document_id", "corpus_pos").select("chunk_id", "prev_chunk_id", "next_chunk_id")


def stable_chunk_ids(spark, d):
    key = T.chunk_key(F.concat(F.col("document_id"), F.lit(".json")), F.lit(1), F.col("ascii"), F.lit("text"), F.lit(0))
    return document_chunks(spark, d).withColumn("ascii", F.regexp_replace("text", r"[^\x20-\x7E]", "")).select("chunk_id", key.alias("stable_id"))


def _assembled(spark, d):
    none = F.lit(None).cast("string")
    # A pool is as large as the queries; the side that is broadcast.
    rows = document_chunks(spark, d).join(F.broadcast(_pool(spark, d).where("rrf_rank <= 6")), "chunk_id").select("query_id", F.col("rrf_rank").alias("rank"), "chunk_id", "text", "document_id", F.lit(1).alias("page"), none.alias("section"), none.alias("subsection"), F.lit("text").alias("source_type"))
    return context.assemble(rows)


def context_assembly(spark, d):
    return _assembled(spark, d).select("query_id", "source_count", "input_count", "reference_filtered_count", "duplicate_filtered_count")


def context_texts(spark, d):
    return _assembled(spark, d).select("query_id", "context_text", F.array_join(F.transform("sources", lambda s: s["id"].cast("string")), ",").alias("source_ids"))


def citation_validation(spark, d):
    """Turns with two tags put on, the second beyond the sources of every third turn."""
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit(" [SOURCE 1] [source 2, "), (F.col("turn") % 3 + 2).cast("string"), F.lit("]"))
    t = table(spark, d, "conversations").withColumn("answer", answer)
    return t.select("conv_id", "turn", F.array_join(T.cited_sources(F.col("answer")).cast("array<string>"), ",").alias("cited"), T.citations_valid(F.col("answer"), F.lit(3)).alias("valid"), T.citation_count(F.col("answer")).alias("tags"))


def out_of_scope_turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.has_medication_signal(F.col("text")).alias("medication"), T.is_out_of_scope(F.col("text")).alias("out_of_scope"))


def minmax_relevance(spark, d):
    rows = fusion.min_max(_pool(spark, d), "rrf_score", "normalized_rrf")
    return rows.select("query_id", "chunk_id", F.round("normalized_rrf", 6).alias("normalized_rrf"))


def mmr_top6(spark, d):
    return diversified(document_chunks(spark, d), benchmark_queries(spark, d), stored_vectors(spark, d).select("chunk_id", "vec"), _query_vectors(spark, d))


def probability_rank(spark, d):
    """Rerank the pool by made-up probabilities from the ranks of both sides."""
    direct = 1.0 / (1 + F.coalesce(F.col("bm25_rank"), F.lit(99)))
    partial = 1.0 / (1 + F.coalesce(F.col("dense_rank"), F.lit(99)))
    return fusion.rerank(_pool(spark, d), fusion.probability_score(direct, partial)).select("query_id", "chunk_id", "pre_rerank_rank", "rank", F.round("rerank_score", 6).alias("rerank_score"))


def rerank_udf(spark, d):
    score = scorer(lambda: lambda q, t: [float(len(set(a.split()) & set(b.split()))) for a, b in zip(q, t, strict=True)])
    pool = document_chunks(spark, d).select("chunk_id", "text").join(F.broadcast(_pool(spark, d)), "chunk_id").join(benchmark_queries(spark, d), "query_id")
    return fusion.rerank(pool, score("query", "text")).select("query_id", "chunk_id", "pre_rerank_rank", "rank", "rerank_score")


def manifest_override(spark, d):
    """A made-up manifest for half of the sources, its year null for one of them."""
    manifest = spark.createDataFrame([("src1json", 0, "WHO", "World Health Organization", 2020), ("src2json", 1, "NICE", "NICE", None)], "key string, pos long, doc_family string, organization string, year int")
    docs = table(spark, d, "documents").select("source").distinct().withColumn("file", F.concat("source", F.lit(".json")))
    return report.manifest_lookup(docs, manifest, T.filename_key(F.col("file"))).select("source", "doc_family", "organization", "year", "matched")


def legacy_id_consume(spark, d):
    """Every document may take a prior id of its language; there is one for each labelled document."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    prior = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select("lang", F.col("doc_id").alias("prior_pos"), F.concat(F.lit("old_"), F.col("doc_id").cast("string")).alias("legacy_chunk_id"))
    return report.consume_ids(docs, prior, ["lang"], "doc_id", "prior_pos").select("doc_id", "legacy_chunk_id")


def vector_upsert(spark, d):
    v = stored_vectors(spark, d).select("chunk_id", "label")
    new = v.where(F.col("label") == 3).withColumn("label", F.lit(-3))
    return upserted(v, new).groupBy("label").agg(F.count("*").alias("n"))


def sentence_packing(spark, d):
    return document_chunks(spark, d).select("chunk_id", F.posexplode(T.pack_sentences(F.col("text"))).alias("piece", "text")).select("chunk_id", "piece", F.length("text").alias("length"))


def page_chunks(spark, d):
    return chunking.chunk_pages(_pages(spark, d)).select("document", "page", "chunk_id", "section", "local_heading", "estimated_tokens", "completeness")


def _layout(spark, d):
    """Every document as a file of one page in two columns: its lines as blocks with boxes, every seventeenth bold and
    larger, and for every fiftieth document a table over the page's foot."""

    def block(x, i):
        left, top = F.when(i % 60 < 30, 50.0).otherwise(320.0), (i % 30) * 22.0 + 40.0
        font = F.struct(F.when(i % 17 == 0, 13.0).otherwise(10.0).alias("size"), (i % 17 == 0).alias("bold"))
        return F.struct(x.alias("text"), F.array(left, top, left + 230.0, top + 12.0).alias("bbox"), F.array(font).alias("spans"))

    rows = F.array(F.array(F.lit("COR"), F.lit("LOE"), F.lit("Recommendations")), F.array(F.lit("1"), F.lit("A"), F.lit("Walk daily.")), F.array(F.lit("2a"), F.lit("B-NR"), F.lit("Rest well.")))
    table_of = F.struct(F.array(*[F.lit(x) for x in (40.0, 600.0, 560.0, 760.0)]).alias("bbox"), rows.alias("rows"))
    tables = F.when(F.col("chunk_id") % 50 == 0, F.array(table_of)).otherwise(F.expr("cast(array() as array<struct<bbox:array<double>,rows:array<array<string>>>>)"))
    name = F.when(F.col("chunk_id") % 3 == 0, F.format_string("aha acc %d.json", "chunk_id")).when(F.col("chunk_id") % 3 == 1, F.format_string("nice guideline %d.json", "chunk_id")).otherwise(F.format_string("doc_%d.json", "chunk_id"))
    return layout.layout_chunks(document_chunks(spark, d).select(name.alias("document"), F.lit(1).alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), "text", F.transform(F.split("text", "\n"), block).alias("blocks"), tables.alias("tables")))


def layout_chunks(spark, d):
    return _layout(spark, d).select("document", "chunk_no", "chunk_id", "chunk_type", "section_id", "token_count", "recommendation_id", "grade_system")


def short_page_chunks(spark, d):
    """Page chunks of the older profile, which drops text pieces under 300 characters."""
    return chunking.chunk_pages(_pages(spark, d), min_text=300).select("document", "page", "chunk_id", "section", "estimated_tokens")


def _flat_chunks(spark, d):
    """Documents as chunks of the positioned chunker, their kinds and labels made up from their numbers."""
    c, none = document_chunks(spark, d), F.lit(None).cast("string")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("paragraph", "list_item", "recommendation", "table", "references", "appendix")]), (F.col("chunk_id") % 6 + 1).cast("int"))
    path = F.when(F.col("chunk_id") % 4 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array("lang"))
    return c.select(
        F.col("document_id").alias("document"), F.lit("GENERIC").alias("doc_family"), F.col("chunk_id").alias("chunk_no"), F.col("chunk_id").cast("string").alias("chunk_id"), kind.alias("chunk_type"), "text",
        T.estimate_tokens(F.col("text")).alias("token_count"), F.when(F.col("chunk_id") % 5 == 0, "A").alias("evidence_grade"), F.when(F.col("chunk_id") % 7 == 0, "high").alias("evidence_quality"),
        F.when(F.col("chunk_id") % 8 == 0, "strong").alias("recommendation_strength"), F.lit(True).alias("embedding_eligible"), path.alias("section_path"), F.lit(1).alias("n_spans"),
        F.when(F.col("chunk_id") % 9 == 0, "extracted").otherwise("generated").alias("recommendation_id_source"), F.lit(False).alias("noisy_path"), none.alias("spare"),
    )


def layout_statistics(spark, d):
    r = layout.layout_report(_flat_chunks(spark, d))
    return r.select("document", "chunk_count", "recommendation_chunks", "under_30", "under_50_excluding_atomic", "under_30_ratio", "median_chars", "average_tokens", "max_tokens", "chunks_over_char_target", "recommendation_evidence_grade_filled_ratio", "orphan_chunk_count", "recommendation_id_extracted_count", "broken_text_chunk_count", F.array_join("orphan_samples", ",").alias("orphan_samples"))


def layout_totals(spark, d):
    return layout.layout_totals(layout.layout_report(_flat_chunks(spark, d))).select("documents", *layout.COUNTERS, "under_30_ratio", "under_30_excluding_atomic_ratio", "orphan_chunk_ratio", "recommendation_strength_filled_ratio")


def benchmark_methods(spark, d):
    """All methods of a benchmark run over one pool, a made-up reranker among them."""
    ranked = _lexical(spark, d, BENCHMARK.lexical_n)
    pool = _pool(spark, d, ranked=ranked)
    direct = 1.0 / (1 + F.coalesce(F.col("bm25_rank"), F.lit(99)))
    rows = benchmark_run(ranked, _dense(spark, d), pool, _held_gold(spark, d), {"lexical_first": direct})
    return rows.select("query_id", "method", "hit_at_1", "recall_at_10", F.round("mrr", 6).alias("mrr"), "first_rank")


def layout_report(spark, d):
    return layout.layout_report(_layout(spark, d)).select("document", "chunk_count", "under_30", "under_30_excluding_atomic", "median_tokens", "orphan_chunk_count")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        tokenize_stats, postings_df, bm25_corpus_stats, bm25_idf, bm25_top20, bm25_full_rank_gold, dense_top40, dense_expression_top10, dense_label_precision, rrf_pool30,
        rrf_production_penalty, pool_gold_ceiling, missing_gold_anti, index_symmetric_diff, metrics_hit_per_query, metrics_fraction_per_query, metrics_method_summary,
        metrics_by_source_pivot, paired_win_tie_loss, gold_trace, gold_diagnosis, dedupe_first_wins, duplicate_text_groups, chunk_quality_report, corpus_quality_totals,
        short_chunk_thresholds, orphan_reasons, semantic_completeness, text_quality_flags, chunk_role, reference_only_filter, token_estimate_bins, repeated_line_detection,
        heading_classification, page_line_filter, prev_next_links, stable_chunk_ids, context_assembly, context_texts, citation_validation, out_of_scope_turns,
        minmax_relevance, mmr_top6, probability_rank, rerank_udf, manifest_override, legacy_id_consume, vector_upsert, sentence_packing, page_chunks,
        layout_chunks, layout_report, short_page_chunks, layout_statistics, layout_totals, benchmark_methods,
    )
    return {q.__name__: q for q in every}
