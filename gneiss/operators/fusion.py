"""Weighted reciprocal-rank fusion, min-max relevance and greedy maximal marginal relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine


def rrf(dense: DataFrame, lexical: DataFrame, k: int = 60, dense_weight: float = 1.0, lexical_weight: float = 0.85, quality: DataFrame | None = None, pool: int | None = None) -> DataFrame:
    """query_id, chunk_id, rrf_score, dense_rank, bm25_rank, rrf_rank, from two rankings (query_id,
    chunk_id, rank); one shuffle. ``quality(chunk_id, penalty)`` scales scores. Ties keep dense order, then lexical."""
    side = lambda df, name, w: df.select("query_id", "chunk_id", (F.lit(w) / (k + F.col("rank"))).alias("part"), F.when(F.lit(name == "dense"), F.col("rank")).alias("dense_rank"), F.when(F.lit(name != "dense"), F.col("rank")).alias("bm25_rank"))
    both = side(dense, "dense", dense_weight).unionByName(side(lexical, "bm25", lexical_weight))
    fused = both.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("rrf_score"), F.max("dense_rank").alias("dense_rank"), F.max("bm25_rank").alias("bm25_rank"))
    if quality is not None:
        fused = fused.join(quality.select("chunk_id", "penalty"), "chunk_id", "left").withColumn("rrf_score", F.col("rrf_score") * F.coalesce("penalty", F.lit(1.0))).drop("penalty")
    order = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last())
    ranked = fused.withColumn("rrf_rank", F.row_number().over(order)).select("query_id", "chunk_id", "rrf_score", "dense_rank", "bm25_rank", "rrf_rank")
    return ranked if pool is None else ranked.where(F.col("rrf_rank") <= pool)


def min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """Scale within each query to 0..1; equal values all become 1."""
    w = Window.partitionBy("query_id")
    low, high = F.min(value).over(w), F.max(value).over(w)
    flat = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return df.withColumn(out, F.when(flat, 1.0).otherwise((F.col(value) - low) / (high - low)))


def relevance(pool: DataFrame, vectors: DataFrame, query_vectors: DataFrame, rrf_weight: float = 0.85, semantic_weight: float = 0.15) -> DataFrame:
    """Pool rows plus vec, semantic_similarity and relevance; a pool row without a vector raises."""
    if abs(rrf_weight + semantic_weight - 1) > 1e-9:
        raise ValueError("relevance weights must add up to 1")
    rows = pool.join(vectors.select("chunk_id", "vec"), "chunk_id", "left").join(query_vectors, "query_id")
    rows = rows.withColumn("vec", F.when(F.col("vec").isNull(), F.raise_error(F.concat(F.lit("no vector for "), F.col("chunk_id").cast("string")))).otherwise(F.col("vec")))
    rows = rows.withColumn("semantic_similarity", cosine(F.col("vec"), F.col("qvec"))).drop("qvec")
    rows = min_max(min_max(rows, "rrf_score", "normalized_rrf"), "semantic_similarity", "normalized_semantic")
    return rows.withColumn("relevance", rrf_weight * F.col("normalized_rrf") + semantic_weight * F.col("normalized_semantic"))


def mmr(rows: DataFrame, final_k: int = 6, candidate_k: int = 40, balance: float = 0.8, per_document: int = 2) -> DataFrame:
    """Greedy picks from ``rows(query_id, chunk_id, document_id, rrf_rank, relevance, vec)``: chunk_id,
    selection_rank, mmr_score, redundancy. A pool is at most ``candidate_k`` rows of one query, so it is folded
    as an array; a document's cap is lifted when no other candidate is left; the first of equal scores wins."""
    pool = rows.where(F.col("rrf_rank") <= candidate_k)
    packed = pool.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rrf_rank", "chunk_id", "document_id", "relevance", "vec"))).alias("c"))
    sims = F.transform("c", lambda a: F.transform("c", lambda b: cosine(a["vec"], b["vec"])))
    packed = packed.withColumn("sims", sims).withColumn("docs", F.transform("c", lambda a: a["document_id"].cast("string"))).withColumn("rel", F.transform("c", lambda a: a["relevance"]))
    trace = "array<struct<i:int,score:double,redundancy:double>>"
    zero = F.struct(F.expr("cast(array() as array<int>)").alias("sel"), F.expr(f"cast(array() as {trace})").alias("trace"))

    def step(acc, _):
        sel = acc["sel"]
        every = F.filter(F.sequence(F.lit(1), F.size("rel")), lambda i: ~F.array_contains(sel, i))
        used = lambda i: F.size(F.filter(sel, lambda j: F.element_at("docs", j) == F.element_at("docs", i)))
        free = F.filter(every, lambda i: used(i) < per_document)
        near = lambda i: F.when(F.size(sel) == 0, 0.0).otherwise((F.array_max(F.transform(sel, lambda j: F.element_at(F.element_at(F.col("sims"), i), j))) + 1) / 2)
        scored = F.transform(F.when(F.size(free) > 0, free).otherwise(every), lambda i: F.struct((balance * F.element_at("rel", i) - (1 - balance) * near(i)).alias("score"), (-i).alias("o"), near(i).alias("redundancy")))
        best = F.array_max(scored)
        pick = F.struct((-best["o"]).alias("i"), best["score"].alias("score"), best["redundancy"].alias("redundancy"))
        more = best.isNotNull()
        return F.struct(F.when(more, F.concat(sel, F.array(pick["i"]))).otherwise(sel).alias("sel"), F.when(more, F.concat(acc["trace"], F.array(pick))).otherwise(acc["trace"]).alias("trace"))

    picks = packed.select("query_id", "c", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(final_k)), zero, step, lambda a: a["trace"])).alias("pos", "t"))
    chosen = F.element_at("c", F.col("t.i"))
    return picks.select("query_id", (F.col("pos") + 1).alias("selection_rank"), chosen["chunk_id"].alias("chunk_id"), chosen["document_id"].alias("document_id"), F.col("t.score").alias("mmr_score"), F.col("t.redundancy").alias("redundancy"))


def rerank(pool: DataFrame, score, top_k: int = 10, order_in: str = "rrf_rank") -> DataFrame:
    """Order each query's pool by ``score`` (a Column, for instance a pandas UDF over query and text): pre_rerank_rank and rank; ties keep the order they came in."""
    scored = pool.withColumn("rerank_score", score).withColumn("pre_rerank_rank", F.col(order_in))
    w = Window.partitionBy("query_id").orderBy(F.round("rerank_score", 9).desc(), order_in)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, top_k))


def probability_score(direct, partial, expected: bool = True):
    """direct + half of partial relevance, or direct alone."""
    return direct + 0.5 * partial if expected else direct
