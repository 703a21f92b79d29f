"""Profiles and end-to-end retrieval over a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_role, reference_penalty
from ..operators import evaluation, fusion
from ..operators.dense import knn_blocks
from ..operators.lexical import top_lexical


@dataclass(frozen=True)
class Profile:
    dense_n: int = 40
    lexical_n: int = 40
    k: int = 60
    dense_weight: float = 1.0
    lexical_weight: float = 0.85
    penalize: bool = True
    pool: int = 40
    final_k: int = 6
    balance: float = 0.8
    rrf_weight: float = 0.85
    semantic_weight: float = 0.15
    per_document: int = 2

    def __post_init__(self):
        if min(self.dense_n, self.lexical_n, self.k, self.pool, self.final_k, self.per_document) < 1 or min(self.dense_weight, self.lexical_weight) < 0:
            raise ValueError("counts must be positive and weights not negative")
        if abs(self.rrf_weight + self.semantic_weight - 1) > 1e-9 or not 0 <= self.balance <= 1:
            raise ValueError("relevance weights must add up to 1 and balance lie in 0..1")


PRODUCTION = Profile()
BENCHMARK = Profile(lexical_n=20, dense_weight=1.10, penalize=False, pool=30)


def hybrid(chunks: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, p: Profile = PRODUCTION, lexical: DataFrame | None = None) -> DataFrame:
    """Fused pool of every query. With ``penalize`` reference chunks are scaled in the lexical ranking and again in the fusion.
    ``lexical`` is that ranking, if it was made before."""
    quality, penalty = None, reference_penalty(chunk_role(F.col("text")))
    chunks = chunks.withColumn("penalty", penalty) if p.penalize else chunks
    lexical = top_lexical(chunks, queries, p.lexical_n, penalty=p.penalize) if lexical is None else lexical
    dense = knn_blocks(vectors, query_vectors, p.dense_n, skip_self=True)
    if p.penalize:
        # Only ranked chunks are judged again: as many as the queries have places; the side that is broadcast.
        ranked = dense.select("chunk_id").unionByName(lexical.select("chunk_id")).distinct()
        quality = chunks.drop("penalty").join(F.broadcast(ranked), "chunk_id", "left_semi").select("chunk_id", penalty.alias("penalty"))
    return fusion.rrf(dense, lexical, p.k, p.dense_weight, p.lexical_weight, quality, p.pool)


def diversified(chunks: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, p: Profile = PRODUCTION) -> DataFrame:
    """Hybrid pool, relevance and MMR picks."""
    # A pool is as large as the queries; the side that is broadcast.
    pool = chunks.select("chunk_id", "document_id").join(F.broadcast(hybrid(chunks, queries, vectors, query_vectors, p)), "chunk_id")
    pool = pool.join(vectors.select("chunk_id"), "chunk_id", "left_semi")
    rows = fusion.relevance(pool, vectors, query_vectors, p.rrf_weight, p.semantic_weight)
    return fusion.mmr(rows, p.final_k, p.pool, p.balance, p.per_document)


def benchmark_run(lexical: DataFrame, dense: DataFrame, pool: DataFrame, gold: DataFrame, rerankers: dict | None = None, top_k: int = 10) -> DataFrame:
    """Metric rows of all methods over one fused pool: lexical, dense, fused, and a reranking per scorer Column."""
    named = lambda df, name, rank="rank": df.select("query_id", "chunk_id", F.col(rank).alias("rank"), F.lit(name).alias("method"))
    rows = named(lexical, "bm25").unionByName(named(dense, "dense")).unionByName(named(pool, "rrf", "rrf_rank"))
    for name, score in (rerankers or {}).items():
        rows = rows.unionByName(named(fusion.rerank(pool, score, top_k), name))
    methods = pool.sparkSession.createDataFrame([(m,) for m in ("bm25", "dense", "rrf", *(rerankers or {}))], "method string")
    return evaluation.metrics_hit(rows, gold, methods)
