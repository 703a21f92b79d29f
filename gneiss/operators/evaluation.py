"""Retrieval metrics, summaries, comparisons and gold diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hits(ranked: DataFrame, gold: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Gold ranks per (question, method) and gold counts per question."""
    counts = gold.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n_gold"))
    found = ranked.join(gold.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi").groupBy(*keys).agg(F.min("rank").alias("first"), F.sort_array(F.collect_list("rank")).alias("ranks"))
    return found, counts


def _gain(ranks: Column, k: int) -> Column:
    return F.aggregate(F.filter(F.coalesce(ranks, F.expr("cast(array() as array<int>)")), lambda r: r <= k), F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + F.lit(1.0)))


def _ideal(n_gold: Column, k: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.least(n_gold.cast("int"), F.lit(k))), F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + F.lit(1.0)))


def metrics_hit(ranked: DataFrame, gold: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """Per (query_id, method): hit_at_1, recall_at_{1,3,5,10} (any gold in the top), mrr, ndcg_at_{5,10}, first_rank."""
    found, counts = _hits(ranked, gold, ["query_id", "method"])
    methods = ranked.select("method").distinct() if methods is None else methods
    rows = counts.crossJoin(F.broadcast(methods)).join(found, ["query_id", "method"], "left")
    any_in = lambda k: F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))
    return rows.select(
        "query_id", "method", any_in(1).alias("hit_at_1"), *[any_in(k).alias(f"recall_at_{k}") for k in (1, 3, 5, 10)], F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        *[(_gain(F.col("ranks"), k) / _ideal(F.col("n_gold"), k)).alias(f"ndcg_at_{k}") for k in (5, 10)], F.col("first").alias("first_rank"),
    )


def metrics_fraction(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query of ``ranked``: recall_at_k as the share of gold in the top, precision-free, rounded to four digits; null without gold."""
    found, counts = _hits(ranked, gold, ["query_id"])
    rows = ranked.select("query_id").distinct().join(counts, "query_id", "left").join(found, "query_id", "left")
    within = lambda k: F.size(F.filter(F.coalesce("ranks", F.expr("cast(array() as array<int>)")), lambda r: r <= k))
    some = F.col("n_gold") > 0
    return rows.select("query_id", F.col("n_gold").alias("gold_count"), *[F.when(some, F.bround(within(k) / F.col("n_gold"), 4)).alias(f"recall_at_{k}") for k in (1, 3, 5, 10)], F.when(some, F.bround(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4)).alias("mrr"), *[F.when(some, F.bround(_gain(F.col("ranks"), k) / _ideal(F.col("n_gold"), k), 4)).alias(f"ndcg_at_{k}") for k in (5, 10)])


def metrics_single(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """metrics_hit for questions with exactly one gold id; more or fewer raise."""
    checked = gold.groupBy("query_id").agg(F.count("*").alias("n"), F.first("chunk_id").alias("chunk_id"))
    one = F.when(F.col("n") == 1, F.col("chunk_id")).otherwise(F.raise_error(F.lit("exactly one gold id is required")))
    return metrics_hit(ranked, checked.select("query_id", one.alias("chunk_id")))


def method_summary(rows: DataFrame) -> DataFrame:
    means = ("hit_at_1", "recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_5", "ndcg_at_10")
    within = lambda k: F.count_if(F.col("first_rank") <= k)
    return rows.groupBy("method").agg(F.count("*").alias("questions"), *[F.avg(c).alias(c) for c in means], F.count("first_rank").alias("any_gold"), within(1).alias("top_1"), within(3).alias("top_3"), within(5).alias("top_5"), within(10).alias("top_10"))


def category_pivot(rows: DataFrame, categories: DataFrame, methods: list[str]) -> DataFrame:
    """Means of mrr and hit_at_1 by category, a column pair per method."""
    return rows.join(categories, "query_id").groupBy("category").pivot("method", methods).agg(F.avg("mrr").alias("mrr"), F.avg("hit_at_1").alias("hit_at_1"))


def paired(rows: DataFrame, method: str, other: str) -> DataFrame:
    """One row: wins, ties, losses of ``method`` against ``other`` by first gold rank (none: last)."""
    last = F.lit(float("inf"))
    side = lambda m, n: rows.where(F.col("method") == m).select("query_id", F.coalesce(F.col("first_rank").cast("double"), last).alias(n))
    both = side(method, "a").join(side(other, "b"), "query_id")
    return both.agg(F.count_if(F.col("a") < F.col("b")).alias("wins"), F.count_if(F.col("a") == F.col("b")).alias("ties"), F.count_if(F.col("a") > F.col("b")).alias("losses"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided sign test; terms are carried as ratios, so large counts do not overflow."""
    n, k = wins + losses, F.least(wins, losses)
    start = F.struct(F.lit(0.0).alias("sum"), F.pow(F.lit(0.5), n.cast("double")).alias("term"))
    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), start, lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (n - i) / (i + 1)).alias("term")), lambda a: a["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def pool_ceiling(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: questions, and those with a gold chunk in the pool."""
    inside = pool.join(gold, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct().withColumn("inside", F.lit(1))
    return gold.select("query_id").distinct().join(inside, "query_id", "left").agg(F.count("*").alias("questions"), F.count("inside").alias("in_pool"))


def missing_gold(gold: DataFrame, corpus: DataFrame) -> DataFrame:
    return gold.join(corpus.select("chunk_id"), "chunk_id", "left_anti").select("query_id", "chunk_id")


def require_gold(gold: DataFrame, corpus: DataFrame) -> None:
    """Raise with up to twenty of the missing pairs."""
    if rows := missing_gold(gold, corpus).limit(20).collect():
        raise ValueError("gold ids that the corpus lacks: " + ", ".join(f"{r[0]}: {r[1]}" for r in rows))


def index_difference(corpus: DataFrame, index: DataFrame) -> DataFrame:
    """chunk_id and side ('missing' from the index, 'extra' in it)."""
    a, b = corpus.select("chunk_id").distinct(), index.select("chunk_id").distinct()
    return a.join(b, "chunk_id", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "chunk_id", "left_anti").withColumn("side", F.lit("extra")))


def gold_trace(gold: DataFrame, dense_full: DataFrame, lexical_full: DataFrame, fused: DataFrame, pool: int = 30) -> DataFrame:
    """Each gold pair with its full ranks, fused rank and whether it is in the pool."""
    out = gold
    for name, df, column in (("dense_rank", dense_full, "rank"), ("bm25_rank", lexical_full, "rank"), ("rrf_rank", fused, "rrf_rank")):
        out = out.join(df.select("query_id", "chunk_id", F.col(column).alias(name)), ["query_id", "chunk_id"], "left")
    return out.withColumn("in_pool", F.coalesce(F.col("rrf_rank") <= pool, F.lit(False)))


def gold_diagnosis(trace: DataFrame, top_dense: int = 40, top_lexical: int = 20) -> DataFrame:
    none = F.col("dense_rank").isNull() & F.col("bm25_rank").isNull()
    outside = (F.coalesce("dense_rank", F.lit(1 << 30)) > top_dense) & (F.coalesce("bm25_rank", F.lit(1 << 30)) > top_lexical)
    verdict = F.when(none, "not_indexed").when(outside, "outside_both").when(F.col("rrf_rank").isNull(), "not_fused").when(~F.col("in_pool"), "outside_pool").otherwise("in_pool")
    return trace.withColumn("verdict", verdict)


def gold_rows(debug: DataFrame) -> DataFrame:
    """Debug rows with alias-coalesced names: id, dense_rank, bm25_rank, rrf_rank; rows without an id go."""
    have = set(debug.columns)
    first = lambda names, kind: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have], F.lit(None).cast("string")).cast(kind)
    return debug.select(first(("id", "chunk_id", "gold_id"), "string").alias("id"), first(("dense_rank", "dense_full_rank"), "int").alias("dense_rank"), first(("bm25_rank", "lexical_rank", "bm25_full_rank"), "int").alias("bm25_rank"), first(("rrf_rank", "fused_rank"), "int").alias("rrf_rank")).where("id is not null")


def with_ranks(df: DataFrame, value: str, tie: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(value).desc(), tie)))
