"""Cases that the small tables do not hold, and forms that must not grow faster than their input."""

import random

import pytest
from pyspark.sql import functions as F

from gneiss.functions import lines
from gneiss.functions import text as T
from gneiss.operators import chunking, lexical
from gneiss.operators.dense import knn_blocks, ranks_of


@pytest.mark.parametrize(("text", "issues"), [("Ganas y ías", ["trailing_connector"]), ("On enréon", ["trailing_connector"]), ("Walk as", ["trailing_connector"]), ("Walk bias", []), ("Walk _as", [])])
def test_connector_after_accented_letter(spark, text, issues):
    assert spark.range(1).select(T.completeness(F.lit(text))["issues"].alias("i")).first().i == issues


def test_words_in_arrow_tasks(spark):
    """The same tokens as ``tokenize``, across texts, nulls and letters whose lower case is ASCII."""
    import pyarrow as pa

    texts = ["ends", "ab The cd", None, "", "3.5mg İx Kg É1a", "  z-9 "]
    doc, code, words = lexical.encoded(pa.array(["skipped", *texts]).slice(1))
    kept = [(d, w) for d, w in zip(doc.tolist(), [words[c].as_py() for c in code.tolist()], strict=True) if w != "the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.tokenize(F.col("t")).alias("w")).orderBy("i").collect()
    assert kept == [(r.i, w) for r in rows for w in r.w]


def test_no_posting_is_shuffled(spark):
    """Ranking takes one exchange, of what a task has among its best; texts and postings stay where they are."""
    chunks = spark.createDataFrame([(i, i, ("gait " if i in (4, 9) else "") + "pain scale sleep") for i in range(40)], "chunk_id long, corpus_pos long, text string")
    queries = spark.createDataFrame([(1, "gait pain"), (2, "scale")], "query_id int, query string")
    top = lexical.top_lexical(chunks, queries, 3)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Aggregate" not in plan
    assert [(r.query_id, r.chunk_id) for r in top.orderBy("query_id", "rank").collect()] == [(1, 4), (1, 9), (1, 0), (2, 4), (2, 9), (2, 0)]


def test_ranks_by_counting(spark):
    """Ranks of many targets, ties among them, equal those of the full order, without pairs of chunks and targets."""
    chunks = spark.createDataFrame([(f"c{i}", i, "gait " * (i % 4) + "pain " * (i % 3) + "x") for i in range(60)] + [("none", 60, None)], "chunk_id string, corpus_pos long, text string").repartition(5)
    queries = spark.createDataFrame([(1, "gait"), (2, "pain gait x"), (3, "absent")], "query_id int, query string")
    full = {(r.query_id, r.chunk_id): r["rank"] for r in lexical.top_lexical(chunks, queries, 1000).collect()}
    asked = [(q, f"c{i}") for q in (1, 2, 3) for i in range(0, 60, 4)] + [(2, "none"), (9, "c1")]
    ranked = lexical.ranks_of(chunks, queries, spark.createDataFrame(asked, "query_id int, chunk_id string"))
    assert {(r.query_id, r.chunk_id): r["rank"] for r in ranked.collect()} == {k: full[k] for k in asked if k in full}
    assert "Join" not in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_dense_ranks_of_many_targets(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "chunk_id long, vec array<double>")
    q = v.where("chunk_id % 9 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    full = {(r.query_id, r.chunk_id): r["rank"] for r in knn_blocks(v, q, 100, True, shards=3).collect()}
    targets = q.select("query_id").crossJoin(v.where("chunk_id % 2 = 0").select("chunk_id"))
    found = {(r.query_id, r.chunk_id): r["rank"] for r in ranks_of(v, q, targets, True, shards=3).collect()}
    assert found == {k: r for k, r in full.items() if k[1] % 2 == 0}


def test_holders(spark):
    chunks = spark.createDataFrame([(1, "before walk daily, rest. after"), (2, "walk daily, rests"), (3, "xwalk daily, rest"), (4, "Walk daily, rest"), (5, None), (6, "rest daily walk")], "chunk_id int, text string")
    passages = spark.createDataFrame([("a", "walk daily, rest"), ("b", "rest."), ("c", ""), ("d", None)], "query_id string, passage string")
    found = sorted((r.query_id, r.chunk_id) for r in lexical.holders(chunks, passages).collect())
    assert found == [("a", 1), ("a", 2), ("a", 3), ("b", 1), *[("c", i) for i in (1, 2, 3, 4, 6)]]


#: Parts of odd lines: white space of all kinds, ligatures, marks of layout, headings and prose.
PARTS = [*"aB9_-. ,;:Éñß()[]^`{~", *" " * 8, "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u200b", "\u202f", "\u3000", "ﬁ", "ﬂ", "\xad", "\u0301", "…", "\x7f", "İ", "K", "€"]
WORDS = ["table of contents", "1 ", "2.1 ", "3.2.1. ", "Scope of care", "Introduction", "KEY POINTS:", "M E T H O D S", "the", "were", "et al", " 2019", "Smith, J.", "doi", "PMID", "www.", "10.1234/x", "Page 7", "12", "..... 3", "Safety", "RESULTS AND MORE", "rest, ", "ISSN", "x" * 60]


def odd_lines(n):
    draw = random.Random(7)
    return [None, "", *("".join(draw.choice(draw.choice((PARTS, WORDS))) for _ in range(draw.randint(0, 12))) for _ in range(n)), *("\n".join(draw.choice((" 12", "1 a", "word", "x.", "Two b", "y ...... 4", "2.1 Long heading here")) for _ in range(draw.randint(6, 16))) for _ in range(200))]


def test_lines_in_arrow_tasks(spark):
    """Each Python form equals its column form on odd lines."""
    given = odd_lines(3000)
    t = F.col("t")
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select(
        "i", T.clean_line(t).alias("clean"), T.compare_key(t).alias("key"), T.squeeze(t).alias("squeezed"), T.clean_lines(t).alias("lines"), T.is_contents_page(t).alias("toc"), T.repair_word_per_line(t).alias("repaired"), T.classify_heading(t).alias("heading"), T.is_layout_line(t).alias("layout"), T.is_page_number(t).alias("number"), T.is_doi_or_url(t).alias("link")
    ).orderBy("i").collect()
    for r in rows:
        raw = given[r.i]
        text = raw or ""
        own, clean = lines.clean_lines(raw), lines.clean_line(text)
        joined = lines.repaired(own)
        assert (clean, lines.line_key(clean), lines.squeeze(text), own) == (r.clean, r.key, r.squeezed, r.lines)
        assert (lines.is_contents_page(text, own), joined is not None, raw if joined is None else joined) == (r.toc, r.repaired.repaired, r.repaired.text)
        assert (lines.is_layout_key(lines.line_key(clean)), lines.is_page_number(clean), lines.is_doi_or_url(clean)) == (r.layout, r.number, r.link)
        assert lines.heading(text) == (None if r.heading is None else r.heading.asDict()), repr(raw)
    assert {r.heading.kind for r in rows if r.heading} == {"numbered", "local", "common", "caps"} and any(r.toc for r in rows) and any(r.repaired.repaired for r in rows)


def test_lines_are_cleaned_once(spark):
    """The filter on cleaned lines does not clean each of them again as a column."""
    pages = spark.createDataFrame([("d", p, f"Running header line\nbody {p}\n\n\nwww.x.org\n7") for p in range(10)], "document string, page int, text string")
    found = chunking.page_lines(pages)
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.page, r.line_no, r.line) for r in found.collect()) == sorted((p, n, x) for p in range(10) for n, x in ((1, f"body {p}"), (2, "")))


def test_page_work_is_dealt_by_page(spark):
    """Only running sections and chunk numbers hold a document in one task; texts are judged between."""
    pages = spark.createDataFrame([("d", p, "1 Scope of the guideline\nSome text here." if p == 0 else f"Text of page {p}, which\nends on") for p in range(4)], "document string, page int, text string")
    found = chunking.chunk_pages(pages)
    assert "RepartitionByExpression [document" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.page, r.chunk_id, r.section, r.completeness_issues) for r in found.orderBy("chunk_id").collect()] == [
        (0, "d_chunk_0001", "1 Scope of the guideline", []), *[(p, f"d_chunk_{p + 1:04d}", "1 Scope of the guideline", ["trailing_connector"]) for p in (1, 2, 3)]
    ]
