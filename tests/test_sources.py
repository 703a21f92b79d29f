"""Readers, writers and streams on files in a temporary folder."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.sources import readers, sinks
from gneiss.streaming import tables


def chunk(i, text, **meta):
    return {"chunk_id": i, "text": text, "metadata": meta}


def put(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_chunk_corpus(spark, tmp_path):
    put(tmp_path / "a.json", {"chunks": [chunk(" x1 ", "one", page=3, section="s"), chunk("x2", ""), chunk("", "no id"), chunk("x3", "three")]})
    put(tmp_path / "b.json", [chunk("x1", "again"), chunk("x4", "four")])
    put(tmp_path / "_quality_report.json", {"chunks": [chunk("no", "no")]})
    rows = {r.chunk_id: r for r in readers.chunk_corpus(spark, str(tmp_path)).collect()}
    assert {k: r.text for k, r in rows.items()} == {"x1": "one", "x3": "three", "x4": "four"}
    meta = readers.chunk_corpus(spark, str(tmp_path)).select("chunk_id", readers.metadata_struct(F.col("metadata")).alias("m")).where("chunk_id = 'x1'").first().m
    assert (meta.page, meta.section, meta.title) == ("3", "s", "")
    assert tuple(readers.corpus_counts(spark, str(tmp_path)).first()) == (4, 0)
    put(tmp_path / "c.json", [chunk("x4", "four once more")])
    assert tuple(readers.corpus_counts(spark, str(tmp_path)).first()) == (4, 1)
    prior = {r.legacy_chunk_id: r.key for r in readers.prior_files(spark, str(tmp_path)).collect()}
    assert prior["x4"] == "four" and len(prior) == 3


def test_documents_from_mixed_folders(spark, tmp_path):
    def fake_pdf(content):
        if content == b"broken":
            raise ValueError("no pages")
        return [{"page": 1, "text": content.decode(), "width": 600.0, "height": 800.0, "blocks": [{"text": "b", "bbox": [0.0, 1.0, 2.0, 3.0], "spans": [{"size": 9.0, "bold": True}]}], "tables": [{"bbox": None, "rows": [["a", "b"]]}], "images": 2}]

    pages = [{"page": 1, "text": "from json", "tables": [{"rows": [["x"]]}], "images": [{}, {}]}, {"page": 2, "text": "second"}]
    (tmp_path / "deep" / "er").mkdir(parents=True)
    put(tmp_path / "deep" / "a.json", {"document": "a.json", "pages": pages})
    put(tmp_path / "bad.json", {"document": "bad.json"})
    (tmp_path / "deep" / "er" / "p.pdf").write_bytes(b"from pdf")
    (tmp_path / "broken.pdf").write_bytes(b"broken")
    (tmp_path / "note.txt").write_text("ignored")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/q.json", json.dumps({"pages": pages[:1]}))
        z.writestr("r.pdf", b"pdf in zip")
    got = {r.document: r for r in readers.parsed_totals(readers.documents_from(spark, str(tmp_path), fake_pdf)).collect()}
    assert {k: (r.page_count, r.table_count, r.image_count, r.reason) for k, r in got.items()} == {
        "a.json": (2, 1, 2, None), "bad.json": (0, 0, 0, "ValueError: no list of pages"), "p.pdf": (1, 1, 2, None), "broken.pdf": (0, 0, 0, "ValueError: no pages"),
        "q.json": (1, 1, 2, None), "r.pdf": (1, 1, 2, None),
    }
    assert readers.pdf_pages(spark, str(tmp_path), lambda c: [(7, c.decode())]).where("document = 'p.pdf'").first().text == "from pdf"
    with pytest.raises(ValueError):
        readers.documents_from(spark, str(tmp_path / "note.txt"))
    good, rejected = readers.extracted(spark, str(tmp_path / "deep" / "a.json"))
    assert readers.extracted_counts(good).first()[1:] == (2, 1, 2) and rejected.count() == 0
    assert [tuple(r) for r in readers.tables_of(good).select("page", "rows").collect()] == [(1, [["x"]])]
    assert [r.text for r in readers.pages_of(good).collect()] == ["from json", "second"]


def test_glossary_manifest_and_benchmark(spark, tmp_path):
    put(tmp_path / "g.json", {"bel ağrısı": ["low back pain"], "denge": ["balance", "stability"]})
    assert [(r.term, r.equivalents, r.term_pos) for r in readers.glossary(spark, str(tmp_path / "g.json")).collect()] == [("bel ağrısı", ["low back pain"], 0), ("denge", ["balance", "stability"], 1)]
    (tmp_path / "m.csv").write_text("Dosya Adı,Doc-Family,Year\nA guide.json,who,2020\nb.json,NICE,n/a\n,NICE,2\n", encoding="utf-8")
    got = [tuple(r)[:4] for r in readers.manifest(spark, str(tmp_path / "m.csv")).orderBy("pos").collect()]
    assert got == [("aguidejson", "WHO", "World Health Organization", 2020), ("bjson", "NICE", "NICE", None)]
    (tmp_path / "bad.csv").write_text("file,doc_family\nx,OTHER\n")
    with pytest.raises(Exception, match="unknown doc_family"):
        readers.manifest(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises(ValueError):
        (tmp_path / "none.csv").write_text("a,b\n1,2\n")
        readers.manifest(spark, str(tmp_path / "none.csv"))
    questions = [{"id": "1", "question": "q one", "gold_chunk_ids": ["a", " b "]}, {"query": "q two", "relevant_ids": "c; d|e"}, {"question_id": "z", "question": "q three", "gold_chunk_id": "f"}]
    put(tmp_path / "x_benchmark.json", {"questions": questions})
    q, gold = readers.benchmark(spark, str(tmp_path / "x_benchmark.json"), expected=3)
    assert [(r.query_id, r.query) for r in q.collect()] == [("1", "q one"), ("Q2", "q two"), ("z", "q three")]
    assert [tuple(r) for r in gold.collect()] == [("1", "a"), ("1", "b"), ("Q2", "c"), ("Q2", "d"), ("Q2", "e"), ("z", "f")]
    assert readers.benchmark(spark, str(tmp_path / "x_benchmark.json"), limit=2)[0].count() == 2
    with pytest.raises(ValueError):
        readers.benchmark(spark, str(tmp_path / "x_benchmark.json"), expected=4)
    assert readers.find_benchmark(["a.json", "x_benchmark.json", "benchmark_results.json"]) == "x_benchmark.json"
    with pytest.raises(ValueError):
        readers.find_benchmark(["a.json"])


def test_upsert_survives_a_failed_writer(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "chunk_id string, n int")
    assert sinks.current(spark, path) is None
    sinks.upsert(rows(("a", 1), ("b", 2)), path)
    sinks.upsert(rows(("b", 3), ("c", 4)), path)
    state = lambda: sorted((r.chunk_id, r.n) for r in sinks.read_current(spark, path).collect())
    assert state() == [("a", 1), ("b", 3), ("c", 4)]
    held = sinks.read_current(spark, path)  # a reader under way keeps its version over one more
    with pytest.raises(Exception, match="boom"):
        sinks.upsert(rows(("d", 5)).withColumn("n", F.raise_error(F.lit("boom")).cast("int")), path)
    assert state() == [("a", 1), ("b", 3), ("c", 4)]
    sinks.upsert(rows(("d", 5)), path)
    assert held.count() == 3 and len(state()) == 4
    sinks.reset(sinks.read_current(spark, path), path)
    assert state() == [] and sinks.read_current(spark, path).columns == ["chunk_id", "n"]


def test_index_build(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "one", 0), ("a", "other", 1), ("b", "two", 2), (None, "x", 3), ("c", " ", 4)], "chunk_id string, text string, corpus_pos int")
    embed = F.array(F.length("text").cast("double"), F.lit(1.0))
    assert sinks.build_index(chunks, embed, str(tmp_path / "i"), expected=2) == {"chunks": 5, "indexed": 2, "left_out": 2, "repeated": 1}
    assert {r.chunk_id: r.vec for r in sinks.read_current(spark, str(tmp_path / "i")).collect()} == {"a": [3.0, 1.0], "b": [3.0, 1.0]}
    with pytest.raises(ValueError):
        sinks.build_index(chunks, F.when(F.col("chunk_id") == "a", embed), str(tmp_path / "j"))


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("q1", 1.0), ("q2", 0.5)], "query_id string, mrr double")
    sinks.write_results(rows, str(tmp_path / "r"), config={"k": "60"})
    back = spark.read.option("header", True).csv(str(tmp_path / "r" / "csv"))
    assert back.count() == 2 and [c.strip("﻿") for c in back.columns] == ["query_id", "mrr"]
    assert b"\xef\xbb\xbf" in next((tmp_path / "r" / "csv").glob("part-*")).read_bytes()
    assert spark.read.json(str(tmp_path / "r" / "config")).first()[0]["k"] == "60" and spark.read.json(str(tmp_path / "r" / "json")).count() == 2
    sinks.append_log(rows.limit(1), str(tmp_path / "log"))
    sinks.append_log(rows.limit(1), str(tmp_path / "log"))
    sinks.progress_log(str(tmp_path / "p"))(spark, "embed", {"rows": 2})
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and spark.read.json(str(tmp_path / "p")).first().stage == "embed"
    sinks.write_chunks(rows.withColumn("document", F.col("query_id")), str(tmp_path / "c"))
    sinks.write_report(rows, str(tmp_path / "rep"))
    sinks.write_json(rows, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "c")).where("document = 'q1'").count() == 1 and spark.read.json(str(tmp_path / "rep")).count() == 2 == spark.read.json(str(tmp_path / "j")).count()
    documents = spark.createDataFrame([("a.json", [("one", 1)]), ("b.json", [(" ", 1)]), ("c.json", None)], "document string, pages array<struct<text: string, page: int>>")
    n, failed = sinks.chunk_files(documents, lambda d: d.select("document", F.explode("pages").alias("p")).select("document", "p.*"), str(tmp_path / "cf"))
    assert n == 1 and sorted(map(tuple, failed.collect())) == [("b.json", "no text"), ("c.json", "no list of pages")]


def test_upsert_stream_and_token_events(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "t")
    source.mkdir()
    (source / "a.json").write_text('{"chunk_id": "a", "text": "one"}\n{"chunk_id": "b", "text": "two"}\n')
    run = lambda: tables.upsert_stream(spark, str(source), "chunk_id string, text string", target, str(tmp_path / "ck")).awaitTermination()
    run()
    (source / "b.json").write_text('{"chunk_id": "b", "text": "new"}\n')
    run()
    assert {r.chunk_id: r.text for r in sinks.read_current(spark, target).collect()} == {"a": "one", "b": "new"}
    assert sorted(r.rows for r in spark.read.json(target + "_progress").collect()) == [1, 2]
    parts = spark.createDataFrame([(1, 0, 10, "", False), (1, 1, 30, "a", False), (1, 2, 40, "b", False), (1, 3, 55, "", True), (2, 0, 0, "", False), (2, 1, 9, "", True)], "request_id int, seq int, t_ms long, text string, done boolean")
    events = [(r.request_id, r.event, r.elapsed_ms) for r in tables.token_events(parts).orderBy("request_id", "seq").collect()]
    assert events == [(1, "first_token", 20), (1, "token", 30), (1, "done", 45), (2, "error", 9)]
    timing = tables.request_timing(parts).where("request_id = 1").first()
    assert (timing.ttft_ms, timing.generation_ms, timing.parts) == (20, 25, 2)


def test_small_text_functions(spark):
    one = spark.createDataFrame([("", None, "x", "a; b,c|", "A,b\nA")], "e string, n string, x string, l string, i string")
    got = one.select(T.pick(F.col("e"), F.col("n"), F.col("x")), T.as_list(F.col("l")), T.id_set(F.col("i")), T.display(F.col("n")), T.query_prompt(F.col("x"), "query: "), T.document_of(F.lit("doc_chunk_0003")), T.strip_prefix(F.lit("Section: a > b\nRecommendation: Do it"))).first()
    assert tuple(got) == ("x", ["a", "b", "c"], ["A", "b"], T.EMPTY_DISPLAY, "query: x", "doc", "Do it")
