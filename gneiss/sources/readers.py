"""Readers. All go through Spark's readers, so any store Spark reads will do."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.evidence import ORGANIZATIONS
from ..functions.text import as_list, compare_key, filename_key, pick

#: Metadata fields an index keeps.
METADATA = ("document_id", "title", "organization", "year", "domain", "condition", "population", "section", "subsection", "page", "source_type")
CHUNK = f"chunk_id string, text string, metadata struct<{', '.join(f'{f}: string' for f in METADATA)}>"
CHUNKS = "array<struct<chunk_id: string, text: string, metadata: struct<" + ", ".join(f"{f}: string" for f in METADATA) + ">>>"
#: Folded manifest headers with their usual names.
HEADERS = {"dosyaadi": "file", "dosya_adi": "file", "filename": "file", "file_name": "file", "document": "file", "document_name": "file", "family": "doc_family", "organization_name": "organization", "publisher": "organization"}


def metadata_struct(meta: Column) -> Column:
    """The kept fields, null as empty text."""
    return F.struct(*[F.coalesce(meta[f].cast("string"), F.lit("")).alias(f) for f in METADATA])


def listed_chunks(spark: SparkSession, path: str, strip_ids: bool = True) -> DataFrame:
    """file, pos, chunk_id, text, metadata from JSON files that hold ``{"chunks": [...]}`` or a list; rows without id or
    text go."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")).where(~F.col("file").endswith("_quality_report.json"))
    listed = F.from_json("value", CHUNKS)
    inner = F.from_json("value", f"struct<chunks: {CHUNKS}>")["chunks"]
    chunks = raw.select("file", F.posexplode(F.when(F.col("value").rlike(r"^\s*\["), listed).otherwise(inner)).alias("pos", "c")).select("file", "pos", (F.trim("c.chunk_id") if strip_ids else F.col("c.chunk_id")).alias("chunk_id"), F.col("c.text").alias("text"), F.col("c.metadata").alias("metadata"))
    return chunks.where((F.coalesce("chunk_id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))


def chunk_corpus(spark: SparkSession, path: str, strip_ids: bool = True) -> DataFrame:
    """chunk_id, text, metadata, corpus_pos of ``listed_chunks``; files in name order, of an id the first wins."""
    kept = listed_chunks(spark, path, strip_ids)
    first = kept.groupBy("chunk_id").agg(F.min(F.struct("file", "pos", "text", "metadata")).alias("c"))
    return first.select("chunk_id", "c.text", "c.metadata", F.struct("c.file", "c.pos").alias("corpus_pos"))


def corpus_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: unique chunks and skipped repeats of their ids; a path without files raises in the reader."""
    kept = listed_chunks(spark, path, strip_ids=False)
    return kept.agg(F.countDistinct("chunk_id").alias("chunks"), (F.count("*") - F.countDistinct("chunk_id")).alias("skipped_duplicates"))


PAGES = "document string, pages array<struct<page: int, text: string, tables: array<struct<table_index: int, rows: array<array<string>>>>, images: array<struct<image_index: int, xref: int>>>>"


def extracted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): extracted documents with their pages, and those without a list of pages."""
    docs = spark.read.schema(PAGES).option("multiLine", True).json(path)
    return docs.where("pages is not null"), docs.where("pages is null").select("document", F.lit("no list of pages").alias("reason"))


POSITIONED = (
    "document string, pages array<struct<page: int, width: double, height: double, text: string, "
    "blocks: array<struct<text: string, bbox: array<double>, spans: array<struct<size: double, font: string, flags: int, bold: boolean>>>>, "
    "tables: array<struct<bbox: array<double>, rows: array<array<string>>>>>>"
)


def positioned(spark: SparkSession, path: str) -> DataFrame:
    """Pages with blocks and tables as ``layout_chunks`` takes them, from extracted JSON. A span is bold by its own
    mark, by bit 16 of its flags, or by its font's name. Documents without a list of pages give no rows."""
    docs = spark.read.schema(POSITIONED).option("multiLine", True).json(path)
    p = docs.select("document", F.explode("pages").alias("p")).select("document", "p.*")

    def span(s):
        named = F.lower(F.coalesce(s["font"], F.lit(""))).rlike("bold|black|demi")
        marked = F.coalesce(s["flags"], F.lit(0)).bitwiseAND(F.lit(16)) != 0
        return F.struct(s["size"].alias("size"), (F.coalesce(s["bold"], F.lit(False)) | marked | named).alias("bold"))

    blocks = F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["bbox"].alias("bbox"), F.transform(b["spans"], span).alias("spans")))
    return p.withColumn("blocks", blocks)


def pages_of(documents: DataFrame) -> DataFrame:
    return documents.select("document", F.explode("pages").alias("p")).select("document", "p.page", "p.text")


def tables_of(documents: DataFrame) -> DataFrame:
    return documents.select("document", F.explode("pages").alias("p")).select("document", "p.page", F.explode("p.tables").alias("t")).select("document", "page", "t.table_index", "t.rows")


def extracted_counts(documents: DataFrame) -> DataFrame:
    count = lambda field: F.aggregate("pages", F.lit(0), lambda a, p: a + F.coalesce(F.size(p[field]), F.lit(0)))
    return documents.select("document", F.size("pages").alias("page_count"), count("tables").alias("table_count"), count("images").alias("image_count"))


PARSED = "document string, page int, text string, width double, height double, blocks array<struct<text: string, bbox: array<double>, spans: array<struct<size: double, bold: boolean>>>>, tables array<struct<bbox: array<double>, rows: array<array<string>>>>, images int, reason string"


def _parsed_rows(name: str, parse: Callable[[bytes], list[dict]], content: bytes) -> list[tuple]:
    """Rows of ``PARSED`` for one file; what ``parse`` rejects is one row with a reason."""
    try:
        pages = [{"page": p[0], "text": p[1]} if isinstance(p, tuple) else p for p in parse(content)]
        return [(name, p.get("page"), p.get("text"), p.get("width"), p.get("height"), p.get("blocks") or [], p.get("tables") or [], p.get("images") or 0, None) for p in pages]
    except Exception as e:  # noqa: BLE001  the reason is the result
        return [(name, None, None, None, None, [], [], 0, f"{type(e).__name__}: {e}")]


def pdf_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list]) -> DataFrame:
    """Pages of PDF files through ``parse``, since the image has no PDF library: bytes to a list of (page, text) or of
    dicts with page, text, width, height, blocks, tables and the number of images. Columns are those of ``PARSED``."""
    return _parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path), lambda name: parse)


def _parse_files(files: DataFrame, parser_of: Callable[[str], Callable | None]) -> DataFrame:
    def members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
        import io
        import zipfile

        if not name.lower().endswith(".zip"):
            yield name, content
            return
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for inner in sorted(z.namelist()):
                yield inner, z.read(inner)

    def json_pages(content: bytes) -> list[dict]:
        d = json.loads(content)
        if not isinstance(d.get("pages"), list):
            raise ValueError("no list of pages")
        return [p | {"tables": [{"bbox": t.get("bbox"), "rows": t.get("rows")} for t in p.get("tables") or []], "images": len(p.get("images") or []), "blocks": [{"text": b.get("text"), "bbox": b.get("bbox"), "spans": [{"size": s.get("size"), "bold": s.get("bold")} for s in b.get("spans") or []]} for b in p.get("blocks") or []]} for p in d["pages"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, data in members(path, content.as_py()):
                    parse = json_pages if name.lower().endswith(".json") else parser_of(name)
                    if parse:
                        rows = _parsed_rows(name.rsplit("/", 1)[-1], parse, data)
                        yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in rows], schema=TYPES)

    return files.select("path", "content").mapInArrow(run, PARSED)


NAMES = [c.split()[0] for c in ("document", "page", "text", "width", "height", "blocks", "tables", "images", "reason")]
_BOX = pa.list_(pa.float64())
TYPES = pa.schema({
    "document": pa.string(), "page": pa.int32(), "text": pa.string(), "width": pa.float64(), "height": pa.float64(),
    "blocks": pa.list_(pa.struct({"text": pa.string(), "bbox": _BOX, "spans": pa.list_(pa.struct({"size": pa.float64(), "bold": pa.bool_()}))})),
    "tables": pa.list_(pa.struct({"bbox": _BOX, "rows": pa.list_(pa.list_(pa.string()))})), "images": pa.int32(), "reason": pa.string(),
})


def documents_from(spark: SparkSession, path: str, parse_pdf: Callable | None = None) -> DataFrame:
    """Pages (``PARSED``) of a file or folder, by kind of file: .json, .pdf (with a parser) and .zip with members of
    either kind; folders are read at any depth and may be mixed. Another single file raises ValueError."""
    name = path.rsplit("/", 1)[-1]
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else None
    if kind not in (None, "json", "zip") and not (kind == "pdf" and parse_pdf):
        raise ValueError(f"no reader for {path}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return _parse_files(files.where(F.lower("path").rlike(r"\.(json|pdf|zip)$")), lambda n: parse_pdf if n.lower().endswith(".pdf") else None)


def parsed_totals(pages: DataFrame) -> DataFrame:
    """Per document: pages, tables, images, characters; and the reason where it was rejected."""
    return pages.groupBy("document").agg(F.count("page").alias("page_count"), F.sum(F.size("tables")).alias("table_count"), F.sum("images").alias("image_count"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.max("reason").alias("reason"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """term, equivalents, term_pos from a JSON object of lists."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return text.select(F.posexplode(F.map_entries("m")).alias("term_pos", "e")).select(F.col("e.key").alias("term"), F.col("e.value").alias("equivalents"), "term_pos")


def fold_header(name: str) -> str:
    plain = name.strip().lower().replace("﻿", "").replace(" ", "_").replace("-", "_").translate(str.maketrans("ışğüöç", "isguoc"))
    return HEADERS.get(plain, plain)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """key, doc_family, organization, year, pos. Missing columns and unknown families raise; a year that is no number is null."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = [fold_header(c) for c in raw.columns]
    if not {"file", "doc_family"} <= set(names):
        raise ValueError("a manifest needs a file name and a doc_family column")
    raw = raw.toDF(*names).withColumn("pos", F.monotonically_increasing_id())
    family = F.upper(F.trim("doc_family"))
    known = F.when(family.isin(*ORGANIZATIONS), family).otherwise(F.raise_error(F.concat(F.lit("unknown doc_family "), family)))
    usual = F.create_map(*[x for k, v in ORGANIZATIONS.items() if v for x in (F.lit(k), F.lit(v))])
    own = F.nullif(F.trim("organization"), F.lit("")) if "organization" in names else F.lit(None).cast("string")
    year = F.when(F.trim("year").rlike(r"^\d+$"), F.trim("year").try_cast("int")) if "year" in names else F.lit(None).cast("int")
    return raw.where(F.trim("file") != "").select(filename_key(F.col("file")).alias("key"), known.alias("doc_family"), F.coalesce(own, F.try_element_at(usual, family)).alias("organization"), year.alias("year"), "pos")


def benchmark(spark: SparkSession, path: str, expected: int | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions, gold) from a JSON list or ``{"questions": [...]}``: alternative field names, gold as a list or
    delimited text, ids ``Q1``... by default. Empty questions, repeated ids and an unexpected count raise."""
    item = "struct<id: string, question_id: string, category: string, question: string, query: string, answer: string, source: string, gold_chunk_ids: string, gold_chunk_id: string, relevant_ids: string>"
    text = spark.read.text(path, wholetext=True)
    rows = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", f"array<{item}>")).otherwise(F.from_json("value", f"struct<questions: array<{item}>>")["questions"])
    q = text.select(F.posexplode(rows).alias("pos", "q")).select("pos", "q.*")
    raw = pick(F.col("gold_chunk_ids"), F.col("relevant_ids"), F.col("gold_chunk_id"))
    parsed = F.coalesce(F.transform(F.from_json(raw, "array<string>"), lambda x: F.trim(x)), as_list(raw))
    q = q.select("pos", F.coalesce(pick(F.col("id"), F.col("question_id")), F.concat(F.lit("Q"), F.col("pos") + 1)).alias("query_id"), "category", pick(F.col("question"), F.col("query")).alias("query"), "answer", "source", F.filter(parsed, lambda x: x != "").alias("gold_chunk_ids"))
    n, ids, blank = q.agg(F.count("*"), F.countDistinct("query_id"), F.count_if(F.col("query").isNull())).first()
    if blank or ids != n or expected not in (None, n):
        raise ValueError(f"benchmark has {n} questions, {ids} ids, {blank} empty questions")
    q = q if limit is None else q.where(F.col("pos") < limit)
    q = q.drop("pos")
    return q, q.select("query_id", F.explode("gold_chunk_ids").alias("chunk_id"))


def find_benchmark(names: list[str]) -> str:
    """The one JSON file that is named a benchmark and no result."""
    hits = [n for n in names if n.endswith(".json") and "benchmark" in n.lower() and "results" not in n.lower()]
    if len(hits) != 1:
        raise ValueError(f"one benchmark file is needed, found {hits}")
    return hits[0]


def prior_ids(chunks: DataFrame) -> DataFrame:
    """Numbered prior ids by key, for ``report.consume_ids``."""
    w = Window.partitionBy("document", "page", "key", "chunk_type").orderBy("corpus_pos")
    return chunks.withColumn("n", F.row_number().over(w))


def prior_files(spark: SparkSession, path: str) -> DataFrame:
    """Prior ids of earlier chunk files under ``path`` (any depth), in file and list order: key of the text, id, order.
    Ids that a file repeats count once, at their first place."""
    found = listed_chunks(spark, path)
    first = found.groupBy("chunk_id").agg(F.min(F.struct("file", "pos", "text")).alias("c"))
    return first.select(compare_key(F.col("c.text")).alias("key"), F.col("chunk_id").alias("legacy_chunk_id"), F.struct("c.file", "c.pos").alias("prior_pos"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, vec, norm of a vector table."""
    v = spark.read.parquet(path).select("chunk_id", F.col("vec").cast("array<double>").alias("vec"))
    return v.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))


# -- the driver's tables as stand-ins --------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as chunks: chunk_id, corpus_pos, text, document_id, lang."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("corpus_pos"), "text", F.col("source").alias("document_id"), "lang")


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
