"""Queries that run the smaller operators on the driver's tables, each beside its DuckDB SQL.

``events`` stands in for ordered items of a document (user_id, event_id), ``part`` and ``orders`` for
tables and boxes. The SQL is written from the definitions and shares no list or expression with the code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as G
from ..functions import text as T
from ..operators import chunking, context, evaluation, fusion, report
from ..sources.readers import benchmark_queries, document_chunks, metadata_struct, prior_ids, stored_vectors, table
from .models import compare, embedder, rewriter, scorer, token_counter

REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def sql(text: str):
    def register(query):
        REGISTERED[query.__name__] = (query, text)
        return query

    return register


# -- ids, links, copies ----------------------------------------------------------------------------


@sql("select doc_id, printf('%s_chunk_%04d', source, row_number() over (partition by source order by doc_id)) as chunk_id from documents")
def sequence_chunk_ids(spark, d):
    return report.sequence_ids(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"]).select("doc_id", "chunk_id")


@sql("select doc_id, row_number() over (partition by source, lang order by doc_id) - 1 as occurrence from documents")
def occurrence_numbers(spark, d):
    return report.occurrences(table(spark, d, "documents"), ["source", "lang"], "doc_id").select("doc_id", F.col("occurrence").cast("long"))


@sql("select min(event_id) as event_id, count(*) as duplicate_count, coalesce(array_to_string(list(event_id order by event_id)[2:], ','), '') as later from events group by user_id, event_type")
def collapsed_copies(spark, d):
    found = report.collapse(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id", "event_id")
    return found.select("event_id", F.col("duplicate_count").cast("long"), F.array_join(F.col("duplicate_locations").cast("array<string>"), ",").alias("later"))


@sql("select user_id, event_type, n, rank from (select *, row_number() over (partition by user_id order by n desc, first) as rank from (select user_id, event_type, count(*) as n, min(event_id) as first from events group by 1, 2)) where rank <= 2")
def top_event_types(spark, d):
    return report.top_values(table(spark, d, "events"), "user_id", "event_type", "event_id", 2).select("user_id", "event_type", "n", "rank")


_WORDS = r"list_filter(string_split(trim(regexp_replace(lower(translate(text, '-', ' ')), '[^\p{L}\p{N}_\p{M}]+', ' ', 'g')), ' '), lambda x: x != '')"


@sql(f"with w as (select source as document, doc_id, unnest({_WORDS}) as word from documents), lost as (select distinct document, word from w except select distinct document, word from w where doc_id % 2 = 0) select document, word from (select *, row_number() over (partition by document order by word) as n from lost) where n <= 100")
def word_gap(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("document"), "doc_id", F.translate("text", "-", " ").alias("text"))
    return report.word_gap(docs, docs.where("doc_id % 2 = 0")).select("document", "word")


@sql("select source, lang, 'old_' || doc_id as legacy_chunk_id, row_number() over (partition by source, lang order by doc_id) as n from documents")
def prior_id_numbers(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("document"), F.lit(1).alias("page"), F.col("lang").alias("key"), F.lit("text").alias("chunk_type"), F.col("doc_id").alias("corpus_pos"))
    return prior_ids(rows).select(F.col("document").alias("source"), F.col("key").alias("lang"), F.concat(F.lit("old_"), "corpus_pos").alias("legacy_chunk_id"), "n")


# -- sections, order, boxes ------------------------------------------------------------------------

_LINES = "case event_id % 5 when 1 then (1 + event_id % 9) || ' Scope of guidance' when 3 then (1 + event_id % 9) || '.' || (1 + event_id % 4) || ' Target group here' else 'plain words of a line.' end"


@sql(
    f"with l as (select user_id, event_id, {_LINES} as line, case event_id % 5 when 1 then 1 when 3 then 2 end as level from events), "
    "s as (select *, last_value(case when level = 1 then line end ignore nulls) over w as section, sum((level = 1)::int) over w as run from l window w as (partition by user_id order by event_id rows between unbounded preceding and current row)) "
    "select event_id, section, last_value(case when level = 2 then line end ignore nulls) over (partition by user_id, coalesce(run, 0) order by event_id rows between unbounded preceding and current row) as subsection, last_value(case when level is not null then line end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as local_heading from s"
)
def section_carry_forward(spark, d):
    number = F.col("event_id") % 9 + 1
    line = F.when(F.col("event_id") % 5 == 1, F.concat(number, F.lit(" Scope of guidance"))).when(F.col("event_id") % 5 == 3, F.concat(number, F.lit("."), F.col("event_id") % 4 + 1, F.lit(" Target group here"))).otherwise("plain words of a line.")
    lines = table(spark, d, "events").select(F.col("user_id").alias("document"), F.lit(1).alias("page"), F.col("event_id").alias("line_no"), line.alias("line"), F.lit(False).alias("is_toc"))
    return chunking.with_sections(lines).select(F.col("line_no").alias("event_id"), "section", "subsection", "local_heading")


@sql(
    "with e as (select *, 1 + event_id % 4 as level from events), "
    + ", ".join(f"p{k} as (select event_id, last_value(case when level = {k} then event_id end ignore nulls) over w as at, max(case when level < {k} then event_id end) over w as reset from e window w as (partition by user_id order by event_id rows between unbounded preceding and current row))" for k in (1, 2, 3, 4))
    + " select event_id, concat_ws(' > ', " + ", ".join(f"case when p{k}.at > coalesce(p{k}.reset, -1) then 'h' || p{k}.at end" for k in (1, 2, 3, 4)) + ") as path from p1 join p2 using (event_id) join p3 using (event_id) join p4 using (event_id)"
)
def section_paths(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("document"), F.col("event_id").alias("event_pos"), F.concat(F.lit("h"), "event_id").alias("heading_text"), (F.col("event_id") % 4 + 1).alias("heading_level"))
    return chunking.section_paths(e).select(F.col("event_pos").alias("event_id"), F.array_join("section_path", " > ").alias("path"))


_BOXES = "select user_id as document, event_id as block, (event_id * 37 % 500)::double as x0, (event_id * 91 % 700)::double as y0, case event_id % 7 when 0 then 400.0 else 60.0 end::double as w from events"


@sql(
    f"with b as ({_BOXES}), s as (select *, w >= 0.58::double * 600 as wide, (select count(*) from b o where o.document = b.document and o.w >= 0.58::double * 600 and o.y0 * 1000 <= b.y0 * 1000 - 501) as band from b) "
    "select block, row_number() over (partition by document order by band, case when wide then 2 when x0 + w / 2 < 300 then 0 else 1 end, y0, x0, block) as reading_pos from s"
)
def reading_order(spark, d):
    e = table(spark, d, "events")
    x0, y0, w = (F.col("event_id") * 37 % 500).cast("double"), (F.col("event_id") * 91 % 700).cast("double"), F.when(F.col("event_id") % 7 == 0, 400.0).otherwise(60.0)
    blocks = e.select(F.col("user_id").alias("document"), F.lit(1).alias("page"), F.col("event_id").alias("block_no"), x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + 10).alias("y1"), F.lit(600.0).alias("width"))
    return chunking.reading_order(blocks).select(F.col("block_no").alias("block"), "reading_pos")


@sql(f"with b as ({_BOXES}), t as (select s_suppkey % 50 as document, (s_suppkey * 53 % 400)::double as x0, (s_suppkey * 17 % 500)::double as y0 from supplier) select block from b where not exists (select 1 from t where t.document = b.document and b.x0 >= t.x0 - 2 and b.y0 >= t.y0 - 2 and b.x0 + b.w <= t.x0 + 182 and b.y0 + 10 <= t.y0 + 122)")
def outside_tables(spark, d):
    x0, y0, w = (F.col("event_id") * 37 % 500).cast("double"), (F.col("event_id") * 91 % 700).cast("double"), F.when(F.col("event_id") % 7 == 0, 400.0).otherwise(60.0)
    blocks = table(spark, d, "events").select(F.col("user_id").alias("document"), F.lit(1).alias("page"), F.col("event_id").alias("block"), x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + 10).alias("y1"))
    tx, ty = (F.col("s_suppkey") * 53 % 400).cast("double"), (F.col("s_suppkey") * 17 % 500).cast("double")
    tables = table(spark, d, "supplier").select((F.col("s_suppkey") % 50).alias("document"), F.lit(1).alias("page"), tx.alias("x0"), ty.alias("y0"), (tx + 180).alias("x1"), (ty + 120).alias("y1"))
    return chunking.outside_tables(blocks, tables).select("block")


@sql("select user_id as document, event_id % 3 as block_no, median(value) filter (value > 0) as size, avg((event_type = 'click')::int) >= 0.55 as is_bold, false as is_upper from events group by 1, 2")
def font_features(spark, d):
    spans = table(spark, d, "events").select(F.col("user_id").alias("document"), F.lit(1).alias("page"), (F.col("event_id") % 3).alias("block_no"), F.col("event_type").alias("text"), F.col("value").alias("size"), (F.col("event_type") == "click").alias("bold"))
    return chunking.font_features(spans).select("document", "block_no", "size", "is_bold", "is_upper")


@sql("select event_id, (event_id * 91 % 700) < 0.14::double * 700 or (event_id * 91 % 700) + 10 > (1 - 0.14::double) * 700 as at_edge from events")
def edge_blocks(spark, d):
    y0 = (F.col("event_id") * 91 % 700).cast("double")
    return table(spark, d, "events").select("event_id", chunking.is_edge_block(y0, y0 + 10, F.lit(700.0)).alias("at_edge"))


# -- tables ----------------------------------------------------------------------------------------

_ROWS = "select p_size, list([p_brand, p_name, case when p_partkey % 3 = 0 then '' else p_type end] order by p_partkey) as r from part where p_partkey < 600 group by 1"


def _part_rows(spark, d):
    p = table(spark, d, "part").where("p_partkey < 600")
    cells = F.struct("p_partkey", F.array("p_brand", "p_name", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type"))).alias("c"))
    return p.groupBy("p_size").agg(F.transform(F.array_sort(F.collect_list(cells)), lambda x: x["c"]).alias("r"))


@sql(f"with t as ({_ROWS}) select p_size, array_to_string(list_transform(r, lambda x: array_to_string(x, ' | ')), chr(10)) as text, true as ok, 'validated' as reason from t")
def table_texts(spark, d):
    check = T.table_check(F.col("r"))
    return _part_rows(spark, d).select("p_size", T.table_text(F.col("r")).alias("text"), check["ok"].alias("ok"), check["reason"].alias("reason"))


@sql(
    f"with recursive t as ({_ROWS}), l as (select p_size, list_transform(r, lambda x: array_to_string(x, ' | ')) as lines from t), "
    "f as (select p_size, lines, 2 as i, 0 as piece, lines[1] as cur, null::varchar as done from l union all "
    "select p_size, lines, i + 1, case when length(cur || chr(10) || lines[i]) <= 160 or cur = lines[1] then piece else piece + 1 end, case when length(cur || chr(10) || lines[i]) <= 160 or cur = lines[1] then cur || chr(10) || lines[i] else lines[1] || chr(10) || lines[i] end, null from f where i <= len(lines)) "
    "select p_size, piece, arg_max(cur, i) as text from f group by p_size, piece"
)
def split_tables(spark, d):
    return _part_rows(spark, d).select("p_size", F.posexplode(chunking.split_rows(F.col("r"), 160)).alias("piece", "text"))


# -- terminology -----------------------------------------------------------------------------------

#: A made-up glossary over the words of the test tables.
GLOSSARY = (("the", ["definite article"]), ("of the", ["genitive", "definite article"]), ("that thes", ["relative"]), ("on", ["preposition", "genitive"]), ("für", ["purpose"]))
_SUFFIXES = (
    "lerindeki|larındaki|lerimiz|larımız|leriniz|larınız|lerdir|lardır|lerinin|larının|lerine|larına|lerini|larını|lerden|lardan|lerle|larla|lerin|ların|ler|lar|"
    "daki|deki|taki|teki|dan|den|tan|ten|dır|dir|dur|dür|tır|tir|tur|tür|nin|nın|nun|nün|nde|nda|yi|yı|yu|yü|ye|ya|ni|nı|nu|nü|ne|na|in|ın|un|ün|im|ım|um|üm|i|ı|u|ü|e|a"
)


def _norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower(translate(coalesce({x}, ''), 'İI’', 'iı''')), '\s+', ' ', 'g'))"


def _stems_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all({_norm_sql(x)}, '[a-zçğıöşü0-9]+'), lambda w: case when length(w) <= 5 then w else regexp_replace(w, '^(.{{4,}}?)(?:{_SUFFIXES})$', '\\1') end)"


_TERMS_SQL = (
    "with g as (select * from (values ('the', ['definite article'], 0), ('of the', ['genitive', 'definite article'], 1), ('that thes', ['relative'], 2), ('on', ['preposition', 'genitive'], 3), ('für', ['purpose'], 4)) g(term, equivalents, pos)), "
    f"q as (select item_id as query_id, text, {_norm_sql('text')} as n, {_stems_sql('text')} as s from benchmark), gs as (select *, {_stems_sql('term')} as t from g), "
    "hits as (select query_id, term, equivalents, pos from q, gs where regexp_matches(n, '(^|[^a-zçğıöşü0-9])' || term || '($|[^a-zçğıöşü0-9])') or len(list_filter(range(1, len(s) + 1), lambda i: s[i:i + len(t) - 1] = t)) > 0 or (len(t) = 2 and list_contains(s, t[1]) and list_contains(s, t[2]))), "
    "h as (select query_id, list(term order by length(term) desc, pos) as terms, list(equivalents order by length(term) desc, pos) as lists from hits group by 1), "
    "a as (select q.query_id, text, coalesce(terms, []) as terms, coalesce(list_filter(flatten(lists), lambda x, i: list_position(flatten(lists), x) = i), []) as added from q left join h using (query_id)) "
)


def _glossary(spark):
    return spark.createDataFrame([(t, e, i) for i, (t, e) in enumerate(GLOSSARY)], "term string, equivalents array<string>, term_pos int")


@sql(_TERMS_SQL + "select query_id, array_to_string(terms, ',') as terms, array_to_string(added, ',') as added from a")
def terminology_exact_match(spark, d):
    found = G.find_terms(benchmark_queries(spark, d), _glossary(spark))
    return found.select("query_id", F.array_join("matched_terms", ",").alias("terms"), F.array_join("added_terms", ",").alias("added"))


@sql(_TERMS_SQL + "select query_id, text as original_query, trim(text) as rewritten_query, concat_ws(' ', trim(text), nullif(array_to_string(added, ' '), '')) as expanded_query from a")
def processed_queries(spark, d):
    return G.process_queries(benchmark_queries(spark, d), _glossary(spark)).select("query_id", "original_query", "rewritten_query", "expanded_query")


@sql(_TERMS_SQL + "select q.query_id, coalesce(string_agg('- ' || term || ' => ' || array_to_string(equivalents, ', '), chr(10) order by length(term) desc, pos), '') as glossary from q left join hits using (query_id) group by 1")
def glossary_prompts(spark, d):
    return G.glossary_lines(G.find_terms(benchmark_queries(spark, d), _glossary(spark)))


@sql(f"select item_id as query_id, array_to_string({_stems_sql('text')}, ' ') as stems from benchmark")
def stemmed_queries(spark, d):
    return benchmark_queries(spark, d).select("query_id", F.array_join(G.stems(F.col("query")), " ").alias("stems"))


@sql(
    "with r as (select item_id as query_id, case when item_id % 2 = 0 then 'the article' else 'genitive case' end as t from benchmark) "
    "select query_id, case when t = 'the article' then 'the article definite article genitive' else 'genitive case definite article' end as restored from r"
)
def restored_anchors(spark, d):
    lists = F.array(F.array(F.lit("definite article")), F.array(F.lit("genitive"), F.lit("possessive")))
    rewritten = F.when(F.col("query_id") % 2 == 0, "the article").otherwise("genitive case")
    return benchmark_queries(spark, d).select("query_id", G.restore_anchors(rewritten, lists).alias("restored"))


# -- answers ---------------------------------------------------------------------------------------

_ANSWERS = (
    "select conv_id, turn, turn % 3 as n, case when conv_id % 11 = 0 then 'ilaç dozu nedir' else 'How far?' end as q, 'Walk daily. [SOURCE ' || (1 + conv_id % 3) || ']' as a, "
    "case when conv_id % 5 = 0 then 'Her gün yürüyün.' else 'Her gün yürüyün. [SOURCE ' || (1 + conv_id % 3) || ']' end as t from conversations"
)
_STATES = f"select *, case when q like 'ilaç%' then 'out_of_scope' when n = 0 or 1 + conv_id % 3 > n then 'insufficient' when conv_id % 5 = 0 then 'untranslated' else 'grounded' end as state from ({_ANSWERS})"


def _states(spark, d):
    c, number = table(spark, d, "conversations"), F.concat(F.lit("[SOURCE "), F.col("conv_id") % 3 + 1, F.lit("]"))
    query = F.when(F.col("conv_id") % 11 == 0, "ilaç dozu nedir").otherwise("How far?")
    answer = F.concat(F.lit("Walk daily. "), number)
    translated = F.when(F.col("conv_id") % 5 == 0, "Her gün yürüyün.").otherwise(F.concat(F.lit("Her gün yürüyün. "), number))
    return c.select("conv_id", "turn", context.answer_state(query, F.col("turn") % 3, answer, translated).alias("s")).select("conv_id", "turn", "s.*")


@sql(f"select conv_id, turn, state, case state when 'out_of_scope' then 'out_of_scope' when 'insufficient' then 'insufficient_evidence' when 'untranslated' then a else t end as answer from ({_STATES})")
def answer_states(spark, d):
    return _states(spark, d)


@sql(f"select count(*) as answers, count(*) filter (state = 'grounded') as grounded, count(*) filter (state = 'insufficient') as insufficient, count(*) filter (state = 'out_of_scope') as out_of_scope, count(*) filter (state = 'untranslated') as untranslated from ({_STATES})")
def answer_flags(spark, d):
    return context.flag_summary(_states(spark, d))


@sql("select item_id as query_id, 'Answer only from the sources and cite them as [SOURCE n].' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Sources:' || chr(10) || 'none' as prompt from benchmark")
def answer_prompts(spark, d):
    return benchmark_queries(spark, d).select("query_id", context.english_prompt(F.col("query"), F.lit("none")).alias("prompt"))


@sql("select item_id as query_id, v as variant, text || ' ' || v as answer from benchmark, (values ('a'), ('b')) x(v)")
def compared_variants(spark, d):
    variants = spark.createDataFrame([("a",), ("b",)], "variant string")
    return compare(benchmark_queries(spark, d), variants, F.concat_ws(" ", "query", "variant")).select("query_id", "variant", "answer")


@sql("with t as (select user_id as request_id, event_id as seq, event_id * 3 as t_ms, event_type != 'error' as has, event_id = max(event_id) over (partition by user_id) as done from events), r as (select *, first_value(t_ms) over w as start, sum(has::int) over w as n from t window w as (partition by request_id order by seq rows between unbounded preceding and current row)), e as (select *, case when done and n = 0 then 'error' when done then 'done' when has and n = 1 then 'first_token' when has then 'token' end as event from r) select request_id, seq, event, t_ms - start as elapsed_ms from e where event is not null")
def token_events(spark, d):
    from ..streaming.tables import token_events as events_of

    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("event_id").alias("last"))
    parts = e.join(last, "user_id").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 3).alias("t_ms"), F.when(F.col("event_type") != "error", "x").otherwise("").alias("text"), (F.col("event_id") == F.col("last")).alias("done"))
    return events_of(parts)


# -- columns and models ----------------------------------------------------------------------------


@sql("select doc_id, coalesce(nullif(lang, ''), source) as picked, coalesce(nullif(lang, ''), 'belirtilmemiş') as shown, lang || '/' || source as listed, case when lang = source then lang else lang || '/' || source end as ids, source as document, 'query: ' || lang as prompt, printf('%.2f', doc_id / 7.0::double) as score, 'Do it' as stripped from documents")
def field_helpers(spark, d):
    joined = F.concat(F.lit(" "), "lang", F.lit(" ;,| "), "source", F.lit("|"))
    return table(spark, d, "documents").select(
        "doc_id", T.pick(F.col("lang"), F.col("source")).alias("picked"), T.display(F.col("lang")).alias("shown"), F.array_join(T.as_list(joined), "/").alias("listed"),
        F.array_join(T.id_set(F.concat_ws(",", "lang", "source", "lang")), "/").alias("ids"), T.document_of(F.concat("source", F.lit("_chunk_0001"))).alias("document"), T.query_prompt(F.col("lang"), "query: ").alias("prompt"),
        report.format_score(F.col("doc_id") / 7.0, 2).alias("score"), T.strip_prefix(F.lit("Section: a\nRecommendation: Do it")).alias("stripped"),
    )


@sql("select doc_id, source as document_id, '' as title, lang as section, n_chars::varchar as page from documents")
def kept_metadata(spark, d):
    none = F.lit(None).cast("string")
    given = {"document_id": F.col("source"), "section": F.col("lang"), "page": F.col("n_chars")}
    from ..sources.readers import METADATA

    meta = F.struct(*[given.get(c, none).alias(c) for c in METADATA])
    return table(spark, d, "documents").select("doc_id", metadata_struct(meta).alias("m")).select("doc_id", "m.document_id", "m.title", "m.section", "m.page")


@sql("select vec_id as chunk_id, label from embeddings semi join benchmark on vec_id = item_id where embedding is not null")
def vector_lookup(spark, d):
    from ..operators.dense import lookup

    return lookup(stored_vectors(spark, d), benchmark_queries(spark, d).select(F.col("query_id").alias("chunk_id"))).select("chunk_id", "label")


@sql("select item_id as query_id, length(text) as width, length(text) + 2 as rewritten, len(string_split(text, ' ')) as tokens, (length(text) - length('passage'))::double as score from benchmark")
def model_hooks(spark, d):
    """An embedder, a rewriter, a token counter and a scorer made of plain functions."""
    embed = embedder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    rewrite = rewriter(lambda: lambda texts: [t + " !" for t in texts])
    count = token_counter(lambda: lambda texts: [len(t.split(" ")) for t in texts])
    score = scorer(lambda: lambda q, t: [float(len(a) - len(b)) for a, b in zip(q, t, strict=True)])
    return benchmark_queries(spark, d).select("query_id", F.get(embed("query"), F.lit(0)).cast("int").alias("width"), F.length(rewrite("query")).alias("rewritten"), count("query").alias("tokens"), score("query", F.lit("passage")).alias("score"))


# -- evaluation ------------------------------------------------------------------------------------


@sql("with r as (select item_id as query_id, doc_id as chunk_id, row_number() over (partition by item_id order by (doc_id * 31 + item_id) % 97, doc_id) as rank from benchmark, documents where doc_id < 60), g as (select item_id as query_id, item_id as chunk_id from benchmark where item_id < 60) select query_id, 'one' as method, (rank <= 1)::int::double as hit_at_1, (rank <= 10)::int::double as recall_at_10, round(1.0 / rank, 9) as mrr, rank as first_rank from r join g using (query_id, chunk_id)")
def single_gold_metrics(spark, d):
    docs = table(spark, d, "documents").where("doc_id < 60").select(F.col("doc_id").alias("chunk_id"))
    q = benchmark_queries(spark, d).select("query_id").where("query_id < 60")
    value = (F.col("chunk_id") * 31 + F.col("query_id")) % 97
    from ..operators.lexical import rank

    ranked = rank(q.crossJoin(docs).withColumn("v", value.cast("double")), "v", False, "chunk_id").withColumn("method", F.lit("one"))
    rows = evaluation.metrics_single(ranked, q.select("query_id", F.col("query_id").alias("chunk_id")))
    return rows.select("query_id", "method", "hit_at_1", "recall_at_10", F.round("mrr", 9).alias("mrr"), "first_rank")


@sql("select doc_id::varchar as id, (doc_id % 7)::int as dense_rank, case when doc_id % 3 = 0 then (doc_id % 5)::int end as bm25_rank, null::int as rrf_rank from documents")
def gold_debug_rows(spark, d):
    rows = table(spark, d, "documents").select(F.lit("").alias("id"), F.col("doc_id").alias("gold_id"), (F.col("doc_id") % 7).alias("dense_full_rank"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 5).alias("lexical_rank"))
    return evaluation.gold_rows(rows)


@sql("with u as (select user_id as query_id, event_type as document_id, count(*) as picks from events group by 1, 2) select *, count(*) over (partition by query_id) as documents from u")
def selected_documents(spark, d):
    return report.selected_counts(table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("document_id")))


@sql("select doc_id, n_chars, row_number() over (order by n_chars desc, doc_id) as rank from documents where source = 'src1'")
def ranked_by_value(spark, d):
    docs = table(spark, d, "documents").where("source = 'src1'").withColumn("query_id", F.lit(1))
    return evaluation.with_ranks(docs, "n_chars", "doc_id").select("doc_id", "n_chars", "rank")


_HOLDER = "case source when 'src1' then 'world health organization and who guideline' when 'src2' then 'eular recommendations; eular' when 'src3' then 'eular' else 'none' end"


@sql(f"with f as (select source, case when source = 'src4' then 'NICE' when source = 'src1' then 'WHO' when source = 'src2' then 'EULAR' else 'GENERIC' end as doc_family, case when source = 'src4' then 2019 when source = 'src5' then 2022 end as year from documents) select doc_family, year, count(*) as documents from f group by all")
def family_distribution(spark, d):
    from ..functions.evidence import infer_family, infer_year

    name = F.when(F.col("source") == "src4", "a/nice guideline 2019.json").otherwise(F.concat(F.lit("a/"), "source", F.lit(".json")))
    page = F.when(F.col("source") == "src1", "World Health Organization and WHO guideline").when(F.col("source") == "src2", "EULAR recommendations; EULAR").when(F.col("source") == "src3", "EULAR").when(F.col("source") == "src5", "Published in 2022.").otherwise("none")
    docs = table(spark, d, "documents").select(name.alias("name"), page.alias("page"))
    return docs.groupBy(infer_family(F.col("name"), F.col("page")).alias("doc_family"), infer_year(F.col("name"), F.col("page")).alias("year")).agg(F.count("*").alias("documents"))


_JUDGED = "round((event_id * 13 % 100) / 100.0::double + 0.5::double * ((event_id * 7 % 100) / 100.0::double), 6)"


@sql(f"select user_id as query_id, event_id as chunk_id, row_number() over (partition by user_id order by {_JUDGED} desc, event_id) as rank, {_JUDGED} as score from events qualify rank <= 10")
def judged_rerank(spark, d):
    share = lambda by: (F.col("event_id") * by % 100) / 100.0
    pool = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), F.col("event_id").alias("rrf_rank"), share(13).alias("direct"), share(7).alias("partial"))
    found = fusion.rerank(pool, F.round(fusion.probability_score(F.col("direct"), F.col("partial")), 6))
    return found.select("query_id", "chunk_id", "rank", F.col("rerank_score").alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in REGISTERED.items()}
