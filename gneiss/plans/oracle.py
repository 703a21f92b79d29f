"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

# The lists are written out here, apart from those of the code, so that a wrong list shows.
#: Words that the lexical tokenizer drops.
STOPWORDS = "a an the and or of for in on at to from with by as is are was were be been being this that these those which what how does do did can could should would may might".split()
#: Labels of reference lists, signals of citations, openings, last words, medication, scope.
REFERENCE_LABELS = ("reference", "references", "bibliography", "bibliographic references", "references cited", "literature cited")
CITATION_SIGNALS = ("doi", "pmid", "et al.", "journal", "vol.", "issue")
LEANING_STARTS = ("this ", "these ", "those ", "such ", "therefore ", "however ", "additionally ", "furthermore ", "moreover ", "thus ", "in this population", "in these patients", "for these patients", "the latter", "the former")
CONNECTORS = r"\b(and|or|but|because|although|while|which|that|including|such as|with|for|to|of|in|on|by|as)\s*$"
MEDICATION_SIGNALS = ("mg", "milligram", "tablet", "kapsül", "ilaç dozu", "ilaç kullan", "şu ilacı", "medication", "drug dose")
OUT_OF_SCOPE = (r"\bilaç\b", r"\bilac\b", r"\bilaç\s+dozu\b", r"\bilac\s+dozu\b", r"\btanı\s+koy\b")
#: Headings that many documents share, headings that hold within a page, marks of the page's own lines.
COMMON_HEADINGS = ("abstract", "introduction", "background", "methods", "methodology", "results", "discussion", "conclusion", "recommendations", "references", "appendix", "scope", "purpose", "objectives", "assessment", "outcome measures", "safety", "limitations", "patient population", "target population", "risk factors", "overview", "process", "definitions", "implementation", "clinical implications", "strengths and limitations", "future research", "literature searches", "best-evidence synthesis", "peer review and public commentary", "exclusions", "feasibility", "role of patient preferences", "potential benefits, risks, harms, and costs", "benefit-harm assessment", "rationale", "recommendation")
LOCAL_HEADINGS = ("what this evidence adds", "key points", "highlights", "clinical practice guideline", "clinical practice guidelines")
LAYOUT_MARKS = ("doi:", "http://", "https://", "www.", "copyright", "©", "isbn", "issn", "downloaded from", "all rights reserved")


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+'), lambda w: w not in ({_list(STOPWORDS)}))"


DOCS = f"docs as (select doc_id as chunk_id, source, text, {_tokens('text')} as tokens, len(tokens) as dl from documents)"
POST = "post as (select term, chunk_id, dl, count(*) as tf from (select chunk_id, dl, unnest(tokens) as term from docs) group by all), stats as (select count(*) as n_docs, avg(dl) as avgdl from docs)"
IDF = "dfs as (select term, count(*) as df from post group by 1), rawidf as (select term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) as raw from dfs, stats), idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from rawidf) else raw end as idf from rawidf)"
SCORED = f"qt as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({_tokens('text')}) as term from benchmark) group by all), scored as (select query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from qt join post using (term) join idf using (term), stats group by all), lexfull as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from scored)"
BM25 = f"{DOCS}, {POST}, {IDF}, {SCORED}"
_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
DENSE = f"vecs as (select vec_id, label, embedding::double[] as v from embeddings), near as (select a.vec_id as query_id, b.vec_id as chunk_id, 1 - {_COS} as distance from vecs a join benchmark q on a.vec_id = q.item_id join vecs b on a.vec_id != b.vec_id), densefull as (select *, row_number() over (partition by query_id order by round(distance, 9), chunk_id) as rank from near)"
GOLD = "gold as (select item_id as query_id, doc_id as chunk_id from benchmark b join documents d on contains(d.text, b.text))"


def _pool(dense: int = 40, lex: int = 20, wd: float = 1.10, wl: float = 0.85, pool: int = 30) -> str:
    return (
        f"parts as (select query_id, chunk_id, {wd}::double / (60 + rank) as part, rank as dense_rank, null::bigint as bm25_rank from densefull where rank <= {dense} union all select query_id, chunk_id, {wl}::double / (60 + rank), null, rank from lexfull where rank <= {lex}), "
        "fused as (select query_id, chunk_id, sum(part) as rrf_score, max(dense_rank) as dense_rank, max(bm25_rank) as bm25_rank from parts group by all), "
        f"pool as (select * from (select *, row_number() over (partition by query_id order by round(rrf_score, 12) desc, dense_rank nulls last, bm25_rank nulls last) as rrf_rank from fused) where rrf_rank <= {pool})"
    )


BASE = f"{BM25}, {DENSE}, {_pool()}, {GOLD}"
METHODS = "ranked as (select query_id, chunk_id, rank, 'bm25' as method from lexfull where rank <= 20 union all select query_id, chunk_id, rrf_rank, 'rrf' from pool)"
METRICS = (
    "hits as (select query_id, method, min(rank) as first_rank, list(rank) as ranks from ranked semi join gold using (query_id, chunk_id) group by all), counts as (select query_id, count(*) as n_gold from gold group by 1), "
    "m as (select c.query_id, t.method, h.first_rank, coalesce(h.ranks, []) as ranks, c.n_gold from counts c cross join (values ('bm25'), ('rrf')) t(method) left join hits h on h.query_id = c.query_id and h.method = t.method), "
    "metrics as (select query_id, method, coalesce((first_rank <= 1)::int::double, 0) as hit_at_1, coalesce((first_rank <= 5)::int::double, 0) as recall_at_5, coalesce((first_rank <= 10)::int::double, 0) as recall_at_10, coalesce(1.0 / first_rank, 0) as mrr, "
    + ", ".join(f"list_sum(list_transform(list_filter(list_concat(ranks, [1000000]), lambda r: r <= {k} or r = 1000000), lambda r: case when r = 1000000 then 0 else 1 / log2(r + 1) end)) / list_sum(list_transform(range(1, least(n_gold, {k}) + 1), lambda r: 1 / log2(r + 1))) as ndcg_at_{k}" for k in (5, 10))
    + ", first_rank from m)"
)
KEY = r"lower(regexp_replace(replace(replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '\s+', ' ', 'g'))"
SQUEEZED = r"regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^ | $', '', 'g')"
TOKENS = "case when length(coalesce(text, '')) = 0 then 0 else greatest(1, round_even(length(text) / 4.0::double, 0)::int) end"


def _count(c: str) -> str:
    return f"(length(t) - length(replace(t, '{c}', '')))"


_LEANING = " or ".join(f"starts_with(lower(t), '{x}')" for x in LEANING_STARTS)
CHUNKS = (
    f"sq as (select doc_id as chunk_id, source as document, lang, text, {SQUEEZED} as t, {TOKENS} as estimated_tokens from documents), "
    "issues as (select *, case when t = '' then 1 else (regexp_matches(t, '^[\\p{Ll},;:)\\]]'))::int + (regexp_matches(t, '[,;:]$'))::int + "
    f"(regexp_matches(lower(t), '{CONNECTORS}'))::int + ({_LEANING})::int + ({_count('(')} != {_count(')')} or {_count('[')} != {_count(']')})::int end as n_issues from sq), "
    "ch as (select *, case when t = '' then 0 else greatest(0, round_even(1.0 - 0.22 * n_issues, 2)) end::double as score, case when t = '' then 'incomplete' when n_issues <= 1 then 'complete' when n_issues = 2 then 'warning' else 'incomplete' end as completeness from issues)"
)
_FLAGS = (
    (r"regexp_matches(regexp_replace(text, 'https?://\S+|\bdoi\s*:\s*\S+|\b10\.\d{4,9}/\S+', ' ', 'gi'), '[A-Za-z]{30,}')", "long_unspaced_token"),
    (r"regexp_matches(text, '[A-Za-z]-\s+[a-z]{2,}')", "possible_hyphenation_artifact"),
    (r"regexp_matches(text, '(?:[A-Za-z][^\p{L}\p{N}_\p{M}\s]){5,}')", "dense_punctuation_or_extraction_noise"),
    (r"regexp_matches(text, '(?i)\b(?:cid:\d+|glyph)\b')", "possible_glyph_extraction_error"),
)
_CITED = r"regexp_extract_all(answer, '(?i)\[SOURCE\s+\d+(?:\s*,\s*\d+)*\s*\]')"
REPORT = "rep as (select document, count(*) as chunk_count, count(*) as text_chunk_count, round_even(avg(length(text)), 1) as average_characters, min(length(text)) as min_characters, max(length(text)) as max_characters, round_even(median(estimated_tokens), 1) as median_estimated_tokens, round_even(100.0::double * count(*) filter (coalesce(lang, '') != '') / count(*), 1) as section_coverage_percent, count(*) filter (estimated_tokens < 150 or completeness != 'complete') as orphan_candidates, count(*) filter (length(text) < 300) as short_chunks, count(*) filter (length(text) > 4050) as long_chunks from ch group by 1)"
TRACE = "trace as (select g.query_id, g.chunk_id, d.rank as dense_rank, l.rank as bm25_rank, p.rrf_rank, coalesce(p.rrf_rank <= 30, false) as in_pool from gold g left join densefull d using (query_id, chunk_id) left join lexfull l using (query_id, chunk_id) left join pool p using (query_id, chunk_id))"
_ROLE = r"case when regexp_matches(text, '(?im)^\s*references\s*$') or ((len(regexp_extract_all(text, '(?i)\bdoi\s*:\s*10\.\d{4,9}/')) + len(regexp_extract_all(text, '(?i)\bhttps?://doi\.org/')) + len(regexp_extract_all(text, '(?i)\bpmid\s*[:.]?\s*\d+'))) >= 1 and len(regexp_extract_all(text, '\b(?:19|20)\d{2}\b')) >= 1) then 'reference' else 'clinical' end"
_REFERENCE = f"(t = '' or (({' or '.join(f'''starts_with(lower(t), '{x}')''' for x in REFERENCE_LABELS)}) and ({' or '.join(f'''contains(lower(t), '{x}')''' for x in CITATION_SIGNALS)})))"

_LOW = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"
_SCOPE = " or ".join(f"regexp_matches({_LOW}, '(^|[^\\p{{L}}\\p{{N}}_]){x[2:-2]}($|[^\\p{{L}}\\p{{N}}_])')" for x in OUT_OF_SCOPE)
_MEDICATION = " or ".join(f"contains(lower(coalesce(text, '')), '{x}')" for x in MEDICATION_SIGNALS)
_LINE = r"replace(replace(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
EDGES = (
    rf"ln as (select source as document, doc_id as page, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), lambda x: {_LINE}), lambda x: x != '') as lines from documents), "
    r"en as (select document, page, unnest(list_distinct(list_transform(list_filter(list_concat(lines[1:3], list_reverse(lines)[1:3]), lambda x: length(x) <= 180), lambda x: lower(regexp_replace(x, '\s+', ' ', 'g'))))) as line from ln), "
    "pg as (select source as document, count(*) as n_pages from documents group by 1)"
)
_SHARED = r"len(list_intersect(list_distinct(string_split_regex(trim(q.text), '\s+')), list_distinct(string_split_regex(trim(d.text), '\s+'))))"


def _squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _cleaned(x: str) -> str:
    return rf"replace(replace(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"


def _is_layout(x: str) -> str:
    low = f"lower({_squeezed(x)})"
    return f"({low} = '' or " + " or ".join(f"contains({low}, '{m}')" for m in LAYOUT_MARKS) + ")"


def _is_link(x: str) -> str:
    return rf"(regexp_matches(lower({x}), '10\.\d{{4,9}}/\S+') or regexp_matches(lower({x}), '^(https?://|www\.)') or contains(lower({x}), 'doi.org/'))"


def _joined_capitals(x: str) -> str:
    return rf"case when regexp_matches({x}, '^(?:[A-Za-z]\s+){{3,}}[A-Za-z]$') then regexp_replace({x}, '\s+', '', 'g') else {x} end"


_FORM = r"^(\d+(?:\.\d+){0,3})\.?\s+(.+)$"
_CITATION = (
    r"(contains(lower(title), 'et al') or regexp_matches(title, '\b(?:19|20)\d{2}\b') or length(title) - length(replace(title, ',', '')) >= 2 or regexp_matches(title, '\b[A-Z][a-z]+,\s+[A-Z]\.?|\b[A-Z][a-z]+\s+[A-Z][a-z]+,\s+[A-Z]') "
    r"or regexp_matches(lower(title), '\b(?:doi|pmid|issn|isbn)\b'))"
)
_REJECT = (
    r"(regexp_matches(t, '(?i)^\d+\s+(?:were|was|are|is|the|a|an|in|of|to|for|from|with|on|by|and|or|both|two|one|several|these|those|this|that)\b') or regexp_matches(t, '^\d+\s+[A-Z][^.!?]{0,25},\s*$') "
    rf"or {_is_link('t')} or {_is_layout('t')} or {_CITATION} or regexp_matches(title, '[,;:]$') or length(title) < 3 or length(title) > 180 or regexp_matches(regexp_extract(title, '(\p{{L}})', 1), '^\p{{Ll}}') "
    rf"or (not contains(number, '.') and words <= 2 and not common) or regexp_matches(title, '(?i)\b(?:CPG|DOI|PMID|ISSN|ISBN)\b') or regexp_matches(title, '^[A-Za-z][A-Za-z ]+\s+\d{{2,4}}$') or (words = 1 and not common))"
)


def _classified(lines: str) -> str:
    """CTEs over ``lines(..., t)``: ``kinds`` with number and kind, null for no heading."""
    return (
        rf"form as (select *, regexp_extract(t, '{_FORM}', 1) as number, {_cleaned(f"regexp_extract(t, '{_FORM}', 2)")} as title, {_joined_capitals('t')} as compact from {lines}), "
        rf"word as (select *, len(string_split({_squeezed('title')}, ' ')) as words, lower(title) in ({_list(COMMON_HEADINGS)}) as common, regexp_replace(lower(compact), ':+$', '') as low, regexp_replace({_joined_capitals('compact')}, '[^A-Za-z]', '', 'g') as letters from form), "
        rf"kinds as (select *, case when t = '' or length(t) > 180 or {_is_layout('t')} or regexp_matches(t, '^\d{{1,4}}$') or {_is_link('t')} then null when regexp_matches(t, '{_FORM}') and not {_REJECT} then 'numbered' "
        rf"when low in ({_list(LOCAL_HEADINGS)}) then 'local' when low in ({_list(COMMON_HEADINGS)}) then 'common' when length(compact) <= 140 and lower(compact) not in ({_list(LOCAL_HEADINGS)}) and length(letters) >= 5 and upper(letters) = letters and len(string_split({_squeezed('compact')}, ' ')) <= 16 then 'caps' end as kind from word)"
    )


HEADINGS = rf"lines as (select doc_id as chunk_id, unnest(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), lambda x: {_LINE}), lambda x: x != '')) as t from documents), {_classified('lines')}"
def _packed(source: str) -> str:
    """CTEs over ``source(key, text)``: ``pieces(key, piece, text)`` of whole sentences up to 3000 characters."""
    return (
        rf"parts as (select key, text, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x != '') as ss from {source}), "
        "u as (select key, unnest(ss) as s, generate_subscripts(ss, 1) as i from parts), "
        "v as materialized (select key, i, s, length(s) as l, case when length(s) > 3000 then list_filter(list_transform(range(0, ceil(length(s) / 3000.0)::bigint), lambda k: trim(s[k * 3000 + 1:(k + 1) * 3000])), lambda x: x != '') else [] end as cuts from u), "
        "f as (select key, i, 0::bigint as p, case when l > 3000 then len(cuts) else 0 end as base, case when l > 3000 then 0 else l end as cur from v where i = 1 union all "
        "select v.key, v.i, case when l > 3000 then base + (cur > 0)::int when cur = 0 or cur + 1 + l <= 3000 then base else base + 1 end, case when l > 3000 then base + (cur > 0)::int + len(cuts) when cur = 0 or cur + 1 + l <= 3000 then base else base + 1 end, case when l > 3000 then 0 when cur = 0 then l when cur + 1 + l <= 3000 then cur + 1 + l else l end from f join v on v.key = f.key and v.i = f.i + 1), "
        "pieces as (select key, p as piece, string_agg(s, ' ' order by i) as text from f join v using (key, i) where l <= 3000 group by 1, 2 union all select key, p + j - 1, cuts[j] from (select f.key, p, cuts, unnest(range(1, len(cuts) + 1)) as j from f join v using (key, i) where l > 3000) union all select key, 0, coalesce(text, '') from parts where len(ss) = 0)"
    )


_SHORT = r"list_filter(ls, lambda x: len(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ')) <= 2 and length(x) <= 18)"
PAGE_LINES = (
    rf"pg0 as (select source as document, doc_id as page, coalesce(text, '') as text, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), lambda x: {_LINE}), lambda x: x != '') as ls from documents), "
    rf"pg1 as (select document, page, case when len(ls) >= 12 and len({_SHORT}) >= 0.65::double * len(ls) and list_median(list_transform(ls, lambda x: length(x))) <= 18 then regexp_replace(regexp_replace(array_to_string(ls, ' '), '\s+([,.;:!?])', '\1', 'g'), '([.!?])\s+([A-Z])', '\1' || chr(10) || '\2', 'g') else text end as text from pg0), "
    r"raw0 as (select document, page, string_split_regex(text, '\r\n|\r|\n') as xs from pg1), raw1 as (select document, page, unnest(xs) as x, generate_subscripts(xs, 1) as line_no from raw0), "
    rf"raw2 as (select document, page, line_no, {_LINE} as line from raw1), "
    rf"raw3 as (select *, lower({_squeezed('line')}) as low from raw2 where line = '' or not ({_is_layout('line')} or regexp_matches(line, '^\d{{1,4}}$') or starts_with(lower({_squeezed('line')}), 'downloaded from'))), "
    r"rc as (select document, line as low, count(*) as n from en group by all), often as (select document, low from rc join pg using (document) where n_pages >= 2 and n >= greatest(3, round_even(n_pages * 0.35::double, 0)::int) and length(low) >= 12 and contains(low, ' ') and not regexp_matches(low, '^[^\p{L}_\p{M}]+$')), "
    "raw4 as (select *, lag(line) over (partition by document, page order by line_no) as before from raw3 anti join often using (document, low)), plines as (select document, page, line_no, line from raw4 where line != '' or coalesce(before, '') != '')"
)


_TWO, _FOUR = "(values ('bm25'), ('rrf'))", "(values ('bm25'), ('dense'), ('rrf'), ('lexical_first'))"
FLAT = f"fl as (select source as document, doc_id, text, {TOKENS} as n, doc_id % 6 as kind, doc_id % 6 not in (2, 3, 4) as free, {' or '.join(c for c, _ in _FLAGS)} as broken from documents)"


def _page_chunks(least: int = 0) -> str:
    """Chunks of pages without tables; no subsection of the test tables opens the list of domains, so that list is left out."""
    judged = CHUNKS[CHUNKS.index("issues as") :]
    return (
        f"{EDGES}, {PAGE_LINES}, "
        rf"toc0 as (select document, page, lower({_squeezed('text')}) as low, list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: {_LINE}), lambda x: x != '') as ls from pg1), "
        r"toc as (select document, page, contains(low, 'table of contents') or (len(ls) >= 8 and (len(list_filter(ls, lambda x: regexp_matches(x, '\.{3,}\s*\d{1,3}\s*$'))) >= 3 or (len(list_filter(ls, lambda x: regexp_matches(x, '\.{3,}\s*\d{1,3}\s*$'))) >= 1 and len(list_filter(ls, lambda x: regexp_matches(x, '^\d+(?:\.\d+)*\s+'))) >= 6))) as is_toc from toc0), "
        f"tl as (select *, line as t from plines join toc using (document, page)), {_classified('tl')}, "
        "hd as (select *, case when kind = 'numbered' then number || ' ' || title when kind is not null then compact end as heading, kind = 'numbered' and not is_toc as sets, length(number) - length(replace(number, '.', '')) + 1 as level from kinds), "
        "s0 as (select *, last_value(case when sets and level = 1 then heading end ignore nulls) over w as section, sum((coalesce(sets, false) and level = 1)::int) over w as run, last_value(heading ignore nulls) over (partition by document, page order by line_no rows between unbounded preceding and current row) as local_heading, sum((heading is not null)::int) over (partition by document, page order by line_no rows between unbounded preceding and current row) as block from hd window w as (partition by document order by page, line_no rows between unbounded preceding and current row)), "
        f"s1 as (select * from s0 where line != '' and not {_is_link('line')}), "
        "ends as (select document, page, arg_max(struct_pack(s := section), line_no).s as section from s1 group by 1, 2), "
        r"bl as (select document, page, block, regexp_replace(string_agg(line, chr(10) order by line_no), '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g') as body, arg_min(struct_pack(h := local_heading), line_no).h as local_heading from s1 group by 1, 2, 3), "
        f"given as (select struct_pack(d := document, p := page, b := block) as key, body as text from bl where length(body) > 3000), {_packed('given')}, "
        "tx as (select document, page, block, 0::bigint as piece, body as text, local_heading from bl where length(body) <= 3000 union all select key.d, key.p, key.b, piece, pieces.text, local_heading from pieces join bl on bl.document = key.d and bl.page = key.p and bl.block = key.b), "
        f"sq as (select *, {SQUEEZED} as t, {TOKENS} as estimated_tokens, printf('%s_chunk_%04d', document, row_number() over (partition by document order by page, block, piece)) as chunk_id from tx where text != '' and length(text) >= {least}), {judged}"
    )


def _scaled(value: str, low: str, high: str) -> str:
    return f"case when abs({high} - {low}) <= 1e-9 * greatest(abs({high}), abs({low})) then 1 else ({value} - {low}) / ({high} - {low}) end"


def _mmr(picks: int) -> str:
    # One step a pick: candidates of documents below the cap come first, then the best score.
    steps = [
        f"rel0 as (select p.query_id, p.chunk_id, p.rrf_rank, p.rrf_score, d.source as document_id, a.v, {_COS} as sem from pool p join documents d on d.doc_id = p.chunk_id join vecs a on a.vec_id = p.chunk_id join vecs b on b.vec_id = p.query_id)",
        "mm as (select *, min(rrf_score) over w as l1, max(rrf_score) over w as h1, min(sem) over w as l2, max(sem) over w as h2 from rel0 window w as (partition by query_id))",
        f"rel as materialized (select query_id, chunk_id, rrf_rank, document_id, v, 0.85::double * ({_scaled('rrf_score', 'l1', 'h1')}) + 0.15::double * ({_scaled('sem', 'l2', 'h2')}) as relevance from mm)",
        "sel0 as (select query_id, chunk_id, document_id, v, 0 as selection_rank, relevance as mmr_score, relevance as redundancy from rel where false)",
    ]
    for k in range(1, picks + 1):
        steps += [
            f"c{k} as (select a.query_id, a.chunk_id, a.document_id, a.v, a.rrf_rank, a.relevance, count(*) filter (b.document_id = a.document_id) as used, coalesce((max({_COS}) + 1) / 2, 0) as redundancy from rel a left join sel{k - 1} b on b.query_id = a.query_id where not exists (select 1 from sel{k - 1} x where x.query_id = a.query_id and x.chunk_id = a.chunk_id) group by all)",
            f"n{k} as (select *, 0.8::double * relevance - (1 - 0.8::double) * redundancy as mmr_score, row_number() over (partition by query_id order by used >= 2, 0.8::double * relevance - (1 - 0.8::double) * redundancy desc, rrf_rank) as rn from c{k})",
            f"sel{k} as materialized (select * from sel{k - 1} union all select query_id, chunk_id, document_id, v, {k}, mmr_score, redundancy from n{k} where rn = 1)",
        ]
    return ", ".join(steps)


def oracle_sql() -> dict[str, str]:
    return {
        "tokenize_stats": f"with {DOCS} select chunk_id, dl as n_tokens, len(list_distinct(tokens)) as n_distinct from docs",
        "postings_df": f"with {DOCS}, {POST} select term, count(*) as df, sum(tf) as cf from post group by 1",
        "bm25_corpus_stats": f"with {DOCS}, {POST} select n_docs, round(avgdl, 6) as avgdl, (select count(distinct term) from post) as vocabulary from stats",
        "bm25_idf": f"with {DOCS}, {POST}, {IDF} select term, df, round(idf, 6) as idf from idf",
        "bm25_top20": f"with {BM25} select query_id, chunk_id, rank, round(score, 5) as score from lexfull where rank <= 20",
        "bm25_full_rank_gold": f"with {BM25}, {GOLD} select query_id, chunk_id, rank, round(score, 5) as score from lexfull semi join gold using (query_id, chunk_id)",
        "dense_top40": f"with {DENSE} select query_id, chunk_id, rank, round(distance, 5) as distance from densefull where rank <= 40",
        "dense_expression_top10": f"with {DENSE} select query_id, chunk_id, rank, round(distance, 5) as distance from densefull where rank <= 10",
        "dense_label_precision": f"with {DENSE} select query_id, round(avg((a.label = b.label)::int), 6) as precision_at_10 from densefull d join vecs a on a.vec_id = d.query_id join vecs b on b.vec_id = d.chunk_id where rank <= 10 group by 1",
        "rrf_pool30": f"with {BASE} select query_id, chunk_id, round(rrf_score, 9) as rrf_score, dense_rank, bm25_rank, rrf_rank from pool",
        "rrf_production_penalty": f"with {BM25}, {DENSE}, {_pool(40, 40, 1.0, 0.85, 40)} select query_id, chunk_id, round(rrf_score, 9) as rrf_score, dense_rank, bm25_rank, rrf_rank from pool",
        "pool_gold_ceiling": f"with {BASE} select count(distinct g.query_id) as questions, count(distinct p.query_id) as in_pool from gold g left join pool p using (query_id, chunk_id)",
        "missing_gold_anti": f"with {GOLD} select query_id, chunk_id from gold where chunk_id not in (select vec_id from embeddings)",
        "index_symmetric_diff": "select doc_id as chunk_id, 'missing' as side from documents where doc_id not in (select vec_id from embeddings) union all select vec_id, 'extra' from embeddings where vec_id not in (select doc_id from documents)",
        "metrics_hit_per_query": f"with {BASE}, {METHODS}, {METRICS} select query_id, method, hit_at_1, recall_at_5, recall_at_10, round(mrr, 6) as mrr, round(ndcg_at_5, 6) as ndcg_at_5, round(ndcg_at_10, 6) as ndcg_at_10, first_rank from metrics",
        "metrics_fraction_per_query": f"with {BM25}, {GOLD}, c as (select query_id, count(*) as gold_count from gold group by 1), h as (select query_id, min(rank) as first_rank, {', '.join(f'count(*) filter (rank <= {k}) as h{k}' for k in (1, 3, 5, 10))} from lexfull semi join gold using (query_id, chunk_id) where rank <= 20 group by 1) select q.query_id, gold_count, {', '.join(f'case when gold_count > 0 then round_even(coalesce(h{k}, 0) / gold_count, 4) end as recall_at_{k}' for k in (1, 3, 5, 10))}, case when gold_count > 0 then round_even(coalesce(1.0::double / first_rank, 0), 4) end as mrr from (select distinct query_id from lexfull) q left join c using (query_id) left join h using (query_id)",
        "metrics_method_summary": f"with {BASE}, {METHODS}, {METRICS} select method, count(*) as questions, round(avg(hit_at_1), 6) as hit_at_1, round(avg(recall_at_10), 6) as recall_at_10, round(avg(mrr), 6) as mrr, count(first_rank) as any_gold, count(*) filter (first_rank <= 1) as top_1, count(*) filter (first_rank <= 3) as top_3, count(*) filter (first_rank <= 5) as top_5, count(*) filter (first_rank <= 10) as top_10 from metrics group by 1",
        "metrics_by_source_pivot": f"with {BASE}, {METHODS}, {METRICS}, cat as (select query_id, source as category from (select query_id, min(chunk_id) as doc_id from gold group by 1) join documents using (doc_id)) select category, {', '.join(f'''round(avg({c}) filter (method = '{m}'), 6) as {m}_{c}''' for m in ('bm25', 'rrf') for c in ('mrr', 'hit_at_1'))} from metrics join cat using (query_id) group by 1",
        "paired_win_tie_loss": f"with {BASE}, {METHODS}, {METRICS}, w as (select count(*) filter (a < b) as wins, count(*) filter (a = b) as ties, count(*) filter (a > b) as losses from (select query_id, max(coalesce(first_rank, 1e18)) filter (method = 'rrf') as a, max(coalesce(first_rank, 1e18)) filter (method = 'bm25') as b from metrics group by 1)) select wins, ties, losses, round(case when wins + losses = 0 then 1 else least(1, 2 * (select sum(factorial((wins + losses)::int) / (factorial(i::int) * factorial((wins + losses - i)::int)))::double from range(0, least(wins, losses) + 1) r(i)) / pow(2, wins + losses)) end::double, 9) as p_value from w",
        "gold_trace": f"with {BASE}, {TRACE} select * from trace",
        "gold_diagnosis": f"with {BASE}, {TRACE} select case when dense_rank is null and bm25_rank is null then 'not_indexed' when coalesce(dense_rank, 1000000000) > 40 and coalesce(bm25_rank, 1000000000) > 20 then 'outside_both' when rrf_rank is null then 'not_fused' when not in_pool then 'outside_pool' else 'in_pool' end as verdict, count(*) as n from trace group by 1",
        "dedupe_first_wins": f"select min(doc_id) as chunk_id, count(*) as duplicate_count from documents group by {KEY}",
        "duplicate_text_groups": f"select count(*) as groups, coalesce(sum(n - 1), 0) as surplus from (select count(*) as n from documents group by trim(regexp_replace(lower(translate(text, '-', ' ')), '[^\\p{{L}}\\p{{N}}_\\p{{M}}]+', ' ', 'g'))) where n > 1",
        "chunk_quality_report": f"with {CHUNKS}, {REPORT} select * from rep",
        "corpus_quality_totals": f"with {CHUNKS}, {REPORT} select count(*) as documents, sum(chunk_count) as chunk_count, sum(orphan_candidates) as orphan_candidates, sum(short_chunks) as short_chunks, sum(long_chunks) as long_chunks, round_even(sum(short_chunks) / sum(text_chunk_count), 4) as short_ratio from rep",
        "short_chunk_thresholds": f"with {CHUNKS} select document, count(*) as chunks, round_even(avg(estimated_tokens), 2) as mean_tokens, min(estimated_tokens) as min_tokens, max(estimated_tokens) as max_tokens, {', '.join(f'count(*) filter (estimated_tokens < {n}) as under_{n}' for n in (10, 20, 30, 50))} from ch group by 1",
        "orphan_reasons": f"with {CHUNKS} select concat_ws(';', case when estimated_tokens < 150 then 'very_small_chunk' end, case when completeness != 'complete' then 'semantic_' || completeness end) as reason, count(*) as n from ch where estimated_tokens < 150 or completeness != 'complete' group by 1",
        "semantic_completeness": f"with {CHUNKS} select chunk_id, completeness, score, n_issues from ch",
        "text_quality_flags": f"select doc_id as chunk_id, concat_ws(',', {', '.join(f'''case when {c} then '{n}' end''' for c, n in _FLAGS)}) as flags from documents",
        "chunk_role": f"select {_ROLE} as role, count(*) as n from documents group by 1",
        "reference_only_filter": f"with {CHUNKS} select chunk_id, {_REFERENCE} as reference_only from ch",
        "token_estimate_bins": f"select (t // 100) * 100 as bin, count(*) as n, sum(t) as tokens from (select {TOKENS} as t from documents) group by 1",
        "prev_next_links": "select doc_id as chunk_id, lag(doc_id) over w as prev_chunk_id, lead(doc_id) over w as next_chunk_id from documents window w as (partition by source order by doc_id)",
        "stable_chunk_ids": r"select doc_id as chunk_id, substr(sha256(concat_ws('|', lower(source), '1', trim(regexp_replace(lower(trim(regexp_replace(regexp_replace(text, '[^\x20-\x7E]', '', 'g'), '[ \t]+', ' ', 'g'))), '\W+', ' ', 'g')), 'text', '0')), 1, 24) as stable_id from documents",
        "citation_validation": rf"with t as (select conv_id, turn, coalesce(text, '') || ' [SOURCE 1] [source 2, ' || (turn % 3 + 2) || ']' as answer from conversations), c as (select conv_id, turn, {_CITED} as tags, list_sort(list_distinct(list_transform(flatten(list_transform({_CITED}, lambda x: regexp_extract_all(x, '\d+'))), lambda n: n::int))) as cited from t) select conv_id, turn, array_to_string(cited, ',') as cited, len(cited) > 0 and len(list_filter(cited, lambda x: x < 1 or x > 3)) = 0 as valid, len(tags) as tags from c",
        "minmax_relevance": f"with {BASE} select query_id, chunk_id, round(case when abs(hi - lo) <= 1e-9 * greatest(abs(hi), abs(lo)) then 1 else (rrf_score - lo) / (hi - lo) end, 6) as normalized_rrf from (select *, min(rrf_score) over (partition by query_id) as lo, max(rrf_score) over (partition by query_id) as hi from pool)",
        "probability_rank": f"with {BASE}, s as (select *, 1.0::double / (1 + coalesce(bm25_rank, 99)) + 0.5::double * (1.0::double / (1 + coalesce(dense_rank, 99))) as sc from pool), r as (select *, row_number() over (partition by query_id order by round(sc, 9) desc, rrf_rank) as rank from s) select query_id, chunk_id, rrf_rank as pre_rerank_rank, rank, round(sc, 6) as rerank_score from r where rank <= 10",
        "manifest_override": "select distinct source, case source when 'src1' then 'WHO' when 'src2' then 'NICE' end as doc_family, case source when 'src1' then 'World Health Organization' when 'src2' then 'NICE' end as organization, case source when 'src1' then 2020 end as year, source in ('src1', 'src2') as matched from documents",
        "legacy_id_consume": "with d as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as n from documents), p as (select lang, 'old_' || doc_id as legacy_chunk_id, row_number() over (partition by lang order by doc_id) as n from documents semi join labels using (doc_id)) select doc_id, legacy_chunk_id from d left join p using (lang, n)",
        "vector_upsert": "select case when label = 3 then -3 else label end as label, count(*) as n from embeddings group by 1",
        "out_of_scope_turns": f"select conv_id, turn, {_MEDICATION} as medication, {_SCOPE} as out_of_scope from conversations",
        "rerank_udf": f"with {BASE}, s as (select p.query_id, p.chunk_id, p.rrf_rank, {_SHARED}::double as rerank_score from pool p join documents d on d.doc_id = p.chunk_id join benchmark q on q.item_id = p.query_id), r as (select *, row_number() over (partition by query_id order by rerank_score desc, rrf_rank) as rank from s) select query_id, chunk_id, rrf_rank as pre_rerank_rank, rank, rerank_score from r where rank <= 10",
        "context_assembly": f"with {BASE}, {CHUNKS}, j as (select p.query_id, lower(t) as key, {_REFERENCE} as reference from pool p join ch using (chunk_id) where rrf_rank <= 6) select query_id, least(3, count(distinct key) filter (not reference)) as source_count, count(*) as input_count, count(*) filter (reference) as reference_filtered_count, count(*) filter (not reference) - count(distinct key) filter (not reference) as duplicate_filtered_count from j group by 1",
        "repeated_line_detection": rf"with {EDGES}, c as (select document, line, count(*) as n from en group by all) select document, line from c join pg using (document) where n_pages >= 2 and n >= greatest(3, round_even(n_pages * 0.02::double, 0)::int) and length(line) >= 12 and contains(line, ' ') and not regexp_matches(line, '^[^\p{{L}}_\p{{M}}]+$')",
        "heading_classification": f"with {HEADINGS} select kind, count(*) as n from kinds group by 1",
        "sentence_packing": f"with recursive given as (select doc_id as key, text from documents), {_packed('given')} select key as chunk_id, piece, length(text) as length from pieces",
        "page_chunks": f"with recursive {_page_chunks()} select document, page, chunk_id, section, local_heading, estimated_tokens, completeness from ch left join ends using (document, page)",
        "short_page_chunks": f"with recursive {_page_chunks(300)} select document, page, chunk_id, section, estimated_tokens from ch left join ends using (document, page)",
        "layout_statistics": f"with {FLAT} select document, count(*) as chunk_count, count(*) filter (kind = 2) as recommendation_chunks, count(*) filter (n < 30) as under_30, count(*) filter (n < 50 and free) as under_50_excluding_atomic, round_even(count(*) filter (n < 30) / count(*), 4) as under_30_ratio, round_even(median(length(text)), 2) as median_chars, round_even(avg(n), 2) as average_tokens, max(n) as max_tokens, count(*) filter (length(text) > 3000) as chunks_over_char_target, round_even(count(*) filter (kind = 2 and doc_id % 5 = 0) / nullif(count(*) filter (kind = 2), 0), 4) as recommendation_evidence_grade_filled_ratio, count(*) filter (doc_id % 4 = 0) as orphan_chunk_count, count(*) filter (kind = 2 and doc_id % 9 = 0) as recommendation_id_extracted_count, count(*) filter (broken) as broken_text_chunk_count, coalesce(array_to_string(list(doc_id order by doc_id) filter (doc_id % 4 = 0)[1:5], ','), '') as orphan_samples from fl group by 1",
        "layout_totals": f"with {FLAT}, t as (select count(distinct document) as documents, count(*) as chunk_count, {', '.join(f'count(*) filter (kind = {i}) as {k}_chunks' for i, k in enumerate(('paragraph', 'list_item', 'recommendation', 'table', 'references', 'appendix')))}, {', '.join(f'count(*) filter (n < {k}) as under_{k}, count(*) filter (n < {k} and free) as under_{k}_excluding_atomic' for k in (10, 20, 30, 50))}, count(*) filter (length(text) > 3000) as chunks_over_char_target, count(*) filter (kind = 2 and doc_id % 7 = 0) as recommendation_evidence_quality_filled_count, count(*) filter (kind = 2 and doc_id % 8 = 0) as recommendation_strength_filled_count, count(*) filter (doc_id % 4 = 0) as orphan_chunk_count, count(*) filter (free) as n_free from fl) select * exclude (n_free), round_even(under_30 / chunk_count, 4) as under_30_ratio, round_even(under_30_excluding_atomic / n_free, 4) as under_30_excluding_atomic_ratio, round_even(orphan_chunk_count / chunk_count, 4) as orphan_chunk_ratio, round_even(recommendation_strength_filled_count / recommendation_chunks, 4) as recommendation_strength_filled_ratio from t",
        "benchmark_methods": f"with {BASE}, ranked as (select query_id, chunk_id, rank, 'bm25' as method from lexfull where rank <= 20 union all select query_id, chunk_id, rank, 'dense' from densefull where rank <= 40 union all select query_id, chunk_id, rrf_rank, 'rrf' from pool union all select query_id, chunk_id, rank, 'lexical_first' from (select *, row_number() over (partition by query_id order by coalesce(bm25_rank, 99), rrf_rank) as rank from pool) where rank <= 10), {METRICS.replace(_TWO, _FOUR)} select query_id, method, hit_at_1, recall_at_10, round(mrr, 6) as mrr, first_rank from metrics",
        "context_texts": f"with {BASE}, {CHUNKS}, j as (select p.query_id, rrf_rank, chunk_id, document, t, lower(t) as key, {_REFERENCE} as reference from pool p join ch using (chunk_id) where rrf_rank <= 6), k as (select * from j where not reference qualify row_number() over (partition by query_id, key order by rrf_rank) = 1), n as (select *, row_number() over (partition by query_id order by rrf_rank) as i from k) select query_id, string_agg('[SOURCE ' || i || ']' || chr(10) || 'Document: ' || document || chr(10) || 'Page: 1' || chr(10) || 'Section: belirtilmemiş' || chr(10) || t || chr(10) || '[/SOURCE ' || i || ']', chr(10) || chr(10) order by i) as context_text, string_agg(chunk_id::varchar, ',' order by i) as source_ids from n where i <= 3 group by 1",
        "page_line_filter": f"with {EDGES}, {PAGE_LINES} select document, count(*) as lines, count(distinct page) as pages from plines group by 1",
        "mmr_top6": f"with {BM25}, {DENSE}, {_pool(40, 40, 1.0, 0.85, 40)}, {_mmr(6)} select query_id, selection_rank, chunk_id, document_id, mmr_score, redundancy from sel6",
    }
