"""Turkish terminology: normalisation, suffix stems, phrase matching, query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import text_or_empty

#: Turkish suffixes, longest first.
SUFFIXES = (
    "lerindeki", "larındaki", "lerimiz", "larımız", "leriniz", "larınız", "lerdir", "lardır", "lerinin", "larının",
    "lerine", "larına", "lerini", "larını", "lerden", "lardan", "lerle", "larla", "lerin", "ların", "ler", "lar",
    "daki", "deki", "taki", "teki", "dan", "den", "tan", "ten", "dır", "dir", "dur", "dür", "tır", "tir", "tur", "tür",
    "nin", "nın", "nun", "nün", "nde", "nda", "yi", "yı", "yu", "yü", "ye", "ya", "ni", "nı", "nu", "nü", "ne", "na",
    "in", "ın", "un", "ün", "im", "ım", "um", "üm", "i", "ı", "u", "ü", "e", "a",
)
LETTERS = "a-zçğıöşü0-9"


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(text_or_empty(text), "İI’", "iı'")), r"(?U)\s+", " "))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalize(text), F.lit(f"[{LETTERS}]+"), F.lit(0))


def stem_token(token: Column) -> Column:
    """Longest suffix that leaves four letters goes; tokens of up to five letters stay."""
    longest_first = "|".join(sorted(SUFFIXES, key=lambda s: -len(s)))
    return F.when(F.length(token) <= 5, token).otherwise(F.regexp_replace(token, f"(?<=^.{{4,60}})(?:{longest_first})$", ""))


def stems(text: Column) -> Column:
    return F.transform(word_tokens(text), stem_token)


def _bounded(text: Column, term: Column, letters: str) -> Column:
    """Whether ``term`` occurs in ``text`` with no letter of the class next to it."""
    quoted = F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return (term != "") & F.regexp_like(text, F.concat(F.lit(f"(?<![{letters}])"), quoted, F.lit(f"(?![{letters}])")))


def contains_term(text: Column, term: Column) -> Column:
    return _bounded(normalize(text), normalize(term), "a-z0-9")


def phrase_matches(query: Column, term: Column) -> Column:
    """Bounded phrase, or the term's stems in a row, or both of two stems in any order."""
    q, t = stems(query), stems(term)
    n = F.size(t)
    in_a_row = F.exists(F.sequence(F.lit(1), F.greatest(F.size(q), F.lit(1))), lambda i: F.slice(q, i, F.greatest(n, F.lit(1))) == t)
    both = (n == 2) & F.forall(t, lambda s: F.array_contains(q, s))
    return _bounded(normalize(query), normalize(term), LETTERS) | ((n > 0) & (in_a_row | both))


def find_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """``queries(query_id, query)`` with ``terms(term, equivalents, term_pos)``: matched terms in order,
    longest first. The glossary is a fixed list of a few hundred rows, checked before it is broadcast."""
    if terms.limit(10_001).count() > 10_000:
        raise ValueError("a glossary of more than 10000 terms is not broadcast")
    hits = queries.join(F.broadcast(terms), phrase_matches(F.col("query"), F.col("term")))
    order = F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("o"), "term_pos", "term", "equivalents")))
    found = hits.groupBy("query_id").agg(order.alias("hits"))
    none = F.expr("cast(array() as array<string>)")
    out = queries.join(found, "query_id", "left")
    matched = F.coalesce(F.transform("hits", lambda h: h["term"]), none)
    added = F.coalesce(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["equivalents"]))), none)
    return out.select(*queries.columns, matched.alias("matched_terms"), added.alias("added_terms"), F.transform("hits", lambda h: h["equivalents"]).alias("equivalent_lists"))


def expand(query: Column, added: Column) -> Column:
    """The query and each new equivalent once."""
    return F.when(F.size(added) > 0, F.concat_ws(" ", F.trim(query), F.array_join(added, " "))).otherwise(F.trim(query))


def restore_anchors(rewritten: Column, equivalent_lists: Column) -> Column:
    """Append the first equivalent of every matched term of which the rewrite holds none."""
    missing = F.filter(F.coalesce(equivalent_lists, F.expr("cast(array() as array<array<string>>)")), lambda e: (F.size(e) > 0) & ~F.exists(e, lambda t: contains_term(rewritten, t)))
    anchors = F.array_distinct(F.transform(missing, lambda e: F.element_at(e, 1)))
    return F.trim(F.concat_ws(" ", F.trim(rewritten), F.array_join(anchors, " ")))


def process_queries(queries: DataFrame, terms: DataFrame, rewrite: Column | None = None) -> DataFrame:
    """original, rewritten and expanded query with matched and added terms. Without a rewrite column the query itself counts as the rewrite. A blank query raises."""
    found = find_terms(queries, terms)
    text = F.col("query") if rewrite is None else restore_anchors(rewrite, F.col("equivalent_lists"))
    checked = F.when(F.trim(text_or_empty(F.col("query"))) == "", F.raise_error(F.lit("empty query"))).otherwise(F.col("query"))
    unique = F.array_distinct(F.concat(F.array(F.trim(text)), F.col("added_terms")))
    return found.select("query_id", checked.alias("original_query"), F.trim(text).alias("rewritten_query"), F.array_join(unique, " ").alias("expanded_query"), "matched_terms", "added_terms")


def glossary_lines(matched: DataFrame, otherwise: str = "") -> DataFrame:
    """One text a query: ``- term => equivalent, equivalent`` per matched term; ``otherwise`` where none matched."""
    lines = F.zip_with("matched_terms", F.coalesce("equivalent_lists", F.expr("cast(array() as array<array<string>>)")), lambda t, e: F.concat(F.lit("- "), t, F.lit(" => "), F.array_join(e, ", ")))
    return matched.select("query_id", F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit(otherwise)).alias("glossary"))
