"""Context assembly: reference filter, first-wins duplicates, cut, formatting; and the answer's states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import citation_tags, citations_valid, display, is_out_of_scope, is_reference_only, squeeze

#: Texts of answers that are not generated.
OUT_OF_SCOPE_ANSWER = "out_of_scope"
NO_EVIDENCE_ANSWER = "insufficient_evidence"


def first_wins(items: Column) -> Column:
    """Keep array items ``struct(id, key, ...)`` whose id and key were both not kept before; a dropped
    item does not register its keys. Null ids never collide."""
    kind = F.filter(items, lambda _: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        seen = F.exists(kept, lambda y: (y["id"] == x["id"]) | (y["key"] == x["key"]))
        return F.when(F.coalesce(seen, F.lit(False)), kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(items, kind, step)


def assemble(ranked: DataFrame, max_sources: int = 3, exclude_reference_only: bool = True) -> DataFrame:
    """One row a query from ``ranked(query_id, rank, chunk_id, text, document_id, page, section,
    subsection, source_type)``: sources, context_text and counters. Lists are a query's final picks."""
    flagged = ranked.withColumn("reference", is_reference_only(F.col("text"), F.col("source_type"), F.col("section"), F.col("subsection")) if exclude_reference_only else F.lit(False))
    item = F.struct("rank", F.col("chunk_id").alias("id"), F.lower(squeeze(F.col("text"))).alias("key"), squeeze(F.col("text")).alias("text"), "document_id", "page", "section", "subsection", "source_type", "reference")
    packed = flagged.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kept = F.filter("all", lambda x: ~x["reference"])
    packed = packed.withColumn("kept", kept).withColumn("unique", first_wins(F.col("kept")))
    packed = packed.withColumn("sources", F.slice("unique", 1, max_sources))
    block = lambda s, i: F.concat(F.format_string("[SOURCE %d]\n", i + 1), F.lit("Document: "), display(s["document_id"]), F.lit("\nPage: "), display(s["page"]), F.lit("\nSection: "), display(s["section"]), F.lit("\n"), s["text"], F.format_string("\n[/SOURCE %d]", i + 1))
    return packed.select(
        "query_id", "sources", F.array_join(F.transform("sources", block), "\n\n").alias("context_text"), F.size("sources").alias("source_count"), F.size("all").alias("input_count"),
        (F.size("all") - F.size("kept")).alias("reference_filtered_count"), (F.size("kept") - F.size("unique")).alias("duplicate_filtered_count"), F.lit(max_sources).alias("max_sources"),
    )


def english_prompt(query: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer only from the sources and cite them as [SOURCE n].\n\nQuestion: "), query, F.lit("\n\nSources:\n"), context)


def answer_state(query: Column, source_count: Column, answer: Column, translated: Column) -> Column:
    """struct(state, answer): out of scope, no evidence, uncited, translation changed the tags, grounded."""
    same = citation_tags(answer) == citation_tags(translated)
    result = lambda state, text: F.struct(F.lit(state).alias("state"), text.alias("answer"))
    return (
        F.when(is_out_of_scope(query), result("out_of_scope", F.lit(OUT_OF_SCOPE_ANSWER)))
        .when(F.coalesce(source_count, F.lit(0)) == 0, result("insufficient", F.lit(NO_EVIDENCE_ANSWER)))
        .when(~citations_valid(answer, source_count), result("insufficient", F.lit(NO_EVIDENCE_ANSWER)))
        .when(~F.coalesce(same, F.lit(False)), result("untranslated", answer))
        .otherwise(result("grounded", translated))
    )


def flag_summary(answers: DataFrame) -> DataFrame:
    """Sums of answer states over ``answers(state)``."""
    return answers.agg(F.count("*").alias("answers"), *[F.count_if(F.col("state") == s).alias(s) for s in ("grounded", "insufficient", "out_of_scope", "untranslated")])
