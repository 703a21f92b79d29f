"""Hooks for models: embedders, rerankers, rewriters, generators. Each wraps a Python function of texts in an
iterator pandas UDF, made once per worker by its factory; without a model the caller uses plain columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embedder(factory: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """UDF text -> array<double>."""
    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            out = model(texts.fillna("").tolist())
            if len(out) != len(texts):
                raise ValueError("the model returned another number of vectors")
            yield pd.Series(out)

    return embed


def scorer(factory: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 16):
    """UDF (query, text) -> double, in batches of ``batch``; a model that returns another number raises."""
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for q, t in batches:
            out: list[float] = []
            for i in range(0, len(q), batch):
                part = model(q[i : i + batch].tolist(), t[i : i + batch].tolist())
                if len(part) != len(q[i : i + batch]):
                    raise ValueError("the model returned another number of scores")
                out += part
            yield pd.Series(out, dtype="float64")

    return score


def rewriter(factory: Callable[[], Callable[[list[str]], list[str]]]):
    """UDF text -> text; an empty rewrite raises."""
    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            out = pd.Series(model(texts.fillna("").tolist()))
            if (out.str.strip() == "").any():
                raise ValueError("the model returned an empty text")
            yield out

    return rewrite


def token_counter(factory: Callable[[], Callable[[list[str]], list[int]]]):
    """UDF text -> number of tokens, for chunkers that count with a model's tokenizer instead of a quarter of the characters."""
    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            out = model(texts.fillna("").tolist())
            if len(out) != len(texts):
                raise ValueError("the counter returned another number of counts")
            yield pd.Series(out, dtype="int32")

    return count


def compare(contexts: DataFrame, variants: DataFrame, generate) -> DataFrame:
    """Every context answered by every variant (a handful of rows): query_id, variant, answer."""
    if variants.limit(101).count() > 100:
        raise ValueError("more than 100 variants are no comparison")
    return contexts.crossJoin(F.broadcast(variants)).withColumn("answer", generate)
