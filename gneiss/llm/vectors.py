"""Vectors as rows: which take part, and numpy views of Arrow columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int | None = None):
    """float64 rows of a list column without nulls; shorter lists are padded with zeros."""
    import numpy as np

    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0)) if width is None else width
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def unit(x):
    """Rows scaled to length one. The largest component comes out first, so tiny and huge rows survive."""
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0).clip(min=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)).clip(min=1e-300)


def sample(rows: DataFrame, vec_col: str, n_rows: int, most: int, seed: int):
    """About ``most`` unit rows at most, by a hash of the vector (the bound holds whatever the table's size)."""
    part = min(1.0, most / max(1, n_rows))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), vec_col), 11) / F.lit(float(1 << 53))
    table = rows.where(draw < part).select(vec_col, F.xxhash64(F.lit(seed), vec_col).alias("h")).toArrow().sort_by("h")
    return unit(matrix(table.column(0).combine_chunks()))
