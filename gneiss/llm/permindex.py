"""Operator 8: approximate nearest neighbours by a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order. Vectors are dealt into shards;
each shard posts its vectors in one inverted file per pivot. Queries walk the files of their own
pivots and sum what shared pivots save of the footrule distance (a pivot missing from a prefix
counts as at its end). Each shard ranks its vectors by footrule distance and reranks the nearest
``share`` of them, ties at the border included, by cosine in double precision on the original
vectors. The share is calibrated on the sample as the part of the ranking in which ``recall`` of the
true neighbours are found; neighbours only get nearer as the table grows. Lengths with at most
``exact_rows`` vectors need no pivots: all of them are reranked.

Orders are computed once a vector. Queries are dealt into blocks and meet every shard, so a task
holds one shard and streams queries. Vectors of each length are a class of their own, with pivots,
share, shards and blocks of their own.

Defined results: vectors that are null, zero or hold null or non-finite components, or have a null
vec_id, take no part; vectors meet those of their own length only; equal scores go to the smaller
vec_id; repeated rows count once, and a vec_id with several vectors asks with all of them and is
found by the nearest of them, so neighbours are distinct ids; rows with the query's own vec_id are
its own and no candidates; fewer candidates than ``k`` are all returned; very large and very small
components are scaled by powers of two, which changes no cosine; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import matrix, unit, usable


def orders(x, pivots, prefix: int):
    """The ``prefix`` nearest pivots of each row, nearest first."""
    import numpy as np

    near = -(unit(x) @ pivots.T)
    top = np.argpartition(near, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.broadcast_to(np.arange(len(pivots)), near.shape)
    return np.take_along_axis(top, np.take_along_axis(near, top, 1).argsort(axis=1, kind="stable"), 1).astype(np.int16)


def scaled(x):
    """Rows times a power of two that brings the largest component near one: exact, and no square overflows."""
    import numpy as np

    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


class InvertedFiles:
    """Postings (row, position) of each pivot for one shard."""

    def __init__(self, perms, n_pivots: int):
        import numpy as np

        n, self.prefix = perms.shape
        flat = perms.ravel()
        order = flat.argsort(kind="stable")
        edges = np.searchsorted(flat[order], np.arange(n_pivots + 1))
        rows, place = order // self.prefix, (order % self.prefix).astype(np.int32)
        self.files = [(rows[a:b], place[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        self.n = n

    def saved(self, perms):
        """For each query's order, what every row saves of the largest footrule distance (halved)."""
        import numpy as np

        out = np.zeros((len(perms), self.n), np.int32)
        flat = perms.ravel()
        order = flat.argsort(kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0]) if len(flat) else []
        for s, e in zip(first, [*first[1:], len(flat)], strict=True):
            asked, at = order[s:e] // self.prefix, (order[s:e] % self.prefix).astype(np.int32)
            rows, place = self.files[flat[order[s]]]
            out[asked[:, None], rows[None, :]] += self.prefix - np.maximum(place[None, :], at[:, None])
        return out


def calibrate(x, pivots, prefix: int, k: int, recall: float, queries: int = 400) -> float:
    """Share of a footrule ranking of the sample that holds ``recall`` of its true neighbours."""
    import numpy as np

    perms = orders(x, pivots, prefix)
    index, found = InvertedFiles(perms, len(pivots)), []
    asked = np.flatnonzero(~(x[:, None, 0] == pivots[None, :, 0]).any(axis=1))[:queries]  # a pivot would be its own nearest
    for i, saved in zip(asked, index.saved(perms[asked]), strict=True):
        near = x @ x[i]
        near[i], saved[i] = -2, -1
        found += [(saved >= saved[j]).sum() for j in near.argpartition(-k)[-k:]]
    return float(np.quantile(found, recall)) / len(x)


def samples(rows: DataFrame, sizes: dict[int, int], most: int) -> Iterator[tuple[int, object]]:
    """(width, unit rows) of each length, at most about ``most`` by a hash of the vector; lengths with few rows share a job."""
    import numpy as np

    draw = F.shiftrightunsigned(F.xxhash64(F.lit(8), "vec"), 11) / F.lit(float(1 << 53))
    groups: list[list[int]] = []
    load = most
    for width, n in sorted(sizes.items()):
        if load + min(n, most) > most:
            groups.append([])
            load = 0
        groups[-1].append(width)
        load += min(n, most)
    for group in groups:
        part = rows.sparkSession.createDataFrame([(w, min(1.0, most / sizes[w])) for w in group], "width int, part double")
        table = rows.join(F.broadcast(part), "width").where(draw < F.col("part")).select("width", "vec", F.xxhash64(F.lit(8), "vec").alias("h")).toArrow().sort_by("h")
        widths, vecs = table.column(0).to_numpy(), table.column(1).combine_chunks()
        for width in group:
            yield width, unit(matrix(vecs.take(pa.array(np.flatnonzero(widths == width))), width))


def _represent(models: dict[int, tuple]):
    """mapInArrow function that adds each row's order of pivots, as bytes of 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            width = batch.column(1).to_numpy()
            perm: list = [b""] * len(width)
            for w in np.unique(width):
                if int(w) in models:
                    pivots, prefix, _ = models[int(w)]
                    at = np.flatnonzero(width == w)
                    for s in range(0, len(at), 4096):
                        own = at[s : s + 4096]
                        found = orders(matrix(batch.column(2).take(pa.array(own)), int(w)), pivots, prefix)
                        for i, row in zip(own, found, strict=True):
                            perm[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(perm, pa.binary())], ["vec_id", "width", "vec", "perm"])

    return run


def _search(models: dict[int, tuple[int, int, float]], k: int, at_once: int = 64):
    """mapInArrow function over rows sorted by (width, shard, block, kind): the shard's vectors, then queries.
    ``models`` holds (number of pivots, prefix, share) by width."""

    def best_of(q_id, q, ids, x, norms, near):
        import numpy as np

        score = (x[near] * q).sum(axis=1) / (norms[near] * np.sqrt((q * q).sum()))
        order = np.lexsort((ids[near], -score))
        best = order[:k]
        if len(np.unique(ids[near[best]])) < len(best):
            own, first = np.unique(ids[near[order]], return_index=True)
            best = order[np.sort(first)[:k]]
        return [q_id] * len(best), ids[near[best]].tolist(), score[best].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        key, held, index = None, [], None
        ids = x = norms = None
        for batch in batches:
            width, shard, block, kind, vec = (batch.column(i).to_numpy() for i in range(5))
            out: list[list] = [[], [], []]
            changes = (np.diff(width) != 0) | (np.diff(shard) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)
            change = [0, *(np.flatnonzero(changes) + 1)] if len(vec) else []
            for s, e in zip(change, [*change[1:], len(vec)], strict=True):
                if (width[s], shard[s], block[s]) != key:
                    key, held, index, x = (width[s], shard[s], block[s]), [], None, None
                model = models.get(int(width[s]))
                rows = scaled(matrix(batch.column(5).slice(s, e - s), int(width[s])))
                perms = np.frombuffer(b"".join(batch.column(6).slice(s, e - s).to_pylist()), np.int16).reshape(e - s, -1)
                if kind[s] == 0:
                    held.append((vec[s:e], rows, perms))
                    continue
                if not held:
                    continue
                if x is None:
                    ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    norms = np.sqrt((x * x).sum(axis=1))
                    if model:
                        index = InvertedFiles(np.concatenate([h[2] for h in held]), model[0])
                depth = max(k + 1, int(np.ceil(model[2] * len(ids)))) if model else len(ids)
                for at in range(0, e - s, at_once):
                    saved = index.saved(perms[at : at + at_once]) if index and depth < len(ids) else None
                    for i in range(at, min(at + at_once, e - s)):
                        other = ids != vec[s + i]
                        if saved is None:
                            near = np.flatnonzero(other)
                        else:
                            rank = np.where(other, saved[i - at], -1)
                            edge = np.partition(rank, len(rank) - depth)[len(rank) - depth]
                            near = np.flatnonzero((rank >= edge) & other)
                        for column, part in zip(out, best_of(vec[s + i], rows[i], ids, x, norms, near), strict=True):
                            column += part
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def fit(rows: DataFrame, sizes: dict[int, int], k: int, n_pivots: int, prefix: int, recall: float, fit_sample: int) -> dict[int, tuple]:
    """(pivots, prefix, share) by width, from a sample of at most about ``fit_sample`` rows of a width."""
    models = {}
    for width, x in samples(rows, sizes, fit_sample):
        many = min(n_pivots, len(x) // 4)
        pivots = x[:: len(x) // many][:many]
        depth = min(prefix, len(pivots))
        models[width] = (pivots, depth, calibrate(x, pivots, depth, k, recall))
    return models


def search(vectors: DataFrame, is_query: Column, k: int = 5, n_pivots: int = 1024, prefix: int = 64, recall: float = 0.96, fit_sample: int = 20_000, shard_rows: int = 16_384, block_rows: int = 4096, exact_rows: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec"))).dropDuplicates(["vec_id", "vec"])
    rows = cut(rows.select("vec_id", F.size("vec").alias("width"), "vec"), "ann-rows")
    counts = rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if(is_query).alias("asked")).collect()
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    models = fit(rows, {r["width"]: r["n"] for r in counts if r["n"] > exact_rows}, k, n_pivots, prefix, recall, fit_sample)
    dealing = [(r["width"], -(-r["n"] // shard_rows), -(-max(1, r["asked"]) // block_rows)) for r in counts]
    rows = rows.mapInArrow(_represent(models), "vec_id long, width int, vec array<double>, perm binary")
    rows = rows.join(F.broadcast(spark.createDataFrame(dealing, "width int, shards int, blocks int")), "width")
    copies = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    own = lambda many: F.pmod(F.xxhash64("vec_id", "vec"), F.col(many)).cast("int")
    held = rows.select("width", own("shards").alias("shard"), copies("blocks").alias("block"), F.lit(0).alias("kind"), "vec_id", "vec", "perm")
    asked = rows.where(is_query).select("width", copies("shards").alias("shard"), own("blocks").alias("block"), F.lit(1).alias("kind"), "vec_id", "vec", "perm")
    where = ["width", "shard", "block"]
    parts = min(sum(s * b for _, s, b in dealing), 20_000)
    dealt = held.unionByName(asked).repartition(parts, *where).sortWithinPartitions(*where, "kind")
    steps = {w: (len(pivots), depth, share) for w, (pivots, depth, share) in models.items()}
    found = cut(dealt.mapInArrow(_search(steps, k), "query_id long, vec_id long, score double"), "ann-found")
    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
