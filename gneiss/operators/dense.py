"""Exact nearest neighbours over stored vectors, by cosine distance.

``knn`` is an expression form for small pools, checked for their size. ``knn_blocks`` multiplies blocks
of vectors with blocks of queries in Arrow batches: queries are dealt into blocks of a fixed size and
every block meets every shard of vectors, so no side has to fit a broadcast; a task holds its queries
and their best ``n`` so far. ``ranks_of`` counts nearer vectors the same way instead of ordering them: those between two targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine


SMALL_POOL = 10_000


def knn(vectors: DataFrame, queries: DataFrame, n: int = 10, skip_self: bool = False) -> DataFrame:
    """``vectors(chunk_id, vec)``, ``queries(query_id, qvec)`` -> query_id, chunk_id, rank, distance. All pairs are
    made, so more than ``SMALL_POOL`` queries raise."""
    if queries.limit(SMALL_POOL + 1).count() > SMALL_POOL:
        raise ValueError(f"more than {SMALL_POOL} queries are for knn_blocks")
    pairs = queries.join(vectors, F.col("chunk_id") != F.col("query_id") if skip_self else F.lit(True))
    near = pairs.select("query_id", "chunk_id", (1 - cosine(F.col("vec"), F.col("qvec"))).alias("distance"))
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "chunk_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "chunk_id", "rank", "distance")


def _dealt(vectors: DataFrame, queries: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Rows (shard, block, kind, id, v, marks) sorted so that a task sees a block's queries (kind 0), then a shard's vectors."""
    copies = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    own = lambda column, many: F.pmod(F.xxhash64(column), F.lit(many)).cast("int")
    row = lambda kind, key, vec, marks: (F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), marks.alias("marks"))
    marks = F.col("marks") if "marks" in queries.columns else F.lit(None)
    held = vectors.select(own("chunk_id", shards).alias("shard"), copies(blocks).alias("block"), *row(1, "chunk_id", "vec", F.lit(None).cast("array<double>")))
    asked = queries.select(copies(shards).alias("shard"), own("query_id", blocks).alias("block"), *row(0, "query_id", "qvec", marks.cast("array<double>")))
    where = ["shard", "block"]
    return asked.unionByName(held).repartition(shards * blocks, *where).sortWithinPartitions(*where, "kind")


def _blocks(batches: Iterator[pa.RecordBatch], start, meet, close) -> Iterator[pa.RecordBatch]:
    """Run ``start(ids, unit rows, marks)`` for each block's queries, ``meet(state, ids, unit rows)`` for its vectors
    batch by batch, and yield ``close(state)`` at its end."""
    import numpy as np

    key, held, state = None, [], None
    for batch in batches:
        shard, block, kind, ids = (batch.column(i).to_numpy() for i in range(4))
        if not len(ids):
            continue
        x = batch.column(4).flatten().to_numpy().reshape(len(ids), -1)
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        change = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1)]
        for s, e in zip(change, [*change[1:], len(ids)], strict=True):
            if (shard[s], block[s]) != key:
                if state is not None:
                    yield close(state)
                key, held, state = (shard[s], block[s]), [], None
            if kind[s] == 0:
                held.append((ids[s:e], x[s:e], batch.column(5).slice(s, e - s).to_pylist()))
            elif held:
                if state is None:
                    state = start(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [m for h in held for m in h[2]])
                for at in range(s, e, 4096):
                    meet(state, ids[at : min(at + 4096, e)], x[at : min(at + 4096, e)])
    if state is not None:
        yield close(state)


def knn_blocks(vectors: DataFrame, queries: DataFrame, n: int = 10, skip_self: bool = False, shards: int | None = None, blocks: int = 1) -> DataFrame:
    """The same result for large pools. Vectors have one length; ids are integers."""
    shards = shards or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def start(ids, rows, _) -> dict:
        import numpy as np

        return {"q": ids, "rows": rows, "id": np.zeros((len(ids), 0), np.int64), "far": np.zeros((len(ids), 0))}

    def meet(state: dict, ids, x) -> None:
        import numpy as np

        far = 1 - state["rows"] @ x.T
        if skip_self:
            far[state["q"][:, None] == ids[None]] = np.inf
        far, every = np.concatenate([state["far"], far], axis=1), np.concatenate([state["id"], np.broadcast_to(ids, far.shape)], axis=1)
        best = np.lexsort((every, np.round(far, 9)), axis=1)[:, :n]
        state["far"], state["id"] = np.take_along_axis(far, best, 1), np.take_along_axis(every, best, 1)

    def close(state: dict) -> pa.RecordBatch:
        import numpy as np

        real = np.isfinite(state["far"])
        q = np.broadcast_to(state["q"][:, None], real.shape)
        return pa.RecordBatch.from_arrays([pa.array(q[real]), pa.array(state["id"][real]), pa.array(state["far"][real])], ["query_id", "chunk_id", "distance"])

    near = _dealt(vectors, queries, shards, blocks).mapInArrow(lambda batches: _blocks(batches, start, meet, close), "query_id long, chunk_id long, distance double")
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "chunk_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "chunk_id", "rank", "distance")


def ranks_of(vectors: DataFrame, queries: DataFrame, targets: DataFrame, skip_self: bool = False, shards: int | None = None, blocks: int = 1) -> DataFrame:
    """Full-ranking ranks of ``targets(query_id, chunk_id)`` among all vectors, by counting the nearer ones."""
    shards = shards or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = targets.select("query_id", "chunk_id").distinct().join(queries, "query_id").join(vectors, "chunk_id")
    if skip_self:
        pairs = pairs.where("query_id != chunk_id")
    pairs = pairs.select("query_id", "chunk_id", (1 - cosine(F.col("vec"), F.col("qvec"))).alias("distance"))
    marked = queries.join(pairs.groupBy("query_id").agg(F.flatten(F.collect_list(F.array(F.col("chunk_id").cast("double"), F.col("distance")))).alias("marks")), "query_id")

    def start(ids, rows, marks) -> dict:
        import numpy as np

        # complex numbers are ordered by distance, then id
        marks = [np.array(m).reshape(-1, 2) for m in marks]
        return {"q": ids, "rows": rows, "marks": [np.sort(np.round(m[:, 1], 9) + 1j * m[:, 0]) for m in marks], "n": [np.zeros(len(m) + 1, np.int64) for m in marks]}

    def meet(state: dict, ids, x) -> None:
        import numpy as np

        far = np.round(1 - state["rows"] @ x.T, 9)
        if skip_self:
            far[state["q"][:, None] == ids[None]] = np.inf
        for near, marks, n in zip(far, state["marks"], state["n"], strict=True):
            real = np.isfinite(near)
            at, seen = np.searchsorted(marks, near[real] + 1j * ids[real], side="right"), ids[real]
            n += np.bincount(at, minlength=len(n))
            # a target whose two distances round apart is not before itself
            for i in np.flatnonzero(np.isin(seen, marks.imag)):
                own = int(np.flatnonzero(marks.imag == seen[i])[0])
                if at[i] <= own:
                    n[own] -= 1
                    n[own + 1] += 1

    def close(state: dict) -> pa.RecordBatch:
        import numpy as np

        found = [np.zeros(0, np.int64), *[m.imag.astype(np.int64) for m in state["marks"]]]
        counts = [np.zeros(0, np.int64), *[np.cumsum(n)[:-1] for n in state["n"]]]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(state["q"], [len(m) for m in state["marks"]])), pa.array(np.concatenate(found)), pa.array(np.concatenate(counts))], ["query_id", "chunk_id", "n"])

    nearer = _dealt(vectors, marked, shards, blocks).mapInArrow(lambda batches: _blocks(batches, start, meet, close), "query_id long, chunk_id long, n long")
    counts = nearer.groupBy("query_id", "chunk_id").agg((F.sum("n") + 1).cast("int").alias("rank"))
    return counts.join(pairs, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "rank", "distance")


def lookup(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors of the given ids; null vectors are left out."""
    return vectors.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").where("vec is not null")
