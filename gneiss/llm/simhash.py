"""Operator 10: SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into ``max_distance + 2`` blocks. Two fingerprints that differ in at
most ``max_distance`` bits agree on at least two whole blocks, so joining on every pair of blocks
loses no link. Block groups of ordinary size are joined and verified by Hamming distance. A group
over ``hot`` fingerprints (many near copies) would give a quadratic number of pairs, so there, for
distance 2, each fingerprint is posted at itself and at its one-bit neighbours outside the shared
blocks: two fingerprints are within two bits exactly if they share such a midpoint. A midpoint has
a bounded number of fingerprints, all of them linked to each other, so one star replaces the pairs.
Both ways are exact; no group is capped or dropped.

Defined results: null or empty text (no words) has fingerprint zero; fewer words than ``shingle``
give one shingle of all words; repeated doc_ids and repeated rows each return a row; a null doc_id
is kept and never wins the minimum while another id is present; an empty table returns no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one UTF-8 text, as a signed 64-bit integer."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    total = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, total, CHUNK):
        part = [digest(join(words[i : i + shingle]), seed) for i in range(at, min(total, at + CHUNK))]
        counts += np.unpackbits(np.array(part, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    value = int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp long)`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [fingerprint(x.as_py(), shingle, seed) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _blocks(max_distance: int) -> list[tuple[int, int]]:
    """(key bits mask, index) of each pair of blocks, the masks as signed longs."""
    n = max_distance + 2
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    return [(signed(masks[i] | masks[j]), k) for k, (i, j) in enumerate(combinations(range(n), 2))]


def links(fps: DataFrame, max_distance: int = 2, hot: int = 48) -> DataFrame:
    """Edges ``(a, b)`` over distinct fingerprints ``fps(fp)`` whose components are those of the
    link relation "at most ``max_distance`` differing bits"."""
    pairs = _blocks(max_distance)
    posted = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for m, k in pairs])).alias("p")).select("fp", "p.k", "p.key")
    sizes = posted.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    posted = posted.join(sizes, ["k", "key"])
    plain = posted if max_distance != 2 else posted.where(F.col("n") <= hot)
    left, right = plain.select("k", "key", F.col("fp").alias("a")), plain.select("k", "key", F.col("fp").alias("b"))
    near: Column = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    found = left.join(right, ["k", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    if max_distance != 2:
        return found
    bit = lambda b: (1 << b) - (1 << 64) * (b == 63)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(bit(b)).cast("long") for b in range(64)])
    mask = F.element_at(F.array(*[F.lit(m).cast("long") for m, _ in pairs]), F.col("k") + 1)
    mids = posted.where(F.col("n") > hot).select("k", "key", "fp", F.explode(F.filter(flips, lambda x: x.bitwiseAND(mask) == 0)).alias("flip"))
    stars = mids.groupBy("k", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")).agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    star = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b")
    return found.unionByName(star)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, max_distance: int = 2, hot: int = 48) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per input row; component_id is the smallest doc_id reachable by links."""
    of_doc = cut(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-docs")
    classes = cut(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), max_distance, hot)).select(F.col("id").alias("fp"), F.col("component").alias("root"))
    rooted = cut(classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return of_doc.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
