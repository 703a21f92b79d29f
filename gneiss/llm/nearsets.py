"""Operator 10 at a similarity: SimHash near-duplicates of whole texts by shingle sets.

``simhash`` links fingerprints of 64 bits at a fixed number of bits, which is exact but finds only
copies with an edit or two. Here the rule is a similarity: texts whose sets of ``shingle``-word
shingles have a Jaccard similarity of ``similarity`` or more. Sets that similar have a cosine of at
least ``2J / (1 + J)``, so their SimHash bits differ with a probability of at most
``acos(2J / (1 + J)) / pi`` (0.15 for 0.8). The steps are those of the operator:

1. fingerprints of ``64 * lanes`` bits, over the distinct shingles of a whole text;
2. blocks: seeded permutations of the bits are cut into blocks of ``log2(fingerprints)`` bits, as many
   blocks as a pair at exactly the asked similarity needs to share one with probability ``recall``
   (more similar pairs need far fewer). As many blocks as would leave no pair out by the pigeonhole
   principle alone (335 for 2048 bits) would be 6 bits wide, so blocks are drawn at a stated recall;
3. joins on blocks, then the Hamming distance of whole fingerprints. The bound is the expected
   distance at ``similarity`` plus one and a half standard deviations: with 2048 bits it keeps 93% of
   pairs at exactly 0.8 and all but a few from 0.82 up, and lets in half of those at 0.77.

Every fingerprint is posted in every block and no block is capped. In a block, one leader is compared
with all others, links become components, and only fingerprints outside the leader's component go on
to the next round, where four times as many lead. So a block of a million copies costs a million
comparisons, not all pairs.

After the first round, what is left of a block of more than ``large`` fingerprints is mostly texts that
share a passage or a base and are too unlike to link, whose pairs would grow with the square of their number.
There shingles are counted: one in no other text of these blocks is in no intersection, so two texts
have at most the sum over 32 hash classes of the lesser of both counts of other shingles in common. Texts that
are too unlike any of the block's by that leave it, and pairs that are go no further. The bound is exact:
no pair at ``similarity`` or more is left out.

Defined results: texts are lower-cased (A-Z) and split at ASCII white space; fewer words than
``shingle`` are one shingle; null and empty texts are one class; equal sets are one class; repeated
doc_ids and rows each return a row; a null doc_id never wins the minimum while another is present; an
empty table returns no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, drop_shuffles, keyed
from .components import components

CHUNK = 1 << 15
#: A posting: block, fingerprint, its first 64 bits, and once they are known ``n`` and ``c`` of ``shared_parts``.
ROW = ("key", "node", "word", "n", "c")
#: Counts of ``c``: by the last bits of shingles, so that the least of two counts bounds what two texts have in common.
SLOTS = 32
#: Odd multipliers of the finaliser that turns one hash into many (splitmix64).
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def shingle_set(text: bytes | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct XXH64 values of the shingles of one UTF-8 text."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    total = max(1, len(words) - shingle + 1)
    parts = [
        np.unique(np.array([digest(join(words[i : i + shingle]), seed) for i in range(at, min(total, at + CHUNK))], np.uint64))
        for at in range(0, total, CHUNK)
    ]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def wide_fingerprint(hashes: np.ndarray, lanes: int = 32) -> np.ndarray:
    """SimHash of a sorted set of 64-bit hashes as ``lanes`` signed 64-bit integers; zero for an empty set.

    Ties fall to the bit of the smallest hash, which sets this similar mostly share."""
    out = np.zeros((lanes, 8), np.uint8)
    if not len(hashes):
        return out.view(">i8").ravel().astype(np.int64)
    for lane in range(lanes):
        counts, least = np.zeros(64, np.int64), None
        step = np.uint64(GOLDEN * (lane + 1) % (1 << 64))
        for at in range(0, len(hashes), CHUNK):
            z = hashes[at : at + CHUNK] + step
            z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
            bits = np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1)
            least = bits[0].astype(np.int64) if least is None else least
            for low in range(0, len(bits), 255):  # sums of up to 255 rows fit in a byte
                counts += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
        out[lane] = np.packbits(counts * 2 + least > len(hashes))
    return out.view(">i8").ravel().astype(np.int64)


def differing(similarity: float) -> float:
    """Probability that a SimHash bit differs for sets of this Jaccard similarity, at most."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _bound(bits: int, p: float, deviations: float) -> int:
    return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def block_plan(fingerprints: int, bits: int, similarity: float, recall: float, seed: int) -> np.ndarray:
    """Bit positions of each block, one row a block."""
    width = min(48, bits, max(4, math.ceil(math.log2(max(2, fingerprints)))))
    shared = (1 - differing(similarity)) ** width
    wanted = 1 if shared >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - shared))
    rng, rows, a_round = np.random.default_rng(seed), [], bits // width
    for _ in range(math.ceil(wanted / a_round)):
        rows.append(rng.permutation(bits)[: a_round * width].reshape(a_round, width))
    return np.concatenate(rows)[:wanted]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, lanes: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [wide_fingerprint(shingle_set(x.as_py(), shingle, seed), lanes).tolist() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "mark", "fp"])

    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    return chosen.mapInArrow(run, "doc_id long, mark long, fp array<long>")


def shared_parts(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``(node, n, c)`` of ``texts(node long, text string)``, one row a node: numbers of distinct shingles, and by their last
    bits (``SLOTS``) of those that another of these texts has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = shingle_set(text.as_py(), shingle, seed).view(np.int64)
                sizes = np.bincount(own & (SLOTS - 1), minlength=SLOTS)
                some = np.flatnonzero(sizes)
                # rows of their own carry the sizes
                h, n = np.r_[own, node * SLOTS + some], np.r_[np.zeros(len(own), np.int64), sizes[some]]
                for at in range(0, len(h), CHUNK):
                    part = slice(at, at + CHUNK)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[part]), node)), pa.array(h[part]), pa.array(n[part])], ["node", "h", "n"])

    rows = texts.select("node", "text").mapInArrow(run, "node long, h long, n long").groupBy("h", "n").agg(F.count("*").alias("times"), F.min("node").alias("node"))
    slot, worth = F.col("h").bitwiseAND(SLOTS - 1), F.when(F.col("n") > 0, F.col("n")).otherwise(-1)
    counts = F.array(*[F.sum(F.when(slot == i, worth).otherwise(0)).cast("int") for i in range(SLOTS)])
    return rows.where("times = 1").groupBy("node").agg(F.sum("n").alias("n"), counts.alias("c"))


def postings(classes: DataFrame, plan: np.ndarray, lanes: int) -> DataFrame:
    """``(key, node, word)``: every fingerprint at each of its blocks, with its first 64 bits."""
    count, width = plan.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(width, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words = np.array(part.column(1).flatten()).reshape(-1, lanes)
                bits = np.unpackbits(words.astype(">i8").view(np.uint8).reshape(len(words), -1), axis=1)
                keys = np.stack([(bits[:, rows].astype(np.int64) @ weights) * count + k for k, rows in enumerate(plan)], axis=1)
                node = np.repeat(np.array(part.column(0)), count)
                word = np.repeat(words[:, 0], count)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node), pa.array(word)], ["key", "node", "word"])

    return classes.select("node", "fp").mapInArrow(run, "key long, node long, word long")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _room(shared: Column, n_a: Column, n_b: Column, similarity: float) -> Column:
    """False if sets of ``n_a`` and ``n_b`` with at most ``shared`` in common are too unlike; unknown counts say nothing."""
    return F.coalesce(shared * (1 + similarity) >= similarity * (n_a + n_b) - 1e-6, F.lit(True))


def _with_parts(posted: DataFrame, waiting: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: float, large: int, shingle: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Tables of ``posted`` and ``waiting`` in the blocks that wait, with the ``n`` and ``c`` of what is in a block where over
    ``large`` wait, without what no text of its block has room for."""
    hot = waiting.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > large).select("key")
    members = cut(posted.join(hot, "key", "left_semi").select("key", "node"), "near-members")
    parts = cut(shared_parts(texts(members.select("node").distinct()), shingle, seed), "near-parts")
    sized = members.join(parts, "node", "left")
    low = sized.groupBy("key").agg(F.min(F.coalesce("n", F.lit(0))).alias("low"))
    none = ~_room(sum((F.col("c")[i] for i in range(1, SLOTS)), F.col("c")[0]), F.col("n"), F.col("low"), similarity)
    apart = cut(sized.join(low, "key").where(none).select("key", "node"), "near-apart")
    kept = lambda rows: rows.select("key", "node", "word").join(apart, ["key", "node"], "left_anti").join(parts, "node", "left").select(*ROW)
    found = cut(kept(posted.join(waiting.select("key").distinct(), "key", "left_semi")), "near-open"), cut(kept(waiting), "near-waiting")
    discard(members, parts, apart)
    return found


def links(
    classes: DataFrame,
    texts: Callable[[DataFrame], DataFrame],
    shingle: int = 5,
    lanes: int = 32,
    similarity: float = 0.8,
    recall: float = 0.95,
    seed: int = 42,
    small: int = 8,
    large: int = 8,
    task_postings: int = 300_000,
) -> DataFrame:
    """``(id, component)`` of the nodes of ``classes(node long, fp array<long>)`` that have a link; ``texts`` gives
    ``(node, text)`` for a table of nodes.

    Blocks of up to ``small`` open fingerprints are finished in one round; that changes no result."""
    spark, bits, p = classes.sparkSession, 64 * lanes, differing(similarity)
    whole, loose = _bound(bits, p, 1.5), _bound(64, _bound(bits, p, 1.5) / bits, 4)
    count = classes.count()
    plan = block_plan(count, bits, similarity, recall, seed)
    # a task counts the keys it posts in memory, so tasks are dealt by the number of postings
    every = postings(classes.repartition(1 + count * len(plan) // task_postings, "node"), plan, lanes)
    shared = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    posted = every.join(shared, "key").withColumn("n", F.lit(None).cast("long")).withColumn("c", F.lit(None).cast("array<int>"))
    posted = cut(posted, "near-posted")
    del every, shared
    drop_shuffles(spark)
    waiting, roots, leaders = posted, None, 1
    while True:
        sizes = waiting.groupBy("key").agg(F.count("*").alias("m"), F.min(F.xxhash64("node")).alias("first"))
        chance = F.pmod(F.xxhash64("node", F.lit(leaders)), F.col("m")) < leaders
        finish = F.lit(leaders > 1) & (F.col("m") <= small)
        lead = waiting.join(sizes, "key").where(finish | (F.xxhash64("node") == F.col("first")) | (F.lit(leaders > 1) & chance))
        lead = cut(lead.select("key", F.col("node").alias("a"), F.col("word").alias("w"), F.col("n").alias("n_a"), F.col("c").alias("c_a"), (finish | (F.col("m") <= 2) & F.lit(leaders == 1)).alias("last")), "near-lead")
        pairs = posted.join(lead, "key").where((F.col("a") != F.col("node")) & (_apart(F.col("w"), F.col("word")) <= loose))
        common = [F.when(F.col("c").isNotNull() & F.col("c_a").isNotNull(), F.least(F.col("c")[i], F.col("c_a")[i])) for i in range(SLOTS)]
        pairs = pairs.where(_room(sum(common[1:], common[0]), F.col("n_a"), F.col("n"), similarity))
        pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        if roots is None:
            pairs = pairs.withColumn("of_a", F.col("a")).withColumn("of_b", F.col("b"))
        else:  # pairs within one component say nothing new
            of = lambda side: roots.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}"))
            pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")).where("of_a != of_b")
        at = lambda side: classes.select(F.col("node").alias(side), F.col("fp").alias(f"fp_{side}"))
        far = sum((_apart(F.col("fp_a")[i], F.col("fp_b")[i]) for i in range(1, lanes)), _apart(F.col("fp_a")[0], F.col("fp_b")[0]))
        # links between components so far; what they join is renamed
        new = cut(pairs.join(at("a"), "a").join(at("b"), "b").where(far <= whole).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), "near-edges")
        before = roots
        if roots is None:
            roots = cut(components(new), "near-roots")
        elif not new.isEmpty():
            step = cut(components(new), "near-step")
            moved = roots.join(step.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
            roots = cut(moved.unionByName(step.join(roots.select("id"), "id", "left_anti")), "near-roots")
            discard(before, step)
        # what is neither in a leader's component nor in a finished block goes on
        named = roots.select(F.col("id").alias("node"), F.col("component").alias("root"))
        root = F.coalesce("root", "node").alias("root")
        done = lead.select("key", F.col("a").alias("node")).join(named, "node", "left").select("key", root).distinct()
        rest = waiting.join(lead.where("last").select("key").distinct(), "key", "left_anti")
        rest = rest.join(named, "node", "left").select(*ROW, root).join(done, ["key", "root"], "left_anti")
        old, waiting = waiting, cut(rest.select(*ROW), "near-waiting")
        discard(lead, new, *([] if old is posted else [old]))
        if leaders == 1:
            old, all_posted = waiting, posted
            posted, waiting = _with_parts(posted, waiting, texts, similarity, large, shingle, seed)
            discard(old, all_posted)
            del all_posted
        del sizes, pairs, named, done, rest, old
        drop_shuffles(spark)
        if waiting.isEmpty():
            discard(posted, waiting)
            return roots
        leaders *= 4


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    lanes: int = 32,
    recall: float = 0.95,
    seed: int = 42,
    small: int = 8,
    large: int = 8,
) -> DataFrame:
    """``(doc_id, component_id)``: one row per input row; component_id is the smallest doc_id reachable by links."""
    of_doc = cut(fingerprints(docs, id_col, text_col, shingle, lanes, seed), "near-docs")
    classes = keyed(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("mark").alias("mark")), "near-classes", "node")
    text = F.col(text_col).cast("string")

    def texts(nodes: DataFrame) -> DataFrame:
        asked = classes.join(nodes, "node", "left_semi").select("node", "mark")
        return docs.select(text.alias("text"), F.xxhash64(text).alias("mark")).join(asked, "mark").select("node", "text").dropDuplicates(["node"])

    named = links(classes, texts, shingle, lanes, similarity, recall, seed, small, large).select(F.col("id").alias("node"), F.col("component").alias("root"))
    rooted = cut(classes.join(named, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root")), "near-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return of_doc.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "component_id")
