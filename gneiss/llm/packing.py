"""Operator 9: best-fit packing by exact-complement hashing.

Only the histogram of piece lengths (at most ``capacity`` entries, whatever the corpus) is planned
on the driver. ``SumIndex`` holds, by sum, the single lengths, pairs and triples that add up to it;
entries that have run out are passed over once and for all, since counts only fall. ``plan`` fills
sequences longest piece first: it looks the current gap up as a single, a pair and a triple sum that
fills it exactly under the counts still available, and where there is none takes the longest piece
that fits and tries again. A pattern is used as often as its lengths are available, so every step
uses up a length and the plan has few rows. Pieces then get a rank within their length (counted in
groups salted by a row number, so that neither a length that a third of the pieces share nor a row
that is repeated often is a hot key) and the rank says sequence and offset.

Token ids are those of the byte-level BPE in ``vocab_json``, by the ``tokenizers`` library at its
defaults, without special tokens around a text: added tokens written in a text get their own id.
Texts that hold no added token and no white-space run of ``LONG_RUN`` go through tiktoken's core
with the ranks of the same file, which gives equal ids several times faster; all others go through
the library itself.

Defined results: null text is empty and gives the single id 0; repeated rows and doc_ids each give
their own pieces; null doc_ids stay null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: tiktoken's pattern backtracks over white space and fails near a million in a row.
LONG_RUN = 50_000
SPACES = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoding(vocab_json: str):
    """tiktoken encoding with the ranks of a byte-level BPE file of the tokenizers library."""
    import public_tokenizers
    import tiktoken

    with open(vocab_json, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(vocab_json: str) -> Callable[[str], object]:
    """Ids of a text as the tokenizers library gives them at its defaults, without special tokens around it."""
    from tokenizers import Tokenizer

    fast, whole = _encoding(vocab_json).encode_to_numpy, Tokenizer.from_file(vocab_json)
    with open(vocab_json, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", [])]

    def encode(text: str):
        if any(a in text for a in added) or (len(text) >= LONG_RUN and SPACES.search(text)):
            return whole.encode(text, add_special_tokens=False).ids
        return fast(text, disallowed_special=())

    return encode


def token_pieces(docs: DataFrame, vocab_json: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every text's ids plus ``end_id``; only texts over ``capacity`` are cut, the first piece takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = encoder(vocab_json)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), end_id).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes())), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


class SumIndex:
    """Combinations of one, two and three lengths by their sum, under the counts ``free``.

    The entries of a sum are listed when the sum is first asked for, largest member first, and held by a
    cursor. Counts only fall, so an entry that has run out stays out and its cursor never goes back."""

    def __init__(self, free) -> None:
        self.free = free
        self.pairs: dict[int, list] = {}  # sum -> [cursor, first members]
        self.triples: dict[int, list] = {}  # sum -> [cursor, largest members]

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.free[total] else None

    def _lengths(self, low: int, high: int) -> list[int]:
        import numpy as np

        return (np.flatnonzero(self.free[low : high + 1])[::-1] + low).tolist()

    def pair(self, total: int, besides: int = 0) -> tuple[int, ...] | None:
        """A pair that adds up to ``total`` while one piece of length ``besides`` is spoken for."""
        if total < 2:
            return None
        free = self.free
        if total not in self.pairs:
            self.pairs[total] = [0, [a for a in self._lengths(-(-total // 2), total - 1) if free[total - a]]]
        entry = self.pairs[total]
        at, first = entry
        while at < len(first):
            a, b = first[at], total - first[at]
            if free[a] and free[b] and (a != b or free[a] > 1):
                if free[a] - (a == besides) >= 1 + (a == b) and free[b] - (b == besides) >= 1 + (a == b):
                    return a, b
                at += 1  # only held up by the piece spoken for: it stays in the index
                continue
            if at == entry[0]:
                entry[0] += 1
            at += 1
        return None

    def triple(self, total: int) -> tuple[int, ...] | None:
        if total < 3:
            return None
        if total not in self.triples:
            self.triples[total] = [0, self._lengths(-(-total // 3), total - 2)]
        entry = self.triples[total]
        while entry[0] < len(entry[1]):
            c = entry[1][entry[0]]
            rest = self.pair(total - c, c) if self.free[c] else None
            if rest:
                return (c, *rest)
            entry[0] += 1
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns ``(times, {length: copies})`` that use every piece of the histogram exactly once."""
    import numpy as np

    free = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        free[length] += n
    index = SumIndex(free)
    patterns = []
    while (left := np.flatnonzero(free)).size:
        top = int(left[-1])
        took = {top: 1}
        free[top] -= 1
        gap = capacity - top
        while gap:
            fill = index.exact(gap)
            if not fill:
                fits = np.flatnonzero(free[: gap + 1])
                if not fits.size:
                    break
                fill = (int(fits[-1]),)
            for x in fill:
                took[x] = took.get(x, 0) + 1
                free[x] -= 1
                gap -= x
        times = 1 + min(int(free[x]) // n for x, n in took.items())
        for x, n in took.items():
            free[x] -= n * (times - 1)
        patterns.append((times, took))
    return patterns


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, in rank order: (first rank, first sequence, copies in a sequence, first offset)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for times, took in patterns:
        at = 0
        for length, n in took.items():
            low = used.get(length, 0)
            out.setdefault(length, []).append((low, base, n, at))
            used[length] = low + times * n
            at += n * length
        base += times
    return out


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces."""
    pieces = keyed(pieces, "pieces", "row")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = slots(plan(counts, capacity))
    salts = max(1, math.isqrt(sum(counts.values())))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    run_up = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "salt", F.coalesce(F.sum("n").over(run_up), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tables = {k: np.array(v, dtype=np.int64) for k, v in where.items()}
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, edges) if len(order) else []:
                t = tables[int(length[at[0]])]
                r = t[np.searchsorted(t[:, 0], rank[at], side="right") - 1]
                turn = rank[at] - r[:, 0]
                sequence[at], offset[at] = r[:, 1] + turn // r[:, 2], r[:, 3] + turn % r[:, 2] * length[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab_json: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(token_pieces(docs, vocab_json or default_vocab(), capacity, end_id, id_col, text_col), capacity)
