"""Operator 6: bigram language model with Katz backoff.

Good-Turing discounts apply to counts of one to ``CUT``; larger counts lose ``DELTA``, so every
context keeps mass to back off with. The backoff weight of a context is exactly (mass left) /
(1 - unigram mass of the words seen after it); unigrams back off to one unknown word the same way.
A token is evaluated recursively: its bigram if that was seen, else its context's weight times its
word, and that word's unigram if it was seen, else the unknown word.
``log P(text)`` splits into sums that different shuffles can make:

* by second word: counts of bigrams and words, so all of the discounted and unigram terms;
* by context: the backoff weight, needed only for tokens whose bigram was never seen;
* by document: the sums.

Tokens travel once, as compressed blocks of word hashes dealt by second word (frequent words by
their bigram), so that no word, however frequent, fills one task. Bigrams travel on by context
(those of frequent contexts stay, only their sums travel). Words keep 64 bits of hash, words in the
place of a context ``CONTEXT_BITS``. Work in a block is sorting and slicing, linear in its tokens and
in the number of blocks it meets. Counts cover every training document; nothing is capped.

The model is stored as tables in the shared folder: words and bigrams with their counts, one file a
hash bucket of the context; ``KatzModel`` reads them with probabilities and backoff weights, and
``evaluate`` looks any text up in them.

Defined results: null text is empty and has the one token "end"; repeated rows each give a row; null
doc_ids train and are not held out; without training tokens all scores are 0; an empty table gives
no rows; very long texts may exceed a block, which then holds one text; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_shuffles

CUT, DELTA = 5, 0.5
#: Keys that no word's hash is meant to take: the end token and the context before the first token.
END, START = 1, 2
CONTEXT_BITS = 48
#: Sums of logarithms of a document travel as whole multiples of 2 ** -28, a context's mass as such of 2 ** -44.
FIXED, UNIT, MASS_UNIT = ("base", "part", "mass"), 1 << 28, 1 << 44
BLOB = "p int, kind int, chunk long, blob binary"
#: Blocks, and as rows of their own the bigrams (kind 7).
TABLE = BLOB + ", context long, word long, n long"


@lru_cache(maxsize=1)
def _press():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(**arrays) -> bytes:
    """Arrays by name: word hashes and reals as they are, contexts in six bytes, counts and fixed-point sums
    (``FIXED``) as bytes of equal weight together, compressed."""
    import numpy as np

    about, plain, small = [], [], []
    for name, a in arrays.items():
        if name == "context":
            about.append((name, "context", len(a)))
            plain.append(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8)[:, : CONTEXT_BITS // 8].tobytes())
        elif name in FIXED:
            a = np.ascontiguousarray((a << 1) ^ (a >> 63))
            about.append((name, "fixed", len(a)))
            small.append(a.view(np.uint8).reshape(-1, 8).T.tobytes())
        elif a.dtype.kind == "u" and a.dtype.itemsize < 8 or a.dtype.kind == "b":
            a = a.astype(np.min_scalar_type(int(a.max(initial=0)))) if a.dtype.kind == "u" else a.astype(np.uint8)
            about.append((name, a.dtype.str, len(a)))
            small.append(a.tobytes() if a.itemsize == 1 else a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
        else:
            about.append((name, a.dtype.str, len(a)))
            plain.append(a.tobytes())
    return pickle.dumps((about, _press()[0].compress(b"".join(small)), b"".join(plain)), protocol=5)


def _unpack(blob: bytes) -> dict:
    import numpy as np

    about, small, plain = pickle.loads(blob)
    small, out, at, at_small = _press()[1].decompress(small), {}, 0, 0
    for name, kind, n in about:
        if kind == "context":
            size = CONTEXT_BITS // 8
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :size] = np.frombuffer(plain, np.uint8, n * size, at).reshape(n, size)
            out[name] = wide.view(np.uint64).ravel()
            at += n * size
            continue
        if kind == "fixed":
            raw = np.ascontiguousarray(np.frombuffer(small, np.uint8, n * 8, at_small).reshape(8, -1).T).view(np.uint64).ravel()
            out[name] = (raw >> np.uint64(1)).view(np.int64) ^ -(raw & np.uint64(1)).view(np.int64)
            at_small += n * 8
            continue
        dtype = np.dtype(kind)
        if dtype.kind == "u" and dtype.itemsize < 8:
            raw = np.frombuffer(small, np.uint8, n * dtype.itemsize, at_small)
            out[name] = raw.view(dtype) if dtype.itemsize == 1 else np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()
            at_small += n * dtype.itemsize
        else:
            out[name] = np.frombuffer(plain, dtype, n, at)
            at += n * dtype.itemsize
    return out


def _small(counts):
    """Counts that ``_pack`` compresses, unless they need more than four bytes."""
    import numpy as np

    return counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["p", "kind", "chunk", "blob"])


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 7 is 2; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): counts of training words by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        def flush(own: Counter) -> pa.RecordBatch:
            h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.fromiter(own.values(), np.int64, len(own)))], ["h", "n"])

        own: Counter = Counter()
        texts = 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                own.update((text.as_py() or b"").lower().split())
                texts += 1
            if len(own) > 600_000:
                yield flush(own)
                own.clear()
        if own:
            yield flush(own)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.int64()), pa.array([texts], pa.int64())], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def discounts(of_count: list[int]) -> list[float]:
    """Discounted counts of 1..CUT from the numbers of types seen 1..CUT+1 times (index 0 is unused)."""
    n = [float(x) for x in of_count]
    tail = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    out = [0.0]
    for r in range(1, CUT + 1):
        star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        value = (star - r * tail) / (1 - tail) if tail < 1 else 0.0
        out.append(value if 0 < value < r else r - DELTA)
    return out


def _spread(h, parts: int):
    import numpy as np

    return ((h & np.uint64(0x7FFFFFFF)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)


def _short(h):
    """Hashes as contexts."""
    import numpy as np

    return h & np.uint64((1 << CONTEXT_BITS) - 1)


def _place(h2, h1, hot, parts: int):
    """Partition of a token: by its word; by its bigram where the word is frequent."""
    import numpy as np

    often = np.isin(h2, hot)
    return np.where(often, _spread((h2 ^ (h1 * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(20), parts), _spread(h2, parts))


def _firsts(*keys):
    """Positions where any of the sorted keys changes."""
    import numpy as np

    if not len(keys[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _ungapped(gap, runs):
    """Values from their gaps; the first of each run is a value itself."""
    import numpy as np

    value = np.cumsum(gap, dtype=np.int64)
    first = np.cumsum(runs, dtype=np.int64) - runs
    return value - np.repeat(value[first] - gap[first], runs)


def _deal(hot, parts: int, tokens_at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        index: dict[bytes, int] = {}
        digest, task, chunk = xxhash.xxh64_intdigest, TaskContext.get().partitionId(), 0
        ids, flags, texts, n_tokens = [], [], [], 0

        def hashes(words: list[bytes]) -> list[int]:
            if len(index) > 500_000:
                index.clear()
            out = list(map(index.get, words))
            for i, h in enumerate(out):
                if h is None:
                    out[i] = index[words[i]] = digest(words[i])
            return out

        def flush() -> Iterator[pa.RecordBatch]:
            name = (task << 20) + chunk
            size = np.array([len(t) for t in texts], np.int64)
            h2 = np.concatenate(texts)
            h1 = np.empty_like(h2)
            h1[1:] = _short(h2[:-1])
            h1[np.cumsum(size) - size] = START
            doc = np.repeat(np.arange(len(size), dtype=np.uint32), size)
            place = _place(h2, h1, hot, parts).astype(np.int32)
            # contexts of each partition once, and every token's place among them
            order = np.lexsort((h1, place))
            first = _firsts(place[order], h1[order])
            before, before_at = h1[order[first]], np.searchsorted(place[order[first]], np.arange(parts + 1))
            which = np.empty(len(h2), np.int32)
            which[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, len(h2)]))
            del h1, order
            order = np.lexsort((h2, place))
            first = _firsts(place[order], h2[order])
            words, count = h2[order[first]], np.diff(np.r_[first, len(h2)]).astype(np.uint32)
            edges, word_at = np.searchsorted(place[order], np.arange(parts + 1)), np.searchsorted(place[order[first]], np.arange(parts + 1))
            which = (which[order] - before_at[place[order]]).astype(np.uint32)
            gap = np.diff(doc[order].astype(np.int64), prepend=0)
            gap[first] = doc[order[first]]  # documents rise within a word
            train = np.array(flags, bool)
            null = np.array([i is None for i in ids], bool)
            info = _pack(ids=np.array([i or 0 for i in ids], np.int64), null=null, train=train, size=size)
            out = [(name % parts, 5, name, info)]
            for p in np.flatnonzero(np.diff(edges)):
                at, w, c = slice(edges[p], edges[p + 1]), slice(word_at[p], word_at[p + 1]), slice(before_at[p], before_at[p + 1])
                out.append((int(p), 1, name, _pack(words=words[w], n=count[w], context=before[c], which=which[at], gap=gap[at].astype(np.uint32), train=train)))
            for i in range(0, len(out), 16):
                yield _rows(out[i : i + 16])

        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                ids.append(doc_id)
                flags.append(not held)
                texts.append(np.array([*hashes((text.as_py() or b"").lower().split()), END], np.uint64))
                n_tokens += len(texts[-1])
                if n_tokens >= tokens_at_once:
                    yield from flush()
                    chunk += 1
                    ids, flags, texts, n_tokens = [], [], [], 0
        if ids:
            yield from flush()

    return run


def _words_of(hot, parts: int, at_once: int = 1_000_000):
    """Blocks of word counts for the partitions that hold their tokens; frequent words are known to all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            held.clear()
            rare = ~np.isin(h, hot)
            h, n = h[rare], n[rare]
            place = _spread(h, parts)
            order = place.argsort(kind="stable")
            h, n, edges = h[order], n[order], np.searchsorted(place[order], np.arange(parts + 1))
            out = [(int(p), 0, 0, _pack(h=h[edges[p] : edges[p + 1]], n=n[edges[p] : edges[p + 1]])) for p in np.flatnonzero(np.diff(edges))]
            for i in range(0, len(out), 64):
                yield _rows(out[i : i + 64])

        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            if sum(len(x[0]) for x in held) >= at_once:
                yield from flush()
        if held:
            yield from flush()

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, dict]]]]:
    """Unpacked blocks of each p, from rows that are sorted by p."""
    now, held = None, []
    for batch in batches:
        for p, kind, chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if p != now and held:
                yield now, held
                held = []
            now = p
            held.append((kind, chunk, _unpack(blob.as_py())))
    if held:
        yield now, held


def _grouped(h, columns):
    """Sums of columns by h: (distinct h, sums)."""
    import numpy as np

    order = h.argsort(kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0]) if len(h) else np.zeros(0, np.int64)
    return h[order][first], [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns]


def _count(unigram, hot, hot_n, parts: int, back: int):
    """Blocks of tokens -> sums for documents (kind 0), bigrams with the tokens that back off from their
    contexts (1), the same of frequent contexts as sums and tokens (3), their bigrams (2) and the numbers of
    bigrams by count (4). ``unigram(c)`` is the log10 probability of a word seen ``c`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hot_short = _short(hot)
        for p, blocks in _groups(batches):
            out = [(chunk % back, 5, chunk, _pack(**b)) for kind, chunk, b in blocks if kind == 5]
            known = [b for kind, _, b in blocks if kind == 0]
            tokens = [(chunk, b) for kind, chunk, b in blocks if kind == 1]
            del blocks
            if not tokens:
                yield _rows(out)
                continue
            u_h, u_n = np.concatenate([hot, *[b["h"] for b in known]]), np.concatenate([hot_n, *[b["n"] for b in known]])
            order = u_h.argsort()
            u_h, u_n = u_h[order], u_n[order]
            del known
            n_docs = np.array([len(b["train"]) for _, b in tokens])
            base = np.cumsum(n_docs) - n_docs
            train = np.concatenate([b["train"] for _, b in tokens]).astype(bool)
            h2 = np.concatenate([np.repeat(b["words"], b["n"]) for _, b in tokens])
            h1 = np.concatenate([b["context"][b["which"]] for _, b in tokens])
            doc = np.concatenate([_ungapped(b["gap"], b["n"]).astype(np.int32) + np.int32(at) for at, (_, b) in zip(base, tokens, strict=True)])
            chunks = [chunk for chunk, _ in tokens]
            del tokens
            order = np.lexsort((h1, h2))
            h2, h1, doc = h2[order], h1[order], doc[order]
            del order
            first = _firsts(h2, h1)
            width = np.diff(np.r_[first, len(h2)])
            w2, w1 = h2[first], h1[first]
            del h2
            c12 = np.add.reduceat(train[doc].astype(np.int64), first)
            at = np.minimum(np.searchsorted(u_h, w2), max(0, len(u_h) - 1))
            c2 = np.where(u_h[at] == w2, u_n[at], 0) if len(u_h) else np.zeros(len(w2), np.int64)
            log_u = unigram(c2)
            part = np.where(c12 > CUT, np.log10(np.maximum(c12 - DELTA, DELTA)), np.where(c12 == 0, log_u, 0.0))
            part -= np.where((w2 != END) & (c2 > 0), np.log10(np.maximum(c2, 1)), 0.0)
            total = int(n_docs.sum())
            sums = {name: np.rint(np.bincount(doc, np.repeat(value, width), total) * UNIT).astype(np.int64) for name, value in (("base", np.log10(c2 + 1.0)), ("part", part))}
            for name, flag in [("known", c2 > 0), *[(f"n{r}", c12 == r) for r in range(1, CUT + 1)]]:
                sums[name] = np.bincount(doc[np.repeat(flag, width)], minlength=total).astype(np.uint32)
            some = np.bincount(doc, minlength=total) > 0
            for chunk, a, n in zip(chunks, base, n_docs, strict=True):
                mine = np.flatnonzero(some[a : a + n])
                out.append((chunk % back, 0, chunk, _pack(doc=mine.astype(np.uint32), **{k: v[a : a + n][mine] for k, v in sums.items()})))
            del sums
            seen = c12 > 0
            g_n, g_1, g_2, g_c2, g_u = c12[seen], w1[seen], w2[seen], c2[seen], log_u[seen]
            event = np.repeat(c12 == 0, width)
            e_1, e_doc = h1[event], doc[event]
            del h1, doc
            names_of = np.array(chunks, np.int64)

            def tokens_of(at) -> dict:
                """Tokens that back off, by context."""
                at = at[e_1[at].argsort(kind="stable")]
                first = _firsts(e_1[at])
                chunk = np.searchsorted(base, e_doc[at], side="right") - 1
                return {"e": e_1[at][first], "times": np.diff(np.r_[first, len(at)]).astype(np.uint32), "chunks": names_of, "chunk": chunk.astype(np.uint32), "doc": (e_doc[at] - base[chunk]).astype(np.uint32)}

            def bigrams_of(at) -> dict:
                """Bigrams in the order of their second words."""
                first = _firsts(g_2[at])
                return {"context": g_1[at], "count": _small(g_n[at]), "words": g_2[at][first], "runs": np.diff(np.r_[first, len(at)]).astype(np.uint32), "known": _small(g_c2[at][first])}

            g_hot, e_hot = np.isin(g_1, hot_short), np.isin(e_1, hot_short)
            at = np.flatnonzero(g_hot)
            if len(at) or e_hot.any():
                h, values = _grouped(g_1[at], _sums(g_n[at], g_u[at]))
                stats = {k: np.rint(v * MASS_UNIT).astype(np.int64) if k == "mass" else _small(v) for k, v in zip(STATS, values, strict=True)}
                out.append((p % back, 3, 0, _pack(h=h, **stats, **tokens_of(np.flatnonzero(e_hot)))))
                out.append((p % back, 2, 0, _pack(**bigrams_of(at))))
            g_at, e_at = np.flatnonzero(~g_hot), np.flatnonzero(~e_hot)
            g_q, e_q = _spread(g_1[g_at], back), _spread(e_1[e_at], back)
            g_order, e_order = g_q.argsort(kind="stable"), e_q.argsort(kind="stable")
            g_edges, e_edges = (np.searchsorted(q[o], np.arange(back + 1)) for q, o in ((g_q, g_order), (e_q, e_order)))
            for q in np.flatnonzero(np.diff(g_edges) + np.diff(e_edges)):
                out.append((int(q), 1, 0, _pack(**bigrams_of(g_at[g_order[g_edges[q] : g_edges[q + 1]]]), **tokens_of(e_at[e_order[e_edges[q] : e_edges[q + 1]]]))))
            out.append((p % back, 4, 0, _pack(r=np.bincount(np.minimum(c12, CUT + 2), minlength=CUT + 3)[: CUT + 2].astype(np.int64))))
            for i in range(0, len(out), 16):
                yield _rows(out[i : i + 16])

    return run


STATS = [*[f"m{r}" for r in range(1, CUT + 1)], "many", "big", "mass"]


def _sums(n, log_u) -> list:
    """Columns of ``STATS`` for bigrams with counts ``n`` of words with log10 probability ``log_u``."""
    import numpy as np

    return [*[(n == r).astype(np.int64) for r in range(1, CUT + 1)], (n > CUT).astype(np.int64), np.where(n > CUT, n, 0), 10.0**log_u]


def _gather(unigram):
    """Sums of documents and of contexts over all blocks, and the bigrams as rows."""

    def bigram_rows(p: int, context, word, n) -> pa.RecordBatch:
        size = len(n)
        columns = [pa.array([p] * size, pa.int32()), pa.array([7] * size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(x.view("int64")) for x in (context, word, n)]], ["p", "kind", "chunk", "blob", "context", "word", "n"])

    def block_rows(out: list[tuple]) -> pa.RecordBatch:
        rows = _rows(out)
        return pa.RecordBatch.from_arrays([*rows.columns, *[pa.nulls(rows.num_rows, pa.int64())] * 3], [*rows.schema.names, "context", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for q, blocks in _groups(batches):
            out = [(q, kind, chunk, _pack(**b)) for kind, chunk, b in blocks if kind in (3, 4)]
            mine: dict[int, list] = {}
            for kind, c, b in blocks:
                if kind in (0, 5):
                    mine.setdefault(c, []).append((kind, b))
            for chunk, own in mine.items():
                info = next(b for kind, b in own if kind == 5)
                total = {}
                for kind, b in own:
                    if kind == 0:
                        for k, v in b.items():
                            if k != "doc":
                                total.setdefault(k, np.zeros(len(info["ids"]), np.int64))
                                total[k][b["doc"]] += v
                out.append((q, 0, chunk, _pack(**info, **total)))
            del mine
            for b in (b for kind, _, b in blocks if kind == 2):
                yield bigram_rows(q, b["context"], np.repeat(b["words"], b["runs"]), b["count"].astype(np.int64))
            parts = [b for kind, _, b in blocks if kind == 1]
            del blocks
            if parts:
                context, n = np.concatenate([b["context"] for b in parts]), np.concatenate([b["count"] for b in parts]).astype(np.int64)
                word, c2 = (np.concatenate([np.repeat(b[k], b["runs"]) for b in parts]) for k in ("words", "known"))
                order = np.lexsort((word, context))
                context, n, word, c2 = context[order], n[order], word[order], c2[order]
                for s in range(0, len(n), 1 << 16):
                    yield bigram_rows(q, context[s : s + (1 << 16)], word[s : s + (1 << 16)], n[s : s + (1 << 16)])
                h, values = _grouped(context, _sums(n, unigram(c2.astype(np.int64))))
                del order, word, c2, context, n
                e = np.concatenate([np.repeat(b["e"], b["times"]) for b in parts])
                at = np.minimum(np.searchsorted(h, e), max(0, len(h) - 1))
                real = (h[at] == e) if len(h) else np.zeros(len(e), bool)  # a context without counts backs off with weight one
                chunk, doc = (np.concatenate(x)[real] for x in ([b["chunks"][b["chunk"]] for b in parts], [b["doc"] for b in parts]))
                used, which = np.unique(at[real], return_inverse=True)
                order = np.lexsort((doc, chunk, which))
                stats = {k: np.rint(v[used] * MASS_UNIT).astype(np.int64) if k == "mass" else _small(v[used]) for k, v in zip(STATS, values, strict=True)}
                out.append((q, 1, 0, _pack(**stats, times=np.bincount(which, minlength=len(used)).astype(np.uint32), names=np.unique(chunk), chunk=np.unique(chunk, return_inverse=True)[1][order].astype(np.uint32), doc=doc[order].astype(np.uint32))))
            for i in range(0, len(out), 16):
                yield block_rows(out[i : i + 16])

    return run


def backoff(stats: dict, star: list[float]):
    """log10 of (context's count x its backoff weight), for arrays of context sums."""
    import numpy as np

    seen = sum(r * stats[f"m{r}"] for r in range(1, CUT + 1)) + stats["big"]
    kept = sum(star[r] * stats[f"m{r}"] for r in range(1, CUT + 1)) + stats["big"] - DELTA * stats["many"]
    return np.log10(np.maximum(seen - kept, 1e-12) / np.maximum(1 - stats["mass"], 1e-12))


@dataclass
class KatzModel:
    """Tables of a fitted model. ``words(h, n, log_p)``: 64-bit hashes of words, ``END`` for the end.
    ``bigrams(context, word, n, log_p)``. ``contexts(context, total, backoff)``: log10 of the weight that
    words not seen after a context are multiplied by. ``unknown``: log10 probability of an unseen word."""

    words: DataFrame
    bigrams: DataFrame
    contexts: DataFrame
    unknown: float


def _model(words: DataFrame, table: DataFrame, star: list[float], star2: list[float], total: int, unknown: float) -> KatzModel:
    kept = lambda n, s: F.coalesce(*[F.when(n == r, F.lit(float(s[r]))) for r in range(1, CUT + 1)], n - DELTA)
    known = words.select("h", "n", F.log10(kept(F.col("n"), star) / max(total, 1)).alias("log_p"))
    seen = table.where("kind = 7").select("context", "word", "n").withColumn("kept", kept(F.col("n"), star2))
    of_context = seen.join(known.select(F.col("h").alias("word"), F.pow(F.lit(10.0), "log_p").alias("p")), "word").groupBy("context")
    contexts = of_context.agg(F.sum("n").alias("total"), F.sum("kept").alias("kept"), F.sum("p").alias("mass"))
    weight = F.log10(F.greatest(1 - F.col("kept") / F.col("total"), F.lit(1e-12)) / F.greatest(1 - F.col("mass"), F.lit(1e-12)))
    contexts = cut(contexts.select("context", "total", weight.alias("backoff")), "katz-contexts")
    bigrams = seen.join(contexts, "context").select("context", "word", "n", F.log10(F.col("kept") / F.col("total")).alias("log_p"))
    return KatzModel(known, bigrams, contexts, unknown)


def fit(docs: DataFrame, **options) -> KatzModel:
    """Model of the documents that are not held out."""
    return _score(docs, **options)[1]()


def evaluate(docs: DataFrame, model: KatzModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) of any texts, each token looked up in the model's tables: its bigram, else its
    context's weight and its word, else the unknown word. One row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                h = np.array([*map(xxhash.xxh64_intdigest, (text.as_py() or b"").lower().split()), END], np.uint64)
                for s in range(0, len(h), 50_000):
                    own = h[s : s + 50_000]
                    before = np.r_[h[s - 1] if s else np.uint64(START), own[:-1]].astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(own), pa.int64()), pa.array(_short(before).view(np.int64)), pa.array(own.view(np.int64))], ["row", "context", "word"])

    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "katz-asked")
    asked = rows.select("row", "text").mapInArrow(run, "row long, context long, word long").groupBy("row", "context", "word").agg(F.count("*").alias("times"))
    found = asked.join(model.bigrams.select("context", "word", F.col("log_p").alias("pair")), ["context", "word"], "left")
    found = found.join(model.words.select(F.col("h").alias("word"), F.col("log_p").alias("single")), "word", "left").join(model.contexts.select("context", "backoff"), "context", "left")
    log_p = F.coalesce("pair", F.coalesce("backoff", F.lit(0.0)) + F.coalesce("single", F.lit(model.unknown)))
    sums = found.groupBy("row").agg(F.sum("times").alias("n_tokens"), F.sum(log_p * F.col("times")).alias("score"))
    return rows.select("row", "doc_id").join(sums, "row").select("doc_id", "n_tokens", "score")


def score(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per document."""
    return _score(docs, **options)[0]


def _score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 2_400_000, deal_tokens: int = 1_700_000):
    """Scores, and a function that gives the model's tables."""
    import numpy as np

    spark = docs.sparkSession
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", held_out(F.col("doc_id")).alias("held"), "text")
    words = cut(_word_counts(docs.where("not held")), "katz-words")
    drop_shuffles(spark)
    head = words.agg(F.sum("n"), F.count("*"), *[F.count_if(F.col("n") == r) for r in range(1, CUT + 2)], F.sum(F.when(F.col("n") > CUT, F.col("n"))), F.max(F.when(F.col("h") == END, F.col("n")))).first()
    total, distinct, texts = head[0] or 0, head[1], head[-1] or 0
    star = discounts([0, *head[2 : CUT + 3]])
    many = distinct - sum(head[2 : CUT + 2])
    kept = sum(star[r] * head[1 + r] for r in range(1, CUT + 1)) + (head[-2] or 0) - DELTA * many
    logs = np.log10(np.array([max(total - kept, 1e-9), *star[1:]]) / total) if total else np.zeros(CUT + 1)

    def unigram(c):
        return np.where(c > CUT, np.log10(np.maximum(c - DELTA, DELTA) / max(total, 1)), logs[np.minimum(c, CUT)])

    parts = max(1, -(-total * 7 // 6 // block_tokens))
    # words that would fill a quarter of a block: at most four a block by count, far fewer by Zipf's law
    often = words.where(F.col("n") > total / (4 * parts)).select("h", "n").collect() if parts > 1 else []
    hot, hot_n = np.array([r["h"] for r in often], np.int64).view(np.uint64), np.array([r["n"] for r in often], np.int64)
    blocks = docs.mapInArrow(_deal(hot, parts, deal_tokens), BLOB).unionByName(words.mapInArrow(_words_of(hot, parts), BLOB))
    counted = blocks.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_count(unigram, hot, hot_n, parts, parts), BLOB)
    table = cut(counted.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_gather(unigram), TABLE), "katz-tables")
    drop_shuffles(spark)
    by_count = sum((_unpack(r["blob"])["r"] for r in table.where("kind = 4").select("blob").toLocalIterator()), np.zeros(CUT + 2, np.int64))
    star2 = discounts(by_count.tolist())

    def hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                b = _unpack(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(b["h"].view(np.int64)), *[pa.array(b[k] / (MASS_UNIT if k == "mass" else 1.0)) for k in STATS]], ["h", *STATS])

    hot_stats = table.where("kind = 3").select("blob").mapInArrow(hot_rows, "h long, " + ", ".join(f"{k} double" for k in STATS)).groupBy("h").agg(*[F.sum(k).alias(k) for k in STATS]).toPandas().sort_values("h")
    hot_h = hot_stats["h"].to_numpy(np.int64)
    hot_weight = backoff({k: hot_stats[k].to_numpy() for k in STATS}, star2) if len(hot_h) else np.zeros(0)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = _unpack(blob.as_py())
                if kind == 1:
                    stats = {k: b[k] / MASS_UNIT if k == "mass" else b[k].astype(np.int64) for k in STATS}
                    chunk, value = b["names"][b["chunk"]], np.repeat(backoff(stats, star2), b["times"])
                else:
                    e = np.repeat(b["e"], b["times"]).view(np.int64)
                    at = np.minimum(np.searchsorted(hot_h, e), max(0, len(hot_h) - 1))
                    chunk, value = b["chunks"][b["chunk"]], np.where(hot_h[at] == e, hot_weight[at], 0.0) if len(hot_h) else np.zeros(len(e))
                doc, order = b["doc"], chunk.argsort(kind="stable")
                edges = [0, *(np.flatnonzero(np.diff(chunk[order])) + 1), len(order)]
                out = []
                for s, e in zip(edges, edges[1:]):
                    if s < e:
                        at, (sums,) = _grouped(doc[order[s:e]], [value[order[s:e]]])
                        out.append((0, 6, int(chunk[order[s]]), _pack(doc=at, more=sums)))
                for i in range(0, len(out), 64):
                    yield _rows(out[i : i + 64])

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by chunk: its documents' sums, then what contexts add to them."""
        start = np.log10(texts) if texts else 0.0
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

        def done(b: dict, value) -> pa.RecordBatch:
            floor = b["base"] / UNIT - b["size"] * np.log10(total + distinct + 1)
            columns = [pa.array(b["ids"], mask=b["null"].astype(bool)), pa.array(~b["train"].astype(bool)), pa.array(b["size"]), pa.array(b["known"]), pa.array(floor), pa.array(value)]
            return pa.RecordBatch.from_arrays(columns, names)

        now = value = None
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                b = _unpack(blob.as_py())
                if kind == 0:
                    if now:
                        yield done(now, value)
                    now = b
                    value = b["part"] / UNIT - start + sum(b[f"n{r}"] * np.log10(star2[r]) for r in range(1, CUT + 1))
                else:
                    value[b["doc"]] += b["more"]
        if now:
            yield done(now, value)

    more = table.where("kind in (1, 3)").select("kind", "blob").mapInArrow(unseen, BLOB)
    own = table.where("kind = 0").select("p", "kind", "chunk", "blob").unionByName(more)
    found = own.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(of_docs, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    found = found.withColumn("train_tokens", F.lit(total).cast("long")).select(*[x.split()[0] for x in schema.split(", ")])
    return found, lambda: _model(words, table, star, star2, total, float(logs[0]))
