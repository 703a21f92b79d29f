"""Operator 2: quality classifier by co-training.

Two views of a document learn apart: its text (character and word statistics, hashed words) and its
page metadata (language, source, length, layout). In each round either view scores every unlabelled
document and hands all those it is sure of to the other. At the end both are calibrated on labelled
documents that were kept out of training, their calibrated log-odds are combined by a small logistic
model fitted on others that were kept out, and every document is scored from its whole text.

Only labelled rows are bounded (``labelled`` of them, by a hash of the id, repeated rows counted each). The features of all
unlabelled documents are a table in the shared folder; fits sum its gradients and Hessians where the
rows are, and the driver holds one small matrix a partition. ``share`` and ``pool`` leave no document
out: they bound the weight of what a view hands over in a round (``share`` of the unlabelled
documents a class, counted as ``pool`` at most), so that labelled rows keep their say at any size.

Defined results: null text counts as empty; null metadata is a value of its own; with no labels, or
labels of one class only, every score is 0.5 or that class's smoothed share; null doc_ids are scored
and never used for fitting; repeated rows each give a row; an empty table gives no rows; very long
texts are read whole, in one pass; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WORDS, META, STATS = 256, 96, 16
DELETE_PLAIN = bytes(b for b in range(256) if chr(b).isalnum() or b in b" \n\t\r" or b >= 128)
DIGITS, UPPERS = b"0123456789", bytes(range(65, 91))


def text_features(text: bytes):
    """Statistics of the whole text, then shares of hashed words (square roots)."""
    import numpy as np

    out = np.zeros(STATS + WORDS, np.float32)
    n, words = max(1, len(text)), text.split()
    k = max(1, len(words))
    lines = text.split(b"\n")
    counts = Counter(words)
    symbols = len(text.translate(None, DELETE_PLAIN))
    out[:13] = (
        1, symbols / n, len(text.translate(None, bytes(b for b in range(256) if b not in DIGITS))) / n, len(text.translate(None, bytes(b for b in range(256) if b not in UPPERS))) / n,
        min(n / k, 40) / 10, len(counts) / k, 1 - len(set(lines)) / len(lines), max(counts.values(), default=0) / k,
        sum(w.isalpha() for w in counts) / max(1, len(counts)), np.log1p(k) / 10, sum(c for c in counts.values() if c > 3) / k, text.count(b"|") / k, np.log1p(len(lines)) / 10,
    )
    for word, c in counts.items():
        out[STATS + zlib.crc32(word.lower()) % WORDS] += c
    out[STATS:] = np.sqrt(out[STATS:] / k)
    return out


def meta_features(lang: str | None, source: str | None, text: bytes):
    import numpy as np

    out = np.zeros(META, np.float32)
    out[0] = 1
    size, lines = len(text), text.count(b"\n") + 1
    for slot in (f"l{lang}", f"s{source}", f"n{int(np.log2(size + 1) * 2)}", f"m{int(np.log2(lines))}", f"w{int(np.log2(size / lines + 1))}"):
        out[1 + zlib.crc32(slot.encode()) % (META - 1)] += 1
    return out


def _terms(x, y, weight, w):
    """Gradient and Hessian of the weighted logistic loss."""
    import numpy as np

    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ ((p - y) * weight), (x * (np.maximum(p * (1 - p), 1e-4) * weight)[:, None]).T @ x


def _logistic(x, y, weight, ridge: float = 1.0, steps: int = 12):
    """Weights by damped Newton steps."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        grad, h = _terms(x, y, weight, w)
        w -= np.linalg.solve(h + ridge * np.eye(x.shape[1]), grad + ridge * w)
    return w


def pool_sums(views, past, weights, w, sure: float):
    """What unlabelled rows add: (gradient, Hessian) of either view at ``w``, or, where ``w`` is None,
    how many of each label either view gave in the last round of ``past``.

    ``past`` holds the weights of both views by round. The first round in which a view is sure of a row
    says the label it gives to the other view; ``weights[round, giver, label]`` says what it counts there."""
    import numpy as np

    edge, out, counts = np.log(sure / (1 - sure)), [], np.zeros((2, 2))
    for giver in (0, 1):
        z = np.stack([views[giver] @ r[giver] for r in past], axis=1)
        is_sure = np.abs(z) >= edge
        rows = np.flatnonzero(is_sure.any(axis=1))
        when = is_sure[rows].argmax(axis=1)
        label = (z[rows, when] > 0).astype(int)
        if w is None:
            counts[giver] = np.bincount(label[when == len(past) - 1], minlength=2)
        else:
            out.append(_terms(views[1 - giver][rows], label.astype(float), weights[when, giver, label], w[1 - giver]))
    return counts if w is None else [*out[1], *out[0]]


@dataclass
class CoModel:
    text: object
    meta: object
    calibrate: tuple  # (slope, shift) of either view
    combine: object  # weights of 1, text log-odds, metadata log-odds

    def score(self, text, meta):
        import numpy as np

        a, b = (np.clip((x @ w) * c[0] + c[1], -20, 20) for x, w, c in zip((text, meta), (self.text, self.meta), self.calibrate, strict=True))
        sure = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return sure(a), sure(b), sure(self.combine[0] + self.combine[1] * a + self.combine[2] * b)


def cotrain(text, meta, y, n_pool: int = 0, sums=None, rounds: int = 4, share: float = 0.05, sure: float = 0.95, pool: int = 6000, steps: int = 12) -> CoModel:
    """``y``: 1 or 0. Rows are in hash order, so every eighth is a fair fold; one calibrates, one combines. ``sums(past, weights, w)``
    is ``pool_sums`` over all ``n_pool`` unlabelled rows."""
    import numpy as np

    known = np.arange(len(y))
    fold, last, train = known[::8], known[4::8], known[known % 4 > 0]
    if any(len(np.unique(y[part])) < 2 for part in (train, fold, last)):
        p = (np.sum(y) + 1) / (len(known) + 2)
        return CoModel(np.zeros(text.shape[1]), np.zeros(meta.shape[1]), ((0.0, 0.0), (0.0, 0.0)), np.array([np.log(p / (1 - p)), 0.0, 0.0]))
    views = (text.astype(np.float64), meta.astype(np.float64))
    w = [_logistic(views[v][train], y[train], np.ones(len(train))) for v in (0, 1)]
    past: list[list] = []
    weights = np.zeros((rounds, 2, 2))
    for r in range(rounds if n_pool else 0):
        past.append(list(w))
        fresh = sums(past, weights, None)
        weights[r] = 0.3 * min(1.0, pool / n_pool) * np.minimum(1.0, share * n_pool / np.maximum(fresh, 1))
        if not fresh.any():
            break
        for _ in range(steps):
            found, step = sums(past, weights, w), 0.0
            for v in (0, 1):
                grad, h = _terms(views[v][train], y[train], np.ones(len(train)), w[v])
                move = np.linalg.solve(h + found[2 * v + 1] + np.eye(len(w[v])), grad + found[2 * v] + w[v])
                w[v] = w[v] - move
                step = max(step, float(np.abs(move).max()))
            if step < 1e-3:
                break
    ones = np.ones(len(fold))
    platt = [_logistic(np.c_[ones, views[v][fold] @ w[v]], y[fold], ones, 1e-2) for v in (0, 1)]
    ones = np.ones(len(last))
    both = np.c_[ones, *[np.clip(views[v][last] @ w[v] * platt[v][1] + platt[v][0], -20, 20) for v in (0, 1)]]
    return CoModel(w[0], w[1], tuple((float(c[1]), float(c[0])) for c in platt), _logistic(both, y[last], ones, 1e-2))


def _features(text, lang, source):
    import numpy as np

    raw = [t or b"" for t in text]
    return np.array([text_features(t) for t in raw]).reshape(len(raw), -1), np.array([meta_features(a, b, t) for a, b, t in zip(lang, source, raw, strict=True)]).reshape(len(raw), -1)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 6000, pool: int = 6000, label_col: str = "quality") -> CoModel:
    """``docs(doc_id, text, lang, source)``, ``labels(doc_id, label_col)``. Conflicting labels of an id count as their mean, rounded."""
    import numpy as np

    truth = labels.where(f"doc_id is not null and `{label_col}` is not null").groupBy(F.col("doc_id").alias("id")).agg(F.round(F.avg(label_col)).alias("y"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(2), "doc_id"), 11) / F.lit(float(1 << 53))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                a, b = _features(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(bytes, a)), pa.binary()), pa.array(list(map(bytes, b)), pa.binary())], ["doc_id", "a", "b"])

    made = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    made = made.mapInArrow(run, "doc_id long, a binary, b binary")
    table = cut(made.join(truth, F.col("doc_id") == F.col("id"), "left").select("doc_id", "y", "a", "b"), "cotrain-features")
    n_known, n_all = table.agg(F.count("y"), F.count("*")).first()
    found = table.where(F.col("y").isNotNull() & (draw < min(1.0, labelled / max(1, n_known)))).orderBy(F.xxhash64(F.lit(7), "doc_id"), "a").limit(labelled).toArrow()
    unlabelled = table.where("y is null").select("a", "b")

    def sums(past, weights, w):
        sizes = [4] if w is None else [n for size in (STATS + WORDS, META) for n in (size, size * size)]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(sizes))
            for batch in batches:
                if batch.num_rows:
                    part = pool_sums([_floats(batch.column(i), n) for i, n in enumerate((STATS + WORDS, META))], past, weights, w, 0.95)
                    total += np.concatenate([np.ravel(x) for x in part])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        total = np.zeros(sum(sizes))
        for row in unlabelled.mapInArrow(add, "sums binary").collect():
            total += np.frombuffer(row["sums"])
        if w is None:
            return total.reshape(2, 2)
        parts = np.split(total, np.cumsum(sizes)[:-1])
        return [x.reshape(n, n) if i % 2 else x for i, (x, n) in enumerate(zip(parts, (STATS + WORDS,) * 2 + (META,) * 2, strict=True))]

    a, b = (_floats(found.column(c), n) for c, n in (("a", STATS + WORDS), ("b", META)))
    return cotrain(a, b, found.column("y").to_numpy().astype(float), n_all - n_known, sums, pool=pool)


def _floats(column, width: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(np.float64)


def score(docs: DataFrame, model: CoModel) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep (score of at least 0.5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                a, b, c = model.score(*_features(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a), pa.array(b), pa.array(c), pa.array(c >= 0.5)], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")
