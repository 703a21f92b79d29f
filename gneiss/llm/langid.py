"""Operator 5: language identification of mixed-language text.

A word is a run of letters and combining marks; in scripts written without spaces it is a piece of at
most ``UNSPACED_PIECE`` of them. Its script, that of its first letter, narrows the candidate languages
to those that showed the script in training, for every script. Its score under each candidate is a
padded character trigram model with backoff. Viterbi with a
switching penalty then labels every word, and so the spans of a text. Viterbi runs over blocks of
``BLOCK`` words, for all blocks of a batch at once: a first pass gives each block's best path
between any two languages, blocks are chained, and a second pass labels the words.

Only the sample that fits the model is bounded (``sample`` documents a language, by a hash of the
id); prediction reads every whole text. Grams of two or three characters that a language showed once
in the sample are left out of its model (most are slips, and they would be most of its size).

Defined results: null text or no letter gives ``und`` and score 0; ties go to the smaller code
point; a table without labels predicts ``und`` throughout; null doc_ids are never learned from and
count as held out; a word in a script no language showed has no say; an empty table gives no rows; very
long texts are labelled whole, block by block, and take memory in proportion; repeated rows each give a
row; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, UNSPACED_PIECE = 128, 4
#: First and last code points of scripts; letters elsewhere count as "other".
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
#: Code points of scripts written without spaces (Thai to Lao, Myanmar, Khmer, kana, Han).
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _letters() -> tuple[str, str]:
    """Insides of character classes of letters and marks, of spaced and of unspaced scripts."""
    ranges: dict[bool, list[list[int]]] = {False: [], True: []}
    for code in range(0x41, sys.maxunicode + 1):
        if unicodedata.category(chr(code))[0] in "LM":
            own = ranges[any(low <= code <= high for low, high in UNSPACED)]
            if own and own[-1][1] == code - 1:
                own[-1][1] = code
            else:
                own.append([code, code])
    return tuple("".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges[kind]) for kind in (False, True))


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern:
    spaced, unspaced = _letters()
    return re.compile(f"[{spaced}]+|[{unspaced}]{{1,{UNSPACED_PIECE}}}")


@lru_cache(maxsize=100_000)
def script_of(char: str) -> str:
    code = ord(char)
    return next((name for name, low, high in SCRIPTS if low <= code <= high), "other")


@dataclass
class LanguageModel:
    langs: list[str]
    scripts: dict[str, list[int]]  # script -> indexes of its languages
    rows: dict[str, int]  # gram of one to three characters -> row of ``scores``
    scores: object  # float32 [rows, languages]; the last row is for unseen characters


def grams(word: str) -> Iterator[str]:
    padded = f"^{word}$"
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            yield padded[i : i + n]


def fit(docs: DataFrame, sample: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count grams of a sample of at most about ``sample`` documents a language, on the executors."""
    import numpy as np

    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], {}, {}, np.zeros((1, 0), np.float32))
    part = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, sample / sizes[x]))) for x in langs])
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 11) / F.lit(float(1 << 53))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, Counter())
                for word, n in Counter(word_pattern().findall(text.lower())).items():
                    for g in grams(word):
                        own[g] += n
            flat = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    seen = known.where(draw < part).select("text", "lang").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1 or length(gram) = 1").toArrow()
    of = {x: i for i, x in enumerate(langs)}
    by: dict[str, object] = {}
    for lang, gram, n in zip(*(seen.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
        by.setdefault(gram, np.zeros(len(langs)))[of[lang]] += n
    total = sum((v for g, v in by.items() if len(g) == 1), np.zeros(len(langs))) + 1
    floor = np.log(0.5 / total)
    order = sorted(by, key=lambda g: (len(g), g))
    table, rows = np.zeros((len(order) + 1, len(langs)), np.float32), {g: i for i, g in enumerate(order)}
    table[-1] = floor
    for g in order:
        under = total if len(g) == 1 else by.get(g[:-1], np.zeros(len(langs)))
        lower = floor if len(g) == 1 else table[rows.get(g[1:], len(order))] + math.log(0.4)
        own = by[g]
        table[rows[g]] = np.where(own > 0, np.log(np.maximum(own, 1) / np.maximum(under, own + 1)), lower)
    letters: dict[str, object] = {}
    for g, n in by.items():
        if len(g) == 1 and g.isalpha():
            letters.setdefault(script_of(g), np.zeros(len(langs)))
            letters[script_of(g)] += n
    every = sum(letters.values(), np.zeros(len(langs))) + 1
    scripts = {s: [int(i) for i in np.flatnonzero(n >= 0.002 * every)] for s, n in letters.items()}
    return LanguageModel(langs, {s: x for s, x in scripts.items() if x}, rows, table)


class Scorer:
    """Scores of words under a model; keeps those of words seen before."""

    def __init__(self, model: LanguageModel, spread: float = 12.0, keep: int = 400_000):
        import numpy as np

        self.model, self.spread, self.keep, self.np = model, spread, keep, np
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)), np.float32)
        # kinds of words: 0 of a script no language showed, 1 without a letter, then one a script
        self.kinds = {script: i + 2 for i, script in enumerate(sorted(model.scripts))}
        self.allowed = np.ones((len(self.kinds) + 2, len(model.langs)), bool)
        for script, i in self.kinds.items():
            self.allowed[i] = np.isin(np.arange(len(model.langs)), model.scripts[script])
        self.says = np.r_[0, np.ones(len(self.kinds) + 1)].astype(np.float32)

    def learn(self, words: list[str]) -> None:
        np, m = self.np, self.model
        if len(self.index) + len(words) > self.keep:
            self.index, self.table = {}, self.table[:0]
            return
        last, rows, ids, starts, back = len(m.rows), m.rows, [], [], []
        for w in words:
            starts.append(len(ids))
            padded = f"^{w}$"
            for i in range(1, len(padded)):
                g = padded[max(0, i - 2) : i + 1]
                k, steps = rows.get(g), 0
                while k is None and len(g) > 1:
                    g, steps = g[1:], steps + 1
                    k = rows.get(g)
                ids.append(last if k is None else k)
                back.append(steps)
        s = np.add.reduceat(m.scores[ids] + np.array(back, np.float32)[:, None] * np.float32(math.log(0.4)), starts, axis=0)
        s = np.maximum(s - s.max(axis=1, keepdims=True), -self.spread)
        heads = [w[0] if w[0].isalpha() else next((c for c in w if c.isalpha()), "") for w in words]
        kind = np.fromiter((self.kinds.get(script_of(c), 0) if c else 1 for c in heads), np.int64, len(heads))
        s = np.where(self.allowed[kind], s, -np.float32(self.spread)) * self.says[kind][:, None]
        s[kind == 1] = np.nan  # no letter: no word
        self.index.update((w, len(self.table) + j) for j, w in enumerate(words))
        self.table = np.concatenate([self.table, s])

    def __call__(self, words: list[str]):
        """One row of scores per word; NaN rows for words without a letter."""
        np = self.np
        fresh = [w for w in dict.fromkeys(words) if w not in self.index]
        if fresh and len(self.index) + len(fresh) > self.keep:
            self.index, self.table = {}, self.table[:0]
            fresh = list(dict.fromkeys(words))
        keep, self.keep = self.keep, max(self.keep, len(self.index) + len(fresh))
        for at in range(0, len(fresh), 50_000):
            self.learn(fresh[at : at + 50_000])
        self.keep = keep
        get = self.index.__getitem__
        return self.table[np.fromiter(map(get, words), np.int64, len(words))] if words else np.zeros((0, len(self.model.langs)), np.float32)


def viterbi(scores, lengths, penalty: float):
    """Labels of all words. scores: [words, L], texts one after another; lengths: words of each text."""
    import numpy as np

    lengths = np.asarray(lengths, dtype=np.int64)
    n_words, n_lang = scores.shape
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), blocks)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = first[owner] + turn * BLOCK
    size = np.minimum(lengths[owner] - turn * BLOCK, BLOCK)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(BLOCK), side="left")  # blocks with more than t words

    def forward(v, back=None):
        for t in range(BLOCK):
            n = int(live[t])
            if not n:
                break
            at = order[:n]
            rows = scores[start[at] + t]
            top = v[at].max(axis=-1, keepdims=True) - penalty
            if back is not None:
                back["stay"][start[at] + t] = v[at] >= top
                back["from"][start[at] + t] = v[at].argmax(axis=-1)
            v[at] = np.maximum(v[at], top) + (rows[:, None, :] if v.ndim == 3 else rows)
        return v

    ways = np.full((len(owner), n_lang, n_lang), -1e9)
    ways[:, np.arange(n_lang), np.arange(n_lang)] = 0
    forward(ways)
    # chain the blocks of each text: best score of being in a language before and after every block
    entry, came = np.zeros((len(owner), n_lang)), np.zeros((len(owner), n_lang), np.int64)
    head = np.cumsum(blocks) - blocks
    state = np.zeros((len(lengths), n_lang))
    for k in range(int(blocks.max(initial=0))):
        texts = np.flatnonzero(blocks > k)
        b = head[texts] + k
        entry[b] = state[texts]
        total = state[texts][:, :, None] + ways[b]
        came[b] = total.argmax(axis=1)
        state[texts] = total.max(axis=1)
    end = np.zeros(len(owner), np.int64)
    now = state.argmax(axis=1)
    for k in range(int(blocks.max(initial=0)) - 1, -1, -1):
        texts = np.flatnonzero(blocks > k)
        b = head[texts] + k
        end[b] = now[texts]
        now[texts] = came[b, now[texts]]
    begin = came[np.arange(len(owner)), end]
    v = np.full((len(owner), n_lang), -1e9)
    v[np.arange(len(owner)), begin] = 0
    back = {"stay": np.zeros((n_words, n_lang), bool), "from": np.zeros(n_words, np.int64)}
    forward(v, back)
    labels, now = np.zeros(n_words, np.int64), end.copy()
    for t in range(BLOCK - 1, -1, -1):
        at = order[: int(live[t])]
        if len(at):
            w = start[at] + t
            labels[w] = now[at]
            now[at] = np.where(back["stay"][w, now[at]], now[at], back["from"][w])
    return labels


def spans(text: str, model: LanguageModel, penalty: float = 6.0) -> list[tuple[int, int, str]]:
    """Spans (start, end, lang) of one text, in code points of its lower-cased form."""
    import numpy as np

    found = list(word_pattern().finditer((text or "").lower()))
    score = Scorer(model)([m.group() for m in found])
    keep = np.flatnonzero(~np.isnan(score).any(axis=1)) if len(found) and model.langs else []
    out: list[tuple[int, int, str]] = []
    for i, k in zip(keep, viterbi(score[keep], [len(keep)], penalty) if len(keep) else [], strict=True):
        lang = model.langs[k]
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], found[i].end(), lang)
        else:
            out.append((found[i].start(), found[i].end(), lang))
    return out


def predict(docs: DataFrame, model: LanguageModel, penalty: float = 6.0, id_col: str = "doc_id", text_col: str = "text", words_at_once: int = 400_000, keep: bool = False) -> DataFrame:
    """``(doc_id, lang_pred, score, n_spans)``: the language with the most letters among the labelled
    spans, and its share. With ``keep``, ``row`` holds the input's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        scorer = Scorer(model)

        def flush(rows: pa.RecordBatch, words: list[str], counts: list[int]) -> pa.RecordBatch:
            n_lang, n = len(model.langs), rows.num_rows
            share, switches = np.zeros((n, max(1, n_lang))), np.zeros(n, np.int64)
            if words and n_lang:
                score, of = scorer(words), np.repeat(np.arange(n), counts)
                letters = np.fromiter(map(len, words), np.int64, len(words))
                ok = ~np.isnan(score[:, 0])
                score, of, letters = score[ok], of[ok], letters[ok]
                labels = viterbi(score, np.bincount(of, minlength=n), penalty)
                np.add.at(share, (of, labels), letters)
                fresh = np.ones(len(of), bool)
                fresh[1:] = (of[1:] != of[:-1]) | (labels[1:] != labels[:-1])
                switches = np.bincount(of[fresh], minlength=n)
            total = share.sum(axis=1)
            best = share.argmax(axis=1)
            names = [model.langs[b] if t else "und" for b, t in zip(best, total, strict=True)]
            part = share[np.arange(n), best] / np.maximum(total, 1)
            own = [rows.column(0), *([rows.column(2)] if keep else [])]
            return pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(part, pa.float64()), pa.array(switches, pa.int32())], ["doc_id", *(["row"] if keep else []), "lang_pred", "score", "n_spans"])

        for batch in batches:
            words, counts, start = [], [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = word_pattern().findall(text.lower()) if text else []
                words += own
                counts.append(len(own))
                if len(words) >= words_at_once or i == batch.num_rows - 1:
                    yield flush(batch.slice(start, i + 1 - start), words, counts)
                    words, counts, start = [], [], i + 1

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    schema = "doc_id long, lang_pred string, score double, n_spans int"
    if keep:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        schema = f"doc_id long, row {docs.select(columns[-1]).schema['row'].dataType.simpleString()}, lang_pred string, score double, n_spans int"
    return docs.select(*columns).mapInArrow(run, schema)


def held_out(doc_id) -> object:
    """True where crc32(doc_id as text) mod 5 is 0, and for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
