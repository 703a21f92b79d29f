"""The ten operators and the pipeline against brute force on small fixtures, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import cotrain, katz, langid, licenses, mixing, multiindex, packing, permindex, pii, simhash
from gneiss.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, label string"
EN, DE = "the of and that with this for was on it " * 6, "der die und nicht mit das für auf ist ein " * 6


def docs_of(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 3))
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(1, 60)))), "en", f"s{i % 3}") for i in range(60)]
    rows += [(60, None, None, None), (61, "", "en", "s0"), (62, "one", "en", "s0"), (63, "two words", None, "s1"), (None, "no id here", "en", "s1"), (64, "w " * 9000, "en", "s2")]
    rows += [rows[5], rows[5], (70, rows[5][1], "en", "s0"), (71, "1234 5678", "en", None), (72, "ÄÖ ß  日本 é", "de", "é")]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(500 + i, 501 + i) for i in range(30)]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


@pytest.mark.parametrize("hot", [1, 10_000])
def test_simhash_links(spark, hot):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 30)]
    for base in fps[:6]:
        for _ in range(12):
            flip = 0
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                flip |= 1 << int(b)
            v = (base ^ flip) & (2**64 - 1)
            fps.append(v - 2**64 if v >= 2**63 else v)
    fps = sorted(set(fps))
    near = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot=hot).distinct()
    got = {(r.a, r.b) for r in edges.collect()}
    assert got <= near and (hot == 1 or got == near)
    cc = lambda e: {r.id: r.component for r in components(spark.createDataFrame(sorted(e), "a long, b long")).collect()}
    assert cc(got) == cc(near)


def test_simhash_documents(spark, odd, empty):
    import xxhash

    def brute(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    found = simhash.simhash_groups(odd).select("doc_id", simhash.hex16(F.col("fp")).alias("h"), "component_id").collect()
    rows = odd.collect()
    assert sorted((str(r.doc_id), r.h) for r in found) == sorted((str(r.doc_id), f"{brute(r.text):016x}") for r in rows)
    assert {r.component_id for r in found if r.doc_id in (5, 70)} == {5} and {r.component_id for r in found if r.doc_id in (60, 61)} == {60}
    assert simhash.simhash_groups(empty).count() == 0


def test_simhash_components_by_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(25)]
    for t in texts[:10]:
        parts = t.split()
        parts[int(rng.integers(30))] = "changed"
        texts += [" ".join(parts), t, t + " tail"]
    rows = [(100 - i, t, "en", "s") for i, t in enumerate(texts)] + [(900, "", "en", "s"), (901, None, "en", "s")]
    fps = {i: simhash.fingerprint((t or "").encode()) & (2**64 - 1) for i, t, _, _ in rows}
    root = {i: i for i in fps}
    for _ in range(len(fps)):
        root = {i: min(root[j] for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 2) for i in fps}
    assert {r.doc_id: r.component_id for r in simhash.simhash_groups(docs_of(spark, rows)).collect()} == root


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocab())
    import zlib

    want = []
    for r in odd.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(str(r.doc_id), k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    got = packing.pack_documents(odd).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    place = defaultdict(list)
    for r in got:
        place[r.sequence_id].append((r.offset, r.length))
    for spots in place.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


def test_packing_added_tokens_and_long_runs(spark):
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocab())
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "a" + " " * 1_000_000 + "b", "x\n\t" * 40_000, " " * 49_999 + "\x1c\u3000z"]
    want = []
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    got = packing.pack_documents(docs_of(spark, [(i, x, "en", "s") for i, x in enumerate(texts)])).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert [r.length for r in got if r.doc_id == 0] == [5]


def test_exact_fill():
    counts = {700: 10, 600: 10, 748: 10, 1000: 5, 1048: 5, 2048: 2}
    assert sum(n for n, _ in packing.plan(counts, 2048)) == 17
    with pytest.raises(ValueError):
        packing.plan({3000: 1}, 2048)


def fewest(pieces, capacity):
    """Fewest sequences by exhaustive search."""
    pieces = sorted(pieces, reverse=True)

    def fits(i, room):
        if i == len(pieces):
            return True
        return any(room[j] >= pieces[i] and room[j] not in room[:j] and fits(i + 1, (*room[:j], room[j] - pieces[i], *room[j + 1 :])) for j in range(len(room)))

    return next(k for k in range(-(-sum(pieces) // capacity), len(pieces) + 1) if fits(0, (capacity,) * k))


def test_packing_against_exhaustive_search():
    rng = np.random.default_rng(0)
    over = Counter()
    for _ in range(200):
        capacity = int(rng.integers(6, 20))
        pieces = rng.integers(1, capacity + 1, int(rng.integers(1, 11))).tolist()
        found, used = packing.plan(dict(Counter(pieces)), capacity), Counter()
        for times, took in found:
            assert sum(size * n for size, n in took.items()) <= capacity
            for size, n in took.items():
                used[size] += times * n
        assert used == Counter(pieces)
        over[sum(times for times, _ in found) - fewest(pieces, capacity)] += 1
    assert over[0] >= 198 and max(over) <= 1


def test_sum_index():
    rng = np.random.default_rng(1)
    for _ in range(100):
        free = rng.integers(0, 3, 25)
        free[0] = 0
        index = packing.SumIndex(free)
        for _ in range(30):
            total = int(rng.integers(1, 25))
            for size, found in ((2, index.pair(total)), (3, index.triple(total))):
                some = [c for c in __import__("itertools").combinations_with_replacement(range(1, 25), size) if sum(c) == total and all(free[x] >= n for x, n in Counter(c).items())]
                assert (found is None) == (not some)
                assert found is None or tuple(sorted(found)) in some
            drop = int(rng.integers(1, 25))
            free[drop] = max(0, free[drop] - 1)


def test_packing_repeated_rows(spark):
    rows = [(None, "", "en", "s")] * 5000 + [(1, "same text", "en", "s")] * 5000
    got = packing.pack_documents(docs_of(spark, rows)).collect()
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(got) == len(places) == 10_000 and len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 2048)


def test_mixing(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    again = mixing.mix(odd.repartition(7)).collect()
    key = lambda rs: sorted((str(r.doc_id), r["size"], r.taken) for r in rs)
    assert key(rows) == key(again)
    total = sum(r["size"] for r in rows)
    goal = {r.source: (r.target, r.source_size) for r in rows}
    names = sorted(x for x in goal if x is not None) + ([None] if None in goal else [])
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    free, left, want = set(names), float(total), {}
    while True:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 3 * goal[n][1] + 1e-9]
        if not over:
            want |= share
            break
        for n in over:
            want[n] = 3.0 * goal[n][1]
            left -= want[n]
            free.discard(n)
    assert all(math.isclose(goal[n][0], want[n], rel_tol=1e-9, abs_tol=1e-6) for n in names)
    for n in names:
        assert abs(sum(r.taken for r in rows if r.source == n) - want[n]) <= max(r["size"] for r in rows if r.source == n)
    assert mixing.mix(empty).count() == 0


def test_mixing_draw_and_many_sources(spark):
    # equal documents: taken by share, whatever their id
    rows = mixing.mix(docs_of(spark, [(i, "a b c", "en", "s0" if i < 1500 else "s1") for i in range(2000)])).collect()
    one = [r for r in rows if r.source == "s1"]
    assert abs(sum(r.taken for r in one) - one[0].target) <= 3 and {r.copies for r in one} == {1, 2}
    most = [r for r in rows if r.source == "s0"]
    share = most[0].target / most[0].source_size
    for half in (most[:750], most[750:]):
        assert abs(sum(r.copies for r in half) / 750 - share) < 5 * math.sqrt(share * (1 - share) / 750)
    # repeated rows beyond one array of copies, and sources in code point order over several ranges
    got = mixing.mix(docs_of(spark, [(7, "x y", "en", "s")] * 9000)).agg(F.count("*"), F.countDistinct("copies")).first()
    assert tuple(got) == (9000, 1)
    names = [f"n{i:03d}" for i in range(300)] + [None, "é", "Z"]
    placed = {r.source: r.place for r in mixing.numbered(spark.createDataFrame([(x, 1) for x in names], "source string, source_size long").repartition(9)).collect()}
    assert [placed[x] for x in [*sorted(x for x in names if x), None]] == list(range(303))


def brute_base(text):
    def luhn(d):
        return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    out = []
    for rank, (kind, p) in enumerate(pii.PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii(spark, odd, empty):
    texts = [
        None, "", "a@b.co_x@d.ee a.b@c-d.e.f. @x a@b", "1.2.3.4.5.6.7.8 999.1.2.3.4 007.1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 1 2 3", "+1 (705) 555-1902 +49 30 +1-2", "é日 4222222222222 +4 9301234567x",
        "x" * 50_000 + "@", "1" * 40_000, "a." * 20_000, "7 " * 3000, "u@h.c" * 50,
    ]
    df = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    rows = pii.extract(df).select("doc_id", pii.joined(F.col("base")).alias("b"), pii.joined(F.col("spans")).alias("s")).collect()
    assert {r.doc_id: r.b for r in rows} == {i: brute_base(t) for i, t in enumerate(texts)}
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in rows)
    assert pii.extract(odd).count() == odd.count() and pii.extract(empty).count() == 0


def test_pii_discovers(spark):
    seeds = [(i, f"filler words here call me at +1 (705) 555-{1000 + i} today please", "en", "s") for i in range(40)]
    more = [(100, "so call me at 705-555-7777 today please", "en", "s"), (101, "there were 705-555-7777 of them", "en", "s")]
    df = docs_of(spark, seeds + more)
    got = {r.doc_id: r.s for r in pii.extract(df).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}
    assert got[100] == "phone:14:26" and got[101] == ""
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[100] == "so call me at <phone> today please" and clean[101] == more[1][1]


def test_pii_discovers_next_to_others(spark):
    rows = [(i, f"filler words here call me at +1 (705) 555-{1000 + i} today please", "en", "s") for i in range(40)]
    rows += [(50 + i, f"+1 (705) 556-{1000 + i} reaches the desk", "en", "s") for i in range(40)]
    phone = r"705-555-7777|705-555-8888|\(705\) 555-9999|705 555 6666"
    texts = [
        "so call me at 705-555-7777, 705-555-8888 today please", "so call me at a@b.com 705-555-7777 now", "so call me at 705-555-7777 24/7", "so call me at +1 (705) 555-1001, 705-555-8888 or so",
        "call me at 705-555-7777/705-555-8888", "call me at tel:705-555-7777 today please", "705-555-8888 reaches the desk", "call me at (705) 555-9999 or not", "call me at 705 555 6666; 24 times", "each 705-555-7777 of them",
    ]
    df = docs_of(spark, rows + [(200 + i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: set(filter(None, r.s.split(","))) for r in pii.extract(df).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = {f"phone:{m.start()}:{m.end()}" for m in re.finditer(phone, t)} if not t.startswith("each") else set()
        assert got[200 + i] == want | set(filter(None, brute_base(t).split(","))), t


def test_pii_many_matches_in_one_text(spark):
    text = "é, " + "; ".join(f"u{i}@ex.com or 10.0.{i % 256}.7" for i in range(6000))
    got = pii.extract(docs_of(spark, [(1, text, "en", "s")])).select(pii.joined(F.col("base")).alias("b"), F.size("spans").alias("n")).first()
    assert got.b == brute_base(text) and got.n == 12_000
    clean = pii.redact(docs_of(spark, [(1, text, "en", "s"), (2, None, "en", "s"), (3, "", "en", "s")])).collect()
    assert {r.doc_id: r.text for r in clean} == {1: "é, " + "; ".join(["<email> or <ip>"] * 6000), 2: None, 3: ""}


def test_language(spark, odd, empty):
    train = docs_of(spark, [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "s") for i in range(60)])
    model = langid.fit(train)
    got = {r.doc_id: r for r in langid.predict(docs_of(spark, [(1, EN + DE + EN, None, None), (2, DE, None, None), (3, "12 34", None, None), (4, None, None, None), (5, EN * 100, None, None)]), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "en"]
    assert got[1].n_spans == 3 and 0.5 < got[1].score < 0.8 and got[3].score == 0
    assert [s[2] for s in langid.spans(EN + DE, model)] == ["en", "de"]
    assert langid.predict(odd, model).count() == odd.count()
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_language_narrows_by_script_and_keeps_marks(spark):
    assert langid.word_pattern().findall("हिन्दी தமிழ் naïve cafe\u0301 2abc a_b 東京都庁舎") == ["हिन्दी", "தமிழ்", "naïve", "cafe\u0301", "abc", "a", "b", "東京都庁", "舎"]
    hindi = "यह एक वाक्य है और यह भी हिन्दी में है "
    model = langid.fit(docs_of(spark, [(i, EN if i % 2 else hindi, "en" if i % 2 else "hi", "s") for i in range(40)]))
    score = langid.Scorer(model)(["zqxj", "है", "слово", "\u0301"])
    en, hi = model.langs.index("en"), model.langs.index("hi")
    assert score[0, hi] == -12 < score[0, en] and score[1, en] == -12 < score[1, hi]
    assert score[2].tolist() == [0, 0] and np.isnan(score[3]).all()


def held_out_rows(name):
    from pathlib import Path

    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no test tables here")
    return str(folder / f"{name}.parquet")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(held_out_rows("documents"))
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held))
    truth = {r.doc_id: r.lang for r in docs.where(held & F.col("lang").isNotNull()).select("doc_id", "lang").collect()}
    got = [(r.lang_pred, truth[r.doc_id]) for r in langid.predict(docs.where(held).select("doc_id", "text"), model).collect() if r.doc_id in truth]
    assert len(got) > 100 and sum(a == b for a, b in got) / len(got) >= 0.97


def test_cotraining_held_out(spark):
    docs, labels = spark.read.parquet(held_out_rows("documents")), spark.read.parquet(held_out_rows("labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    model = cotrain.fit(docs, labels.where(~held))
    truth = {r.doc_id: r.quality for r in labels.where(held).collect()}
    score = {r.doc_id: r.score for r in cotrain.score(docs.join(labels.where(held).select("doc_id"), "doc_id"), model).collect()}
    good, bad = ([score[i] for i in truth if truth[i] == y] for y in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(bad) >= 10 and auc >= 0.95


def test_cotraining_scores_by_hand(spark):
    """Scores of a fitted model are the stated formula of its parts, computed from plain features."""
    rows = [(i, "plain prose about things that matter " * 5 if i % 2 else "SPAM!!! " * (10 + i % 30), "en", "ab"[i % 2]) for i in range(200)]
    docs = docs_of(spark, rows)
    model = cotrain.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int"))
    sure = lambda z: 1 / (1 + math.exp(-z))
    for r in cotrain.score(docs, model).collect():
        _, text, lang, source = rows[r.doc_id]
        a = float(cotrain.text_features(text.encode()).astype(float) @ model.text) * model.calibrate[0][0] + model.calibrate[0][1]
        b = float(cotrain.meta_features(lang, source, text.encode()).astype(float) @ model.meta) * model.calibrate[1][0] + model.calibrate[1][1]
        a, b = (max(-20, min(20, v)) for v in (a, b))
        want = sure(a), sure(b), sure(model.combine[0] + model.combine[1] * a + model.combine[2] * b)
        assert (r.text_score, r.meta_score, r.score) == pytest.approx(want, abs=1e-4)


def test_viterbi_blocks():
    rng = np.random.default_rng(0)
    lengths = [0, 1, 127, 128, 129, 700, 3]
    scores = rng.normal(size=(sum(lengths), 3)) * 2
    got, at = langid.viterbi(scores, lengths, 3.0), 0

    def value(labels, s):
        return s[np.arange(len(s)), labels].sum() - 3.0 * (np.diff(labels) != 0).sum()

    for n in lengths:
        s = scores[at : at + n]
        v, back = (s[0].copy() if n else None), []
        for t in range(1, n):
            stay = v[:, None] - 3.0 * (1 - np.eye(3))
            back.append(stay.argmax(0))
            v = stay.max(0) + s[t]
        if n:
            assert math.isclose(value(got[at : at + n], s), v.max(), rel_tol=1e-9)
        at += n


def test_katz(spark, odd, empty):
    rows = odd.collect()
    train = [r for r in rows if r.doc_id is None or __import__("zlib").crc32(str(r.doc_id).encode()) % 7 != 2]
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]
    uni = Counter(w for r in train for w in words(r.text))
    bi = Counter(p for r in train for p in zip([b"<s>", *words(r.text)[:-1]], words(r.text)))
    n, v = sum(uni.values()), len(uni)
    by = lambda c: [0] + [sum(x == r for x in c.values()) for r in range(1, katz.CUT + 2)]
    su, sb = katz.discounts(by(uni)), katz.discounts(by(bi))
    cut = lambda c, s: s[c] if c <= katz.CUT else c - katz.DELTA
    left = n - sum(cut(c, su) for c in uni.values())
    pu = lambda w: cut(uni[w], su) / n if w in uni else left / n
    total, kept, mass = Counter(), defaultdict(float), defaultdict(float)
    for (a, b), c in bi.items():
        total[a] += c
        kept[a] += cut(c, sb)
        mass[a] += pu(b)

    def p(a, b):
        if (a, b) in bi:
            return cut(bi[a, b], sb) / total[a]
        return pu(b) * ((1 - kept[a] / total[a]) / (1 - mass[a]) if a in total else 1)

    context = next(iter(total))
    assert math.isclose(sum(p(context, w) for w in uni) + p(context, b"never seen"), 1, rel_tol=1e-9)
    for tokens in (10**6, 400):
        got = katz.score(odd, block_tokens=tokens, deal_tokens=500).collect()
        want = sorted((str(r.doc_id), round(sum(math.log10(p(a, b)) for a, b in zip([b"<s>", *words(r.text)[:-1]], words(r.text))), 5), round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in words(r.text)), 5)) for r in rows)
        assert [(a, pytest.approx(b, abs=1e-4), pytest.approx(c, abs=1e-4)) for a, b, c in want] == sorted((str(r.doc_id), round(r.score, 5), round(r.base_score, 5)) for r in got)
    assert katz.score(empty).count() == 0
    for tokens in (10**6, 400):  # the stored tables give the same probabilities, token by token
        model = katz.fit(odd, block_tokens=tokens, deal_tokens=500)
        found = katz.evaluate(odd, model).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in found) == sorted((str(r.doc_id), len(words(r.text))) for r in rows)
        assert sorted((str(r.doc_id), r.score) for r in found) == [(a, pytest.approx(b, abs=1e-4)) for a, b, _ in want]
        assert model.bigrams.count() == len(bi) and model.bigrams.agg(F.sum("n")).first()[0] == sum(bi.values())
        assert {r.h: r.n for r in model.words.collect()}[katz.END] == uni[b""]


def test_katz_normalises_exactly(spark, odd):
    """For every context: seen words, unseen words and the unknown word add up to one."""
    model = katz.fit(odd, block_tokens=400, deal_tokens=500)
    p = {r.h: 10**r.log_p for r in model.words.collect()}
    seen = defaultdict(dict)
    for r in model.bigrams.collect():
        seen[r.context][r.word] = 10**r.log_p
    for r in model.contexts.collect():
        rest = sum(x for w, x in p.items() if w not in seen[r.context]) + 10**model.unknown
        assert math.isclose(sum(seen[r.context].values()) + 10**r.backoff * rest, 1, rel_tol=1e-9)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, vec string, cid string")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    x[100:160] = x[0] + rng.normal(size=(60, 16)) * 0.12
    x[200:220] = x[1]
    return [(i, int(i % 2 if not 100 <= i < 220 else 0), [float(v) for v in np.float32(x[i])], "a", "b") for i in range(400)]


def test_multiindex(spark, points):
    extra = [(900, 0, None, "", ""), (901, 0, [0.0] * 16, "", ""), (902, 0, [float("nan")] * 16, "", ""), (903, None, points[0][2], "", ""), (904, 0, points[0][2][:8], "", ""), (905, 0, [None] * 16, "", "")]
    rows = points + extra
    got = {r.vec_id: r for r in multiindex.near_vectors(vectors_of(spark, rows), block=16, per_cell=8).collect()}
    x = np.array([p[2] for p in points], float)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    lab = np.array([p[1] for p in points])
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab[None]) & ~np.eye(len(u), dtype=bool)
    assert [got[i].n_links for i in range(len(points))] == link.sum(1).tolist()
    root = list(range(len(points)))
    for _ in range(20):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(link[i]))]) for i in range(len(points))]
    assert [got[i].component_id for i in range(len(points))] == root
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 906))
    assert multiindex.near_vectors(vectors_of(spark, [])).count() == 0


def test_permutation_index(spark, points):
    rows = points + [(900, 0, None, "", ""), (901, 0, [0.0] * 16, "", "")]
    got = permindex.search(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, shard_rows=100, block_rows=7).collect()
    x = np.array([p[2] for p in points], float)
    hit = total = 0
    for q in range(0, 400, 20):
        s = x @ x[q] / np.sqrt((x * x).sum(1) * (x[q] @ x[q]))
        s[q] = -9
        best = np.lexsort((np.arange(400), -s))[:5]
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hit += len({m[1] for m in mine} & set(best.tolist()))
        total += 5
    assert hit / total >= 0.9
    assert permindex.search(vectors_of(spark, points[:3]), F.col("vec_id") == 0).count() == 2
    assert permindex.search(vectors_of(spark, []), F.col("vec_id") == 0).count() == 0


def test_permutation_index_by_length(spark, points):
    find = lambda rows: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in permindex.search(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, shard_rows=100, block_rows=7).collect())
    odd = [(1000, 0, [*points[0][2], 1.0], "", "")]
    short = [(2000 + i, 0, points[i][2][:8], "", "") for i in range(3)]
    assert find(points + odd) == find(points) and len(find(points)) == 100
    got = find(points + odd + short)
    assert [r for r in got if r[0] < 1000] == find(points) and not [r for r in got if r[0] == 1000]
    assert sorted(r[2] for r in got if r[0] == 2000) == [2001, 2002]


def test_permutation_index_repeats_and_extremes(spark, points):
    find = lambda rows, **o: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in permindex.search(vectors_of(spark, rows), F.col("vec_id") % 50 == 0, **o).collect())
    plain = find(points)
    again = find(points + [points[50], points[50], points[72]])
    assert again == plain and all(len({r[2] for r in plain if r[0] == q}) == 5 for q in range(0, 400, 50))
    # a second vector of a query's id asks too; neighbours stay distinct
    both = [r for r in find([*points, (50, 0, points[0][2], "", "")]) if r[0] == 50]
    assert len({r[2] for r in both}) == 5
    doubles = lambda scale: spark.createDataFrame([(p[0], [v * scale for v in p[2]]) for p in points], "vec_id long, embedding array<double>")
    for scale in (1e200, 1e-200, 1e300):
        got = permindex.search(doubles(scale), F.col("vec_id") % 50 == 0).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [r[:3] for r in plain]
        assert all(abs(r.score) <= 1 + 1e-12 for r in got) and max(r.score for r in got) > 0.5


def test_permutation_index_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    rows = [(i, 0, x[i].tolist(), "", "") for i in range(len(x))]
    got = defaultdict(set)
    for r in permindex.search(vectors_of(spark, rows), F.col("vec_id") % 50 == 0, shard_rows=2500).collect():
        got[r.query_id].add(r.vec_id)
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    hit = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit / 600 >= 0.9
    pivots, prefix, share = permindex.fit(spark.createDataFrame([(64, [float(v) for v in p]) for p in x[:3000]], "width int, vec array<double>"), {64: 3000}, 5, 1024, 64, 0.96, 20_000)[64]
    assert share < 0.5 and prefix == 64


def test_multiindex_skewed_labels_and_odd_lengths(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 16))
    x[500:1000] = x[:500] + rng.normal(size=(500, 16)) * 0.1
    label = [0 if i < 2400 else 1 + i // 2 for i in range(3000)]
    rows = [(i, label[i], [float(v) for v in np.float32(x[i])], "", "") for i in range(3000)]
    odd = [(5000, 0, [1.0] * 17, "", ""), (5001, 0, [2.0] * 17, "", ""), rows[3], (rows[3][0], 0, rows[700][2], "", "")]
    u = np.array([r[2] for r in rows], float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    link = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None]) & ~np.eye(3000, dtype=bool)
    got = {r.vec_id: r.n_links for r in multiindex.near_vectors(vectors_of(spark, rows), fit_sample=400, per_cell=8).collect()}
    want = link.sum(1)
    assert sum(min(got[i], want[i]) for i in range(3000)) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in range(3000))
    more = multiindex.near_vectors(vectors_of(spark, rows + odd), fit_sample=10, per_cell=8).collect()
    assert len(more) == 3004 and {r.n_links for r in more if r.vec_id > 4999} == {1}


def test_licenses(spark, odd, empty):
    mit = licenses.KNOWN["MIT"]
    shouted = "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace('"', "``").replace(". ", ".\n\n")
    british = licenses.KNOWN["Zlib"].replace("acknowledgment", "acknowledgement")
    rows = {r.doc_id: r for r in licenses.scan(docs_of(spark, [(1, shouted, "en", "s"), (2, british, "en", "s"), (3, mit + " but not", "en", "s"), (4, None, "en", "s"), (5, "", "en", "s")])).collect()}
    assert [rows[i].license_id for i in range(1, 6)] == ["MIT", "Zlib", None, None, None]
    assert rows[4].digest is None and rows[5].digest == hashlib.sha256(b"").hexdigest()
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0


def test_licenses_known_texts_titles_and_notices(spark):
    from pathlib import Path

    mit, bsd = licenses.KNOWN["MIT"], licenses.KNOWN["BSD-3-Clause"]
    files = {f.stem: f.read_text() for f in sorted((Path(licenses.__file__).parent / "license_texts").glob("*.txt"))}
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "Unlicense", "CC0-1.0"} <= set(files)
    cases = [*files.items(), ("Apache-2.0", "\n".join(x.strip() for x in files["Apache-2.0"].split("APPENDIX")[0].splitlines()))]
    cases += [("MIT", f"{head}\n\n{mit}") for head in ("MIT License\n\nCopyright (c) 2020 X", "The MIT License (MIT)\n\nCopyright (c) Microsoft Corporation.", "Copyright (c) Meta Platforms, Inc. and affiliates.", "Copyright: 2020 X", "© The Authors", "(c) Some Company", "MIT License\n\n  (c) Some Company", "# Copyright by the Team\n# All rights reserved.")]
    wrapped = bsd.replace("COPYRIGHT HOLDER", "\nCOPYRIGHT HOLDER").replace("copyright notice", "\ncopyright notice")
    cases += [("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) Facebook, Inc.\n\n{wrapped}"), (None, "Copyright (c) X\n" + mit + " but not"), (None, "Copyright (c) Microsoft Corporation.")]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, [(i, t, "en", "s") for i, (_, t) in enumerate(cases)])).collect()}
    assert [got[i].license_id for i in range(len(cases))] == [k for k, _ in cases]


def test_licenses_list_marks(spark):
    bsd = licenses.KNOWN["BSD-3-Clause"]
    forms = [bsd.replace(" 1. ", "\n  * ").replace(" 2. ", "\n  * ").replace(" 3. ", "\n  * "), bsd.replace(" 1. ", "\n\n1) ").replace(" 2. ", "\n\n2) ").replace(" 3. ", "\n\n3) "), bsd.replace(" 1. ", "\n(a) ").replace(" 2. ", "\n(b) ").replace(" 3. ", "\n(c) "), bsd.replace("1. ", "").replace("2. ", "").replace("3. ", "")]
    got = licenses.scan(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(forms)])).collect()
    assert {r.license_id for r in got} == {"BSD-3-Clause"}


def test_cotraining(spark, odd, empty):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(rng.choice(["plain", "prose", "about", "things", "that", "matter"], 40))
    bad = lambda: "SPAM!!! " * int(rng.integers(10, 40))
    rows = [(i, good() if i % 2 else bad(), "en", "a" if i % 2 else "b") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    docs = docs_of(spark, rows)
    model = cotrain.fit(docs, labels)
    got = {r.doc_id: r for r in cotrain.score(docs, model).collect()}
    assert all(got[i].keep == bool(i % 2) for i in range(200, 400))
    assert cotrain.score(odd, model).count() == odd.count()
    none = cotrain.fit(empty, labels.limit(0))
    assert {r.score for r in cotrain.score(odd, none).collect()} == {0.5}


def test_cotraining_hands_over_all_sure_documents(spark, monkeypatch):
    words = ["plain", "prose", "about", "things", "that", "matter"]
    rows = [(i, " ".join(words[(i * 7 + k) % 6] for k in range(40)) if i % 2 else "SPAM!!! " * (10 + i % 30), "en", "a" if i % 2 else "b") for i in range(1400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen = []
    real = cotrain.cotrain

    def watched(text, meta, y, n_pool=0, sums=None, **options):
        def kept(past, weights, w):
            out = sums(past, weights, w)
            if w is None:
                seen.append(out)
            return out

        return real(text, meta, y, n_pool, kept, **options)

    monkeypatch.setattr(cotrain, "cotrain", watched)
    model = cotrain.fit(docs_of(spark, rows), labels, pool=100)
    assert seen[0][0].tolist() == [600, 600] and seen[0][1].min() > 100
    got = cotrain.score(docs_of(spark, rows), model).collect()
    assert all(r.keep == bool(r.doc_id % 2) for r in got)


def test_pipeline(spark, odd, empty):
    import corpus_pipeline as p

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in p.STAGES:
        docs = stage(spark, docs, "")
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "language_id":
            assert {60, 61, 71}.isdisjoint({r.doc_id for r in docs.collect()})
        if name == "near_dedup":
            ids = [r.doc_id for r in docs.collect()]
            assert ids.count(5) == 1 and 70 not in ids and None in ids
    assert docs.count() > 0
    # the draw of the mix depends on rows, not on how files lie
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    mixed = [Counter(map(repr, p.mix_sources(spark, d, "").collect())) for d in (plain, plain.repartition(5))]
    assert mixed[0] == mixed[1]
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
