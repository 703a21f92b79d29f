"""SimHash near-duplicates at a similarity, against brute force over shingle sets."""

import numpy as np

from gneiss.llm import nearsets

COLUMNS = "doc_id long, text string, fp string, node string, key long, root int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, None) for i, t in rows], COLUMNS)


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / max(1, len(a) + len(b) - both)


def edited(rng, text, edits):
    words = text.split()
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def roots_of(rows, similarity=0.8):
    sets = {i: nearsets.shingle_set((t or "").encode()) for i, t in rows}
    near = {i: [j for j in sets if i == j or np.array_equal(sets[i], sets[j]) or jaccard(sets[i], sets[j]) >= similarity] for i in sets}
    root = {i: i for i in sets}
    while True:
        new = {i: min(root[j] for j in near[i]) for i in sets}
        if new == root:
            return root
        root = new


def test_near_groups_by_brute_force(spark):
    rng = np.random.default_rng(8)
    fresh = lambda n: " ".join(f"w{rng.integers(1 << 20)}" for _ in range(n))
    texts = [fresh(int(n)) for n in rng.integers(80, 400, 40)]
    # copies with few edits (0.86 or more) are links, copies with many (0.6 or less) are not
    for t in texts[:20]:
        n = len(t.split())
        texts += [edited(rng, t, max(1, n // 100)), t.upper(), edited(rng, t, n // 9)]
    texts += ["", None, " \t\n", "one", "One", "two words", "two words"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r.component_id for r in nearsets.near_groups(docs_of(spark, rows)).collect()}
    assert found == roots_of(rows)


def test_near_groups_at_the_similarity(spark):
    """Of pairs close to 0.8, nearly all from 0.82 up are found and none below 0.7."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(120):
        base = " ".join(f"w{rng.integers(1 << 20)}" for _ in range(300))
        rows += [(2 * i, base), (2 * i + 1, edited(rng, base, 3 + i % 12))]
    found = {r.doc_id: r.component_id for r in nearsets.near_groups(docs_of(spark, rows)).collect()}
    sets = {i: nearsets.shingle_set(t.encode()) for i, t in rows}
    pairs = [(jaccard(sets[2 * i], sets[2 * i + 1]), found[2 * i] == found[2 * i + 1]) for i in range(120)]
    sure = [linked for s, linked in pairs if s >= 0.82]
    assert len(sure) > 20 and sum(sure) >= 0.95 * len(sure)
    assert not any(linked for s, linked in pairs if s < 0.7)


def test_large_group_of_different_copies(spark):
    """One group whose blocks hold hundreds of fingerprints, and two others that share half its words."""
    rng = np.random.default_rng(10)
    base = " ".join(f"w{rng.integers(1 << 20)}" for _ in range(200))
    half = " ".join(base.split()[:100])
    rows = [(10 + i, edited(rng, base, 1)) for i in range(400)]
    others = [half + " " + " ".join(f"v{k}-{j}" for j in range(100)) for k in range(2)]
    rows += [(1000 + 10 * k + i, edited(rng, o, 1)) for k, o in enumerate(others) for i in range(12)]
    got = {}
    for r in nearsets.near_groups(docs_of(spark, [(n, t) for n, (_, t) in enumerate(rows)]), small=2).collect():
        got.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(map(sorted, got.values())) == [list(range(400)), list(range(400, 412)), list(range(412, 424))]


def test_large_blocks_of_texts_too_unlike_to_link(spark, monkeypatch):
    """Texts with a base in common but too many edits leave their large blocks after the first round, the copies among them link."""
    rng = np.random.default_rng(12)
    base = " ".join(f"w{rng.integers(1 << 20)}" for _ in range(150))
    rows = [(1000 + i, edited(rng, base, 6)) for i in range(400)]
    rows += [(i, edited(rng, rows[20 * i][1], 1)) for i in range(20)]
    real, leads = nearsets.cut, []

    def cut(df, name, partition_by=None):
        table = real(df, name, partition_by)
        leads.extend([table.where("not last").count()] if name == "near-lead" else [])
        return table

    monkeypatch.setattr(nearsets, "cut", cut)
    found = {r.doc_id: r.component_id for r in nearsets.near_groups(docs_of(spark, rows)).collect()}
    assert found == roots_of(rows)
    assert sum(leads[1:]) < 100


def test_shared_parts_bound_what_texts_have_in_common(spark):
    rng = np.random.default_rng(13)
    base = " ".join(f"w{rng.integers(1 << 20)}" for _ in range(150))
    texts = [edited(rng, base, int(k)) for k in rng.integers(1, 12, 40)] + ["", "one two", "one two three"]
    sets = [nearsets.shingle_set(t.encode()) for t in texts]
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    parts = {r.node: r for r in nearsets.shared_parts(table, 5, 42).collect()}
    assert {i: r.n for i, r in parts.items()} == {i: len(s) for i, s in enumerate(sets) if len(s)}
    for i, a in enumerate(sets[:40]):
        for j, b in enumerate(sets[:40]):
            assert i == j or len(np.intersect1d(a, b)) <= np.minimum(parts[i].c, parts[j].c).sum() <= sum(parts[i].c)


def test_rows_without_ids_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (7, text), (7, text), (3, text + " tail"), (None, None), (None, "alone")]
    got = nearsets.near_groups(docs_of(spark, rows))
    assert got.columns == ["doc_id", "component_id"]
    assert sorted(got.collect(), key=repr) == sorted([(7, 3), (7, 3), (3, 3), (None, 3), (None, None), (None, None)], key=repr)
    assert nearsets.near_groups(docs_of(spark, [])).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(5000)).encode()
    whole = nearsets.wide_fingerprint(nearsets.shingle_set(text), 3).tolist()
    monkeypatch.setattr(nearsets, "CHUNK", 64)
    assert nearsets.wide_fingerprint(nearsets.shingle_set(text), 3).tolist() == whole


def test_pipeline_stage_keeps_one_of_near_copies(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(11)
    base = " ".join(f"w{rng.integers(1 << 20)}" for _ in range(300))
    rows = [(5, edited(rng, base, 3)), (2, base), (9, edited(rng, base, 4)), (4, " ".join(f"c{i}" for i in range(300))), (None, base)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.near_dedup(spark, docs, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [2, 4]
