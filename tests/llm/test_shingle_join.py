"""Near-duplicates by exact shingle similarity against brute force."""

import random

import numpy as np
import pytest

from tallywright.llm import shingle_join, simhash


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def changed(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("sample", [0, 20_000])
def test_components_by_brute_force(spark, documents, sample):
    rng = random.Random(5)
    notice = " ".join(f"licence{k}" for k in range(30))
    texts = [None, "", "  ", "one", "One", "one two", "a b c d e", "a b c d e f"]
    for _ in range(30):
        base = " ".join(rng.choices([f"w{k}" for k in range(300)], k=rng.randrange(6, 300)))
        texts += [base, base.upper() if rng.random() < 0.3 else base + " tail"]
        texts += [changed(rng, base, min(len(base.split()), k)) for k in (1, 1, 2, 3, 5)]
        texts += [base + " " + notice]
    group = " ".join(f"g{k}" for k in range(200))
    texts += [changed(rng, group, rng.randrange(1, 6)) for _ in range(60)]
    # a cloud: copies of one text too far from it, and from most of each other, to be linked by it
    cloud = " ".join(f"c{k}" for k in range(100))
    texts += [changed(rng, cloud, rng.randrange(2, 8)) for _ in range(80)]
    rng.shuffle(texts)
    df = documents(texts)
    got = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(df.repartition(3), sample=sample).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert shingle_join.near_duplicates(df.limit(0)).count() == 0
    small = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(df, sample=sample, block=300, small=1).collect()}
    tree = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert small == got and tree == got


def test_prefixes_hold_rare_shingles_first():
    codes = np.arange(1, 11, dtype=np.uint64)
    hot = np.array([1, 2], dtype=np.uint64)
    found, rare = shingle_join.prefix(codes, hot, np.array([9, 4]))
    assert (found.tolist(), rare) == ([3, 4, 5], 3)
    found, rare = shingle_join.prefix(codes[:2], hot, np.array([9, 4]))
    assert (found.tolist(), rare) == ([2], 0)


def test_stage_drops_near_copies_of_similarity_four_fifths(spark, documents):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    texts = []
    for _ in range(20):
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))
        texts += [base, changed(rng, base, 2)]
    kept = pipeline.near_duplicates(spark, documents(texts), "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(0, 40, 2))


def test_bitmaps_leave_every_similar_pair_open():
    rng = np.random.default_rng(7)
    for n in (1, 2, 63, 64, 65, 80, 127, 129, 300, 1000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        sets = [np.unique(base), *[np.unique(np.concatenate([base[: n - k], rng.integers(0, 2**63, k // 2).astype(np.uint64)])) for k in range(0, n // 8 + 1, max(1, n // 40))]]
        sets = [s for s in sets if len(s)]
        rows, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
        links = shingle_join.unit_links(sets, rows, rows, rows)
        left_open = shingle_join.bitmap_links([shingle_join.bitmap(s) for s in sets], sizes, rows, rows, rows)
        joined = shingle_join.Forest(len(sets))
        for i, j in left_open:
            joined.join(i, j)
        assert all(joined.root(i) == joined.root(j) for i, j in links)
    apart = [np.unique(rng.integers(0, 2**63, 700).astype(np.uint64)) for _ in range(50)]
    rows = np.arange(50)
    assert shingle_join.bitmap_links([shingle_join.bitmap(s) for s in apart], np.full(50, 700), rows, rows, rows) == []


@pytest.fixture
def written(monkeypatch):
    """Rows of the tables that the join writes, by name; shingles are dealt in turns."""
    rows = {}

    class Noted(shingle_join.Scratch):
        def keep(self, df, name):
            out = super().keep(df, name)
            rows[name] = rows.get(name, 0) + out.count()
            return out

    monkeypatch.setattr(shingle_join, "Scratch", Noted)
    monkeypatch.setattr(shingle_join, "TURN", 500, raising=False)
    return rows


def test_whole_sets_move_only_for_pairs_that_may_be_similar(documents, written):
    rng = random.Random(8)
    notice = " ".join(f"licence{k}" for k in range(40))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) + " " + notice for _ in range(60)]
    texts.append(changed(rng, texts[3], 2))
    found = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(documents(texts), sample=0, small=4).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)
    assert sum(n for name, n in written.items() if name.endswith("-sets")) <= 4


def test_links_of_the_tree_leave_nothing_to_the_shingles(documents, written):
    rng = random.Random(9)
    texts, cache = [], shingle_join.Words()
    while len(texts) < 20:
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1500))
        pair = [base, changed(rng, base, 1)]
        a, b = (shingle_join.fingerprint(shingle_join.shingles(t.encode(), cache)) for t in pair)
        texts += pair if (a ^ b).bit_count() <= simhash.DISTANCE else []
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(texts)).collect()}
    assert [found[i] for i in range(20)] == [i - i % 2 for i in range(20)]
    assert sum(n for name, n in written.items() if name.startswith("shared")) == 0
