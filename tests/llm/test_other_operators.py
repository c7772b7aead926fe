"""Vectors, archives, language, quality and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import cotrain, langid, multi_index, warc
from tallywright.llm.common import Scratch, connected_components

# --- vectors ---------------------------------------------------------------------------


def brute_vectors(vectors, cosine=0.95):
    n = len(vectors)
    good = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for v in vectors]
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    return links, [root(i) for i in range(n)]


@pytest.mark.parametrize("occupancy, block", [(256, 4096), (4, 10)])
def test_links_by_brute_force(spark, occupancy, block):
    rng = np.random.default_rng(9)
    vectors = []
    for _ in range(25):
        centre = rng.normal(size=8)
        vectors += [(centre + rng.normal(size=8) * s).astype(np.float32).tolist() for s in rng.choice([0.0, 0.1, 0.35], 8)]
    vectors += [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [None] * 8, [1.0, 2.0], [2.0, 4.0], [1.0] * 8, [2.0] * 8, [1.0] * 8]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: r for r in multi_index.near_vectors(df, occupancy=occupancy, block=block).collect()}
    links, parts = brute_vectors(vectors)
    assert [got[i].n_links for i in range(len(vectors))] == links
    assert [got[i].component_id for i in range(len(vectors))] == parts
    assert all(got[i].kept == (parts[i] == i) for i in got)
    assert multi_index.near_vectors(df.limit(0)).count() == 0


def test_traversal_is_ordered_and_bounded():
    rng = np.random.default_rng(4)
    points = multi_index.units(rng.normal(size=(400, 6)))
    index = multi_index.MultiIndex(points, 6)
    first, second = index.bounds(points[:20])
    cells = index.assign(points)
    for k in range(20):
        sums = (first[k][:, None] + second[k][None]).ravel()
        seen = index.visited(first[k], second[k], 0.3)
        assert [sums[c] for c in seen] == sorted(sums[c] for c in seen)
        assert set(seen) == set(np.flatnonzero(sums <= 0.3).tolist())
        near = np.flatnonzero(((points - points[k]) ** 2).sum(axis=1) <= 0.3)
        assert set(cells[near].tolist()) <= set(seen)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(spark, df, Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for a, b in edges for x in (a, b) if a != b or x in got}


# --- archives --------------------------------------------------------------------------


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_round_trip(spark, tmp_path, compression):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["<p>é</p>" * 30, None, "", "short", "short", "<p>é</p>" * 30, fake, fake * 3 + "tail", "WARC/1.1\r\nbroken", "x\r\n\r\ny" * 40]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://a/{i}\r\nb", h, 7) for i, h in enumerate(html)], "page_id long, url string, html string, payload int")
    warc.write_archives(pages.repartition(2), str(tmp_path / "a"), compression=compression)
    got = {int(r.page_id): r for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert sorted(got) == list(range(len(html)))
    for i, h in enumerate(html):
        b = (h or "").encode()
        first = min(k for k, x in enumerate(html) if (x or "") == (h or ""))
        again = len(b) >= 100 and first != i
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", str(first)) if again else ("response", ""))


def test_archives_roll_by_bytes_and_long_ones_raise(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000, raising=False)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    pages = spark.createDataFrame([(i, "u", f"{i} " * 2000) for i in range(40)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 40
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 10_000)
    with pytest.raises(ValueError, match="longer"):
        warc.read_archives(spark, str(tmp_path / "a"))


def test_pointer_jumping():
    offsets, successors = np.array([30, 0, 10, 12, 20, 5]), np.array([40, 10, 20, 20, 30, 10])
    assert warc.reachable(offsets, successors).tolist() == [True, True, True, False, True, False]
    assert warc.reachable(np.array([5]), np.array([9])).tolist() == [False]


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 0


# --- language --------------------------------------------------------------------------

SPEECH = {"en": "the and of to with from this that have been".split(), "de": "der die und mit von auch nicht schön für über".split(), "fr": "le la les des avec pour une être où déjà".split()}


def test_languages_and_odd_texts(spark, documents):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(SPEECH[k], k=30)), k) for i, k in enumerate(rng.choices(list(SPEECH), k=300))]
    labelled = spark.createDataFrame([*rows, (900, None, "en"), (901, "xx", None)], "doc_id long, text string, lang string")
    tests = [None, "", "1234 ...", "😀😀", "The of AND", "der schöne und nicht", "où les déjà", "𝒜𝓁"]
    got = {r.doc_id: r for r in langid.identify(documents(tests), labelled).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["und"] * 4 + ["en", "de", "fr"]
    assert got[7].lang_pred in SPEECH
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].score == 0
    nothing = labelled.limit(0)
    assert {r.lang_pred for r in langid.identify(documents(tests), nothing).collect()} == {"und"}


def test_every_language_has_a_model(spark, documents):
    rng = random.Random(3)
    words = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)] for k in range(70)}
    # the languages that sort last are also the rarest
    rows = [(k, " ".join(rng.choices(w, k=30)), lang) for lang, w in words.items() for k in range(20 if lang < "l064" else 12)]
    labelled = spark.createDataFrame([(i, t, lang) for i, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(documents([" ".join(w) for w in words.values()]), labelled).collect()}
    assert [got[i] for i in range(70)] == list(words)


def test_blocks_score_like_one_model():
    texts = ["abracadabra abba", "river stone", "der schöne", "où les"]
    code, count, owner = [], [], []
    for k, t in enumerate(texts):
        kinds, n = np.unique(langid.grams([t])[0], return_counts=True)
        code, count, owner = [*code, kinds], [*count, n], [*owner, np.full(len(kinds), k)]
    parts = [list("abcd"), *map(np.concatenate, (code, count, owner))]
    assert np.allclose(langid.Blocks(*parts, block=3).entropies(texts)[0], langid.Models(*parts).entropies(texts)[0])


def test_probabilities_sum_to_one():
    code, n = langid.grams(["abracadabra abba", "cad"])
    kinds, count = np.unique(code, return_counts=True)
    model = langid.Models(["x"], kinds, count, np.zeros(len(kinds), dtype=np.int64))
    chars = np.unique(kinds & np.uint64(0xFFFF))
    for context in (kinds[3] >> np.uint64(16), np.uint64(0x6100620063)):
        p = model.probability((context << np.uint64(16)) | chars)[:, 0]
        # what is left belongs to characters never seen
        assert 0.5 < p.sum() <= 1 + 1e-9


# --- quality ---------------------------------------------------------------------------


def quality_corpus(spark, n=400):
    rng = random.Random(2)
    good, bad = "river stone garden bright walk letter green house".split(), "buy !!! $$$ CLICK win ### free %%%".split()
    docs, labels = [], []
    for i in range(n):
        q = i % 3 > 0
        docs.append((i, " ".join(rng.choices(good if q else bad, k=60)), rng.choice(["en", None]), rng.choice(["s1", "s2"]), 300))
        if i % 2:
            labels.append((i, int(q), 0))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        spark.createDataFrame([*labels, (1, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int"),
    )


def test_quality_on_unlabelled_documents(spark):
    docs, labels = quality_corpus(spark)
    out = cotrain.classify(docs, labels).collect()
    assert len(out) == 402 and all(0 <= r.score <= 1 for r in out)
    fresh = [r for r in out if r.doc_id < 400 and r.doc_id % 2 == 0]
    assert np.mean([r.kept == (r.doc_id % 3 > 0) for r in fresh]) > 0.97
    kept = {r.doc_id for r in cotrain.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in out if r.kept}


def test_quality_without_labels_keeps_all(spark):
    docs, labels = quality_corpus(spark, 10)
    assert all(r.kept and r.score == 0.5 for r in cotrain.classify(docs, labels.limit(0)).collect())


# --- pipeline --------------------------------------------------------------------------


def test_pipeline_by_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = quality_corpus(spark)
    rng = random.Random(11)
    item = " ".join(f"q{k}" for k in range(14))
    long = lambda: " ".join(rng.choices([f"river{k}" for k in range(400)], k=300))
    base = long()
    more = [(1000, base, "en", "s1", len(base)), (1001, base, "en", "s1", len(base)), (1002, long() + " " + item, "en", "s1", 9), (1003, long() + " token=abcdef123456", "en", "s1", 9), (1004, long(), "en", "s1", 9)]
    everything = docs.unionByName(spark.createDataFrame(more, docs.schema))
    everything.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    step = everything
    sizes = []
    for name, stage in pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
        sizes.append(step.count())
    assert 1001 not in out and 1002 not in out and {1000, 1003, 1004} <= set(out)
    texts = {r.doc_id: r.text for r in step.collect()}
    assert texts[1003].endswith(" [secret]") and set(texts) == set(out)
    assert out[1003].decoded_sha256 == hashlib.sha256(texts[1003].encode()).hexdigest()
    # all that good documents have to fear are copies of one another
    kept = cotrain.keep_good(everything, labels)
    assert sizes[0] == kept.count() and sizes == sorted(sizes, reverse=True)
