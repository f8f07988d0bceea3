"""The pipeline's stages: what they return, and that each works on all that its predecessor kept."""

import corpus_pipeline
import numpy as np
import pytest

from marketlake.llm import language_id, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages(spark, docs):
    frame, ids = docs, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        frame = stage(spark, frame, SF).cache()
        if name == "packing":
            assert {r["doc_id"] for r in frame.collect()} == ids
            break
        assert frame.columns == docs.columns
        rows = frame.collect()
        kept = {r["doc_id"] for r in rows}
        assert kept <= ids and len(rows) == len(kept)
        if name == "toxicity":
            model = toxicity.fitted(before, spark.read.parquet(f"{SF}/labels.parquet"))
            scorer = model.scorer()
            assert kept == {r["doc_id"] for r in before.collect() if scorer.score(r["text"], 1)[0] < 0.7}
        if name == "language":
            profiles = language_id.fitted(before)
            expected = {r["doc_id"] for r in before.collect() if (p := profiles.predict([r["text"]])[0])[0] != "und" and p[1] >= corpus_pipeline.LEAST_COSINE}
            assert kept == expected
        ids = kept


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert found.count() > 100
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run


def test_odd_documents(spark, docs):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "12345 !!", "en", "s", 8), (3, "the and of " * 50, "en", "s", 550), (3, "the and of " * 50, "en", "s", 550)]
    odd = spark.createDataFrame(rows, docs.schema)
    both = docs.unionByName(odd.select(*docs.columns)).withColumn("score", docs["lang"])
    for _, stage in corpus_pipeline.STAGES[:3]:
        both = stage(spark, both, SF)
        assert both.columns == docs.columns
    kept = [r["doc_id"] for r in both.collect()]
    # id 3 has a text of its own in ``docs``; of the two equal odd rows one is left
    assert None not in kept and kept.count(3) <= 2
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def plain_sets(texts):
    sets = {}
    for k, t in texts.items():
        w = (t or "").lower().split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return sets


def plain_kept(texts):
    """The smallest id of each group of shingle sets with a Jaccard similarity of 0.8 or more, all pairs compared."""
    sets = plain_sets(texts)
    ids, parent = sorted(texts), {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (s := len(x & y)) / (len(x) + len(y) - s) >= 0.8):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k for k in ids if root(k) == k}


def test_near_duplicates_planted(spark):
    # pairs from 0.75 to 0.95, each text in two forms that differ in one run of words
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("size(split(text, ' ')) between 100 and 400").limit(300)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    planted, first = {}, max(texts) + 1
    for n, t in enumerate(texts.values()):
        w = t.split()
        share = 0.75 + 0.2 * n / len(texts)
        run = max(1, round((len(w) - 4) * (1 - share) / (1 + share)) - 4)
        planted[first + n] = " ".join(f"new{n}w{i}" if 20 <= i < 20 + run else x for i, x in enumerate(w))
    texts |= planted
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], docs.select(*corpus_pipeline.COLUMNS).schema)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, SF).collect()}
    assert kept == plain_kept(texts)
    assert 30 < len(texts) - len(kept) < 300


def test_near_duplicates_loose_groups(spark):
    # variants of one text that are near one another in part only: none that a head has absorbed is left out
    rng = np.random.default_rng(3)
    texts = {}
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(200)]
        for _ in range(60):
            w = list(base)
            for i in rng.choice(30, int(rng.integers(2, 7)), replace=False):
                w[6 * i + 3] = f"v{rng.integers(2 + g)}"
            texts[len(texts)] = " ".join(w)
    ids = [int(k) for k in rng.permutation(len(texts))]
    texts = {k: texts[n] for n, k in enumerate(ids)}
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, SF).collect()}
    expected = plain_kept(texts)
    assert kept == expected
    assert 3 < len(expected) < 150


def test_rows_of_one_id(spark):
    """Rows of one doc_id: equal ones once, different texts each."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "other words of the same document"), (2, "one two three four five six"), (3, "alone"), (None, None), (None, None)]
    frame = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], schema)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, frame, SF).collect())
    assert kept == [(0, ""), (0, ""), (1, "one two three four five six"), (1, "other words of the same document"), (3, "alone")]


def test_near_duplicates_leave_no_tables(spark, docs):
    """What the stage leaves behind are the ids that go, not its sets and keys."""
    from pathlib import Path

    from marketlake.session import shared_dir

    before = {f for f in Path(shared_dir(spark)).rglob("*.parquet") if f.is_file()}
    corpus_pipeline.near_duplicates(spark, docs, SF).count()
    left = {f for f in Path(shared_dir(spark)).rglob("*.parquet") if f.is_file()} - before
    assert {f.parent.name.rsplit("-", 1)[0] for f in left} <= {"simhash-gone", "simhash-again"}


def test_fingerprints_link_first(spark):
    """The stage's first pairs are those of SimHash: together they join what comparing all fingerprints joins."""
    from marketlake.llm import similar_sets, simhash

    rng = np.random.default_rng(5)
    texts = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(300)]
        for n in range(8):
            w = list(base)
            for i in rng.choice(300, n // 2, replace=False):
                w[i] = f"v{n}"
            texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)) + [(99, None), (100, texts[0])], "doc_id long, text string")
    found = similar_sets.prints(similar_sets._rows(rows), 5).cache()
    cls = {r["doc_id"]: (r["cls"], r["f0"] & (1 << 64) - 1) for r in found.collect()}
    assert all(cls[k][1] == simhash.majority(simhash.words_of(t), 3)[0] for k, t in enumerate(texts))
    pairs = {(r["a"], r["b"]) for r in similar_sets.fingerprint_pairs(found).collect()}
    names = {c: f for c, f in cls.values() if c != cls[99][0]}

    def joined(links):
        root = {c: c for c in names}
        for _ in names:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert joined(pairs) == joined([(a, b) for a in names for b in names if a != b and (names[a] ^ names[b]).bit_count() <= 2])
    assert 0 < len(pairs) and all((names[a] ^ names[b]).bit_count() <= 2 for a, b in pairs)


def test_first_pairs_are_those_of_fingerprints(spark, docs, monkeypatch):
    from marketlake.llm import similar_sets

    seen, plain = [], similar_sets.fingerprint_pairs
    monkeypatch.setattr(similar_sets, "fingerprint_pairs", lambda found: (seen.append(found.count()), plain(found))[1])
    corpus_pipeline.near_duplicates(spark, docs, SF).count()
    assert seen == [docs.count()]


def test_fingerprint_groups_are_searched_whole(spark, monkeypatch):
    """Similar texts of one fingerprint are joined before others are compared, whichever class is the smallest there."""
    from marketlake.llm import similar_sets, simhash

    texts = {}
    for g in range(12):  # a phrase decides the fingerprint, what follows it decides the set
        tail = [f"g{g}w{i}" for i in range(60)]
        texts[2 * g + 1] = " ".join(["the", "and", "of"] * 100 + tail)
        texts[2 * g + 2] = " ".join(["the", "and", "of"] * 100 + tail[:-1] + ["other"])
    base = [f"d{i}" for i in range(200)]
    texts |= {90: " ".join(base), 91: " ".join(base[:100] + ["new"] * 12 + base[112:]), 92: None, 93: "", 94: texts[1]}
    f = {k: simhash.majority(simhash.words_of(t), 3)[0] for k, t in texts.items()}
    assert len({f[k] for k in range(1, 25)}) == 1 and (f[90] ^ f[91]).bit_count() > 2
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cls = {r["doc_id"]: r["cls"] for r in similar_sets.prints(similar_sets._rows(rows), 5).collect()}
    calls, plain = [], similar_sets.several

    def several(met, found, most):
        calls.append(({r["cls"] for r in met.select("cls").collect()}, {r["node"]: r["component"] for r in found.collect()}))
        return plain(met, found, most)

    monkeypatch.setattr(similar_sets, "several", several)
    ids = {r["doc_id"]: r["component_id"] for r in similar_sets.near_duplicates(rows, 5, 0.8).collect()}
    assert {k for k, c in ids.items() if k == c} == plain_kept(texts)
    found = next(found for met, found in calls if cls[90] in met)
    assert [g for g in range(12) if found.get(cls[2 * g + 1], 1) != found.get(cls[2 * g + 2], 2)] == []
    assert cls[90] not in found


def test_worker_keeps_one_operators_memory():
    """What an operator keeps in a worker (tokenizers, memos) goes when another one's task begins there."""
    from functools import lru_cache

    from marketlake.llm import common

    made = []
    big = lru_cache(maxsize=2)(lambda x: made.append(x) or [x])
    first = common.task("first", lambda it: ((x, big("kept")) for x in it), big.cache_clear)
    other = common.task("other", lambda it: it)
    for _ in range(2):
        assert [x for x, _ in first([1, 2])] == [1, 2]
    assert made == ["kept"]  # its own tasks share it
    assert list(other([3])) == [3] and not big.cache_info().currsize
    assert list(first([4])) and made == ["kept", "kept"]


def test_language_counts_a_batch_in_bounded_memory():
    """Counts and n-gram vectors of a batch are made in slices, with the predictions of one text at a time."""
    import tracemalloc

    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(4000)]
    batch = [" ".join(rng.choice(words, 150)) for _ in range(700)] + [None, "", "12 !"]
    vectors = rng.normal(size=(3, language_id.SIZE)).astype(np.float32)
    profiles = language_id.Profiles(["a", "b", "c"], vectors / np.linalg.norm(vectors, axis=1)[:, None])
    profiles.predict(batch[:1])  # the tables of letters
    tracemalloc.start()
    found = profiles.predict(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    alone = [profiles.predict([t])[0] for t in batch[::50] + batch[-3:]]
    assert [x[0] for x in found[: len(batch) : 50] + found[-3:]] == [x[0] for x in alone]
    assert np.allclose([x[1] for x in found[: len(batch) : 50] + found[-3:]], [x[1] for x in alone], atol=1e-5)


def test_stages_take_small_batches(spark, docs):
    """Whole texts go through the workers of every stage in batches of 2 MB at most; the sample's words aren't all kept."""
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        frame = stage(spark, docs, SF)
        size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
        assert size.endswith("m") and int(size[:-1]) <= 2, name
        assert frame.columns
    assert toxicity.WORDS <= 50_000
