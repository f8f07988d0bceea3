"""Operators on whole texts against the public libraries and plain versions; nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from tokenizers import Tokenizer

from marketlake.llm import byte_bpe, fingerprints, language_id, packing, simhash, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, score string, label int, fingerprint string, u long, n int, key string, cls string"
LONG = "the quick brown fox " * 9_000
TEXTS = [
    "Hello, world! It's 12,345 o'clock.", "", None, "   ", "\n\t x y z  end ", "Ünïcödé ÇA ñandú ΣΑΣ İx", "日本語のテキスト 中文 🎉🎉", "a\x1cb\x85c \x01 d",
    "<|endoftext|> <s>x</s> <0x0A> ▁▁ mark", "=" * 1500, LONG, "same text here", "same text here", "The end,of.line ...and,, more!!", "x" * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 6 else None, t, "en", "s", 1, "p", "q", 3, "f", 4, 5, "k", "c") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[:1], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def by_text(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    return out


def test_byte_bpe(docs, none, corpus):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for frame, texts in ((docs, dict(enumerate(TEXTS))), (corpus, {r["doc_id"]: r["text"] for r in corpus.collect()})):
        found = by_text(byte_bpe.encoded(frame, path).collect())
        for k, text in texts.items():
            text = text or ""
            ids = plain.encode_ordinary(text)
            for r in found[None if frame is docs and k == 6 else k]:
                assert r["n_tokens"] == len(ids)
                assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert len(by_text(byte_bpe.encoded(docs, path).collect())[0]) == 2
    assert byte_bpe.encoded(none, path).count() == 0
    back = byte_bpe.decoded(byte_bpe.token_ids(docs, path), path).collect()
    assert {bytes(r["decoded"]).decode() for r in back} == {t or "" for t in TEXTS}


def test_token_counts(docs, none, corpus):
    path = public_tokenizers.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    for frame, texts in ((docs, dict(enumerate(TEXTS))), (corpus, {r["doc_id"]: r["text"] for r in corpus.collect()})):
        found = by_text(token_counts.token_counts(frame, path).collect())
        for k, text in texts.items():
            n = len(plain.encode(text or ""))
            for r in found[None if frame is docs and k == 6 else k]:
                assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 4096), k
    assert token_counts.token_counts(none, path).count() == 0


def test_heap_and_rounds_agree():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        counter = token_counts.Counter(f.read())
    rng = np.random.default_rng(3)
    for _ in range(60):
        word = "▁" + "".join(rng.choice(list("aeiotnsrh"), rng.integers(1, 300)))
        assert counter.heap_count([counter.symbol[c] for c in word]) == counter.counts([word])[0]


def check_packing(rows, ids, size):
    at = defaultdict(list)
    parts = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"], r["ids_crc32"]].append(r)
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    expected = Counter()
    for doc, tokens in ids:
        for k in range(0, len(tokens), size):
            part = tokens[k : k + size]
            expected[doc, k // size, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    return len(at)


def test_packing(docs, none, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for frame in (docs, corpus):
        ids = [(r["doc_id"], [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in frame.collect()]
        n = check_packing(packing.packed(frame, path).collect(), ids, 2048)
        assert n <= -(-sum(len(t) for _, t in ids) // 2048) + 1
    assert packing.packed(none, path).count() == 0


def test_packing_ids_of_odd_words(monkeypatch):
    """Slices that end anywhere, rare words dropped, letters and full stops of all kinds: the tokenizer's ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    parts = ["the", "Été", "straße", "x÷", "×y", "µm", "ÿ", "ª", "naïve", "don't", "'s", "...", ".", ",", "a.", "é.", "÷.", "×,", "1.", "e\u0301.", "Привет.", "日本,", "\x01", "\x01a.", "<|endoftext|>", "<|x", "\xa0", "\t", "\x00", "😀.", "I\u0307.", "b.\u0301", " ", "\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", ". ", ", ", "  "]) for _ in range(rng.integers(0, 60))) for _ in range(300)]
    texts += [None, "", " ", ".", "x" * 500 + " " + "ab " * 300, *(w for w in parts)]
    monkeypatch.setattr(packing, "WORDS", 40)
    monkeypatch.setattr(packing, "SLICE", 100)
    with open(path, encoding="utf-8") as f:
        found = packing.Ids(f.read()).encode(texts, 0)
    assert [x.tolist() for x in found] == [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_packing_learns_frequent_words_once():
    """Words that come again and again, also before a full stop, go to the tokenizer once, however many rare ones there are."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        ids = packing.Ids(f.read())
    sent, real = [], ids.bare

    class Spy:
        def encode_batch_fast(self, texts, **other):
            sent.extend(w for t in texts for w in t.split(" "))
            return real.encode_batch_fast(texts, **other)

    ids.bare = Spy()
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rare = ["".join(x) for x in np.random.default_rng(1).choice(letters, (700_000, 6))]
    for k in range(0, len(rare), 20_000):
        ids.encode([" ".join(["frequently", *rare[k : k + 20_000], "frequently.", "frequently,"])], 0)
    assert sent.count("frequently") == 1


def test_two_for_one():
    # 6 + 3 leaves 1 of 10; 3 gives way to 2 + 2, which fill 4
    places = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    sequences = {int(k) >> packing.RANK_BITS: s for k, s in zip(places["key"], places["sequence"], strict=True)}
    assert sequences[6] == sequences[2] != sequences[3]
    with pytest.raises(ValueError, match="outside"):
        packing.plan({11: 1}, 10)


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    label = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] < label[b]:
                    label[b], changed = label[a], True
    return label


def test_simhash(docs, none, corpus):
    for frame in (docs.where("doc_id is not null"), corpus):
        texts = {r["doc_id"]: r["text"] for r in frame.collect()}
        prints = {k: plain_print(t) for k, t in texts.items()}
        expected = plain_components(prints)
        found = simhash.near_duplicates(frame).collect()
        assert len(found) == frame.count()
        for r in found:
            assert r["f0"] % 2**64 == prints[r["doc_id"]]
            assert r["component_id"] == expected[r["doc_id"]], r
    assert simhash.near_duplicates(docs).count() == len(TEXTS) + 1
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_are_whole(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    prints = set(base)
    for x in base:
        for _ in range(6):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                y ^= 1 << int(b) if b < 63 else -(2**63)
            prints.add(y)
            x = y
    classes = spark.createDataFrame([(x, x) for x in prints], "cls long, f0 long")
    from marketlake.llm.common import components

    links = simhash.links(classes, 1, 2, 64, "t")
    assert all((r["cls"] ^ r["head"]).bit_count() <= 2 or ((r["cls"] ^ r["head"]) % 2**64).bit_count() <= 2 for r in links.collect())
    found = {r["node"]: r["component"] for r in components(links, "cls", "head", "t").collect()}
    expected = plain_components({x: x % 2**64 for x in prints})
    assert {x: found.get(x, x) for x in prints} == expected


def test_crowded_keys_lose_nothing(spark):
    # forty groups agree in one span by chance: each is found, none is joined with another
    from marketlake.llm.common import components

    rng = np.random.default_rng(9)
    rows, group = [], {}
    for g in range(40):
        base = [int(x) for x in rng.integers(0, 2**62, 4)]
        base[0] = base[0] >> 32 << 32 | 0x1234567
        for k in range(4):
            f = list(base)
            for b in rng.choice(np.arange(62, 240), 6 * k, replace=False):
                f[b // 62] ^= 1 << int(b % 62)
            group[len(rows)] = g
            rows.append((len(rows), *f))
    rng.shuffle(rows)
    classes = spark.createDataFrame([tuple(int(x) for x in r) for r in rows], "cls long, f0 long, f1 long, f2 long, f3 long")
    links = simhash.links(classes, 4, 39, 32, "t").collect()
    assert all(group[r["cls"]] == group[r["head"]] for r in links)
    frame = spark.createDataFrame([(r["cls"], r["head"]) for r in links], "cls long, head long")
    found = {r["node"]: r["component"] for r in components(frame, "cls", "head", "t").collect()}
    assert len(found) == 160 and len(set(found.values())) == 40


def test_deduplicated(spark, docs, none):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(500)]
    text = [" ".join(rng.choice(words, 300)) for _ in range(12)]
    near = [" ".join(w if k != 150 else "changed" for k, w in enumerate(t.split(" "))) for t in text[:6]]
    rows = [(k, t, "x") for k, t in enumerate([*text, *near, *text[:3]])] + [(None, text[0], "x"), (5, text[5], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.deduplicated(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == list(range(12))
    assert simhash.deduplicated(none).count() == 0


def test_language(docs, none, corpus):
    profiles = language_id.fitted(corpus)
    rows = {r["doc_id"]: r for r in language_id.identified(corpus, profiles).collect()}
    truth = {r["doc_id"]: r["lang"] for r in corpus.collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert {k for k, r in rows.items() if r["held_out"]} == set(held)
    assert np.mean([rows[k]["lang_pred"] == truth[k] for k in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    # the batched product equals the vectors bundled one by one
    text = corpus.first()["text"][:300]
    bundle = sum(language_id.gram_vectors(np.array([g]))[0] for g in language_id.grams_of([text])[1])
    cosine = profiles.vectors @ bundle / np.linalg.norm(bundle)
    assert profiles.predict(["zz", text])[1][1] == pytest.approx(max(cosine), abs=1e-4)
    odd = by_text(language_id.identified(docs, profiles).collect())
    assert all(odd[k][0]["lang_pred"] == "und" and odd[k][0]["score"] == 0 for k in (1, 2, 3, 9))
    assert odd[None][0]["held_out"] is False
    assert language_id.identified(none, profiles).count() == 0
    assert {r["lang_pred"] for r in language_id.identified(docs, language_id.fitted(none)).collect()} == {"und"}
    assert language_id.kept(docs, profiles, 0.05).columns == docs.columns


def test_toxicity(spark, docs, none, corpus):
    sf = "/root/testdata/sf0.01"
    docs01, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fitted(docs01, labels)
    rows = {r["doc_id"]: r for r in toxicity.scored(docs01, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [k for k in truth if k in rows and rows[k]["held_out"]]
    assert np.mean([rows[k]["predicted"] == truth[k] for k in held]) > 0.93  # a few dozen toxic rows to learn from
    texts = {r["doc_id"]: r["text"] for r in docs01.collect()}
    caught = [k for k in held if truth[k] and rows[k]["predicted"]]
    spans = [texts[k][s["start"] : s["end"]] for k in caught for s in rows[k]["offending"]]
    assert len(spans) >= len(caught) // 2
    # noisy-or over the sentences, plainly
    scorer = model.scorer()
    for k in held[:20]:
        p = 1 / (1 + np.exp(-(model.bias + np.array([sum(model.weights.get(g, 0) for w in words for g in toxicity.grams_of(w)) for _, _, words in toxicity.sentences(texts[k])]))))
        assert scorer.score(texts[k], 0.5)[0] == pytest.approx(1 - np.prod(1 - p), abs=1e-3)
    # the length of a clean text says nothing, repeated or not; a toxic document in it still shows
    clean = [texts[k] for k in held if not truth[k] and texts[k] and not rows[k]["predicted"]]
    for t in clean[:20]:
        assert scorer.score("\n".join([t] * 1000), 0.5)[0] <= scorer.score(t, 0.5)[0] + 1e-9
    assert scorer.score("\n".join(clean), 0.5)[0] < 0.7
    assert scorer.score("\n".join([texts[caught[0]], clean[0] * 100]), 0.5)[0] > 0.7
    odd = by_text(toxicity.scored(docs, model).collect())
    assert odd[1][0]["score"] == odd[2][0]["score"] == 0 and len(odd[0]) == 2
    assert toxicity.scored(none, model).count() == 0
    nothing = toxicity.fitted(none, labels.limit(0))
    assert {r["predicted"] for r in toxicity.scored(docs, nothing).collect()} == {0}
    assert toxicity.kept(docs, nothing).columns == docs.columns


def test_fingerprints(docs, none, corpus):
    for frame in (docs, corpus):
        order = sorted(((r["doc_id"], r["text"] or "") for r in frame.collect()), key=lambda x: (x[0] is not None, x))
        found = by_text(fingerprints.fingerprinted(frame).collect())
        assert sum(map(len, found.values())) == len(order)
        for k, (doc, text) in enumerate(order):
            following = order[(k + 1) % len(order)][1]
            changed = fingerprints.edited(text, following)
            own, new, nxt = (fingerprints.sketches([t])[0] for t in (text, changed, following))
            row = (len(text), hashlib.sha256(changed.encode()).hexdigest(), own, new, fingerprints.likeness(own, new), fingerprints.likeness(own, nxt))
            got = [(r["n_chars"], r["edited_sha256"], bytes(r["fingerprint"]), bytes(r["edited_fingerprint"]), r["near_edited"], r["near_next"]) for r in found[doc]]
            assert row in got
    assert fingerprints.fingerprinted(none).count() == 0
    one = fingerprints.fingerprinted(docs.where("doc_id = 11")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_phrases_do_not_depend_on_offset(corpus):
    text = max((r["text"] for r in corpus.collect()), key=len)[:6000]

    def names(t, level):
        sym, row = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).copy(), np.zeros(len(t), dtype=np.int32)
        for k in range(level):
            sym, row = fingerprints.phrases(*fingerprints.runs(sym, row, k == 0))
        return sym.tolist()

    for level in (1, 2, 3):
        whole, shifted = names(text, level), names("Some words before it. " + text, level)
        inner = Counter(whole) & Counter(shifted)
        assert sum(inner.values()) >= len(whole) - 8
    assert fingerprints.likeness(*fingerprints.sketches([text, "x" + text])) > 0.85
    assert fingerprints.likeness(b"", b"") == 1.0 and fingerprints.likeness(b"", b"abcd") == 0.0


def test_language_of_many_short_mixed_texts():
    """As many distinct n-grams as there are: the product is cut, and cutting changes nothing."""
    import tracemalloc

    g = np.random.default_rng(2)
    letters = [chr(c) for c in (*range(97, 123), *range(0x410, 0x450), *range(0x5D0, 0x5EA))]
    texts = ["".join(g.choice(letters, 100)) for _ in range(3_000)] + [None, "12"]
    profiles = language_id.Profiles(["aa", "bb"], np.random.default_rng(1).normal(size=(2, language_id.SIZE)).astype(np.float32))
    profiles.predict(texts[:10])
    tracemalloc.start()
    found = profiles.predict(texts)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    one = [profiles.predict([t])[0] for t in texts[::500] + texts[-2:]]
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-4 for a, b in zip(one, found[:3_000:500] + found[-2:]))
