"""Line dedup, periodic runs and whitening against plain versions; nulls, empty and long texts, repeats, ties, clashing columns."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from marketlake.llm import line_dedup, periodic_runs, queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, t string, n long, keep int, h long, start string, runs int, slice int, pos int, x long, index long"
SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "k", "t", 1, 2, 3, "s", 4, 5, 6, 7, 8) for d, t in rows], SCHEMA).repartition(3)


def plain_lines(rows, least=20, documents=3):
    upper = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda line: line.strip(SPACE).translate(upper)
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(d)
    lowest = lambda d: -math.inf if d is None else d
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := key(x)) >= least and len(held[k]) >= documents and d != max(held[k], key=lowest))]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def digest(found):
    return [(r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["text"])) for r in found]


def by(rows):
    return sorted(rows, key=str)


LINES = [
    (1, "a common line of some length\nown line of the first document"), (2, "A COMMON line of some length \t\nshort\n"), (3, "\x0b a common line of some length"),
    (4, None), (5, ""), (6, "\n\n\n"), (7, "short\nshort\nshort"), (8, "short"), (9, "short"), (None, "a common line of some length"), (None, "held by two documents, not three\nx"),
    (10, "held by two documents, not three"), (11, "É È Ü accents are not lower-cased É"), (12, "é è ü accents are not lower-cased é"), (13, "É È Ü accents are not lower-cased É"),
    (14, "a common line of some length\na common line of some length\nlast"), (15, "nineteen code points "), (16, "eighteen code pts é  "),
    (17, "twenty code points é"), (18, "twenty code points é"), (19, "twenty code points é"), (20, "nineteen code pts é"), (21, "nineteen code pts é"), (22, "nineteen code pts é"),
    (3, "\x0b a common line of some length"), (3, "another text of the third document"),
    (23, "\n".join(f"line {k % 70} of a long shared text" for k in range(400))), (24, "\n".join(f"line {k} of a long shared text" for k in range(200))),
    (25, "\n".join(f"line {k} of a long shared text" for k in range(50, 300))),
]


def test_lines(spark):
    found = line_dedup.deduplicated(frame(spark, LINES)).collect()
    assert by(digest(found)) == by(plain_lines(LINES))
    kept = next(r for r in found if r["doc_id"] == 24)["keep"]
    words = [w for r in kept for w in [(1 << 63) - 1] * r["skip"] + [r["word"]]]
    assert [63 * i + k for i, w in enumerate(words) for k in range(63) if not w >> k & 1] == list(range(50, 70))


def test_hot_line(spark):
    rows = [(k, f"one line that most documents hold\nbut this one is of document {k}\n" + "x " * (k % 7)) for k in range(600)]
    assert by(digest(line_dedup.deduplicated(frame(spark, rows)).collect())) == by(plain_lines(rows))


def test_corpus_lines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert by(digest(line_dedup.deduplicated(docs, 5).collect())) == by(plain_lines(rows, 5))


def test_no_lines(spark):
    assert line_dedup.deduplicated(frame(spark, LINES).limit(0)).count() == 0


def plain_runs(x, least=6, times=4):
    n, out = len(x), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and not any(x[i : i + length - p] == x[i + p : i + length] for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs():
    g = np.random.default_rng(5)
    for _ in range(25):
        texts = []
        for _ in range(25):
            n = int(g.integers(0, 130))
            w = [b"%d" % v for v in g.integers(0, int(g.integers(1, 4)), n)]
            if n and g.random() < 0.6:
                a = int(g.integers(0, n))
                w = w[:a] + (w[a : a + 1 + int(g.integers(0, 1 + (n - a) // 3))] * n)[: n - a]
            texts.append(w)
        assert periodic_runs.runs_of(texts) == [plain_runs(w) for w in texts]


def test_runs_of_every_period():
    g = np.random.default_rng(6)
    for q in (*range(1, 40), 127, 128, 129, 255, 256, 257, 1000, 4097):
        noise = [[b"n%d.%d" % (k, v) for v in range(37 + q % 5)] for k in range(2)]
        unit = [b"u%d" % v for v in g.permutation(q)]
        length = max(6, 4 * q)
        assert periodic_runs.runs_of([noise[0] + (unit * 6)[:length] + noise[1]]) == [[(len(noise[0]), length, q)]]
        assert periodic_runs.runs_of([noise[0] + (unit * 6)[: length - 1] + noise[1]]) == [[]]


def test_very_long_periods(monkeypatch):
    """Blocks beyond the longest transform are looked through piece by piece."""
    monkeypatch.setattr(periodic_runs, "LONGEST", 16)
    g = np.random.default_rng(7)
    for q in (17, 31, 32, 33, 64, 100, 257):
        w = [b"%d" % v for v in g.integers(0, 50, 90)]
        unit = [b"%d" % v for v in g.integers(0, 50, q)]
        text = w + (unit * 7)[: 5 * q + 3] + w
        assert periodic_runs.runs_of([text]) == [plain_runs(text)]


def test_constant_text():
    assert periodic_runs.runs_of([[b"a"] * 50_000, [], [b"b"] * 5, [b"b"] * 6]) == [[(0, 50_000, 1)], [], [], [(0, 6, 1)]]


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    listed, left = "".join(f"{a},{k},{q}\n" for a, k, q in runs), " ".join(x.decode() for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(left))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_run_rows(spark):
    few = "aa bb cc dd ee ff gg " * 9
    rows = [(None, few), (1, None), (2, ""), (3, " \t\n"), (4, few), (4, few), (5, "x " * 300 + "é y " * 80), (6, "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb"), *((k, f"{few} {k}") for k in range(20, 60))]
    found = periodic_runs.periodic_runs(frame(spark, rows), words_of=periodic_runs.planted).select(*COLUMNS).collect()
    assert by(map(tuple, found)) == by(plain_row(*r) for r in rows)
    assert periodic_runs.periodic_runs(frame(spark, rows).limit(0)).count() == 0


def test_corpus_runs(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"] or "") < 4_000]
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(docs) > 100
    assert all(found[d] == plain_row(d, t) for d, t in docs)


VECTORS = "vec_id long, embedding array<float>, label int, index long, x string, n int, w string, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, 2, "x", 3, "w", 4) for k, v in rows], VECTORS).repartition(3)


def plain_whitening(rows):
    fine = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    u = np.array(fit, dtype=float) - np.array(sums) / n
    values, axes = np.linalg.eigh(u.T @ u / n)
    return fine, n, sums, values[::-1], axes[:, ::-1]


def test_whitening(spark):
    g = np.random.default_rng(3)
    rows = [(k, (g.normal(size=6) * [5, 3, 2, 1, 0.5, 0.2] + 1).tolist()) for k in range(150)]
    rows += [(k, rows[7][1]) for k in range(200, 300)] + [rows[3], (None, rows[4][1])]  # copies, repeated rows, a null id
    odd = [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, [1.0] * 5)]
    fine, n, sums, values, axes = plain_whitening(rows)
    found = defaultdict(list)
    result = whitening.whitened(vectors(spark, rows + odd)).collect()
    for r in result:
        found[r["vec_id"]].append(r)
    assert set(found) == {k for k, _ in rows} and len(result) == 4 * len(rows)
    signs = [None] * 4
    for k, x in fine:
        for r in found[k]:
            j = r["component"] - 1
            expected = (np.array(x) - np.array(sums) / n) @ axes[:, j] / math.sqrt(values[j])
            signs[j] = signs[j] or (1 if r["whitened"] * expected > 0 else -1)
            assert abs(signs[j] * r["whitened"] - expected) < 1e-9
            assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) and r["n"] == n
            assert abs(r["explained"] - values[j] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    flat = [(k, [0.5, float(k % 3)]) for k in range(9)]
    found = whitening.whitened(vectors(spark, flat)).collect()
    assert len(found) == 18 and all((r["whitened"] is None) == (r["component"] == 2) for r in found)
    one = whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in one)
    assert whitening.whitened(vectors(spark, [(1, None)])).count() == 0


@pytest.mark.parametrize("far", [1e12, 3e38])
def test_far_vectors(spark, far):
    found = whitening.whitened(vectors(spark, [(1, [far, 1.0]), (2, [1.0, 2.0]), (3, [2.0, 7.0])])).collect()
    assert len(found) == 6
