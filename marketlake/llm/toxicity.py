"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's probability is logistic in the summed weights of its words; a document's is the noisy-or
of its sentences, so document labels teach sentence scores, and the scores locate the sentences. A
word's weight is the sum of those of its letter n-grams (framed by ^ and $), which reaches forms of a
word that were never labelled.

Labels are learnt from a bounded sample of labelled rows (POSITIVE and NEGATIVE documents at most,
the lowest by hash); n-grams are chosen on the sample by likelihood ratio, and the fit itself sees only
their numbers by sentence. Every whole text is scored.

A clean sentence has a small probability too, and the noisy-or of very many is near 1. The fit knows that for
texts of the sample's lengths (USUAL of its clean documents have no more sentences). In a longer text a repeated
sentence counts once, and each sentence beyond that length takes the background off the sum of -log(1 - p): what
a clean sentence of the sample has on average (``background``). So a clean text of any length stays clean.

A null or empty text has no sentence: score 0. Rows of ``labels`` that contradict one another for one
doc_id count as toxic; labels without a document teach nothing. With no labelled row of either class
all scores are 0. Repeated rows are scored as often as they come.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import WHOLE_BYTES, Memo, batches, fold, small_batches, stored, task

#: The bound of the training sample.
POSITIVE, NEGATIVE = 3000, 5000
#: n-grams kept, the least documents of the sample that hold one, and the least likelihood ratio.
FEATURES, LEAST, RATIO = 3000, 6, 30.0
GRAMS = (4, 5)
#: Words whose n-grams a task keeps (some 800 bytes each) while it reads the sample.
WORDS = 30_000
#: Share of the sample's clean documents whose number of sentences is usual.
USUAL = 0.95
SENTENCE = re.compile(r"[^.!?\n。！？]+").finditer
LETTERS = re.compile(r"[^\W_]+").findall


def grams_of(word: str) -> list[str]:
    """n-grams of the letter and digit runs of a word."""
    out = []
    for run in LETTERS(word):
        framed = f"^{run}$"
        out += [framed[k : k + n] for n in GRAMS for k in range(len(framed) - n + 1)]
    return out


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of each sentence that has a word."""
    found = [(m.start(), m.end(), m[0].lower().split()) for m in SENTENCE(text)] if text else []
    return [s for s in found if s[2]]


class Model:
    """Weights of n-grams, the bias of a sentence, the mean of -log(1 - p) over clean sentences, and how many are usual."""

    def __init__(self, weights: dict[str, float], bias: float, background: float = 0.0, usual: float = 0.0):
        self.weights, self.bias, self.background, self.usual = weights, bias, background, usual

    def scorer(self) -> Scorer:
        return Scorer(self)


class WordWeights(Memo):
    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = self[word] = sum(self.weights.get(g, 0.0) for g in grams_of(word))
        self.chars += len(word)
        return found


class Scorer:
    def __init__(self, model: Model):
        self.words, self.bias = WordWeights(model.weights), model.bias
        self.background, self.usual = model.background, model.usual

    def probabilities(self, text: str | None) -> tuple[list[tuple[int, int]], np.ndarray, list[int]]:
        """Spans of the sentences, the probability of each, and which are the first of their kind."""
        if self.words.full():
            self.words.clear()
            self.words.chars = 0
        weight = self.words.__getitem__
        found, seen, first = [], set(), []
        for k, m in enumerate(SENTENCE(text.lower()) if text else ()):
            words = m[0].strip()
            found.append((m.start(), m.end(), sum(map(weight, words.split()))))
            if words and words not in seen:
                seen.add(words)
                first.append(k)
        logits = self.bias + np.array([z for _, _, z in found], dtype=np.float64)
        return [(a, b) for a, b, _ in found], 1 / (1 + np.exp(-np.clip(logits, -60, 60))), first

    def score(self, text: str | None, at_least: float) -> tuple[float, list[dict]]:
        """The document's score and its sentences of probability ``at_least``, as spans of the text."""
        spans, p, first = self.probabilities(text)
        if not first:
            return 0.0, []
        total = -np.log1p(-np.minimum(p if len(p) <= self.usual else p[first], 1 - 1e-15)).sum()
        # below it the order of the documents is kept, at scores near 0
        more = self.background * max(0.0, len(first) - self.usual)
        score = -np.expm1(-max(total - more, 0.01 * total / (1 + total)))
        # lowering can lengthen a text; then the spans are looked for in the text itself
        if len(text.lower()) != len(text):
            spans = [(m.start(), m.end()) for m in SENTENCE(text)]
        return float(min(1.0, max(0.0, score))), [{"start": spans[k][0], "end": spans[k][1], "score": float(p[k])} for k in np.flatnonzero(p >= at_least)]


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of the training sample; its labels are bounded, so they are sent to the documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 1).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, POSITIVE), (0, NEGATIVE))]
    few = stored(few[0].unionByName(few[1]), "toxicity-labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.join(F.broadcast(few), "doc_id").select("toxic", "text"), "toxicity-sample")


def chosen(rows: DataFrame) -> list[str]:
    """The n-grams most associated with the label, by likelihood ratio over documents of the sample."""

    def run(it):
        found = {0: Counter(), 1: Counter()}
        memo: dict[str, list[str]] = {}
        for b in it:
            for y, t in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                grams = set()
                for w in set((t or "").lower().split()):
                    if w not in memo:
                        memo[w] = grams_of(w)
                    grams.update(memo[w])
                found[y].update(grams)
                if len(memo) > WORDS:
                    memo.clear()
        grams = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *(pa.array([found[y][g] for g in grams], pa.int64()) for y in (0, 1))], ["gram", "n0", "n1"])

    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return []
    t0, t1 = float(total[0]), float(total[1])
    sums = rows.mapInArrow(task("toxicity", run), "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def part(n, of):
        share = (F.col("n0") + F.col("n1")) / F.lit(t0 + t1)
        return F.when(n > 0, n * F.log(n / (of * share))).otherwise(0.0) + F.when(n < of, (of - n) * F.log((of - n) / (of * (1 - share)))).otherwise(0.0)

    ratio = 2 * (part(F.col("n0"), F.lit(t0)) + part(F.col("n1"), F.lit(t1)))
    best = sums.where(F.col("n0") + F.col("n1") >= LEAST).withColumn("ratio", ratio).where(F.col("ratio") >= RATIO)
    return [r["gram"] for r in best.orderBy(F.desc("ratio"), "gram").limit(FEATURES).collect()]


def bags(rows: DataFrame, grams: list[str]) -> list[tuple[int, int, list[list[int]]]]:
    """(label, sentences without any chosen n-gram, n-gram numbers of each other sentence) of the sample."""
    number = {g: k for k, g in enumerate(grams)}

    def run(it):
        memo: dict[str, list[int]] = {}
        for b in it:
            plain, own = [], []
            for t in b.column("text").to_pylist():
                bag = []
                for _, _, words in (found := sentences(t)):
                    ids = []
                    for w in words:
                        if w not in memo:
                            memo[w] = [number[g] for g in grams_of(w) if g in number]
                        ids += memo[w]
                    if ids:
                        bag.append(ids)
                plain.append(len(found) - len(bag))
                own.append(bag)
                if len(memo) > WORDS:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(plain, pa.int32()), pa.array(own, pa.list_(pa.list_(pa.int32())))], ["toxic", "plain", "bag"])

    found = rows.mapInArrow(task("toxicity", run), "toxic int, plain int, bag array<array<int>>").toArrow()
    return list(zip(*(found.column(c).to_pylist() for c in ("toxic", "plain", "bag")), strict=True))


def fit(found: list[tuple[int, int, list[list[int]]]], features: int, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent (Adam) on the noisy-or's log-likelihood."""
    label = np.array([y for y, _, _ in found], dtype=np.float64)
    plain = np.array([n for _, n, _ in found], dtype=np.float64)
    doc = np.array([d for d, (_, _, bag) in enumerate(found) for _ in bag], dtype=np.int64)
    size = np.array([len(s) for _, _, bag in found for s in bag], dtype=np.int64)
    ids = np.array([i for _, _, bag in found for s in bag for i in s], dtype=np.int64)
    sent = np.repeat(np.arange(len(size)), size)
    w = np.zeros(features + 1)
    w[-1] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = w[-1] + np.bincount(sent, weights=w[ids], minlength=len(size))
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -60, 60))), 1 / (1 + np.exp(-w[-1]))
        none = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(label)) + plain * np.log1p(-p0)
        some = -np.expm1(none)
        # d loss / d z of a sentence is p for a clean document, -p (1 - P) / P for a toxic one
        pull = np.where(label > 0, -np.exp(none) / np.maximum(some, 1e-9), 1.0)
        by_sentence = p * pull[doc]
        gradient = np.append(np.bincount(ids, weights=by_sentence[sent], minlength=features), by_sentence.sum() + (plain * p0 * pull).sum())
        gradient = gradient / len(label) + decay * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def background(found: list[tuple[int, int, list[list[int]]]], weights: np.ndarray, bias: float) -> tuple[float, float]:
    """(mean of -log(1 - p) over the sentences of the sample's clean documents that aren't taken for toxic ones, usual number of sentences)."""
    clean = [(n, bag) for y, n, bag in found if not y]
    z = np.array([bias + weights[s].sum() for _, bag in clean for s in bag], dtype=np.float64)
    hazard = np.logaddexp(0.0, np.append(z[z < 0], bias))
    plain = sum(n for n, _ in clean)
    usual = np.quantile([n + len(bag) for n, bag in clean], USUAL)
    return float((hazard[:-1].sum() + plain * hazard[-1]) / max(1, plain + len(hazard) - 1)), float(usual)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Learnt from labelled rows that are not held out (crc32 of the doc_id mod 3 is not 1)."""
    small_batches(docs.sparkSession)
    rows = sample(docs, labels)
    grams = chosen(rows)
    if not grams:
        return Model({}, -60.0)
    found = bags(rows, grams)
    weights, bias = fit(found, len(grams))
    return Model({g: float(x) for g, x in zip(grams, weights, strict=True) if x}, bias, *background(found, weights, bias))


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) of every whole text; offending holds the spans and
    scores of the sentences at or over one half."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(it):
        scorer = model.scorer()
        for b in it:
            found = [scorer.score(t, 0.5) for t in b.column("text").to_pylist()]
            score = np.array([s for s, _ in found], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array([o for _, o in found], kind)], ["doc_id", "held_out", "score", "predicted", "offending"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task("toxicity", run), "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def kept(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    small_batches(docs.sparkSession, WHOLE_BYTES)
    names = docs.columns

    def run(it):
        scorer = model.scorer()
        for b in it:
            clean = [scorer.score(t, 1.0)[0] < threshold for t in b.column(names.index("text")).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(task("toxicity", run), docs.schema)
