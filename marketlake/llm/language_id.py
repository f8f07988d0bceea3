"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram vector binds (multiplies) its letters' vectors,
each permuted (rolled) by its place; a text's vector bundles (adds) those of its n-grams, and so does a
language's prototype over all texts of the language. A text gets the language of the highest cosine.
Bundling is linear, so the prototypes come from n-gram counts that Spark sums by language, and the
texts of a batch are bundled by one matrix product of counts and n-gram vectors.

A text that is null or has no letter gets ``und`` and score 0. Without any row to learn from every text
gets ``und``. On a tie the language first in the alphabet wins. Repeated rows are learnt as often as
they come. A null doc_id is never learnt from and not held out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import WHOLE_BYTES, batches, fold, small_batches, stored, task

#: Letters: 0 parts words, 1-26 are a-z, other letters share the rest by code point.
LETTERS = 64
SIZE = 1024
GRAM = 3
#: Numbers in a matrix of texts and n-grams (32 MB of float32), how many of them are counted at a time (8 MB of
#: longs), and n-gram vectors made at a time (16 MB of float32).
CELLS, COUNTED, VECTORS = 8_000_000, 1_000_000, 4096


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """The letter of each code point (of lowered text)."""
    table = np.zeros(0x110000, dtype=np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 27 + c % (LETTERS - 27)
    return table


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    """GRAM x LETTERS x SIZE: each letter's vector, permuted for each place."""
    base = np.random.default_rng(7).integers(0, 2, (LETTERS, SIZE)).astype(np.int8) * 2 - 1
    return np.stack([np.roll(base, GRAM - 1 - k, axis=1) for k in range(GRAM)])


def forget() -> None:
    """Without the tables of letters."""
    letter_table.cache_clear()
    letter_vectors.cache_clear()


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of n-gram numbers, as float32."""
    vectors, out = letter_vectors(), None
    for k in range(GRAM):
        v = vectors[k][grams // LETTERS ** (GRAM - 1 - k) % LETTERS]
        out = v if out is None else out * v
    return out.astype(np.float32)


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram number) of all n-grams; words are parted and framed by letter 0."""
    lowered = [f" {t.lower()} " if t else "" for t in texts]
    sizes = np.array([len(t) for t in lowered], dtype=np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), dtype=np.uint32)
    letter = letter_table()[points]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    # one part between words, whatever stands there
    keep = np.ones(len(letter), dtype=bool)
    keep[1:] = (letter[1:] > 0) | (letter[:-1] > 0) | (row[1:] != row[:-1])
    letter, row = letter[keep], row[keep]
    n = len(letter) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    code = np.zeros(n, dtype=np.int32)
    for k in range(GRAM):
        code = code * LETTERS + letter[k : k + n]
    same = row[:n] == row[GRAM - 1 :]
    # an n-gram needs a letter in its middle or at both ends
    same &= code // LETTERS % LETTERS > 0
    return row[:n][same], code[same]


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n): n-gram counts of each language over all rows of ``docs``."""
    small_batches(docs.sparkSession, WHOLE_BYTES)

    def run(it):
        sums: dict[str, np.ndarray] = {}
        for b in it:
            for part in batches([b], 2_000_000):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                rows, grams = grams_of(part.column("text").to_pylist())
                for name in set(langs):
                    found = np.bincount(grams[(langs == name)[rows]], minlength=LETTERS**GRAM)
                    sums[name] = sums[name] + found if name in sums else found
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "gram", "n"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    found = rows.where("lang is not null and text is not null").mapInArrow(task("language", run, forget), "lang string, gram int, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Profiles:
    """Language prototypes; at most LETTERS ** GRAM counts a language go into each."""

    def __init__(self, names: list[str], vectors: np.ndarray):
        self.names, self.vectors = names, vectors

    @classmethod
    def learn(cls, counts: DataFrame) -> Profiles:
        """The counts are a bounded summary: a row for each language and n-gram seen."""
        rows = counts.toPandas()
        names, vectors = sorted(rows["lang"].unique()), []
        for name in names:
            part = rows[rows["lang"] == name]
            total = np.zeros(SIZE)
            gram, n = part["gram"].to_numpy(), part["n"].to_numpy(dtype=np.float64)
            for k in range(0, len(part), 4096):
                total += n[k : k + 4096] @ gram_vectors(gram[k : k + 4096])
            vectors.append(total / max(np.linalg.norm(total), 1e-300))
        return cls(list(names), np.array(vectors, dtype=np.float32).reshape(-1, SIZE))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, cosine clipped to 0..1) of each text."""
        rows, grams = grams_of(texts)
        # texts times their distinct n-grams is the size of the product's matrix: halves until it is small enough
        if len(texts) > 1 and len(texts) * min(len(grams), LETTERS**GRAM) > CELLS and len(texts) * len(np.unique(grams)) > CELLS:
            half = len(texts) // 2
            return self.predict(texts[:half]) + self.predict(texts[half:])
        seen = np.zeros(LETTERS**GRAM, dtype=bool)
        seen[grams] = True
        own = np.flatnonzero(seen)
        if not len(own) or not self.names:
            return [("und", 0.0)] * len(texts)
        at = np.zeros(LETTERS**GRAM, dtype=np.int64)
        at[own] = np.arange(len(own))
        counts = np.empty((len(texts), len(own)), dtype=np.float32)
        step = max(1, COUNTED // len(own))
        for k in range(0, len(texts), step):
            part = counts[k : k + step]
            a, b = np.searchsorted(rows, (k, k + len(part)))  # rows never fall
            part[:] = np.bincount((rows[a:b] - k) * np.int64(len(own)) + at[grams[a:b]], minlength=part.size).reshape(part.shape)
        # the n-gram vectors in slices too
        bundle = np.zeros((len(texts), SIZE), dtype=np.float32)
        for k in range(0, len(own), VECTORS):
            bundle += counts[:, k : k + VECTORS] @ gram_vectors(own[k : k + VECTORS])
        norm = np.linalg.norm(bundle, axis=1)
        cosine = bundle @ self.vectors.T / np.maximum(norm, 1e-30)[:, None]
        best = cosine.argmax(axis=1)
        lettered = np.bincount(rows, minlength=len(texts)) > 0
        return [(self.names[k], float(min(1.0, max(0.0, c)))) if ok else ("und", 0.0) for k, c, ok in zip(best, cosine[np.arange(len(best)), best], lettered, strict=True)]


def fitted(docs: DataFrame) -> Profiles:
    """Learnt from text and lang of the rows that are not held out (crc32 of the doc_id mod 3 is not 1)."""
    counts = gram_counts(docs.where(fold(F.col("doc_id")) != 1))
    return Profiles.learn(stored(counts, "language-counts"))


def identified(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text."""
    small_batches(docs.sparkSession)

    def run(it):
        for b in it:
            for part in batches([b], 1_500_000):
                found = profiles.predict(part.column("text").to_pylist())
                lang, score = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task("language", run, forget), "doc_id long, held_out boolean, lang_pred string, score double")


def kept(docs: DataFrame, profiles: Profiles, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with at least this cosine."""
    small_batches(docs.sparkSession, WHOLE_BYTES)
    names = docs.columns

    def run(it):
        for whole in it:
            for b in batches([whole], 1_500_000):
                found = profiles.predict(b.column(names.index("text")).to_pylist())
                yield b.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(task("language", run, forget), docs.schema)
