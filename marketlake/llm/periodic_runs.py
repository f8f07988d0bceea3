"""Periodic runs in word sequences by block convolution.

A run is a stretch of words of smallest period q, at least ``least`` words and ``times`` periods long, that can't be
extended. At the scale of blocks of L words (L = 1, 2, 4, ...) the periods are L <= q < 2 L. Every aligned block is
held against the following window of 2 L words: the squared differences at every distance come from a number
theoretic transform modulo a Fermat prime, 257 up to L = 128 and 65537 above (whole numbers, no rounding), all
blocks of a batch of texts at once. A distance of zero squared difference repeats the block; as a run is four
periods long, it holds so many neighbouring blocks that repeat at the same distance that a count of them leaves few
seeds. A seed is compared word by word (a residue of zero is no proof), extended to both sides, and is a run; seeds
inside a run of a shorter period, found at an earlier scale, are multiples of that period.

Scales above 32,768 words take the first 32,768 words of a block and look through the window piece by piece.

Nulls and empty texts have no words and no runs. Texts of any length are one sequence each; a batch of short ones is
one array. Repeated rows are returned as often as they came; a null doc_id is a row like others. Other columns, of
any name, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketlake.llm.common import batches, small_batches, texts

GENERATOR = 3  # of either field
#: Longest block that is transformed (twice as long, the transform has the largest size that the prime allows).
LONGEST = 32_768
#: Numbers in an array of the transform.
CELLS = 1 << 15

Run = tuple[int, int, int]


class Field:
    """Whole numbers modulo 2^bits + 1 in arrays wide enough for a transform of ``size`` 2^bits."""

    def __init__(self, bits: int, dtype: type) -> None:
        self.bits, self.mask, self.prime, self.dtype = bits, (1 << bits) - 1, (1 << bits) + 1, dtype
        self.roots: dict[tuple[int, bool], list[np.ndarray]] = {}

    def reduced(self, x: np.ndarray) -> np.ndarray:
        """Smaller numbers of the same residue: 2^bits is -1."""
        return (x & self.mask) - (x >> self.bits)

    def twiddles(self, size: int, inverse: bool) -> list[np.ndarray]:
        """The powers of the root of each stage, largest stage first."""
        if (size, inverse) not in self.roots:
            out, half = [], size // 2
            while half:
                root = pow(GENERATOR, (self.prime - 1) // (2 * half), self.prime)
                root = pow(root, self.prime - 2, self.prime) if inverse else root
                w = np.ones(half, dtype=np.int64)
                done = 1
                while done < half:  # doubling: w[done:] = w[:done] * root^done
                    w[done : 2 * done] = w[:done] * pow(root, done, self.prime) % self.prime
                    done *= 2
                out.append(w[:, None].astype(self.dtype))
                half //= 2
            self.roots[size, inverse] = out
        return self.roots[size, inverse]

    def forward(self, x: np.ndarray) -> np.ndarray:
        """The transform of each column, in bit-reversed order. Sums grow by a bit in each stage and stay in range."""
        size, rows = x.shape
        for w in self.twiddles(size, False):
            v = x.reshape(-1, 2, len(w), rows)
            a, b = v[:, 0], v[:, 1]
            x = np.empty_like(v)
            np.add(a, b, out=x[:, 0])
            d = a - b
            if len(w) > 1:
                d *= w
                np.subtract(d & self.mask, d >> self.bits, out=x[:, 1])
            else:
                x[:, 1] = d
        return x.reshape(size, rows)

    def backward(self, x: np.ndarray) -> np.ndarray:
        """What ``forward`` was taken of, times the size."""
        size, rows = x.shape
        for w in self.twiddles(size, True)[::-1]:
            v = x.reshape(-1, 2, len(w), rows)
            a, b = v[:, 0], v[:, 1]
            if len(w) > 1:
                b = b * w
                b = (b & self.mask) - (b >> self.bits)
            x = np.empty_like(v)
            np.add(a, b, out=x[:, 0])
            np.subtract(a, b, out=x[:, 1])
        return x.reshape(size, rows)


SMALL, LARGE = Field(8, np.int32), Field(16, np.int64)


def repeats(field: Field, x: np.ndarray, squares: np.ndarray, at: np.ndarray, block: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(number in ``at``, distance) where the block of each start has no squared difference, distances shift..shift+block-1.

    ``squares`` are running sums of the squares of ``x``.
    """
    size = 2 * block
    reduced = field.reduced
    found_row, found_far = [], []
    for i in range(0, len(at), max(1, CELLS // size)):
        s = at[i : i + max(1, CELLS // size)]
        whole = np.zeros((size, len(s)), dtype=field.dtype)
        whole[:block] = x[s[None, :] + np.arange(block - 1, -1, -1)[:, None]]  # turned round: the product is a correlation
        window = x[s[None, :] + shift + np.arange(size)[:, None]]
        product = reduced(field.forward(whole)) * reduced(field.forward(window))
        both = reduced(reduced(field.backward(reduced(reduced(product)))[block - 1 : size - 1]))
        # times the size: sum a^2 + sum b^2 - 2 sum a b
        ends = s[None, :] + shift + np.arange(block)[:, None]
        sums = reduced(reduced((squares[s + block] - squares[s])[None, :] + squares[ends + block] - squares[ends])) * size - 2 * both
        left = reduced(reduced(sums))
        far, row = np.nonzero((left == 0) | (left == field.prime))
        found_row.append(row + i)
        found_far.append(far + shift)
    return np.concatenate(found_row), np.concatenate(found_far)


def _same(x: np.ndarray, a: int, b: int, q: int) -> bool:
    return bool((x[a:b] == x[a + q : b + q]).all())


def _right(x: np.ndarray, at: int, q: int, end: int) -> int:
    """First i >= at where x[i] and x[i + q] differ or i + q is the end."""
    step = 16
    while at + q < end:
        stop = min(at + step, end - q)
        differ = np.flatnonzero(x[at:stop] != x[at + q : stop + q])
        if len(differ):
            return at + int(differ[0])
        at, step = stop, step * 2
    return at


def _left(x: np.ndarray, at: int, q: int, begin: int) -> int:
    """Smallest i so that x[i..at) equals what is q further on."""
    step = 16
    while at > begin:
        stop = max(at - step, begin)
        differ = np.flatnonzero(x[stop:at] != x[stop + q : at + q])
        if len(differ):
            return stop + int(differ[-1]) + 1
        at, step = stop, step * 2
    return at


class _Found:
    """Runs so far as places of the whole array, with what decides whether a stretch is inside one."""

    def __init__(self) -> None:
        self.runs: list[Run] = []
        self.starts = self.ends = np.zeros(0, dtype=np.int64)

    def add(self, runs: set[Run]) -> None:
        if runs:
            self.runs += sorted(runs)
            held = np.array(sorted((a, a + n) for a, n, _ in self.runs), dtype=np.int64)
            self.starts, self.ends = held[:, 0], np.maximum.accumulate(held[:, 1])

    def inside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(len(a), dtype=bool)
        k = np.searchsorted(self.starts, a, side="right") - 1
        return (k >= 0) & (self.ends[np.maximum(k, 0)] >= b)


def find_runs(x: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int, times: int) -> list[Run]:
    """(start, length, period) of every run of the sequences x[begins[k]:ends[k]], as places of ``x``."""
    found, lengths, block = _Found(), ends - begins, 1
    if not len(x):
        return found.runs
    x = np.concatenate([x, np.zeros(4 * min(int(lengths.max()), LONGEST) + int(lengths.max()), dtype=np.int64)])
    # residues do for the transform; running sums of their squares may wrap, their differences don't
    fields = []
    for field in (SMALL, LARGE):
        low = (x % field.prime).astype(field.dtype)
        squares = np.concatenate([[0], np.cumsum(low.astype(np.int64) ** 2 % field.prime)])
        fields.append((field, low, squares.astype(field.dtype)))
    while True:
        on = np.flatnonzero(lengths >= max(least, times * block))
        if not len(on):
            return found.runs
        number = np.maximum(lengths[on] - 2 * block, 0) // block + 1
        owner = np.repeat(on, number)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        at = begins[owner] + place * block
        short = min(block, LONGEST)
        rows, fars = [], []
        for shift in range(block, 2 * block, short):
            row, far = repeats(*fields[short > 128], at, short, shift)
            fits = at[row] + far + short <= ends[owner[row]]
            rows.append(row[fits])
            fars.append(far[fits])
        row, q = np.concatenate(rows), np.concatenate(fars)
        order = np.lexsort((row, q))
        row, q = row[order], q[order]
        # neighbouring blocks of one sequence that repeat at one distance
        new = np.ones(len(row), dtype=bool)
        new[1:] = (q[1:] != q[:-1]) | (row[1:] != row[:-1] + 1) | (owner[row[1:]] != owner[row[:-1]])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(row)))
        row, q = row[first], q[first]
        # of a stretch of m equal pairs at most block - 1 words on each side are in no such block
        need = np.maximum(least, times * q) - q
        seeds = count * block >= need - 2 * (block - 1)
        a, b = at[row], at[row] + (count - 1) * block + short
        seeds &= ~found.inside(a, b + q)
        runs: set[Run] = set()
        for s, e, d, k in zip(a[seeds].tolist(), b[seeds].tolist(), q[seeds].tolist(), owner[row[seeds]].tolist(), strict=True):
            if not _same(x, s, e, d):
                # a false zero: its true parts are tried one by one
                parts = [(i, min(i + short, e)) for i in range(s, e, block)]
                parts = [p for p in parts if _same(x, *p, d)]
            else:
                parts = [(s, e)]
            for s2, e2 in parts:
                left, right = _left(x, s2, d, int(begins[k])), _right(x, e2, d, int(ends[k]))
                if right - left + d >= max(least, times * d):
                    runs.add((left, right - left + d, d))
        found.add(runs)
        block *= 2


def runs_of(sequences: list[list[bytes]], least: int = 6, times: int = 4) -> list[list[Run]]:
    """The runs of each sequence by (start, period)."""
    names: dict[bytes, int] = {}
    flat = np.fromiter((names.setdefault(w, len(names) + 1) for words in sequences for w in words), dtype=np.int64)
    lengths = np.array([len(w) for w in sequences], dtype=np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    out: list[list[Run]] = [[] for _ in sequences]
    for a, n, q in find_runs(flat * 40_503, begins, ends, least, times):
        k = int(np.searchsorted(ends, a, side="right"))
        out[k].append((a - int(begins[k]), n, q))
    return [sorted(r, key=lambda t: (t[0], t[2])) for r in out]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for a, n, q in runs:
        steps[a + q] += 1
        steps[a + n] -= 1
    return [w for w, d in zip(words, np.cumsum(steps[:-1]).tolist(), strict=True) if not d]


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode().split() if text else []


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's text: every tenth document (by the crc of its id) becomes periodic from a place on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string"


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, words_of: Callable[[int | None, list[bytes]], list[bytes]] = lambda _, words: words) -> DataFrame:
    """Per row: its runs, the longest of them, digests, and the text collapsed to the first period of each run.

    ``words_of`` may change the words of a document before they are searched.
    """
    small_batches(docs.sparkSession)

    def run(it):
        for b in batches(it, 2_000_000):
            ids = b.column("doc_id").to_pylist()
            words = [words_of(i, split(t)) for i, t in zip(ids, b.column("text").to_pylist(), strict=True)]
            rows = []
            for doc_id, w, runs in zip(ids, words, runs_of(words, least, times), strict=True):
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
                text = b" ".join(collapsed(w, runs))
                rows.append({
                    "doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
                    "exponent_milli": 1000 * best[1] // best[2] if runs else None,
                    "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(text).hexdigest(),
                    "runs": [{"start": a, "length": n, "period": q} for a, n, q in runs], "text": text.decode()})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return texts(docs).mapInArrow(run, SCHEMA)


ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("text", pa.string())])
