"""Token counts of a sentencepiece BPE model by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens where no piece of the vocabulary reaches across (between a character and
the space mark after it). All new pre-tokens of a batch lie in one flat array of symbols with the
starts of its rows; in each round every row's lowest-ranked pair (the leftmost of equals) is merged, in
all rows at once, until no pair of a row is in the vocabulary. The symbols that survive are counted;
one that is no piece counts as many byte tokens as its character has bytes. A row of more than LONG
symbols, which would need as many rounds, is merged with a heap in the same order.

A null text counts as empty: no bytes, no tokens.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from marketlake.llm.common import Memo, batches, small_batches, texts

MARK = "▁"
NONE = np.iinfo(np.int64).max
LONG = 400


class Counter:
    """Counts tokens as the library would, for models with byte fallback and identity normalisation."""

    def __init__(self, data: bytes):
        model = model_pb2.ModelProto()
        model.ParseFromString(data)
        plain = model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and not model.normalizer_spec.precompiled_charsmap
        if not plain or not model.normalizer_spec.add_dummy_prefix or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("a BPE model with byte fallback, a leading space mark, identity normalisation and no user-defined or unused pieces is needed")
        self.trim = model.normalizer_spec.remove_extra_whitespaces
        normal = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds a space mark after another character")
        # symbols: all characters that pieces are made of, then the pieces
        chars = sorted({c for p in normal for c in p})
        self.symbol = {c: k for k, c in enumerate(chars)}
        for p in normal:
            self.symbol.setdefault(p, len(self.symbol))
        self.base = len(self.symbol)
        rank = {p: k for k, p in enumerate(sorted(normal, key=lambda p: (-normal[p], p)))}
        pairs = []
        for p in normal:
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, rank[p] << 32 | self.symbol[p]))
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [NONE], dtype=np.int64)
        self.values = np.array([v for _, v in pairs] + [NONE], dtype=np.int64)
        # tokens of a symbol that stays: one if it is a piece, else the bytes of its character
        self.cost = np.array([1 if s in normal else len(s.encode()) for s in self.symbol], dtype=np.int64)
        self.lookup = np.full(0x110000, -1, dtype=np.int32)
        self.lookup[[ord(c) for c in chars]] = range(len(chars))
        self.memo = Memo()

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | merged symbol for each pair, NONE if the vocabulary lacks it."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(words), dtype=np.int64)
        if not words:
            return out
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.lookup[points]
        # a character outside the vocabulary never merges: its bytes count at once, it stays a barrier
        row = np.repeat(np.arange(len(words)), sizes)
        odd = sym < 0
        if odd.any():
            size = 1 + (points[odd] > 0x7F).astype(np.int64) + (points[odd] > 0x7FF) + (points[odd] > 0xFFFF)
            out += np.bincount(row[odd], weights=size, minlength=len(words)).astype(np.int64)
        for k in np.flatnonzero(sizes > LONG):
            out[k] += self.heap_count(sym[row == k].tolist())
        short = (sizes <= LONG)[row]
        sym, row = sym[short], row[short]
        last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
        rank = np.where(last, NONE, self.merges(sym, np.r_[sym[1:], -1])) if len(row) else np.zeros(0, np.int64)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            low = np.minimum.reduceat(rank, starts)
            ends = np.r_[starts[1:], len(sym)]
            open_ = low != NONE
            sizes = ends - starts
            if not open_.all():  # rows without a further merge are counted and leave
                stay = np.repeat(open_, sizes)
                done = sym[~stay]
                tokens = np.where(done >= 0, self.cost[done], 0)
                out += np.bincount(row[~stay], weights=tokens, minlength=len(words)).astype(np.int64)
                sym, row, rank = sym[stay], row[stay], rank[stay]
                low, sizes = low[open_], sizes[open_]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]  # the leftmost of each row
            sym[hit] = (rank[hit] & 0xFFFFFFFF).astype(sym.dtype)
            rank[hit] = rank[hit + 1]  # whether a pair follows; its rank is found anew below
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            sym, row, rank = sym[keep], row[keep], rank[keep]
            before = at[(at > 0) & (row[at - 1] == row[at])] - 1
            after = at[(at + 1 < len(sym))]
            after = after[row[after + 1] == row[after]]
            ended = np.setdiff1d(at, after, assume_unique=True)
            rank[ended] = NONE
            for place in (before, after):
                rank[place] = self.merges(sym[place], sym[place + 1])
        return out

    def heap_count(self, sym: list[int]) -> int:
        """Tokens of one long row (symbols outside the vocabulary not counted): the same merges by a heap."""
        n = len(sym)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        arr = np.array(sym, dtype=np.int64)
        first = self.merges(arr[:-1], arr[1:])
        heap = [(int(v) >> 32, k, sym[k], sym[k + 1], int(v) & 0xFFFFFFFF) for k, v in enumerate(first.tolist()) if v != NONE]
        heapq.heapify(heap)
        table = self.table()
        while heap:
            _, k, a, b, merged = heapq.heappop(heap)
            j = nxt[k]
            if sym[k] != a or j >= n or sym[j] != b:
                continue
            sym[k], sym[j] = merged, -2
            nxt[k] = nxt[j]
            if nxt[k] < n:
                prev[nxt[k]] = k
            for left in (prev[k], k):
                right = nxt[left] if left >= 0 else n
                if left >= 0 and right < n and (v := table.get(sym[left] << 32 | sym[right])) is not None and sym[left] >= 0 and sym[right] >= 0:
                    heapq.heappush(heap, (v >> 32, left, sym[left], sym[right], v & 0xFFFFFFFF))
        return int(sum(self.cost[s] for s in sym if s >= 0))

    @lru_cache(maxsize=1)  # noqa: B019
    def table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist()[:-1], self.values.tolist()[:-1], strict=True))

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens without the space mark that each begins with; runs of spaces stay with the word after them."""
        if self.trim:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            parts, run = [], 0
            for p in text.split(" "):
                if p:
                    parts.append(MARK * run + p)
                    run = 0
                else:
                    run += 1
            return parts + [MARK * (run - 1)] * (run > 0)
        return text.split(" ")

    def count_all(self, texts: list[str | None]) -> list[int]:
        cut = [self.pretokens(t) if t else [] for t in texts]
        new = self.memo.missing(cut)
        self.memo.update(zip(new, self.counts([MARK + w for w in new]).tolist(), strict=True))
        known = self.memo.__getitem__
        return [sum(map(known, c)) for c in cut]


@lru_cache(maxsize=2)
def _counter(data: bytes) -> Counter:
    return Counter(data)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    The model is read on the driver (below a few MB) and sent along with the tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(it):
        counter = _counter(sent.value)
        for b in batches(it):
            rows = b.column("text").to_pylist()
            n = counter.count_all(rows)
            size = [len(t.encode()) if t else 0 for t in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
