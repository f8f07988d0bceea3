"""Document fingerprints by locally consistent parsing.

A text is parsed into a hierarchy of phrases. On each level runs of one symbol become a symbol, then
deterministic coin tossing gives every symbol a label of few values that differs from its neighbour's
and depends on a few symbols before it alone; a phrase begins at each local maximum of the labels and
is named by a hash of its symbols. Names are the symbols of the next level. So equal substrings get
equal phrases inside, wherever they begin. The fingerprint holds the KEPT smallest hashes of the
names from LEVEL on (of the last name where a text ends before), and the likeness of two fingerprints
estimates the share of phrases that the texts have in common.

A null text counts as empty; an empty text has an empty fingerprint, like another empty one (1.0) and
unlike any other (0.0). Equal texts have equal fingerprints. Documents are ordered by doc_id, those of
one doc_id by text, a null doc_id first; the one after the last is the first, so a single document
follows itself. Any length goes: work and memory follow the length.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import batches, small_batches, stored

#: Hashes in a fingerprint, and the first level whose phrases count (about 15 characters each).
KEPT, LEVEL = 48, 3
#: Documents of a range partition when texts are put in order.
ROWS = 4_000
ONE = np.uint64(1)
# Odd multipliers of the hash.
A, B, C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * A
    x = (x ^ (x >> np.uint64(27))) * B
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of C and of its inverse modulo 2**64, for at least ``n`` symbols."""
    inverse = np.uint64(pow(int(C), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.full(n, x, dtype=np.uint64)) for x in (C, inverse))


def runs(sym: np.ndarray, row: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """One symbol for each run of a symbol in a row."""
    start = np.empty(len(sym), dtype=bool)
    start[0] = True
    np.not_equal(sym[1:], sym[:-1], out=start[1:])
    start[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(start)
    if len(at) == len(sym):
        return sym, row
    size = np.diff(at, append=len(sym)) - 1
    sym, row = sym[at], row[at]
    long = np.flatnonzero(size)
    size = size[long].astype(np.uint64)
    if not first:
        sym[long] = mix(sym[long] ^ size * C)
    elif size.max() < 1 << 11:  # code points leave room for the length
        sym[long] |= (size << np.uint64(21)).astype(sym.dtype)
    else:
        sym = sym.astype(np.uint64)
        sym[long] |= size << np.uint64(21)
    return sym, row


def labels(sym: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Deterministic coin tossing down to labels below 6; ``head`` are the first symbols of the rows."""
    x = sym
    for _ in range(3):
        one = x.dtype.type(1)
        differ = np.empty_like(x)
        np.bitwise_xor(x[1:], x[:-1], out=differ[1:])
        differ[head] = one
        low = np.bitwise_count((differ - one) & ~differ)
        bit = ((x >> low.astype(x.dtype, copy=False)) & one).astype(np.uint8)
        x = (low << np.uint8(1)) + bit
    return x


def phrases(sym: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of each row, and their rows."""
    start = np.empty(len(sym), dtype=bool)
    start[0] = True
    np.not_equal(row[1:], row[:-1], out=start[1:])
    label = labels(sym, np.flatnonzero(start))
    # a peak is higher than both neighbours and not the last of its row
    start[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~start[2:]
    at = np.flatnonzero(start)
    # the hash of a phrase: a difference of running sums, moved to the same power wherever it stands
    up, down = powers(1 << max(16, (len(sym) - 1).bit_length()))
    sums = np.multiply(sym, up[: len(sym)], dtype=np.uint64)
    np.cumsum(sums, out=sums)
    last = np.append(at[1:], len(sym)) - 1
    part = sums[last]
    part[1:] -= sums[last[:-1]]
    return mix(part * down[at] + (last - at).astype(np.uint64)), row[at]


def sketches(texts: list[str]) -> list[bytes]:
    """The fingerprint of each text: up to KEPT ascending 32-bit hashes, big-endian."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    sym = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).copy()
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    found, level = [], 0
    while len(sym):
        if level >= LEVEL:
            found.append((row, sym))
        alone = np.r_[True, row[1:] != row[:-1]] & np.r_[row[1:] != row[:-1], True]
        if level < LEVEL and level and alone.any():
            found.append((row[alone], sym[alone].astype(np.uint64)))
        if level:  # a row of one phrase is finished
            sym, row = sym[~alone], row[~alone]
            if not len(sym):
                break
        sym, row = phrases(*runs(sym, row, level == 0))
        level += 1
    if not found:
        return [b""] * len(texts)
    row = np.concatenate([r for r, _ in found]).astype(np.uint64)
    both = np.unique(row << np.uint64(32) | mix(np.concatenate([s for _, s in found])) >> np.uint64(32))
    row = (both >> np.uint64(32)).astype(np.int64)
    begin, end = np.searchsorted(row, np.arange(len(texts))), np.searchsorted(row, np.arange(len(texts)), side="right")
    low = (both & np.uint64(0xFFFFFFFF)).astype(">u4")
    return [low[a : min(b, a + KEPT)].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    """Share of the KEPT smallest hashes of both together that both hold; exact where neither is full."""
    if a == b:
        return 1.0
    x, y = ({f[k : k + 4] for k in range(0, len(f), 4)} for f in (a, b))
    low = sorted(x | y)[:KEPT]
    return sum(h in x and h in y for h in low) / len(low)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the following text's first."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _rows(found: list[tuple[str, str]]) -> list[tuple]:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of (text, following)."""
    changed = [edited(t, f) for t, f in found]
    n = len(found)
    # a text's follower is mostly the next of the list
    extra = [k for k in range(n) if k + 1 == n or found[k + 1][0] is not found[k][1]]
    all_ = sketches([t for t, _ in found] + changed + [found[k][1] for k in extra])
    own, new, rest = all_[:n], all_[n : 2 * n], dict(zip(extra, all_[2 * n :], strict=True))
    out = []
    for k, (t, _) in enumerate(found):
        following = rest[k] if k in rest else own[k + 1]
        out.append((len(t), hashlib.sha256(changed[k].encode()).hexdigest(), own[k], new[k], likeness(own[k], new[k]), likeness(own[k], following)))
    return out


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _batch(ids: list, rows: list[tuple], extra: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    columns = [ids, *(zip(*rows, strict=True) if rows else [()] * 6)]
    arrays = [pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)]
    extra = extra or {}
    return pa.RecordBatch.from_arrays(arrays + list(extra.values()), NAMES + list(extra))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they and the next document's are.

    Texts are dealt out by ranges of doc_id and sorted in each, so that a document meets the next one
    there. A partition's last document waits: it is joined with the next partition's first one, two
    rows a partition, once the partitions are written.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(1, -(-rows.count() // ROWS))

    def run(it):
        part = TaskContext.get().partitionId()
        edge = lambda k: {"kind": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32())}
        empty = (0, "", b"", b"", 0.0, 0.0)
        held = None
        for whole in it:
            for b in batches([whole], 2_000_000):
                ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                if not ids:
                    continue
                if held is None:
                    yield _batch(ids[:1], [empty], edge(2) | {"text": pa.array(texts[:1], pa.string())})
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = ids[-1], texts[-1]
                if len(ids) > 1:
                    done = _rows(list(zip(texts[:-1], texts[1:], strict=True)))
                    yield _batch(ids[:-1], done, {"kind": pa.array([0] * len(done), pa.int32()), "part": pa.array([part] * len(done), pa.int32()), "text": pa.array([None] * len(done), pa.string())})
        if held is not None:
            yield _batch([held[0]], [empty], edge(1) | {"text": pa.array([held[1]], pa.string())})

    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    found = stored(ordered.mapInArrow(run, RESULT + ", kind int, part int, text string"), "fingerprints")
    firsts = found.where("kind = 2").select("part", F.col("text").alias("following"))
    # one row a partition: which partition comes next
    order = firsts.select("part").withColumn("next", F.lead("part").over(Window.orderBy("part")))
    order = order.select(F.col("part").alias("own"), F.coalesce("next", F.min("part").over(Window.partitionBy())).alias("next"))
    waiting = found.where("kind = 1").join(order, F.col("part") == F.col("own")).select("doc_id", "text", "next")
    waiting = waiting.join(firsts, F.col("next") == F.col("part")).select("doc_id", "text", "following")

    def close(it):
        for b in batches(it, 2_000_000):
            pairs = list(zip(b.column("text").to_pylist(), b.column("following").to_pylist(), strict=True))
            yield _batch(b.column("doc_id").to_pylist(), _rows(pairs) if pairs else [])

    return found.where("kind = 0").select(*NAMES).unionByName(waiting.mapInArrow(close, RESULT))
