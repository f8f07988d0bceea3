"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints of distance at most 2 within the span of a key
meet where the small Hamming balls (radius 1) of their segments meet: each enumerates itself and every
flip of one bit, segment by segment, as table keys. All that meet at a key are fetched together, and
the complete distance of each to the smallest one is verified; what fails is compared with twice as
many of those that failed, and so on, until nothing is left. A key holds at most one fingerprint for each of its own
flips, so no bucket grows with a group of copies, and no pairs are emitted within it.

Nulls and texts without words have fingerprint zero and link with one another. Equal texts are one
class; repeated rows are returned as often as they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import batches, components, scratch, small_batches, stored, task, texts

SEED = 42
#: Words hashed at a time; longer texts go in slices that overlap by a shingle.
SLICE = 200_000
#: A table of at most so many rows of one or two longs (16 MB) may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Keys that a task enumerates and counts before they are dealt out.
TASK_KEYS = 400_000
#: Odd multipliers that give further 64-bit words of a wide fingerprint from one hash.
MIX = [1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


def hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, repeats included; of the whole sequence if that is shorter."""
    if not words:
        return
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, SLICE):
        part = words[i : min(n, i + SLICE) + size - 1]
        rows = zip(*(part[k:] for k in range(size)), strict=False) if len(words) >= size else [part]
        yield np.fromiter((digest(b" ".join(r), SEED) for r in rows), dtype=np.uint64)


def majority(words: list[bytes], size: int, parts: int = 1) -> list[int]:
    """``parts`` unsigned 64-bit words of a fingerprint: a bit is 1 if set in over half of the hashes."""
    ones, total = np.zeros(64 * parts, dtype=np.int64), 0
    for h in hashes(words, size):
        total += len(h)
        if parts > 1:
            wide = h[:, None] * np.array(MIX[:parts], dtype=np.uint64)
            wide[:, 1:] ^= wide[:, 1:] >> np.uint64(32)
            h = wide
        raw = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        for i in range(0, len(raw), 255):  # sums of 255 bits fit a byte
            ones += np.add.reduce(raw[i : i + 255], axis=0, dtype=np.uint8)
    return [int(x) for x in np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, parts: int = 1) -> DataFrame:
    """(doc_id, f0, f1, ...) with one long for each 64 bits, a row for each row of ``docs``."""
    small_batches(docs.sparkSession)

    def run(it):
        for b in batches(it):
            found = [majority(words_of(t), shingle, parts) for t in b.column("text").to_pylist()]
            columns = [pa.array(_signed([f[k] for f in found])) for k in range(parts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *(f"f{k}" for k in range(parts))])

    return texts(docs).mapInArrow(task("simhash", run), "doc_id long, " + ", ".join(f"f{k} long" for k in range(parts)))


def distance(a: list, b: list):
    """Differing bits of two fingerprints given as lists of long columns."""
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def ball_keys(span, segments: int = 2, bits: int = 64):
    """The table keys of one span: itself, and the radius-1 ball of each of its segments with the rest kept."""
    width = bits // segments
    flips = [[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(s * width, (s + 1) * width)] for s in range(segments)]
    balls = [F.transform(F.array(*f), lambda x: span.bitwiseXOR(x)) for f in flips]
    return F.concat(F.array(span), *balls)


def meetings(classes: DataFrame, parts: int, bits: int = 64) -> DataFrame:
    """(key, cls): every class at every key of its fingerprint.

    ``bits`` is the width of a span: 64 makes one table of a 64-bit fingerprint, whose links of up to
    2 bits it finds all; 32 makes a table of each half of each long, for wide fingerprints that need
    agree to within 2 bits in one span only. The table's number stands above the span in the key.
    """
    tables = []
    for k in range(parts):
        for s in range(64 // bits):
            keys = ball_keys(F.col(f"f{k}"))
            if bits < 64:
                span = F.shiftrightunsigned(F.col(f"f{k}"), s * bits).bitwiseAND(F.lit((1 << bits) - 1))
                keys = ball_keys(span.bitwiseOR(F.lit((k * (64 // bits) + s) << bits)), bits=bits)
            tables.append(keys)
    keys = len(tables) * (1 + bits)
    tasks = max(1, -(-classes.count() * keys // TASK_KEYS))
    return classes.repartition(tasks).select("cls", F.explode(F.concat(*tables)).alias("key"))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast only if it is counted to be small; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df


def links(classes: DataFrame, parts: int, within: int, bits: int, name: str) -> DataFrame:
    """Verified links (cls, head) between classes (cls, f0, ...); each is within ``within`` bits."""
    f = [f"f{k}" for k in range(parts)]
    met, keep = meetings(classes, parts, bits), None
    # most keys have one class: only the keys are counted at first, then their classes are fetched
    shared = stored(met.groupBy("key").count().where("count > 1").select("key"), f"{name}-keys")
    met = stored(met.join(small_side(shared), "key"), f"{name}-met")
    # classes with one span meet at its whole ball: of keys with the same classes one is enough
    same = met.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("low"), F.bit_xor(F.xxhash64("cls")).alias("all"))
    alone = stored(same.groupBy("n", "low", "all").agg(F.min("key").alias("key")).select("key"), f"{name}-alone")
    met = stored(met.join(small_side(alone), "key"), f"{name}-met")
    heads = met.groupBy("key").agg(F.array(F.min("cls")).alias("heads"))
    most = 1
    while True:
        heads = stored(heads, f"{name}-heads")
        met = stored(met.join(heads, "key").select("key", "cls", F.explode("heads").alias("head")).where("cls <> head"), f"{name}-met")
        pairs = met.select("cls", "head").distinct()
        if parts == 1:  # the class is the fingerprint
            near = pairs.where(distance([F.col("cls")], [F.col("head")]) <= within)
        else:
            other = classes.select(F.col("cls").alias("head"), *(F.col(x).alias(f"h{x}") for x in f))
            near = pairs.join(classes.select("cls", *f), "cls").join(other, "head")
            near = near.where(distance([F.col(x) for x in f], [F.col(f"h{x}") for x in f]) <= within).select("cls", "head")
        near = stored(near, name)
        keep = near if keep is None else keep.unionByName(near)
        # what is near no head of its key is compared with more of its own kind: twice as many heads each time
        done = met.join(near, ["cls", "head"]).select("key", "cls").unionByName(heads.select("key", F.explode("heads").alias("cls")))
        rest = met.select("key", "cls").distinct().join(done, ["key", "cls"], "left_anti")
        if rest.isEmpty():
            return keep
        met, most = stored(rest, f"{name}-rest"), most * 2
        place = F.row_number().over(Window.partitionBy("key").orderBy("cls"))
        heads = met.withColumn("place", place).where(F.col("place") <= most).groupBy("key").agg(F.collect_list("cls").alias("heads"))


def near_duplicates(docs: DataFrame, shingle: int = 3, within: int = 2, parts: int = 1, bits: int = 64) -> DataFrame:
    """(doc_id, f0.., component_id): component_id is the smallest doc_id reachable by links.

    With ``parts`` = 1 and ``bits`` = 64 every link of at most 2 bits is found. A component of null ids
    only has a null component_id.
    """
    f = [f"f{k}" for k in range(parts)]
    # a class is named by its fingerprint: its only long, or a hash of all
    prints = fingerprints(docs, shingle, parts).withColumn("cls", F.col("f0") if parts == 1 else F.xxhash64(*f))
    prints = stored(prints, "simhash-prints")
    classes = prints.groupBy("cls").agg(F.min("doc_id").alias("first"), *(F.min(x).alias(x) for x in f))
    classes = stored(classes, "simhash-classes")
    groups = components(links(classes, parts, within, bits, "simhash-links"), "cls", "head", "simhash-stars")
    named = classes.join(groups, classes["cls"] == groups["node"], "left").select("cls", "first", F.coalesce("component", "cls").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(named.join(lowest, "root").select("cls", "component_id"), "simhash-named")
    return prints.join(named, "cls").select("doc_id", *f, "component_id")


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each near-duplicate group; other columns stay as they are.

    Groups are those of ``similar_sets``: exact Jaccard similarity of shingle sets, no pair lost. Of rows that
    repeat both doc_id and text one stays; rows of one doc_id with different texts stand or fall with their id.
    Rows with a null doc_id stay: they can't be told apart.
    """
    from marketlake.llm import similar_sets  # it builds on this module

    with scratch(docs.sparkSession):
        ids = similar_sets.near_duplicates(docs, shingle, similarity).where("doc_id is not null")
        # an id goes if one of its texts is near a smaller id
        gone = stored(ids.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "simhash-gone", outer=True)
        again = stored(ids.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "simhash-again", outer=True)
    key = F.col("doc_id").cast("long")
    kept = docs.join(small_side(gone), key == F.col("_gone"), "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(small_side(again), key == F.col("_again"), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small_side(again), key == F.col("_again"), "left_anti").unionByName(once)
