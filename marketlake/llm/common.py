"""Helpers that the corpus operators share: bounded batches, written tables, linked components."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.session import shared_dir

#: Python workers get whole rows in Arrow batches of about this many bytes.
BATCH_BYTES = "8m"
#: The same where tables of whole texts go through a worker and back: a task holds a batch several times over.
WHOLE_BYTES = "2m"
#: Characters of keys that a worker's memo of words holds before it starts anew.
MEMO_CHARS = 3_000_000


def small_batches(spark: SparkSession, size: str = BATCH_BYTES) -> None:
    """Bound the Arrow batches of this session by bytes: texts differ widely in length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: Folders of the operators at work, innermost last.
_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``stored`` inside are deleted at the end; what is returned must be stored as ``outer``."""
    path = f"{shared_dir(spark)}/scratch-{uuid4().hex}"
    _scratch.append(path)
    try:
        yield
    finally:
        _scratch.pop()
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors.

    It goes to the folder of the innermost ``scratch``, or of the one around that (``outer``).
    """
    spark = df.sparkSession
    folders = [shared_dir(spark), *_scratch]
    path = f"{folders[-1 - outer]}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id long, text string), whatever other columns there are; a null text stays null."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def batches(it: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``chars`` bytes at most (one longer row stays whole)."""
    for b in it:
        step = max(1, int(b.num_rows * chars / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


class Memo(dict):
    """A worker's memo of words: emptied when its keys have grown past MEMO_CHARS."""

    chars = 0

    def full(self) -> bool:
        return self.chars > MEMO_CHARS

    def missing(self, lists) -> list:
        """The distinct keys of ``lists`` that are to be found and put in; a full memo is emptied first."""
        if self.full():
            self.clear()
            self.chars = 0
        new = list(set().union(*lists).difference(self))
        self.chars += sum(map(len, new))
        return new


#: What this worker keeps from task to task (tokenizers, memos), and how it is dropped, by operator.
_kept: dict[str, Callable[[], None]] = {}


def begin(operator: str, drop: Callable[[], None] | None = None) -> None:
    """Drop what other operators keep in this worker; ``drop`` is how what this one keeps will go."""
    for name in [name for name in _kept if name != operator]:
        _kept.pop(name)()
    if drop:
        _kept[operator] = drop


def trim() -> None:
    """Give freed memory back to the system (glibc keeps it otherwise; other libraries have no malloc_trim)."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (give := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        give(0)


def task(operator: str, run: Callable, drop: Callable[[], None] | None = None) -> Callable:
    """``run`` as a task of ``operator``, for mapInArrow. A worker serves one stage after another, so what a task
    or another operator has left there would add to what the next one needs."""

    def whole(it):
        begin(operator, drop)
        yield from run(it)
        trim()

    return whole


#: A table of so many rows of a few longs (some MB) is read by one task: its rounds need no shuffle.
TASK_ROWS = 50_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """A stored table that was counted to have ``rows`` rows, in no more tasks than these need."""
    tasks = -(-max(rows, 1) // TASK_ROWS)
    return df.coalesce(tasks) if tasks <= 8 else df


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(node, component) for every node of the links; component is the smallest node reachable.

    Large-star and small-star rounds (each a minimum per node with map-side partial results and a
    join on the node) until the edges are stars. A node with very many links is split by Spark's
    skew join; nothing is collected but one count and two checksums a round.
    """
    with scratch(links.sparkSession):
        x, y = F.col(a), F.col(b)
        edges = stored(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), name)
        seen = _digest(edges)
        while seen[0]:
            edges = few(edges, seen[0])
            both = few(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), seen[0])
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
            if (now := _digest(edges)) == seen:
                break
            seen = now
        stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        stars = stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        return stored(stars, name, outer=True)
