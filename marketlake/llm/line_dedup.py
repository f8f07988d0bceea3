"""Line deduplication over the whole corpus with DataFrame functions only; the result is a keep bitmap per document.

A line's key is the line without white space (0x20, 0x09-0x0D) at its ends and with A-Z lower-cased. Keys of
``least`` code points or more that are found in ``documents`` documents or more lose all their lines but those
of the largest doc_id that holds them.

Keys are two 64-bit hashes. Their occurrences are partitioned by ranges of (hash, slice of documents) and
sorted by document, largest first, and position, so that one pass over a range sees every new document of a
key as it comes; only the number of new ones and the largest are kept of a slice. The slices (a hash of the
doc_id) split a key that a third of all lines carry; a document is in one slice, so the numbers add up. Texts
are never shuffled for this: an occurrence is six numbers.

The bitmap holds a bit for each line, 1 = kept, in words of 63 lines. Words without a dropped line are left
out: ``keep`` lists (skipped words before it, word). A document that loses nothing has an empty list.

A null or empty text is one empty line. Rows are told apart by (doc_id, text): equal rows have equal bitmaps
and are returned as often as they came; rows of one doc_id with different texts are one document when
documents are counted, and each has its own bitmap. Null ids are one document, smaller than any other.
Other columns, of any name, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import stored

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines of a word of the bitmap.
WORD = 63
#: Parts into which the documents of one key are split.
SLICES = 64
#: Longs that a side may hold to be broadcast (32 MB).
BROADCAST_LONGS = 4_000_000


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text): t names the text of a row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def keys(line: Column) -> Column:
    """The key of a line."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def occurrences(rows: DataFrame, least: int) -> DataFrame:
    """(h, g, slice, doc_id, t, pos) of every line whose key is long enough."""
    lines = rows.select("doc_id", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # a line that is too short as it is needs no key
    keyed = lines.where(F.length("line") >= least).select("doc_id", "t", "pos", keys(F.col("line")).alias("key")).where(F.length("key") >= least)
    slice_ = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int")
    return keyed.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), slice_.alias("slice"), "doc_id", "t", "pos")


def first_occurrences(found: DataFrame) -> DataFrame:
    """(h, g, slice, n, largest): distinct documents of a slice of a key, and the largest of them."""
    ranges = found.repartitionByRange("h", "slice")
    order = Window.partitionBy("h", "g", "slice").orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    new = (F.row_number().over(order) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(order))
    return ranges.withColumn("new", new).where("new").groupBy("h", "g", "slice").agg(F.count("*").alias("n"), F.max("doc_id").alias("largest"))


def dropped(found: DataFrame, documents: int) -> DataFrame:
    """(doc_id, t, pos) of the lines that go."""
    slices = stored(first_occurrences(found), "lines-slices")
    shared = slices.groupBy("h", "g").agg(F.sum("n").alias("docs"), F.max("largest").alias("keeper")).where(F.col("docs") >= documents)
    shared = stored(slices.select("h", "g", "slice").join(shared.select("h", "g", "keeper"), ["h", "g"]), "lines-shared")
    side = F.broadcast(shared) if shared.count() * 4 <= BROADCAST_LONGS else shared
    return found.join(side, ["h", "g", "slice"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "t", "pos")


def bitmaps(gone: DataFrame) -> DataFrame:
    """(doc_id, t, n_dropped, keep) of the rows that lose lines."""
    bit = F.expr(f"shiftleft(1L, pos % {WORD})")
    words = gone.groupBy("doc_id", "t", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    lists = words.groupBy("doc_id", "t").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    full = (1 << WORD) - 1
    before = "CASE WHEN i = 0 THEN x.word ELSE x.word - w[i - 1].word - 1 END"
    return lists.select("doc_id", "t", "n_dropped", F.expr(f"transform(w, (x, i) -> named_struct('skip', {before}, 'word', x.bits ^ {full}L))").alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines whose bit is 1."""
    full = F.lit((1 << WORD) - 1)
    dense = F.flatten(F.transform(keep, lambda r: F.concat(F.array_repeat(full, r["skip"]), F.array(r["word"]))))
    bits = F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: i)
    # one flag a line, so that a line is looked up by its number
    flags = F.flatten(F.transform(dense, lambda w: F.transform(bits, lambda i: F.getbit(w, i))))
    return F.filter(lines, lambda _, i: F.coalesce(F.get(flags, i), F.lit(1)) == 1)


def keep_bitmaps(docs: DataFrame, least: int = 20, documents: int = 3) -> DataFrame:
    """(doc_id, t, n_dropped, keep) of every document that loses lines; t is the xxhash64 of its text."""
    return bitmaps(dropped(stored(occurrences(_rows(docs), least), "lines-found"), documents))


def deduplicated(docs: DataFrame, least: int = 20, documents: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep, text) of every row; ``text`` is what is left of it."""
    maps = stored(keep_bitmaps(docs, least, documents), "lines-bitmaps")
    size = maps.agg(F.count("*") * 4 + F.coalesce(F.sum(F.size("keep")), F.lit(0)) * 2).first()[0]
    side = maps.withColumnsRenamed({"doc_id": "_id", "t": "_t"})
    side = F.broadcast(side) if size <= BROADCAST_LONGS else side
    rows = _rows(docs)
    both = rows.join(side, (F.col("t") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    lines = F.split("text", "\n")
    text = F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(lines, F.col("keep")), "\n"))
    # a new line is one byte
    n_lines = F.octet_length("text") - F.octet_length(F.translate("text", "\n", "")) + 1
    none = F.lit(None).cast("array<struct<skip:int,word:bigint>>")
    keep = F.coalesce("keep", F.filter(F.array(F.struct(F.lit(0).alias("skip"), F.lit(0).cast("long").alias("word"))), lambda x: F.lit(False)), none)
    return both.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), keep.alias("keep"), text.alias("text"))


def oracle(least: int = 20, documents: int = 3) -> str:
    """DuckDB SQL for the digest of ``deduplicated``; doc_id is unique and not null there."""
    space = " || ".join(f"chr({ord(c)})" for c in SPACE)
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {space}), '{UPPER}', '{LOWER}') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {least} GROUP BY key HAVING count(DISTINCT doc_id) >= {documents}),
marked AS (SELECT k.doc_id, pos, line, s.key IS NULL OR k.doc_id = s.keeper AS kept FROM k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
