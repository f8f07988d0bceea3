"""Best-two-fit packing of tokenised documents into sequences.

Only lengths decide what fits where, and there are no more lengths than a sequence has tokens. So Spark
counts the pieces of each length, the packing is planned on those counts (a plan of patterns, each
used many times), and Spark deals the pieces of each length out over the places of the plan by their
rank. The plan is as good for all data as for a part, and its size depends on the sequence length alone.

A pattern is filled greedily with the longest pieces that fit; then its shortest piece is replaced by
two unpacked pieces if some pair fills the gap, widened by that piece, more tightly.

A null text counts as empty: one piece that holds the closing id alone. Repeated rows are packed as
often as they come. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.byte_bpe import alphabet
from marketlake.llm.common import WHOLE_BYTES, batches, small_batches, stored, task, texts

#: Pieces of one length ranked in one group; a common length gets as many groups as it needs.
GROUP = 1_000
#: Bits of a rank within a length.
RANK_BITS = 44


#: Distinct words that a worker keeps with their ids (some 50 bytes each) before it drops the rare ones.
WORDS = 200_000
#: Bytes of texts whose words are looked up at a time.
SLICE = 1_000_000

#: A character that is one token, and whose byte stands in no other character.
MARK = "\x01"
#: Lowered Latin-1 letters.
LOWERED = re.compile(f"[{''.join(c for c in map(chr, range(256)) if c.isalpha() and c == c.lower())}]+")


def latin(text: str) -> bool:
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def word_starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a byte is in a word, whether one begins there) of UTF-8 bytes that begin and end with a line end.

    Words are parted by spaces and line ends. A full stop or comma between a letter (of ASCII, or lowered
    Latin-1) and the end of the word is a word of its own: it is a pre-token of its own there.
    """
    inside = (raw != 32) & (raw != 10)
    begins = np.zeros(len(raw), dtype=bool)
    begins[1:] = inside[1:] & ~inside[:-1]
    at = np.flatnonzero((raw == 44) | (raw == 46))
    at = at[~inside[at + 1]]
    one, two = raw[at - 1], raw[np.maximum(at - 2, 0)]
    lower = one | 32
    letter = ((lower >= 97) & (lower <= 122) & (one < 128)) | ((two == 0xC3) & (one >= 0x9F) & (one != 0xB7))
    begins[at[letter]] = True
    return inside, begins


class Ids:
    """Ids of whole texts, word by word: a space or line end always parts pre-tokens.

    The tokenizer lowers case, so Latin-1 texts may be lowered first. A word of lowered Latin-1 letters is
    one pre-token: it goes to the same merges without normalising it again. All other words take the whole
    tokenizer. Words, their ids and how often they came are kept as flat arrays; when there are more than
    WORDS, the most frequent half of that stays.
    """

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(data)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.mark = int(self._ids(self.whole, [MARK])[0])
        self.bytes_to = dict(enumerate(alphabet()))
        self.last = self._last()
        self.words = pa.array([], pa.binary())
        self.ids, self.sizes, self.often = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _last(self) -> np.ndarray | None:
        """Whether an id ends a pre-token of letters; None if the vocabulary does not tell."""
        suffix, vocab = self.whole.model.end_of_word_suffix, self.whole.get_vocab(with_added_tokens=False)
        if not suffix or any(x not in vocab or x + suffix not in vocab for x in self.bytes_to.values()):
            return None
        last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        last[[k for x, k in vocab.items() if x.endswith(suffix)]] = True
        return last

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> np.ndarray:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, dtype=np.uint32) for e in found)])

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each word has): many words are encoded as one text, parted by a mark that is a token of its own."""
        found = self._ids(self.whole, [f" {MARK} ".join(words[k : k + 1000]) + f" {MARK}" for k in range(0, len(words), 1000)])
        marks = found == self.mark
        return found[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of lowered letters, whose last ids say that they are the last."""
        if self.last is None:
            return self._marked(runs)
        mapped = " ".join(runs).encode().decode("latin-1").translate({**self.bytes_to, 32: " "}).split(" ") if runs else []
        found = self._ids(self.bare, [" ".join(mapped[k : k + 1000]) for k in range(0, len(mapped), 1000)])
        return found, np.diff(np.flatnonzero(self.last[found]), prepend=-1)

    def learn(self, words: pa.Array) -> np.ndarray:
        """Keep the ids of new words, after those that are kept; the places of the words among the new."""
        names = words.cast(pa.string()).to_pylist()
        kinds = np.array([1 if LOWERED.fullmatch(w) else 2 if MARK not in w else 3 for w in names], dtype=np.int8)
        order = np.argsort(kinds, kind="stable")
        by = [[names[k] for k in np.flatnonzero(kinds == x)] for x in (1, 2, 3)]
        single = [self._ids(self.whole, [w]) for w in by[2]]
        parts = [self._runs(by[0]), self._marked(by[1]), (np.concatenate([np.zeros(0, np.uint32), *single]), np.array([len(x) for x in single], dtype=np.int64))]
        self.words = pa.concat_arrays([self.words, words.take(pa.array(order))])
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in parts)])
        self.sizes = np.concatenate([self.sizes, *(sizes for _, sizes in parts)])
        self.often = np.concatenate([self.often, np.zeros(len(names), np.int64)])
        return np.argsort(order)

    def _shrink(self) -> None:
        """Drop all but the most frequent half of WORDS; older counts weigh less from then on."""
        keep = np.sort(np.argsort(-self.often, kind="stable")[: WORDS // 2])
        stays = np.zeros(len(self.sizes), dtype=bool)
        stays[keep] = True
        self.ids, self.sizes, self.often = self.ids[np.repeat(stays, self.sizes)], self.sizes[keep], self.often[keep] // 2
        self.words = self.words.take(pa.array(keep))

    def _looked_up(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many of them come before each place in ``bounds``) of a slice from one word's end to another's."""
        inside, begins = word_starts(raw)
        data, starts = raw[inside], np.flatnonzero(begins[inside]).astype(np.int32)
        offsets = np.append(starts, np.int32(len(data)))
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        if len(self.words) > WORDS:
            self._shrink()
        kept = len(self.words)
        # the words that are kept come first, so they keep their places
        found = pa.concat_arrays([self.words, words]).dictionary_encode()
        at, new = found.indices.to_numpy()[kept:], found.dictionary.slice(kept)
        if len(new):
            at = np.concatenate([np.arange(kept), kept + self.learn(new)])[at]
        self.often += np.bincount(at, minlength=len(self.often))
        sizes = self.sizes[at]
        ends = np.append(0, np.cumsum(sizes))
        first = (np.cumsum(self.sizes) - self.sizes)[at]
        ids = self.ids[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(np.flatnonzero(begins), bounds)]

    def encode(self, texts: list[str | None], closing: int) -> list[np.ndarray]:
        """The ids of each text and the closing id."""
        lowered = [(t.lower() if latin(t) and "<|" not in t else t).encode() if t else b"" for t in texts]
        joined = b"\n".join([b"", *lowered, b""])
        starts = np.cumsum([1, *(len(t) + 1 for t in lowered)])
        raw, found, before, total, at = np.frombuffer(joined, np.uint8), [], [], 0, 0
        while at < len(joined) - 1:
            end = min((k for x in (b" ", b"\n") if (k := joined.find(x, at + SLICE)) >= 0), default=len(joined) - 1)
            ids, counts = self._looked_up(raw[at : end + 1], starts[(starts > at) & (starts <= end)] - at)
            found.append(ids)
            before.append(counts + total)
            total, at = total + len(ids), end
        ids, before = np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([*before, [total]]).astype(np.int64)
        return [np.append(ids[a:b], np.uint32(closing)) for a, b in zip(before[:-1], before[1:], strict=True)]


@lru_cache(maxsize=2)
def _ids(data: str) -> Ids:
    return Ids(data)


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, closing: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document cut into pieces of at most ``size`` ids."""
    spark = docs.sparkSession
    small_batches(spark, WHOLE_BYTES)
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(it):
        ids = _ids(sent.value)
        for b in batches(it, 2 * SLICE):
            out = []
            for doc, found in zip(b.column("doc_id").to_pylist(), ids.encode(b.column("text").to_pylist(), closing), strict=True):
                for k, at in enumerate(range(0, len(found), size)):
                    part = found[at : at + size]
                    out.append((doc, k, at, len(part), zlib.crc32(part.astype("<u4"))))
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(task("packing", run, _ids.cache_clear), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int) -> dict[str, np.ndarray]:
    """Places for ``counts[length]`` pieces of each length in sequences of ``size``.

    Arrays of one entry for each (pattern, length): ``key`` (length and first rank), ``rank`` (first
    rank), ``uses`` (pieces of the length in one sequence), ``sequence`` (first of the pattern's
    sequences) and ``offset`` (place of the first such piece).
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= size:
            raise ValueError(f"length {length} is outside 1..{size}")
        left[length] = n
    used, rows, sequences = np.zeros_like(left), [], 0
    while len(live := np.flatnonzero(left)):
        take: dict[int, int] = {}
        room = size
        while True:  # greedily, the longest that fits
            at = np.searchsorted(live, room, side="right") - 1
            while at >= 0 and left[live[at]] == take.get(live[at], 0):
                at -= 1
            if at < 0:
                break
            length = int(live[at])
            n = min(room // length, int(left[length]) - take.get(length, 0))
            take[length] = take.get(length, 0) + n
            room -= n * length
        small = min(take)
        if room:
            take = _two_for_one(take, small, room + small, left)
        times = min(int(left[x]) // n for x, n in take.items())
        offset = 0
        for x, n in take.items():
            rows.append((x << RANK_BITS | int(used[x]), used[x], n, sequences, offset))
            used[x] += n * times
            left[x] -= n * times
            offset += n * x
        sequences += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(("key", "rank", "uses", "sequence", "offset"))}


def _two_for_one(take: dict[int, int], small: int, gap: int, left: np.ndarray) -> dict[int, int]:
    """``take`` with its shortest piece replaced by the two unpacked ones that fill ``gap`` most tightly, if they beat it."""
    free = left.copy()
    for x, n in take.items():
        free[x] -= n
    free[small] += 1
    live = np.flatnonzero(free)
    live = live[live < gap]
    if not len(live):
        return take
    at = np.searchsorted(live, gap - live, side="right") - 1
    at = np.where((at >= 0) & (live[at] == live) & (free[live] < 2), at - 1, at)
    sums = np.where(at >= 0, live + live[at], 0)
    best = int(np.argmax(sums))
    if sums[best] <= small:
        return take
    take = {x: n - (x == small) for x, n in take.items() if n > (x == small)}
    for x in (int(live[best]), int(live[at[best]])):
        take[x] = take.get(x, 0) + 1
    return take


def packed(docs: DataFrame, tokenizer_path: str, size: int = 2048, closing: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    cut = stored(pieces(docs, tokenizer_path, size, closing), "packing-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    places = plan(counts, size)
    # ranks within a length: within (length, group) first, then the rows of the groups before
    groups = F.array(*(F.lit(max(1, -(-counts.get(x, 0) // GROUP))) for x in range(size + 1)))
    cut = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(groups, (F.col("length") + 1).cast("int"))))
    sizes = cut.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "group", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece"))
    ranked = cut.withColumn("within", within).join(sizes, ["length", "group"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))

    def place(it):
        for b in it:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(places["key"], length << RANK_BITS | rank, side="right") - 1
            ahead = rank - places["rank"][at]
            sequence = places["sequence"][at] + ahead // places["uses"][at]
            offset = places["offset"][at] + ahead % places["uses"][at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(task("packing", place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
