"""Byte-level BPE on a sentencepiece model that is serialised straight from a rank file.

Every byte is mapped to one visible character, a piece is the mapped bytes of a rank, its score the
negative rank, normalisation is the identity. sentencepiece then joins the neighbours of the lowest
rank first, leftmost on a tie, as the rank file means it. Texts are cut by the pattern first and each
match is encoded alone; ids are decoded by the inverse mapping.

A null text counts as empty; an empty text has no ids and the digests of empty strings. Repeated rows
and ties need no rule: each row is encoded by itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import Memo, batches, small_batches, texts

#: White space next to a space.
SPACES = re.compile(r"\s | \s").search


def alphabet() -> list[str]:
    """One visible character for each byte: Latin-1 where it prints, else one from 256 up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(other)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and rank from lines of base64 and number."""
    return {base64.b64decode(a): int(n) for a, n in map(bytes.split, data.splitlines())}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose id is the rank; the unknown piece comes after all ranks."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without a gap")
    to = alphabet()
    out = b""
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = _message(1, "".join(to[b] for b in token).encode())
        out += _message(1, piece + b"\x15" + struct.pack("<f", -rank))
    # fixed values of the model format: type 2 is the unknown piece, model type 2 is BPE
    out += _message(1, _message(1, b"<unknown piece>") + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x02")
    trainer = b"\x18\x02" + _varint(4 << 3) + _varint(len(ranks) + 1) + _varint(40 << 3) + _varint(len(ranks))
    trainer += b"".join(_varint(f << 3) + b"\xff" * 9 + b"\x01" for f in (41, 42, 43))  # no begin, end or padding piece
    trainer += _message(45, b"<unknown piece>")
    # no prefix, no removal of white space, no escaping
    normalizer = _message(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"
    return out + _message(2, trainer) + _message(3, normalizer)


def classes(pattern: str) -> str:
    r"""The pattern with \\p{L}, \\p{N} and \\s spelt out as ranges, which the standard matcher looks up in a bitmap.

    White space is that of the rank files' library: four separators of ASCII are none.
    """
    sets: dict[str, list[int]] = {r"\p{L}": [], r"\p{N}": [], r"\s": []}
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LN":
            sets[rf"\p{{{kind[0]}}}"].append(c)
        elif chr(c).isspace() and not 28 <= c <= 31:
            sets[r"\s"].append(c)
    for name, members in sets.items():
        starts = [c for c, before in zip(members, [-2, *members], strict=False) if c != before + 1]
        ends = [c for c, after in zip(members, [*members[1:], -2], strict=True) if c != after - 1]
        ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))
        pattern = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(name, ranges), pattern).replace(name, f"[{ranges}]")
        if name == r"\s":
            pattern = pattern.replace(r"\S", f"[^{ranges}]")
    return pattern


class Encoder:
    """Encodes and decodes whole texts; keeps what it found for short matches."""

    def __init__(self, ranks: dict[bytes, int]):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.to = alphabet()
        self.back = {c: b for b, c in enumerate(self.to)}
        self.bytes_to = dict(enumerate(self.to))
        self.tokens = [bytes(map(self.back.__getitem__, self.model.id_to_piece(i))) for i in range(len(ranks))]
        self.match = re.compile(classes(public_tokenizers.PATTERN)).findall
        self.memo = Memo()
        self.decimal = list(map(str, range(len(ranks))))

    def mapped(self, matches: list[str]) -> list[str]:
        """The bytes of each match as characters; the byte 255, which UTF-8 never has, parts them meanwhile."""
        joined = b"\xff".join([m.encode() for m in matches]).decode("latin-1").translate(self.bytes_to)
        return joined.split(self.to[255]) if matches else []

    def ids(self, matches: list[str]) -> list[list[int]]:
        """Ids of each match alone."""
        return self.model.encode(self.mapped(matches), num_threads=1)

    def bytes_of(self, ids: list[int]) -> bytes:
        """The inverse mapping."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def packed(self, matches: list[str], ends: list[int]) -> list[bytes]:
        """Ids of consecutive matches, joined up to each of ``ends``, four bytes an id."""
        found = self.ids(matches)
        flat = array("I", chain.from_iterable(found)).tobytes()
        stops = np.cumsum([0, *map(len, found)])[[0, *ends]] * 4
        return [flat[a:b] for a, b in pairwise(stops.tolist())]

    def _learn(self, words: list[str]) -> None:
        """Ids of words as they stand after a space: all are cut at once, each begins at its space."""
        matches = self.match(" " + " ".join(words)) if words else []
        ends = [k for k, m in enumerate(matches) if m[0] == " "][1:] + [len(matches)] * bool(words)
        self.memo.update(zip(words, self.packed(matches, ends), strict=True))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts.

        A single space between two characters that are no white space always begins a match, so words
        cut there can be kept in a memo. Other texts, and the first word of each, are cut as a whole.
        """
        plain = [bool(t) and t[0] != " " and t[-1] != " " and not SPACES(t) for t in texts]
        words = [t.split(" ") if p else [] for t, p in zip(texts, plain, strict=True)]
        cut = [self.match(w[0] if p else t or "") for t, p, w in zip(texts, plain, words, strict=True)]
        first = self.packed([m for c in cut for m in c], np.cumsum([len(c) for c in cut]).tolist())
        words = [w[1:] for w in words]
        self._learn(self.memo.missing(words))
        known = self.memo.__getitem__
        return [np.frombuffer(f + b"".join(map(known, w)), dtype=np.uint32).tolist() for f, w in zip(first, words, strict=True)]

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes)."""
        out = []
        for ids in self.encode(texts):
            decimal = ",".join(map(self.decimal.__getitem__, ids)).encode()
            out.append((len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(self.bytes_of(ids)).hexdigest()))
        return out


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> Encoder:
    return Encoder(read_ranks(data))


def encoded(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    The rank file is read on the driver (a few MB at most) and sent along with the tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(it):
        encoder = _encoder(sent.value)
        for b in batches(it):
            found = encoder.digests(b.column("text").to_pylist())
            n, ids, raw = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids array): the ids themselves."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(it):
        encoder = _encoder(sent.value)
        for b in batches(it):
            rows = encoder.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded`` (binary): the bytes of its id arrays; null for a null array."""
    spark = tokens.sparkSession
    with open(ranks_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("binary")
    def back(column):
        encoder = _encoder(sent.value)
        return column.map(lambda x: None if x is None else encoder.bytes_of(list(x)))

    return tokens.withColumn("decoded", back(ids))
