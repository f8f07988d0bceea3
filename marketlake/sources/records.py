"""Fixed-width tick records as a Spark data source: ``spark.read.format("tick_records").load(path)``.

A file is dealt to tasks by byte range, cut at record borders (option ``splitBytes``), so one large file is
read by many tasks; a task holds one chunk of records at a time. A short rest at the end of a file is an
error row in a batch; a stream waits until the record is whole. Null fields are written as 0, a null symbol as an
empty one; an empty folder gives no rows. Files whose name begins with ``_`` or ``.`` are not read.

Writing puts each task's file in a staging folder; the commit moves the files of the successful attempts
next to the others. Paths may be on any file system that pyarrow knows by its URI.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from marketlake.sources.io import DECODED, PRICE_SCALE, RECORD

#: Bytes of one task, and records of one batch of rows.
SPLIT_BYTES = 64 << 20
CHUNK = 1 << 15
OUT = pa.schema([("source", pa.string()), ("symbol", pa.string()), ("timestamp_us", pa.int64()), ("bid", pa.float64()), ("ask", pa.float64()),
                 ("last", pa.float64()), ("volume", pa.float64()), ("flags", pa.int32()), ("error", pa.string())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def files(path: str) -> dict[str, int]:
    """Size of every record file at or below ``path``."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    base = at.rstrip("/") + "/"
    return {f.path: f.size for f in found if f.is_file and not any(p[:1] in "_." for p in f.path.removeprefix(base).split("/"))}


@dataclass
class Span(InputPartition):
    """Bytes of one file; ``last`` if what follows the whole records is an error."""

    file: str
    start: int
    end: int
    last: bool


def spans(file: str, start: int, end: int, size: int, tail: bool) -> list[Span]:
    """Ranges of about ``size`` bytes that begin at record borders."""
    step = max(1, size // RECORD.itemsize) * RECORD.itemsize
    return [Span(file, a, min(a + step, end), tail and a + step >= end) for a in range(start, end, step)]


def rows_of(rec: np.ndarray, file: str) -> pa.RecordBatch:
    n = len(rec)
    symbols = np.char.decode(rec["symbol"], "utf-8", "replace")
    return pa.RecordBatch.from_arrays([
        pa.array([file] * n, pa.string()), pa.array(symbols.tolist(), pa.string()), pa.array(rec["timestamp_us"].astype("int64")),
        *[pa.array(rec[c] / PRICE_SCALE) for c in ("bid", "ask", "last")], pa.array(rec["volume"].astype("float64")), pa.array(rec["flags"].astype("int32")), pa.nulls(n, pa.string())], schema=OUT)


def read_span(path: str, span: Span):
    fs, _ = opened(path)
    with fs.open_input_file(span.file) as f:
        for at in range(span.start, span.end, CHUNK * RECORD.itemsize):
            blob = f.read_at(min(CHUNK * RECORD.itemsize, span.end - at), at)
            n = len(blob) // RECORD.itemsize
            if n:
                yield rows_of(np.frombuffer(blob, RECORD, count=n), span.file)
            rest = len(blob) - n * RECORD.itemsize
            if rest and span.last:
                yield pa.RecordBatch.from_pylist([{"source": span.file, "error": f"short record of {rest} bytes"}], schema=OUT)


class RecordReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self):
        return [s for f, n in sorted(files(self.path).items()) for s in spans(f, 0, n, self.size, True)] or [Span("", 0, 0, False)]

    def read(self, partition: Span):
        if partition.file:
            yield from read_span(self.path, partition)


class RecordStreamReader(DataSourceStreamReader):
    """The offset is the number of bytes taken from each file, whole records only; it grows with the number of
    files in the folder, not with their rows."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: n - n % RECORD.itemsize for f, n in files(self.path).items()}

    def partitions(self, start: dict, end: dict):
        return [s for f, n in sorted(end.items()) for s in spans(f, start.get(f, 0), n, self.size, False)]

    def read(self, partition: Span):
        yield from read_span(self.path, partition)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _staging(self, at: str) -> str:
        return f"{at}/_staging-{self.job}"

    def write(self, iterator) -> Written:
        fs, at = opened(self.path)
        name, out = f"part-{uuid.uuid4().hex}.bin", None
        for b in iterator:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(self._staging(at), recursive=True)
                out = fs.open_output_stream(f"{self._staging(at)}/{name}")
            out.write(encoded(b).tobytes())
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages) -> None:
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        old = list(files(self.path)) if self.overwrite else []
        for m in messages:
            if m is not None and m.file:
                fs.move(f"{self._staging(at)}/{m.file}", f"{at}/{m.file}")
        for f in old:
            fs.delete_file(f)
        self._clear(fs, at)

    def abort(self, messages) -> None:
        self._clear(*opened(self.path))

    def _clear(self, fs: pafs.FileSystem, at: str) -> None:
        if fs.get_file_info(self._staging(at)).type == pafs.FileType.Directory:
            fs.delete_dir(self._staging(at))


def encoded(batch: pa.RecordBatch) -> np.ndarray:
    """Records of a batch with the columns symbol, timestamp_us, bid, ask, last, volume and flags."""
    def numbers(name):
        return batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)

    rec = np.zeros(batch.num_rows, RECORD)
    rec["symbol"] = [(s or "").encode("utf-8") for s in batch.column("symbol").to_pylist()]
    rec["timestamp_us"], rec["volume"], rec["flags"] = numbers("timestamp_us"), numbers("volume"), numbers("flags")
    for c in ("bid", "ask", "last"):
        rec[c] = np.round(numbers(c) * PRICE_SCALE)
    return rec


class TickRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tick_records"

    def schema(self) -> str:
        return DECODED

    def _size(self) -> int:
        return int(self.options.get("splitBytes", SPLIT_BYTES))

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"], self._size())

    def streamReader(self, schema) -> RecordStreamReader:
        return RecordStreamReader(self.options["path"], self._size())

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TickRecords)
