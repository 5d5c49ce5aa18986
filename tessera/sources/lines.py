"""Lines of files with their byte offsets: a data source whose partitions are byte ranges, a stored index, reads by offset.

A line belongs to the range that its first byte lies in, so a large file is read by many tasks and none reads a line twice.
Files are opened where pyarrow can open them (local paths, and stores named by a URI).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, range int, place int, offset long, n_bytes long, line string"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _opened(store: pafs.FileSystem, path: str) -> io.BufferedIOBase:
    return open(path, "rb") if isinstance(store, pafs.LocalFileSystem) else io.BufferedReader(store.open_input_file(path), 1 << 20)


class ByteRange(InputPartition):
    def __init__(self, file: str, number: int, begin: int, end: int):
        super().__init__(None)
        self.file, self.number, self.begin, self.end = file, number, begin, end


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most, self.text = options["path"], int(options.get("rangebytes", 32 << 20)), options.get("text", "true") == "true"

    def partitions(self) -> list[ByteRange]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        found = store.get_file_info(pafs.FileSelector(path, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))
        if not files and info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        return [ByteRange(f, k, begin, begin + self.most) for f, size in files for k, begin in enumerate(range(0, size, self.most))] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = _store(self.path)
        rows: list[tuple] = []
        with _opened(store, partition.file) as file:
            for place, (offset, n_bytes, line) in enumerate(lines_of(file, partition.begin, partition.end)):
                rows.append((place, offset, n_bytes, line.rstrip(b"\r\n").decode("utf-8") if self.text else None))
                if len(rows) == 4096:
                    yield self.batch(partition, rows)
                    rows = []
        if rows:
            yield self.batch(partition, rows)

    def batch(self, p: ByteRange, rows: list[tuple]) -> pa.RecordBatch:
        place, offset, n_bytes, line = zip(*rows, strict=True)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.record_batch([pa.array([p.file] * len(rows)), pa.array([p.number] * len(rows), pa.int32()), pa.array(place, pa.int32()), pa.array(offset, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(line, pa.string())], names=names)


def lines_of(file: io.BufferedIOBase, begin: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, bytes up to the next such line or the end of the file, line) of the non-blank lines that begin in [begin, end)."""
    at = begin
    if begin:
        file.seek(begin - 1)
        at = begin - 1 + len(file.readline())  # to the end of a line that began before
    pending = None
    while True:
        line = file.readline()
        if (not line or line.strip()) and pending:
            yield pending[0], at - pending[0], pending[1]
            pending = None
        if not line or (at >= end and pending is None):
            return
        if line.strip():
            pending = (at, line)
        at += len(line)


class LineSource(DataSource):
    """Format ``byte_lines``: options path (a file or folder), rangebytes, and text (false: no contents)."""

    @classmethod
    def name(cls) -> str:
        return "byte_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> LineReader:
        return LineReader(dict(self.options))


def lines(spark: SparkSession, path: str, range_bytes: int = 32 << 20, text: bool = True) -> DataFrame:
    """(file, range, place, offset, n_bytes, line) of all non-blank lines below a path.

    ``n_bytes`` goes up to the next non-blank line or the end of the file, with line ends of any kind and blank lines.
    Lines end at a newline; a carriage return before it is no part of ``line``.
    """
    spark.dataSource.register(LineSource)
    return spark.read.format("byte_lines").option("rangebytes", range_bytes).option("text", str(text).lower()).load(path)


def write_offsets(spark: SparkSession, path: str, index_path: str, range_bytes: int = 32 << 20) -> None:
    """An index of the lines below ``path`` as Parquet: file, offset, n_bytes, row_index (dense, by file and offset)."""
    lines(spark, path, range_bytes, text=False).select("file", "range", "place", "offset", "n_bytes").write.parquet(f"{index_path}/ranges")
    ranges = spark.read.parquet(f"{index_path}/ranges")
    counts = ranges.groupBy("file", "range").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = ranges.join(counts.select("file", "range", before.alias("base")), ["file", "range"])
    numbered.select((F.col("base") + F.col("place")).alias("row_index"), "file", "offset", "n_bytes").write.parquet(f"{index_path}/lines")


def offsets(spark: SparkSession, index_path: str) -> DataFrame:
    return spark.read.schema("row_index long, file string, offset long, n_bytes long").parquet(f"{index_path}/lines")


def read_at(located: DataFrame, path: str) -> DataFrame:
    """located (with file, offset and n_bytes) and ``line``: only those bytes of the files below ``path`` are read.

    Rows are put in order by file, so that a task opens few files and reads forward.
    """
    columns = located.columns

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(path)
        file, now = None, None
        for batch in batches:
            found = []
            for name, offset, n in zip(*[batch[c].to_pylist() for c in ("file", "offset", "n_bytes")], strict=True):
                if name != now:
                    if file:
                        file.close()
                    file, now = _opened(store, name), name
                file.seek(offset)
                found.append(file.read(n).split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*columns, "line"])
        if file:
            file.close()

    parts = int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return located.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(fetch, located.schema.add("line", "string"))
