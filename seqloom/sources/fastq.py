"""FASTQ in and out: a batch Data Source for plain, gzip, bzip2, xz and zstd files, and text sinks."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import os
from glob import glob

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqloom.functions.dna import fastq_record

SCHEMA = "file_idx int, read_idx long, id string, seq string, qual string"
INDEX_SCHEMA = "file_idx int, path string, start long, stop long, records long"
_INDEX = [("file_idx", pa.int32()), ("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("records", pa.int64())]
#: Plain files are cut into ranges of this size, and counted in blocks.
SPLIT_BYTES, COUNT_BYTES = 128 << 20, 8 << 20
#: read_idx has a file's number above so many bits of the record's.
FILE_BITS = 40


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> list[str]:
    """Files of a path, folder or (on the driver's own disks) pattern, sorted; hidden ones are left out."""
    if "://" not in path and any(c in path for c in "*?["):
        found = sorted(glob(path))
    else:
        store, inside = _at(path)
        if store.get_file_info(inside).type == fs.FileType.Directory:
            prefix = path[: len(path) - len(inside)] if "://" in path else ""
            found = sorted(prefix + i.path for i in store.get_file_info(fs.FileSelector(inside)) if i.is_file)
        else:
            found = [path]
    return [p for p in found if not os.path.basename(p).startswith(("_", "."))]


def _packing(magic: bytes) -> str | None:
    for begin, name in ((b"\x1f\x8b", "gzip"), (b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz"), (b"\x28\xb5\x2f\xfd", "zstd")):
        if magic.startswith(begin):
            return name
    return None


def open_reads(path: str):
    """A byte stream, decompressed by the file's first bytes (several members follow each other)."""
    store, inside = _at(path)
    f = store.open_input_file(inside)
    kind = _packing(f.read(6))
    f.seek(0)
    if kind == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True))
    opened = {"gzip": gzip.open, "bz2": bz2.open, "xz": lzma.open}.get(kind)
    return opened(f, "rb") if opened else io.BufferedReader(f)


def first_record(stream, start: int) -> int:
    """Where the first record at or behind byte `start` of a plain stream begins (its end, if none does).

    Of four lines in a row only a record's name begins with @ while the line after next begins
    with +: bases never do, whatever a quality line begins with."""
    stream.seek(max(0, start - 1))
    if start:
        stream.readline()
    at, lines = stream.tell(), []
    while len(lines) < 6:
        line = stream.readline()
        if not line:
            break
        lines.append((at, line))
        at += len(line)
    for (here, name), (_, plus) in zip(lines, lines[2:]):
        if name.startswith(b"@") and plus.startswith(b"+"):
            return here
    return at


def parse(stream, where: str):
    """(id, seq, qual) of each four-line record; a broken one is an error that names its number."""
    n = 0
    while True:
        lines = [stream.readline() for _ in range(4)]
        if not lines[0].strip() and not any(lines[1:]):
            return
        name, seq, plus, qual = (x.rstrip(b"\r\n").decode("ascii") for x in lines)
        if not name.startswith("@") or not plus.startswith("+") or len(seq) != len(qual):
            raise ValueError(f"{where}: record {n} is no FASTQ record")
        yield name[1:], seq, qual
        n += 1


class _Part(InputPartition):
    """A file, or a range of one, and the number of its first record."""

    def __init__(self, index: int, path: str, start: int = 0, end: int | None = None, first: int = 0):
        self.index, self.path, self.start, self.end, self.first = index, path, start, end, first


class _Run(InputPartition):
    """Files and ranges that one task reads one after the other."""

    def __init__(self, parts: list[_Part]):
        self.parts = parts


#: Tasks for each core, at most, that read ranges: a range may be small, and each task costs its start.
TASKS_PER_CORE = 8


def _runs(parts: list[_Part], options: dict) -> list[_Run]:
    """Neighbouring parts as tasks, as many as the option `tasks` says at most (0: one a part)."""
    size = -(-len(parts) // (int(options.get("tasks", 0)) or max(1, len(parts))))
    return [_Run(parts[i : i + size]) for i in range(0, len(parts), size)] or [_Run([])]


def tasks(spark: SparkSession) -> int:
    return TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def _ranges(path: str, size: int) -> list[_Part]:
    """Files, and ranges of `size` bytes of plain ones that are larger."""
    out = []
    for i, name in enumerate(p for part in path.split(",") for p in _files(part)):
        store, inside = _at(name)
        n = store.get_file_info(inside).size or 0
        with store.open_input_file(inside) as f:
            plain = _packing(f.read(6)) is None
        out += [_Part(i, name, a, min(a + size, n)) for a in range(0, n, size)] if plain and n > size else [_Part(i, name)]
    return out


def count_records(part: _Part) -> int:
    """Records that begin in a range of a plain file, by its line ends; those of a whole file, if it has no range."""
    if part.end is None:
        with open_reads(part.path) as f:
            lines, last = 0, b"\n"
            while block := f.read(COUNT_BYTES):
                lines, last = lines + block.count(b"\n"), block[-1:]
        return (lines + (last != b"\n")) // 4  # a blank line behind the last record is none
    store, inside = _at(part.path)
    with io.BufferedReader(store.open_input_file(inside)) as f:
        at = first_record(f, part.start)
        if at >= part.end:
            return 0
        f.seek(at)
        lines, left = 1, part.end - 1 - at  # a line end before the last byte begins a line in the range
        while left and (block := f.read(min(left, COUNT_BYTES))):
            lines, left = lines + block.count(b"\n"), left - len(block)
        f.seek(max(0, part.end - 2))
        lines -= f.read(3) == b"\n\n"  # a blank line at the file's end
    return -(-lines // 4)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.limit = int(options.get("limit", 0))

    def partitions(self):
        if "index" in self.options:
            parts = [_Part(*x) for x in json.loads(self.options["index"])]
            return _runs([p for p in parts if not self.limit or p.first < self.limit], self.options)
        return _runs(_ranges(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)) if self.options.get("mode") == "index" else 1 << 62), self.options)

    def __getstate__(self):
        """What goes to every task; the index of all ranges does not."""
        return self.__dict__ | {"options": {k: v for k, v in self.options.items() if k != "index"}}

    def _records(self, part):
        if part.end is None:
            with open_reads(part.path) as f:
                yield from enumerate(parse(f, part.path), part.first)
            return
        store, inside = _at(part.path)
        with io.BufferedReader(store.open_input_file(inside)) as f:
            at = first_record(f, part.start)
            f.seek(at)
            if at < part.end:
                for n, record in enumerate(parse(f, f"{part.path} from byte {at}"), part.first):
                    yield n, record
                    if f.tell() >= part.end:
                        return

    def read(self, run):
        for part in run.parts:
            yield from self._part(part)

    def _part(self, partition):
        if self.options.get("mode") == "index":
            yield pa.RecordBatch.from_pylist([{"file_idx": partition.index, "path": partition.path, "start": partition.start, "stop": partition.end, "records": count_records(partition)}], pa.schema(_INDEX))
            return
        rows, size = [], int(self.options.get("batchRows", 8192))
        file = 0 if self.options.get("numbering") == "all" else partition.index << FILE_BITS
        for n, (name, seq, qual) in self._records(partition):
            if self.limit and n >= self.limit:
                break
            rows.append((partition.index, file + n, name, seq, qual))
            if len(rows) == size:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file_idx", "read_idx", "id", "seq", "qual"])


class FastqDataSource(DataSource):
    """spark.read.format("fastq"): read_idx numbers records from 0 within each file, file after file.

    As it is, a partition for each file.  Ranges of plain files need to know how many records lie
    before them: mode=index gives a row for each range of splitBytes with its number of records, and
    index takes ranges with the number of their first one (read_fastq does both).  limit keeps the first
    records by number; ranges behind it are not opened.  Paths are local or URIs that Arrow can
    open from executors (s3, gs, hdfs, file)."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return INDEX_SCHEMA if self.options.get("mode") == "index" else SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def record_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file_idx, path, start, stop (null: a whole file), records: how many records begin in each range, counted by
    one task a range; a compressed file is one range."""
    spark.dataSource.register(FastqDataSource)
    return spark.read.format("fastq").option("mode", "index").option("splitBytes", split_bytes).option("tasks", tasks(spark)).load(path)


def read_fastq(spark: SparkSession, path: str, limit: int = 0, split_bytes: int = SPLIT_BYTES, numbering: str = "file") -> DataFrame:
    """Records of a file, folder or pattern (or several with commas), numbered without gaps: from 0 in each file
    (numbering="file", with the file's number in the upper bits) or from 0 over all of them in order
    ("all").  limit keeps the records with smaller numbers: of each file, or of all.

    Where a plain file is larger than split_bytes, or numbers run over several files, records are counted first, by
    range; what comes to the driver is a row a range.  The same records have the same numbers for
    any split_bytes."""
    if numbering not in ("file", "all"):
        raise ValueError("numbering is by file or all")
    spark.dataSource.register(FastqDataSource)
    parts = _ranges(path, split_bytes)
    several = len({p.index for p in parts}) > 1
    if len(parts) > len({p.index for p in parts}) or (several and numbering == "all"):
        counted = record_index(spark, path, split_bytes).orderBy("file_idx", "start").collect()
        parts, before = [], {}
        for r in counted:
            key = 0 if numbering == "all" else r["file_idx"]
            parts.append(_Part(r["file_idx"], r["path"], r["start"], r["stop"], before.get(key, 0)))
            before[key] = before.get(key, 0) + r["records"]
    index = json.dumps([[p.index, p.path, p.start, p.end, p.first] for p in parts])
    return spark.read.format("fastq").option("index", index).option("tasks", tasks(spark)).option("limit", limit).option("numbering", numbering).load()


def write_fastq(df: DataFrame, path: str, *keys: str, compression: str = "gzip", told: tuple | None = None) -> None:
    """One folder for each value of keys (sample and mate, say), records in input order inside.

    Rows are dealt by keys and a stretch of read_idx, so a large sample is written by many tasks.
    told: an Observation and aggregates of keys, observed in the stage that writes, which counts a task once.
    """
    record = df.select(*keys, "read_idx", fastq_record(F.col("id"), F.col("seq"), F.expr("qual")).alias("value"))
    dealt = record.repartitionByRange(*keys, "read_idx").sortWithinPartitions(*keys, "read_idx") if keys else record.repartitionByRange("read_idx").sortWithinPartitions("read_idx")
    if told:
        dealt = dealt.observe(*told)
    writer = dealt.select(*keys, F.expr("substring(value, 1, length(value) - 1)").alias("value")).write.option("compression", compression)
    (writer.partitionBy(*keys) if keys else writer).text(path)
