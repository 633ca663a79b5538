"""Named FASTQ files, one for each sample and stream (or part of it): tasks write members, a commit puts them together."""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from seqloom.operators.metrics import split_parts
from seqloom.sources.fastq import _at
from seqloom.sources.tables import file_names

MARKER, STAGING, MANIFEST = "_INCOMPLETE", "_staging", "_staging/manifest.json"
COPY_BYTES = 8 << 20


def file_name(target: str, stream: str, part: int | None = None, compression: str = "gzip") -> str:
    """`sample.fastq.gz`, `sample_R1.fastq.gz`, and with a number from 1 in front for a part."""
    body = target if stream == "single" else f"{target}_{stream}"
    return ("" if part is None else f"{part + 1:04}.") + body + ".fastq" + (".gz" if compression == "gzip" else "")


@dataclass
class _Written(WriterCommitMessage):
    """Members of one task: (file, number of the first record, staged path, records, bytes)."""

    members: list[tuple[str, int, str, int, int]]


class _Writer(DataSourceArrowWriter):
    """Rows (file, read_idx, value), sorted by file and read_idx within a task."""

    def __init__(self, options):
        self.root, self.gzip = options["path"], options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, inside = _at(self.root)
        members: list[list] = []
        raw = out = None

        def close():
            if out is not None:
                if self.gzip:
                    out.close()
                members[-1][4] = raw.tell()
                raw.close()

        for batch in iterator:
            for name, number, value in zip(*(batch.column(c).to_pylist() for c in ("file", "read_idx", "value"))):
                if not members or members[-1][0] != name:
                    close()
                    staged = f"{STAGING}/{uuid.uuid4().hex}"
                    store.create_dir(f"{inside}/{STAGING}", recursive=True)
                    raw = store.open_output_stream(f"{inside}/{staged}", compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6, mtime=0) if self.gzip else raw
                    members.append([name, number, staged, 0, 0])
                out.write(value.encode())
                members[-1][3] += 1
        close()
        return _Written([tuple(m) for m in members])

    def commit(self, messages: list[_Written | None]) -> None:
        """Note the members of each file in order; whatever failed tasks left is not among them."""
        store, inside = _at(self.root)
        files: dict[str, list] = {}
        for name, *member in sorted(m for x in messages if x for m in x.members):
            files.setdefault(name, []).append(member)
        store.create_dir(f"{inside}/{STAGING}", recursive=True)
        with store.open_output_stream(f"{inside}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        """The marker stays, so nobody takes the folder for a whole one."""


class FastqFiles(DataSource):
    """df.write.format("fastq_files"): the staged half of write_files, which puts the members together."""

    @classmethod
    def name(cls):
        return "fastq_files"

    def schema(self):
        return "file string, read_idx long, value string"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def _begin(path: str, overwrite: bool) -> tuple[fs.FileSystem, str]:
    """An empty folder with the marker, or an error that leaves everything as it was."""
    store, inside = _at(path)
    there = store.get_file_info(fs.FileSelector(inside, allow_not_found=True))
    if there and not overwrite:
        raise ValueError(f"{path} is not empty" + (", and a run into it did not end" if any(x.base_name == MARKER for x in there) else ""))
    store.create_dir(inside, recursive=True)
    with store.open_output_stream(f"{inside}/{MARKER}", compression=None):
        pass
    for x in there:
        if x.base_name != MARKER:
            (store.delete_dir if x.type == fs.FileType.Directory else store.delete_file)(x.path)
    return store, inside


def _join(spark: SparkSession, path: str, files: dict[str, list]) -> None:
    """Each file from its members, in order: one that has a single member is moved, the others are copied by a
    task a file."""
    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = _at(path)
        for batch in batches:
            for name, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                draft = f"{inside}/{STAGING}/{uuid.uuid4().hex}"
                with store.open_output_stream(draft, compression=None) as out:
                    for member in members:
                        with store.open_input_stream(f"{inside}/{member}", compression=None) as f:
                            while block := f.read(COPY_BYTES):
                                out.write(block)
                store.move(draft, f"{inside}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["file"])

    rows = [(name, [m[1] for m in members]) for name, members in files.items() if len(members) > 1]
    store, inside = _at(path)
    for name, members in files.items():
        if len(members) == 1:
            store.move(f"{inside}/{members[0][1]}", f"{inside}/{name}")
    if rows:
        df = spark.createDataFrame(rows, "file string, members array<string>").repartition(len(rows), "file")
        df.mapInArrow(copy, "file string").collect()


def _rows_to_files(rows: DataFrame, order: list[str], path: str, compression: str) -> dict[str, list]:
    """Rows (file, read_idx, value and what else order names) as files below path; their members by file."""
    spark = rows.sparkSession
    spark.dataSource.register(FastqFiles)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("file", "read_idx", "value")
    dealt.write.format("fastq_files").mode("append").option("path", path).option("compression", compression).save()
    store, inside = _at(path)
    with store.open_input_stream(f"{inside}/{MANIFEST}", compression=None) as f:
        files = json.loads(f.read())
    _join(spark, path, files)
    return files


def _end(path: str) -> None:
    store, inside = _at(path)
    store.delete_dir(f"{inside}/{STAGING}")
    store.delete_file(f"{inside}/{MARKER}")


def write_lines(rows: DataFrame, path: str, compression: str = "none", overwrite: bool = False) -> None:
    """Rows (file, read_idx, value: lines with their ends) as files below path, in order of read_idx; see write_files."""
    _begin(path, overwrite)
    _rows_to_files(rows, ["file", "read_idx"], path, compression)
    _end(path)


def write_files(records: DataFrame, path: str, compression: str = "gzip", per_part: int = 0, expected: tuple[tuple[str, str], ...] = (), overwrite: bool = False) -> DataFrame:
    """Write records (target, stream, read_idx, id, seq, qual) as named files below path, and tell file, records, bytes.

    Rows are dealt by file and stretch of read_idx, so many tasks write one large sample; each writes gzip
    members, and a file is its members in order, which is a gzip file.  per_part: so many records of
    each stream in a file, numbered from 1.  expected: (target, stream) that get an empty file if no record
    comes.  A folder that is not empty is an error unless overwrite is set; names that meet once unsafe
    characters are replaced are one, too.  From the first write until all files stand, the folder has an
    _INCOMPLETE marker, and a job that fails leaves it.  A lost task is written again under other names.
    """
    if compression not in ("gzip", "none"):
        raise ValueError("compression is gzip or none")
    spark = records.sparkSession
    targets = sorted({r["target"] for r in records.select("target").distinct().collect()} | {t for t, _ in expected})  # samples: a dimension
    safe = file_names([t for t in targets if t != "unassigned"]) | {"unassigned": "unassigned"}
    store, inside = _begin(path, overwrite)
    if per_part:
        records = split_parts(records, per_part, "target", "stream")
    name = F.element_at(F.create_map(*(F.lit(x) for t in targets for x in (t, safe[t]))), F.col("target"))
    body = F.when(F.col("stream") == "single", name).otherwise(F.concat_ws("_", name, "stream"))
    front = F.concat(F.lpad((F.col("part") + 1).cast("string"), F.greatest(F.lit(4), F.length((F.col("part") + 1).cast("string"))), F.lit("0")), F.lit(".")) if per_part else F.lit("")
    file = F.concat(front, body, F.lit(".fastq" + (".gz" if compression == "gzip" else "")))
    value = F.concat(F.lit("@"), F.col("id"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"), F.lit("\n"))
    order = ["file", "read_idx", *(["stream_order"] if "stream_order" in records.columns else [])]
    files = _rows_to_files(records.withColumns({"file": file, "value": value}), order, path, compression)
    told = [(n, sum(m[2] for m in members), sum(m[3] for m in members)) for n, members in files.items()]
    for target, stream in expected:
        empty = file_name(safe[target], stream, 0 if per_part else None, compression)
        if empty not in files:
            with store.open_output_stream(f"{inside}/{empty}", compression=None) as f:
                f.write(gzip.compress(b"", mtime=0) if compression == "gzip" else b"")
            told.append((empty, 0, store.get_file_info(f"{inside}/{empty}").size))
    _end(path)
    return spark.createDataFrame(told, "file string, records long, bytes long")
