"""FASTQ files that grow: a streaming source by byte offsets, and the first of each in order of arrival."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor

from seqloom.sources.fastq import FILE_BITS, SPLIT_BYTES, _at, _files, _packing, _Part, first_record, parse

SCHEMA = "place long, id string, seq string, qual string"
#: Bytes from a file's end in which its last whole record is looked for, at first.
TAIL = 1 << 16
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def whole_end(stream, start: int, size: int) -> int:
    """Where the last whole record of a plain file of `size` bytes ends, or start: only the file's tail is read."""
    tail = TAIL
    while True:
        begin = max(start, size - tail)
        at = start if begin == start else first_record(stream, begin)
        stream.seek(at)
        data = stream.read(size - at)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        if len(ends) >= 4:
            return at + int(ends[len(ends) // 4 * 4 - 1]) + 1
        if begin == start:
            return start
        tail *= 4


class _Growing(DataSourceStreamReader):
    """An offset is, for each file by number, how far whole records were read."""

    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in (p for part in self.path.split(",") for p in _files(part)):
            store, inside = _at(path)
            size = store.get_file_info(inside).size or 0
            with io.BufferedReader(store.open_input_file(inside)) as f:
                if _packing(f.read(6)):
                    raise ValueError(f"{path}: a compressed file can't be read while it grows")
                out[path] = whole_end(f, 0, size)
        return out

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        numbers = {p: i for i, p in enumerate(sorted(end))}
        return [_Part(numbers[p], p, a, min(a + self.size, n)) for p, n in end.items() for a in range(start.get(p, 0), n, self.size)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, inside = _at(partition.path)
        rows = []
        with io.BufferedReader(store.open_input_file(inside)) as f:
            at = first_record(f, partition.start)
            f.seek(at)
            if at < partition.end:
                for record in parse(f, f"{partition.path} from byte {at}"):
                    rows.append(((partition.index << FILE_BITS) + at, *record))
                    at = f.tell()
                    if at >= partition.end or len(rows) == 8192:
                        yield _batch(rows)
                        rows = []
                    if at >= partition.end:
                        return

    def commit(self, end: dict) -> None:
        """Files stay as they are."""


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["place", "id", "seq", "qual"])


class GrowingFastq(DataSource):
    """spark.readStream.format("growing_fastq"): records of plain files (a file, folder or pattern) as they are
    written; a record counts once its last line end is there.  place orders records: the byte at which
    one begins, below the number of its file by name (files that come later must sort last)."""

    @classmethod
    def name(cls):
        return "growing_fastq"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return _Growing(self.options)


def read_growing(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of place, id, seq, qual; restarted from a checkpoint, it goes on behind the last whole record."""
    spark.dataSource.register(GrowingFastq)
    return spark.readStream.format("growing_fastq").option("splitBytes", split_bytes).load(path)


class _First(StatefulProcessor):
    """One number a key: the place of its first read."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "place long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            row = part.nsmallest(1, "place")
            if best is None or row["place"].iloc[0] < best["place"].iloc[0]:
                best = row
        if not self.seen.exists():
            self.seen.update((int(best["place"].iloc[0]),))
            yield best[["place", "id", "seq", "qual"]]

    def close(self) -> None:
        pass


def first_arrivals(reads: DataFrame) -> DataFrame:
    """The first read, by place, of each sequence of bases on a stream of place, id, seq, qual.

    State is a digest and a number for each different read, in RocksDB; reads come in order of place from one
    micro-batch to the next, so what was passed on stays right."""
    reads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = reads.withColumn("_key", F.sha2(F.upper("seq"), 256))
    return keyed.groupBy("_key").transformWithStateInPandas(_First(), outputStructType=SCHEMA, outputMode="Append", timeMode="None")
