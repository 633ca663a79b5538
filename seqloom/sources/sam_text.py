"""SAM text: records of unmapped files with their header checked, and a sink that adds to the chain of programs."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from seqloom.sources import sam
from seqloom.sources.fastq import SPLIT_BYTES, _at, _Part, _ranges, _runs, open_reads, tasks
from seqloom.sources.files import write_lines

#: The columns of a record, in order.
FIELDS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
NUMBERS = ["flag", "pos", "mapq", "pnext", "tlen"]
PROGRAM = "seqloom"


def read_header(path: str) -> list[str]:
    """The lines that begin with @ in front of the records."""
    out = []
    with open_reads(path) as f:
        for line in f:
            if not line.startswith(b"@"):
                break
            out.append(line.rstrip(b"\r\n").decode())
    return out


def check_header(header: list[str], paired: bool) -> None:
    """Mates must be neighbours: a paired file says that it is sorted or grouped by name."""
    first = header[0].split("\t") if header and header[0].startswith("@HD") else []
    if paired and not {"SO:queryname", "GO:query"} & set(first[1:]):
        raise ValueError("the header of paired records must have SO:queryname or GO:query")


def with_program(header: list[str], command: str = "", name: str = PROGRAM) -> list[str]:
    """header plus an @PG line of a new ID, behind the last program of its chain."""
    programs = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in header if line.startswith("@PG\t")]
    ids = [p["ID"] for p in programs if "ID" in p]
    followed = {p["PP"] for p in programs if "PP" in p}
    own, n = name, 1
    while own in ids:
        own, n = f"{name}.{n}", n + 1
    last = [i for i in ids if i not in followed]
    fields = [f"ID:{own}", f"PN:{name}", *([f"PP:{last[-1]}"] if last else []), *([f"CL:{command}"] if command else [])]
    return [*header, "\t".join(["@PG", *fields])]


def _lines(part: _Part) -> Iterator[bytes]:
    """Records' lines that begin in a range (or the whole file)."""
    if part.end is None:
        with open_reads(part.path) as f:
            yield from (x for x in f if not x.startswith(b"@") and x.strip())
        return
    store, inside = _at(part.path)
    with io.BufferedReader(store.open_input_file(inside)) as f:
        f.seek(max(0, part.start - 1))
        if part.start:
            f.readline()
        while f.tell() < part.end and (line := f.readline()):
            if not line.startswith(b"@") and line.strip():
                yield line


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options, self.counts = options, "index" not in options

    def partitions(self):
        parts = _ranges(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES))) if self.counts else [_Part(*x) for x in json.loads(self.options["index"])]
        return _runs(parts, self.options)

    def __getstate__(self):
        """What goes to every task; the index of all ranges does not."""
        return self.__dict__ | {"options": {k: v for k, v in self.options.items() if k != "index"}}

    def read(self, run):
        for part in run.parts:
            yield from self._part(part)

    def _part(self, part):
        if self.counts:
            n = sum(1 for _ in _lines(part))
            yield pa.RecordBatch.from_pylist([{"read_idx": n, "value": json.dumps([part.index, part.path, part.start, part.end])}], pa.schema([("read_idx", pa.int64()), ("value", pa.string())]))
            return
        rows = []
        for n, line in enumerate(_lines(part), part.first):
            rows.append((n, line.rstrip(b"\r\n").decode()))
            if len(rows) == 8192:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string()))], names=["read_idx", "value"])


class SamLines(DataSource):
    """spark.read.format("sam_lines"): a row for each range with its number of records and its place, or, given these
    as index, the records' lines numbered from 0 over all files."""

    @classmethod
    def name(cls):
        return "sam_lines"

    def schema(self):
        return "read_idx long, value string"

    def reader(self, schema):
        return _Reader(self.options)


def read_sam(spark: SparkSession, path: str, paired: bool, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of SAM text files (plain ones in ranges), numbered without gaps, with the columns that sources.sam
    works on: the header is checked first, and a broken record is an error that names it.

    A record has 11 fields or more, numbers where there are some, and tags as TAG:TYPE:VALUE, each once."""
    spark.dataSource.register(SamLines)
    for name in sorted({p.path for p in _ranges(path, 1 << 62)}):
        check_header(read_header(name), paired)
    counted = spark.read.format("sam_lines").option("splitBytes", split_bytes).option("tasks", tasks(spark)).load(path).collect()  # a row a range
    index, before = [], 0
    for place, n in sorted((json.loads(r["value"]), r["read_idx"]) for r in counted):
        index.append([*place, before])
        before += n
    lines = spark.read.format("sam_lines").option("index", json.dumps(index)).option("tasks", tasks(spark)).load()
    f = F.split("value", "\t")
    split = lines.select("read_idx", "value", f.alias("f"))

    def fault(what: str):
        return F.raise_error(F.concat(F.lit("record "), F.col("read_idx").cast("string"), F.lit(f": {what}")))

    columns = [F.when(F.size("f") < 11, fault("fewer than 11 fields").cast("string")).otherwise(F.get("f", F.lit(i))).alias(c) if i == 0 else F.get("f", F.lit(i)).alias(c) for i, c in enumerate(FIELDS)]
    numbers = {c: F.when(F.col(c).rlike("^-?[0-9]{1,10}$"), F.col(c).cast("long")).otherwise(fault(f"{c} is no number").cast("long")).cast("int") for c in NUMBERS}
    tag = lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.struct(F.substring(t, 4, 1).alias("type"), F.substring(t, 6, 1 << 30).alias("value")).alias("value"))
    texts = F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0)))
    good = F.forall(texts, lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[AifZHB]:")) & (F.size(F.array_distinct(F.transform(texts, lambda t: F.substring(t, 1, 2)))) == F.size(texts))
    tags = F.when(good, F.map_from_entries(F.transform(texts, tag))).otherwise(fault("a tag is broken or there twice").cast("map<string,struct<type:string,value:string>>"))
    return split.select("read_idx", *columns, tags.alias("tags")).withColumns(numbers)


def write_sam(records: DataFrame, path: str, name: str, header: list[str], command: str = "", compression: str = "none") -> None:
    """records (read_idx and FIELDS, tags) as one SAM text file path/name, in order, with our program in its header."""
    text = F.concat_ws("\t", *(F.col(c).cast("string") for c in FIELDS), F.transform(F.map_entries("tags"), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"])))
    top = "".join(x + "\n" for x in with_program(header, command))
    rows = records.select(F.lit(name).alias("file"), "read_idx", F.concat(text, F.lit("\n")).alias("value"))
    first = records.sparkSession.createDataFrame([(name, -1, top)], "file string, read_idx long, value string")
    write_lines(first.unionByName(rows), path, compression)


def read_checked(spark: SparkSession, path: str, paired: bool, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """read_sam under the contract of unmapped input: sam.checked, and for pairs, sam.mates on top of it."""
    records = sam.checked(read_sam(spark, path, paired, split_bytes), paired)
    return sam.mates(records) if paired else records
