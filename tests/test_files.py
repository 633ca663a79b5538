"""Named FASTQ files: members put together, parts, guards and the marker."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from seqloom.plans.pipeline import Spec, trim
from seqloom.sources.files import MARKER, file_name, write_files
from seqloom.sources.fastq import read_fastq


def records(spark, n=2000):
    df = spark.range(n).select(F.when(F.col("id") % 5 == 0, "b c").otherwise("a").alias("target"), F.when(F.col("id") % 2 == 0, "R1").otherwise("single").alias("stream"), F.col("id").alias("read_idx"), F.concat(F.lit("r"), F.col("id")).alias("id"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"))
    return df.repartition(5)


def ids(path):
    with (gzip.open if str(path).endswith(".gz") else open)(path, "rt") as f:
        return [x[2:].strip() for x in f if x.startswith("@r")]


def test_members_are_joined_in_order(spark, tmp_path):
    out = tmp_path / "o"
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are one task
    try:
        told = {r.file: (r.records, r.bytes) for r in write_files(records(spark), str(out), expected=(("none", "R2"),)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(os.listdir(out)) == sorted(told) == ["a.fastq.gz", "a_R1.fastq.gz", "b_c.fastq.gz", "b_c_R1.fastq.gz", "none_R2.fastq.gz"]
    assert ids(out / "a_R1.fastq.gz") == [str(i) for i in range(0, 2000, 2) if i % 5]
    assert ids(out / "b_c.fastq.gz") == [str(i) for i in range(5, 2000, 10)] and told["b_c.fastq.gz"][0] == 200
    assert ids(out / "none_R2.fastq.gz") == [] and all(os.path.getsize(out / f) == b for f, (_, b) in told.items())
    assert (out / "a_R1.fastq.gz").read_bytes().count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") > 1
    assert read_fastq(spark, str(out / "a_R1.fastq.gz")).count() == 800
    with pytest.raises(ValueError, match="not empty"):
        write_files(records(spark), str(out))
    assert write_files(records(spark, 10), f"file://{out}", compression="none", overwrite=True).count() == 4 and len(os.listdir(out)) == 4


def test_parts_are_numbered(spark, tmp_path):
    out = tmp_path / "o"
    write_files(records(spark), str(out), per_part=150, compression="none", expected=(("z", "single"),))
    every = [str(i) for i in range(0, 2000, 2) if i % 5]
    names = sorted(x for x in os.listdir(out) if x.endswith("a_R1.fastq"))
    assert names == [f"{i:04}.a_R1.fastq" for i in range(1, 7)] and sum((ids(out / x) for x in names), []) == every
    assert len(ids(out / names[0])) == 150 and ids(out / "0001.z.fastq") == [] and file_name("s", "merged", 11) == "0012.s_merged.fastq.gz"


def test_a_failed_job_leaves_the_marker(spark, tmp_path):
    out = tmp_path / "o"
    broken = records(spark).withColumn("seq", F.when(F.col("read_idx") == 1234, F.raise_error(F.lit("broken read"))).otherwise(F.col("seq")))
    with pytest.raises(Exception, match="broken read"):
        write_files(broken, str(out))
    assert MARKER in os.listdir(out) and not [x for x in os.listdir(out) if x.endswith(".gz")]
    with pytest.raises(ValueError, match="did not end"):
        write_files(records(spark), str(out))
    write_files(records(spark), str(out), overwrite=True)
    assert MARKER not in os.listdir(out) and len(os.listdir(out)) == 4
    with pytest.raises(ValueError, match="collide"):
        write_files(records(spark).withColumn("target", F.when(F.col("read_idx") < 9, "b_c").otherwise(F.col("target"))), str(tmp_path / "p"))
    assert not (tmp_path / "p").exists()


def test_trim_writes_named_files_with_unmerged_mates_in_turn(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(2)
    rows, comp = [], str.maketrans("ACGT", "TGCA")
    for i in range(60):
        insert = "".join(r.choice(list("ACGT"), 70 if i % 2 else 400))
        rows.append((i, f"r{i}/1", insert[:50], "I" * 50, f"r{i}/2", insert[::-1].translate(comp)[:50], "I" * 50))
    reads = spark.createDataFrame(rows, "read_idx long, id1 string, seq1 string, qual1 string, id2 string, seq2 string, qual2 string")
    trim(reads, Spec(merge=True, include_unmerged=True), str(tmp_path / "o"), named=True)
    assert sorted(os.listdir(tmp_path / "o/reads")) == ["trimmed_R1.fastq.gz", "trimmed_R2.fastq.gz", "trimmed_merged.fastq.gz"]
    with gzip.open(tmp_path / "o/reads/trimmed_merged.fastq.gz", "rt") as f:
        names = [x.split()[0][1:].strip() for x in f if x.startswith("@r")]
    assert [x.split("/")[0] for x in names] == [f"r{i}" for i in range(60) for _ in range(1 if i % 2 else 2)]
    assert [x for x in names if x.startswith("r4")][:2] == ["r4/1", "r4/2"]
