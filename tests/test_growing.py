"""Streams over FASTQ files that grow."""

import io

import pytest

from seqloom.sources.fastq import read_fastq
from seqloom.streaming.growing import first_arrivals, read_growing, whole_end


def record(i, size=12):
    return f"@r{i}\n{'ACGT'[i % 4] * (1 + i % size)}\n+\n{'@I+5'[i % 4] * (1 + i % size)}\n".encode()


def test_last_whole_record():
    data = b"".join(record(i) for i in range(40))
    edges = {0}
    for i in range(40):
        edges.add(max(edges) + len(record(i)))
    for n in range(len(data) + 1):
        assert whole_end(io.BytesIO(data[:n]), 0, n) == max(e for e in edges if e <= n)
    long = record(0) + b"@x\n" + b"A" * 300_000 + b"\n+\n" + b"I" * 300_000 + b"\n@open\nAC"
    assert whole_end(io.BytesIO(long), 0, len(long)) == len(long) - len(b"@open\nAC")


def run(stream, out, check):
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


@pytest.mark.parametrize("dedup", [False, True])
def test_restarts_lose_and_repeat_nothing(spark, tmp_path, dedup):
    folder = tmp_path / "in"
    folder.mkdir()
    every = [b"".join(record(i) for i in range(a, a + 200)) for a in (0, 1000)]
    cuts = [0, 1000, 1003, len(every[0])]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for name, data in zip(("a.fq", "b.fq"), every):
            with open(folder / name, "ab") as f:
                f.write(data[a:b] if b < cuts[-1] else data[a:])
        stream = read_growing(spark, str(folder), split_bytes=333)
        run(first_arrivals(stream) if dedup else stream, tmp_path / "out", tmp_path / "check")
        assert n or 0 < spark.read.parquet(str(tmp_path / "out")).count() < 400
    got = [(r.id, r.seq, r.qual) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("place").collect()]
    batch = [(r.id, r.seq, r.qual) for r in read_fastq(spark, str(folder)).orderBy("read_idx").collect()]
    assert len(batch) == 400
    if dedup:
        assert {s for _, s, _ in got} == {s for _, s, _ in batch} and len(got) == len({s for _, s, _ in batch})
    else:
        assert got == batch


def test_one_batch_keeps_the_first(spark, tmp_path):
    (tmp_path / "a.fq").write_bytes(b"".join(record(i) for i in range(300)))
    run(first_arrivals(read_growing(spark, str(tmp_path / "a.fq"), 500)), tmp_path / "out", tmp_path / "check")
    first = {}
    for i in range(300):
        first.setdefault("ACGT"[i % 4] * (1 + i % 12), f"r{i}")
    assert {r.seq: r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == first
