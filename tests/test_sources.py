"""Readers, sinks, options and streams."""

import bz2
import gzip
import lzma

import pytest
from pyspark.sql import functions as F

from seqloom.functions import dna
from seqloom.operators import filters
from seqloom.operators.adapters import Adapter, distal, infer_adapter, opposite
from seqloom.operators.pairing import interleaved
from seqloom.plans import options
from seqloom.plans.layout import Layout
from seqloom.plans.pipeline import Spec, html_report
from seqloom.sources import sam, tables
from seqloom.sources.fastq import read_fastq, record_index, write_fastq
from seqloom.streaming import reads as streams


def fastq(n, start=0):
    return b"".join(b"@r%d/1 x\n%s\n+\n%s\n" % (i, b"ACGTN"[: i % 5 + 1] * 3, b"@+I#5"[: i % 5 + 1] * 3) for i in range(start, start + n))


def test_compressed_files_and_ranges(spark, tmp_path):
    zstd = pytest.importorskip("zstandard")
    kinds = {"a.fq": fastq(50), "b.fq.gz": gzip.compress(fastq(30, 50)) + gzip.compress(fastq(20, 80)), "c.fq.bz2": bz2.compress(fastq(10, 100)), "d.fq.xz": lzma.compress(fastq(10, 110)), "e.fq.zst": zstd.compress(fastq(10, 120)), "_SUCCESS": b""}
    for name, data in kinds.items():
        (tmp_path / name).write_bytes(data)
    whole = read_fastq(spark, str(tmp_path)).orderBy("read_idx").collect()
    assert [r.id for r in whole] == [f"r{i}/1 x" for i in range(130)]
    for size in (40, 300):
        cut = read_fastq(spark, f"file://{tmp_path}/a.fq", split_bytes=size)
        assert cut.orderBy("read_idx").collect() == whole[:50]
        assert record_index(spark, str(tmp_path / "a.fq"), size).agg(F.sum("records")).first()[0] == 50
        every = read_fastq(spark, str(tmp_path), split_bytes=size, numbering="all").orderBy("read_idx").collect()
        assert [(r.read_idx, r.id) for r in every] == [(i, f"r{i}/1 x") for i in range(130)]
        assert read_fastq(spark, str(tmp_path), limit=60, split_bytes=size, numbering="all").count() == 60
        assert read_fastq(spark, str(tmp_path), limit=15, split_bytes=size).count() == 15 * 2 + 30
    assert whole[50].read_idx == 1 << 40


def test_numbers_do_not_depend_on_ranges(spark, tmp_path):
    """Interleaved mates, samples and limits over cut files; blank and missing line ends at a file's end; CRLF."""
    data = fastq(400)
    for name, text in (("plain", data), ("open", data[:-1]), ("blank", data + b"\n"), ("crlf", data.replace(b"\n", b"\r\n")), ("empty", b"")):
        (tmp_path / f"{name}.fq").write_bytes(text)
    for name in ("plain", "open", "blank", "crlf"):
        for size in (999, 5000):
            reads = read_fastq(spark, str(tmp_path / f"{name}.fq"), split_bytes=size)
            assert [r.id for r in reads.where("read_idx % 20 = 0").orderBy("read_idx").collect()] == [f"r{i}/1 x" for i in range(0, 400, 20)]
            assert reads.agg(F.max("read_idx"), F.count_distinct("read_idx")).first()[:] == (399, 400)
    assert read_fastq(spark, str(tmp_path / "empty.fq"), split_bytes=50).count() == 0
    two = b"".join(b"@f%d/%d\nACGT\n+\nIIII\n" % (i, m) for i in range(300) for m in (1, 2))
    (tmp_path / "two.fq").write_bytes(two)
    both = interleaved(read_fastq(spark, str(tmp_path / "two.fq"), split_bytes=700))
    assert both.where("kind = 'pair'").count() == 300


@pytest.mark.parametrize("data", [b"@a\nACGT\n+\nIII\n", b"a\nACGT\n+\nIIII\n", b"@a\nACGT\n+\n"])
def test_broken_records_are_errors(spark, tmp_path, data):
    (tmp_path / "x.fq").write_bytes(data)
    with pytest.raises(Exception, match="record 0"):
        read_fastq(spark, str(tmp_path / "x.fq")).collect()


def test_sink_keeps_order_within_a_key(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("read_idx"), F.concat(F.lit("n"), F.col("id")).alias("id"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"), F.concat(F.lit("k"), F.col("id") % 3).alias("k"))
    write_fastq(df, str(tmp_path / "o"), "k")
    got = read_fastq(spark, str(tmp_path / "o/k=k1")).orderBy("read_idx").collect()
    assert [r.id for r in got] == [f"n{i}" for i in range(100) if i % 3 == 1]


def test_interleaved_mates_must_match(spark):
    rows = [(0, "a/1", "A", "I"), (1, "a/2", "C", "I"), (2, "b/1", "A", "I")]
    schema = "read_idx long, id string, seq string, qual string"
    assert interleaved(spark.createDataFrame(rows[:2], schema)).first().seq2 == "C"
    with pytest.raises(Exception, match="interleaved"):
        interleaved(spark.createDataFrame(rows, schema)).collect()


def test_configuration_tables(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    layout = Layout.parse("R1_4A4B2T")
    codes = tables.read_barcodes(put("b", "Set\tID\tSequence\nA\tA1\tacgt\nA\tA2\tTGCA\nB\tB1\tTTTT\n"), layout)
    assert codes[0] == ("A", "A1", "ACGT")
    assert tables.read_samples(put("s", "Sample\tA\tB\nx\tA1\tB1\n"), layout, codes) == [{"Sample": "x", "A": "A1", "B": "B1"}]
    assert tables.read_technical(put("t", "Mate\tSequence\nR1\tAC\n"), layout) == {1: "AC"}
    assert tables.read_adapters(put("f", ">a\nACGT\nAC\n>b\nGG\n")) == [("a", "ACGTAC"), ("b", "GG")]
    assert tables.read_blacklist(put("l", "ACGT\n\nTTTT\n")) == ["ACGT", "TTTT"]
    for read, text in (
        (lambda p: tables.read_barcodes(p, layout), "ID\tSet\tSequence\n"), (lambda p: tables.read_barcodes(p, layout), "Set\tID\tSequence\nA\tA1\tACG\n"), (lambda p: tables.read_barcodes(p, layout), "Set\tID\tSequence\nT\tA1\tACGT\n"),
        (lambda p: tables.read_samples(p, layout, codes), "Sample\tA\tB\nx\tA9\tB1\n"), (lambda p: tables.read_samples(p, layout, codes), "Sample\tA\tB\nx\tA1\tB1\ny\tA1\tB1\n"),
        (lambda p: tables.read_technical(p, layout), "Mate\tSequence\nR1\tACG\n"), (tables.read_blacklist, ""), (tables.read_adapters, "ACGT\n"),
    ):
        with pytest.raises(ValueError):
            read(put("bad", text))
    with pytest.raises(ValueError):
        tables.file_names(["a b", "a_b"])


@pytest.mark.parametrize("bad", [dict(umi_location="read3"), dict(umi_location="per_read"), dict(barcodes=(("A", "x", "ACGT"),))])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        Spec(**bad)


def test_opposite_signature_turns_segments_round():
    layout = Layout.parse("R1_4A2T", "R2_3B(rc)1T")
    assert opposite(layout, 1, {"A": "AACC", "B": "ACG"}) == "NNGGTT"
    assert opposite(layout, 2, {"A": "AACC", "B": "AAG"}, {2: "A"}) == "TAAG"
    assert opposite(layout, 1, {"A": "AACC", "B": "ACG"}, {1: "AC"}, umi=2) == "NNGTGGTT"


def test_adapters_are_inferred_from_tails(spark):
    adapter = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
    base = F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    cut = (F.col("id") % 20 + 10).cast("int")
    df = spark.range(400).select(F.col("id").alias("read_idx"), F.concat(F.substring(base, F.lit(1), cut), F.lit(adapter)).alias("seq"))
    assert infer_adapter(df) == adapter
    assert infer_adapter(df.select("read_idx", F.lit("ACGTTGCA").alias("seq"))) is None


def test_scalar_edge_cases(spark):
    row = spark.range(1).select(dna.consensus_complement(F.lit("acNx")).alias("c"), dna.two_colour(F.lit("A00123:1")).alias("two"), dna.two_colour(F.lit("M00123:1")).alias("four"), dna.is_informative(F.lit("AAAAAAAA")).alias("poor")).first()
    assert (row.c, row.two, row.four, row.poor) == ("TGNN", True, False, False)
    with pytest.raises(Exception, match="Phred"):
        spark.range(1).select(dna.phred64_to_33(F.lit("!!"))).collect()
    assert "&lt;b&gt;" in html_report({"x": "<b>"})


def test_streams_give_what_tables_give(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("read_idx"), F.concat(F.lit("r"), F.col("id")).alias("id"), F.concat(F.repeat(F.lit("ACGT"), 5), F.when(F.col("id") % 2 == 0, "A").otherwise("C")).alias("seq"), F.concat(F.repeat(F.lit("I"), 15), F.when(F.col("id") % 3 == 0, "######").otherwise("IIIIII")).alias("qual"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    options = filters.FilterOptions(min_length=18)
    source = streams.read_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    for name, f in (("clean", lambda d: streams.clean(d, options)), ("first", streams.first_of_each)):
        q = f(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(spark.table("clean").collect()) == sorted(streams.clean(df, options).collect())
    assert spark.table("first").count() == 2


def test_adapter_places(spark):
    a = Adapter("AGATCGGAAGAGCACACGTCTG", min_partial=8)
    row = spark.range(1).select(a.full_at(F.lit("TTAGATCGGAAGAGCACACGTCTGCC"), F.lit(2)).alias("yes"), a.full_at(F.lit("TTAGATCGGAAGAGCACACGTCTGCC"), F.lit(1)).alias("no"), a.partial_at(F.lit("CCCCAGATCGGAAG"), F.lit(4)).alias("end"), a.evidence(F.lit("CCCCAGATCGGAAG")).alias("e")).first()
    assert row.yes and not row.no and row.end and (row.e.known, row.e.start) == (10, 4)


def test_option_texts():
    assert (options.positive("7"), options.fraction("0.5"), options.percent("100"), options.quality("93")) == (7, 0.5, 100, 93)
    assert [options.byte_size(x) for x in ("auto", "12", "3k", "2MiB", "1gb", "5b")] == [None, 12, 3072, 2 << 20, 1 << 30, 5]
    for f, bad in ((options.positive, "0"), (options.positive, "x"), (options.fraction, "1.1"), (options.fraction, "nan"), (options.percent, "-1"), (options.quality, "94"), (options.byte_size, ""), (options.byte_size, "0k"), (options.byte_size, "3x")):
        with pytest.raises(ValueError):
            f(bad)


def test_distal_ends():
    s = Layout.parse("R2_4A(rc)2T3B").structures[0]
    assert distal(s, {"A": "AACG", "B": "GGA"}) == "CGTTNNGGA" and distal(s, {"A": "AACG", "B": "GGA"}, "AC") == "CGTTACGGA"
    for codes, technical in (({"A": "AACGT", "B": "GGA"}, None), ({"A": "AACG", "B": "GGA"}, "A")):
        with pytest.raises(ValueError):
            distal(s, codes, technical)


def test_record_errors(spark):
    schema = "read_idx long, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string, struct<type: string, value: string>>"
    row = lambda i, flag, tags=None, qname="a": (i, qname, flag, "*", 0, 0, "*", "*", 0, 0, "ACGT", "IIII", tags or {})
    df = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert sam.checked(df(row(0, 77), row(1, 141)), paired=True).count() == 2
    for flag, paired in ((4, True), (77, False), (69, True), (205, True), (79, True)):
        with pytest.raises(Exception, match="record a"):
            sam.checked(df(row(0, flag)), paired).collect()
    with pytest.raises(Exception, match="neighbours"):
        sam.mates(df(row(0, 77), row(2, 141))).collect()
    for tags in ({"OQ": ("i", "1")}, {"OQ": ("Z", "III")}):
        with pytest.raises(Exception, match="tag"):
            sam.trimmed(df(row(0, 4, tags)).withColumns({"b_start": F.lit(1), "b_end": F.lit(4)})).collect()


def test_tasks_do_not_grow_with_ranges(spark, tmp_path):
    """Ranges are as small as asked for, but a task reads several, and none gets the index of all."""
    (tmp_path / "a.fq").write_bytes(fastq(3000))
    reads = read_fastq(spark, str(tmp_path / "a.fq"), split_bytes=60)
    assert record_index(spark, str(tmp_path / "a.fq"), 60).count() > 1000
    assert reads.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    assert [(r.read_idx, r.id) for r in reads.orderBy("read_idx").collect()] == [(i, f"r{i}/1 x") for i in range(3000)]
