"""The ledger of a run, its reports and the sums that must agree."""

import html
import json
import random
import re
from collections import Counter

import pytest

from seqloom.operators.adapters import Adapter
from seqloom.operators.filters import FilterOptions
from seqloom.plans import accounting, catalog
from seqloom.plans.layout import Layout
from seqloom.plans.pipeline import Spec, demux, failed_records, fragments, trim
from seqloom.sources.fastq import read_fastq

TAIL = "AGATCGGAAGAGCACACGTCTG"


def back(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def made_pairs(spark, n=60):
    """Pairs whose inserts are read through, overlap, or don't; some lack a mate."""
    r = random.Random(4)
    rows = []
    for i in range(n):
        insert = "".join(r.choice("ACGT") for _ in range((40, 70, 200)[i % 3]))
        a, b = (insert + TAIL)[:60], (back(insert) + TAIL)[:60]
        q = "".join(chr(33 + r.randint(2, 41)) for _ in range(60))
        rows.append((i, f"r{i}/1", a, q[: len(a)], f"r{i}/2", b, q[::-1][: len(b)]))
    rows[5] = (5, None, None, None, *rows[5][4:])
    rows[7] = (*rows[7][:4], None, None, None)
    return spark.createDataFrame(rows, "read_idx long, id1 string, seq1 string, qual1 string, id2 string, seq2 string, qual2 string"), rows


SPEC = Spec(adapters={1: (Adapter(TAIL),), 2: (Adapter(TAIL),)}, merge=True, filters=FilterOptions(min_length=45))


def test_ledger_counts_what_the_table_holds(spark):
    df, _ = made_pairs(spark)
    table = fragments(df, SPEC)
    rows = table.collect()
    book = accounting.ledger(table)
    one = accounting.totals(book).first()
    whole = [x for x in rows if x.status != "orphan"]
    assert (one.processed, one.orphan_r1, one.orphan_r2) == (58, 1, 1)
    assert one.retained == sum(not x.rejected for x in whole) and one.rejected == one.too_short == sum(x.rejected for x in whole) > 0
    assert one.merged == sum(x.merged_seq is not None and not x.rejected for x in whole) > 0
    assert one.overlap_confirmed == sum(x.adapter1 is not None or x.adapter2 is not None for x in whole) > 0
    assert one.overlap_confirmed + one.overlap_unconfirmed == 58 and one.overlap_gapped == 0
    names = dict((x.Metric, x.Count) for x in accounting.metric_rows(book).collect())
    assert len(names) == 18 + 24 and names["rejected_min_length"] == one.too_short
    assert names["R2_full_adapter_reads"] + names["R2_partial_adapter_reads"] + names["R2_overlap_only_reads"] == sum(x.adapter2 is not None for x in whole)
    parts = [accounting.ledger(fragments(df.where(f"read_idx % 2 = {k}"), SPEC)) for k in (0, 1)]
    assert accounting.totals(parts[0].unionByName(parts[1])).first() == one  # ledgers of parts merge


def test_sections_and_histograms(spark):
    df, rows = made_pairs(spark)
    table = fragments(df, SPEC).cache()
    got = table.collect()
    stats = accounting.section_rows(accounting.ledger(table))
    reads = {
        ("before", "R1"): [(r[2], r[3]) for r in rows if r[2]],
        ("before", "R2"): [(r[5], r[6]) for r in rows if r[5]],
        ("after", "R1"): [(x.seq1, x.qual1) for x in got if x.status != "orphan" and not x.rejected and x.merged_seq is None],
        ("after", "R2"): [(x.seq2, x.qual2) for x in got if x.status != "orphan" and not x.rejected and x.merged_seq is None],
        ("after", "Merged"): [(x.merged_seq, x.merged_qual) for x in got if not x.rejected and x.merged_seq is not None],
    }
    assert {(x.phase, x.mate): (x.reads, x.bases) for x in stats.collect()} == {k: (len(v), sum(len(s) for s, _ in v)) for k, v in reads.items()}
    seen = accounting.spectrum(table).cache()
    lengths, qualities, cycles = Counter(), Counter(), Counter()
    for k, v in reads.items():
        lengths.update((*k, len(s)) for s, _ in v)
        qualities.update((*k, ord(c) - 33) for _, q in v for c in q)
        cycles.update((*k, i + 1, c) for s, _ in v for i, c in enumerate(s))
    assert {(x.phase, x.mate, x.length): x.reads for x in accounting.length_histogram(seen, stats).collect()} == lengths
    assert {(x.phase, x.mate, x.quality): x.bases for x in accounting.quality_histogram(seen).collect()} == qualities
    assert {(x.phase, x.mate, x.cycle, x.base): x.bases for x in accounting.cycle_content(seen).collect()} == cycles


def test_reads_without_bases_have_length_zero(spark):
    df = spark.createDataFrame([(0, "a", "ACGTA", "IIIII"), (1, "b", "AC", "II"), (2, "c", "ACG", "III")], "read_idx long, id1 string, seq1 string, qual1 string")
    spec = Spec(trim_front=(3, 0))
    table = fragments(df, spec)
    stats = accounting.section_rows(accounting.ledger(table))
    found = accounting.length_histogram(accounting.spectrum(table), stats).where("phase = 'after'")
    assert {x.length: x.reads for x in found.collect()} == {0: 2, 2: 1}
    row = stats.where("phase = 'after'").first()
    assert (row.reads, row.min_length, row.max_length) == (3, 0, 2)


def test_lengths_are_those_of_a_spectrum(spark):
    df, _ = made_pairs(spark)
    for spec in (SPEC, Spec(trim_front=(50, 0), max_len=(0, 7)), Spec(layout=Layout.parse("R1_4A2T"), barcodes=(("A", "A1", "ACGT"),), sheet=({"Sample": "s", "A": "A1"},))):
        table = fragments(df, spec).cache()
        stats = accounting.section_rows(accounting.ledger(table, spec.layout))
        want = accounting.length_histogram(accounting.spectrum(table, spec.layout), stats)
        got = accounting.lengths(table, spec.layout)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(got.collect()) == sorted(want.collect()) != []


def test_lengths_make_no_qualities_and_no_row_a_base(spark):
    """What is made of every base is most of the work, and lengths ask for none of it."""
    plan = catalog.queries()["report_lengths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(q" not in plan and "posexplode" not in plan and "parquet" in plan


def test_empty_input_has_whole_reports(spark, tmp_path):
    df, _ = made_pairs(spark)
    row = demux(df.where("read_idx < 0"), Spec(report_details=True, write_unassigned=True), str(tmp_path / "o")).first()
    assert row.processed == 0 and row.orphan_r1 == 0
    got = {x.Metric: x.Count for x in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "o/preprocessing")).collect()}
    assert len(got) == 42 and set(got.values()) == {"0"}


@pytest.mark.parametrize("named", [False, True])
def test_a_run_reconciles_and_reports(spark, tmp_path, named):
    df, _ = made_pairs(spark)
    spec = Spec(adapters=SPEC.adapters, merge=True, include_unmerged=True, filters=SPEC.filters, write_failed=True, write_unassigned=True, report_details=True, report_title="A <b> & c")
    row = trim(df, spec, str(tmp_path / "o"), named=named).first()
    sums = {x.check: (int(x.told), int(x.found)) for x in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "o/reconciliation")).collect()}
    assert set(sums) == {"classes", "decisions", "samples", "mates", "unassigned", "assigned"}
    assert all(a == b for a, b in sums.values()) and sums["unassigned"] == (2, 2) and sums["samples"][0] == row.assigned - row.assigned_rejected
    page = spark.read.option("wholetext", True).text(str(tmp_path / "o/report_html")).first()[0]
    document = json.loads(spark.read.option("wholetext", True).text(str(tmp_path / "o/report_json")).first()[0])
    inside = re.search(r"<script type='application/json' id='report'>(.*?)</script>", page, re.S)[1]
    assert json.loads(inside) == document and "<b>" not in page and html.escape("A <b> & c") in page
    assert document["read1_before_filtering"]["summary"]["reads"] == 59 and document["merged_after_filtering"]["summary"]["reads"] == row.merged
    assert sum(n for _, n in document["read2_after_filtering"]["length_histogram"]) == document["read2_after_filtering"]["summary"]["reads"]


def test_lost_records_are_an_error(spark):
    df, _ = made_pairs(spark)
    book = accounting.ledger(fragments(df, Spec()))
    by_sample = accounting.sample_rows(book, accounting.samples_of(spark, ["trimmed"]))
    bad = accounting.reconciled(book, by_sample, True, {"unassigned": 2, "assigned": 115}).where("told <> found").collect()
    assert [(x.check, x.told, x.found) for x in bad] == [("assigned", 116, 115)]


def test_before_begins_behind_the_structure(spark):
    df = spark.createDataFrame([(0, "a", "ACGTTTGATTACA", "I" * 13), (1, "b", "ACG", "III")], "read_idx long, id1 string, seq1 string, qual1 string")
    layout = Layout.parse("R1_4A2T")
    table = fragments(df, Spec(layout=layout, barcodes=(("A", "A1", "ACGT"),), sheet=({"Sample": "s", "A": "A1"},), max_mismatches=0))
    row = accounting.section_rows(accounting.ledger(table, layout)).where("phase = 'before'").first()
    assert (row.reads, row.bases, row.min_length) == (2, 7, 0)


def test_merged_reads_are_judged_and_fail_as_one(spark):
    insert = "ACGTTGCAGATTACAGGCATCGATTACGGATCCATGCAAGTC"
    df = spark.createDataFrame([(0, "r/1", insert[:36], "I" * 36, "r/2", back(insert)[:36], "I" * 36)], "read_idx long, id1 string, seq1 string, qual1 string, id2 string, seq2 string, qual2 string")
    assert fragments(df, Spec(merge=True, filters=FilterOptions(min_length=40))).first().rejected is False
    table = fragments(df, Spec(merge=True, filters=FilterOptions(min_length=43)))
    assert [(x.stream, x.mate, x.seq) for x in failed_records(table).collect()] == [("failed", 0, insert)]


def test_files_of_unassigned_reads_by_name(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", s, "I" * 12) for i, s in enumerate(("ACGTGATTACAG", "TTTTGATTACAG", "ACGTGATTACAT"))], "read_idx long, id1 string, seq1 string, qual1 string")
    spec = Spec(layout=Layout.parse("R1_4A"), barcodes=(("A", "A1", "ACGT"),), sheet=({"Sample": "unassigned_R1", "A": "A1"},), max_mismatches=0, write_unassigned=True)
    demux(df, spec, str(tmp_path / "o"), named=True)
    assert read_fastq(spark, str(tmp_path / "o/reads/unassigned.fastq.gz")).count() == 1
