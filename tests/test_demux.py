"""demux and trim from reads to files."""

import gzip

import pytest

from seqloom.operators.adapters import Adapter
from seqloom.operators.filters import FilterOptions
from seqloom.operators.overlap import overlaps
from seqloom.plans.layout import Layout
from seqloom.plans.pipeline import Spec, demux, fragments, records, trim
from seqloom.sources.fastq import read_fastq


def test_demux_single_end(spark, tmp_path):
    reads = [("a", "ACGATGCAAAGATTACA"), ("b", "ANNTTGCAAACCCCCCC"), ("c", "TGCACTAGAAGATTACA"), ("d", "ACGTTGCA")]
    with gzip.open(tmp_path / "in.fastq.gz", "wt") as f:
        f.writelines(f"@{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in reads)
    df = read_fastq(spark, str(tmp_path / "in.fastq.gz")).withColumnsRenamed({"id": "id1", "seq": "seq1", "qual": "qual1"}).drop("file_idx")
    spec = Spec(layout=Layout.parse("R1_4A4B2T"), barcodes=(("A", "A01", "ACGT"), ("A", "A02", "TGCA"), ("B", "B01", "TGCA")), sheet=({"Sample": "sample_1", "A": "A01", "B": "B01"},))
    row = demux(df, spec, str(tmp_path / "out")).first()
    assert (row.processed, row.assigned, row.unmatched, row.unrouted) == (4, 1, 2, 1)
    got = read_fastq(spark, str(tmp_path / "out/reads/target=sample_1/stream=single")).collect()
    assert [(r.id, r.seq) for r in got] == [("a", "GATTACA")]


def test_trim_pairs_with_merge_and_umi(spark, tmp_path):
    insert = "ACGTTGCAGATTACAGGCATCGATTACGGATCCATGCAAGTC"
    back = insert[::-1].translate(str.maketrans("ACGT", "TGCA"))
    tail = "AGATCGGAAGAGCACACGTCTG"
    df = spark.createDataFrame([(0, "r/1", "GG" + insert + tail, "I" * 66, "r/2", back + tail, "I" * 64)], "read_idx long, id1 string, seq1 string, qual1 string, id2 string, seq2 string, qual2 string")
    spec = Spec(merge=True, umi_location="read1", umi_length=2, filters=FilterOptions(min_length=20), adapters={1: (Adapter(tail),), 2: (Adapter(tail),)})
    rows = records(fragments(df, spec), spec).collect()
    assert [(r.stream, r.id, r.seq) for r in rows] == [("merged", "r:GG merged", insert)]
    assert trim(df, spec, str(tmp_path / "out")).first().merged == 1


def test_specs_are_checked():
    with pytest.raises(ValueError):
        Layout.parse("R1_4T(rc)")
    with pytest.raises(ValueError):
        Spec(umi_location="read1")


def rows_of(spark, pairs):
    rows = [(i, f"r{i}/1", a, "I" * len(a) if a is not None else None, f"r{i}/2", b, "I" * len(b) if b is not None else None) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "read_idx long, id1 string, seq1 string, qual1 string, id2 string, seq2 string, qual2 string")


def back(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def dna_of(seed, n):
    import random

    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def test_pairs_with_missing_mates_keep_their_number(spark):
    from seqloom.operators.pairing import pair

    names = [(i, f"q{i}") for i in range(12)]
    schema = "read_idx long, id string, seq string, qual string"
    r1 = spark.createDataFrame([(k, n, dna_of(k, 60), "I" * 60) for k, (i, n) in enumerate(x for x in names if x[0] != 3)], schema)
    r2 = spark.createDataFrame([(k, n, dna_of(100 + k, 60), "I" * 60) for k, (i, n) in enumerate(x for x in names if x[0] != 7)], schema)
    spec = Spec(correction=True, merge=True, filters=FilterOptions(min_length=100), write_unassigned=True)
    table = fragments(pair(r1, r2), spec)
    got = table.collect()
    assert len(got) == 12 and len({r.read_idx for r in got}) == 12
    assert sorted(r.status for r in got).count("orphan") == 2
    kept = records(table, spec).collect()
    assert sorted((r.target, r.stream, r.id) for r in kept) == [("unassigned", "R1", "q7"), ("unassigned", "R2", "q3")]


def test_merge_restores_what_front_clips_took(spark):
    insert = dna_of(5, 100)
    df = rows_of(spark, [(insert, back(insert))])
    spec = Spec(merge=True, trim_front=(3, 7))
    got = [r for r in records(fragments(df, spec), spec).collect()]
    assert [(r.stream, r.seq) for r in got] == [("merged", insert)]


def test_overlap_confirms_adapters(spark):
    insert, tail1, tail2 = dna_of(6, 60), "AGATCGGAAGAGCACACGTCTG", "AGATCGGAAGAGCGTCGTGTAG"
    inside = dna_of(7, 60) + tail1 + dna_of(8, 138)
    short = dna_of(9, 25)
    df = rows_of(spark, [(insert + tail1, back(insert) + tail2), (inside[:150], back(inside)[:150]), (short + tail1, back(short) + tail2)])
    own = {1: (Adapter(tail1),), 2: (Adapter(tail2),)}
    by = {r.read_idx: r for r in fragments(df, Spec(adapters=own)).collect()}
    assert (by[0].seq1, by[0].seq2, by[0].adapter1) == (insert, back(insert), "full")
    assert by[1].seq1 == inside[:150] and by[2].seq1 == short + tail1  # kept: inside the insert, and too short to overlap
    alone = {r.read_idx: r for r in fragments(df, Spec(adapters=own, overlap=False)).collect()}
    assert alone[1].seq1 == inside[:60] and alone[2].seq1 == short
    front = {r.read_idx: r for r in fragments(df, Spec(adapters=own, trim_front=(4, 6))).collect()}
    assert (front[0].seq1, front[0].seq2) == (insert[4:], back(insert)[6:])


def test_overlaps_equal_a_plain_search(spark):
    import random

    import numpy as np

    from seqloom.operators import overlap as O

    r, xs, ys = random.Random(3), [], []
    for i in range(300):
        insert = dna_of(1000 + i, r.randint(25, 120))
        if i % 5 == 0:
            insert = (insert[:12] * 12)[: len(insert)]
        a, b = (insert + dna_of(i, 40))[: r.randint(30, 90)], (back(insert) + dna_of(i + 500, 40))[: r.randint(30, 90)]
        b = "".join("N" if r.random() < 0.002 else r.choice("ACGT") if r.random() < 0.03 else c for c in b)
        xs.append(O._CODE[np.frombuffer(a.encode(), np.uint8)])
        ys.append(O._back(O._CODE[np.frombuffer(b.encode(), np.uint8)]))
    want = []
    for x, y in zip(xs, ys):
        hits = []
        for insert in range(30, len(x) + len(y) - 29):
            a, b = max(0, insert - len(y)), max(0, len(y) - insert)
            n = min(len(x) - a, len(y) - b)
            p, q = x[a : a + n], y[b : b + n]
            if n >= 30 and max(p.max(), q.max()) < 4 and (p != q).sum() <= min(5, n * 20 // 100) and O._informative(p):
                hits.append(("unique", insert, n, int((p != q).sum())))
        want.append(hits[0] if len(hits) == 1 else ("ambiguous" if hits else "none", 0, 0, 0))
    got = O.find_overlaps(xs, ys, 30, 5, 20)
    assert got == want and {w[0] for w in want} == {"unique", "ambiguous", "none"}


def test_overlaps_of_long_mates_and_lacking_ones(spark):
    """Sums beyond 255 matches, mates of different lengths in a batch, nulls, and rows that aren't asked."""
    insert = dna_of(21, 400)
    rows = [(0, insert[:300], back(insert)[:300], True), (1, insert[:300], back(insert)[:300], False), (2, insert[:300], back(insert)[:300], None), (3, None, back(insert)[:40], True), (4, "", "", True), (5, insert[:300], back(insert[:290]), True), (6, insert[:40], back(insert[5:45]), True)]
    df = spark.createDataFrame(rows, "i int, a string, b string, asked boolean").coalesce(1)
    got = overlaps(df, seqs=("a", "b"), where="asked").where("overlap_status <> 'ambiguous'").orderBy("i").collect()
    assert [(x.i, x.overlap_status, x.insert_length, x.overlap_length, x.overlap_mismatches) for x in got] == [(0, "unique", 400, 200, 0), *((i, "none", 0, 0, 0) for i in (1, 2, 3, 4)), (5, "unique", 290, 290, 0), (6, "unique", 45, 35, 0)]
    assert all(x.gap_end1 is None and x.asked == r[3] for x, r in zip(got, rows))


def test_long_pairs_among_short_ones_have_their_overlaps():
    import numpy as np

    from seqloom.operators import overlap as O

    codes = lambda s: O._CODE[np.frombuffer(s.encode(), np.uint8)]
    one = [codes(dna_of(i, 50 if i != 40 else 1200)) for i in range(80)]
    two = [codes(dna_of(i, 60 if i != 40 else 1500))[(20 if i != 40 else 900) :] for i in range(80)]
    alone = [O.find_overlaps([a], [b], 30, 5, 20)[0] for a, b in zip(one, two)]
    assert O.find_overlaps(one, two, 30, 5, 20) == alone
    assert alone[40] == ("unique", 1500, 300, 0) and alone[0] == ("unique", 60, 30, 0)


def test_only_bases_go_to_python_for_overlaps(spark):
    df = spark.createDataFrame([(0, "ACGT", "ACGT", "name")], "i int, seq1 string, seq2 string, id1 string").selectExpr("*", "concat('made-', id1) as other")
    plan = overlaps(df).where("overlap_status = 'none'").select("i", "insert_length")._jdf.queryExecution().executedPlan().toString()
    assert "made-" not in plan and plan.count("ArrowEvalPython") == 1


def test_gap_overlap_knows_fronts(spark):
    insert = dna_of(11, 60)
    other = back(insert[:30] + insert[31:])
    df = rows_of(spark, [(insert + "AGATCGGAAG", other + "AGATCGGAAG")])
    for front in ((0, 0), (3, 5)):
        row = fragments(df, Spec(gap_overlap=True, overlap_limit=0, trim_front=front)).first()
        assert row.overlap_status == "none" and row.seq1 == insert[front[0] :] and row.seq2 == other[front[1] :]


def test_single_reads_get_their_samples_signature(spark, tmp_path):
    codes = (("A", "A1", "ACGTTGCAGA"), ("A", "A2", "TTGACCGATC"), ("B", "B1", "GATTCAGCAT"))
    sheet = ({"Sample": "x", "A": "A1", "B": "B1"}, {"Sample": "y", "A": "A2", "B": "B1"})
    spec = Spec(layout=Layout.parse("R1_10A10B"), barcodes=codes, sheet=sheet, infer_adapters=True, write_failed=True, filters=FilterOptions(min_length=10))
    reads = []
    for i, a in enumerate(("ACGTTGCAGA", "TTGACCGATC")):
        prefix, insert = a + "GATTCAGCAT", dna_of(20 + i, 30 if i else 2)
        seq = prefix + insert + back(prefix)
        reads.append((i, f"n{i}", seq, "I" * len(seq)))
    df = spark.createDataFrame(reads, "read_idx long, id1 string, seq1 string, qual1 string")
    got = {r.sample: (r.seq1, r.dimer1, r.adapter1) for r in fragments(df, spec).collect()}
    assert got == {"x": (dna_of(20, 2), True, "full"), "y": (dna_of(21, 30), False, "full")}
    row = demux(df, spec, str(tmp_path / "o"))
    assert (row.first().dimers_r1, row.first().full_adapters_r1, row.first().too_short) == (1, 2, 1)
    assert [r.id for r in read_fastq(spark, str(tmp_path / "o/failed/stream=failed/mate=1")).collect()] == ["n0"]
    made = {p.name for p in (tmp_path / "o").iterdir()}
    assert {"reads", "failed", "summary", "preprocessing", "fastq_stats", "retained_fastq_stats", "barcode_stats", "sample_metrics", "report_html"} <= made


def test_pairs_come_out_as_one_by_one():
    """Correction and merging of all rows at once against a base at a time."""
    import numpy as np
    import pyarrow as pa

    from seqloom.operators import overlap as O

    r = np.random.default_rng(5)
    for front in ((0, 0), (3, 5)):
        rows, want = [], []
        for k in range(200):
            insert, n, m = int(r.integers(30, 70)), int(r.integers(20, 60)), int(r.integers(20, 60))
            own = [bytearray(r.choice(list(b"ACGTN"), s).tolist()) for s in (n, m)]
            for i in range(max(0, insert - m), min(n, insert)):  # mostly agreeing
                if r.random() < 0.8:
                    own[1][insert - 1 - i] = ord(back(chr(own[0][i])))
            quals = [bytearray(r.choice(list(b"#/?I"), s).tolist()) for s in (n, m)]
            rows.append((*map(bytes, (own[0], quals[0], own[1], quals[1])), insert))
            fixed = 0
            for i in range(max(0, insert - m), min(n, insert)):
                j = insert - 1 - i
                x, y = chr(own[0][i]), back(chr(own[1][j]))
                if x == y and x in "ACGT":
                    continue
                if quals[0][i] >= 63 and quals[1][j] <= 47:
                    own[1][j], quals[1][j], fixed = ord(back(x)), quals[0][i], fixed + 1
                elif quals[1][j] >= 63 and quals[0][i] <= 47:
                    own[0][i], quals[0][i], fixed = ord(y), quals[1][j], fixed + 1
            left = min(front[0], max(0, m - insert))
            n1, m1 = min(n, insert + front[1]), min(m, insert + front[0])
            seq = qual = ""
            for at in range(left + max(insert, n1)):
                i, j = at - left, insert + left - at - 1
                one = (chr(own[0][i]), chr(quals[0][i])) if 0 <= i < n1 else None
                two = (back(chr(own[1][j])), chr(quals[1][j])) if 0 <= j < m1 else None
                c, q = two if two and (not one or two[1] > one[1]) else one or ("\0", "\0")
                seq, qual = seq + c, qual + q
            want.append((fixed, seq, qual))
        (s1, n), (q1, _), (s2, m), (q2, _) = (O._rows(pa.array([x[i].decode() for x in rows])) for i in range(4))
        insert = np.array([x[4] for x in rows])
        fixed = O._correct(s1, q1, s2, q2, n, m, insert)
        seq, qual, size = O._merge(s1, q1, s2, q2, n, m, insert, [np.full(len(n), f) for f in front])
        assert list(zip(fixed.tolist(), O._texts(seq, size), O._texts(qual, size))) == want and sum(fixed) > 100
