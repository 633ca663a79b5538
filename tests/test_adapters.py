"""Many adapters by one automaton, and Shift-And ends, against one adapter at a time."""

from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators.adapters import Adapter, distal, sample_adapters
from seqloom.operators.automaton import AdapterSet
from seqloom.operators.filters import FilterOptions
from seqloom.plans.layout import Layout, Structure
from seqloom.plans.pipeline import Spec, detected, fragments

R = np.random.default_rng(11)


def bases(n, letters="ACGT"):
    return "".join(R.choice(list(letters), n))


@lru_cache(None)
def parts(a):
    return a.anchor, a._heads()


def plain_full(a, read):
    """Where an adapter begins whole, by its own rules."""
    if parts(a)[0] is None or read is None:
        return None
    at, word = parts(a)[0]
    if word not in read:
        return None
    for s in range(len(read) - len(a.expected) + 1):
        part = read[s : s + len(a.expected)]
        known = [(p, e) for p, e in zip(part, a.expected) if e != "N"]
        if part[at : at + len(word)] == word and all(p in "ACGT" for p, _ in known) and sum(p != e for p, e in known) <= a.mismatches:
            return s
    return None


def plain_partial(a, read):
    best = (0, None)
    for n, k in parts(a)[1]:
        if read is not None and len(read) >= n and all(e in (p, "N") for p, e in zip(read[len(read) - n :], a.expected)) and k > best[0]:
            best = (k, len(read) - n)
    return best


def test_500_adapters_equal_one_by_one(spark, tmp_path):
    texts = [bases(34) for _ in range(480)] + [bases(8) + "NNNN" + bases(22) for _ in range(20)]
    adapters = [Adapter(t, min_partial=20) for t in texts]
    both = AdapterSet(tuple(adapters))
    reads = []
    for i, t in enumerate(texts):
        own = t.replace("N", "A")
        spoiled = own[:1] + ("C" if own[1] != "C" else "G") + own[2:]
        reads += [bases(i % 30) + (own, spoiled, own[:25], own[:3] + "N" + own[4:])[i % 4] + ("" if i % 4 == 2 else bases(i % 9))]
    reads += [None, "", "ACGT", reads[0].lower(), texts[5] + texts[3]]
    df = spark.createDataFrame(list(enumerate(reads)), "i int, s string").repartition(4)
    seq = F.col("s")
    got = {r.i: r for r in df.select("i", both.found(seq).alias("x"), both.full_at(seq, F.lit(3)).alias("at"), both.partial_at(seq, F.length("s") - 25).alias("end")).collect()}
    for i, read in enumerate(reads):
        up = read and read.upper()
        each = [plain_full(a, up) for a in adapters]
        first = min(((s, j) for j, s in enumerate(each) if s is not None), default=(None, None))
        known, start = max((plain_partial(a, up) for a in adapters), key=lambda x: (x[0], x[1] or 0))
        x = got[i].x
        assert ((x.start, x.adapter), (x.known or 0, x.partial)) == (first, (known, start))
        assert got[i].at == any(parts(a)[0] and up is not None and len(up) >= 37 and plain_full(a, up[3:]) == 0 for a in adapters)
        assert got[i].end == (up is not None and len(up) >= 25 and any(25 in dict(parts(a)[1]) and all(e in (p, "N") for p, e in zip(up[-25:], a.expected)) for a in adapters))
    assert sum(r.x.start is not None for r in got.values()) > 200


def test_plan_does_not_grow_with_adapters_and_spec_takes_a_file(spark, tmp_path):
    texts = [bases(33) for _ in range(300)]
    (tmp_path / "a.fa").write_text("".join(f">a{i}\n{t[:20]}\n{t[20:]}\n" for i, t in enumerate(texts)))
    reads = spark.createDataFrame([(i, f"r{i}", bases(30) + t + "ACG", "I" * 66) for i, t in enumerate(texts)], "read_idx long, id1 string, seq1 string, qual1 string")
    table = fragments(reads, Spec(adapter_fasta={1: str(tmp_path / "a.fa")}))
    rows = table.select("read_idx", "adapter1", "seq1").collect()
    assert {(r.adapter1, len(r.seq1)) for r in rows} == {("full", 30)}
    few = AdapterSet(tuple(map(Adapter, texts[:10])))
    size = lambda s: len(reads.select(s.full(F.col("seq1")))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(few) - size(AdapterSet(tuple(map(Adapter, texts))))) < 50
    with pytest.raises(ValueError, match="without an anchor"):
        AdapterSet((Adapter("ACGTACGTAC"),))


def test_shift_and_over_long_adapters(spark):
    """Starts of up to 150 bases take three words of state; N in an adapter fits anything."""
    for text in (bases(33), "NNNN" + bases(12) + "NN" + bases(15), bases(150)):
        a = Adapter(text, min_partial=10)
        reads = [bases(int(R.integers(0, 40))) + text[:n].replace("N", "T") for n in range(1, len(text) + 1)] + [None, "", "N" * 60]
        df = spark.createDataFrame(list(enumerate(reads)), "i int, s string").repartition(4)
        got = {r.i: (r.p, r.at) for r in df.select("i", a.partial(F.col("s")).alias("p"), a.partial_at(F.col("s"), F.length("s") - 20).alias("at")).collect()}
        for i, read in enumerate(reads):
            assert got[i][0] == plain_partial(a, read)[1]
            assert got[i][1] == (read is not None and len(read) >= 20 and 20 in dict(a._heads()) and all(e in (p, "N") for p, e in zip(read[-20:], text)))


READ = "read_idx long, id1 string, seq1 string, qual1 string"


def test_adapters_are_detected_and_poly_g_found_out(spark):
    adapter = "AGATCGGAAGAGCACACGTCTGAACTCCAG"
    rows = [(i, f"{'VH' if i == 0 else 'r'}{i}", bases(30 + i % 9) + adapter + bases(3), "I" * (63 + i % 9)) for i in range(120)]
    reads = spark.createDataFrame(rows, READ).repartition(3)
    got = fragments(reads, Spec(detect_adapters=True)).collect()
    assert {(r.adapter1, len(r.seq1) - r.read_idx % 9) for r in got} == {("full", 30)}
    spec = detected(reads, Spec(auto_poly_g=True))
    assert spec.poly_g == 10 and not spec.auto_poly_g and detected(reads.where("read_idx > 0"), Spec(auto_poly_g=True)).poly_g == 0
    plain = spark.createDataFrame([(i, f"r{i}", bases(60), "I" * 60) for i in range(60)], READ)
    assert detected(plain, Spec(detect_adapters=True)).adapters == {} and detected(plain.limit(0), Spec(auto_poly_g=True, detect_adapters=True)) == Spec()
    for bad in ({"detect_adapters": True, "infer_adapters": True}, {"auto_poly_g": True, "poly_g": 5}, {"distal": {1: "R1_4A"}}):
        with pytest.raises(ValueError):
            Spec(**bad)


def test_a_distal_structure_replaces_the_mirrored_one(spark):
    layout = Layout.parse("R1_22A")
    codes = {"x": "ACGTTGCATCAGGATTCACCGT", "y": "TGCAACGTAGTCCTAAGTGGCA"}
    sheet, far = ({"Sample": "sx", "A": "x"}, {"Sample": "sy", "A": "y"}), "R1_6T22A"
    rows = [(i, f"r{i}", codes[k] + bases(20) + bases(6) + codes[k] + "AC", "I" * 72) for i, k in enumerate("xyxy")]
    reads = spark.createDataFrame(rows, READ)
    spec = Spec(layout=layout, barcodes=tuple(("A", i, s) for i, s in codes.items()), sheet=sheet, infer_adapters=True, distal={1: far})
    assert distal(Structure.parse(far), {"A": codes["x"]}) == "N" * 6 + codes["x"]
    known = sample_adapters(layout, list(spec.barcodes), list(sheet), False, distals={1: Structure.parse(far)})
    assert [(r[0], r[2]) for r in known] == [("sx", "N" * 6 + codes["x"]), ("sy", "N" * 6 + codes["y"])]
    assert [(r.adapter1, len(r.seq1)) for r in fragments(reads, spec).collect()] == [("full", 20)] * 4
    with pytest.raises(ValueError, match="unknown barcodes"):
        Spec(layout=layout, barcodes=spec.barcodes, sheet=sheet, infer_adapters=True, distal={1: "R1_4B"})


def test_filter_kinds_go_off():
    o = FilterOptions.defaults_profile(length_limit=90, min_average_quality=20.0)
    assert o.without("quality").max_low_quality_percent is None and o.without("quality").min_average_quality is None and o.without("quality").max_n == 5
    assert (o.without("length").min_length, o.without("length").length_limit, o.without("n").max_n) == (0, None, None)


def test_the_longest_end_is_found_behind_others(spark):
    """The adapter's start may stand in a read before the place from which the read's end equals it."""
    a = Adapter("AGATCGGAAGAGCACACGTC", min_partial=10)
    e = a.expected
    reads = ["TT" + e[:10], "TT" + e[:19], "TT" + e, e[:10] + "CC" + e[:12], e[:12] + e[:11], e[:10] + "T", e[:9], ("gg" + e[:13]).lower(), "", None, e[:10] + "\n", e[:10] + "N"]
    want = [(10, 2), (19, 2), None, (12, 12), (11, 12), None, None, (13, 2), None, None, None, None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(reads)], "i int, r string").select("i", a.evidence(F.col("r")).alias("x")).orderBy("i").collect()
    assert [x.x and (x.x.known, x.x.start) for x in got] == want
    odd = Adapter("AGATCGGAAGRGCACACGTC", min_partial=10)  # R is not a known base: of two ends with as many, the later
    got = spark.createDataFrame([("TT" + odd.expected[:11],), ("TT" + odd.expected[:12],)], "r string").select(odd.evidence(F.col("r")).alias("x")).collect()
    assert [(x.x.known, x.x.start) for x in got] == [(10, 2), (11, 2)]
    for size in (266, 300):  # the most that one pattern holds, and more
        long = Adapter("ACGTTGCAGATTACAGGCAT" + bases(size - 20), min_partial=10)
        got = spark.createDataFrame([("TT" + long.expected[: size - 1],), ("TT" + long.expected,)], "r string").select(long.evidence(F.col("r"))["known"].alias("x")).collect()
        assert got[0].x == size - 1 and got[1].x is None
