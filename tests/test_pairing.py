"""Pairing by position against a plain merge of two lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators.pairing import anchors, merged, numbered, pair, pair_in_order

READS = "read_idx long, id string, seq string, qual string"


def frame(spark, names):
    return spark.createDataFrame([(10 * i, f"{n}/1 x", f"A{i}", "II") for i, n in enumerate(names)], READS).repartition(3)


def plain(one, two, window=1024):
    """A merge with two queues, read on in turn."""
    a, b, qa, qb, out = list(one), list(two), [], [], []
    while True:
        if not qa and a:
            qa.append(a.pop(0))
        if not qb and b:
            qb.append(b.pop(0))
        if not qa or not qb:
            break
        while True:
            met = [(i + j, i, j) for i, x in enumerate(qa) for j, y in enumerate(qb) if x[1] == y[1]]
            if met:
                _, i, j = min(met)
                break
            i = None
            grown = False
            for q, rest, other in ((qa, a, qb), (qb, b, qa)):
                if rest and len(q) < window:
                    q.append(rest.pop(0))
                    grown = True
                    if q[-1][1] in [z[1] for z in other]:
                        break
            if not grown:
                if a or b:
                    raise ValueError("no common name")
                break
        if i is None:
            break
        out += [(x, None) for x in qa[:i]] + [(None, y) for y in qb[:j]] + [(qa[i], qb[j])]
        a, b = qa[i + 1 :] + a, qb[j + 1 :] + b
        qa, qb = [], []
    return out + [(x, None) for x in qa + a] + [(None, y) for y in qb + b]


def disordered(seed, n=600, dup=False):
    r = np.random.default_rng(seed)
    files = []
    for _ in range(2):
        names = [f"n{i}" for i in range(n) if r.random() > 0.1]
        for i in r.choice(len(names) - 30, 12, replace=False):
            j = i + int(r.integers(1, 25))
            names[i], names[j] = names[j], names[i]
        if dup:
            names[50] = names[300] = names[7]
        names[200:200] = [f"only{seed}_{len(files)}_{i}" for i in range(40)]
        files.append(names)
    return files


@pytest.mark.parametrize("seed,dup", [(1, False), (2, False), (3, True), (4, True)])
def test_merge_equals_two_queues(seed, dup):
    one, two = disordered(seed, dup=dup)
    left, right = merged(one, two, False)
    assert list(zip(left, right)) == [(x[0] if x else -1, y[0] if y else -1) for x, y in plain(enumerate(one), enumerate(two))]


@pytest.mark.parametrize("seed,dup,segment", [(5, False, 40), (6, True, 40), (7, False, 1 << 16)])
def test_segments_give_the_same_orphans(spark, seed, dup, segment):
    one, two = disordered(seed, dup=dup)
    got = pair_in_order(frame(spark, one), frame(spark, two), segment=segment).collect()
    want = plain(enumerate(one), enumerate(two))
    assert sorted((r.kind, r.seq1 or "", r.seq2 or "") for r in got) == sorted(("orphan_r2" if x is None else "orphan_r1" if y is None else "pair", f"A{x[0]}" if x else "", f"A{y[0]}" if y else "") for x, y in want)
    assert {r.read_idx for r in got} == {2 * x[0] if x else 2 * y[0] + 1 for x, y in want}


def test_ordered_files_pair_as_by_name(spark):
    one, two = [f"n{i}" for i in range(900) if i % 9 != 4], [f"n{i}" for i in range(900) if i % 7 != 2]
    a, b = frame(spark, one), frame(spark, two)
    cuts = anchors(*(numbered(x.withColumn("core", F.regexp_extract("id", "^(.*)/1", 1))).select("n", "core") for x in (a, b)), segment=100)
    assert cuts.count() >= 5
    rows = lambda df: sorted((r.kind, r.id1 or "", r.id2 or "", r.qual1 or "") for r in df.collect())
    assert rows(pair_in_order(a, b, segment=100)) == rows(pair(a, b))
    assert pair_in_order(a, b.limit(0)).groupBy("kind").count().collect()[0][:] == ("orphan_r1", len(one))
    assert pair_in_order(a.limit(0), b.limit(0)).count() == 0


def test_window_is_a_bound(spark):
    names = [f"n{i}" for i in range(50)]
    for extra in (9, 10):
        one = names[:20] + [f"x{i}" for i in range(extra)] + names[20:]
        df = pair_in_order(frame(spark, one), frame(spark, names), window=10, segment=10)
        if extra == 9:
            assert df.where("kind = 'orphan_r1'").count() == 9 and df.where("kind = 'pair'").count() == 50
        else:
            with pytest.raises(Exception, match="no common name within 10"):
                df.collect()
    with pytest.raises(ValueError):
        merged(["a", "b"], ["x"] * 5, False, 3)
    assert merged(["a"], ["a"] + ["x"] * 5, False, 3) == ([0] + [-1] * 5, [0, 1, 2, 3, 4, 5])


def test_no_frame_is_taken_anew_for_each_row(spark):
    """A frame up to the last row costs a pass over the rest of the partition for each row."""
    n = 4000
    a = spark.range(n).select(F.col("id").alias("n"), F.concat(F.lit("n"), F.col("id")).alias("core"))
    cuts = anchors(a, a, segment=100)
    assert "unboundedfollowing" not in cuts._jdf.queryExecution().toString().lower()
    assert [r[:] for r in cuts.orderBy("a").collect()] == [(i, i) for i in range(0, n, 100)]


def test_runs_of_every_length_merge():
    one = [f"n{i}" for i in range(20_000) if i % 9_001 != 5 and i not in range(40, 60)]
    two = [f"n{i}" for i in range(20_000) if i not in (3, 4, 30)]
    left, right = merged(one, two, False)
    assert [(one[i] if i >= 0 else None, two[j] if j >= 0 else None) for i, j in zip(left, right)] == [(n if n in set1 else None, n if n in set2 else None) for set1, set2 in [(set(one), set(two))] for n in (f"n{i}" for i in range(20_000)) if n in set1 or n in set2]
