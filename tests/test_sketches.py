"""Summaries in bounded memory against exact counts."""

import re
from collections import Counter

import numpy as np
import pytest

from seqloom.operators import metrics, sketches


def zipf(spark, n, seed, parts):
    r = np.random.default_rng(seed)
    values = [f"v{min(x, 50_000)}" for x in r.zipf(1.3, n)]
    return values, spark.createDataFrame([(v,) for v in values] + [(None,)], "sequence string").repartition(parts)


@pytest.mark.parametrize("counters,parts", [(20, 1), (20, 7), (300, 4), (100_000, 3)])
def test_bounds_hold_every_count(spark, counters, parts):
    values, df = zipf(spark, 30_000, counters, parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = {r.item: (r.lower, r.upper) for r in sketches.heavy_hitters(df, "sequence", counters).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    exact = Counter(values)
    assert all(a <= exact[v] <= b for v, (a, b) in got.items())
    width = {b - a for a, b in got.values()}
    assert len(width) == 1 and width.pop() <= len(values) / (counters + 1)
    assert {v for v, n in exact.items() if n > len(values) / counters} <= set(got)
    if counters > len(exact):
        assert {v: a for v, (a, _) in got.items()} == exact


def test_frequent_values_are_exact(spark):
    values, df = zipf(spark, 20_000, 3, 5)
    got = {r.item: r.n for r in sketches.frequent(df, "sequence", 200, 200).collect()}
    assert got == {v: n for v, n in Counter(values).items() if n > 100}
    with pytest.raises(ValueError):
        sketches.frequent(df, "sequence", 300, 200)
    assert sketches.frequent(df.limit(0), "sequence", 10).count() == 0


def test_bounded_overrepresentation(spark):
    r = np.random.default_rng(1)
    reads = [(i, "".join(r.choice(list("ACGT"), 20)) + "ACGGTTCAGA" * (i % 3 == 0)) for i in range(600)]
    df = spark.createDataFrame(reads, "read_idx long, seq string")
    exact = {x.sequence: x.n for x in metrics.overrepresented(df).collect()}
    bounded = metrics.overrepresented(df, counters=100).collect()
    assert bounded[0].sequence == "ACGGTTCAGA" and bounded[0].n <= exact["ACGGTTCAGA"] <= bounded[0].upper
    wide = {x.sequence: x.n for x in metrics.overrepresented(df, counters=100_000).collect()}
    assert wide == exact


@pytest.mark.parametrize("distinct,bits", [(0, 16), (1, 16), (3000, 16), (9000, 16), (9000, 20)])
def test_distinct_estimates(spark, distinct, bits):
    df = spark.range(3 * distinct).selectExpr(f"concat('k', id % {max(1, distinct)}) AS s")
    one = sketches.distinct_estimate(df, "s", bits).first()
    assert one.rows == 3 * distinct and abs(one.distinct - distinct) <= 5 * one.standard_error + 1
    assert one.standard_error <= 0.02 * distinct + 1


def test_windows_are_dealt_by_their_number(spark):
    """With one shuffle partition, 1,368,000 windows go to two tasks, and counts are those of a plain Counter."""
    r = np.random.default_rng(2)
    reads = ["".join(x) for x in r.choice(list("ACGT"), (12_000, 60))]
    reads = [x[:30] + "ACGGTTCAGA" * 3 if i % 3 == 0 else x[:59] + "n" if i % 7 == 0 else x for i, x in enumerate(reads)]
    df = spark.createDataFrame(list(enumerate([*reads, None, "", "acgt"])), "read_idx long, seq string").repartition(4)
    widths = (10, 20, 40)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = metrics.overrepresented(df, widths, top=500, whole=True)
        got = [(x.sequence, x.n) for x in out.collect()]
        dealt = {int(n) for n in re.findall(r"hashpartitioning\(sequence#\d+, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    want = Counter(x[i : i + w].upper() for x in reads for w in widths for i in range(len(x) - w + 1)) + Counter(x.upper() for x in [*reads, "acgt"])
    want = sorted(((k, n) for k, n in want.items() if n > 1 and "N" not in k), key=lambda x: (-x[1], x[0]))[:500]
    assert got == want and dealt == {2}
