"""Lookups within a Hamming distance against a comparison of everything with everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import filters, routing
from seqloom.operators.near import close_pairs, near_join


def codes(r, n, size):
    return r.integers(0, 4, (n, size)).astype(np.uint8)


def text(rows):
    return ["".join(x) for x in np.array(list("ACGTN"))[rows]]


@pytest.mark.parametrize("k", [0, 1, 2])
def test_nearest_of_many_barcodes(spark, k):
    r = np.random.default_rng(k)
    known = codes(r, 20_000, 12)
    seen = known[r.integers(0, len(known), 600)].copy()
    for row in seen:
        for p in r.choice(12, r.integers(0, 4), replace=False):
            row[p] = r.integers(0, 5)
    d = (seen[:, None, :] != known[None]).sum(2)
    names, observed = text(known), text(seen)
    uniq = sorted(set(names))
    dim = spark.createDataFrame([("p", s, f"id{s}") for s in uniq], "p string, o string, i string")
    df = spark.createDataFrame([(n, "p", s) for n, s in enumerate(observed)] + [(1000, "other", observed[0]), (1001, "p", None), (1002, "p", "ACG"), (1003, None, names[0])], "n int, p string, s string")
    out = near_join(df, dim, ["p"], "s", "o", k)
    assert "NestedLoop" not in out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) and out.count() == df.count()
    got = {x.n: (x.i, x["_distance"]) for x in out.collect()}
    for n in range(len(seen)):
        least = int(d[n].min())
        want = (f"id{min(names[j] for j in np.flatnonzero(d[n] == least))}", least) if least <= k else (None, None)
        assert got[n] == want
    assert all(got[n] == (None, None) for n in range(1000, 1004))


def test_close_pairs_and_safety(spark):
    r = np.random.default_rng(9)
    known = codes(r, 3000, 14)
    known[7] = known[5]
    known[7, 3] = (known[5, 3] + 1) % 4
    names = text(known)
    pairs = close_pairs(spark.createDataFrame([("p", f"{i:05}", s) for i, s in enumerate(names)], "parent string, id string, seq string"), ["parent"], 3)
    d = (known[:, None, :] != known[None]).sum(2)
    want = {(f"{i:05}", f"{j:05}", int(d[i, j])) for i, j in zip(*np.where(d <= 3)) if i < j}
    assert {(x.id1, x.id2, x.distance) for x in pairs.collect()} == want and want
    rows = [("p", f"{i:05}", s) for i, s in enumerate(names)]
    with pytest.raises(ValueError, match="differ in"):
        routing.check_all(spark, rows, 1)
    routing.check_all(spark, [("p", "a", "AAAA"), ("q", "b", "AAAA"), ("p", "c", "TTTT")], 1)
    with pytest.raises(ValueError, match="under p"):
        routing.check_all(spark, [("p", "a", "AAAA"), ("p", "c", "AATT")], 1)


def test_long_blacklists_are_joined(spark):
    r = np.random.default_rng(2)
    entries = sorted(set(text(codes(r, 60, 8)))) + ["ACGTAC"]
    df = spark.createDataFrame([(i, f"r{i} 1:N:0:{e.lower()}+{e[::-1]}") for i, e in enumerate(text(codes(r, 400, 8)) + entries)] + [(9999, "r 1:N:0:ACGTAG+A"), (10000, "no index")], "read_idx long, id1 string")
    for second in (False, True):
        many = filters.blacklisted(df, entries, 1, second)
        few = [filters.blacklisted(df, entries[i : i + 8], 1, second).where("is_blacklisted") for i in range(0, len(entries), 8)]
        assert {x.read_idx for x in many.where("is_blacklisted").collect()} == {x.read_idx for f in few for x in f.collect()} and many.count() == df.count()
    both = filters.blacklisted(filters.blacklisted(df, entries[:1]), entries, 0)
    assert both.where("is_blacklisted").count() == len(entries)
