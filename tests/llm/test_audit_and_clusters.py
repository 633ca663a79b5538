"""Fingerprints, the filter audit and centroid clustering against brute force and SQL, and on odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import centroids as C
from seqloom.llm import filter_audit as A
from seqloom.llm import fingerprint as P
from seqloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
CLASH = ["text2", "part", "n", "A", "E", "good", "digest", "first", "sketch", "_at", "place", "guest", "next_text", "cluster", "lower", "v"]


def same(spark, name, tables):
    """Whether a registered query equals its SQL."""
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = Q.queries()[name](spark, SF).toPandas(), duck.execute(Q.oracle_sql()[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(str, df[columns].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
    return len(got)


def test_near_dedup_query_equals_sql(spark):
    assert same(spark, "op3_near_dedup", ["documents"]) == 200


# fingerprints


def h64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def naive_sketch(text, k=P.K, size=P.TUPLE, bits=P.BIN_BITS):
    def of(values, seed=42):
        for v in values:
            seed = h64(v, seed)
        return seed

    low = (1 << P.POS_BITS) - 1
    tokens = [t.encode() for t in re.findall("[^ \t-\r]{1,16}", text or "")]
    runs = [tokens[i : i + k] for i in range(len(tokens) - k + 1)] or ([tokens] if tokens else [])
    seen, bins = Counter(), defaultdict(list)
    for place, run in enumerate(runs):
        kmer = of(run) & ~low
        occurrence, seen[kmer] = seen[kmer], seen[kmer] + 1
        element = of([kmer.to_bytes(8, "little"), occurrence.to_bytes(4, "little")])
        packed = signed((element & ~low) | place)
        bins[(packed >> (64 - bits)) + (1 << (bits - 1))].append(packed)
    out = []
    for b in sorted(bins):
        first = sorted(bins[b])[:size]
        ordered = sorted((x & low, (x & (2**64 - 1)) >> 24) for x in first)
        out.append(b << 32 | of([e.to_bytes(8, "little") for _, e in ordered]) & 0xFFFFFFFF)
    return out


def naive_likeness(a, b):
    bins = {x >> 32 for x in a} | {x >> 32 for x in b}
    return len(set(a) & set(b)) / len(bins) if bins else 1.0


def naive_fingerprints(rows):
    """rows: (doc_id, text) -> what the query gives, by brute force."""
    tie = lambda t: signed(h64(t.encode()))
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = map(naive_sketch, (t, edited, after))
        text = lambda s: "".join(f"{x:010x}" for x in s)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), naive_likeness(a, b), naive_likeness(a, c)))
    return sorted(out, key=str)


def test_fingerprint_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in Q.op11_fingerprint(spark, SF).collect()), key=str)
    assert got == naive_fingerprints(docs)
    assert np.mean([r[5] for r in got]) > np.mean([r[6] for r in got]) + 0.05


def test_fingerprints_on_odd_tables(spark):
    said = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, said), (1, said), (1, "other"), (None, None), (None, "é" * 50_000), (3, ""), (4, " \n\t "), (7, "a b"), (7, None), (9, said * 3), (2, "x" * 300_000), (5, "same line here again\n" * 20_000)]
    rows += [(8, f"hot {i}") for i in range(60)]  # an id with most rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(3)
    got = sorted((tuple(r) for r in P.edited_fingerprints(docs).collect()), key=str)
    assert got == naive_fingerprints(rows)
    assert P.edited_fingerprints(docs.limit(0)).count() == 0
    alone = P.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert (alone.edited_sha256, alone.near_next) == (hashlib.sha256(b"abab").hexdigest(), 1.0)
    assert {r.n_chars for r in P.fingerprints(docs).where("doc_id is null").collect()} == {0, 50_000}


def test_fingerprints_follow_edit_distance(spark):
    r = np.random.default_rng(5)
    base = [f"w{x}" for x in r.integers(0, 5000, 2000)]
    kept = []
    for changed in (0, 20, 100, 400):
        text = list(base)
        for i in r.choice(len(text), changed, replace=False):
            text[i] = "new"
        kept.append(text)
    moved = base[1000:] + base[:1000]  # the same k-mers in another order
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*kept, moved])], "doc_id long, text string")
    sketches = {r.doc_id: r.sketch for r in P.with_sketch(df, "text", "sketch").collect()}
    near = [naive_likeness(sketches[0], sketches[i]) for i in range(5)]
    assert near[0] == 1 and near[1] > near[2] > near[3] and near[4] < 0.8


# filter audit


def test_audit_query_equals_sql(spark):
    assert same(spark, "op12_filter_audit", ["documents", "labels"]) % 600 == 0


def test_audit_on_odd_tables(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (None, long, None), (None, None, ""), (3, "", "de"), (4, "AB $", "de"), (5, "a a a", None), (6, "same", "en"), (7, "same", "fr")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (4, None, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    flags = {}
    for i, t, lang in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        upper = len(re.findall("[A-Z]", t or ""))
        first = min((j for j, u, _ in rows if (u or "") == (t or "") and j is not None), default=None)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * upper > 3 * len(t or ""), "D": bool(re.search("[#$%&*|]", t or "")), "E": i is not None and first < i}
        good, toxic = (any(r[0] == i and i is not None and r[j] == 1 for r in labels) for j in (1, 2))
        flags.setdefault(lang or "", []).append((bad, good, toxic))
    got = A.audit_text_filters(docs, said).collect()
    assert len(got) == 600 * len(flags)
    shapley = Counter()
    for r in got:
        shapley[r.part, r.filter_order[r.step - 1]] += r.removed
    for r in got:
        f, before = r.filter_order[r.step - 1], r.filter_order[: r.step - 1]
        there = [x for x in flags[r.part] if not any(x[0][b] for b in before)]
        gone = [x for x in there if x[0][f]]
        failing = [x for x in flags[r.part] if x[0][f]]
        alone = sum(1 for x in failing if sum(x[0].values()) == 1)
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == (len(there) - len(gone), len(gone), len(failing) - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone), shapley[r.part, f])
    assert A.audit_text_filters(docs.limit(0), said).count() == 0 and A.audit_text_filters(docs, said.limit(0)).count() == len(got)


def test_bitmap_index_blocks(spark):
    """Bits of any filters, over several blocks and more parts than one task keeps."""
    n = 150_000
    df = spark.range(n).select(F.concat(F.lit("p"), F.col("id") % 400).alias("p"), (F.col("id") % 2 == 0).alias("X"), (F.col("id") % 3 == 0).alias("Y"), (F.col("id") % 5 == 0).alias("label")).repartition(2)
    index = A.bitmap_index(df, "p", ["X", "Y", "label"])
    assert index.agg(F.sum("n")).first()[0] == n and index.count() > 800
    counts = A.subset_counts(index, ["X", "Y"], ["label"]).where("part = 'p7'")
    got = {(r.passed, r.filter): (r.n, r.alive, r.removed, r.removed_label, r.fails) for r in counts.collect()}
    own = [i for i in range(n) if i % 400 == 7]
    y = [i for i in own if i % 3 == 0]
    assert got[1, 1] == (375, 375, len(y), sum(i % 5 == 0 for i in y), len(y)) and got[2, 0] == (375, 375 - len(y), 0, 0, 0)
    with pytest.raises(ValueError):
        A.audit(index, list("ABCDEFG"), [])


# clusters


def test_clusters_query_equals_sql(spark):
    assert same(spark, "op13_centroids", ["embeddings"]) > 0


def naive_clusters(rows, k, rounds, dim=4):
    """rows: (id, vector) with usable ones only."""
    v = [(i, [int(np.floor(64 * float(c))) for c in x]) for i, x in rows]
    cents = [x for _, x in sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in v:
            own[nearest(x)[1]].append(x)
        cents = [[sum(c) // len(own[j]) for c in zip(*own[j])] if own[j] else c for j, c in enumerate(cents)]
    return sorted(((i, nearest(x)[1], nearest(x)[0], hashlib.sha256(",".join(map(str, cents[nearest(x)[1]])).encode()).hexdigest()) for i, x in v), key=str)


def test_clusters_on_odd_tables(spark):
    r = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    good = [(int(i), [float(c) / 64 for c in r.integers(-3, 4, 4)]) for i in range(300)]  # a grid: many ties
    good += [(7, good[7][1]), (7, [9.0, 9.0, 9.0, 9.0]), (None, [0.5] * 4)] + [(1000 + i, [0.25] * 4) for i in range(200)]
    bad = [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0, None, 1.0, 1.0]), (504, [nan] * 4), (505, [1.0, inf, 0.0, 0.0]), (506, [0.0, -inf, 0.0, 0.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(good + bad, f"vec_id long, embedding array<{kind}>").select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(3)
        got = C.cluster(df, k=16, dim=4).collect()
        assert sorted(((x.vec_id, x.cluster, x.distance, x.centroid_sha256) for x in got), key=str) == naive_clusters(good, 16, 3)
        sums = Counter()
        for x in got:
            sums[x.cluster] += x.distance
        assert all(x.cluster_inertia == sums[x.cluster] and x.inertia == sum(sums.values()) for x in got)
    assert C.cluster(df.limit(0), dim=4).count() == 0 and C.cluster(df.where("vec_id in (500, 504)"), dim=4).count() == 0
    few = C.cluster(df.where("vec_id in (1, 2)"), dim=4).collect()
    assert len(few) == 2 and {x.distance for x in few} == {0}
    with pytest.raises(Exception, match="too large"):
        C.cluster(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>"), dim=4)


def test_exponion_skips_and_is_exact():
    """Bounds carried over moves leave out most distances, and change nothing."""
    r = np.random.default_rng(0)
    means = r.integers(-400, 400, (40, 8))
    x = (means[r.integers(0, 40, 6000)] + r.integers(-20, 20, (6000, 8))).astype(np.int64)
    c = x[:40].copy()
    cluster, lower, taken = np.zeros(len(x), np.int64), np.zeros(len(x)), []
    for _ in range(6):
        cluster, distance, lower, n = C._Rings(c).search(x, cluster, lower)
        taken.append(n)
        every = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
        new = np.array([x[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(len(c))])
        moved, c = np.sqrt(((new - c) ** 2).sum(1).astype(float)), new
        top = np.sort(moved)[::-1]
        lower = np.maximum((lower - np.where(moved[cluster] == top[0], top[1], top[0]) * C.SLACK) / C.SLACK, 0)
    assert taken[-1] < 0.1 * len(x) * len(c)
