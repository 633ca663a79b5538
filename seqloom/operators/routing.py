"""Routing: reads to samples by a chain of mismatch-tolerant barcode lookups."""

from __future__ import annotations

from itertools import combinations, product
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.near import close_pairs, near_join
from seqloom.plans.layout import Layout

#: Neighbourhoods of more rows than this are not spelled out: observed barcodes meet known ones on pieces.
MAX_NEIGHBOURS = 100_000
#: So many barcodes of one level are compared with each other on the driver; more are joined on pieces.
FEW_BARCODES = 500


def check_all(spark: SparkSession, rows: list[tuple[str, str, str]], k: int) -> None:
    """Barcodes (parent, id, seq) under one parent must differ in 2k + 1 places, or correction is ambiguous."""
    if len(rows) > FEW_BARCODES:
        close = close_pairs(spark.createDataFrame(rows, "parent string, id string, seq string"), ["parent"], 2 * k).orderBy("parent", "id1", "id2").first()
        if close:
            raise ValueError(f"barcodes {close['id1']} and {close['id2']} under {close['parent'] or 'the root'} differ in {close['distance']} places; {2 * k + 1} are needed")
        return
    under: dict[str, list[tuple[str, str]]] = {}
    for parent, i, seq in rows:
        under.setdefault(parent, []).append((i, seq))
    for parent, own in under.items():
        check_distances(own, k, parent or "the root")


def check_distances(barcodes: list[tuple[str, str]], k: int, where: str) -> None:
    """check_all for a few barcodes (id, seq) of one parent."""
    for (a, x), (b, y) in combinations(barcodes, 2):
        d = sum(p != q for p, q in zip(x, y))
        if d < 2 * k + 1:
            raise ValueError(f"barcodes {a} and {b} under {where} differ in {d} places; {2 * k + 1} are needed")


def neighbours(seq: str, k: int) -> dict[str, int]:
    """Every string over ACGTN within k places of seq, with its distance; an observed N counts 1."""
    out = {seq: 0}
    for d in range(1, k + 1):
        for places in combinations(range(len(seq)), d):
            for letters in product("ACGTN", repeat=d):
                if all(c != seq[p] for c, p in zip(letters, places)):
                    s = list(seq)
                    for c, p in zip(letters, places):
                        s[p] = c
                    out["".join(s)] = d
    return out


def neighbour_count(length: int, k: int) -> int:
    return sum(comb(length, d) * 4**d for d in range(k + 1))


def route(reads: DataFrame, layout: Layout, barcodes: list[tuple[str, str, str]], sheet: list[dict[str, str]], k: int = 1, max_neighbours: int = MAX_NEIGHBOURS) -> DataFrame:
    """reads plus is_short, status, sample and <symbol>_id, <symbol>_mm for each barcode symbol.

    reads has seq1 and, if paired, seq2.  barcodes: (set, id, seq); sheet: rows {"Sample": .., symbol:
    id}.  Levels go by symbol: the first is looked up among its whole set, each further one among
    the children of the one found.  A known first barcode that no sample uses is unrouted, anything
    else that is not found unmatched.  Each level is one broadcast lookup; the dimension is a
    whitelist with its neighbourhood, bounded by max_neighbours rows.
    """
    spark, symbols = reads.sparkSession, layout.symbols
    by_set: dict[str, dict[str, str]] = {}
    for s, i, seq in barcodes:
        by_set.setdefault(s, {})[i] = seq.upper()
    for row in sheet:
        for s in symbols:
            if row[s] not in by_set.get(s, {}):
                raise ValueError(f"sample {row['Sample']}: no barcode {row[s]} in set {s}")
    for s in symbols:
        for i, seq in by_set.get(s, {}).items():
            if len(seq) != layout.length(s):
                raise ValueError(f"barcode {i} of set {s} has {len(seq)} bases, the structure {layout.length(s)}")
    seqs = {m: F.col(f"seq{m}") for m in (1, 2) if f"seq{m}" in reads.columns}
    out = reads.withColumn("is_short", ~layout.long_enough(seqs)).withColumn("_path", F.lit(""))
    for level, s in enumerate(symbols):
        parents: dict[str, set[str]] = {}
        for row in sheet:
            parents.setdefault("/".join(row[x] for x in symbols[:level]), set()).add(row[s])
        if not level:
            parents = {"": set(by_set[s])}
        rows = []
        for parent, ids in parents.items():
            rows += [(parent, i, by_set[s][i]) for i in sorted(ids)]
        check_all(spark, rows, k)
        observed = F.when(~F.col("is_short") & F.col("_path").isNotNull(), layout.barcode(s, seqs))
        out = out.withColumn("_obs", observed)
        if len(rows) * neighbour_count(layout.length(s), k) <= max_neighbours:
            dim = spark.createDataFrame([(p, o, i, d) for p, i, seq in rows for o, d in neighbours(seq, k).items()], f"_p string, _o string, {s}_id string, {s}_mm int")
            out = out.join(F.broadcast(dim), (F.col("_path") == F.col("_p")) & (F.col("_obs") == F.col("_o")), "left").drop("_p", "_o")
        else:
            dim = spark.createDataFrame(rows, f"_path string, {s}_id string, _o string")
            valid = out.withColumn("_obs", F.when(F.col("_obs").rlike("^[ACGTN]+$"), F.col("_obs")))
            out = near_join(valid, dim, ["_path"], "_obs", "_o", k).withColumnRenamed("_distance", f"{s}_mm")
        out = out.withColumn("_path", F.when(F.col("_path") == "", F.col(f"{s}_id")).otherwise(F.concat("_path", F.lit("/"), F.col(f"{s}_id"))))
    names = spark.createDataFrame([("/".join(r[s] for s in symbols), r["Sample"]) for r in sheet], "_p string, sample string")
    out = out.join(F.broadcast(names), F.col("_path") == F.col("_p"), "left").drop("_p")
    used = sorted({row[symbols[0]] for row in sheet})
    first = F.col(f"{symbols[0]}_id")
    status = F.when(F.col("sample").isNotNull(), "assigned").when(first.isNotNull() & ~first.isin(used), "unrouted").otherwise("unmatched")
    return out.withColumn("status", status).drop("_path", "_obs")


def route_counts(routed: DataFrame) -> DataFrame:
    """Fragments and bases by status and sample."""
    return routed.groupBy("status", "sample").agg(F.count("*").alias("fragments"), F.sum(F.length("seq1")).alias("bases"), F.sum(F.col("is_short").cast("long")).alias("short_reads"))
