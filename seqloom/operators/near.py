"""Lookups within a Hamming distance as equi-joins on pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.dna import hamming


def pieces(text: Column, k: int) -> Column:
    """array of (piece, part): text cut into k + 1 parts of about one length.  Texts of one length that differ in up
    to k places have an equal part in one of the places."""
    n = F.length(text)
    edge = lambda i: F.floor(n * i / (k + 1)).cast("int")
    return F.array(*(F.struct(F.lit(i).alias("piece"), F.substring(text, edge(i) + 1, edge(i + 1) - edge(i)).alias("part")) for i in range(k + 1)))


def _cut(df: DataFrame, text: str, k: int) -> DataFrame:
    return df.withColumn("_n", F.length(text)).withColumn("_x", F.explode(pieces(F.col(text), k))).select("*", "_x.piece", "_x.part").drop("_x")


def near_join(df: DataFrame, dim: DataFrame, on: list[str], observed: str, known: str, k: int) -> DataFrame:
    """df plus dim's other columns and _distance: the row of dim with equal `on` whose known text is nearest to the
    observed one, within k places and of the same length (ties: the smaller text); nulls where there is none.

    Both sides hold upper-case text.  Exact texts meet in one join.  Only the other texts, each once, are cut
    into k + 1 pieces, meet dim on a piece and its place, and are compared; a pair that shares several
    pieces is compared for its first.  dim's (on, known) must differ from each other."""
    more = [c for c in dim.columns if c not in (*on, known)]
    keys = [*on, observed]
    own = dim.withColumnRenamed(known, observed)
    exact = df.join(own.withColumn("_exact", F.lit(True)), keys, "left")
    if not k:
        return exact.withColumn("_distance", F.when(F.col("_exact"), 0)).drop("_exact")
    open_ = exact.where(F.col("_exact").isNull() & F.col(observed).isNotNull()).select(keys).distinct()
    cut = _cut(open_, observed, k)
    there = _cut(dim, known, k)
    met = cut.join(there, [*on, "_n", "piece", "part"])
    earlier = F.exists(F.arrays_zip(pieces(F.col(observed), k).alias("a"), pieces(F.col(known), k).alias("b")), lambda x: (x["a"]["piece"] < F.col("piece")) & (x["a"]["part"] == x["b"]["part"]))
    close = met.where(~earlier).withColumn("_d", hamming(F.col(observed), F.col(known))).where(F.col("_d") <= k)
    best = close.groupBy(keys).agg(F.min(F.struct("_d", known, *more)).alias("_best"))
    out = exact.join(best, keys, "left")
    took = [F.when(F.col("_exact"), F.col(c)).otherwise(F.col("_best")[c]).alias(c) for c in more]
    return out.select(*df.columns, *took, F.when(F.col("_exact"), 0).otherwise(F.col("_best._d")).alias("_distance"))


def close_pairs(barcodes: DataFrame, on: list[str], most: int) -> DataFrame:
    """(on, id1, id2, distance) of barcodes (on, id, seq) of one length that differ in up to `most` places, id1 < id2,
    found by a join on pieces."""
    cut = _cut(barcodes, "seq", most)
    other = cut.select(*on, "_n", "piece", "part", F.col("id").alias("id2"), F.col("seq").alias("seq2"))
    met = cut.join(other, [*on, "_n", "piece", "part"]).where("id < id2")
    distance = hamming(F.col("seq"), F.col("seq2"))
    return met.select(*on, F.col("id").alias("id1"), "id2", distance.alias("distance")).where(F.col("distance") <= most).distinct()
