"""Mixing sources to target weights: pivotal dependent rounding through a reduction tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.shared import keep, only_kept, small

#: Rows that one step of the reduction tree folds, on average.
FAN_IN = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t-\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target for sizes (source, source_size), one row per source.

    Sources take the weights in turn, by code point, null last, and share `share` of all sizes;
    a target stops at `most` times its source's size and the excess goes to the others by
    weight.  In closed form: with sources sorted by where they stop, the first i stop, for the
    smallest i at which the rest's share per weight stays under the next one's.  The table of
    sources is a dimension (a row per source), so its sort is small.
    """
    if share > most:
        raise ValueError("the sources cannot hold that share")
    numbered = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("k") % len(weights) + 1).cast("int"))
    stops = numbered.withColumn("w", w).withColumn("stop", most * F.col("source_size")).withColumn("ratio", F.col("stop") / F.col("w"))
    by = Window.orderBy("ratio", "k")
    above, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = share * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("stop").over(above), F.lit(0.0))
    per = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(above), F.lit(0.0)))
    levels = stops.withColumn("per", per)
    level = F.min(F.when(F.col("per") <= F.col("ratio"), F.struct("ratio", "k", "per"))).over(everything)["per"]
    return levels.withColumn("level", level).select("source", "source_size", F.least("stop", F.coalesce(F.col("w") * F.col("level"), F.col("stop"))).alias("target"))


def _fold(rows: Column) -> Column:
    """Pivotal rounding along an array of (id, size, u, x): struct(done: array<(id, up)>, last).

    Two fractions x, y of texts with sizes a, b keep a * x + b * y: one moves up and the other down
    until either is 0 or 1, in the direction and with the chances that keep each one's mean.  The
    one that becomes whole is done; the other meets the next.  u is the row's own uniform number.
    """
    item = "struct<id:string,size:double,u:double,x:double>"
    start = F.struct(F.expr("cast(array() as array<struct<id:string,up:int>>)").alias("done"), F.lit(None).cast(item).alias("last"))

    def step(acc: Column, row: Column) -> Column:
        p, q = acc["last"], row
        a, b, x, y = p["size"], q["size"], p["x"], q["x"]
        up, down = F.least(a * (1 - x), b * y), F.least(a * x, b * (1 - y))  # words that can move to p, and from it
        rises = q["u"] * (up + down) < down
        x1 = F.when(rises, F.when(a * (1 - x) <= b * y, 1.0).otherwise(x + up / a)).otherwise(F.when(a * x <= b * (1 - y), 0.0).otherwise(x - down / a))
        y1 = F.when(rises, F.when(b * y <= a * (1 - x), 0.0).otherwise(y - up / b)).otherwise(F.when(b * (1 - y) <= a * x, 1.0).otherwise(y + down / b))
        whole = (x1 <= 0) | (x1 >= 1)

        def taken(r: Column, z: Column) -> Column:
            return F.array(F.struct(r["id"].alias("id"), (z >= 0.5).cast("int").alias("up")))

        def left(r: Column, z: Column) -> Column:
            return F.struct(r["id"].alias("id"), r["size"].alias("size"), r["u"].alias("u"), z.alias("x"))

        met = F.when(whole, F.struct(F.concat(acc["done"], taken(p, x1)).alias("done"), left(q, y1).alias("last"))).otherwise(
            F.struct(F.concat(acc["done"], taken(q, y1)).alias("done"), left(p, x1).alias("last"))
        )
        return F.when(p.isNull(), F.struct(acc["done"].alias("done"), left(q, y).alias("last"))).otherwise(met)

    return F.aggregate(rows, start, step)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs (doc_id, text, source).

    Every text of a source has target / source_size copies on average; the whole part is given and
    the fraction is rounded by the pivotal method within its source, so the source's taken words
    differ from its target by less than one text.  Rows fold in groups of about fan_in, dealt by
    a hash of doc_id within the source, so one source with most rows spreads over all tasks;
    each group hands one open fraction to the next level, and levels grow with the logarithm.
    Groups fold from long texts to short ones, so that what stays open tends to be short.

    Null text: size 0, nothing taken.  Null source: a source of its own, last.  Rows that repeat a
    doc_id share its source's rate and are told apart by size and a number within the doc_id.
    Texts of any length are counted whole.  Extra columns are ignored; an empty table gives no rows.  The same rows and seed give the
    same result in any order of partitions.
    """
    with only_kept(docs.sparkSession) as stay:
        return stay(_mix(docs, weights, share, most, seed, fan_in))


def _mix(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int, fan_in: int) -> DataFrame:
    base = keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h")))
    by_source = small(keep(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).select("source", "source_size"), weights, share, most)))
    near = F.col("source").eqNullSafe(F.col("s"))
    one = Window.partitionBy("doc_id", "h", "size").orderBy("source")
    rated = base.join(by_source.withColumnRenamed("source", "s"), near).drop("s")
    rated = rated.withColumn("rate", F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("x", F.col("rate") - F.col("whole"))
    return _rounded(rated, one, seed, fan_in)


def _rounded(rated: DataFrame, one: Window, seed: int, fan_in: int) -> DataFrame:
    named = rated.withColumn("id", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("h").cast("string"), F.row_number().over(one).cast("string")))
    named = keep(named)
    open_ = named.where("x > 0 and size > 0").select("source", "id", F.col("size").cast("double").alias("size"), "x")
    most = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    level, done = 0, []
    while most:
        groups = -(-most // fan_in)
        u = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(level)), F.lit(1 << 30)) + 0.5) / (1 << 30)
        put = F.pmod(F.xxhash64("id", F.lit(seed + 1), F.lit(level)), F.lit(groups))
        row = F.struct((-F.col("size")).alias("big"), F.xxhash64("id", F.lit(level)).alias("at"), "id", "size", u.alias("u"), "x")
        rows = F.transform(F.sort_array(F.collect_list(row)), lambda r: F.struct(r["id"].alias("id"), r["size"].alias("size"), r["u"].alias("u"), r["x"].alias("x")))
        folded = keep(open_.groupBy("source", put.alias("g")).agg(rows.alias("rows")).select("source", _fold(F.col("rows")).alias("f")).select("source", "f.done", "f.last"))
        done.append(folded.select(F.explode("done").alias("d")).select("d.id", "d.up"))
        open_ = folded.select("source", "last.id", "last.size", "last.x")
        if groups == 1:
            u = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(-1)), F.lit(1 << 30)) + 0.5) / (1 << 30)
            done.append(open_.select("id", (u < F.col("x")).cast("int").alias("up")))
            break
        most, level = groups, level + 1
    out = named
    if done:
        out = named.join(reduce(DataFrame.unionByName, done), "id", "left")
    else:
        out = named.withColumn("up", F.lit(None).cast("int"))
    copies = F.col("whole") + F.coalesce("up", F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies"), "source")
