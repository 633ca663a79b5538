"""Mergeable summaries in bounded memory: frequent items with bounds, and distinct items by bits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.sources.scratch import settled

#: Items that a summary holds.
COUNTERS = 4096


def _lessened(items: pa.Table, counters: int) -> tuple[pa.Table, int]:
    """At most `counters` of items (item, n): the next largest count is taken from all of them, and told."""
    if len(items) <= counters:
        return items, 0
    order = pc.sort_indices(items, [("n", "descending")])
    cut = items.column("n")[order[counters].as_py()].as_py()
    left = items.take(order.slice(0, counters))
    left = left.set_column(1, "n", pc.subtract(left.column("n"), cut))
    return left.filter(pc.greater(left.column("n"), 0)), cut


def heavy_hitters(items: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """item, lower, upper: bounds of how often each frequent value of a string column occurs.

    Each task keeps `counters` values (Misra-Gries with whole batches merged in), and what it took from
    all counters is its error; counts add up over tasks, and so do errors.  lower is never above
    the true count and upper never below, they differ by less than 1 / counters of all rows, and every value
    that is more frequent than that is there.  Nulls do not count."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, error = pa.table({"item": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), 0
        for batch in batches:
            seen = batch.column(0).drop_null().value_counts()
            own = pa.table({"item": seen.field("values"), "n": seen.field("counts")})
            met = pa.concat_tables([held, own]).group_by("item").aggregate([("n", "sum")]).rename_columns(["item", "n"])
            held, cut = _lessened(met, counters)
            error += cut
        yield pa.RecordBatch.from_arrays([pa.array([*held.column("item").to_pylist(), None], pa.string()), pa.array([*held.column("n").to_pylist(), error], pa.int64())], names=["item", "n"])

    told = settled(items.select(F.col(column).cast("string").alias("item")).mapInArrow(summary, "item string, n long"))
    error = told.where("item is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("e")).first()["e"]
    return told.where("item is not null").groupBy("item").agg(F.sum("n").alias("lower")).withColumn("upper", F.col("lower") + error)


def frequent(items: DataFrame, column: str, one_in: int, counters: int = COUNTERS) -> DataFrame:
    """item, n, lower, upper of all values that are more than one in `one_in` of the rows: a summary finds those that
    can be, a second pass counts these alone, so what is shuffled does not grow with the number of values."""
    if one_in > counters:
        raise ValueError("a summary of so few counters misses values as rare as that")
    rows = items.where(F.col(column).isNotNull())
    least = rows.count() / one_in
    likely = settled(heavy_hitters(rows, column, counters).where(F.col("upper") > least))  # at most about counters rows
    counted = rows.select(F.col(column).alias("item")).join(F.broadcast(likely), "item").groupBy("item", "lower", "upper").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > least).select("item", "n", "lower", "upper")


def distinct_estimate(keys: DataFrame, column: str, bits: int = 24, hashes: int = 4) -> DataFrame:
    """rows, distinct (estimated), standard_error of a column: each value sets `hashes` bits of a map of 2 ** bits, and
    the share of zeros tells how many values there were.

    Maps are made where rows are and joined by OR; a map is dealt in pieces of 32,768 bits."""
    size = 1 << bits
    places = F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(h), F.col(column)), F.lit(size)) for h in range(hashes))))
    total = keys.agg(F.count(column).alias("rows"))
    pieces = keys.where(F.col(column).isNotNull()).select(places.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("m"))
    ones = pieces.agg(F.coalesce(F.sum(F.bitmap_count("m")), F.lit(0)).alias("ones"))
    zero = 1 - F.col("ones") / size
    load = -F.log(zero)  # bits set a place, on average
    error = F.sqrt(F.greatest(F.exp(load) - load - 1, F.lit(0.0)) / size) * size / hashes
    return total.crossJoin(F.broadcast(ones)).select("rows", F.when(F.col("ones") < size, load * size / hashes).alias("distinct"), error.alias("standard_error"))  # one row each
