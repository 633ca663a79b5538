"""Helpers that the corpus operators share: tables, kept intermediates, joins with sides of a checked size."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast if its measured values take up to this many bytes, and shuffled beyond;
#: the session's own setting is read first.
BROADCAST_BYTES, BROADCAST_SETTING = 64 << 20, "spark.seqloom.broadcastBytes"
#: A table of keys beyond that bound is sent as a map of at most this many bits first.
MAP_BITS = 1 << 28

#: Paths that keep() wrote in the innermost block of only_kept, by thread (or task) that opened it.
_block: ContextVar[list[str] | None] = ContextVar("_block", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Where the session names none, a local folder stands in on a local master only, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and a lost
    executor costs nothing, since every later read starts from files that all of them see."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    if (block := _block.get()) is not None:
        block.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _delete(spark: SparkSession, path: str) -> None:
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


@contextmanager
def only_kept(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that keep() writes inside the block go at its end, but for those written by the
    function that the block gets; these go with a block around it, if there is one.  Blocks of other threads
    are apart."""
    around, own, staying = _block.get(), [], []
    token = _block.set(own)

    def stay(df: DataFrame) -> DataFrame:
        out, path = _written(df)
        staying.append(path)
        return out

    try:
        yield stay
    finally:
        _block.reset(token)
        for path in own:
            if path not in staying:
                _delete(spark, path)
        if around is not None:
            around.extend(staying)


def _bytes(field: T.StructField) -> Column:
    c, kind = F.col(field.name), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        inside = F.aggregate(c, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0))) if isinstance(kind.elementType, T.StringType) else F.lit(0)
        return F.coalesce(8 * F.size(c) + inside, F.lit(0))
    return F.lit(8)


def fits(df: DataFrame) -> bool:
    """Whether the values of df (a kept table), summed up, stay within the bound of a broadcast."""
    limit = int(df.sparkSession.conf.get(BROADCAST_SETTING, str(BROADCAST_BYTES)))
    each = [F.sum(_bytes(f).cast("long")) for f in df.schema]
    return (df.agg(sum(each[1:], each[0]).alias("n")).first()["n"] or 0) <= limit


def small(df: DataFrame) -> DataFrame:
    """df (a kept table), marked for broadcast only if its measured bytes stay within the bound."""
    return F.broadcast(df) if fits(df) else df


def _flagged(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df with _maybe: false for rows whose key is surely not in keys, by one bit a key in a map that
    is broadcast (MAP_BITS / 8 bytes at most)."""

    def bit(of: DataFrame) -> DataFrame:
        return of.withColumn("_bit", F.pmod(F.xxhash64(*on), F.lit(MAP_BITS)))

    made = bit(keys).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map"))
    met = bit(df).withColumn("_bucket", F.bitmap_bucket_number("_bit")).join(F.broadcast(keep(made)), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_map", F.expr("cast(bitmap_bit_position(_bit) div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    flag = F.coalesce(F.expr("getbit(_byte, cast(bitmap_bit_position(_bit) % 8 as int)) = 1"), F.lit(False))
    return met.withColumn("_byte", byte).withColumn("_maybe", flag).drop("_bit", "_bucket", "_map", "_byte")


def among(df: DataFrame, keys: DataFrame, on: list[str], inside: bool = True) -> DataFrame:
    """The rows of df whose key is in keys (a kept table of distinct keys without nulls), or those that
    are not.  Keys beyond a broadcast's bound shuffle only those rows of df that a map of bits
    can't tell from them, so most of a large table stays where it is."""
    how = "left_semi" if inside else "left_anti"
    if fits(keys):
        return df.join(F.broadcast(keys), on, how)
    flagged = _flagged(df, keys, on)
    maybe = flagged.where("_maybe").drop("_maybe").join(keys, on, how)
    return maybe if inside else flagged.where("not _maybe").drop("_maybe").unionByName(maybe)


def row_key() -> list[Column]:
    """k1, k2: a key of doc_id and text that is never null; rows alike in both have the same."""
    return [F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("k1"), F.coalesce(F.hash("text", F.lit(1), "doc_id"), F.lit(0)).cast("long").alias("k2")]
