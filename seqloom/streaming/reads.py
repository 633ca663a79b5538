"""The stateless steps on a stream of reads: the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import clip, dna
from seqloom.operators import filters


def read_stream(spark: SparkSession, path: str, schema: str = "read_idx long, id string, seq string, qual string", files_per_trigger: int = 100) -> DataFrame:
    """Records that land as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def clean(reads: DataFrame, options: filters.FilterOptions, window: int = 4, mean: int = 20) -> DataFrame:
    """Tail clips by quality and filters; works on streams and tables alike."""
    s, e = clip.cut_tail(F.col("seq"), F.col("qual"), clip.whole(F.col("seq")), window, mean)
    cut = reads.withColumns({"seq1": dna.cut(F.col("seq"), s, e), "qual1": dna.cut(F.col("qual"), s, e)})
    return filters.flag(cut, options).where(~F.col("rejected")).select("read_idx", "id", F.col("seq1").alias("seq"), F.col("qual1").alias("qual"))


def first_of_each(reads: DataFrame) -> DataFrame:
    """Reads whose bases were not seen before; state grows with the number of different reads."""
    return reads.withColumn("_key", F.sha2(F.upper("seq"), 256)).dropDuplicates(["_key"]).drop("_key")
