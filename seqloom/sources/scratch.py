"""Files that a job writes and reads again, in a folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, as a URI or an absolute path; a local master without that setting
    takes a temporary folder, any other is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{re.sub('^file:/+', 'file:///', root).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


def settled(df: DataFrame, *gone: str) -> DataFrame:
    """df as a kept table, after which the files it came from go."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    for p in gone:
        delete(spark, p)
    return spark.read.schema(df.schema).parquet(path)
