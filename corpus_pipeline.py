"""A training corpus from raw documents: five stages, each written before the next one reads it.

Rows are told apart by a key of doc_id and text that is never null, so a null doc_id or one that
several texts share is judged text by text.  An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.decontaminate import contaminated_rows
from seqloom.llm.line_dedup import drop_recurring_lines
from seqloom.llm.mixing import mix_sources
from seqloom.llm.near_dedup import near_groups
from seqloom.llm.quality import good_documents, learn_rules
from seqloom.llm.shared import among, keep, only_kept, row_key, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY = ["k1", "k2"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, *row_key())


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and the learned decision list keep, each row judged by its own text.

    Null and empty texts fail the base rules; repeated rows are all kept or all dropped; very long
    texts are counted whole; other columns than those of documents go."""
    rules = learn_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return good_documents(docs.select(COLUMNS), rules)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the lines of recurring templates; see drop_recurring_lines for odd input."""
    return drop_recurring_lines(docs.select(COLUMNS)).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the first by doc_id, then by a hash of its text.

    Rows that repeat a doc_id and text are copies, too.  Texts without words, and rows without a
    doc_id, are linked with nothing and stay."""
    with only_kept(spark) as stay:
        members = near_groups(docs).where("group is not null")
        first = members.groupBy("group").agg(F.min(F.struct("doc_id", *KEY)).alias("first"), F.count("*").alias("n")).where("n > 1")
        later = members.join(first, "group").where("k1 <> first.k1 or k2 <> first.k2")
        gone = keep(later.select(KEY).distinct())
        again = keep(among(members.groupBy(KEY).count().where("count > 1").select(KEY), gone, KEY, False))
        rows = among(_keyed(docs), gone, KEY, False)
        once = among(rows, again, KEY).groupBy(KEY).agg(F.min(F.struct(COLUMNS)).alias("row")).select("row.*")
        return stay(among(rows, again, KEY, False).select(COLUMNS).unionByName(once))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no passage with the benchmark; those without a doc_id or text are judged alike."""
    with only_kept(spark) as stay:
        found = stay(contaminated_rows(docs, table(spark, sf_dir, "benchmark")).select(KEY).distinct())
    return among(_keyed(docs), found, KEY, False).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each row, and how many words that are; see mix_sources for odd input."""
    return mix_sources(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: Shingle links, line templates and learned rules are beyond SQL; the tests hold brute force against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each one's result is kept as Parquet until the next has read it."""
    docs = table(spark, sf_dir, "documents")
    with only_kept(spark) as stay:
        for _, stage in STAGES[:-1]:
            docs = keep(stage(spark, docs, sf_dir))
        return stay(STAGES[-1][1](spark, docs, sf_dir))
