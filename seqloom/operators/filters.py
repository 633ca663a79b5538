"""Fragment filters: eight reasons, each counted once a fragment; either mate rejects a pair."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import dna
from seqloom.operators.metrics import read_digest
from seqloom.operators.near import near_join

#: So many entries of a blacklist are compared with every index in place.
FEW_ENTRIES = 8
REASONS = ["too_short", "too_many_n", "low_quality", "low_mean_quality", "too_long", "low_complexity", "duplicate", "index_blacklist"]


@dataclass(frozen=True)
class FilterOptions:
    min_length: int = 0
    max_n: int | None = None
    qualified_quality: int = 15
    max_low_quality_percent: float | None = None
    min_average_quality: float | None = None
    length_limit: int | None = None
    low_complexity_percent: float | None = None
    dedup: bool = False

    @classmethod
    def defaults_profile(cls, **explicit) -> FilterOptions:
        """Quality 15, 40 % low, 5 N and length 15, where nothing else is said."""
        return cls(**{"qualified_quality": 15, "max_low_quality_percent": 40, "max_n": 5, "min_length": 15} | explicit)


    def without(self, *kinds: str) -> FilterOptions:
        """These options with whole kinds of filters off, whatever set them: quality, n, length or complexity."""
        off = {"quality": {"max_low_quality_percent": None, "min_average_quality": None}, "n": {"max_n": None}, "length": {"min_length": 0, "length_limit": None}, "complexity": {"low_complexity_percent": None}}
        return replace(self, **{k: v for kind in kinds for k, v in off[kind].items()})


def reasons(seq: Column, qual: Column, o: FilterOptions) -> dict[str, Column]:
    """A flag for each reason that one mate's retained bases can give."""
    n, no = F.length(seq), F.lit(False)
    mean = F.when(n > 0, dna.quality_sum(qual) / n).otherwise(0.0)
    return {
        "too_short": n < o.min_length,
        "too_many_n": no if o.max_n is None else dna.n_count(seq) > o.max_n,
        "low_quality": no if o.max_low_quality_percent is None else (n > 0) & (dna.low_quality_count(qual, o.qualified_quality) * 100 > o.max_low_quality_percent * n),
        "low_mean_quality": no if o.min_average_quality is None else mean < o.min_average_quality,
        "too_long": no if o.length_limit is None else n > o.length_limit,
        "low_complexity": no if o.low_complexity_percent is None else dna.is_low_complexity(seq, o.low_complexity_percent),
    }


def flag(df: DataFrame, o: FilterOptions, mates: tuple[int, ...] = (1,)) -> DataFrame:
    """df (seq<m>, qual<m>; is_duplicate and is_blacklisted if there) plus a flag for each reason,
    failed<m> for each mate and rejected.  Fragments that lack a mate (orphans) pass all of them; those that have a
    merged_seq are judged by it."""
    whole_pair = reduce(lambda a, b: a & b, (F.col(f"seq{m}").isNotNull() for m in mates))
    read = lambda c, m: F.coalesce(f"merged_{c}", f"{c}{m}") if "merged_seq" in df.columns else F.col(f"{c}{m}")
    own = {m: reasons(read("seq", m), read("qual", m), o) for m in mates}
    either = {r: reduce(lambda a, b: a | b, (own[m][r] for m in mates)) for r in REASONS[:6]}
    either["duplicate"] = F.col("is_duplicate") if o.dedup and "is_duplicate" in df.columns else F.lit(False)
    either["index_blacklist"] = F.col("is_blacklisted") if "is_blacklisted" in df.columns else F.lit(False)
    whole = either["duplicate"] | either["index_blacklist"]
    failed = {f"failed{m}": reduce(lambda a, b: a | b, own[m].values()) | whole for m in mates}
    either, failed = ({k: F.coalesce(whole_pair & c, F.lit(False)) for k, c in flags.items()} for flags in (either, failed))
    return df.withColumns(either | failed).withColumn("rejected", reduce(lambda a, b: a | b, map(F.col, REASONS)))


def rejection_counts(flagged: DataFrame) -> DataFrame:
    """One row: fragments, rejected, and how many each reason concerns."""
    return flagged.agg(F.count("*").alias("fragments"), F.sum(F.col("rejected").cast("long")).alias("rejected_fragments"), *(F.sum(F.col(r).cast("long")).alias(r) for r in REASONS))


def blacklisted(df: DataFrame, entries: list[str], threshold: int = 0, second: bool = False, id_column: str = "id1") -> DataFrame:
    """df plus is_blacklisted (or whether it was so before): its index is as long as an entry and differs in threshold
    places at most.  A few entries are compared in place; more are joined on pieces."""
    if not entries or len(set(entries)) != len(entries):
        raise ValueError("the blacklist must have entries, each once")
    index = F.upper(dna.index_of(F.col(id_column), second))
    known = sorted({e.upper() for e in entries})
    if len(known) <= FEW_ENTRIES:
        hit = reduce(lambda a, b: a | b, (F.coalesce(dna.hamming(index, F.lit(e)) <= threshold, F.lit(False)) for e in known))
    else:
        dim = df.sparkSession.createDataFrame([(e,) for e in known], "_entry string")
        df = near_join(df.withColumn("_index", index), dim, [], "_index", "_entry", threshold).drop("_index")
        hit = F.col("_distance").isNotNull()
    if "is_blacklisted" in df.columns:
        hit = hit | F.col("is_blacklisted")
    return df.withColumn("is_blacklisted", hit).drop("_distance")


def mark_duplicates(df: DataFrame, mates: tuple[int, ...] = (1,)) -> DataFrame:
    """df plus is_duplicate: another fragment with the same bases has a smaller read_idx.

    A digest of the bases and read_idx are all that is shuffled to find duplicates; their numbers are
    then joined back, which moves whole reads only where duplicates are too many to send.
    """
    keyed = df.select("read_idx", read_digest(mates).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("read_idx").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = keyed.join(first, "_key").where("read_idx > _first").select("read_idx", F.lit(True).alias("is_duplicate"))
    return df.join(later, "read_idx", "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
