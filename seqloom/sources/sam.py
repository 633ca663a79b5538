"""SAM-like records as rows: the contract of unmapped input, mates by name, and tags after trimming.

Columns: read_idx, qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual (Phred+33) and
tags map<string, struct<type: string, value: string>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags cut with the bases, and tags that a cut makes wrong.
CUT = ["OQ", "BQ", "E2", "U2"]
INVALID = ["MM", "ML", "MN", "MD", "NM", "SA", "MC", "AS", "XS", "UQ", "MQ", "AM", "SM", "CM", "NH", "HI", "IH", "PT", "CC", "CP", "CG", "H0", "H1", "H2", "PQ", "TS"]


def _set(bit: int) -> Column:
    return F.col("flag").bitwiseAND(bit) != 0


def problem(paired: bool) -> Column:
    """What a record breaks of the contract, or null: primary, unmapped, without a place, with bases and
    a quality of 0 to 93 for each; with paired flags as the mode says."""
    placed = (F.col("rname") != "*") | (F.col("pos") != 0) | (F.col("mapq") != 0) | (F.col("cigar") != "*")
    mate_placed = (F.col("rnext") != "*") | (F.col("pnext") != 0) | (F.col("tlen") != 0)
    n = F.length("seq")
    out = F.when(F.coalesce(F.col("qname"), F.lit("")) == "", "no name").when(_set(0x100), "secondary").when(_set(0x800), "supplementary").when(~_set(0x4) | placed, "aligned")
    if paired:
        out = out.when(~_set(0x1), "not paired").when(~_set(0x8), "mate mapped").when(_set(0x40) == _set(0x80), "not one mate").when(_set(0x2) | mate_placed, "mate placed")
    else:
        out = out.when(F.col("flag").bitwiseAND(0x1 | 0x2 | 0x8 | 0x20 | 0x40 | 0x80) != 0, "paired").when(mate_placed, "mate placed")
    return out.when(F.coalesce(n, F.lit(0)) == 0, "no bases").when(F.coalesce(F.length("qual"), F.lit(-1)) != n, "lengths differ").when(~F.col("qual").rlike("^[!-~]*$"), "quality out of range")


def checked(records: DataFrame, paired: bool) -> DataFrame:
    """records, or an error that names the first broken one of a task."""
    what = problem(paired)
    fault = F.raise_error(F.concat(F.lit("record "), F.coalesce("qname", F.lit("?")), F.lit(": "), what))
    return records.withColumn("seq", F.when(what.isNull(), F.col("seq")).otherwise(fault))


def mates(records: DataFrame) -> DataFrame:
    """A row for each name: read_idx of its first record, r1_first, and seq and qual of either mate.

    Records of one name must be two neighbours, one of each mate; anything else is an error."""
    first, second = (F.when(_set(bit), F.struct("read_idx", "seq", "qual")) for bit in (0x40, 0x80))
    both = records.groupBy("qname").agg(F.count("*").alias("n"), F.min("read_idx").alias("read_idx"), F.max("read_idx").alias("last"), F.max(first).alias("a"), F.max(second).alias("b"))
    right = (F.col("n") == 2) & (F.col("last") == F.col("read_idx") + 1) & F.col("a").isNotNull() & F.col("b").isNotNull()
    name = F.when(F.coalesce(right, F.lit(False)), F.col("qname")).otherwise(F.raise_error(F.concat(F.lit("no pair of neighbours: "), F.col("qname"))))
    parts = [F.col(f"{s}.{c}").alias(f"{c}{m}") for s, m in (("a", 1), ("b", 2)) for c in ("seq", "qual")]
    return both.select("read_idx", name.alias("qname"), (F.col("a.read_idx") < F.col("b.read_idx")).alias("r1_first"), *parts)


def trimmed(records: DataFrame) -> DataFrame:
    """records (with b_start, b_end and, for pairs, mate_seq and mate_qual where the mate was cut, else
    null) with seq and qual cut, tags kept, rewritten or removed, and actions: array of (action, tag).

    Only where bounds change something are CUT tags cut alike and INVALID ones removed; R2 and Q2 get
    the mate's bases and qualities where that changed.  A rewritten tag must have type Z, and a
    cut one the read's length."""
    n = F.length("seq")
    changed = (F.col("b_start") != 0) | (F.col("b_end") != n)
    part = lambda x: F.substring(x, F.col("b_start") + 1, F.col("b_end") - F.col("b_start"))
    mate = {"R2": F.col("mate_seq"), "Q2": F.col("mate_qual")} if "mate_seq" in records.columns else {}

    def rewritten(k: Column) -> Column:
        out = changed & k.isin(CUT)
        for tag, value in mate.items():
            out = out | ((k == tag) & value.isNotNull())
        return out

    def value(k: Column, v: Column) -> Column:
        text = v["value"]
        new = F.when(k.isin(CUT), F.when(F.length(text) == n, part(text)).otherwise(F.raise_error(F.concat(F.lit("tag of another length: "), k))))
        for tag, own in mate.items():
            new = new.when(k == tag, own)
        fault = F.raise_error(F.concat(F.lit("tag must have type Z: "), k))
        put = F.struct(v["type"].alias("type"), F.when(v["type"] == "Z", new).otherwise(fault).alias("value"))
        return F.when(rewritten(k), put).otherwise(v)

    gone = lambda k: changed & k.isin(INVALID)
    action = lambda k: F.when(gone(k), "removed").when(rewritten(k), "rewritten").otherwise("preserved")
    actions = F.transform(F.map_keys("tags"), lambda k: F.struct(action(k).alias("action"), k.alias("tag")))
    tags = F.transform_values(F.map_filter("tags", lambda k, v: ~gone(k)), value)
    return records.withColumns({"actions": actions, "tags": tags, "_s": part(F.col("seq")), "_q": part(F.col("qual"))}).withColumns({"seq": F.col("_s"), "qual": F.col("_q")}).drop("_s", "_q")


def tag_counts(records: DataFrame) -> DataFrame:
    """Action, Tag, Count over trimmed records."""
    return records.select(F.explode("actions").alias("x")).groupBy(F.col("x.action").alias("Action"), F.col("x.tag").alias("Tag")).agg(F.count("*").alias("Count"))
