"""Quality-control tables: every one is a partial aggregate over the fragment table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import dna
from seqloom.operators.sketches import distinct_estimate, heavy_hitters
from seqloom.plans.layout import Layout


#: Numbers of reads that one task puts in order where parts are numbered.
STRETCH = 1_000_000


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.when(b == 0, 0.0).otherwise(scale * a / b)


def stats_of(s: Column, q: Column) -> list[Column]:
    """The sums behind FASTQ stats; extremes are null where there is no read."""
    return [
        F.count(s).alias("reads"),
        F.coalesce(F.sum(F.length(s)), F.lit(0)).alias("bases"),
        F.min(F.length(s)).alias("min_length"),
        F.max(F.length(s)).alias("max_length"),
        F.sum(dna.gc_count(s)).alias("gc"),
        F.sum(dna.n_count(s)).alias("n"),
        F.sum(dna.quality_sum(q)).alias("quality"),
        F.sum(dna.at_least_quality(q, 20)).alias("q20"),
        F.sum(dna.at_least_quality(q, 30)).alias("q30"),
    ]


def rates(df: DataFrame, *keys: str) -> DataFrame:
    """FASTQ stats from their sums."""
    c = F.col
    return df.select(
        *keys, "reads", "bases", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("min_length", "max_length")),
        F.round(ratio(c("bases"), c("reads")), 4).alias("mean_length"),
        *(F.round(ratio(c(x), c("bases"), 100.0), 4).alias(f"{x}_percent") for x in ("gc", "n")),
        F.round(ratio(c("quality"), c("bases")), 4).alias("mean_quality"),
        *(F.round(ratio(c(x), c("bases"), 100.0), 4).alias(f"{x}_percent") for x in ("q20", "q30")),
    )


def fastq_stats(df: DataFrame, *keys: str, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """Reads, bases, lengths, GC, N and quality by keys."""
    return rates(df.groupBy(*keys).agg(*stats_of(F.col(seq), F.col(qual))), *keys)


def segment_stats(reads: DataFrame, layout: Layout) -> DataFrame:
    """fastq_stats of each barcode piece as read, clipped where a read is short."""
    pieces = F.array(*(
        F.struct(F.lit(x.mate).alias("mate"), F.lit(x.symbol).alias("symbol"), F.lit(p + 1).alias("piece"), F.lit(x.start + 1).alias("start_cycle"), F.lit(x.end).alias("end_cycle"),
                 F.substring(f"seq{x.mate}", x.start + 1, x.end - x.start).alias("seq"), F.substring(f"qual{x.mate}", x.start + 1, x.end - x.start).alias("qual"))
        for s in layout.symbols for p, x in enumerate(layout.pieces(s))
    ))
    keys = ["mate", "symbol", "piece", "start_cycle", "end_cycle"]
    return fastq_stats(reads.select(F.explode(pieces).alias("x")).select("x.*"), *keys)


def mate_stats(table: DataFrame, raw: bool = False) -> DataFrame:
    """fastq_stats of each mate of a fragment table, and of merged reads if it has any; raw: as they came."""
    prefix = "raw_" if raw else ""
    mates = [m for m in (1, 2) if f"seq{m}" in table.columns]
    merged = "merged_seq" in table.columns and not raw
    alone = F.col("merged_seq").isNull() if merged else F.lit(True)
    rows = [F.when(alone, F.struct(F.lit(f"R{m}").alias("mate"), F.col(f"{prefix}seq{m}").alias("seq"), F.col(f"{prefix}qual{m}").alias("qual"))) for m in mates]
    if merged:
        rows.append(F.when(~alone, F.struct(F.lit("Merged").alias("mate"), F.col("merged_seq").alias("seq"), F.col("merged_qual").alias("qual"))))
    return fastq_stats(table.select(F.explode(F.array(*rows)).alias("x")).where("x.seq is not null").select("x.*"), "mate")


def sample_metrics(counts: DataFrame, samples: DataFrame, low_fraction: float = 0.05, columns: list[str] | None = None) -> DataFrame:
    """Fragments and bases (or other counts, by name) of every sample, shares of all and of the median, and
    OK, LOW_REPRESENTATION or MISSING.  counts: sample, fragments, bases; samples: sample."""
    n, columns = F.col("fragments"), columns or ["bases"]
    joined = samples.join(counts, "sample", "left").select("sample", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("fragments", *columns)))
    sums = joined.agg(F.sum("fragments").alias("all"), F.median(F.when(n > 0, n)).alias("median"))
    status = F.when(n == 0, "MISSING").when(n < F.col("median") * low_fraction, "LOW_REPRESENTATION").otherwise("OK")
    shares = [F.round(ratio(n, F.col("all")), 8).alias("fraction_of_assigned"), F.round(ratio(n, F.coalesce("median", F.lit(0.0))), 8).alias("fraction_of_median")]
    return joined.crossJoin(F.broadcast(sums)).select("sample", "fragments", *columns, *shares, status.alias("status"))


def length_histogram(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.groupBy(F.length(seq).alias("length")).agg(F.count("*").alias("reads"))


def quality_histogram(df: DataFrame, qual: str = "qual") -> DataFrame:
    """Bases by quality; everything above 93 counts as 93."""
    return df.select(F.explode(dna.phred(F.col(qual))).alias("q")).groupBy(F.least("q", F.lit(93)).alias("quality")).agg(F.count("*").alias("bases"))


def cycle_content(df: DataFrame, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """Bases and their summed quality by cycle (from 1) and base (A, T, C, G, N, other)."""
    both = F.arrays_zip(dna.letters(F.upper(seq)).alias("b"), dna.phred(F.col(qual)).alias("q"))
    rows = df.select(F.posexplode(both).alias("i", "x")).select((F.col("i") + 1).alias("cycle"), F.col("x.b"), F.col("x.q"))
    base = F.when(F.col("b").isin(*"ATCGN"), F.col("b")).otherwise("other")
    return rows.groupBy("cycle", base.alias("base")).agg(F.count("*").alias("bases"), F.sum("q").alias("quality_sum"))


def windows(df: DataFrame, widths: tuple[int, ...] = (10,), every: int = 1, seq: str = "seq", whole: bool = False) -> DataFrame:
    """sequence: every substring of ACGT of all widths in every nth read; whole: reads of 512 bases at most, and of
    none of the widths, as they are, too."""
    s = F.upper(F.col(seq))

    def cut(w: int):
        starts = F.when(F.length(s) >= w, F.sequence(F.lit(1), F.length(s) - w + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(s, i, F.lit(w)))

    parts = [cut(w) for w in widths]
    if whole:
        parts.append(F.when((F.length(s) <= 512) & ~F.length(s).isin(*widths), F.array(s)).otherwise(F.array().cast("array<string>")))
    return df.where(F.col("read_idx") % every == 0).select(F.explode(F.concat(*parts)).alias("sequence")).where("sequence rlike '^[ACGT]+$'")


#: Different windows of one task, at most, where windows are counted.
WINDOWS_IN_TASK, _TALLIED = 1_000_000, 1 << 18


def _different(df: DataFrame, widths: tuple[int, ...], every: int, seq: str, whole: bool) -> int:
    """A bound of how many different windows there are, from lengths alone: of a width, as many as windows or words of ACGT."""
    n = F.length(seq).cast("long")
    each = [F.sum(F.greatest(n - w + 1, F.lit(0))) for w in widths]
    told = df.where(F.col("read_idx") % every == 0).agg(F.count(seq).alias("reads"), *(F.coalesce(x, F.lit(0)).alias(f"w{i}") for i, x in enumerate(each))).first()
    return sum(min(told[f"w{i}"], 4**w) for i, w in enumerate(widths)) + whole * told["reads"]


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sequence, n of some batches at a time, so a window that most reads have isn't sent once a read."""
    held, rows = [], 0

    def told() -> pa.RecordBatch:
        seen = pa.chunked_array(held, pa.string()).value_counts()
        return pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], names=["sequence", "n"])

    for batch in batches:
        held.append(batch.column(0))
        rows += len(batch)
        if rows >= _TALLIED:
            yield told()
            held, rows = [], 0
    if rows:
        yield told()


def _counts(pieces: DataFrame, different: int) -> DataFrame:
    """sequence, n of all windows.  Where the session's partitions would get more different ones than a task should hold, they
    are dealt to as many tasks as it takes."""
    tasks = -(-different // WINDOWS_IN_TASK)
    if tasks <= int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return pieces.groupBy("sequence").agg(F.count("*").alias("n"))
    return pieces.mapInArrow(_tallied, "sequence string, n long").repartition(tasks, "sequence").groupBy("sequence").agg(F.sum("n").alias("n"))


def overrepresented(df: DataFrame, widths: tuple[int, ...] = (10,), every: int = 1, top: int = 100, seq: str = "seq", whole: bool = False, counters: int = 0) -> DataFrame:
    """sequence, n: the most frequent of windows, twice at least; ties by sequence.  counters: in bounded memory
    instead, n being a lower bound, with the upper one as upper."""
    pieces = windows(df, widths, every, seq, whole)
    if counters:
        counted = heavy_hitters(pieces, "sequence", counters).select(F.col("item").alias("sequence"), F.col("lower").alias("n"), "upper").where("n >= 2")
    else:
        counted = _counts(pieces, _different(df, widths, every, seq, whole)).where("n >= 2")
    return counted.orderBy(F.desc("n"), "sequence").limit(top)


def read_digest(mates: tuple[int, ...] = (1,)) -> Column:
    """32 bytes of a fragment's bases, whatever their case, with where one mate ends."""
    return F.unhex(F.sha2(F.concat_ws("|", *(F.concat(F.length(f"seq{m}").cast("string"), F.lit(":"), F.upper(F.col(f"seq{m}"))) for m in mates)), 256))


def duplication(df: DataFrame, mates: tuple[int, ...] = (1,)) -> DataFrame:
    """One row: fragments, different ones, duplicates and their rate; digests are what is shuffled."""
    counted = df.groupBy(read_digest(mates).alias("s")).agg(F.count("*").alias("n"))
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fragments"), F.count("*").alias("distinct_fragments"))
    dup = F.col("fragments") - F.col("distinct_fragments")
    return sums.select("fragments", "distinct_fragments", dup.alias("duplicates"), F.round(ratio(dup, F.col("fragments")), 8).alias("duplication_rate"))


def duplication_estimate(df: DataFrame, mates: tuple[int, ...] = (1,), bits: int = 24) -> DataFrame:
    """duplication in bounded memory: fragments, and estimates of the others with the standard error of the rate; the
    map of 2 ** bits bits suits up to about half as many different fragments."""
    one = distinct_estimate(df.select(read_digest(mates).alias("s")), "s", bits)
    distinct = F.least(F.col("distinct"), F.col("rows").cast("double"))
    return one.select(F.col("rows").alias("fragments"), F.round(distinct).cast("long").alias("distinct_fragments"), F.round(ratio(F.col("rows") - distinct, F.col("rows")), 8).alias("duplication_rate"), ratio(F.col("standard_error"), F.col("rows")).alias("rate_error"))


def split_parts(df: DataFrame, per_part: int, *keys: str) -> DataFrame:
    """df plus part, from 0: per_part records of each stream in input order.

    Records are counted by stream and stretch of read_idx first; a record's place is what lies before
    its stretch and its place within it, so a stream with most records spreads over all tasks."""
    dealt = df.withColumn("_stretch", F.floor(F.col("read_idx") / STRETCH))
    counts = dealt.groupBy(*keys, "_stretch").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(counts.select(*keys, "_stretch", before.alias("_before")), [*keys, "_stretch"])
    own = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy("read_idx"))
    return placed.withColumn("part", F.floor((F.col("_before") + own - 1) / per_part).cast("long")).drop("_stretch", "_before")


def split_evenly(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df plus part: so many parts of all records, by a count of them first."""
    return split_parts(df, max(1, -(-df.count() // parts)), *keys)
