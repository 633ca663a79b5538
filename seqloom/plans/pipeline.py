"""demux and trim: one lazy fragment table, from which every sink and report is a query."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import clip, dna
from seqloom.operators import filters, metrics
from seqloom.operators.adapters import Adapter, SampleAdapter, infer_adapter, opposite, sample_adapters
from seqloom.operators.automaton import AdapterSet
from seqloom.operators.overlap import consensus, overlaps
from seqloom.operators.routing import route
from seqloom.plans import accounting
from seqloom.plans.accounting import html_report
from seqloom.plans.layout import Layout, Structure
from seqloom.sources import scratch
from seqloom.sources.fastq import write_fastq
from seqloom.sources.files import write_files
from seqloom.sources.tables import file_names, read_adapters

#: So many adapters of a mate are expressions of their own; more go through one automaton.
FEW_ADAPTERS = 4


@dataclass(frozen=True)
class CutOptions:
    """Clips by quality: window and mean for each direction that is on; right takes precedence over tail."""

    front: tuple[int, int] | None = None
    tail: tuple[int, int] | None = None
    right: tuple[int, int] | None = None


@dataclass(frozen=True)
class Spec:
    """What demux and trim do; every check that needs no data is made here."""

    layout: Layout = field(default_factory=Layout)
    barcodes: tuple[tuple[str, str, str], ...] = ()
    sheet: tuple[dict, ...] = ()
    max_mismatches: int = 1
    trim_front: tuple[int, int] = (0, 0)
    trim_tail: tuple[int, int] = (0, 0)
    max_len: tuple[int, int] = (0, 0)
    cut: CutOptions = field(default_factory=CutOptions)
    poly_g: int = 0
    poly_x: int = 0
    adapters: dict[int, tuple[Adapter, ...]] = field(default_factory=dict)
    adapter_fasta: dict[int, str] = field(default_factory=dict)
    adapter_min_known: int = 20
    infer_adapters: bool = False
    distal: dict[int, str] = field(default_factory=dict)
    detect_adapters: bool = False
    auto_poly_g: bool = False
    technical: dict[int, str] = field(default_factory=dict)
    overlap: bool = True
    overlap_length: int = 30
    overlap_limit: int = 5
    overlap_percent: float = 20
    require_adapter: bool = False
    gap_overlap: bool = False
    correction: bool = False
    merge: bool = False
    umi_location: str | None = None
    umi_length: int = 0
    umi_skip: int = 0
    umi_prefix: str = ""
    umi_delimiter: str = ":"
    fix_mgi: bool = False
    phred64: bool = False
    filters: filters.FilterOptions = field(default_factory=filters.FilterOptions)
    blacklist: tuple[str, ...] = ()
    blacklist2: tuple[str, ...] = ()
    blacklist_threshold: int = 0
    write_unassigned: bool = False
    write_failed: bool = False
    include_unmerged: bool = False
    low_fraction: float = 0.05
    dimer_max: int = 2
    report_title: str = "Read report"
    report_details: bool = False

    def __post_init__(self):
        if self.umi_location not in (None, "read1", "read2", "per_read", "index1", "index2", "per_index"):
            raise ValueError(f"unknown UMI location {self.umi_location!r}")
        if self.umi_location in ("read1", "read2", "per_read") and not self.umi_length:
            raise ValueError("a UMI in reads needs a length")
        if bool(self.barcodes) != bool(self.sheet):
            raise ValueError("barcodes and samples go together")
        if self.distal and not (self.infer_adapters and self.barcodes):
            raise ValueError("a distal structure is for signatures of samples")
        if self.detect_adapters and (self.adapters or self.adapter_fasta or self.infer_adapters):
            raise ValueError("adapters are detected where none are given")
        if self.auto_poly_g and self.poly_g:
            raise ValueError("poly-G is clipped or found out, not both")
        for m, text in self.distal.items():
            if unknown := {x.symbol for x in Structure.parse(text).segments} - {*self.layout.symbols, "T"}:
                raise ValueError(f"the distal structure of R{m} has unknown barcodes {sorted(unknown)}")
        for s in self.layout.symbols:
            if not 0 <= self.max_mismatches <= self.layout.length(s):
                raise ValueError("more mismatches than barcode bases")
        if self.sheet:
            file_names([r["Sample"] for r in self.sheet])

    def umi_bases(self, mate: int) -> int:
        used = {"read1": (1,), "read2": (2,), "per_read": (1, 2)}.get(self.umi_location, ())
        return self.umi_length + self.umi_skip if mate in used else 0


#: Bases of a run that poly-G clips take, where the instrument asks for them.
AUTO_POLY_G = 10


def detected(reads: DataFrame, spec: Spec) -> Spec:
    """spec with what it leaves to the reads: poly-G clips if the first read's name is that of an instrument with
    two colours, and for each mate the adapter that many of its ends share.  Looks at the first read and
    the first few thousand, by read_idx."""
    more: dict = {}
    mates = (1, 2) if "seq2" in reads.columns else (1,)
    if spec.auto_poly_g:
        named = reads.where("id1 is not null").orderBy("read_idx").limit(1).select(dna.two_colour(F.col("id1")).alias("two")).first()
        more |= {"auto_poly_g": False, "poly_g": AUTO_POLY_G if named and named["two"] else 0}
    if spec.detect_adapters:
        found = {m: infer_adapter(reads.where(f"seq{m} is not null").select("read_idx", F.col(f"seq{m}").alias("seq")), prefix=spec.layout.prefix(m) + spec.umi_bases(m)) for m in mates}
        more |= {"detect_adapters": False, "adapters": {m: (Adapter(a, min_partial=spec.adapter_min_known),) for m, a in found.items() if a}}
    return replace(spec, **more) if more else spec


def fragments(reads: DataFrame, spec: Spec) -> DataFrame:
    """The fragment table: read_idx, id, seq, qual by mate as they came, status and sample, bounds,
    retained bases, filter flags, bases removed by each step, and for pairs the overlap's features.

    reads: read_idx, id1, seq1, qual1 and, for pairs, id2, seq2, qual2; a pair that lacks a mate is an
    orphan, which nothing clips or rejects.  Order of steps: duplicates on the raw bases,
    routing, fixed and quality clips, poly-G, adapters or overlap (assigned ones only), poly-X,
    length, correction, merging, filters.  Nothing is collected; only duplicate marking shuffles,
    and pairs pass through one or two Arrow stages.
    """
    mates = (1, 2) if "seq2" in reads.columns else (1,)
    df, spec = reads, detected(reads, spec)
    if spec.phred64:
        df = df.withColumns({f"qual{m}": dna.phred64_to_33(F.col(f"qual{m}")) for m in mates})
    if spec.filters.dedup:
        df = filters.mark_duplicates(df, mates)
    paired = len(mates) == 2
    for second, entries in ((False, spec.blacklist), (True, spec.blacklist2)):
        if entries:  # the second index is read from R2's name, if there is one
            df = filters.blacklisted(df, list(entries), spec.blacklist_threshold, second, "id2" if second and paired else "id1")
    if spec.barcodes:
        df = route(df, spec.layout, list(spec.barcodes), list(spec.sheet), spec.max_mismatches)
    else:
        df = df.withColumns({"status": F.lit("assigned"), "sample": F.lit("trimmed"), "is_short": F.lit(False)})
    if paired:
        orphan = F.col("seq1").isNull() | F.col("seq2").isNull()
        df = df.withColumns({"status": F.when(orphan, "orphan").otherwise(F.col("status")), "sample": F.when(~orphan, F.col("sample")), "is_short": F.coalesce(~orphan & F.col("is_short"), F.lit(False))})
    inferred = []
    if spec.infer_adapters and spec.barcodes:
        inferred = sample_adapters(spec.layout, list(spec.barcodes), list(spec.sheet), paired, spec.technical, {m: spec.umi_bases(m) for m in mates}, {m: Structure.parse(x) for m, x in spec.distal.items()})
        for m in sorted({r[1] for r in inferred}):
            dim = df.sparkSession.createDataFrame([(r[0], *r[2:]) for r in inferred if r[1] == m], f"_s string, infer{m}_expected string, infer{m}_at int, infer{m}_word string")
            df = df.join(F.broadcast(dim), F.col("sample") == F.col("_s"), "left").drop("_s")  # a row a sample of the sheet
    own = {m: [*_own_adapters(spec, m), *_technical_adapter(spec, m, paired), *([SampleAdapter(f"infer{m}")] if any(r[1] == m for r in inferred) else [])] for m in mates}
    df = df.withColumn("_able", F.col("status") == "assigned")
    confirm = paired and spec.overlap
    for m in mates:
        df = _settled(_clip(df, m, spec, own[m], alone=not confirm), df.columns)
    df = _names(df, spec, mates)
    if confirm:
        df = _pair_bounds(df, spec, own)
    for m in mates:
        df = _finish(df, m, spec)
        df = df.withColumn(f"kept_seq{m}", dna.cut(F.col(f"seq{m}"), F.col(f"_s{m}"), F.col(f"_e{m}")))
    df = _settled(df, [c for c in df.columns if not c.startswith(("kept_", "_s", "_e", "poly_x", "max_length", "adapter", "dimer", "pair_overlap"))])
    df = df.withColumns({f"kept_qual{m}": dna.cut(F.col(f"qual{m}"), F.col(f"_s{m}"), F.col(f"_e{m}")) for m in mates})  # not settled: made only where asked for
    df = df.withColumns({f"raw_{c}{m}": F.col(f"{c}{m}") for c in ("seq", "qual") for m in mates}).withColumns({f"{c}{m}": F.col(f"kept_{c}{m}") for c in ("seq", "qual") for m in mates})
    if paired and (spec.correction or spec.merge):
        df = overlaps(df.drop("overlap_status", "insert_length", "overlap_length", "overlap_mismatches", "gap_end1", "gap_end2") if confirm else df, where="_able", **_limits(spec))
        df = consensus(df, correct=spec.correction, merge=spec.merge, fronts=("_front1", "_front2"))
    return filters.flag(df, spec.filters, mates).drop("_able")


def _own_adapters(spec: Spec, m: int) -> list:
    """A mate's given adapters and those of its FASTA file: as they are while they are few, else as one automaton."""
    own = [*spec.adapters.get(m, ())]
    if m in spec.adapter_fasta:
        known = {"min_known": spec.adapter_min_known, "min_partial": spec.adapter_min_known}
        own += AdapterSet(tuple(Adapter(seq, **known) for _, seq in read_adapters(spec.adapter_fasta[m]))).adapters
    return own if len(own) <= FEW_ADAPTERS else [AdapterSet(tuple(own))]


def _technical_adapter(spec: Spec, m: int, paired: bool) -> list[Adapter]:
    """Without barcodes a far end is known where its technical bases are."""
    if spec.barcodes or not spec.infer_adapters:
        return []
    source = 3 - m if paired else m
    expected = opposite(spec.layout, source, {}, spec.technical, spec.umi_bases(source))
    return [Adapter(expected)] if Adapter(expected).anchor else []


def _settled(df: DataFrame, before: list[str]) -> DataFrame:
    """df with the columns it has beyond `before` computed once: an exploded array of one keeps Spark from
    writing their expressions out again in every later filter and projection that uses them."""
    new = [c for c in df.columns if c not in before]
    old = [c for c in df.columns if c in before]
    return df.select(*old, F.explode(F.array(F.struct(*new))).alias("_new")).select(*old, "_new.*")


def _limits(spec: Spec) -> dict:
    return dict(least=spec.overlap_length, limit=spec.overlap_limit, percent=spec.overlap_percent)


def _put(df: DataFrame, m: int, step: str, bounds: tuple) -> DataFrame:
    """New bounds of assigned fragments, and what the step has removed so far."""
    s, e, able = F.col(f"_s{m}"), F.col(f"_e{m}"), F.col("_able")
    df = df.withColumns({"_ns": F.when(able, bounds[0]).otherwise(s), "_ne": F.when(able, bounds[1]).otherwise(e)})
    taken = (e - s) - (F.col("_ne") - F.col("_ns"))
    before = F.col(f"{step}_removed{m}") if f"{step}_removed{m}" in df.columns else F.lit(0)
    return df.withColumn(f"{step}_removed{m}", before + F.coalesce(taken, F.lit(0))).withColumns({f"_s{m}": F.col("_ns"), f"_e{m}": F.col("_ne")}).drop("_ns", "_ne")


def _clip(df: DataFrame, m: int, spec: Spec, own: list, alone: bool) -> DataFrame:
    """Bounds of a mate after its prefix, fixed and quality clips and poly-G, and where adapters begin in
    what is left; if alone, these cut it."""
    seq, qual, i = F.col(f"seq{m}"), F.col(f"qual{m}"), m - 1
    here = F.col(f"_s{m}"), F.col(f"_e{m}")
    df = df.withColumns({f"_s{m}": F.lit(0), f"_e{m}": F.length(seq)})
    df = _put(df, m, "proximal", (F.least(F.lit(spec.layout.prefix(m) + spec.umi_bases(m)), F.length(seq)), here[1]))
    df = df.withColumn(f"_front{m}", here[0])
    if spec.trim_front[i] or spec.trim_tail[i]:
        df = _put(df, m, "quality", clip.fixed(here, spec.trim_front[i], spec.trim_tail[i]))
    if spec.cut.front:
        df = _put(df, m, "quality", clip.cut_front(seq, qual, here, *spec.cut.front))
    if spec.cut.right:
        df = _put(df, m, "quality", clip.cut_right(seq, qual, here, *spec.cut.right))
    elif spec.cut.tail:
        df = _put(df, m, "quality", clip.cut_tail(seq, qual, here, *spec.cut.tail))
    if spec.poly_g:
        df = _put(df, m, "poly_g", clip.poly_g(seq, here, spec.poly_g))
    df = df.withColumns({f"_front{m}": here[0] - F.col(f"_front{m}"), f"_part{m}": dna.cut(seq, *here)})
    part, none = F.col(f"_part{m}"), F.lit(None).cast("int")
    full = F.array_min(F.array(*(a.full(part) for a in own))) if own else none
    strongest = F.array_max(F.array(*(a.evidence(part) for a in own)))["start"] if own else none
    df = df.withColumn(f"full{m}", F.when(F.col("_able"), full)).withColumn(f"partial{m}", F.when(F.col("_able") & F.col(f"full{m}").isNull(), strongest))
    if alone:
        kind = F.when(F.col(f"full{m}").isNotNull(), "full").when(F.col(f"partial{m}").isNotNull(), "partial")
        df = _adapter_cut(df, m, spec, kind, F.coalesce(f"full{m}", f"partial{m}"))
    return df


def _adapter_cut(df: DataFrame, m: int, spec: Spec, kind, at) -> DataFrame:
    """Cut a mate at `at` where kind (full, partial or overlap) isn't null, and note both and dimers."""
    df = df.withColumns({f"adapter{m}": kind, "_at": at})
    cut = F.when(F.col(f"adapter{m}").isNotNull(), F.col(f"_s{m}") + F.col("_at")).otherwise(F.col(f"_e{m}"))
    df = _put(df, m, "adapter", (F.col(f"_s{m}"), cut)).drop("_at")
    short = F.col(f"_e{m}") - F.col(f"_s{m}") <= spec.dimer_max
    return df.withColumn(f"dimer{m}", F.col(f"adapter{m}").isNotNull() & short)


def _finish(df: DataFrame, m: int, spec: Spec) -> DataFrame:
    here = F.col(f"_s{m}"), F.col(f"_e{m}")
    if spec.poly_x:
        df = _put(df, m, "poly_x", clip.poly_x(F.col(f"seq{m}"), here, spec.poly_x))
    if spec.max_len[m - 1]:
        df = _put(df, m, "max_length", clip.max_length(here, spec.max_len[m - 1]))
    return df


def _names(df: DataFrame, spec: Spec, mates: tuple[int, ...]) -> DataFrame:
    """Names with the UMI, which is read before any clip; a read too short for it is an error."""
    umi = None
    if spec.umi_location in ("read1", "read2", "per_read"):
        parts = []
        for m in [x for x in mates if spec.umi_bases(x)]:
            seq, at = F.col(f"raw_seq{m}" if f"raw_seq{m}" in df.columns else f"seq{m}"), spec.layout.prefix(m)
            short = F.raise_error(F.lit(f"R{m} is too short for its structure, UMI and skip"))
            parts.append(F.when(F.length(seq) < at + spec.umi_bases(m), short).otherwise(F.substring(seq, at + 1, spec.umi_length)))
        umi = F.concat_ws("_", *parts)
    elif spec.umi_location:
        one, two = dna.index_of(F.col("id1")), dna.index_of(F.col(f"id{mates[-1]}"), second=True)
        umi = {"index1": one, "index2": two, "per_index": F.concat_ws("_", one, two) if len(mates) == 2 else one}[spec.umi_location]
    for m in mates:
        name = F.col(f"id{m}")
        if spec.fix_mgi:
            name = dna.fix_mgi_id(name)
        if umi is not None:
            name = dna.umi_name(name, umi, spec.umi_prefix, spec.umi_delimiter)
        df = df.withColumn(f"id{m}", name)
    return df


def _pair_bounds(df: DataFrame, spec: Spec, own: dict[int, list]) -> DataFrame:
    """Overlap-confirmed adapter bounds.

    A mate may end at the insert plus what was clipped in front of the other mate (or where a one-gap
    overlap puts it): if it has a full adapter and any signature begins there, or none and any
    partial one does, or neither and the overlap may decide alone.  Pairs without a unique
    overlap keep their bases.
    """
    df = overlaps(df, seqs=("_part1", "_part2"), gap=spec.gap_overlap, fronts=("_front1", "_front2"), where="_able", **_limits(spec))
    for m, other in ((1, 2), (2, 1)):
        part, full, partial = F.col(f"_part{m}"), F.col(f"full{m}"), F.col(f"partial{m}")
        at = F.when(F.col("overlap_status") == "unique", F.col("insert_length") + F.col(f"_front{other}")).when(F.col("overlap_status") == "none", F.col(f"gap_end{m}"))
        df = df.withColumn(f"_end{m}", at)
        here = F.col(f"_end{m}")
        whole = reduce(lambda a, b: a | b, (x.full_at(part, here) for x in own[m]), F.lit(False))
        end = reduce(lambda a, b: a | b, (x.partial_at(part, here) for x in own[m]), F.lit(False))
        alone = full.isNull() & partial.isNull() & F.lit(not spec.require_adapter) & (here < F.length(part))
        kind = F.when(here.isNull() | ~F.col("_able"), None).when(full.isNotNull() & whole, "full").when(full.isNull() & end, "partial").when(alone, "overlap")
        df = _adapter_cut(df, m, spec, kind, here).drop(f"_end{m}")
    evidence = [F.col(f"{k}{m}").isNotNull() for k in ("full", "partial") for m in (1, 2)]
    asked = F.col("_able") & reduce(lambda a, b: a | b, evidence, F.lit(not spec.require_adapter))
    cut, unique = F.col("adapter1").isNotNull() | F.col("adapter2").isNotNull(), F.col("overlap_status") == "unique"
    told = F.when(cut & unique, "confirmed").when(cut, "gapped").when(F.col("overlap_status") == "ambiguous", "ambiguous").otherwise("unconfirmed")
    return df.withColumn("pair_overlap", F.when(asked, told))


def records(table: DataFrame, spec: Spec) -> DataFrame:
    """target, stream (R1, R2, single or merged), read_idx, stream_order (within a fragment), id, seq, qual of everything retained.

    Unassigned fragments come untrimmed and only if asked for.
    """
    mates = (1, 2) if "seq2" in table.columns else (1,)
    assigned = F.col("status") == "assigned"
    target = F.when(assigned, F.col("sample")).otherwise("unassigned")
    merged = F.col("merged_seq").isNotNull() if "merged_seq" in table.columns else F.lit(False)
    names = {1: "R1", 2: "R2"} if len(mates) == 2 else {1: "single"}
    rows = [F.when(~merged | ~assigned, F.struct(F.lit(names[m]).alias("stream"), F.col(f"id{m}").alias("id"), F.when(assigned, F.col(f"seq{m}")).otherwise(F.col(f"raw_seq{m}")).alias("seq"), F.when(assigned, F.col(f"qual{m}")).otherwise(F.col(f"raw_qual{m}")).alias("qual"))) for m in mates]
    if spec.merge and len(mates) == 2:
        rows.append(F.when(merged & assigned, F.struct(F.lit("merged").alias("stream"), F.col("merged_id").alias("id"), F.col("merged_seq").alias("seq"), F.col("merged_qual").alias("qual"))))
    if spec.include_unmerged and spec.merge and len(mates) == 2:  # R1 and R2 in turn among the merged ones
        rows += [F.when(assigned, r.withField("stream", F.lit("merged"))) for r in rows[:2]]
    rows = [F.when(r["id"].isNotNull(), r) for r in rows]  # an orphan has one mate
    kept = table.where(~F.col("rejected")).where(assigned | F.lit(spec.write_unassigned))
    return kept.select(target.alias("target"), "read_idx", F.posexplode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("stream_order", "x")).select("target", "read_idx", "stream_order", "x.*")


def failed_records(table: DataFrame) -> DataFrame:
    """stream (failed, or unpaired for the mate that passes), mate (0 for a merged read), read_idx, id, seq, qual of
    rejected fragments."""
    mates = (1, 2) if "seq2" in table.columns else (1,)
    rows = [F.struct(F.when(F.col(f"failed{m}"), "failed").otherwise("unpaired").alias("stream"), F.lit(m).alias("mate"), F.col(f"id{m}").alias("id"), F.col(f"seq{m}").alias("seq"), F.col(f"qual{m}").alias("qual")) for m in mates]
    rows = F.array(*rows)
    if "merged_seq" in table.columns:
        whole = F.struct(F.lit("failed").alias("stream"), F.lit(0).alias("mate"), *(F.col(f"merged_{c}").alias(c) for c in ("id", "seq", "qual")))
        rows = F.when(F.col("merged_seq").isNotNull(), F.array(whole)).otherwise(rows)
    return table.where("rejected").select("read_idx", F.explode(rows).alias("x")).select("read_idx", "x.*")


def summary(table: DataFrame) -> DataFrame:
    """One row of counters over the fragment table."""
    mates = [m for m in (1, 2) if f"seq{m}" in table.columns]
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = {s: count(F.col("status") == s).alias(s) for s in ("assigned", "unmatched", "unrouted")}
    sums |= {f"orphan_r{m}": count((F.col("status") == "orphan") & F.col(f"seq{m}").isNotNull()).alias(f"orphan_r{m}") for m in mates if len(mates) == 2}
    extra = [count(F.col("corrected")).alias("corrected_bases")] if "corrected" in table.columns else []
    extra += [count(F.col("merged_seq").isNotNull()).alias("merged")] if "merged_seq" in table.columns else []
    for m in mates:
        extra += [count(F.col(f"adapter{m}") == k).alias(f"{k}_adapters_r{m}") for k in ("full", "partial", "overlap")]
        extra += [count(F.when(F.col(f"adapter{m}") == k, F.col(f"adapter_removed{m}"))).alias(f"{k}_bases_r{m}") for k in ("full", "partial", "overlap")]
        extra.append(count(F.col(f"dimer{m}")).alias(f"dimers_r{m}"))
        extra += [count(F.col(f"{s}_removed{m}")).alias(f"{s}_bases_r{m}") for s in ("proximal", "quality", "poly_g", "poly_x", "max_length") if f"{s}_removed{m}" in table.columns]
    reasons = (count(F.col(r)).alias(r) for r in filters.REASONS)
    return table.agg(F.count("*").alias("processed"), *sums.values(), count(F.col("is_short")).alias("short_reads"), count(~F.col("rejected")).alias("retained"), *reasons, *extra)


def preprocessing_table(table: DataFrame) -> DataFrame:
    """Metric, Count: the counters as rows, in the order of summary's columns."""
    one = summary(table)
    pairs = F.array(*(F.struct(F.lit(c).alias("Metric"), F.col(c).cast("long").alias("Count")) for c in one.columns))
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def sample_table(table: DataFrame, spec: Spec) -> DataFrame:
    """A row for each sample of the sheet: fragments, records and bases retained by stream, shares and status."""
    paired = "seq2" in table.columns
    good = table.where("status = 'assigned' and not rejected")
    merged = F.col("merged_seq").isNotNull() if "merged_seq" in table.columns else F.lit(False)
    if paired:
        parts = {"single": F.when(merged, F.length("merged_seq") if "merged_seq" in table.columns else F.lit(0)), "r1": F.when(~merged, F.length("seq1")), "r2": F.when(~merged, F.length("seq2"))}
    else:
        parts = {"single": F.length("seq1"), "r1": F.lit(None).cast("int"), "r2": F.lit(None).cast("int")}
    counts = good.groupBy("sample").agg(
        F.count("*").alias("fragments"),
        *(F.count(c).alias(f"{n}_records") for n, c in parts.items()),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(f"assigned_bases_{n}") for n, c in parts.items()),
    )
    samples = table.sparkSession.createDataFrame([(r["Sample"],) for r in spec.sheet], "sample string")
    columns = [f"{n}_records" for n in parts] + [f"assigned_bases_{n}" for n in parts]
    return metrics.sample_metrics(counts, samples, spec.low_fraction, columns).withColumnsRenamed({"fragments": "assigned_fragments", "fraction_of_assigned": "fraction_of_assigned_fragments"})


def expected_files(spec: Spec, paired: bool) -> tuple[tuple[str, str], ...]:
    """(target, stream) of the files that a run makes even if nothing comes into them."""
    streams = [("merged",)] * (spec.merge and paired) + ([("R1",), ("R2",)] if paired else [("single",)])
    targets = [r["Sample"] for r in spec.sheet] or ["trimmed"]
    return tuple((t, s) for t in targets + ["unassigned"] * spec.write_unassigned for (s,) in streams if not (t == "unassigned" and s == "merged"))


def demux(reads: DataFrame, spec: Spec, output: str, compression: str = "gzip", named: bool = False, per_part: int = 0) -> DataFrame:
    """Write every sample's reads and the reports under output, and return the summary row.

    Reads go to folders by target and stream, or, if named, to one file for each of them (or numbered files
    of per_part records).  output must not exist.  The fragment table is written once to the shared folder, from
    which sinks read it, so executors may be lost; one aggregation gives the ledger that all reports
    come from (accounting), and sums that don't agree are an error.  report_details adds lengths,
    qualities and cycles to the report, by one more aggregation.
    """
    spark = reads.sparkSession
    paths = [scratch.shared_path(spark, x) for x in ("fragments", "ledger", "spectrum")]
    kept = lambda df, path: (df.write.parquet(path), spark.read.schema(df.schema).parquet(path))[1]
    try:
        table = kept(fragments(reads, spec), paths[0])
        if named or per_part:
            files = write_files(records(table, spec), f"{output}/reads", compression, per_part, expected_files(spec, "seq2" in table.columns))
            mate = "_R[12]" if "seq2" in table.columns else ""
            apart = F.col("file").rlike(rf"^(\d{{4,}}\.)?unassigned{mate}\.fastq(\.gz)?$")
            sums = files.agg(*(F.coalesce(F.sum(F.when(c, F.col("records"))), F.lit(0)).alias(k) for k, c in (("unassigned", apart), ("assigned", ~apart)))).first().asDict()
        else:
            told, apart = Observation(), F.col("target") == "unassigned"
            counts = [F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in (("unassigned", apart), ("assigned", ~apart))]
            write_fastq(records(table, spec), f"{output}/reads", "target", "stream", compression=compression, told=(told, *counts))
            sums = {k: told.get.get(k) or 0 for k in ("unassigned", "assigned")}
        if spec.write_failed:
            write_fastq(failed_records(table), f"{output}/failed", "stream", "mate", compression=compression)
        book = kept(accounting.ledger(table, spec.layout), paths[1])
        seen = kept(accounting.spectrum(table, spec.layout), paths[2]) if spec.report_details else None
        totals = accounting.totals(book)
        row = totals.first().asDict()
        one = lambda df, name: df.coalesce(1).write.option("sep", "\t").option("header", True).csv(f"{output}/{name}")
        out = spark.createDataFrame([row], totals.schema)
        out.coalesce(1).write.json(f"{output}/summary")
        one(accounting.metric_rows(book), "preprocessing")
        stats = accounting.section_rows(book)
        one(stats.where("phase = 'before'").drop("phase"), "fastq_stats")
        one(stats.where("phase = 'after'").drop("phase"), "retained_fastq_stats")
        if spec.layout.symbols:
            raw = {f"{c}{m}": F.col(f"raw_{c}{m}") for c in ("seq", "qual") for m in (1, 2) if f"raw_seq{m}" in table.columns}
            one(metrics.segment_stats(table.withColumns(raw), spec.layout), "barcode_stats")
        by_sample = accounting.sample_rows(book, accounting.samples_of(spark, [r["Sample"] for r in spec.sheet] or ["trimmed"]), spec.low_fraction)
        if spec.sheet:
            one(by_sample, "sample_metrics")
        document = accounting.report(book, seen, spec.report_title)
        for name, text in (("report_json", json.dumps(document)), ("report_html", html_report(document, spec.report_title))):
            spark.createDataFrame([(text,)], "page string").coalesce(1).write.text(f"{output}/{name}")
        if spec.include_unmerged and spec.merge:  # R1 and R2 stand among the merged ones, too
            sums["assigned"] -= row_copies(row)
        checks = accounting.reconciled(book, by_sample, spec.write_unassigned, sums)
        one(checks, "reconciliation")
        if bad := checks.where("told <> found").collect():
            raise RuntimeError("; ".join(f"{r['check']}: {r['told']} and {r['found']}" for r in bad))
        return out
    finally:
        for path in paths:
            scratch.delete(spark, path)


def row_copies(row: dict) -> int:
    """Records that a run with include_unmerged writes once more: both mates of assigned pairs that stay unmerged."""
    return 2 * (row["assigned"] - row["assigned_rejected"] - row["merged"])


def trim(reads: DataFrame, spec: Spec, output: str, compression: str = "gzip", **options) -> DataFrame:
    """demux without barcodes: all fragments belong to one sample, trimmed."""
    if spec.barcodes:
        raise ValueError("trim takes no barcodes")
    return demux(reads, spec, output, compression, **options)


def spark_session(cores: int = 8) -> SparkSession:
    return SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g")).getOrCreate()
