"""The account of a run: one aggregation over the fragment table, from whose few rows all its reports come.

Counts are not observed on the fragments as they pass to a sink: a map stage runs again where its output is lost, and a
range partitioning runs it once more for its samples, and both would count twice.  Only what the last
stage of a write has written is observed there.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import dna
from seqloom.operators import filters, metrics
from seqloom.plans.layout import Layout

KINDS = ("full", "partial", "overlap")
STEPS = ("proximal", "quality", "poly_g", "poly_x", "max_length")
STATS = ("reads", "bases", "min_length", "max_length", "gc", "n", "quality", "q20", "q30")

# The metrics of a run and of each mate in their order, and the sums behind them.
RUN_METRICS = {
    "duplicate_fragments": "duplicate_fragments",
    "merged_fragments": "merged",
    "corrected_bases": "corrected_bases",
    "overlap_confirmed_pairs": "overlap_confirmed",
    "gapped_overlap_pairs": "overlap_gapped",
    "overlap_unconfirmed_pairs": "overlap_unconfirmed",
    "overlap_ambiguous_pairs": "overlap_ambiguous",
    "fragments_processed": "processed",
    "fragments_retained": "retained",
    "fragments_rejected": "rejected",
    "rejected_duplicates": "duplicate",
    "rejected_index": "index_blacklist",
    "rejected_min_length": "too_short",
    "rejected_max_length": "too_long",
    "rejected_low_complexity": "low_complexity",
    "rejected_max_n": "too_many_n",
    "rejected_low_quality_percent": "low_quality",
    "rejected_mean_quality": "low_mean_quality",
}
MATE_METRICS = {
    "overlap_only_reads": "overlap_adapters",
    "overlap_only_bases_removed": "overlap_bases",
    "adapter_dimers": "dimers",
    "full_adapter_reads": "full_adapters",
    "partial_adapter_reads": "partial_adapters",
    "full_adapter_bases_removed": "full_bases",
    "partial_adapter_bases_removed": "partial_bases",
    "proximal_bases_removed": "proximal_bases",
    "quality_global_bases_removed": "quality_bases",
    "poly_g_bases_removed": "poly_g_bases",
    "poly_x_bases_removed": "poly_x_bases",
    "max_length_bases_removed": "max_length_bases",
}


def _mates(columns: list[str], pattern: str) -> list[int]:
    return [m for m in (1, 2) if pattern.format(m) in columns]


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))


def _had(table: DataFrame, name: str, c: Column | None = None) -> Column:
    return (F.col(name) if c is None else c) if name in table.columns else F.lit(0)


def sections(table: DataFrame, layout: Layout | None = None) -> list[tuple[str, str, Column, Column]]:
    """(phase, mate, bases, qualities) of each kind of read that a report tells of.  before: as they came, behind
    the structure that the layout declares, orphans too; after: what is left of pairs and single reads, merged ones
    being reads of their own.  Bases are null in rows that have none of a kind."""
    mates = _mates(table.columns, "seq{}")
    out = []
    for m in mates:
        at = layout.prefix(m) if layout else 0
        out.append(("before", f"R{m}", *(F.expr(f"substring(raw_{c}{m}, {at + 1})") for c in ("seq", "qual"))))
    whole = (F.col("status") != "orphan") & ~F.col("rejected")
    merged = "merged_seq" in table.columns
    alone = whole & F.col("merged_seq").isNull() if merged else whole
    out += [("after", f"R{m}", *(F.when(alone, F.col(f"{c}{m}")) for c in ("seq", "qual"))) for m in mates]
    if merged:
        out.append(("after", "Merged", *(F.when(whole, F.col(f"merged_{c}")) for c in ("seq", "qual"))))
    return out


def ledger(table: DataFrame, layout: Layout | None = None) -> DataFrame:
    """A row for each status, sample and whether filters reject it: fragments, the counts behind all metrics, and the
    sums (or extremes, null if there is none) behind the stats of each section.

    Every column adds up (or is a minimum or maximum), so rows of any grouping, and of parts of the input, merge.
    The table is read once; its rows are combined on their executors before the few groups are shuffled.
    """
    mates = _mates(table.columns, "seq{}")
    out = [F.count("*").alias("fragments"), _sum(F.col("is_short")).alias("short_reads")]
    out.append(_sum(_had(table, "is_duplicate")).alias("duplicate_fragments"))
    out.append(_sum(_had(table, "corrected")).alias("corrected_bases"))
    out.append(_sum(_had(table, "merged_seq", F.col("merged_seq").isNotNull()) if "merged_seq" in table.columns else F.lit(0)).alias("merged"))
    kinds = {"confirmed": ("confirmed", "gapped"), "gapped": ("gapped",), "unconfirmed": ("unconfirmed", "ambiguous"), "ambiguous": ("ambiguous",)}
    for name, of in kinds.items():
        out.append(_sum(F.col("pair_overlap").isin(*of) if "pair_overlap" in table.columns else F.lit(0)).alias(f"overlap_{name}"))
    out += [_sum(F.col(r)).alias(r) for r in filters.REASONS]
    for m in mates:
        for k in KINDS:
            hit = F.col(f"adapter{m}") == k
            out += [_sum(hit).alias(f"{k}_adapters_r{m}"), _sum(F.when(hit, F.col(f"adapter_removed{m}"))).alias(f"{k}_bases_r{m}")]
        out.append(_sum(F.col(f"dimer{m}")).alias(f"dimers_r{m}"))
        out += [_sum(_had(table, f"{s}_removed{m}")).alias(f"{s}_bases_r{m}") for s in STEPS]
    for phase, mate, s, q in sections(table, layout):
        named = dict(zip(STATS, metrics.stats_of(s, q)))
        out += [c.alias(f"{phase}_{mate}_{n}") for n, c in named.items()]
    return table.groupBy("status", "sample", "rejected").agg(*out)


def totals(book: DataFrame) -> DataFrame:
    """One row: the ledger as a whole.  processed, retained and rejected are of pairs and single reads; orphans are
    told by mate, apart."""
    n, status, orphan = F.col("fragments"), F.col("status"), F.col("status") == "orphan"
    mates = _mates(book.columns, "dimers_r{}")
    told = {"processed": ~orphan, "retained": ~orphan & ~F.col("rejected"), "rejected": ~orphan & F.col("rejected")}
    told |= {s: status == s for s in ("assigned", "unmatched", "unrouted")} | {"assigned_rejected": (status == "assigned") & F.col("rejected")}
    out = [_sum(F.when(c, n)).alias(k) for k, c in told.items()]
    if len(mates) == 2:
        out += [_sum(F.when(orphan, F.col(f"before_R{m}_reads"))).alias(f"orphan_r{m}") for m in mates]
    plain = [c for c in book.columns if c not in ("status", "sample", "rejected", "fragments", "merged") and not c.startswith(("before_", "after_"))]
    merged = _sum(F.when(~F.col("rejected"), F.col("merged"))).alias("merged")
    return book.agg(*out, merged, *(_sum(F.col(c)).alias(c) for c in plain))


def metric_rows(book: DataFrame) -> DataFrame:
    """Metric, Count: 18 of the run and 12 of each mate, in their order."""
    named = list(RUN_METRICS.items())
    for m in _mates(book.columns, "dimers_r{}"):
        named += [(f"R{m}_{k}", f"{c}_r{m}") for k, c in MATE_METRICS.items()]
    rows = F.array(*(F.struct(F.lit(k).alias("Metric"), F.col(c).cast("long").alias("Count")) for k, c in named))
    return totals(book).select(F.explode(rows).alias("x")).select("x.*")


def section_rows(book: DataFrame) -> DataFrame:
    """phase, mate, and the FASTQ stats of each section that has reads."""
    names = [c.removesuffix("_reads") for c in book.columns if c.startswith(("before_", "after_")) and c.endswith("_reads")]
    rows = F.array(*(F.struct(F.lit(x.split("_")[0]).alias("phase"), F.lit(x.split("_")[1]).alias("mate"), *(F.col(f"{x}_{s}").alias(s) for s in STATS)) for x in names))
    how = {"min_length": F.min, "max_length": F.max}
    sums = [F.coalesce(how.get(s, F.sum)(s), F.lit(0)).alias(s) for s in STATS]
    each = book.select(F.explode(rows).alias("x")).select("x.*").groupBy("phase", "mate").agg(*sums)
    return metrics.rates(each.where("reads > 0"), "phase", "mate")


def sample_rows(book: DataFrame, samples: DataFrame, low_fraction: float = 0.05) -> DataFrame:
    """A row for each sample: fragments, records and bases retained by stream, shares and status.  samples: sample."""
    paired = len(_mates(book.columns, "dimers_r{}")) == 2
    none = F.lit(0).cast("long")
    of = lambda x, s: F.coalesce(F.sum(f"after_{x}_{s}"), none) if f"after_{x}_{s}" in book.columns else none
    parts = {"single": "Merged", "r1": "R1", "r2": "R2"} if paired else {"single": "R1", "r1": "-", "r2": "-"}
    counts = book.where("status = 'assigned' and not rejected").groupBy("sample").agg(
        F.sum("fragments").alias("fragments"),
        *(of(x, "reads").alias(f"{n}_records") for n, x in parts.items()),
        *(of(x, "bases").alias(f"assigned_bases_{n}") for n, x in parts.items()),
    )
    columns = [f"{n}_records" for n in parts] + [f"assigned_bases_{n}" for n in parts]
    return metrics.sample_metrics(counts, samples, low_fraction, columns).withColumnsRenamed({"fragments": "assigned_fragments", "fraction_of_assigned": "fraction_of_assigned_fragments"})


def reconciled(book: DataFrame, by_sample: DataFrame, write_unassigned: bool, written: dict[str, int]) -> DataFrame:
    """check, told, found: sums that must agree in any whole run.

    classes: fragments processed and those of each class; decisions: retained and rejected ones; samples: what
    assigned fragments remain and the sum over samples; mates: samples (0) whose R1, R2 and merged
    records don't match; unassigned and assigned: records that the sinks wrote (written, by these names; include
    R1 and R2 beside merged reads) and what the ledger expects of them."""
    paired = len(_mates(book.columns, "dimers_r{}")) == 2
    one = totals(book)
    if not paired:
        one = one.withColumns({"orphan_r1": F.lit(0), "orphan_r2": F.lit(0)})
    odd = (F.col("r1_records") != F.col("r2_records")) | (F.col("assigned_fragments") != F.col("r1_records") + F.col("single_records"))
    sums = by_sample.agg(
        _sum(F.col("assigned_fragments")).alias("_fragments"),
        (_sum(odd) if paired else F.lit(0)).alias("_odd"),
        _sum(F.col("single_records") + F.col("r1_records") + F.col("r2_records")).alias("_records"),
    )
    c = F.col
    kept = c("assigned") - c("assigned_rejected")
    apart = (c("retained") - kept) * (2 if paired else 1) + c("orphan_r1") + c("orphan_r2")
    checks = [
        ("classes", c("processed"), c("assigned") + c("unmatched") + c("unrouted")),
        ("decisions", c("processed"), c("retained") + c("rejected")),
        ("samples", kept, c("_fragments")),
        ("mates", F.lit(0), c("_odd")),
        ("unassigned", apart if write_unassigned else F.lit(0), F.lit(written["unassigned"])),
        ("assigned", c("_records"), F.lit(written["assigned"])),
    ]
    rows = F.array(*(F.struct(F.lit(k).alias("check"), a.cast("long").alias("told"), b.cast("long").alias("found")) for k, a, b in checks))
    return one.crossJoin(F.broadcast(sums)).select(F.explode(rows).alias("x")).select("x.*")  # a row with a row


def spectrum(table: DataFrame, layout: Layout | None = None) -> DataFrame:
    """phase, mate, cycle (from 1), base (A, T, C, G, N, other), quality (93 at most), bases.

    One aggregation, bounded by the length of reads whatever their number; cycle_content, quality_histogram and
    length_histogram come from its rows."""
    rows = F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(m).alias("mate"), s.alias("seq"), q.alias("qual")) for p, m, s, q in sections(table, layout)))
    reads = table.select(F.explode(rows).alias("x")).select("x.*").where("seq is not null")
    both = F.arrays_zip(dna.letters(F.upper("seq")).alias("b"), dna.phred(F.col("qual")).alias("q"))
    base = F.when(F.col("x.b").isin(*"ATCGN"), F.col("x.b")).otherwise("other")
    each = reads.select("phase", "mate", F.posexplode(both).alias("i", "x")).select("phase", "mate", (F.col("i") + 1).alias("cycle"), base.alias("base"), F.least("x.q", F.lit(93)).alias("quality"))
    return each.groupBy("phase", "mate", "cycle", "base", "quality").agg(F.count("*").alias("bases"))


def cycle_content(seen: DataFrame) -> DataFrame:
    """phase, mate, cycle, base, bases, quality_sum of a spectrum."""
    return seen.groupBy("phase", "mate", "cycle", "base").agg(F.sum("bases").alias("bases"), F.sum(F.col("bases") * F.col("quality")).alias("quality_sum"))


def quality_histogram(seen: DataFrame) -> DataFrame:
    """phase, mate, quality, bases of a spectrum."""
    return seen.groupBy("phase", "mate", "quality").agg(F.sum("bases").alias("bases"))


def lengths(table: DataFrame, layout: Layout | None = None) -> DataFrame:
    """phase, mate, length, reads: length_histogram without a spectrum, where nothing else of one is asked for.

    A row a read and section is counted on its executor at once; neither bases nor qualities are looked at."""
    rows = F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(m).alias("mate"), F.length(s).alias("length")) for p, m, s, _ in sections(table, layout)))
    reads = table.select(F.explode(rows).alias("x")).select("x.*").where("length is not null")
    return reads.groupBy("phase", "mate", "length").agg(F.count("*").alias("reads"))


def length_histogram(seen: DataFrame, stats: DataFrame) -> DataFrame:
    """phase, mate, length, reads of a spectrum and its section_rows: reads of length n are those that have a base n
    and no base n + 1, and all that have no first base are of length 0."""
    keys = ["phase", "mate"]
    deep = seen.groupBy(*keys, "cycle").agg(F.sum("bases").alias("deep"))
    whole = stats.select(*keys, F.lit(0).alias("cycle"), F.col("reads").alias("deep"))
    here = deep.unionByName(whole).withColumn("end", F.explode(F.array(F.struct(F.col("cycle").alias("at"), F.col("deep").alias("n")), F.struct((F.col("cycle") - 1).alias("at"), (-F.col("deep")).alias("n")))))
    ends = here.where("end.at >= 0").groupBy(*keys, F.col("end.at").alias("length")).agg(F.sum("end.n").alias("reads"))
    return ends.where("reads > 0")


def report(book: DataFrame, seen: DataFrame | None, title: str) -> dict:
    """The run as a document: processing, duplication, trimming, filtering_result, and for each section its summary
    and, with a spectrum, its lengths, qualities and cycles.  Holds a row a section and, with a spectrum, one a
    cycle and base, so its size is bounded by the length of reads."""
    one = totals(book).first().asDict()
    mates = _mates(book.columns, "dimers_r{}")
    by_mate = lambda name: [one[f"{name}_r{m}"] for m in mates]
    share = lambda a, b: a / b if b else 0.0
    out: dict = {"title": title, "schema_version": 1}
    out["processing"] = {"fragments_processed": one["processed"], "fragments_retained": one["retained"], "fragments_rejected": one["rejected"], "merged_fragments": one["merged"], "corrected_bases": one["corrected_bases"], "orphans": [one.get(f"orphan_r{m}", 0) for m in mates]}
    out["duplication"] = {"duplicate_fragments": one["duplicate_fragments"], "rate": share(one["duplicate_fragments"], one["processed"])}
    out["trimming"] = {k: by_mate(c) for k, c in MATE_METRICS.items()} | {k: one[c] for k, c in RUN_METRICS.items() if k.endswith("_pairs")}
    out["filtering_result"] = {r: one[r] for r in filters.REASONS}
    stats = section_rows(book)
    for row in stats.orderBy("phase", "mate").collect():
        d = row.asDict()
        out[_section(d.pop("phase"), d.pop("mate"))] = {"summary": d}
    if seen is not None:
        for r in length_histogram(seen, stats).orderBy("phase", "mate", "length").collect():
            out[_section(r["phase"], r["mate"])].setdefault("length_histogram", []).append([r["length"], r["reads"]])
        for r in quality_histogram(seen).orderBy("phase", "mate", "quality").collect():
            out[_section(r["phase"], r["mate"])].setdefault("quality_histogram", []).append([r["quality"], r["bases"]])
        for r in cycle_content(seen).orderBy("phase", "mate", "base", "cycle").collect():
            curves = out[_section(r["phase"], r["mate"])].setdefault("cycles", {})
            curves.setdefault(r["base"], []).append([r["cycle"], r["bases"], round(r["quality_sum"] / r["bases"], 4)])
    return out


def _section(phase: str, mate: str) -> str:
    return f"{ {'R1': 'read1', 'R2': 'read2', 'Merged': 'merged'}[mate] }_{phase}_filtering"


def html_report(document: dict, title: str = "Read report") -> str:
    """A page with the document, both as a table of its summaries and whole, as JSON that a page can hold."""
    plain = lambda text: str(text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")
    data = json.dumps(document, default=str)
    for a in "&<>":
        data = data.replace(a, f"\\u{ord(a):04x}")
    parts = [f"<h1>{plain(title)}</h1>"]
    for name, value in document.items():
        if not isinstance(value, dict):
            parts.append(f"<p>{plain(name)}: {plain(value)}</p>")
            continue
        cells = value.get("summary", value)
        rows = "".join(f"<tr><th>{plain(k)}</th><td>{plain(v)}</td></tr>" for k, v in cells.items())
        parts.append(f"<h2>{plain(name)}</h2><table>{rows}</table>")
    body = "".join(parts)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{plain(title)}</title></head><body>{body}<script type='application/json' id='report'>{data}</script></body></html>"


def samples_of(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "sample string")
