"""Column builders over bases, qualities and read names; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPLEMENT = ("ACGTacgt", "TGCAtgca")


def revcomp(seq: Column) -> Column:
    """Reverse complement; case stays, other characters stay."""
    return F.reverse(F.translate(seq, *COMPLEMENT))


def consensus_complement(seq: Column) -> Column:
    """Complement in upper case, with every other character as N."""
    return F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), *COMPLEMENT)


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of seq are among letters, in either case."""
    up = F.upper(seq)
    return F.length(up) - F.length(F.translate(up, letters, ""))


def gc_count(seq: Column) -> Column:
    return count_of(seq, "GC")


def n_count(seq: Column) -> Column:
    return count_of(seq, "N")


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def phred(qual: Column) -> Column:
    """array<int> of Phred+33 qualities."""
    return F.transform(letters(qual), lambda c: F.ascii(c) - 33)


def quality_sum(qual: Column) -> Column:
    """Summed Phred+33 qualities, a bit of them at a time; characters that are none are summed one by one."""
    usual = [chr(c) for c in range(33, 127)]
    bits = [(1 << b, "".join(c for c in usual if ord(c) - 33 >> b & 1)) for b in range(7)]
    counted = sum(((F.length(qual) - F.length(F.translate(qual, those, ""))) * n for n, those in bits), F.lit(0))
    odd = F.length(F.translate(qual, "".join(usual), "")) > 0
    return F.when(odd, F.aggregate(phred(qual), F.lit(0), lambda s, q: s + q)).otherwise(counted)


def low_quality_count(qual: Column, threshold: int) -> Column:
    low = "".join(chr(33 + q) for q in range(threshold))
    return F.length(qual) - F.length(F.translate(qual, low, "")) if low else F.lit(0)


def at_least_quality(qual: Column, threshold: int) -> Column:
    return F.length(qual) - low_quality_count(qual, threshold)


def hamming(a: Column, b: Column) -> Column:
    """Places at which equally long strings differ (case-insensitive); null if lengths differ."""
    x, y = letters(F.upper(a)), letters(F.upper(b))
    return F.when(F.length(a) == F.length(b), F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda d: d)))


def changes(seq: Column) -> Column:
    """Adjacent pairs of different bases."""
    n = F.length(seq)
    return hamming(F.substring(seq, F.lit(1), F.greatest(n - 1, F.lit(0))), F.substring(seq, F.lit(2), n))


def is_low_complexity(seq: Column, percent: float = 30) -> Column:
    return (F.length(seq) < 2) | (changes(seq) * 100 < percent * (F.length(seq) - 1))


def is_informative(seq: Column) -> Column:
    """At least three different bases, none over three quarters, and six different dinucleotides."""
    up = F.upper(seq)
    n = F.length(up)
    counts = [count_of(up, b) for b in "ACGT"]
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(up, i, F.lit(2))))
    kinds = sum(((c > 0).cast("int") for c in counts), F.lit(0))
    return F.coalesce(F.when(n >= 2, (kinds >= 3) & (F.greatest(*counts) * 4 <= n * 3) & (F.size(pairs) >= 6)), F.lit(False))


def core_read_id(name: Column) -> Column:
    """The first token of a read name without /1 or /2."""
    return F.regexp_replace(F.element_at(F.split(name, r"\s"), 1), "/[12]$", "")


#: How names of reads begin that instruments with two colours gave.
TWO_COLOUR = ["FS", "MN", "SH", "NS", "NB", "NDX", "VL", "VH", "A", "NA", "LH"]


def two_colour(name: Column) -> Column:
    """Whether a read is from an instrument that calls G where it sees nothing, so that poly-G is clipped."""
    return name.rlike("^(" + "|".join(TWO_COLOUR) + ")")


def index_of(name: Column, second: bool = False) -> Column:
    """First or second index of a CASAVA name: what stands after the last colon of its last token."""
    tail = F.regexp_extract(F.element_at(F.split(name, r"\s"), -1), r":([^:]*)$", 1)
    parts = F.split(tail, r"\+")
    return F.get(parts, F.lit(1)) if second else F.get(parts, F.lit(0))


def fix_mgi_id(name: Column) -> Column:
    """`/` as `:` in the first token."""
    first = F.element_at(F.split(name, r"\s"), 1)
    return F.concat(F.replace(first, F.lit("/"), F.lit(":")), F.substring(name, F.length(first) + 1, F.length(name)))


def umi_name(name: Column, umi: Column, prefix: str = "", delimiter: str = ":") -> Column:
    """The name with delimiter, prefix and umi after its first token, before a final /1 or /2."""
    first = F.element_at(F.split(name, r"\s"), 1)
    body, mate = F.regexp_replace(first, "/[12]$", ""), F.regexp_extract(first, "(/[12])$", 1)
    tag = F.concat(F.lit(delimiter + (f"{prefix}_" if prefix else "")), umi)
    return F.concat(body, tag, mate, F.substring(name, F.length(first) + 1, F.length(name)))


def phred64_to_33(qual: Column) -> Column:
    """Phred+64 as Phred+33; characters outside 64..126 are an error."""
    old = "".join(map(chr, range(64, 127)))
    new = "".join(chr(c - 31) for c in range(64, 127))
    return F.when(qual.rlike("^[@-~]*$"), F.translate(qual, old, new)).otherwise(F.raise_error(F.lit("quality outside Phred+64")))


def fastq_record(name: Column, seq: Column, qual: Column) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual, F.lit("\n"))


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end], counted from 0."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
