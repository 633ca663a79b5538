"""Document fingerprints: Order MinHash with one permutation, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a k-mer, k-mers of a tuple, and tuples of a fingerprint (2 ** BIN_BITS).
K, TUPLE, BIN_BITS = 3, 2, 6
#: A word is cut into tokens of so many code points at most.
TOKEN_CHARS = 16
#: Bits of a k-mer's place; texts of more tokens than 2 ** POS_BITS keep their order within stretches of that.
POS_BITS = 23
_LOW = (1 << POS_BITS) - 1
#: An id that fills several of the ranges into which ids are dealt is dealt on by a hash of the text, in so many.
_SUBS = 16


def _packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_LOW)).bitwiseOR(place.cast("long").bitwiseAND(F.lit(_LOW)))


def _hash(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_LOW))


def _longs() -> Column:
    return F.array().cast("array<bigint>")


def _indexes(array: str) -> Column:
    n = F.size(array)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, size: int = TUPLE, bin_bits: int = BIN_BITS) -> DataFrame:
    """df plus out: array<bigint>, an entry (bin << 32 | hash of its tuple) for each bin that has k-mers.

    Tokens are pieces of words of up to TOKEN_CHARS code points.  k-mers of tokens, told apart by the
    number of times they occurred before, are hashed once and dealt into bins by the first bits of
    the hash (the permutation is the same for all bins, so a text is hashed once whatever their
    number).  A bin's tuple is its `size` smallest k-mers in the order of the text.  Null or empty
    texts, and those of white space, have no entries; fewer than k tokens are one k-mer.

    Everything happens in the row; every array below is used twice where it is built upon, so that
    Spark computes it once a row.
    """
    if not 0 < bin_bits <= 16:
        raise ValueError("bins: 1 to 16 bits")

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, 64 - bin_bits) + F.lit(1 << (bin_bits - 1))

    before = df.columns
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^ \\t-\\r]{{1,{TOKEN_CHARS}}}"), F.lit(0))
    df = df.withColumn("_tokens", tokens)
    n = F.size("_tokens")
    runs = F.arrays_zip(*(F.slice("_tokens", i + 1, F.greatest(n - k + 1, F.lit(0))).alias(f"t{i}") for i in range(k)))
    kmers = F.when(n >= k, F.transform(runs, lambda x, i: _packed(F.xxhash64(x), i))).when(n > 0, F.array(_packed(F.xxhash64("_tokens"), F.lit(0)))).otherwise(_longs())
    df = df.withColumn("_kmers", F.sort_array(kmers)).drop("_tokens")

    def again(array: str, x: Column, i: Column) -> Column:
        return F.coalesce(_hash(F.get(array, i - 1)) == _hash(x), F.lit(False))

    first = F.filter("_kmers", lambda x, i: ~again("_kmers", x, i))
    df = df.withColumns({"_first": F.transform(first, lambda x: _packed(F.xxhash64(_hash(x), F.lit(0)), x)), "_later": F.filter("_kmers", lambda x, i: again("_kmers", x, i))}).drop("_kmers")
    starts = F.filter(_indexes("_later"), lambda i: ~again("_later", F.get("_later", i), i))
    df = df.withColumn("_starts", starts)

    def numbered(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get("_starts", i + 1), F.size("_later"))
        return F.transform(F.slice("_later", start + 1, end - start), lambda x, o: _packed(F.xxhash64(_hash(x), o + 1), x))

    everything = F.when(F.size("_later") == 0, F.col("_first")).otherwise(F.concat("_first", F.flatten(F.transform("_starts", numbered))))
    df = df.withColumn("_all", F.sort_array(everything)).drop("_first", "_later", "_starts")
    df = df.withColumn("_least", F.filter("_all", lambda x, i: F.coalesce(bin_of(F.get("_all", i - size)) != bin_of(x), F.lit(True)))).drop("_all")

    def entry(i: Column) -> Column:
        own = F.filter(F.slice("_least", i + 1, size), lambda y: bin_of(y) == bin_of(F.get("_least", i)))
        in_order = F.sort_array(F.transform(own, lambda y: F.shiftleft(y.bitwiseAND(F.lit(_LOW)), 40).bitwiseOR(F.shiftrightunsigned(y, 24))))
        tuple_ = F.xxhash64(F.transform(in_order, lambda y: y.bitwiseAND(F.lit((1 << 40) - 1))))
        return F.shiftleft(bin_of(F.get("_least", i)), 32).bitwiseOR(tuple_.bitwiseAND(F.lit((1 << 32) - 1)))

    heads = F.filter(_indexes("_least"), lambda i: F.coalesce(bin_of(F.get("_least", i - 1)) != bin_of(F.get("_least", i)), F.lit(True)))
    return df.withColumn(out, F.transform(heads, entry)).select(*before, out)


def printed(sketch: Column) -> Column:
    """A sketch as text: ten hexadecimal digits for each entry, of which the first two are its bin."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of the bins that either sketch fills in which both have the same tuple; 1 for two empty ones."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(bins == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / bins)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row of docs (doc_id, text); see with_sketch for odd texts."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_sketch(own, "text", "sketch").select("doc_id", F.length("text").cast("long").alias("n_chars"), printed(F.col("sketch")).alias("fingerprint"))


def _range_of(value: Column, bounds: list[int], low: int, high: int) -> Column:
    """How many of the ascending bounds[low:high] are above value, as a balanced tree of comparisons."""
    if low == high:
        return F.lit(len(bounds) - low)
    mid = (low + high) // 2
    return F.when(value < bounds[mid], _range_of(value, bounds, low, mid)).otherwise(_range_of(value, bounds, mid + 1, high))


def followed(rows: DataFrame, take: list[str]) -> DataFrame:
    """rows (doc_id, text, ...) plus next_<c> for each c of take, of the next row by descending doc_id (null
    ids last, ties by a hash of the text); the first row follows the last.

    Rows are dealt into ranges of ids at quantiles of all ids, once, and each range takes the first
    row of the next range as a guest, so no task sees more than its range.  An id that holds
    several quantiles, and the missing one, is dealt on by the hash that orders its rows.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("b")).first()["b"] or []
    bounds, heavy = sorted(set(found)), sorted({b for b in found if found.count(b) > 1})
    rank = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(_range_of(F.col("doc_id"), bounds, 0, len(bounds)))
    tie = F.xxhash64("text")
    split = F.col("doc_id").isNull() | F.col("doc_id").isin(heavy) if heavy else F.col("doc_id").isNull()
    place = rank * (2 * _SUBS) + F.when(split, F.shiftright(F.col("_tie"), 60) + _SUBS).otherwise(0)
    # a heavy id is a bound, so it is the smallest of its range and its pieces come last there
    placed = rows.withColumns({"_tie": tie, "_down": -F.col("doc_id")}).withColumn("_place", place.cast("long"))
    heads = placed.groupBy("_place").agg(F.min(F.struct("_down", "_tie")).alias("h"))
    back = F.coalesce(F.lag("_place").over(Window.orderBy("_place")), F.max("_place").over(Window.partitionBy()))
    heads = heads.select(F.col("_place").alias("_p"), "h", back.alias("_guest_of"))  # a row a range: a bounded number
    is_head = (F.col("_place") == F.col("_p")) & F.col("_down").eqNullSafe(F.col("h._down")) & (F.col("_tie") == F.col("h._tie"))
    own = F.struct(F.col("_place").alias("place"), F.lit(0).alias("guest"))
    both = F.when(F.col("_p").isNotNull(), F.array(own, F.struct(F.col("_guest_of").alias("place"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    dealt = placed.join(F.broadcast(heads), is_head, "left").withColumn("_at", F.explode(both)).select(*rows.columns, "_down", "_tie", "_at.place", "_at.guest")
    after = Window.partitionBy("place").orderBy("guest", "_down", "_tie")
    return dealt.select(*rows.columns, "guest", *(F.lead(c).over(after).alias(f"next_{c}") for c in take)).where("guest = 0").drop("guest")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row
    of docs (doc_id, text).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next row's text.  A text's sketch is made where it is read; it, the text and the id are
    shuffled once, and the edited text's sketch is made behind that.

    Null text: empty; two empty sketches are alike (1.0), an empty and another are not (0.0).  Null
    and repeated ids: see followed; rows alike in id and text follow each other.  A row alone is
    followed by itself.  Texts are processed whole, in their row's memory.  Other columns are ignored;
    an empty table gives no rows.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = followed(with_sketch(own, "text", "sketch"), ["text", "sketch"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    made = with_sketch(pairs.withColumn("edited", edited).withColumn("n_chars", n.cast("long")).drop("text", "next_text"), "edited", "edited_sketch")
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(a).alias("fingerprint"), printed(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"),
    )
