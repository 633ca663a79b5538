"""Benchmark decontamination: spaced seeds join test and training texts, overlaps are verified."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import among, keep, only_kept, row_key, small

#: Words under a 1 are hashed, words under a 0 may differ.
MASKS = ("1101011", "1110011")
#: An overlap is any run of so many aligned words of which this share is equal.
WINDOW, SHARE = 13, 0.8
#: Slots of the map of the benchmark's places: eight for each, within these powers of two.
SLOT_BITS = (12, 22)


def tokens(text: Column) -> Column:
    """Lower-case words; white space becomes spaces first, as a split at one character needs no regex."""
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", F.lower(text))
    return F.array_remove(F.split(plain, " "), "")


def _places(df: DataFrame, masks: tuple[str, ...], keys: list[str], at: str) -> DataFrame:
    """(keys, at, w0, w1, ...): a row for each place that a mask fits, with the words that some mask hashes."""
    span = len(masks[0])
    used = [i for i in range(span) if any(m[i] == "1" for m in masks)]
    n = F.greatest(F.size("words") - span + 1, F.lit(0))
    shifted = F.arrays_zip(*(F.slice("words", i + 1, n).alias(f"w{i}") for i in used))
    return df.where(F.size("words") >= span).select(*keys, F.posexplode(shifted).alias(at, "w")).select(*keys, at, *(F.col(f"w.w{i}").alias(f"w{i}") for i in used))


def _hashed(mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *(F.col(f"w{i}") for i, c in enumerate(mask) if c == "1"))


def _seeds(places: DataFrame, masks: tuple[str, ...], keys: list[str]) -> DataFrame:
    """(keys, seed): a row for each place and mask."""
    return places.select(*keys, F.explode(F.array(*map(_hashed, masks))).alias("seed"))


def _core(masks: tuple[str, ...]) -> str:
    """The words that every mask hashes, as a mask."""
    return "".join("1" if set(c) == {"1"} else "0" for c in zip(*masks))


def masks_for(size: int, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE) -> tuple[str, ...]:
    """Masks of which one fits every overlap of an item of so many words: those given, if they do, else all that leave
    out as many of a few blocks of the run as it may have words that differ."""
    run = min(window, size)
    differ = run - ceil(run * share)

    def fits(bad: tuple[int, ...]) -> bool:
        return any(all(m[p - at] == "0" for p in bad if at <= p < at + len(m)) for m in masks for at in range(run - len(m) + 1))

    if all(map(fits, combinations(range(run), differ))):
        return masks
    blocks = min(run, differ + 3) if differ else 1
    return tuple("".join("0" if p * blocks // run in out else "1" for p in range(run)) for out in combinations(range(blocks), differ))


def _taken(places: DataFrame, masks: tuple[str, ...]) -> Column:
    """A test that passes every place whose words under some mask are in places (a kept table), and few others; one
    test of the words that all masks hash does, where there are any."""
    core = _core(masks)
    return reduce(Column.__or__, (_slotted(places, m) for m in ((core,) if "1" in core else masks)))


def _slotted(places: DataFrame, mask: str) -> Column:
    """A test of the words under one mask: a byte for each slot as a literal, so most places of texts go before any join."""
    bits = min(max(SLOT_BITS[0], (8 * places.count()).bit_length()), SLOT_BITS[1])

    def slot(hashed: Column) -> Column:
        return F.shiftrightunsigned(hashed, 64 - bits).cast("int")

    flags = bytearray(1 << bits)
    for r in places.select(slot(_hashed(mask)).alias("slot")).distinct().toLocalIterator():
        flags[r["slot"]] = 1
    return F.substring(F.lit(bytes(flags)), slot(_hashed(mask)) + 1, F.lit(1)) == F.lit(b"\x01")


def _seed_hits(items: DataFrame, texts: DataFrame, masks: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(seed, item, item_at, n_items) of items, and (k1, k2, at, seed) of the texts' places that hold one."""
    known = keep(_places(items.withColumnRenamed("item_words", "words"), masks, ["item"], "item_at"))
    seeds = keep(_seeds(known, masks, ["item", "item_at"]).distinct())
    counted = keep(seeds.join(seeds.groupBy("seed").agg(F.count_distinct("item").alias("n_items")), "seed"))
    places = _places(texts, masks, ["k1", "k2"], "at").where(_taken(known, masks))
    own = small(keep(counted.select("seed").distinct()))
    return counted, _seeds(places, masks, ["k1", "k2", "at"]).join(own, "seed", "left_semi")


def _overlaps(hits: DataFrame, texts: DataFrame, items: DataFrame, window: int, share: float) -> DataFrame:
    """doc_id, k1, k2, item, start, matched, item_words, n_items: the hits (k1, k2, item, start, n_items)
    around which the words of text and item agree."""
    found = among(texts, keep(hits.select("k1", "k2").distinct()), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    pairs = found.join(hits, ["k1", "k2"]).join(small(items), "item")
    equal = F.filter(
        F.sequence(F.lit(0), F.size("item_words") - 1),
        lambda j: F.coalesce(F.when(F.col("start") + j >= 0, F.get("words", F.col("start") + j)) == F.get("item_words", j), F.lit(False)),
    )
    run = F.least(F.lit(window), F.size("item_words"))
    need = F.ceil(run * F.lit(share)).cast("int")
    dense = F.exists(
        F.when(F.size("equal") >= need, F.sequence(F.lit(0), F.size("equal") - need)).otherwise(F.array().cast("array<int>")),
        lambda p: F.get("equal", p + need - 1) - F.get("equal", p) < run,
    )
    kept = pairs.withColumn("equal", equal).where(dense)
    return kept.select("doc_id", "k1", "k2", "item", "start", F.size("equal").alias("matched"), F.size("item_words").alias("item_words"), "n_items")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """What contamination gives, with k1 and k2, the key of the row's doc_id and text."""
    if len({len(m) for m in masks}) != 1:
        raise ValueError("masks must have one length")
    with only_kept(docs.sparkSession) as stay:
        split = benchmark.where("text is not null").select("item_id", tokens(F.col("text")).alias("item_words")).where("size(item_words) > 0")
        members = keep(split.select("item_id", F.xxhash64("item_words").alias("item")).distinct())
        items = keep(split.select("item_words").distinct().withColumn("item", F.xxhash64("item_words")))
        texts = docs.where("text is not null").select("doc_id", *row_key(), tokens(F.col("text")).alias("words"))
        sizes = [r["m"] for r in items.select(F.least(F.size("item_words"), F.lit(window)).alias("m")).distinct().collect()]  # a row a size
        kinds: dict[tuple[str, ...], list[int]] = {}
        for m in sizes:
            kinds.setdefault(masks_for(m, masks, window, share), []).append(m)
        parts = [_seed_hits(items.where(F.least(F.size("item_words"), F.lit(window)).isin(own)), texts, k) for k, own in (kinds or {masks: [0]}).items()]
        seeds, hits = (keep(reduce(DataFrame.unionByName, side)) for side in zip(*parts))
        start = (F.col("at") - F.col("item_at")).alias("start")
        met = keep(hits.join(small(seeds), "seed").groupBy("k1", "k2", "item", start).agg(F.max("n_items").alias("n_items")))
        best = F.max(F.struct("matched", (-F.col("start")).alias("back"), "doc_id", "item_words")).alias("b")
        rows = _overlaps(met, texts, items, window, share).groupBy("k1", "k2", "item").agg(best, F.max("n_items").alias("n_items"))
        told = rows.join(small(members), "item")
        return stay(told.select("b.doc_id", "item_id", (-F.col("b.back")).alias("start"), "b.matched", "b.item_words", "n_items", "k1", "k2"))


def contamination(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, start, matched, item_words, n_items: a row for each document and item that overlap.

    docs: doc_id, text; benchmark: item_id (a number), text.  Texts are lower-cased words.  Hashes
    of both sides under each mask are joined; around a hit, words are aligned, and the overlap
    counts if some run of `window` aligned words (the whole item, if shorter) has at least
    `share` of them equal.  start and matched are those of the item's alignment with most equal words,
    start the document's word at which the item would begin; n_items tells how many different items have
    a seed of the alignment.

    A document meets all items of each of its seeds.  Where the masks could miss an overlap of a short
    item, masks over its whole length take their place (masks_for), so no overlap is left out; items of fewer
    than five words are joined on all of them, so an item of one word is found wherever that word is.
    Items of the same words are compared once and all named.

    Built-in functions only.  The benchmark's seeds are broadcast while their measured bytes stay
    under a bound and joined by a shuffle beyond it; documents are read once for hits, and only
    those with hits are compared.

    Null or empty texts never match.  Null doc_id or item_id is kept as null; rows that repeat a
    doc_id and text give one row; very long texts are split whole, in one task's memory; no
    benchmark or no documents give no rows; other columns are ignored.
    """
    return contaminated_rows(docs, benchmark, masks, window, share).drop("k1", "k2")
