"""Filter interaction audit: a packed bitmap index of filters, and counts of every prefix of every order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import keep, only_kept, small

#: Rows of one block of the index at most: a bit each.
BLOCK_ROWS = 1 << 16
#: Filters that all orders of can be listed for.
MOST_FILTERS = 6


def bitmap_index(rows: DataFrame, part: str, flags: list[str]) -> DataFrame:
    """part, n, and a binary column for each of flags: rows (a string column part, boolean flags without
    nulls) as blocks of packed bits, made within each partition.

    A block holds rows of one part; bit i of every column is the same row, bits beyond n are 0.
    Repeated rows have a bit each.  No rows, no blocks.
    """
    kinds = ", ".join(f"`{f}` binary" for f in flags)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.string()), ("n", pa.int32()), *((f, pa.binary()) for f in flags)])
        held: dict[str, list[np.ndarray]] = {}
        count = 0

        def blocks() -> pa.RecordBatch:
            out = []
            for name, pieces in held.items():
                bits = np.concatenate(pieces)
                out.append((name, len(bits), *(p.tobytes() for p in np.packbits(bits, axis=0, bitorder="little").T)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            bits = np.stack([np.asarray(batch.column(i + 1).to_numpy(zero_copy_only=False), bool) for i in range(len(flags))], axis=1)
            codes = names.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            edges = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 1))
            for name, a, b in zip(names.dictionary.to_pylist(), edges, edges[1:]):
                held.setdefault(name, []).append(bits[order[a:b]])
            count += len(batch)
            if count >= BLOCK_ROWS:
                yield blocks()
                held, count = {}, 0
        if count:
            yield blocks()

    return rows.select(F.col(part).alias("part"), *flags).mapInArrow(pack, f"part string, n int, {kinds}")


def subset_counts(index: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """part, passed (a bit mask of filters applied before), filter, and long counts over all blocks of an index:
    n rows, alive (not failing any filter passed), removed (of these, failing filter), removed_<label>,
    and fails (failing filter, whatever came before).

    Each block gives AND-NOT and popcount for all subsets; sums are all that is shuffled.
    """
    k, subsets = len(filters), 1 << len(filters)
    columns = ["n", "alive", "removed", *(f"removed_{x}" for x in labels), "fails"]
    kinds = ", ".join(f"{c} long" for c in columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.string()), ("passed", pa.int32()), ("filter", pa.int32()), *((c, pa.int64()) for c in columns)])
        sums: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            names, cells = list(sums), np.stack(list(sums.values())).reshape(-1, len(columns))
            passed, each = np.divmod(np.arange(subsets * k), k)
            arrays = [pa.array(np.repeat(np.array(names, object), subsets * k), pa.string()), pa.array(np.tile(passed, len(names)), pa.int32()), pa.array(np.tile(each, len(names)), pa.int32())]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, pa.int64()) for c in cells.T)], schema=schema)

        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            packed = [batch.column(i + 2).to_pylist() for i in range(k + len(labels))]
            for row, (name, n) in enumerate(zip(names, sizes)):
                bits = np.stack([np.frombuffer(c[row], np.uint8) for c in packed])
                every = np.packbits(np.ones(n, bool), bitorder="little")
                gone = np.zeros((subsets, len(every)), np.uint8)
                for s in range(1, subsets):
                    low = s & -s
                    gone[s] = gone[s ^ low] | bits[low.bit_length() - 1]
                alive = every & ~gone
                removed = alive[:, None, :] & bits[None, :k, :]
                pops = lambda x: np.bitwise_count(x).sum(-1, dtype=np.int64)
                cell = np.empty((subsets, k, len(columns)), np.int64)
                cell[..., 0], cell[..., 1], cell[..., 2] = n, pops(alive)[:, None], pops(removed)
                for j in range(len(labels)):
                    cell[..., 3 + j] = pops(removed & bits[k + j])
                cell[..., -1] = pops(bits[:k])[None]
                sums[name] = sums[name] + cell if name in sums else cell
                if len(sums) == 256:
                    yield told()
                    sums = {}
        if sums:
            yield told()

    counted = index.mapInArrow(count, f"part string, passed int, filter int, {kinds}")
    return counted.groupBy("part", "passed", "filter").agg(*(F.sum(c).cast("long").alias(c) for c in columns))


def audit(index: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """part, filter_order (a string of filters' names), step, kept, removed, redundant, unique_fails,
    <label>_lost for each label, shapley: a row, zeros included, for each part of the index, order and step.

    shapley is removed summed over all orders, at any step; over their number it is the filter's Shapley value.
    """
    k = len(filters)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    with only_kept(index.sparkSession) as stay:
        counts = keep(subset_counts(index, filters, labels))
        ways = [factorial(bin(s).count("1")) * factorial(max(0, k - 1 - bin(s).count("1"))) for s in range(1 << k)]
        others = F.expr(f"passed = ({(1 << k) - 1} ^ shiftleft(1, filter))")
        weight = F.when(F.expr("(shiftright(passed, filter) & 1) = 0"), F.get(F.array(*map(F.lit, ways)), F.col("passed"))).otherwise(0)
        whole = counts.groupBy("part", "filter").agg(F.sum(F.when(others, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * weight).cast("long").alias("shapley"))
        steps = [(o, s + 1, sum(1 << f for f in order[:s]), order[s]) for order in permutations(range(k)) for o in ["".join(filters[f] for f in order)] for s in range(k)]
        orders = index.sparkSession.createDataFrame(steps, "filter_order string, step int, passed int, filter int")  # k * k! rows, at most 4,320
        told = counts.join(F.broadcast(orders), ["passed", "filter"]).join(small(keep(whole)), ["part", "filter"])
        return stay(told.select(
            "part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
            "unique_fails", *(F.col(f"removed_{x}").alias(f"{x}_lost") for x in labels), "shapley",
        ))


#: Failure conditions of the five text filters, by letter; E is a matter of the whole table.
FILTERS = ["A", "B", "C", "D", "E"]


def _text_flags(text: Column) -> list[Column]:
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    words, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    return [(words < 200).alias("A"), (100 * distinct < 50 * words).alias("B"), (100 * upper.cast("long") > 3 * F.length(text)).alias("C"), text.rlike("[#$%&*|]").alias("D")]


def text_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and the flags A to E, good, toxic of every row of docs (doc_id, text, lang); labels: doc_id, quality, toxic.

    A: under 200 words; B: fewer than half of the words differ; C: more than 3 % of the code points are
    A-Z; D: holds one of #$%&*|; E: a row with a smaller doc_id has the same text.  Words are runs
    of other characters than space and 0x09-0x0D, case-sensitive.

    Null text: empty; null lang: the empty string.  A null doc_id is no smaller or larger than any,
    so E holds for none of its rows, and it has no labels.  Rows that repeat a doc_id count each; of
    several labels of a doc_id, any that is 1 counts, and null is 0.
    """
    text = F.coalesce("text", F.lit(""))
    plain = F.translate(F.col("text"), "\t\n\x0b\x0c\r", " " * 5)
    own = docs.select("doc_id", text.alias("text"), F.coalesce("lang", F.lit("")).alias("part")).withColumn("_words", F.array_remove(F.split(plain, " "), ""))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    base = keep(own.select("doc_id", "part", *_text_flags(F.col("text")), digest))
    again = base.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    marked = base.join(small(keep(again)), "digest", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    said = small(keep(said.where("quality or toxic").withColumn("_salt", F.lit(0).cast("long"))))
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))  # rows without an id spread
    met = marked.withColumn("_salt", salt).join(said, ["doc_id", "_salt"], "left")
    return met.select("part", *FILTERS, *(F.coalesce(c, F.lit(False)).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))))


def audit_text_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of text_filters over docs, by lang: 600 rows a lang; see text_filters for odd rows.  Empty docs
    give no rows, other columns are ignored."""
    with only_kept(docs.sparkSession) as stay:
        index = keep(bitmap_index(text_filters(docs, labels), "part", [*FILTERS, "good", "toxic"]))
        return stay(audit(index, FILTERS, ["good", "toxic"]))
