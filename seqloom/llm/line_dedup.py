"""Line dedup: a fixed-depth tree of log templates; templates that recur across documents go."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import words as W
from seqloom.llm.shared import among, fits, keep, only_kept, row_key, small

DEPTH, MIN_DOCS = 3, 8
#: A token is fixed if it stands at its place in min_docs of a leaf's lines, or in these shares of them.
SHARES = (0.1, 0.6)
_FIELD = np.uint64(0x5851F42D4C957F2D)  # stands for any token with a decimal
_MAP_BITS = 1 << 22
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _parse(data: np.ndarray, offs: np.ndarray, depth: int):
    """The lines with words of several texts: text, line_no, first word, words, leaf and form of each, and
    all words' hashes, those with a decimal as fields.

    A line of more fields than other tokens is no template: its form is that of its raw words and it
    has no leaf (0).  Others' leaf is their number of words and the first `depth` ones."""
    w = W.words(data, offs, lower=False)
    newlines = np.flatnonzero(data == 10)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(w.first))
    line = np.searchsorted(newlines, w.starts)
    first = np.flatnonzero(np.diff(line + text, prepend=-1))
    n = np.diff(np.append(first, len(line)))
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
    field = digits[w.ends] > digits[w.starts]
    tokens = np.where(field, _FIELD, w.hashes)
    if not len(first):
        none = np.empty(0, np.int64)
        return none, none, none, none, none, none, tokens
    exact = 2 * np.add.reduceat(field.astype(np.int64), first) > n
    tokens = np.where(np.repeat(exact, n), w.hashes, tokens)
    place = np.arange(len(line)) - np.repeat(first, n)
    mixed = W.mix(tokens + W.mix(place.astype(np.uint64)))
    form = W.mix(np.add.reduceat(mixed, first) ^ n.astype(np.uint64)).view(np.int64)
    routed = np.flatnonzero((n > depth) & ~exact)
    leaf = np.zeros(len(first), np.int64)
    leaf[routed] = W.mix(sum(mixed[first[routed] + i] for i in range(depth)) ^ n[routed].astype(np.uint64)).view(np.int64) if depth else n[routed]
    number = line[first] - np.searchsorted(newlines, offs[:-1])[text[first]]
    return text[first], number, first, n, leaf, form, tokens


def _lines(depth: int):
    def run(batches):
        for batch in batches:
            for i, j, data, offs in W.chunks(batch.column("text")):
                text, number, _, _, leaf, form, _ = _parse(data, offs, depth)
                owner = [batch.column(c).slice(i, j - i).take(pa.array(text)) for c in ("doc_id", "k1", "k2", "copy")]
                yield pa.RecordBatch.from_arrays([*owner, *map(pa.array, (number, leaf, form))], names=["doc_id", "k1", "k2", "copy", "line_no", "leaf", "form"])

    return run


def _tokens(depth: int, taken):
    """Forms of the leaves that the broadcast map has, once a block, with how many lines they are of."""

    def run(batches):
        for batch in batches:
            for _, _, data, offs in W.chunks(batch.column("text")):
                _, _, first, n, leaf, form, tokens = _parse(data, offs, depth)
                wanted = np.flatnonzero((leaf != 0) & taken.value[leaf & (_MAP_BITS - 1)])
                _, at, k = np.unique(form[wanted], return_index=True, return_counts=True)
                at = wanted[at]
                own = [tokens[first[x] : first[x] + n[x]] for x in at]
                flat = pa.array((np.concatenate(own) if own else np.empty(0, np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[at]), pa.array(form[at]), W.list_array(flat, n[at]), pa.array(k.astype(np.int64))], names=["leaf", "form", "tokens", "k"])

    return run


def _leaf_map(leaves: DataFrame) -> np.ndarray:
    """A flag for each value of a leaf's low bits, so that most other lines go before any join."""
    bit = F.col("leaf").bitwiseAND(F.lit(_MAP_BITS - 1)) + 1
    maps = leaves.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m"))
    flags = np.zeros(_MAP_BITS // 8, np.uint8)
    for r in maps.toLocalIterator():  # 4,096 bytes each; bits and buckets count from 1
        flags[(r["b"] - 1) * 4096 :][:4096] = np.frombuffer(r["m"], np.uint8)
    return np.unpackbits(flags, bitorder="little").astype(bool)


def _templates(rows: DataFrame, texts: DataFrame, depth: int, min_docs: int) -> DataFrame:
    """form, template for the forms that leaves generalise.

    At each place beyond the leading tokens, a word is fixed if it is frequent there in the leaf: in
    min_docs lines, or in one of SHARES of them; other words vary.  Each of these three levels
    groups a leaf's forms by their fixed words.  A group is a template if most of the places
    beyond the leading ones are fixed and no field.
    """
    ends = (F.min("form").alias("f1"), F.max("form").alias("f2"), F.min("copy").alias("c1"), F.max("copy").alias("c2"))
    leaves = rows.where("leaf <> 0").groupBy("leaf").agg(F.count("*").alias("lines"), *ends)
    leaves = keep(leaves.where(f"lines >= {min_docs} and f1 <> f2 and c1 <> c2").select("leaf", "lines"))
    taken = rows.sparkSession.sparkContext.broadcast(_leaf_map(leaves))
    forms = texts.select("text").mapInArrow(_tokens(depth, taken), "leaf long, form long, tokens array<long>, k long").join(small(leaves), "leaf")
    forms = keep(forms.groupBy("leaf", "form").agg(F.first("tokens").alias("tokens"), F.sum("k").alias("k"), F.first("lines").alias("lines")))
    beyond = F.slice("tokens", depth + 1, F.greatest(F.size("tokens") - depth, F.lit(0)))
    words = forms.select("leaf", "form", "k", "lines", F.size(beyond).alias("n"), F.posexplode(beyond).alias("place", "word"))
    words = words.where(F.col("word") != F.lit(int(_FIELD.view(np.int64))))
    votes = keep(words.groupBy("leaf", "place", "word").agg(F.sum("k").alias("votes")).where(f"votes >= {min_docs}"))
    hashed = F.xxhash64("place", "word")
    levels = [F.lit(True), *(F.col("votes") >= s * F.col("lines") for s in SHARES)]
    level = [F.struct(F.lit(i).alias("level"), F.bit_xor(F.when(c, hashed)).alias("sig"), F.count(F.when(c, 1)).alias("fixed")) for i, c in enumerate(levels)]
    signed = words.join(small(votes), ["leaf", "place", "word"]).groupBy("leaf", "form").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.array(*level).alias("levels"))
    flat = signed.select("leaf", "form", "n", "k", F.explode("levels").alias("x")).where("2 * x.fixed > n")
    named = keep(flat.select("form", "k", F.xxhash64("leaf", "x.level", "x.sig").alias("template")))
    often = named.groupBy("template").agg(F.sum("k").alias("k")).where(f"k >= {min_docs}").select("template")
    return named.join(often, "template").select("form", "template")


def recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """k1, k2 (the key of a row's doc_id and text), dropped: rows with lines to drop, as sorted numbers.

    A line's form is its words, those with a decimal as one field; it is its own template and
    belongs to those of its leaf that cover it.  A template recurs if it stands in at least
    min_docs documents of different texts: whole copies, by a hash of the text, count as one and
    are left to document dedup.  The document that comes first (by doc_id, null last) keeps its
    lines, so no line is lost altogether.
    """
    texts = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), *row_key(), F.xxhash64("text").alias("copy"), "text")
    order = docs.schema["doc_id"].dataType.simpleString()
    with only_kept(docs.sparkSession) as stay:
        found = texts.mapInArrow(_lines(depth), "doc_id string, k1 long, k2 long, copy long, line_no long, leaf long, form long")
        rows = keep(found.withColumn("doc_id", F.col("doc_id").cast(order)))
        often = rows.groupBy("form").agg(F.count("*").alias("k"), F.min("copy").alias("c1"), F.max("copy").alias("c2"))
        exact = often.where(f"k >= {min_docs} and c1 <> c2").select("form", F.col("form").alias("template"))
        templates = keep(exact.unionByName(_templates(rows, texts, depth, min_docs)))
        named = keep(rows.drop("leaf").join(small(templates), "form"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first")
        copies = named.groupBy("template", "copy").agg(first)
        recurring = copies.groupBy("template").agg(F.count("*").alias("n"), F.min("first").alias("first")).where(f"n >= {min_docs}")
        recurring = keep(recurring.select("template", F.col("first.k1").alias("o1"), F.col("first.k2").alias("o2")))
        gone = named.join(small(recurring), "template").where("k1 <> o1 or k2 <> o2")
        return stay(gone.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.col("line_no").cast("int"))).alias("dropped")))


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with its columns, text without the lines of recurring templates, and n_dropped.

    Lines are split at \\n; a kept line stays as it is.  Lines of numbers mostly recur only as they
    stand.  Null text stays null; blank lines stay; a text may become empty, but no row goes.
    Null doc_ids come after all others; repeated rows lose the same lines; a very long text is
    parsed whole, and only the numbers of its dropped lines leave its task; a column named
    n_dropped is replaced, others may have any name; an empty table gives no rows.
    """
    gone = recurring_lines(docs, depth, min_docs)
    keyed = docs.select(F.struct("*").alias("row"), *row_key())
    if fits(gone):
        met = keyed.join(F.broadcast(gone), ["k1", "k2"], "left")
    else:
        keys = keep(gone.select("k1", "k2"))
        met = among(keyed, keys, ["k1", "k2"], False).withColumn("dropped", F.lit(None).cast("array<int>")).unionByName(among(keyed, keys, ["k1", "k2"]).join(gone, ["k1", "k2"]))
    lines = F.split("row.text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "dropped")
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    columns = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "n_dropped"]
    return met.select(*columns, F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"))
