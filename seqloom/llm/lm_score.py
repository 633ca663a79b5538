"""LM scoring: prediction by partial matching over byte contexts, with a unigram word baseline.

The model has every context of up to four bytes that training texts have.  The most frequent ones,
flattened into tables of MAX_NODES * 257 entries at most, go to every executor as a trie; bytes after
others are looked up in a table of log10 p that Spark makes from all counts: its most frequent rows
are sent, too, the rest is joined.  Where training has no such context, the next shorter one predicts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm import words as W
from seqloom.llm.shared import keep, only_kept

#: Counts of at most so many of the most frequent words are sent to executors; the rest are joined.
HEAD_WORDS = 300_000
#: Contexts that the trie keeps at most, by count; bytes after all others are looked up or joined.
MAX_NODES = 20_000
#: Rows of the table of log10 p that are sent to executors at most; the rest is joined.
HEAD_GRAMS = 250_000
ORDER, _START, _BITS = 4, 256, 9


def _before(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For k = 1, 2, ..: the byte k places before each one, 256 outside the text."""
    padded = np.full(len(data) + ORDER, _START, np.int16)
    padded[ORDER:] = data
    out = []
    lengths = np.diff(offs)
    for k in range(1, ORDER + 1):
        c = padded[ORDER - k : len(padded) - k].copy()
        for j in range(k):
            c[offs[:-1][lengths > j] + j] = _START
        out.append(c)
    return out


def _keys(data: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    key = data.astype(np.int64)
    for k, c in enumerate(before, 1):
        key |= c.astype(np.int64) << (_BITS * k)
    return key


def _count(batches):
    """(kind, key, c): a byte after four others (0), word hashes (1), ends of texts (2)."""
    ends = 0

    def rows(kind, found):
        h, n = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        keys, at = np.unique(h, return_inverse=True)
        c = np.bincount(at, n, len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(c)], names=["kind", "key", "c"])

    for batch in batches:
        seen, grams = [], []
        ends += batch.num_rows
        for _, _, data, offs in W.chunks(batch.column("text")):
            grams.append(np.unique(_keys(data, _before(data, offs)), return_counts=True))
            seen.append(np.unique(W.words(data, offs).hashes, return_counts=True))
        if seen:
            yield rows(0, grams)
            yield rows(1, seen)
    yield rows(2, [(np.zeros(1, np.int64), np.array([ends]))])


def _unseen(batches):
    """(0, key, 0) for each byte after four others, in texts that no model learns from."""
    for batch in batches:
        for _, _, data, offs in W.chunks(batch.column("text")):
            own = np.unique(_keys(data, _before(data, offs)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(own), np.int8)), pa.array(own), pa.array(np.zeros(len(own), np.int64))], names=["kind", "key", "c"])


def _least(counts: DataFrame, limit: int) -> int:
    """The least c of the most frequent rows, of which there are limit at most; 0 if these are all."""
    if counts.count() <= limit:
        return 0
    by = counts.groupBy("c").agg(F.count("*").alias("n")).withColumn("above", F.sum("n").over(Window.orderBy(F.desc("c"))))
    return by.where(f"above <= {limit} and c > 0").agg(F.min("c")).first()[0] or 1 << 62


def gram_logs(grams: DataFrame) -> DataFrame:
    """key, c, log: log10 probability of a byte after the four before it, for all of grams (key, c),
    c being 0 for those that only scored texts have.

    The same estimate as ByteModel's, over all contexts: order by order, each row meets the one
    of the context that is a byte shorter, and a context's rows its sums."""

    def low(k: int) -> Column:
        return F.expr(f"key & {(1 << _BITS * (k + 1)) - 1}L")

    third = keep(grams.groupBy(low(ORDER - 1).alias("key")).agg(F.sum("c").alias("c")))
    w, seen = Window.partitionBy("context"), F.col("c") > 0
    t, d = F.sum("c").over(w).alias("t"), F.count(F.when(seen, 1)).over(w).alias("d")
    done = None
    for k in range(ORDER + 1):
        own = grams if k == ORDER else third if k == ORDER - 1 else third.groupBy(low(k).alias("key")).agg(F.sum("c").alias("c"))
        own = own.select("key", "c", F.expr(f"shiftright(key, {_BITS})").alias("context"))
        if done is None:
            sums = own.select("key", "c", t, d)
            p = F.expr("CASE WHEN t = 0 THEN 1D / 256 WHEN c > 0 THEN c / (t + if(d < 256, d, 0)) ELSE d / (t + d) / (256 - d) END")
        else:
            up = done.select(F.col("key").alias("shorter"), F.col("c").alias("c1"), F.col("t").alias("t1"), F.col("d").alias("d1"), F.col("p").alias("p1"))
            met = own.withColumn("shorter", low(k - 1)).join(up, "shorter")
            sums = met.select("key", "c", "c1", "t1", "d1", "p1", t, d, F.sum(F.when(seen, F.col("c1")).otherwise(0)).over(w).alias("had"))
            rest = "(t1 - had + d1 - d)"
            p = F.expr(f"CASE WHEN t = 0 THEN p1 WHEN c > 0 THEN c / (t + d) WHEN c1 > 0 THEN d / (t + d) * c1 / {rest} ELSE d / (t + d) * if(d1 > d, (d1 - d) / {rest}, 1D) * p1 * (t1 + d1) / d1 END")
        done = sums.withColumn("p", p).select("key", "c", "t", "d", "p")
    return done.select("key", "c", F.log10("p").alias("log"))


def trie_counts(grams: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """context, symbol, c for the contexts that the trie keeps, from grams (key, c).

    A context is its bytes, nearest first from the lowest bits, and its order above them.  Shorter
    ones have no smaller counts than those that extend them, so every node's parent is kept."""
    top = _BITS * ORDER
    orders = F.array(*(F.expr(f"(shiftright(key, {_BITS}) & {(1 << _BITS * k) - 1}L) | {k << top}L") for k in range(ORDER + 1)))
    flat = grams.select(F.explode(orders).alias("context"), F.expr(f"cast(key & {(1 << _BITS) - 1} as int)").alias("symbol"), "c")
    entries = keep(flat.groupBy("context", "symbol").agg(F.sum("c").alias("c")))
    totals = keep(entries.groupBy("context").agg(F.sum("c").alias("t")))
    by = totals.groupBy("t").agg(F.count("*").alias("n")).withColumn("above", F.sum("n").over(Window.orderBy(F.desc("t"))))
    least = by.where(f"above <= {max_nodes}").agg(F.min("t")).first()[0]
    return entries.join(F.broadcast(totals.where(F.col("t") >= (least or 1 << 62)).select("context")), "context")


class ByteModel:
    """log10 probabilities of a byte after others, by escape estimation with symbol exclusion.

    A context seen T times with d different bytes gives c / (T + d) to a byte seen c times and
    escapes with d / (T + d) to the next shorter one, which leaves out the bytes that the longer
    one had; below order 0, bytes never seen share what is left evenly.
    """

    def __init__(self, context: np.ndarray, symbol: np.ndarray, c: np.ndarray):
        used = np.unique(symbol)
        self.index = np.full(257, len(used), np.int32)  # bytes never seen, and a text's start, are one class
        self.index[used] = np.arange(len(used))
        n = self.n = len(used) + 1
        unseen = 256 - len(used)
        names, row = np.unique(context, return_inverse=True)  # by order, so the root is first
        if not len(names):
            names = np.zeros(1, np.int64)
        self.longer = np.zeros((len(names), n), np.int32)  # the node that has one more byte in front
        self.logs = np.empty((len(names), n), np.float32)
        order, low = names >> (_BITS * ORDER), names & ((1 << _BITS * ORDER) - 1)
        parents = np.zeros(len(names), np.int64)
        at = np.argsort(row, kind="stable")
        edges = np.searchsorted(row[at], np.arange(len(names) + 1))

        def counts(nodes: np.ndarray) -> np.ndarray:
            out = np.zeros((len(nodes), n))
            for r, node in enumerate(nodes):
                own = at[edges[node] : edges[node + 1]]
                out[r, self.index[symbol[own]]] = c[own]
            return out

        root = counts(np.zeros(1, np.int64))
        total, kinds = root.sum(), (root > 0).sum()
        escape = kinds / (total + kinds) if unseen and total else float(not total)
        p = root / max(total + (kinds if unseen else 0), 1)
        p[0, -1] = escape / max(unseen, 1)
        self.logs[:1] = np.log10(np.maximum(p, 1e-300))
        for k in range(1, ORDER + 1):
            nodes = np.flatnonzero(order == k)
            if not len(nodes):
                break
            shorter = low[nodes] & ((1 << _BITS * (k - 1)) - 1)
            parents[nodes] = np.searchsorted(names, shorter | ((k - 1) << _BITS * ORDER))
            self.longer[parents[nodes], self.index[low[nodes] >> (_BITS * (k - 1))]] = nodes
            for i in range(0, len(nodes), 4096):
                own = nodes[i : i + 4096]
                self.logs[own] = np.log10(self._row(counts(own), counts(parents[own]), 10.0 ** self.logs[parents[own]].astype(np.float64)))

    @staticmethod
    def _row(c: np.ndarray, above: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of nodes from their counts and their parents' counts and probabilities."""

        def sums(x):
            return x.sum(axis=1, keepdims=True), (x > 0).sum(axis=1, keepdims=True)

        total, kinds = sums(c)
        whole, whole_kinds = sums(above)
        rest = np.where(c > 0, 0, above)
        left, left_kinds = sums(rest)
        out = kinds / (total + kinds)
        next_ = np.where(left_kinds > 0, left_kinds / np.maximum(left + left_kinds, 1), 1.0)
        deeper = p * (whole + whole_kinds) / whole_kinds
        return np.where(c > 0, c / (total + kinds), out * np.where(above > 0, rest / np.maximum(left + left_kinds, 1), next_ * deeper))

    def logs_of(self, data: np.ndarray, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each byte in a block, and whether its longest context is a node."""
        longer, n = self.longer.ravel(), self.n
        node, alive = np.zeros(len(data), np.int64), np.ones(len(data), bool)
        for c in before:
            at = longer[node * n + self.index[c]]
            alive &= (at > 0) & ((self.index[c] < n - 1) | (c == _START))
            node = np.where(alive, at, node)
        return self.logs.ravel()[node * n + self.index[data]].astype(np.float64), alive


def _sums(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(np.diff(offs))
    out = np.zeros(len(offs) - 1)
    if len(full):
        out[full] = np.add.reduceat(x, offs[:-1][full])
    return out


def _score(model, held, grams, words_, tail: bool, end: float):
    """held, grams: broadcast (hashes or keys, log10 probabilities); words_: log10 probability of an
    unknown word; what grams lacks is left to the join."""

    def bytes_(data, offs):
        """log10 probability of each text without the grams of the tail; these, and how often, by text."""
        keys, logs = grams.value
        before = _before(data, offs)
        x, alive = model.value.logs_of(data, before)
        miss = np.flatnonzero(~alive)
        own, at = np.unique(_keys(data[miss], [c[miss] for c in before]), return_inverse=True)
        place = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        known = keys[place] == own if len(keys) else np.zeros(len(own), bool)
        x[miss] = np.where(known, logs[place] if len(logs) else 0.0, 0.0)[at]
        left = np.flatnonzero(~known[at])
        text, key = np.searchsorted(offs[1:], miss[left], "right"), at[left]
        pair, c = np.unique(text.astype(np.int64) * max(1, len(own)) + key, return_counts=True)
        return _sums(x, offs), np.bincount(pair // max(1, len(own)), minlength=len(offs) - 1), own[pair % max(1, len(own))], c

    def run(batches):
        hashes, logs = held.value
        for batch in batches:
            for i, j, data, offs in W.chunks(batch.column("text")):
                w = W.words(data, offs)
                n = np.diff(w.first)
                own, at = np.unique(w.hashes, return_inverse=True)
                place = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
                known = hashes[place] == own if len(hashes) else np.zeros(len(own), bool)
                value = np.where(known, logs[place] if len(logs) else 0.0, words_)
                total, found = (np.concatenate([[0], np.cumsum(x[at])]) for x in (value, known))
                rest = []
                if tail:
                    miss = ~known[at]
                    for d in range(j - i):
                        a, b = w.first[d], w.first[d + 1]
                        h, c = np.unique(w.hashes[a:b][miss[a:b]], return_counts=True)
                        rest.append((h.view(np.int64), c))
                    lengths = np.array([len(h) for h, _ in rest])
                    h, c = (np.concatenate([x[k] for x in rest]) for k in (0, 1))
                else:
                    lengths, h, c = np.zeros(j - i, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
                score, gram_lengths, gram, gram_c = bytes_(data, offs)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        batch.column("key").slice(i, j - i),
                        pa.array(n + 1),
                        pa.array(found[w.first[1:]] - found[w.first[:-1]]),
                        pa.array(total[w.first[1:]] - total[w.first[:-1]] + end),
                        pa.array(score),
                        W.list_array(pa.array(h), lengths),
                        W.list_array(pa.array(c), lengths),
                        W.list_array(pa.array(gram), gram_lengths),
                        W.list_array(pa.array(gram_c), gram_lengths),
                    ],
                    names=["doc_id", "key", "n_tokens", "n_known", "base_score", "score", "rest", "times", "grams", "gram_times"],
                )

    return run


def held_out(doc_id: Column) -> Column:
    """A tenth of documents, by a checksum of the id; a null id is trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def lm_scores(docs: DataFrame, head_words: int = HEAD_WORDS, max_nodes: int = MAX_NODES, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Both models learn from all documents that held_out leaves; score is the byte model's log10
    probability of the whole text, base_score the smoothed unigram's over words and one end.
    Counts are summed on Spark; no context is left out.  At most max_nodes of the most frequent go
    to the executors as a trie, and at most head_grams log10 probabilities of bytes after others;
    of the word counts, at most head_words.  Rarer ones stay tables that are joined with what the
    heads lack, so neither model is ever held whole.

    Words are 64-bit hashes.  Very long texts are scored whole, in blocks of memory that grow with the
    text.  doc_id is cast to long in the result (a text that is no number: null).  Null text: empty, scored as the end alone; null doc_id: in training.
    Repeated rows count and are scored each time; other columns are ignored; an empty table gives
    no rows, and without training documents every word is unknown and every byte equally likely.
    """
    with only_kept(docs.sparkSession) as stay:
        return stay(_scores(docs, head_words, max_nodes, head_grams))


def _scores(docs: DataFrame, head_words: int, max_nodes: int, head_grams: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    found = texts.where("not held_out").select("text").mapInArrow(_count, "kind byte, key long, c long")
    found = found.unionByName(texts.where("held_out").select("text").mapInArrow(_unseen, "kind byte, key long, c long"))
    counts = keep(found.groupBy("kind", "key").agg(F.sum("c").alias("c")))
    trie_rows = keep(trie_counts(counts.where("kind = 0 and c > 0").select("key", "c"), max_nodes))
    nodes = trie_rows.where(f"shiftright(context, {_BITS * ORDER}) = {ORDER}").select("context").distinct()
    grams = gram_logs(counts.where("kind = 0").select("key", "c")).withColumn("context", F.expr(f"shiftright(key, {_BITS}) | {ORDER << _BITS * ORDER}L"))
    grams = keep(grams.join(F.broadcast(nodes), "context", "left_anti").select("key", "c", "log"))
    least_gram = _least(grams, head_grams)
    sent = grams.where(f"c >= {least_gram}").select("key", "log").toPandas().sort_values("key")
    sent = spark.sparkContext.broadcast((sent["key"].to_numpy(np.int64), sent["log"].to_numpy(np.float64).astype(np.float32)))
    rare_grams = grams.where(f"c < {least_gram}") if least_gram else None
    trie = trie_rows.toPandas()
    model = spark.sparkContext.broadcast(ByteModel(*(trie.pop(x).to_numpy(np.int64) for x in ("context", "symbol", "c"))))
    vocabulary = counts.where("kind = 1").select(F.col("key").alias("word"), "c")
    sums = {r["kind"]: (r["n"], r["c"]) for r in counts.groupBy("kind").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    kinds, inside = sums.get(1, (0, 0))
    ends = sums.get(2, (0, 0))[1]
    train, distinct = inside + ends, kinds + (ends > 0)
    scale = np.log10(train + 0.1 * (distinct + 1))
    least = 0
    if kinds > head_words:
        by = vocabulary.groupBy("c").agg(F.count("*").alias("n")).withColumn("above", F.sum("n").over(Window.orderBy(F.desc("c"))))
        least = by.where(f"above <= {head_words}").agg(F.min("c")).first()[0] or 1 << 62
    head = vocabulary.where(f"c >= {least}").toPandas()
    hashes = head["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    logs = np.log10(head["c"].to_numpy(np.float64)[order] + 0.1) - scale
    held = spark.sparkContext.broadcast((hashes[order], logs))
    unknown = float(np.log10(0.1) - scale)
    schema = "doc_id long, key long, n_tokens long, n_known long, base_score double, score double, rest array<long>, times array<long>, grams array<long>, gram_times array<long>"
    tail = vocabulary.where(f"c < {least}") if least else None
    run = _score(model, held, sent, unknown, tail is not None, float(np.log10(ends + 0.1) - scale))
    keyed = texts.select(F.col("doc_id").cast("long").alias("doc_id"), (F.xxhash64("doc_id", "text") if tail is not None or rare_grams is not None else F.lit(0).cast("long")).alias("key"), "text")
    rows = keyed.mapInArrow(run, schema)
    known, base, score = F.col("n_known"), F.col("base_score"), F.col("score")
    if tail is not None or rare_grams is not None:
        rows = keep(rows)
    once = rows.dropDuplicates(["key"])
    if rare_grams is not None:
        rare = once.select("key", F.explode(F.arrays_zip("grams", "gram_times")).alias("r")).select(F.col("key").alias("doc"), F.col("r.grams").alias("key"), "r.gram_times")
        more = rare.join(rare_grams, "key").groupBy("doc").agg(F.sum(F.col("gram_times") * F.col("log")).alias("tail_score"))
        rows = rows.drop("grams", "gram_times").join(more.withColumnRenamed("doc", "key"), "key", "left")
        score = score + F.coalesce("tail_score", F.lit(0.0))
    if tail is not None:
        rare = once.select("key", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("key", F.col("r.rest").alias("word"), "r.times")
        better = F.sum(F.col("times") * (F.log10(F.col("c") + 0.1) - F.lit(float(scale)) - F.lit(unknown)))
        more = rare.join(tail, "word").groupBy("key").agg(F.sum("times").alias("more"), better.alias("better"))
        rows = rows.drop("rest", "times").join(more, "key", "left")
        known, base = known + F.coalesce("more", F.lit(0)), base + F.coalesce("better", F.lit(0.0))
    known = known + (1 if ends else 0)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(train).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
