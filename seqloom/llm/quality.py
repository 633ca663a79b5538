"""Quality rules: learned decision lists over document statistics, as Spark conditional expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm import words as W

#: The list is learned from at most so many labelled rows, chosen by a hash of doc_id.
MAX_LABELLED = 20_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_EXTRA = ["n_lines", "n_upper", "n_digits", "n_distinct"]
#: What rules test, from the counts: ratios, so that thresholds carry over between lengths.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
}


def _twice(h: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _measure(batches):
    for batch in batches:
        carried = [c for c in batch.schema.names if c != "_text"]
        names = [*carried, *STATS, *_EXTRA]
        for i, j, data, offs in W.chunks(batch.column("_text" if "_text" in batch.schema.names else "text")):
            w = W.words(data, offs, lower=False)
            n = np.diff(w.first)

            def per_text(flags):
                total = np.concatenate([[0], np.cumsum(flags)])
                return total[offs[1:]] - total[offs[:-1]]

            inside = ~W._SEP[data]
            char = (data & 0xC0) != 0x80
            counts = [n, per_text(char & inside), per_text(_SYMBOL[data])]
            upper, digits = per_text((data >= 65) & (data <= 90)), per_text((data >= 48) & (data <= 57))
            dup, repeat, lines, distinct = (np.zeros(j - i, np.int64) for _ in range(4))
            newlines = np.flatnonzero(data == 10)
            for d in range(j - i):
                a, b = w.first[d], w.first[d + 1]
                h = w.hashes[a:b]
                distinct[d] = len(np.unique(h))
                if b - a >= 4:
                    again = _twice(W.shingles(h, 3))
                    covered = np.zeros(b - a, bool)
                    for s in range(3):
                        covered[s : s + len(again)] |= again
                    repeat[d] = covered.sum()
                text = data[offs[d] : offs[d + 1]].tobytes()
                if b - a:
                    x, y = np.searchsorted(newlines, offs[d : d + 2])
                    edges = np.concatenate([[offs[d]], newlines[x:y] + 1, [offs[d + 1] + 1]])
                    has = np.searchsorted(w.starts, edges[1:] - 1) > np.searchsorted(w.starts, edges[:-1])
                    own = [text[edges[q] - offs[d] : edges[q + 1] - 1 - offs[d]] for q in np.flatnonzero(has)]
                    lines[d], dup[d] = len(own), len(own) - len(set(own))
            columns = [*counts, dup, repeat, lines, upper, digits, distinct]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in carried), *(pa.array(c.astype(np.int64)) for c in columns)], names=names)


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and whole-text counts: words, code points in words, symbols, repeated lines, words in
    repeated 3-word windows, lines with words, upper-case and decimal characters, distinct words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(_measure, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in STATS + _EXTRA))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Rule:
    """If all conditions (feature, "<=" or ">", threshold) hold, the document is kept or rejected."""

    conditions: tuple[tuple[str, str, float], ...]
    keep: bool

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.conditions:
            x = F.expr(FEATURES[f])
            out = out & ((x <= t) if op == "<=" else (x > t))
        return out

    def mask(self, x: pd.DataFrame) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, op, t in self.conditions:
            out &= (x[f] <= t).to_numpy() if op == "<=" else (x[f] > t).to_numpy()
        return out


def decision(rules: list[Rule]) -> Column:
    """The ordered rules as one CASE expression; documents that none fits are kept."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(r.keep)) if out is None else out.when(r.column(), F.lit(r.keep))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (np.log2((p1 + 1e-9) / (p1 + n1)) - np.log2((p0 + 1e-9) / (p0 + n0))) if p1 else -1.0


def _grow(x: pd.DataFrame, wanted: np.ndarray, keep: bool, banned: set, steps: int = 24, depth: int = 3) -> Rule | None:
    mask, conditions = np.ones(len(x), bool), []
    while len(conditions) < depth and (~wanted & mask).any():
        p0, n0, best = (wanted & mask).sum(), (~wanted & mask).sum(), (1e-6, None, None)
        for f in x.columns:
            v = x[f].to_numpy()
            for t in np.unique(np.quantile(v[wanted & mask], np.linspace(0, 1, steps))) if (wanted & mask).any() else ():
                for op, m in (("<=", mask & (v <= t)), (">", mask & (v > t))):
                    g = _gain(p0, n0, (wanted & m).sum(), (~wanted & m).sum())
                    if g > best[0] and (conditions or (f, op) not in banned):
                        best = (g, (f, op, float(t)), m)
        if best[1] is None:
            break
        conditions.append(best[1])
        mask = best[2]
    return Rule(tuple(conditions), keep) if conditions else None


def _prune(rule: Rule, x: pd.DataFrame, wanted: np.ndarray) -> Rule:
    """Drop final conditions while precision on rows set aside doesn't fall."""

    def worth(r: Rule) -> float:
        m = r.mask(x)
        p, n = (wanted & m).sum(), (~wanted & m).sum()
        return (p - n) / max(1, p + n)

    while len(rule.conditions) > 1 and worth(shorter := Rule(rule.conditions[:-1], rule.keep)) >= worth(rule):
        rule = shorter
    return rule


def learn(x: pd.DataFrame, quality: np.ndarray, max_rules: int = 12, least_precision: float = 0.9, least_kept: float = 0.98) -> list[Rule]:
    """Sequential covering of both classes: for either one, a conjunction is grown on two thirds of the
    rows not covered yet and pruned on the rest.  A rule must be precise on all of them and on
    the rest alone (rules that keep: more so, as most rows are good); where it isn't, another
    first condition is tried.  The better of both, by the lift of what it covers, joins the list,
    its rows go, and so on until no precise rule is left or the rest is of one class."""
    part = np.arange(len(x)) % 3
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < max_rules:
        best = (0.0, None, None)
        for keep, least in ((False, least_precision), (True, least_kept)):
            wanted = (quality == 0) != keep
            if min((wanted & left).sum(), (~wanted & left).sum()) < 4:
                continue
            grow, rest, banned = left & (part < 2), left & (part == 2), set()
            while rule := _grow(x[grow], wanted[grow], keep, banned):
                banned.add(rule.conditions[0][:2])
                rule = _prune(rule, x[rest], wanted[rest])
                m = rule.mask(x) & left
                if (wanted & m).sum() >= 4 and wanted[m].mean() >= least and wanted[m & rest].sum() >= least * (m & rest).sum():
                    lift = (wanted & m).sum() * np.log2(wanted[m].mean() / wanted[left].mean())
                    best = max(best, (lift, rule, m), key=lambda b: b[0])
                    break
        if best[1] is None:
            break
        rules.append(best[1])
        left &= ~best[2]
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """A decision list from labels (doc_id, quality).  Counts are made on Spark; at most
    max_labelled rows of ratios, the first by a hash of doc_id, reach the driver to fit rules.
    Labels that are null, or of documents that base rules reject anyway, teach nothing; of several
    labels of a document the highest counts."""
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = document_stats(texts).where(~base_failed()).join(F.broadcast(chosen), "doc_id")
    seen = rows.select("doc_id", "quality", *(F.expr(e).alias(f) for f, e in FEATURES.items())).toPandas().sort_values("doc_id", kind="stable", ignore_index=True)
    return learn(seen[list(FEATURES)], seen["quality"].to_numpy()) if len(seen) else []


def quality_filter(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts of document_stats, base_failed and kept for every row of docs.

    kept is false where base rules fail, else what the decision list says.  Null or empty text has
    no words and fails; very long ones are counted whole.  Null doc_ids and repeated rows get their rows; extra columns are ignored;
    without labels no rule is learned and base rules decide alone.
    """
    return document_stats(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & decision(rules))


def good_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs, with all their columns, that quality_filter keeps: each row is judged where it
    stands, so rows of one doc_id, or of none, may go different ways."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    numbered = docs.toDF(*("text" if c == "text" else n for n, c in zip(names, docs.columns)))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)
    judged = numbered.mapInArrow(_measure, fields + ", " + ", ".join(f"{c} long" for c in STATS + _EXTRA))
    return judged.where(~base_failed() & decision(rules)).select(numbered.columns).toDF(*docs.columns)
