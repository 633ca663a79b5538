"""URL filters: a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules the trie is sent to every executor (a rule is a few hundred bytes at most);
#: beyond, rules and urls meet in a join.
TRIE_RULES = 200_000


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleTrie:
    """Nodes are dicts: host labels from the last one on, then "/", then path segments.

    A rule's path ends in the middle of a segment in general; that end is kept as a prefix of the
    next segment in the node's list, so that paths match by their leading characters.
    """

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, name, start in sorted(rules, reverse=True):  # of equal rules, allow comes last and stays
            node = self.root
            for label in reversed(name.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})
            *segments, end = start.split("/")
            for s in segments:
                node = node.setdefault(("s", s), {})
            node.setdefault("ends", {})[end] = (name + start, verdict)
            node.setdefault("lengths", set()).add(len(end))

    def match(self, name: str, start: str) -> tuple[str | None, str | None]:
        """The rule with the most host labels, then the longest path, that fits; or nothing."""
        node, best = self.root, (None, None)
        for label in reversed(name.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                best = self._path(node["/"], start.split("/")) or best
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for s in segments:
            fits = [n for n in node.get("lengths", ()) if s[:n] in node["ends"]]  # a lookup for each length that ends have
            if fits:
                best = node["ends"][s[: max(fits)]]
            node = node.get(("s", s))
            if node is None:
                break
        return best


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", max_trie_rules: int = TRIE_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url).

    rules: (verdict, host, path), as a list or a DataFrame with these columns.  A rule fits its
    host and all subdomains where the url's path starts with the rule's; the longest fitting
    rule decides (host first, then path), allow before block among equal ones, else default.

    Rules are collected into a broadcast trie only if there are at most max_trie_rules; larger
    lists are joined on host suffix and path prefix instead, with the same result.
    Null url or no "://": host and path empty, no rule.  Every row is kept, repeated ones too; an
    empty rule list gives the default; urls of any length are matched whole; extra columns are ignored.
    """
    spark = pages.sparkSession
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    if isinstance(rules, DataFrame):
        if rules.count() > max_trie_rules:
            return _joined(urls, rules, default)
        rules = [tuple(r) for r in rules.select("verdict", "host", "path").dropna().collect()]
    elif len(rules) > max_trie_rules:
        return _joined(urls, spark.createDataFrame(rules, "verdict string, host string, path string"), default)
    trie = spark.sparkContext.broadcast(RuleTrie(rules))

    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, starts in parts:
            yield pd.DataFrame([trie.value.match(n, p) for n, p in zip(names, starts)], columns=["rule", "verdict"])

    found = F.pandas_udf(judge, "rule string, verdict string")
    return urls.withColumn("found", found("host", "path")).select("page_id", "host", "path", "found.rule", F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


def _joined(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by joins: distinct (host, path) pairs meet rules on a host suffix and the part of
    the path up to a slash; the rest of the rule's path is a plain prefix test."""
    r = rules.dropna(subset=["verdict", "host", "path"]).select(
        "verdict", F.col("host").alias("suffix"), F.regexp_extract("path", r"(?s)^(.*/)?[^/]*$", 1).alias("lead"), F.concat("host", "path").alias("rule"), F.col("path").alias("start")
    )
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split("path", "/")
    leads = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    tried = pairs.select("host", "path", F.explode(suffixes).alias("suffix"), leads.alias("leads")).select("host", "path", "suffix", F.explode("leads").alias("lead"))
    hit = tried.join(r, ["suffix", "lead"]).where(F.expr("startswith(path, start)"))
    rank = F.struct(F.length("suffix"), F.length("start"), F.when(F.col("verdict") == "allow", 1).otherwise(0))
    best = hit.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("found"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", "found.rule", F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
