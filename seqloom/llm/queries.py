"""The operators as queries over the synthetic tables, one for each, with their SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.centroids import cluster
from seqloom.llm.chat import chat_digests, format_chats
from seqloom.llm.decontaminate import contamination
from seqloom.llm.filter_audit import audit_text_filters
from seqloom.llm.fingerprint import edited_fingerprints
from seqloom.llm.line_dedup import drop_recurring_lines
from seqloom.llm.lm_score import lm_scores
from seqloom.llm.mixing import mix_sources
from seqloom.llm.near_dedup import near_duplicates
from seqloom.llm.passages import repeated_passages
from seqloom.llm.quality import learn_rules, quality_filter
from seqloom.llm.secrets import find_secrets
from seqloom.llm.shared import table
from seqloom.llm.url_filter import filter_urls

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A conversation whose texts hold the template's own control strings.
HOSTILE = r"\### Assistant: </turn> ok"


def _events(rows: DataFrame) -> DataFrame:
    """A log that folds into rows (conv_id, turn, role, text): by a hash of its place, a row arrives whole,
    as a stream of two deltas, as a draft that is edited, or as one that is thrown away and made anew."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length("text") / 2).cast("int")
    a, b = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def log(*events: tuple) -> Column:
        return F.array(*(F.struct(F.lit(kind).alias("kind"), part.alias("text")) for kind, part in events))

    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    events = F.when(way == 0, log(("message", F.col("text")))).when(way == 1, log(("message", a), ("delta", b)))
    events = events.when(way == 2, log(("message", b), ("edit", a), ("delta", b)))
    events = events.otherwise(log(("message", b), ("delta", a), ("regenerate", F.lit("")), ("delta", a), ("delta", b)))
    numbered = rows.withColumn("text", text).withColumn("msg", F.monotonically_increasing_id())
    return numbered.select("conv_id", "turn", "msg", "role", F.posexplode(events).alias("seq", "e")).select(
        "conv_id", "turn", "msg", "seq", "e.kind", F.when(F.col("e.kind") == "message", F.col("role")).alias("role"), "e.text"
    )


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], rows.schema)
    return chat_digests(format_chats(_events(rows.unionByName(own))))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality_filter(docs, learn_rules(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_text_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


_OPERATORS = (
    op1_chat, op2_url_filter, op3_near_dedup, op4_line_dedup, op5_substring_dedup, op6_mixing, op7_quality,
    op8_lm_score, op9_decontamination, op10_secrets, op11_fingerprint, op12_filter_audit, op13_centroids,
)


def queries() -> dict:
    return {f.__name__: f for f in _OPERATORS}


_OP2 = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT p.*, r.verdict, rhost || rpath AS rule,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC) AS rank
  FROM p LEFT JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE rank = 1
"""


_OP1 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       cast(sum(14 + length(role) + length(text) + len(regexp_extract_all(role, '[\\<:\n]|###')) + len(regexp_extract_all(text, '[\\<]|###'))) AS bigint) AS formatted_chars
FROM t GROUP BY conv_id
"""


_OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(shingle) AS h, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c AS (SELECT doc_id AS node, doc_id AS first FROM documents UNION SELECT l.y, c.first FROM c JOIN l ON l.x = c.node WHERE c.first < l.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.first AS component_id, m.first = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(first) AS first FROM c GROUP BY 1) m ON m.node = d.doc_id
"""


_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
m AS (SELECT text, min(doc_id) AS first FROM d GROUP BY 1),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
w AS (SELECT d.*, first, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM d JOIN m USING (text) LEFT JOIN l USING (doc_id)),
b AS (SELECT part, good, toxic, (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
        + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int AS bits FROM w),
p AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM b GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT *, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0)::int AS passed
      FROM (SELECT filter_order, unnest(range(1, 6))::int AS step FROM o)),
t AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (bits & (passed | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (bits & passed = 0 AND bits & own <> 0), 0) AS removed,
        coalesce(sum(n) FILTER (bits & passed <> 0 AND bits & own <> 0), 0) AS redundant, coalesce(sum(n) FILTER (bits = own), 0) AS unique_fails,
        coalesce(sum(good) FILTER (bits & passed = 0 AND bits & own <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (bits & passed = 0 AND bits & own <> 0), 0) AS toxic_lost FROM s, p GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley FROM t
"""


def _op13(rounds: int = 3) -> str:
    nearest = "SELECT r, vec_id, v, j, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, j) AS place FROM (SELECT r, vec_id, v, j, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint AS d FROM v, c{0})) WHERE place = 1"
    floors = "SELECT j, list(((s - ((s % n) + n) % n) // n)::bigint ORDER BY i) AS c FROM (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{0}) GROUP BY 1, 2) GROUP BY 1"
    steps = [f"a{i} AS MATERIALIZED ({nearest.format(i)}), c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN ({floors.format(i)}) m USING (j))" for i in range(rounds)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM v QUALIFY j < 16),
{', '.join(steps)}, a{rounds} AS MATERIALIZED ({nearest.format(rounds)})
SELECT vec_id, j::int AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::bigint AS cluster_inertia, (sum(d) OVER ())::bigint AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (j)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": _OP1, "op2_url_filter": _OP2, "op3_near_dedup": _OP3, "op12_filter_audit": _OP12, "op13_centroids": _op13()}
