"""Near-duplicate documents: MinHash, banding, verification on full sets, large-star/small-star."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import words as W
from seqloom.llm.components import components
from seqloom.llm.shared import among, keep, only_kept, row_key, small

#: Bands of minima that every document has, and those of the second family, for the nodes of open buckets.
BANDS, ROWS = 32, 5
LONG_BANDS, LONG_ROWS = 120, 12
#: Minima of the second family of which one bit each is kept; the bands' are among them.
SKETCH = 4096


def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def _sets(column: pa.Array, k: int):
    """For each block of rows: distinct sorted shingles, one after the other, and how many a row has."""
    for i, j, data, offs in W.chunks(column):
        w = W.words(data, offs)
        own = [np.unique(W.shingles(w.hashes[w.first[d] : w.first[d + 1]], k)) for d in range(j - i)]
        yield i, j, np.concatenate(own), np.array([len(x) for x in own])


def _minima(flat: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row for each hash function: its minima over the sets that begin at `at`."""
    x = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    low, y = np.empty((len(a), len(at)), np.uint32), np.empty_like(x)
    for h in range(len(a)):
        np.multiply(x, a[h], out=y)
        np.add(y, b[h], out=y)
        low[h] = np.minimum.reduceat(y, at)
    return low


def _band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((low.shape[1], bands), np.int64)
    for g in range(bands):
        key = np.full(low.shape[1], np.uint64(g + 1))
        for r in range(rows):
            key = W.mix(key ^ low[g * rows + r].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, g] = W.mix(key).view(np.int64)
    return keys


def _digests(flat: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """A 128-bit cryptographic digest of each whole sorted set; None for empty ones."""
    ends = np.cumsum(sizes)
    return [blake2b(flat[e - n : e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends, sizes)]


def _features(k: int, bands: int, rows: int):
    a, b = _family(bands * rows, 7)

    def run(batches):
        for batch in batches:
            for i, j, flat, sizes in _sets(batch.column("text"), k):
                full = np.flatnonzero(sizes)
                sig, keys = [b""] * (j - i), np.empty((0, bands), np.int64)
                if len(full):
                    low = _minima(flat, np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), a, b)
                    keys = _band_keys(low, bands, rows)
                    tops = np.ascontiguousarray((low >> np.uint32(24)).astype(np.uint8).T)
                    tops ^= np.ascontiguousarray((low & np.uint32(255)).astype(np.uint8).T)
                    for n, d in enumerate(full):
                        sig[d] = tops[n].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(i, j - i) for c in ("doc_id", "k1", "k2")),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(_digests(flat, sizes), pa.binary()),
                        W.list_array(pa.array(keys.ravel()), np.where(sizes == 0, 0, bands)),
                        pa.array(sig, pa.binary()),
                    ],
                    names=["doc_id", "k1", "k2", "n_shingles", "digest", "bands", "sig"],
                )

    return run


def _full_sets(k: int):
    def run(batches):
        for batch in batches:
            for i, j, flat, sizes in _sets(batch.column("text"), k):
                ends = np.cumsum(sizes)
                sets = [flat[e - n : e].tobytes() if n else None for e, n in zip(ends, sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(_digests(flat, sizes), pa.binary()), pa.array(sets, pa.binary())], names=["digest", "shingles"])

    return run


def _long_bands(bands: int, rows: int, sketch: int):
    """Keys of long bands, and one bit each of the first minima, of full sets."""
    a, b = _family(max(bands * rows, sketch), 11)

    def block(nodes: list[int], sets: list[np.ndarray]):
        at = np.cumsum([0] + [len(x) for x in sets[:-1]])
        low = _minima(np.concatenate(sets), at, a, b)
        bits = np.ascontiguousarray(np.packbits((low[:sketch] >> np.uint32(16)).astype(np.uint8).T & 1, axis=1)).view(np.int64)
        keys = _band_keys(low[: bands * rows], bands, rows)
        lists = (W.list_array(pa.array(x.ravel()), np.full(len(nodes), x.shape[1])) for x in (keys, bits))
        return pa.RecordBatch.from_arrays([pa.array(nodes), *lists], names=["node", "bands", "bits"])

    def run(batches):
        for batch in batches:
            nodes, sets, held = [], [], 0
            for node, x in zip(batch.column("node").to_pylist(), batch.column("shingles")):
                nodes.append(node)
                sets.append(np.frombuffer(x.as_buffer(), np.uint64))
                held += len(sets[-1])
                if held > W.BLOCK or len(nodes) == 512:
                    yield block(nodes, sets)
                    nodes, sets, held = [], [], 0
            if nodes:
                yield block(nodes, sets)

    return run


def _alike(percent: int):
    """Signature verification: drop pairs whose estimate lies over five deviations below the threshold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                p = percent / 100
                low = p - 5 * np.sqrt(p * (1 - p) / x.shape[1])
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= low))

    return run


def _confirm(percent: int):
    """Exact test on full shingle sets, in whole numbers."""

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for r, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                ok[r] = 100 * common >= percent * (len(p) + len(q) - common)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _sets_of(used: DataFrame, nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """node, shingles for the nodes in used (node), made again from one text of each."""
    wanted = keep(used.join(nodes.select("node", "digest", "k1", "k2"), "node"))
    sets = among(texts, keep(wanted.select("k1", "k2").distinct()), ["k1", "k2"]).select("text").mapInArrow(_full_sets(k), "digest binary, shingles binary")
    return keep(sets.join(small(wanted.select("node", "digest")), "digest").select("node", "shingles").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are alike enough."""
    n = nodes.select("node", "n_shingles", "sig")
    left, right = (n.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    near = pairs.join(left, "a").join(right, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    near = keep(near.select("a", "b", "sig_a", "sig_b").mapInArrow(_alike(percent), "a long, b long"))
    sets = _sets_of(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, texts, k)
    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    return keep(near.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"))


def _hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each node of a bucket (key, node, n) with the bucket's hub, the node that meets most others
    in all its buckets: what the others are copies of, if anything is."""
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    hubs = members.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node"))["node"].alias("hub"))
    pairs = members.join(hubs, "key").where("node <> hub")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the buckets (key) that hold more than one component (c)."""
    keys = rows.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("key")
    return rows.join(keys, "key")


def _open(members: DataFrame, groups: DataFrame) -> DataFrame:
    """key, node, c of buckets of three nodes or more that hold more than one component."""
    return _mixed(members.where("n > 2").select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")))


def _long_pairs(open_: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): nodes of different components (key, node, c) that share a long band and may be alike.

    Twelve minima agree for few pairs under the threshold, so a bucket holds a small part of a loose
    group.  Of these, pairs go whose sizes, or whose bits of 4,096 minima, differ more often
    than those of sets at the threshold do, with four deviations to spare.
    """
    used = keep(open_.select("node", "c").distinct())
    made = keep(_sets_of(used.select("node"), nodes, texts, k).mapInArrow(_long_bands(LONG_BANDS, LONG_ROWS, SKETCH), "node long, bands array<long>, bits array<long>"))
    flat = made.select("node", F.explode("bands").alias("key")).join(used, "node")
    sketches = made.join(nodes.select("node", "n_shingles"), "node").select("node", F.col("n_shingles").alias("n"), "bits")
    met = keep(_mixed(flat).join(sketches, "node"))
    x, y = (met.select("key", *(F.col(v).alias(f"{v}_{e}") for v in met.columns if v != "key")) for e in "xy")
    off = (1 - percent / 100) / 2  # of the bits of two sets at the threshold
    differ = int(SKETCH * off + 4 * (SKETCH * off * (1 - off)) ** 0.5)
    counted = "aggregate(zip_with(bits_x, bits_y, (p, q) -> bit_count(p ^ q)), 0, (n, d) -> n + d)"
    alike = f"node_x < node_y and c_x <> c_y and 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y) and {counted} <= {differ}"
    return x.join(y, "key").where(alike).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, k1, k2, n_shingles, group, component_id for every row of docs; see near_duplicates.

    k1 and k2 are the key of a row's doc_id and text, group names its component even where rows of
    other components have the same doc_id; group and component_id are null where the set is
    empty or doc_id null."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", *row_key())
    with only_kept(docs.sparkSession) as stay:
        rows_ = stay(texts.mapInArrow(_features(k, bands, rows), "doc_id long, k1 long, k2 long, n_shingles long, digest binary, bands array<long>, sig binary"))
        known = rows_.where("digest is not null and doc_id is not null")
        first = F.min(F.struct("doc_id", "k1", "k2")).alias("first")
        grouped = known.groupBy("digest").agg(first, *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sig")))
        nodes = keep(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("first.doc_id").alias("rep"), "first.k1", "first.k2", "n_shingles", "bands", "sig"))
        flat = nodes.select(F.explode("bands").alias("key"), "node")
        members = keep(flat.join(flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
        pairs = keep(_hub_pairs(members))
        links = _verified(pairs, nodes, texts, k, percent)
        groups = components(links)
        open_ = keep(_open(members, groups))
        if open_.head(1):
            more = keep(_long_pairs(open_, nodes, texts, k, percent))
            if more.head(1):
                groups = components(keep(links.unionByName(_verified(more, nodes, texts, k, percent))))
        least = groups.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
        linked = groups.join(least, "component")
        names = nodes.select("node", "digest", "rep").join(linked, "node", "left")
        of = stay(names.select("digest", F.coalesce("component", "node").alias("group"), F.coalesce("component_id", "rep").alias("component_id")))
    out = rows_.select("doc_id", "k1", "k2", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return out.join(small(of), "digest", "left").drop("digest")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Texts are lower-cased (A-Z) and split into words; a document's set holds its distinct k-word
    shingles, as 64-bit hashes.  Documents are linked where 100 * intersection >= percent * union,
    and component_id is the smallest doc_id that links reach.

    Sets that are equal become one node first, by a 128-bit cryptographic digest of the whole set, so
    copies never meet in a bucket.  A bucket's nodes are compared with the one that meets most others.  Where
    it then holds more than one component, the nodes of all such buckets get a second family of
    minima in longer bands, in which those of different components meet.  Candidates pass size,
    signature and full-set tests.  For a pair at exactly 0.8 the 32 bands of 5 are missed with
    a chance of 3 in a million, the 120 bands of 12 with 2 in 10,000, and bits fail it with 1 in
    30,000; more similar pairs are missed far less often.

    Null or wordless text: an empty set, linked with nothing, kept.  Null doc_id: component null,
    kept, linked with nothing.  doc_id is cast to long (a text that is no number: null).  Rows
    repeated under one doc_id each get their row; copies under one doc_id have the same
    component.  Very long texts are cut into words as a whole, their set in one task's memory (8
    bytes a word).  Other columns are ignored; an empty table gives no rows.
    """
    out = near_groups(docs, k, percent, bands, rows)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
