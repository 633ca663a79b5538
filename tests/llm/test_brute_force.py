"""Operators that SQL cannot express against plain versions, and on hostile tables."""

import base64
import hashlib
import itertools
import json
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from seqloom.llm import decontaminate, line_dedup, passages, secrets, shared
from seqloom.llm.chat import chat_digests, format_chats
from seqloom.llm.lm_score import lm_scores
from seqloom.llm.mixing import mix_sources
from seqloom.llm.near_dedup import near_duplicates
from seqloom.llm.quality import Rule, good_documents, learn, quality_filter
from seqloom.llm.queries import _events
from seqloom.llm.url_filter import filter_urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = "doc_id long, text string"


def prose(seed, n, v=4000):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, v, n))


def brute_lines(rows, depth=3, least=8):
    """Texts without recurring lines, by the docstrings' words."""
    found, leaves = [], defaultdict(list)
    for d, (i, text) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            words = WORD.findall(line)
            if words:
                masked = tuple("<*>" if re.search("[0-9]", w) else w for w in words)
                exact = 2 * masked.count("<*>") > len(words)
                found.append((d, n, tuple(words) if exact else masked))
                if len(words) > depth and not exact:
                    leaves[(len(words), masked[:depth])].append(found[-1])
    names = defaultdict(set)
    for leaf, lines in leaves.items():
        votes = Counter((p, w) for _, _, form in lines for p, w in enumerate(form) if p >= depth and w != "<*>")
        for form in {f for _, _, f in lines}:
            for level, most in enumerate((0, 0.1, 0.6)):
                fixed = tuple((p, w) for p, w in enumerate(form) if votes.get((p, w), 0) >= max(least, most * len(lines)))
                if 2 * len(fixed) > len(form) - depth:
                    names[form].add((leaf, level, fixed))
    stands = defaultdict(set)
    for d, n, form in found:
        for t in {form} | names[form]:
            stands[t].add(d)
    gone = set()
    order = sorted(range(len(rows)), key=lambda d: (rows[d][0] is None, rows[d][0] or 0))
    for d, n, form in found:
        for t in {form} | names[form]:
            if len({rows[x][1] for x in stands[t]}) >= least and min(stands[t], key=order.index) != d:
                gone.add((d, n))
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, (i, t) in enumerate(rows)}


def test_line_dedup_equals_brute_force(spark):
    rows = []
    for i in range(40):
        lines = [prose(i, 12), f"Page {i % 7 + 1} of 10", f"Tel: 555-0{i:03d}", "12 34 56" if i % 2 else f"{i} {i + 1} {i + 2}"]
        lines += ["Read more about %s on this site" % prose(500 + i, 1)] if i < 30 else ["Read more about how %s gets refunds" % prose(600 + i, 1)]
        lines += [prose(900 + i, 9), "Imprint", "", "About us and our partners", "Legal notice of the house", "Cookies are used here", "Back to top"]
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[3][1]) for i in range(9)] + [(200 + i, f"{prose(700 + i, 8)}\nRead more about how {prose(800 + i, 1)} gets refunds") for i in range(20)]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, PLAIN)).collect()}
    want = brute_lines(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert want[9] == "\n".join([prose(9, 12), prose(909, 9), ""]) and want[205] == prose(705, 8) and want[8].startswith(prose(8, 12) + "\n8 9 10\n")


def test_line_dedup_query_equals_brute_force(spark):
    docs = shared.table(spark, SF, "documents")
    want = brute_lines([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], least=3)
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs, min_docs=3).collect()}
    assert got == want


def test_passages_recall_against_brute_force(spark):
    """Passages of 55 to 90 words that several documents share with substitutions, found by nine in ten at least."""
    r, rows, plants = np.random.default_rng(8), [], defaultdict(list)
    for p in range(30):
        words = prose(3000 + p, int(r.integers(55, 90))).split()
        for copy in range(int(r.integers(2, 6))):
            own = list(words)
            for at in r.choice(len(own), int(r.integers(0, 3)), replace=False):
                own[at] = f"s{r.integers(0, 999)}"
            i = len(rows)
            rows.append((i, f"{prose(4000 + i, int(r.integers(0, 120)))} {' '.join(own)} {prose(5000 + i, int(r.integers(0, 120)))}"))
            plants[p].append(i)
    clean = [(1000 + i, prose(6000 + i, 200)) for i in range(30)]
    got = passages.repeated_passages(spark.createDataFrame(rows + clean, PLAIN)).collect()
    texts = {i: t.split() for i, t in rows + clean}
    for x in got:  # every row is a passage of which the shingles agree
        a, b = texts[x.doc_id][x.start : x.end], texts[x.other_id][x.other_start : x.other_end]
        p, q = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert 100 * len(p & q) >= 80 * len(p | q)
    linked = {x.doc_id for x in got} | {x.other_id for x in got}
    alike = set()
    for own in plants.values():  # brute force: the whole plants of two documents are alike enough
        sets = {i: texts[i] for i in own}
        grams = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in sets.items()}
        for a in own:
            for b in own:
                n = len(grams[a] & grams[b])
                if a < b and n >= 0.9 * 51:
                    alike |= {a, b}
    assert len(alike) > 60 and len(alike & linked) >= 0.9 * len(alike)
    assert not linked & {i for i, _ in clean}


def test_passages_of_repeated_and_missing_ids(spark):
    """Every text of an id is looked at, and rows without one."""
    planted = [prose(900 + i, 80, 5000) for i in range(5)]
    rows = [(1, f"{prose(1, 40)} {planted[0]}"), (1, f"{prose(2, 40)} {planted[1]}"), (1, f"{prose(3, 40)} {planted[2]}"), (None, f"{planted[3]} {prose(4, 30)}"), (None, f"{prose(5, 30)} {planted[4]}")]
    rows += [(10 + i, f"{prose(20 + i, 60)} {p} {prose(40 + i, 60)}") for i, p in enumerate(planted)] + [rows[0], (None, None)]
    got = passages.repeated_passages(spark.createDataFrame(rows, PLAIN)).collect()
    assert {tuple(sorted((r.doc_id or 0, r.other_id or 0))) for r in got} == {(1, 10), (1, 11), (1, 12), (0, 13), (0, 14)}
    assert all(r.end - r.start >= 70 for r in got)


def overlaps_somewhere(doc, item, window=13, share=0.8):
    run = min(window, len(item))
    need = -(-run * share // 1)
    for start in range(-len(item) + 1, len(doc)):
        equal = [0 <= start + j < len(doc) and doc[start + j] == item[j] for j in range(len(item))]
        if any(sum(equal[p : p + run]) >= need for p in range(len(item) - run + 1)):
            return True
    return False


def test_contamination_equals_brute_force(spark):
    r = np.random.default_rng(4)
    items = [(i, prose(100 + i, int(r.integers(13, 40)))) for i in range(12)] + [(20, "alpha beta gamma delta"), (21, "only two"), (22, "What holds 6 words and more?")]
    shared_start = prose(77, 20)
    items += [(30 + i, f"{shared_start} {prose(300 + i, 15)}") for i in range(20)]
    rows = []
    for i, (_, text) in enumerate(items):
        words = text.split()
        for k in range(3):
            own = [f"x{i}" if r.random() < 0.09 * k else w for w in words]
            rows.append((len(rows), f"{prose(1000 + len(rows), 30)} {' '.join(own).upper()} {prose(2000 + len(rows), 30)}"))
    rows += [(500 + i, f"{prose(4000 + i, 20)} {shared_start} {prose(5000 + i, 20)}") for i in range(30)]
    rows += [(600 + i, prose(7000 + i, 100)) for i in range(30)] + [(700, "Only TWO"), (701, "not only two words"), (702, None), (703, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(spark.createDataFrame(rows, PLAIN), bench).collect()
    got = {x.doc_id: x for x in found}
    lower = {i: t.lower().split() for i, t in items}
    want = {i for i, t in rows if any(overlaps_somewhere((t or "").lower().split(), w) for w in lower.values())}
    assert set(got) <= want and len(want - set(got)) <= 0.03 * len(want)
    assert {500 + i for i in range(30)} | {700, 701} <= set(got) and got[500].n_items == 20
    assert all(overlaps_somewhere(rows_text.lower().split(), lower[got[i].item_id]) for i, rows_text in rows if i in got)


def test_contamination_names_every_item(spark):
    """Short items anywhere in a text, two items in one, and an item whose seeds all are a smaller item's, too."""
    a, b, common = prose(201, 30), prose(202, 30), prose(203, 9)
    c, d = f"{prose(204, 15)} {common} {prose(205, 4)}", f"{common} {prose(206, 20)}"
    items = [(1, a), (2, b), (3, "yes indeed"), (4, "zzz"), (5, c), (6, d), (7, "solo word here")]
    texts = {1: f"{prose(211, 20)} {a} {prose(212, 9)} {b}", 2: "prefix Yes indeed suffix and more", 3: "yes and indeed", 4: "w zzz w", 5: f"{b} {prose(213, 20)} {common} {' '.join(d.split()[9:15])} x", 6: "a solo word here it is", 7: prose(214, 60)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(list(texts.items()), PLAIN), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (1, 2), (2, 3), (4, 4), (5, 2), (5, 6), (6, 7)}
    assert {r.start for r in got if r.doc_id == 1} == {20, 59}


def naive_base(text):
    """The contract's base kinds, character by character for the two simple ones."""
    out = []
    for kind, inside, begin, least in (("access", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "AKIA", 20), ("hex", set("0123456789abcdef"), "", 24)):
        i = 0
        while i < len(text):
            j = i
            if text.startswith(begin, i):
                j = i + len(begin)
                while j < len(text) and text[j] in inside:
                    j += 1
            if j > i + len(begin) or (begin == "" and j > i):
                if j - i >= least:
                    out.append((i, kind, j))
                i = j
            else:
                i += 1
    i = 0
    head = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", re.IGNORECASE | re.ASCII)
    while m := head.search(text, i):
        j = m.end()
        while j < len(text) and re.match(r"[A-Za-z0-9+/_.=-]", text[j]):
            j += 1
        if j == m.end():
            m2 = secrets.ASSIGN.match(text, m.start())
            i = m2.end() if m2 else m.start() + 1
            if m2 and len(m2[2]) >= 6:
                out.append((m2.start(), "assign", m2.end()))
            continue
        if j - m.end() >= 6:
            out.append((m.start(), "assign", j))
        i = j
    rank = {k: n for n, k in enumerate(secrets.KINDS)}
    return sorted(out, key=lambda x: (x[0], rank[x[1]]))


def test_secrets_query_equals_naive_scan(spark):
    docs = shared.table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    seen = Counter()
    for d in docs.collect():
        base = naive_base(d.text or "")
        seen.update(k for _, k, _ in base)
        want = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (d.doc_id, want, r.spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, x, _ in base) for k in ("assign", "access", "hex"))
    assert naive_base("api_key = 'abcdef' AKIA" + "B" * 16 + " " + "0f" * 12) == [(0, "assign", 17), (19, "access", 39), (40, "hex", 64)]


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def test_secret_structures():
    b64 = lambda x: base64.b64encode(x).decode()
    dsa = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([i + 1]) * 40) for i in range(5)))
    locked = der(0x30, der(0x30, der(6, b"\x2a\x86\x48") + der(0x30, b"")) + der(4, b"z" * 60))
    ec = der(0x30, der(2, b"\1") + der(4, b"k" * 32) + der(0xA0, der(6, b"\x2a")))
    kinds = lambda t: [k for _, _, k in secrets.scan(t)]
    assert kinds(b64(dsa)) == ["der"] and kinds(b64(locked)) == ["der"] and kinds(f"-----BEGIN ENCRYPTED PRIVATE KEY-----\n{b64(locked)}\n-----END ENCRYPTED PRIVATE KEY-----") == ["pem"]
    assert kinds(ec.hex().upper()) == ["der"] and kinds(ec.hex()) == ["hex", "der"]
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{b64(b'q' * 64)}\n-----END RSA PRIVATE KEY-----") == ["pem"]
    deep = "ey" + base64.urlsafe_b64encode(b'{"alg":' + b'{"a":' * 100_000).decode().rstrip("=")
    assert kinds(deep + ".e30.x") == [] and not secrets.is_jwt(base64.urlsafe_b64encode(b"[" * 100_000).decode() + ".e30.x")
    assert kinds(b64(b"n" * 60)) == [] and kinds(b64(der(0x30, der(2, b"\0") + der(2, b"\1")))) == []
    token = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"typ": "JWT"}, {"sub": "1"})) + ".c2ln"
    assert kinds(token) == []


def test_learned_lists_have_both_classes_and_go_on():
    r = np.random.default_rng(0)
    import pandas as pd

    x = pd.DataFrame({"a": r.random(900), "b": r.random(900), "c": r.random(900)})
    bad = ((x.a > 0.8) & (x.b > 0.5)) | ((x.c < 0.15) & (x.a < 0.4))
    rules = learn(x, (~bad).astype(int).to_numpy())
    assert len(rules) >= 2 and {len(q.conditions) for q in rules} & {2, 3} and any(not q.keep for q in rules)
    said, open_ = np.ones(900, bool), np.ones(900, bool)
    for q in rules:
        m = q.mask(x) & open_
        said[m], open_ = q.keep, open_ & ~m
    assert (said != bad.to_numpy()).mean() > 0.95
    assert learn(x, np.ones(900, int)) == []


CLASH = ["k1", "k2", "row", "dropped", "n_dropped", "group", "key", "node", "words", "item", "seed", "place", "leaf", "form", "_text", "n_words", "size", "id", "_maybe", "kept", "_0", "target"]


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls, ties, repeated rows, very long texts and columns whose names clash."""
    long = [("x" * 300_000), prose(1, 60_000), "\n".join(["same line here again"] * 20_000)]
    rows = [(i, t) for i, t in enumerate([*long, None, "", " \n", prose(2, 80), prose(2, 80), prose(3, 80)])]
    rows += [rows[6], (None, prose(2, 80)), (None, None), (8, prose(5, 90)), (8, "two words")]
    df = spark.createDataFrame(rows, PLAIN).select("*", F.lit("en").alias("lang"), F.when(F.col("doc_id") % 2 == 0, "a").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(2)


def test_operators_on_hostile_tables(spark, hostile):
    n, none = hostile.count(), hostile.limit(0)
    bench = spark.createDataFrame([(1, prose(3, 80)), (None, "x y"), (2, None)], "item_id long, text string").select("*", *(F.lit("clash").alias(c) for c in CLASH))
    assert line_dedup.drop_recurring_lines(hostile).columns == [c for c in hostile.columns if c != "n_dropped"] + ["n_dropped"]
    for op in (near_duplicates, line_dedup.drop_recurring_lines, mix_sources, lambda d: quality_filter(d, []), lm_scores, secrets.find_secrets):
        assert op(hostile).count() == n and op(none).count() == 0
    rows = passages.repeated_passages(hostile).collect()  # id 6, a repeated row and one without an id have one text
    assert {(r.doc_id, r.other_id) for r in rows if r.start == 0 and r.end == 80 and r.similarity == 1.0} == {(7, 6), (None, 6)} and passages.repeated_passages(none).count() == 0
    hits = decontaminate.contamination(hostile, bench).collect()
    assert {r.doc_id for r in hits} == {8} and decontaminate.contamination(hostile, bench.limit(0)).count() == 0
    keep_all = good_documents(hostile, [Rule((("n_words", ">", 0.0),), True)])
    assert keep_all.columns == hostile.columns and keep_all.where("doc_id is null").count() == 1


def test_chat_and_urls_on_hostile_tables(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, None), (None, None, "assistant", "z" * 200_000), (2, 1, "assistant", "é\\</turn>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit("clash").alias("way"))
    got = {r.conv_id: r for r in chat_digests(format_chats(_events(df))).collect()}
    assert (got[1].n_turns, got[None].loss_chars, got[2].loss_sha256) == (3, 200_000, hashlib.sha256("é\\</turn>".encode()).hexdigest())
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\nuser\na\nuser\na\n").hexdigest()
    assert chat_digests(format_chats(_events(df.limit(0)))).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        format_chats(spark.createDataFrame([(1, 0, 0, "odd", "user", "hi")], "conv_id long, msg long, seq long, kind string, role string, text string")).collect()
    pages = spark.createDataFrame([(1, "http://a.net/" + "p/" * 50_000), (1, "http://a.net/" + "p/" * 50_000), (None, None)], "page_id long, url string").select("*", F.lit("clash").alias("host"), F.lit("clash").alias("rule"))
    rules = [("block", "net", "/"), ("allow", "net", "/p/p/")]
    out = filter_urls(pages, rules)
    assert [(r.page_id, r.verdict) for r in out.orderBy("page_id").collect()] == [(None, "allow"), (1, "allow"), (1, "allow")] and filter_urls(pages.limit(0), rules).count() == 0


def stage_rows(df):
    return sorted(map(str, df.collect()))


def test_stages_judge_rows_not_ids(spark):
    good, other = prose(11, 90), prose(12, 90)
    item = next(r.text for r in shared.table(spark, SF, "benchmark").collect())
    near = good.split()
    near[40] = "swap"
    rows = [(5, good), (5, "two words"), (6, other), (6, other), (None, prose(13, 90)), (7, " ".join(near)), (None, f"{prose(14, 50)} {item}"), (9, None), (5, prose(15, 70))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    judged = P.quality_rules(spark, docs, SF)
    left = Counter((r.doc_id, r.text) for r in judged.collect())
    assert (5, "two words") not in left and (9, None) not in left and left[(6, other)] == 2 and left[(5, good)] == 1 and left[(None, prose(13, 90))] == 1
    once = Counter((r.doc_id, r.text) for r in P.near_dedup(spark, judged, SF).collect())
    assert once[(6, other)] == 1 and once[(5, good)] + once[(7, " ".join(near))] == 1 and once[(5, prose(15, 70))] == 1 and sum(v for (i, _), v in once.items() if i is None) == 2
    pure = {(r.doc_id, r.text) for r in P.decontamination(spark, judged, SF).collect()}
    assert not any(item in t for _, t in pure) and (None, prose(13, 90)) in pure and len(pure) == len(left) - 1
    want = [stage_rows(f(spark, docs, SF)) for f in (P.near_dedup, P.line_dedup, P.decontamination)]
    spark.conf.set(shared.BROADCAST_SETTING, "0")
    try:  # tables of keys that are too large to send give the same rows
        assert [stage_rows(f(spark, docs, SF)) for f in (P.near_dedup, P.line_dedup, P.decontamination)] == want
    finally:
        spark.conf.unset(shared.BROADCAST_SETTING)
    empty = docs.limit(0)
    assert all(f(spark, empty, SF).count() == 0 for _, f in P.STAGES)


def test_blocks_of_other_threads_are_apart(spark):
    import threading

    began, ended, seen = threading.Event(), threading.Event(), []

    def other():
        with shared.only_kept(spark):
            mine = shared.keep(spark.range(5))
            began.set()
            ended.wait(60)
            seen.append(mine.count())

    worker = threading.Thread(target=other)
    with shared.only_kept(spark) as stay:
        worker.start()
        assert began.wait(60)
        kept = stay(spark.range(6))
    ended.set()
    worker.join(60)
    assert seen == [5] and kept.count() == 6


def test_blocks_within_blocks(spark):
    with shared.only_kept(spark) as outer:
        with shared.only_kept(spark) as inner:
            lost, half = shared.keep(spark.range(2)), inner(spark.range(3))
        with pytest.raises(Exception):
            lost.collect()
        whole = outer(half)
    assert whole.count() == 3
    with pytest.raises(Exception):
        half.collect()


def test_tables_are_deleted_and_folders_shared(spark):
    with shared.only_kept(spark) as stay:
        gone = shared.keep(spark.range(3))
        kept = stay(spark.range(4))
    assert kept.count() == 4
    with pytest.raises(Exception):
        gone.collect()
    keys = shared.keep(spark.range(0, 5000, 7).withColumnRenamed("id", "k"))
    df = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("_b"))
    spark.conf.set(shared.BROADCAST_SETTING, "0")
    try:
        inside, outside = (shared.among(df, keys, ["k"], x) for x in (True, False))
        assert inside.columns == outside.columns == ["k", "_b"] and {r.k for r in inside.collect()} == set(range(0, 5000, 7)) and outside.count() == 5000 - inside.count()
    finally:
        spark.conf.unset(shared.BROADCAST_SETTING)


@pytest.mark.parametrize("size", range(1, 20))
def test_some_mask_fits_every_overlap(size):
    masks, run = decontaminate.masks_for(size), min(size, 13)
    for bad in itertools.combinations(range(run), run - int(np.ceil(run * 0.8))):
        assert any(all(m[p - at] == "0" for p in bad if at <= p < at + len(m)) for m in masks for at in range(run - len(m) + 1))


def test_contamination_leaves_no_pair_out(spark):
    """Every pair of a text and an item, of items that share a passage, are short or alike, too."""
    r = np.random.default_rng(9)
    common = prose(801, 16)
    items = [(i, f"{common} {prose(810 + i, 9)}") for i in range(8)] + [(100 + m, prose(830 + m, m)) for m in range(2, 14)] + [(200, f"{common} {prose(810, 9)}")]
    rows = [(i, f"{prose(850 + i, 12)} {common} {prose(870 + i, 12)}") for i in range(6)]
    for _, text in items[8:20]:
        words = text.split()
        for k in range(len(words)):
            own = [f"other{k}" if j == k or (len(words) > 9 and j == (k + 2) % len(words)) else w for j, w in enumerate(words)]
            rows.append((len(rows), " ".join([prose(900 + len(rows), int(r.integers(3, 9))), *own, prose(1900 + len(rows), 5)])))
    got = decontaminate.contamination(spark.createDataFrame(rows, PLAIN), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(i, k) for i, t in rows for k, item in items if overlaps_somewhere(t.lower().split(), item.lower().split())}
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want) and {(3, i) for i in (*range(8), 200)} <= want


def test_passages_behind_the_hubs(spark):
    """Documents whose windows stand in a line that many others have, too, before those that share their passage."""
    line = prose(600, 38)
    rows = [(i, f"{prose(610 + i, 60)} {line} {prose(640 + i, 60)}") for i in range(12)]
    for i in range(30):
        passage = f"{prose(700 + i, 12)} {line} {prose(740 + i, 12)}"
        rows += [(100 + 2 * i + k, f"{prose(800 + 2 * i + k, 30)} {passage} {prose(900 + 2 * i + k, 30)}") for k in (0, 1)]
    docs = spark.createDataFrame(rows, PLAIN)
    some, every = ({tuple(sorted((x.doc_id, x.other_id))) for x in passages.repeated_passages(docs, hashes=2, hubs=1, rest=rest).collect()} for rest in (False, True))
    want = {(100 + 2 * i, 101 + 2 * i) for i in range(30)}
    assert some < every and want == every


def test_windows_of_one_document_are_not_written(spark, monkeypatch):
    r = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" for x in r.integers(0, 1 << 40, 400))) for i in range(40)]
    rows.append((40, rows[3][1][:900] + " and an end of its own"))
    written = []
    monkeypatch.setattr(passages, "keep", lambda df, keep=passages.keep: (out := keep(df), written.append(out.count() if "key" in out.columns else 0))[0])
    got = passages.repeated_passages(spark.createDataFrame(rows, PLAIN)).collect()
    assert {(x.doc_id, x.other_id) for x in got} == {(40, 3)}
    assert 0 < max(written) < 400  # thousands of windows, of which those of one passage meet
