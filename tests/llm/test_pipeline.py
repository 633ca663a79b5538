"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline as P
from seqloom.llm.shared import keep, table

SF = "/root/testdata/sf0.01"


def test_pipeline_stages(spark):
    docs, seen = table(spark, SF, "documents"), {}
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = keep(stage(spark, docs, SF))
        after = docs.collect()
        seen[name] = (before, after)
        if name != "mixing":
            assert docs.columns == P.COLUMNS
        assert {r.doc_id for r in after} <= set(before)
    before, after = seen["line_dedup"]
    assert len(after) == len(before)
    before, after = seen["near_dedup"]
    texts = [" ".join((r.text or "").lower().split()) for r in after]
    texts = [t for t in texts if t]
    assert len(texts) == len(set(texts)) and {t for t in (" ".join((x or "").lower().split()) for x in before.values()) if t} >= set(texts)
    items = [" ".join(r.text.split()) for r in table(spark, SF, "benchmark").collect()]
    flat = [" ".join((r.text or "").split()) for r in seen["decontamination"][1]]
    assert not any(i in t for i in items for t in flat) and len(flat) > 0.8 * len(seen["decontamination"][0])
    assert all(r.taken <= 2 * r.size for r in seen["mixing"][1]) and len(seen["mixing"][1]) == len(seen["mixing"][0])
