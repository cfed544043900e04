"""The pipeline's stages take effect, each on all that the one before it kept."""

from collections import Counter

import corpus_pipeline
from scimap.llm import simhash
from scimap.llm.common import table, written

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF))
        assert docs.columns == columns
        kept[name] = docs.collect()
    good = {r.doc_id for r in kept["quality classifier"]}
    assert sum(labels[i] for i in labels if i in good) >= 0.97 * sum(labels.values())
    assert sum(i in good for i, q in labels.items() if not q) <= 0.05 * sum(1 - q for q in labels.values())
    assert [r.doc_id for r in sorted(kept["line dedup"])] == sorted(good)
    lines = Counter(k for r in kept["line dedup"] for k in {x.strip(" \t\n\x0b\x0c\r").lower() for x in r.text.split("\n")} - {""})
    assert max(lines.values()) < 10
    prints = sorted(simhash.fingerprint(r.text) & (1 << 64) - 1 for r in kept["simhash near-dedup"])
    assert len(set(prints)) == len(prints)
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[i + 1 :])
    ids = {r.doc_id for r in kept["simhash near-dedup"]}
    times = Counter(r.doc_id for r in kept["source mix"])
    assert set(times) <= ids and max(times.values()) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in last) == times
