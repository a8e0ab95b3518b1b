import random

import corpus_pipeline
from plain import shingles
from test_neardup import near_copies

from tallyframe.llm import neardup


def pairs():
    """Texts 2k and 2k + 1 are similar by 0.70 to 0.92; no other two share a shingle."""
    draw, texts = random.Random(5), {}
    for k in range(24):
        base = [f"p{k}w{i}" for i in range(120 + k)]
        own = list(base)
        n = 6 + 2 * (k % 8)
        own[-n:] = [f"p{k}x{draw.random()}" for _ in range(n)]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(own)
    return texts


def similar(texts, k):
    a, b = shingles(texts[2 * k]), shingles(texts[2 * k + 1])
    return 100 * len(a & b) / len(a | b)


def test_the_stage_drops_pairs_from_80_on_and_op7_keeps_its_85(spark):
    texts = pairs()
    at = {2 * k + 1: similar(texts, k) for k in range(24)}
    assert sum(80 <= x < 85 for x in at.values()) >= 4 and min(at.values()) < 80 and max(at.values()) >= 85
    rows = [(d, t, "en", "s", len(t)) for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert set(texts) - kept == {d for d, x in at.items() if x >= 80}
    assert {r.doc_id for r in neardup.near_duplicates(docs).collect() if not r.kept} == {d for d, x in at.items() if x >= 85}


def test_blocks_hold_pairs_against_the_same_percent(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    texts = near_copies()
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    near = [(a, b) for a in texts for b in texts if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while any(root[a] != root[b] for a, b in near):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, percent=80).collect()} == root
