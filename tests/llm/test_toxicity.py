import itertools

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import toxicity


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 3)
    rng = np.random.default_rng(1)
    odds, trans = np.exp(rng.normal(size=8)), np.exp(rng.normal(size=(2, 2)))
    bounds = np.array([0, 0, 7, 8])
    got = toxicity.Chain(odds, bounds, trans)
    pairs = np.zeros((2, 2))
    for a, b in ((0, 7), (7, 8)):
        weight = np.zeros((b - a, 2))
        total = 0.0
        own = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.prod([trans[p, q] * (odds[a + i] if q else 1) for i, (p, q) in enumerate(zip((0, *y), y))])
            total += w
            for i, q in enumerate(y):
                weight[i, q] += w
            for p, q in zip((0, *y), y):
                own[p, q] += w
        assert np.allclose(got.marginals(8)[a:b], weight[:, 1] / total)
        pairs += own / total
    assert np.allclose(got.expected_pairs(), pairs)


def tables(spark, n=600):
    rng = np.random.default_rng(2)
    common = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for d in range(n):
        words, toxic = rng.choice(common, 60).tolist(), int(d % 5 == 0)
        if toxic:
            words[10:12] = ["nasty" + rng.choice(["a", "b", "c"]), "Nasty!"]
        docs.append((d, " ".join(words)))
        labels.append((d, toxic))
    more = [(-1, None), (-2, ""), (-3, "é nastyq, nasty" + " fine" * 30000)]
    return spark.createDataFrame(docs + more, "doc_id long, text string").withColumn("score", F.lit("x")), spark.createDataFrame(labels + [(-9, None), (-1, 1)], "doc_id long, toxic int")


def test_held_out_accuracy_and_offsets(spark):
    docs, labels = tables(spark)
    rows = toxicity.judge(docs, labels).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r.held_out and r.doc_id >= 0]
    assert len(held) > 80 and all((r.predicted == 1) == (r.doc_id % 5 == 0) for r in held)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[-1].score == by_id[-2].score < 0.3 and 0 <= by_id[-1].score
    assert [(s.start, s.end) for s in by_id[-3].spans] == [(2, 15)]
    kept = toxicity.keep_clean(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in rows)


def test_without_labels(spark):
    docs, labels = tables(spark, 20)
    assert {r.score for r in toxicity.judge(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.judge(docs.limit(0), labels).count() == 0


def test_repeated_rows_and_clashing_columns_score_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.train(docs, labels)
    one = {r.doc_id: (r.score, r.spans) for r in toxicity.score(docs, model).collect()}
    twice = docs.unionByName(docs).withColumns({"score": F.lit(1), "spans": F.lit("x"), "toxic": F.lit(1)})
    rows = toxicity.score(twice, model).collect()
    assert len(rows) == 120 and all(one[r.doc_id] == (r.score, r.spans) for r in rows)
    # Repeated labels and documents give the same model.
    again = toxicity.train(docs.unionByName(docs), labels.unionByName(labels))
    assert {r.doc_id: round(r.score, 9) for r in toxicity.score(docs, again).collect()} == {d: round(s, 9) for d, (s, _) in one.items()}
