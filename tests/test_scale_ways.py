"""The ways that operators take beyond their broadcast bounds: same rows, little exchanged."""

import random
import re
import statistics

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyframe.operators import bootstrap as B
from tallyframe.operators import corpus as C
from tallyframe.operators import groups as G
from tallyframe.operators import ngrams as N
from tallyframe.operators import requests as R


def shuffled_rows(df):
    """Rows written to exchanges while ``df`` runs."""
    plan = df._jdf.queryExecution()
    df.collect()
    text = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("Exchange"):
            text.append(int(node.metrics().apply("shuffleRecordsWritten").value()))
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in name:
            walk(node.plan())

    walk(plan.executedPlan())
    return sum(text)


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    for bits in (1 << 15, N.BLOOM_BITS):
        test = N.bloom_filter(keys, "h", bits)
        hit = spark.range(20000).select("id", test(F.xxhash64("id")).alias("hit"))
        assert hit.filter("id < 5000 AND NOT hit").count() == 0
        wrong = hit.filter("id >= 5000 AND hit").count()
        assert wrong < (15000 if bits == 1 << 15 else 1500)
    none = N.bloom_filter(keys.limit(0), "h")
    assert spark.range(50).filter(none(F.xxhash64("id"))).count() == 0


def test_beyond_the_bound_few_ngrams_travel(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    corpus = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(300)], "id long, text string")
    texts = [r.text for r in corpus.limit(3).collect()]
    bench = spark.createDataFrame([(i, t[20:200]) for i, t in enumerate(texts)] + [(9, "q r s t u v"), (10, None)], "item long, text string")
    grams = N.word_ngrams(bench, ["item"], "text", 5).distinct()
    seen = N.word_ngrams(corpus, [], "text", 5)
    small = sorted(map(tuple, N.match_ngrams(seen, grams).collect()))
    docs_small = sorted(map(tuple, N.documents_with_ngrams(corpus, ["id"], "text", grams, 5).collect()))
    clean_small = sorted(map(tuple, N.clean_corpus(corpus, "id", "text", grams, 5, 20, 10, 20).collect()))
    monkeypatch.setattr(N, "is_small", lambda df, cols, limit=0: False)
    large = N.match_ngrams(seen, grams)
    assert sorted(map(tuple, large.collect())) == small and small
    assert shuffled_rows(N.match_ngrams(seen, grams)) < seen.count() / 10
    assert sorted(map(tuple, N.documents_with_ngrams(corpus, ["id"], "text", grams, 5).collect())) == docs_small
    assert sorted(map(tuple, N.clean_corpus(corpus, "id", "text", grams, 5, 20, 10, 20).collect())) == clean_small
    # Texts without hits are not exchanged.
    assert shuffled_rows(N.clean_corpus(corpus, "id", "text", grams, 5, 20, 10, 20)) < 150


@pytest.mark.parametrize("distinct", [True, False])
def test_sketch_guides_the_exact_count(spark, distinct):
    rng = random.Random(2)
    common = [" ".join(f"c{k}w{i}" for i in range(5)) for k in range(20)]
    rows = [(d, " ".join([common[rng.randrange(20)]] + [f"r{rng.randrange(10**6)}" for _ in range(120)] + ([common[0]] if d % 2 else []))) for d in range(300)]
    rows += [(None, common[1]), (400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    index = N.word_ngrams(docs, ["doc_id"], "text", 5, once=distinct)
    plain = N.ngram_doc_frequency(index, "doc_id", 10, distinct)
    want = sorted(map(tuple, plain.collect()))
    assert len(want) >= 15
    for cells in (64, 1 << 16, 1 << 18):
        assert sorted(map(tuple, N.ngram_doc_frequency(index, "doc_id", 10, distinct, cells).collect())) == want
    hashes = index.select(F.xxhash64("ngram").alias("h"))
    kept = hashes.filter(N.heavy_cells(hashes, "h", 10, 1 << 16)(F.col("h"))).count()
    assert kept < hashes.count() / 5
    many = N.heavy_cells(hashes, "h", 300, 1 << 16)  # counters of two bytes
    assert hashes.filter(many(F.col("h"))).count() == 0


def test_token_places_of_unicode_texts(spark):
    texts = ["  two  words ", "", " ", "a", "é😀 x y\tz\n", "\x1cq\x85r", None, "end"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.token_places(F.col("t")).alias("p"))
    for r in df.collect():
        assert [tuple(x) for x in r.p or []] == [(m.start(), m.end() - 1) for m in re.finditer(r"\S+", r.t or "")]


# ---------------------------------------------------------------- bootstrap


def test_every_resample_draws_n_rows_whatever_the_leaves(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), float(rng.randrange(400))) for _ in range(3000)] + [("c", 1.0), (None, 2.0), (None, 4.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for leaf in (16, 5000):
        out = B.resampled_sums(df, ["g"], {"x": F.col("x")}, iters=50, leaf=leaf)
        sizes = {r.g: r["count"] for r in df.dropna(subset=["x"]).groupBy("g").count().collect()}
        found = out.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("k")).collect()
        assert {r.g: (r.lo, r.hi, r.k) for r in found} == {g: (float(n), float(n), 50) for g, n in sizes.items()}


def test_bootstrap_errors_against_plain_resampling(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.gamma(2.0, 3.0, 900), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    plain = statistics.stdev(float(rng.choice(x, len(x)).mean()) for _ in range(1500))
    for leaf in (32, 4096):
        found = B.bootstrap_stderr(df, [], {"x": F.col("x")}, lambda s: s["x"] / s["n"], iters=1500, leaf=leaf).first()["stderr"]
        assert found == pytest.approx(plain, rel=0.1)


def test_corpus_metric_errors_against_plain_resampling(spark):
    rng = random.Random(6)
    words = ["the", "cat", "dog", "sat", "on", "a", "mat", "ran"]
    pairs = []
    for _ in range(60):
        ref = [rng.choice(words) for _ in range(rng.randrange(5, 12))]
        pairs.append((" ".join(w if rng.random() < 0.8 else rng.choice(words) for w in ref), " ".join(ref)))
    df = spark.createDataFrame(pairs, "pred string, ref string")
    rows = df.select(C.bleu_counts(C.tokens_13a(F.col("pred")), F.array(C.tokens_13a(F.col("ref")))).alias("c")).select("c.*").toPandas().to_numpy(float)

    def bleu(s):
        m, t, p, r = s[0:8:2], s[1:8:2], s[8], s[9]
        return 100 * min(1.0, np.exp(1 - r / p)) * np.exp(np.log(m / t).mean())

    draw = np.random.default_rng(7)
    plain = np.std([bleu(rows[draw.integers(0, 60, 60)].sum(0)) for _ in range(1500)], ddof=1)
    found = C.bleu_stderr(df, F.col("pred"), F.array("ref"), iters=1000).first()["stderr"]
    assert found == pytest.approx(plain, rel=0.12)
    chrf = C.chrf_stderr(df, F.col("pred"), F.col("ref"), iters=300).first()["stderr"]
    assert 0 < chrf < 10


# ---------------------------------------------------------------- summary-level ROUGE-L


def plain_lsum(pred, ref):
    cut = lambda t: [[w for w in re.sub("[^a-z0-9]+", " ", s.lower()).split()] for s in t.replace(" . ", ".\n").split("\n") if s]
    p, r = cut(pred), cut(ref)
    left, own = {}, {}
    for x in p:
        for w in x:
            left[w] = left.get(w, 0) + 1
    for x in r:
        for w in x:
            own[w] = own.get(w, 0) + 1
    hits = 0
    for x in r:
        places = set()
        for y in p:
            t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i, a in enumerate(x):
                for j, b in enumerate(y):
                    t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
            i, j = len(x), len(y)
            while i and j:
                if x[i - 1] == y[j - 1]:
                    places.add(i - 1)
                    i, j = i - 1, j - 1
                elif t[i][j - 1] > t[i - 1][j]:
                    j -= 1
                else:
                    i -= 1
        for k in sorted(places):
            if left.get(x[k], 0) and own[x[k]]:
                left[x[k]] -= 1
                own[x[k]] -= 1
                hits += 1
    return 2.0 * hits / (sum(map(len, p)) + sum(map(len, r))) if hits else 0.0


def test_summary_rouge_against_tables(spark):
    rng = random.Random(8)
    words = ["a", "b", "c", "The", "d1"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", " . "]) for _ in range(rng.randrange(0, 25)))
    pairs = [(text(), text()) for _ in range(150)] + [("", "a"), ("a b", ""), ("x\n\ny", "y\nx"), ("w " * 300, "w w\n" * 150)]
    rows = C.with_rouge_lsum(spark.createDataFrame(pairs, "pred string, ref string"), "pred", "ref").collect()
    for r in rows:
        assert r.rouge_lsum == pytest.approx(plain_lsum(r.pred, r.ref), abs=1e-12)


# ---------------------------------------------------------------- trees


def edges(spark, rows):
    return spark.createDataFrame(rows, "group string, task string")


def test_closure_of_a_tree_with_a_shared_task(spark):
    e = edges(spark, [("all", "x"), ("all", "y"), ("x", "a"), ("x", "b"), ("y", "b"), ("y", "z"), ("z", "c"), ("all", "c"), ("x", "a"), (None, "q"), ("q", None)])
    found = {(r["group"], r["task"]): r["depth"] for r in G.tree_closure(e).collect()}
    assert found == {("all", "x"): 1, ("all", "y"): 1, ("x", "a"): 1, ("x", "b"): 1, ("y", "b"): 1, ("y", "z"): 1, ("z", "c"): 1, ("all", "c"): 1,
                     ("all", "a"): 2, ("all", "b"): 2, ("all", "z"): 2, ("y", "c"): 2}
    leaves = sorted(tuple(r) for r in G.leaf_edges(e).collect())
    assert leaves == [("all", "a"), ("all", "b"), ("all", "c"), ("x", "a"), ("x", "b"), ("y", "b"), ("y", "c"), ("z", "c")]
    places = [(r["depth"], r["alias"]) for r in G.tree_order(e).collect()]
    assert places == [(0, "all"), (1, " - c"), (1, " - x"), (2, "  - a"), (2, "  - b"), (1, " - y"), (2, "  - b"), (2, "  - z"), (3, "   - c")]


@pytest.mark.parametrize("rows", [[("a", "b"), ("b", "c"), ("c", "a")], [("a", "a")], [("r", "a"), ("a", "b"), ("b", "a")]])
def test_cycles_are_an_error(spark, rows):
    with pytest.raises(PySparkException, match="form a cycle"):
        G.tree_closure(edges(spark, rows)).collect()


def test_empty_tree(spark):
    assert G.tree_closure(edges(spark, [])).collect() == [] and G.tree_order(edges(spark, [])).collect() == []


# ---------------------------------------------------------------- context groups


def test_context_groups_give_every_request_its_result(spark):
    rows = [(i, [1, 2, 3], [i % 4]) for i in range(9)] + [(9, [1, 2], [3, 7]), (10, [1, 2, 3], [5, 6]), (11, [], []), (12, None, None), (13, [], [4]), (14, [1, 2, 3], [])]
    df = spark.createDataFrame(rows, "id long, ctx array<int>, cont array<int>")
    grouped = R.group_contexts(df, "id", "ctx", "cont")
    prefix = lambda c, t: tuple((c or []) + (t or [])[:-1])
    first = {}
    for i, c, t in rows:
        first.setdefault(prefix(c, t), i)
    assert {r.id: (r.representative, r.n_prefix, r.last_token) for r in grouped.collect()} == {
        i: (first[prefix(c, t)], len(prefix(c, t)), (t or [None])[-1]) for i, c, t in rows
    }
    batches = R.batch_contexts(grouped, "id", 2)
    assert [(r.representative, r.batch) for r in batches.orderBy("place").collect()] == [(10, 0), (0, 0), (11, 1)]
    spread = R.spread_results(grouped, batches, "id").collect()
    assert [r.id for r in spread] == sorted(i for i, *_ in rows)
