import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import aggregates as A
from tallyframe.operators import attempts as T
from tallyframe.operators import groups as G
from tallyframe.operators.bootstrap import bootstrap_stderr
from tallyframe.operators.joins import erfc


def product_form(n, c, k):
    if n - c < k:
        return 1.0
    return 1.0 - math.prod(1.0 - k / i for i in range(n - c + 1, n + 1))


def test_pass_at_k_equals_the_product_form(spark):
    rows = [(n, c) for n in range(1, 21) for c in range(0, n + 1)]
    df = spark.createDataFrame(rows, "n long, c long")
    for k in (1, 3, 8):
        for r in df.filter(F.col("n") >= k).withColumn("p", T.pass_at_k_value(F.col("n"), F.col("c"), k)).collect():
            assert r["p"] == pytest.approx(product_form(r["n"], r["c"], k), abs=1e-12)


def test_pass_at_1_is_the_mean(spark):
    rows = [(p, a, (p * a) % 3 == 0) for p in range(30) for a in range(4)]
    df = spark.createDataFrame(rows, "p long, a long, ok boolean")
    got = T.pass_at_k(df, "p", F.col("ok"), [1]).first()[0]
    assert got == pytest.approx(sum(r[2] for r in rows) / len(rows))


def test_majority_tie_goes_to_the_first_seen(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "a"), (1, 4, "b"), (2, 1, "z")], "q long, at int, ans string")
    got = {r["q"]: r["answer"] for r in T.majority_votes(df, ["q"], "ans", F.col("at")).collect()}
    assert got == {1: "b", 2: "z"}


def test_group_rollup_values(spark):
    scores = spark.createDataFrame([("a", 0.3, 0.1, 20), ("b", 0.2, 0.1, 40), ("c", 0.4, 0.1, 100)], "task string, value double, stderr double, n long")
    edges = G.leaf_edges(spark.createDataFrame(G.tree_edges({"all": {"x": {"a": None, "b": None}, "c": None}}), "group string, task string"))
    flat = {r["group"]: r["value"] for r in G.group_rollup(scores, edges, weight_by_size=False).collect()}
    sized = {r["group"]: r["value"] for r in G.group_rollup(scores, edges).collect()}
    assert flat["all"] == pytest.approx(0.3) and sized["all"] == pytest.approx(0.3375)
    assert sized["x"] == pytest.approx((0.3 * 20 + 0.2 * 40) / 60)


@pytest.mark.parametrize("parts", [[[1] * 40 + [0] * 60, [1] * 30 + [0] * 30, [1] * 20 + [0] * 60], [[1] * 35 + [0] * 65, [1] * 20 + [0] * 20]])
def test_pooled_stderr_is_that_of_the_whole(spark, parts):
    rows = [(str(i), float(x)) for i, p in enumerate(parts) for x in p]
    df = spark.createDataFrame(rows, "task string, x double")
    pooled = G.task_scores(df, ["task"], "x").agg(G.pooled_stderr(F.col("stderr"), F.col("n")).alias("e")).first()["e"]
    whole = [x for _, x in rows]
    assert pooled == pytest.approx(statistics.stdev(whole) / math.sqrt(len(whole)), abs=1e-3)


def test_bootstrap_is_close_to_the_formula_and_repeatable(spark):
    rnd = random.Random(3)
    rows = [("t", float(rnd.random() < 0.3)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "task string, x double").repartition(3)
    run = lambda: bootstrap_stderr(df, ["task"], {"x": F.col("x")}, lambda s: s["x"] / s["n"], iters=500).first()["stderr"]
    xs = [r[1] for r in rows]
    assert run() == pytest.approx(statistics.stdev(xs) / math.sqrt(len(xs)), rel=0.15)
    assert run() == run()


def test_arrival_median(spark):
    rows = [("a", i, float((i * 7) % 11)) for i in range(101)] + [("b", 5, 2.0), ("b", 9, 4.0)]
    df = spark.createDataFrame(rows, "g string, id long, v double").repartition(3)
    got = {r["g"]: r["median"] for r in A.arrival_median(df, ["g"], "id", "v").collect()}
    assert got == {"a": float((50 * 7) % 11), "b": 4.0}


def test_erfc_fit(spark):
    df = spark.createDataFrame([(x / 4,) for x in range(0, 20)], "x double").withColumn("y", erfc(F.col("x")))
    for r in df.collect():
        assert r["y"] == pytest.approx(math.erfc(r["x"]), rel=2e-7)


def test_empty_and_single_groups_have_no_stderr(spark):
    df = spark.createDataFrame([("a", 1.0)], "t string, x double")
    assert df.agg(A.mean_stderr("x")).first()[0] is None
