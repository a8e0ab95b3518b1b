"""Null groups, null values, repeated entries and short pools are kept or refused, never dropped without a word."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import registry as R, text as X
from tallyframe.operators import aggregates as A, prompts as P
from tallyframe.operators.bootstrap import bootstrap_stderr
from tallyframe.operators.ordering import dense_index, group_index, running_totals
from tallyframe.operators.requests import batch_requests, block_hashes, task_hashes
from tallyframe.operators.selection import limit_docs

ROWS = [(1, "a", 1.0), (2, None, 2.0), (3, "a", None), (4, None, 4.0), (5, "b", 5.0), (6, None, 6.0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, g string, v double")


def test_group_index_keeps_null_groups(df):
    got = {r["id"]: r["rn"] for r in group_index(df, ["g"], ["id"]).collect()}
    assert got == {1: 1, 3: 2, 2: 1, 4: 2, 6: 3, 5: 1}


def test_numbers_with_null_keys_and_an_empty_table(df):
    got = [r["idx"] for r in dense_index(df, ["g", "id"]).orderBy(F.asc_nulls_first("g"), "id").collect()]
    assert got == list(range(6))
    assert dense_index(df.limit(0), ["id"]).count() == 0
    assert running_totals(df.limit(0), ["id"], {"s": F.col("v")}).count() == 0


def test_batches_of_null_groups(df):
    out = batch_requests(df.withColumn("t", F.lit("x")), ["g"], "t", "id", 2)
    assert out.count() == 6 and out.filter("g IS NULL").select("batch").distinct().count() == 2


def test_arrival_median_has_one_row_per_group(df):
    got = {r["g"]: r["median"] for r in A.arrival_median(df, ["g"], "id", "v").collect()}
    assert got == {"a": None, None: 4.0, "b": 5.0}


def test_bootstrap_with_null_groups_values_and_no_group(df):
    mean = lambda s: s["v"] / s["n"]
    out = {r["g"]: r["stderr"] for r in bootstrap_stderr(df, ["g"], {"v": F.col("v")}, mean, iters=300).collect()}
    assert set(out) == {"a", "b", None} and out[None] > 0
    whole = bootstrap_stderr(df, [], {"v": F.col("v")}, mean, iters=300).collect()
    assert len(whole) == 1 and 0.3 < whole[0]["stderr"] < 1.6


def test_task_hash_is_one_rule_at_every_size(spark):
    rows = [("t", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(11)]
    df = spark.createDataFrame(rows, "task string, id long, h string")

    def rule(hashes, block):
        while True:
            hashes = [hashlib.sha256("".join(hashes[i : i + block]).encode()).hexdigest() for i in range(0, len(hashes), block)]
            if len(hashes) == 1:
                return hashes[0]

    for block in (2, 3, 100):
        assert block_hashes(df, ["task"], "id", "h", block).first()["block_hash"] == rule([r[2] for r in rows], block)


def test_task_hash_of_null_tasks_and_null_hashes(spark):
    rows = [("t", 2, "b"), ("t", 1, "a"), (None, 1, "x"), (None, 2, None), ("u", None, "q"), ("u", 0, "p"), ("t", 3, "c")]
    found = dict(map(tuple, task_hashes(spark.createDataFrame(rows, "task string, id long, h string").repartition(3), ["task"], "id", "h").collect()))
    assert found == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in {"t": "abc", None: "x", "u": "qp"}.items()}
    assert task_hashes(spark.createDataFrame([], "task string, id long, h string"), ["task"], "id", "h").collect() == []


def test_limit_docs(df):
    assert [r["id"] for r in limit_docs(df, "id", 2).orderBy("id").collect()] == [1, 2]
    assert limit_docs(df, "id", 0.4).count() == 3


def test_short_pool_is_refused(spark):
    pool = spark.createDataFrame([(1, "q"), (2, "r")], "item_id long, q string")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    with pytest.raises(ValueError):
        P.sample_fewshot(docs, "doc_id", pool, "item_id", 4, sampler="first_n")


def test_count_of_scored_rows(spark):
    df = spark.createDataFrame([("t", "a", "a"), ("t", None, "a")], "task string, pred string, ref string")
    scored = R.score_samples(df, ["exact_match"], F.col("pred"), F.col("ref"))
    row = R.aggregate_samples(scored, ["exact_match"], ["task"]).first()
    assert row["value"] == scored.agg(F.avg("exact_match")).first()[0] and row["n"] == scored.filter("exact_match IS NOT NULL").count()


def test_equal_gold_relations_use_up_predictions(spark):
    df = spark.sql("SELECT array(struct(1 AS a, 2 AS b), struct(1 AS a, 2 AS b)) AS g, array(struct(1 AS a, 2 AS b)) AS p")
    got = [(x["gold"], x["pred"]) for x in df.select(X.relation_labels(F.col("g"), F.col("p")).alias("x")).first()["x"]]
    assert got == [(1, 1), (1, 0)]


def test_regex_replace_in_templates(spark):
    df = spark.createDataFrame([("a1b22c",)], "q string")
    render = lambda t: df.select(P.render_template(t, ["q"]).alias("x")).first()["x"]
    assert render(r"{{ q | regex_replace('[0-9]+', '#') }}!") == "a#b#c!"
    assert render(r"{{ q | regex_replace('[0-9]+', '', 1) | upper }}") == "AB22C"
    assert render(r"{{ q | regex_replace('([0-9]+)', '<\1>') }}") == "a<1>b<22>c"
