import random

from pyspark.sql import functions as F

from tallyframe.operators.ordering import dense_index, first_k, group_index, running_totals, scan_index


def skewed(spark, n=3000):
    rnd = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 50}", rnd.randint(0, 40)) for i in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "id long, g string, v int").repartition(4), rows


def test_dense_index_is_the_sorted_position(spark):
    df, rows = skewed(spark)
    got = {r["id"]: r["idx"] for r in dense_index(df, ["v", "id"]).collect()}
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert got == want


def test_group_index_with_a_hot_group(spark):
    df, rows = skewed(spark)
    got = {r["id"]: r["rn"] for r in group_index(df, ["g"], ["v", "id"]).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])), 1):
            want[r[0]] = i
    assert got == want


def test_running_totals_before_and_with_the_row(spark):
    df, rows = skewed(spark, 500)
    got = {r["id"]: (r["a"]) for r in running_totals(df, ["id"], {"a": F.col("v")}).collect()}
    total, want = 0, {}
    for r in sorted(rows):
        total += r[2]
        want[r[0]] = total
    assert got == want


def test_scan_index_has_no_gaps(spark):
    df, rows = skewed(spark, 700)
    assert sorted(r["idx"] for r in scan_index(df).collect()) == list(range(700))


def test_first_k_prunes_before_the_shuffle(spark):
    df, _ = skewed(spark)
    out = first_k(df, ["g"], [F.col("id")], 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("g = 'hot'").select("id").orderBy("id").collect() == [(0,), (3,), (6,)]
