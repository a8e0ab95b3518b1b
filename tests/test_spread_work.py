"""Work that must not depend on the number of files."""

import pytest
from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.plans import math_queries as Q


@pytest.fixture
def parts_folder(spark, tmp_path):
    rows = spark.range(40).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("name "), "id").alias("p_name"), F.lit("Brand#1").alias("p_brand"),
        (F.col("id") % 50 + 1).cast("int").alias("p_size"), (F.col("id") + 900.25).alias("p_retailprice"),
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["strip_string", "extract_answer", "nested_answers"])
def test_rows_of_one_file_use_all_cores(spark, parts_folder, name):
    out = getattr(Q, name)(spark, parts_folder)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert out.count() == 40


def test_small_parts_read_again_and_move_nothing(spark, tmp_path):
    rows = [(i % 50 or None, f"text {i % 70} " + "x" * (i % 9)) for i in range(400)] + [(None, None), (1, ""), (7, "same"), (7, "same")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = sum(len(t or "") for _, t in rows)
    for parts in (1, 7, session.READINGS, session.READINGS + 1):
        found = session.small_parts(df, "text", -(-size // parts))
        assert sorted(map(str, found.collect())) == sorted(map(str, df.collect()))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan if parts > session.READINGS else "Exchange" not in plan and plan.count("FileScan") == parts
    assert session.small_parts(df.limit(0), "text", 1).collect() == []
