import __spark_entry__ as entry
from tallyframe.plans import load_all


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


def test_fewshot_never_shows_the_document_itself(spark):
    out = entry.queries()["fewshot_same_split"](spark, "/root/testdata/sf0.001")
    assert out.filter("doc_id = pool_id").count() == 0
    assert out.groupBy("doc_id").count().filter("count <> 3").count() == 0


def test_no_cross_joins_in_small_plans(spark):
    for name in ("fewshot_random", "expand_prompt_variants", "contaminated_items", "group_rollup_weighted"):
        plan = load_all().QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
