import duckdb
import pytest

from tallyframe.llm import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = registry.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    plain = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    sql = con.execute(f"select {', '.join(names)} from ({registry.SQL[name]})").fetchall()
    assert plain(found.select(*names).collect()) == plain(sql)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
