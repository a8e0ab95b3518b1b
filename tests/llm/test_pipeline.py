import re

import corpus_pipeline
from plain import base_spans, components, contaminated
from pyspark.sql import functions as F
from test_packing import check_places, expected

from tallyframe.llm import toxicity
from tallyframe.llm.shared import table

SF = "/root/testdata/sf0.001"


def test_every_stage_against_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    extra = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-2, "", "en", "s", 0), (-3, "mail a@b.cc now", "en", None, 15)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "packing":
            assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected(before.items())
            check_places(rows)
            break
        assert out.columns == corpus_pipeline.COLUMNS
        after = {r.doc_id: r.text for r in rows}
        if name == "toxicity":
            score = toxicity.score(docs, toxicity.train(docs, table(spark, SF, "labels"))).collect()
            assert set(after) == {r.doc_id for r in score if r.score < toxicity.THRESHOLD}
        elif name == "near_duplicates":
            assert set(after) == {d for d, (_, c) in components(before, corpus_pipeline.NEAR_PERCENT).items() if d == c} and len(rows) == len(after)
        elif name == "decontamination":
            assert set(after) == {d for d, t in before.items() if not contaminated(t, items)}
        else:
            for d, t in before.items():
                kinds = sorted(x.split(":")[0].upper() for x in base_spans(t).split(",") if x)
                assert kinds == sorted(re.findall(r"\[(EMAIL|IP|CARD|PHONE)\]", after[d] or "")), d
            assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        docs = spark.createDataFrame(rows, docs.schema)


def test_run_returns_packed_pieces(spark):
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, SF).columns)


def test_stages_take_empty_tables_and_extra_columns(spark, tmp_path):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0, name
    clashing = docs.limit(30).withColumns({c: F.lit("x") for c in ("score", "component_id", "kept", "spans", "text_", "piece", "h", "item_id")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, SF)
        assert out.columns == corpus_pipeline.COLUMNS and 0 < out.count() <= 30, name
    assert stage_of("packing")(spark, clashing, SF).select("doc_id").distinct().count() == 30
    # A whole run over tables without rows.
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def stage_of(name):
    return dict(corpus_pipeline.STAGES)[name]
