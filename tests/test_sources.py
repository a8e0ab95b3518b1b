import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ngrams as N
from tallyframe.sources import sinks, tables
from tallyframe.streaming import resume


def test_sample_logs_round_trip(spark, tmp_path):
    root = tmp_path / "m1"
    root.mkdir()
    (root / "samples_gsm8k_cot_2025-01-02T03-04-05.jsonl").write_text('{"doc_id": 1, "target": "4"}\n')
    (root / "samples_arc_2024.jsonl").write_text('{"doc_id": 2, "target": "B"}\n')
    schema = spark.createDataFrame([], "doc_id long, target string").schema
    got = {(r["task"], r["doc_id"]) for r in tables.read_sample_logs(spark, str(tmp_path), schema).collect()}
    assert got == {("gsm8k_cot", 1), ("arc", 2)}


def test_latest_results_and_main_metrics(spark, tmp_path):
    d = tmp_path / "model_a"
    d.mkdir()
    for day, v in (("01", 0.1), ("02", 0.7)):
        body = {"results": {"t": {"accuracy,none": v, "accuracy_stderr,none": 0.01, "alias": "t"}}}
        (d / f"results_2025-01-{day}T00.json").write_text(json.dumps(body))
    rows = tables.extract_main_metrics(tables.read_latest_results(spark, str(tmp_path)), ["accuracy"]).collect()
    assert [(r["model"], r["task"], r["metric"], r["value"]) for r in rows] == [("model_a", "t", "accuracy,none", 0.7)]


def test_corpus_reader_joins_paragraphs(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"text": "a", "meta": {"k": 1}}\n{"text": ["p", "q"]}\n"plain"\n')
    got = sorted(r["text"] for r in tables.read_corpus(spark, str(tmp_path)).collect())
    assert got == ["a", "p\n\nq", "plain"]


def test_ngram_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c")], "doc_id long, text string")
    sinks.write_ngram_index(N.word_ngrams(docs, ["doc_id"], "text", 3), str(tmp_path / "i"), 3, n_buckets=4)
    index, n = sinks.read_ngram_index(spark, str(tmp_path / "i"))
    assert n == 3 and index.count() == 3
    assert N.ngram_doc_frequency(index, "doc_id", 1).collect() == [("a b c", 2)]


def test_eval_table_and_writers(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"Question": "q1"}\n{"Question": "q2"}\n')
    df = tables.read_eval_table(spark, str(tmp_path / "t.jsonl"), ordered=True)
    assert df.columns == ["question", "idx"] and [r["idx"] for r in df.collect()] == [0, 1]
    rows = df.select(
        F.lit("m").alias("model"), F.lit("t").alias("task"), F.lit(3).alias("target"), F.array(F.array("question")).alias("arguments"),
        F.array(F.array("idx")).alias("resps"), F.array("idx").alias("filtered_resps"),
    )
    sinks.write_sample_logs(rows, str(tmp_path / "logs"))
    back = spark.read.json(str(tmp_path / "logs"))
    assert back.count() == 2 and back.first()["target"] == "3"
    results = spark.createDataFrame([("m_2", "a", 0.5), ("m_10", "a", 0.25), ("z", "a", 1.0)], "model string, metric string, value double")
    assert [r["Model"] for r in sinks.model_summary(results).collect()] == ["m_2", "m_10", "z"]
    sinks.write_model_summary(results, str(tmp_path / "s"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "s")).count() == 3
    full = spark.createDataFrame([("m", "t", "acc", "none", 0.5, 4, 1, 0)], "model string, task string, metric string, filter string, value double, n long, version int, n_shot int")
    sinks.write_results(full, str(tmp_path / "r"), {"num_fewshot": "0"})
    doc = json.loads(spark.read.text(str(tmp_path / "r")).first()["value"])
    assert doc["results"] == {"t": {"acc,none": 0.5}} and doc["n-samples"] == {"t": 4}


def test_combine_shards_rejects_overlap(spark):
    a = spark.createDataFrame([(1,), (2,)], "id long")
    b = spark.createDataFrame([(2,)], "id long")
    with pytest.raises(ValueError):
        tables.combine_shards([a, b], "id")
    with pytest.raises(ValueError):
        tables.combine_shards([a], "id", expected=3)


def test_score_stream_resumes(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    schema = "doc_id long, attempt int, score double"
    spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.25), (2, 1, 1.0)], schema).write.parquet(str(src / "a"))
    read = lambda: resume.read_files(spark, str(src / "*"), spark.createDataFrame([], schema).schema, "parquet", "*.parquet")
    resume.stream_scores(read(), ["doc_id", "attempt"], "score", out, state).awaitTermination()
    spark.createDataFrame([(2, 1, 0.0), (3, 1, 0.0)], schema).write.parquet(str(src / "b"))
    resume.stream_scores(read(), ["doc_id", "attempt"], "score", out, state).awaitTermination()
    got = {(r["doc_id"], r["score"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 0.5), (2, 1.0), (3, 0.0)}
