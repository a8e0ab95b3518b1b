"""Streams that stop, fail and start again."""

import glob
import re

import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException

from tallyframe.operators import ngrams as N
from tallyframe.sources import ngram_store
from tallyframe.sources.ngram_store import create_store, open_store
from tallyframe.streaming import resume

SCORES = "doc_id long, attempt int, score double, note string"


def scores(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    schema = spark.createDataFrame([], SCORES).schema

    def arrive(name, rows):
        spark.createDataFrame(rows, SCORES).coalesce(1).write.parquet(str(src / name))

    def run():
        read = resume.read_files(spark, str(src / "*"), schema, "parquet", "*.parquet")
        query = resume.stream_scores(read, ["doc_id", "attempt"], "score", out, state)
        query.awaitTermination()
        return query

    return arrive, run, out


def test_first_batch_wins_and_the_best_of_a_batch_counts(spark, tmp_path):
    arrive, run, out = scores(spark, tmp_path)
    arrive("a", [(1, 1, 0.5, "x"), (1, 1, 0.25, "y"), (2, 1, 1.0, "x"), (None, 1, None, "n"), (None, 1, 0.1, "m"), (7, 1, 0.5, "b"), (7, 1, 0.5, "a")])
    run()
    arrive("b", [(2, 1, 9.0, "late"), (3, 1, 0.0, None), (3, 1, 0.0, None)])
    run()
    arrive("c", [(1, 1, 9.0, "late"), (None, 1, 9.0, "late"), (3, 2, 0.0, "z")])
    run()
    got = sorted(map(str, spark.read.parquet(out).select("doc_id", "attempt", "score", "note", "batch_id").collect()))
    want = [(1, 1, 0.5, "x", 0), (2, 1, 1.0, "x", 0), (None, 1, 0.1, "m", 0), (7, 1, 0.5, "b", 0), (3, 1, 0.0, None, 1), (3, 2, 0.0, "z", 2)]
    assert got == sorted(str(r) for r in spark.createDataFrame(want, "doc_id long, attempt int, score double, note string, batch_id int").collect())


def test_a_failed_batch_is_run_again_with_the_same_rows(spark, tmp_path, monkeypatch):
    arrive, run, out = scores(spark, tmp_path)
    arrive("a", [(1, 1, 0.5, "x")])
    run()
    arrive("b", [(1, 1, 0.7, "late"), (2, 1, 1.0, "x")])
    write = resume.write_batch

    def dies(batch, batch_id, path):
        write(batch, batch_id, path)
        raise RuntimeError("lost after writing")

    monkeypatch.setattr(resume, "write_batch", dies)
    with pytest.raises(StreamingQueryException):
        run()
    monkeypatch.setattr(resume, "write_batch", write)
    run()
    assert sorted((r.doc_id, r.score, r.batch_id) for r in spark.read.parquet(out).collect()) == [(1, 0.5, 0), (2, 1.0, 1)]


def test_a_batch_reads_its_own_files_and_keeps_state(spark, tmp_path):
    arrive, run, out = scores(spark, tmp_path)
    for k in range(3):
        arrive(f"f{k}", [(k * 10 + i, 1, 0.5, "x") for i in range(10)])
        progress = [p for p in run().recentProgress if p.numInputRows]
        assert [p.numInputRows for p in progress] == [10]
        assert progress[-1].stateOperators[0].numRowsTotal == 10 * (k + 1)
        assert "RocksDB" in str(progress[-1].stateOperators[0].customMetrics) or any("rocksdb" in m for m in progress[-1].stateOperators[0].customMetrics)


def grams(spark, rows, n=3):
    return N.word_ngrams(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], "text", n, once=True)


DOCS = [(1, "a b c d"), (2, "a b c"), (3, "x y z a b c"), (4, None), (5, ""), (6, "x y z")]


def test_batches_torn_and_repeated_equal_one_build(spark, tmp_path):
    store = create_store(spark, str(tmp_path / "i"), 3, buckets=4)
    assert store.read().collect() == [] and not store.compact()
    for k in range(3):
        assert store.append(grams(spark, DOCS[2 * k : 2 * k + 2]), f"batch {k}")
    assert not store.append(grams(spark, DOCS[:2]), "batch 0")
    store.write_run(grams(spark, DOCS), "torn")
    whole = sorted(map(tuple, grams(spark, DOCS).select("ngram", "doc_id").collect()))
    assert sorted(map(tuple, store.read().collect())) == whole
    assert len(store.runs()) == 3 and len(store.unpublished_runs()) == 1
    assert store.compact() and len(store.runs()) == 1
    again = open_store(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, again.read().collect())) == whole and again.n == 3
    # The merged run remembers its batches.
    assert not again.append(grams(spark, DOCS[:2]), "batch 2")
    assert again.append(grams(spark, [(9, "q r s")]), "batch 3")
    assert again.read().count() == len(whole) + 1
    # A manifest that died before its file appeared is not seen, and the next one takes its place.
    (tmp_path / "i" / "manifest" / f"version={again.version() + 1}").mkdir()
    assert again.read().count() == len(whole) + 1
    assert again.append(grams(spark, [(10, "q r s")]), "batch 4") and again.read().count() == len(whole) + 2


def test_one_file_per_bucket_and_run_after_compaction(spark, tmp_path):
    store = create_store(spark, str(tmp_path / "i"), 3, buckets=4)
    for k in range(3):
        store.append(grams(spark, [(100 * k + i, f"w{i} w{i + 1} w{i + 2} w{i + 3}") for i in range(40)]), str(k))
    store.compact()
    (run,) = [r["run"] for r in store.runs()]
    files = glob.glob(f"{tmp_path}/i/runs/run={run}/*.parquet")
    assert 1 <= len(files) <= 4
    for f in files:
        rows = [r.ngram for r in spark.read.parquet(f).collect()]
        assert rows == sorted(rows)


def bucket_files(folder):
    """Per bucket the n-grams of each file, files in the order of their first n-gram; every file is sorted."""
    found = {}
    for f in glob.glob(f"{folder}/*.parquet"):
        rows = pq.read_table(f, partitioning=None).column("ngram").to_pylist()
        assert rows == sorted(rows, key=lambda g: (g is not None, (g or "").encode()))
        found.setdefault(re.search(r"_(\d{5})\.", f)[1], []).append(rows)
    return {b: sorted(files, key=lambda rows: (rows[0] is not None, rows[0] or "")) for b, files in found.items()}


def test_rows_are_written_where_they_are_made(spark, tmp_path):
    rows = grams(spark, [(i, f"w{i} w{i + 1} w{i + 2} w{i + 3}") for i in range(300)]).repartition(6)
    few, many = (create_store(spark, str(tmp_path / str(n)), 3, buckets=n) for n in (4, ngram_store.FEW_BUCKETS + 1))
    for store in (few, many):
        store.append(rows, "all")
        assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, rows.select("ngram", "doc_id").collect()))
    assert {b: len(files) for b, files in bucket_files(f"{few.path}/runs/run={few.runs()[0]['run']}").items()} == {f"{b:05}": 6 for b in range(4)}
    assert all(len(files) == 1 for files in bucket_files(f"{many.path}/runs/run={many.runs()[0]['run']}").values())


def test_compaction_takes_a_bucket_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ngram_store, "MERGE_ROWS", 30)
    # Small splits: files of one bucket would be read by many tasks if buckets were not read whole.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        store = create_store(spark, str(tmp_path / "i"), 3, buckets=2)
        for k in range(3):
            rows = grams(spark, [(100 * k + i, f"w{i} w{i + 1} w{i + 2} w{i + 3}") for i in range(40)])
            store.append(rows.unionByName(spark.createDataFrame([(k, None)], "doc_id long, ngram string")), str(k))
        before = sorted(map(str, store.read().collect()))
        assert store.compact() and sorted(map(str, store.read().collect())) == before
        found = bucket_files(f"{tmp_path}/i/runs/run={store.runs()[0]['run']}")
        assert len(found) == 2 and all(2 <= len(files) <= 5 for files in found.values())
        for files in found.values():  # ranges do not overlap: the files of a bucket follow one another
            whole = [g for rows in files for g in rows]
            assert whole == sorted(whole, key=lambda g: (g is not None, g or ""))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_the_join_leaves_the_buckets_where_they_are(spark, tmp_path):
    store = create_store(spark, str(tmp_path / "i"), 3, buckets=4)
    for k in range(2):
        store.append(grams(spark, DOCS[3 * k : 3 * k + 3]), str(k))
    bench = grams(spark, [(1, "A b C!"), (2, "no such words")]).select("ngram")
    joined = store.read().join(bench.hint("merge"), "ngram", "left_semi")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ngram") == 1 and "Bucketed: true" in plan
    assert sorted(r.doc_id for r in joined.collect()) == [1, 2, 3]


def test_index_stream_survives_a_failure_between_publishing_and_commit(spark, tmp_path, monkeypatch):
    src, schema = tmp_path / "in", "doc_id long, text string"
    store = create_store(spark, str(tmp_path / "i"), 3, buckets=2)
    read = lambda: resume.read_files(spark, str(src / "*"), spark.createDataFrame([], schema).schema, "parquet", "*.parquet")
    run = lambda: resume.stream_ngram_index(read(), "doc_id", "text", store, str(tmp_path / "state")).awaitTermination()
    spark.createDataFrame(DOCS[:3], schema).write.parquet(str(src / "a"))
    run()
    spark.createDataFrame(DOCS[3:], schema).write.parquet(str(src / "b"))
    append = type(store).append

    def dies(self, rows, batch):
        append(self, rows, batch)
        raise RuntimeError("lost after publishing")

    monkeypatch.setattr(type(store), "append", dies)
    with pytest.raises(StreamingQueryException):
        run()
    monkeypatch.setattr(type(store), "append", append)
    run()
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, grams(spark, DOCS).select("ngram", "doc_id").collect()))
