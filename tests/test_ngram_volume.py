"""N-gram queries move few bytes per n-gram."""

from pyspark.sql import functions as F

from tallyframe.functions.columns import running_sums
from tallyframe.operators import ngrams as N

TEXTS = [" a  b\tc d e", "one two", "", None, "  ", "é 𝒳y z q \n", "x y z x y z x y z", " ".join(f"w{i % 7}" for i in range(300)) + " "]


def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_figures_of_a_text_are_those_of_its_rows(spark):
    figures = lambda g: F.struct(F.size(g).alias("n"), F.array_max(F.transform(g, lambda x: x["ngram"])).alias("hi"))
    got = N.word_ngrams_indices(texts(spark), ["doc_id"], "text", 3, figures)
    rows = N.word_ngrams_indices(texts(spark), ["doc_id"], "text", 3)
    want = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("ngram").alias("hi"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() < rows.count()


def test_places_of_tokens_are_where_the_text_has_them(spark):
    import re

    gap = r"[\s\x0b\x1c-\x1f\x85]"
    for row in texts(spark).select("text", N.token_places(F.col("text")).alias("p")).collect():
        want = None if row.text is None else [(m.start(), m.end() - 1) for m in re.finditer(rf"(?:(?!{gap}).)+", row.text)]
        assert (row.p and [tuple(p) for p in row.p]) == want or (row.p == [] and want == [])


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 200):
        values = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
        got = spark.range(1).select(running_sums(values).alias("s")).first().s
        assert got == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_texts_of_one_file_are_counted_in_small_tasks(spark):
    from tallyframe.session import small_tasks

    df = spark.range(400).select("id", F.lit("x" * 1000).alias("t")).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    many = small_tasks(df, "t", 400_000 // (3 * cores))
    assert many.rdd.getNumPartitions() >= 3 * cores and many.count() == 400
    assert small_tasks(df, "t").rdd.getNumPartitions() == 1
    assert small_tasks(df.limit(0), "t").count() == 0


def test_texts_of_rare_ngrams_do_not_travel(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same six words again here "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.concat(F.lit("w"), F.col("id") * 100 + i)), " ")).alias("text"))
    index = N.word_ngrams(docs, ["doc_id"], "text", 3, once=True)
    want = sorted(map(tuple, N.ngram_doc_frequency(index, "doc_id", 1, True).collect()))
    monkeypatch.setattr(N, "is_small", lambda *a: False)
    out = N.ngram_doc_frequency(index, "doc_id", 1, True)
    assert sorted(map(tuple, out.collect())) == want and len(want) == 4
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_named_words_make_the_ngrams_of_slices(spark, monkeypatch):
    grams = lambda: [r.g for r in texts(spark).select(N.ngram_array(F.col("text"), 3).alias("g")).collect()]
    got = grams()
    monkeypatch.setattr(N, "NAMED_WORDS", 0)
    assert got == grams()


def test_sketched_hashes_are_written_once(spark, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d "), F.col("id")).alias("text"))
    index = N.word_ngrams(docs, ["doc_id"], "text", 3)
    seen, plain = [], N.written
    monkeypatch.setattr(N, "written", lambda df, name: seen.append(df.columns) or plain(df, name))
    for distinct, columns in ((True, ["_h"]), (False, ["_h", "_d"])):
        got = N.ngram_doc_frequency(index, "doc_id", 10, distinct, cells=1 << 10)
        assert sorted(map(tuple, got.collect())) == [("a b c", 40), ("b c d", 40)]
        assert seen.pop() == columns and not seen
