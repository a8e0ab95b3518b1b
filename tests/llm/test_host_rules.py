from plain import host_figures

from pyspark.sql import functions as F
from tallyframe.llm import host_rules

TEXTS = [
    (1, None, "a"), (2, "", "a"), (3, "x " * 3000, "a"), (4, "one two three four five\n\none two three four five\n \n#$ é𝄞 | a\tb\x0bc", None),
    (5, "all the words of this text are different from each other so nothing fails", "b"), (5, "all the words of this text are different from each other so nothing fails", "b"),
    (6, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z", "b"),
]


def test_figures(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, source string").withColumn("host", F.lit(1)).withColumn("n", F.lit(1))
    rows = host_rules.judge_hosts(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = next(t for d, t, _ in TEXTS if d == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == host_figures(text), r.doc_id
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_bad_host_loses_its_documents(spark):
    good = "every word in this sentence of mine is rather different from its neighbours number "
    rows = [(i, "short" if i % 10 else good, "bad") for i in range(200)] + [(1000 + i, good + str(i), f"good{i % 7}") for i in range(300)]
    out = host_rules.judge_hosts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert not any(r.kept for r in out if r.host == "bad") and all(r.kept for r in out if r.host != "bad")
    assert all(0 < r.rate_short < 1 for r in out)


def test_empty_table(spark):
    assert host_rules.judge_hosts(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
