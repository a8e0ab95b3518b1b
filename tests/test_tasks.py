import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import clean as C
from tallyframe.functions import registry as G
from tallyframe.functions import text as X
from tallyframe.operators import corpus as K
from tallyframe.operators import prompts as P


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_common_subsequence_against_a_table(spark):
    rnd = random.Random(1)
    rows = [([rnd.choice("abcd") for _ in range(rnd.randint(0, 30))], [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]) for _ in range(60)]

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.withColumn("n", K.common_subsequence("a", "b")).collect():
        assert r["n"] == lcs(r["a"], r["b"])


def test_bleu_clips_by_the_best_reference(spark):
    df = spark.createDataFrame([("the the the cat", ["the cat", "the the dog"])], "p string, r array<string>")
    c = df.select(K.bleu_counts(F.split("p", " "), F.transform("r", lambda r: F.split(r, " "))).alias("c")).first()["c"]
    assert (c["m1"], c["t1"], c["m2"], c["ref_len"]) == (3, 4, 2, 3)


def test_perfect_translation_scores_hundred(spark):
    df = spark.createDataFrame([("a b c d e", "a b c d e"), ("x y z w", "x y z w")], "p string, r string")
    assert K.corpus_bleu(df, F.col("p"), F.array("r")).first()["bleu"] == pytest.approx(100.0)
    assert K.corpus_chrf(df, F.col("p"), F.col("r")).first()["chrf"] == pytest.approx(100.0)


def test_entity_and_relation_labels(spark):
    item = lambda kind, *xs: F.array(*[F.struct(F.lit(a).alias(kind[0]), F.lit(b).alias(kind[1])) for a, b in xs])
    e = lambda *xs: item(("text", "type"), *xs)
    r = lambda *xs: item(("a", "b"), *xs)
    pairs = lambda c: [(p["gold"], p["pred"]) for p in one(spark, c)]
    assert pairs(X.entity_labels(e(("Rome", "LOC"), ("Ann", "PER")), e(("Rome", "LOC")))) == [(1, 1), (0, 3)]
    assert pairs(X.entity_labels(e(("Rome", "LOC")), e(("Rome", "LOC"), ("x", "ORG")))) == [(1, 1), (3, 2)]
    assert pairs(X.relation_labels(r(("1", "2")), r(("3", "4"), ("1", "2")))) == [(1, 1), (0, 1)]
    assert pairs(X.relation_labels(r(("1", "2")), r(("9", "9")))) == [(1, 0)]


def test_adapters(spark):
    w = spark.createDataFrame([("Tom  gave it. My hat", ["My hat", "Tom"], "his", 13)], "text string, options array<string>, pronoun string, pronoun_loc int")
    assert C.adapt_item(w, "wsc273").first()["options"] == ["My hat's", "Tom's"]
    m = spark.createDataFrame([("be KIND.", "tom waits", "he Helps", "a", "b")], "norm string, situation string, intention string, moral_action string, immoral_action string")
    assert C.adapt_item(m, "moral_stories").first()["query"] == "Be kind. Tom waits He helps"
    q = spark.createDataFrame([("2", ["x", "y"])], "correct_answer_id string, answer_options array<string>")
    assert C.adapt_item(q, "qa4mre").first()["target"] == "y"
    d = spark.createDataFrame([("Why?", "p", "q", "r", "s")], "sent1 string, ending0 string, ending1 string, ending2 string, ending3 string")
    assert C.adapt_item(d, "medqa").first()["text"] == "Question: Why?\nA. p\nB. q\nC. r\nD. s\nAnswer:"
    k = spark.createDataFrame([("flu", ["a"]), ("NA", ["a"]), ("flu", []), ("बुखार", ["a"]), ("flu", ["दवा"])], "diagnosis string, medicines array<string>")
    assert C.adapt_item(k, "prescriptions").count() == 1


def test_sentence_pairs_and_highlights(spark):
    a, b = C.sentence_pair(F.lit(" It is ( so ) . "), F.lit("Do n't"))
    assert (one(spark, a), one(spark, b)) == ("It is (so)", "don't")
    assert one(spark, C.clean_text(F.lit("End.\n@highlight\nMore\n@highlight\nx"), "highlights")) == "End. More. x"


def test_templates_and_options(spark):
    df = spark.createDataFrame([(" q ", ["u", "v"])], "question string, options array<string>")
    got = df.select(P.render_template("{{question.strip()}}: {{options[1]}} {{ question|upper }}", df.columns).alias("x")).first()["x"]
    assert got == "q: v  Q "
    with pytest.raises(ValueError):
        P.field_reference("question + 1")


def test_bias_annotation_of_woman_and_missing_groups(spark):
    assert one(spark, P.answer_groups(F.array(F.lit("woman")), F.lit("x"))) == ["f", "woman"]
    assert one(spark, P.answer_groups(F.array(F.lit("")), F.lit("The Latina"))) == ["latino"]
    assert one(spark, P.answer_groups(F.array(F.lit("F-Black"), F.lit("lowSES")), F.lit("x"))) == ["f", "black", "low ses"]


def test_registries_reject_doubles(spark):
    with pytest.raises(ValueError):
        G.register_metric(G.Metric("exact_match", X.exact_match))
    with pytest.raises(ValueError):
        G.register_aggregation("mean", F.avg)
