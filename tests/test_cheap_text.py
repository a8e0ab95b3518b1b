"""Text steps that look at the ends of a text only, or are made once."""

import re

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import instructions as I
from tallyframe.functions.columns import SPACE_CLASS, SPACES, strip
from tallyframe.operators import corpus as C


def test_the_listed_spaces_are_those_of_the_pattern(spark):
    chars = spark.range(1, 0x10000).filter("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    found = {r.id for r in chars.filter(F.col("c").rlike(f"^{SPACE_CLASS}$")).collect()}
    assert found == set(map(ord, SPACES))


def test_strip_is_the_pattern_at_both_ends(spark):
    texts = ["", " ", "a", " a b\n", "　x ", "\x1c\x85é \t", "​ x", "a\n\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace("t", f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")
    for r in df.select("t", strip(F.col("t")).alias("got"), old.alias("want"), I.not_blank(F.col("t")).alias("some")).collect():
        assert r.got == r.want and r.some == (None if r.want is None else r.want != ""), r


def test_stripping_runs_no_pattern(spark):
    assert "regexp" not in str(strip(F.col("t")))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_rouge_n_counts_matches_once(spark, n):
    assert str(C.rouge_n(F.col("p"), F.col("r"), n)).count("array_intersect") == 1
    rows = [("a b a c", "a a b d"), ("", "x"), (None, "x y"), ("x", "x"), ("X-y z", "x y, z"), (None, None)]
    df = spark.createDataFrame(rows, "p string, r string")
    for row in df.select("p", "r", C.rouge_n(F.col("p"), F.col("r"), n).alias("got")).collect():
        a, b = ([w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w] for t in (row.p, row.r))
        a, b = ([tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for x in (a, b))
        same = sum(min(a.count(g), b.count(g)) for g in set(a))
        assert row.got == pytest.approx(2.0 * same / (len(a) + len(b)) if same else 0.0)
