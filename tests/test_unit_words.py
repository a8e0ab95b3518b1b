"""Word lists that must not be tried in whole."""

from pyspark.sql import functions as F

from tallyframe.functions import maths as M
from tallyframe.functions.columns import literal_array

TEXTS = [
    "12 miles", "5 q hour. x", "p hour. m", "3 sq hour m", "m east m east", "a . m", "hour", "hours hour", "7 cu . m per hour", "9 rs .x", "2 c . d", "x m\nm y",
    "20 m east, 3 sq m", "∏ cm ³ 4", "π r 2 = 3", "5 ° f", "v â € ™ 3", "no change", "no changes in 4 gallons", "", " ", "miles_", "4 Surface", "1-m-m-m", "o s s. s .", None,
]


def test_units_tried_by_their_first_word_are_those_of_the_whole_list(spark):
    patterns = literal_array([M.UNICODE + rf"(^|\W)(?:{u})($|\W)" for u in M.UNITS + [u + "s" for u in M.UNITS]])

    def whole(text):
        step = lambda acc, p: F.when(F.regexp_replace(acc, p, F.lit("$1$2")) != "", F.regexp_replace(acc, p, F.lit("$1$2"))).otherwise(acc)
        return F.aggregate(F.concat(patterns, patterns), text, step)

    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for row in df.select("t", M.remove_units(F.col("t")).alias("got"), whole(F.col("t")).alias("want")).collect():
        assert row.got == row.want, row


def test_few_unit_patterns_are_tried():
    assert max(len(own) for own in M.UNITS_BY_WORD.values()) < 10
    assert sorted(i for own in M.UNITS_BY_WORD.values() for i in own) == list(range(2 * len(M.UNITS)))
