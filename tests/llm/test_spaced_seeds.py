from itertools import combinations

from plain import contaminated

from pyspark.sql import functions as F
from tallyframe.llm import spaced_seeds

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), (2, "too short"), (3, None), (1, "red orange yellow green blue indigo violet black white grey"),
         (5, "three word item"), (6, "an item of just six words"), (7, "eight words that make a whole item here")]
TEXTS = [
    (10, "Well: ONE two three, four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen."),
    (11, "one two WRONG four five six seven WRONG nine ten eleven twelve WRONG fourteen fifteen sixteen"),
    (12, "one two three four five six seven eight and then something else entirely follows here"), (13, None), (14, ""), (15, "too short"),
    (16, "x " * 5000 + "red orange yellow green blue indigo violet black white grey"), (17, "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"),
    (20, "a three, word item"), (21, "three words item"), (22, "Here: an item of just six words"), (23, "an item of only six words"),
    (24, "eight words NO make a NO item here"), (25, "NO words that NO a whole item here"), (26, "word item"), (27, "three"),
    (18, "one x three x five x seven x nine x eleven x thirteen x fifteen x"), (None, "one two three four five six seven eight nine ten eleven twelve thirteen"),
    (10, "Well: ONE two three, four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen."),
]


def test_against_plain_version(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("item_id", F.lit(9))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(3))
    expected = {d: contaminated(t, [x for _, x in ITEMS]) for d, t in TEXTS if d is not None} | {None: False}
    for most in (spaced_seeds.BROADCAST_ROWS, 0):  # broadcast, and shuffled
        rows = spaced_seeds.overlaps(docs, bench, most).select("doc_id").distinct().collect()
        assert {r.doc_id for r in rows} == {d for d, x in expected.items() if x}
    out = spaced_seeds.decontaminate(docs, bench).collect()
    assert len(out) == len(TEXTS) and all(r.contaminated == expected[r.doc_id] for r in out)
    assert spaced_seeds.clean(docs, bench).columns == docs.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert spaced_seeds.decontaminate(none, bench).count() == 0
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert spaced_seeds.clean(docs, bench.limit(0)).count() == len(TEXTS)


def test_masks_see_every_overlap_that_the_rule_admits():
    """Every choice of places that may differ leaves some mask on equal words, for items of 8 words to windows of 13."""
    for n in range(spaced_seeds.SPAN, spaced_seeds.WINDOW + 1):
        most = next(k for k in range(n, -1, -1) if 100 * (n - k) >= spaced_seeds.AGREE * n)
        for bad in combinations(range(n), most):
            assert any(
                all(at + k not in bad for k, bit in enumerate(mask) if bit == "1") for mask in spaced_seeds.MASKS for at in range(n - len(mask) + 1)
            ), (n, bad)
