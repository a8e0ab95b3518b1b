import random

from plain import components as plain_components

from pyspark.sql import functions as F
from tallyframe.llm import neardup
from tallyframe.llm.graph import components


def near_copies():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for group in range(4):
        base = [draw.choice(words) for _ in range(90)]
        for copy in range(30):
            own = list(base)
            for _ in range(copy % 6):
                own[draw.randrange(len(own))] = draw.choice(words)
            texts[group * 100 + copy] = " ".join(own)
    return texts


def run(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("signature", F.lit("s"))
    return neardup.near_duplicates(docs).collect()


def test_against_all_pairs(spark):
    texts = near_copies() | {900: None, 901: "", 902: " \n", 903: "a B c", 904: "A b\tC", 905: "one two three four five", 906: "one two three four five six", 907: "long " * 20000}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, texts)}
    assert got == plain_components(texts)


def test_blocks_find_every_open_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, texts)}
    assert got == plain_components(texts)


def test_repeated_ids_and_empty_table(spark):
    text = "this is a text of more than five words"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None)], "doc_id long, text string")
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == 5 and {r.component_id for r in out if r.doc_id in (1, 2)} == {1}
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200 + i, 300) for i in range(50)] + [(7, 7), (300, 200)]
    draw = random.Random(1)
    draw.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {200 + i: 200 for i in range(50)} | {300: 200}


def test_pruning_keeps_pairs_at_the_threshold():
    import math

    total = neardup.BANDS * neardup.ROWS
    miss = sum(
        sum(math.comb(n, m) * 0.85**m * 0.15 ** (n - m) for m in range(least))
        for n, least in zip(range(neardup.BATCH, total + 1, neardup.BATCH), neardup.least_matches())
    )
    assert miss < 20 * neardup.MISS
