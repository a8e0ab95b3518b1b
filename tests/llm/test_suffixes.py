import random

from plain import repeats

from pyspark.sql import functions as F
from tallyframe.llm import suffixes

PASSAGE = "The quick brown fox jumps over the lazy dog and runs away from here é "


def texts():
    draw = random.Random(4)
    out = {i: "".join(draw.choice("ab c") for _ in range(300)) for i in range(20)}
    shared = "".join(draw.choice("abcdefgh ") for _ in range(90))
    for i in range(20, 60):
        cut = draw.randrange(40)
        out[i] = out[draw.randrange(20)][draw.randrange(200) :] + shared[cut : cut + 30 + draw.randrange(60)] + str(i) * 30
    out |= {-1: None, -2: "", -3: PASSAGE, -4: "xx" + PASSAGE + "yy", -5: "a" * 300, -6: "b" + "a" * 120 + "c", -7: "\0" * 60, -8: "\0" * 49}
    return out | {100: PASSAGE * 30, 101: "q" + "\0" * 70, 102: shared, 103: shared}


def test_against_every_window(spark):
    own = texts()
    docs = spark.createDataFrame(list(own.items()), "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("rid", F.lit(1))
    for parts in (1, 7):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs, parts).collect()}
        assert got == repeats(own)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (1, "z" + PASSAGE), (None, PASSAGE), (2, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id or 99, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(docs, 3).collect()))
    assert rows == [(1, 0, 0), (1, 0, 0), (1, 0, 0), (2, 0, 0), (99, len(PASSAGE.encode()), 1)]
    assert suffixes.remove_repeats(docs.limit(0), 2).count() == 0


def test_loser_tree_never_sorts_wrongly():
    draw = random.Random(5)
    for n in (1, 2, 3, 5, 8):
        runs = [sorted(bytes(draw.choice(b"ab") for _ in range(suffixes.LENGTH)) for _ in range(draw.randrange(0, 40))) for _ in range(n)]
        lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), suffixes.LENGTH)
        shared = [[0, *(lcp(a, b) for a, b in zip(r, r[1:]))][: len(r)] for r in runs]
        order, prefix = suffixes.merge_runs(shared, runs)
        at = [0] * n
        merged = []
        for r in order:
            merged.append(runs[r][at[r]])
            at[r] += 1
        assert merged == sorted(x for r in runs for x in r)
        assert prefix == [0, *(lcp(a, b) for a, b in zip(merged, merged[1:]))][: len(merged)]


def test_texts_longer_than_a_chunk_and_more_anchors_than_a_run(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN", 64)
    monkeypatch.setattr(suffixes, "CHUNK", 4096)
    draw = random.Random(9)
    long = "".join(draw.choice("abcdefgh ") for _ in range(30_000))
    own = {1: long, 2: "x" * 10 + long[20_000:29_000] + "y" * 10, 3: long[:70] + "é" * 200 + long[15_000:15_060], 4: "é" * 300, 5: long[100:140]}
    docs = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs, 3).collect()}
    assert got == repeats(own)


def test_a_long_text_at_full_size(spark):
    draw = random.Random(10)
    long = "".join(draw.choice("abcdefghijklmnop ") for _ in range(1_200_000))
    rows = [(1, "q" + long[500_000:500_200] + "r"), (2, long), (3, long[-5_000:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(docs, 2).collect()}
    assert got == {1: (202, 0, 0), 2: (1_200_000, 200, 1), 3: (5_000, 5_000, 1)}
