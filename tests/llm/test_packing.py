import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import packing

TEXTS = [
    (-1, None), (-2, ""), (-3, " \n "), (-4, "It's <|endoftext|> ﬁ é x ΣΑΣ don't 123.5 café́ ('a.'s) …, ×÷"), (-5, "word " * 9000),
    (-6, "Ab" * 5000), (-6, "Ab" * 5000), (-7, "a.b,c!'s 're.x"), (-8, "x<|startoftext|><|endoftext|>y Y<|ENDOFTEXT|>.<|endoftext| >"),
]


def expected(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    out = []
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out += [(doc, p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    return sorted(out)


def check_places(rows):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences)


def test_pieces_and_places(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("piece", F.lit("extra")).withColumn("rank", F.lit(0))
    rows = packing.pack(docs).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected(TEXTS)
    check_places(rows)


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert check_places(rows) <= -(-sum(r.length for r in rows) // 4096) + 2


def test_plan_is_tight_at_every_size():
    rng = np.random.default_rng(5)
    for n in (1, 40, 3000, 100_000):
        lengths, counts = np.unique(np.minimum(rng.lognormal(6, 1.1, n).astype(int) + 1, 4096), return_counts=True)
        histogram = dict(zip(lengths.tolist(), counts.tolist()))
        runs, sequences = packing.plan(histogram)
        for length, count in histogram.items():
            own = sorted((r[1], r[2]) for r in runs if r[0] == length)
            assert [a for a, _ in own] == [0, *np.cumsum([c for _, c in own])[:-1].tolist()] and sum(c for _, c in own) == count
        assert sequences <= 1.01 * -(-sum(k * c for k, c in histogram.items()) // 4096) + 2
        assert len(runs) < 60_000


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
