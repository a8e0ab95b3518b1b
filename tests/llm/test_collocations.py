import random

import numpy as np
import pytest
from plain import collocations

from tallyframe.llm import collocations as C

SCHEMA = "doc_id long, lang string, text string, phrase string, row long"


def docs():
    rng = random.Random(4)
    words = ["the", "of", "A", "é", "verylongwordindeed", "in", "x1", "Tea"]
    out = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "."]) for _ in range(rng.randrange(0, 80)))
        out.append((i, rng.choice(["en", "de", None, ""]), text, "p", 1))
    out += [(500, "en", None, "p", 1), (501, None, "", "p", 1), (502, "fr", "only once", "p", 1), (503, "en", "tea the of in " * 5000, "p", 1)]
    return out + out[:3] + [(504, "en", "en", "p", 1), (505, "de", "de", "p", 1)]


@pytest.mark.parametrize("limit", [C.GROUP_BYTES, 0])
def test_against_counted_phrases(spark, limit):
    rows = docs()
    phrases, totals = C.frequent_phrases(spark.createDataFrame(rows, SCHEMA), min_count=9, limit=limit)
    found = C.top(C.collocations(phrases, totals), 50).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, found.collect())) == collocations([r[1:3] for r in rows], 9, 50)


def test_empty_table_and_no_frequent_phrase(spark):
    for rows in ([], docs()[:2]):
        phrases, totals = C.frequent_phrases(spark.createDataFrame(rows, SCHEMA), min_count=10**6)
        assert C.top(C.collocations(phrases, totals)).collect() == []


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a", 1, 10**13), ("en", "b", 1, 10**12), ("en", "a b", 2, 10**12 - 1)], "lang string, phrase string, m int, a long")
    totals = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    (r,) = C.collocations(phrases, totals).collect()
    assert r.score == 1000 * (10**12 - 1) * 10**14 // (10**13 * 10**12)


def test_words_under_one_number_are_seen(spark, monkeypatch):
    real = C.word_hashes
    # Under the first seed all words of one length share a number.
    monkeypatch.setattr(C, "word_hashes", lambda data, s, e: (e - s).astype(np.uint64))
    text = C.pa.array(["ab cd ab", "ab"])
    batch = C.pa.RecordBatch.from_arrays([text, C.pa.array(["en", "en"])], ["t", "lang"])
    (found,) = list(C.counted([batch], 0))
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("word", "n"))))
    assert rows == [("ab", 3), ("cd", 1)]
    assert real is not C.word_hashes


def test_same_words():
    data = np.frombuffer(b"abcdefghij abcdefghij abcdefghix ", np.uint8)
    a, b = np.array([0, 0, 0]), np.array([11, 22, 0])
    assert C.same_words(data, a, b, np.array([10, 10, 0])).tolist() == [True, False, True]


def test_slices_of_the_relation_keep_every_row():
    rng = np.random.default_rng(3)
    sizes = [0, 5, 0, 40, 1, 1, 7, 0, 90, 3]
    pos = [sorted(rng.choice(200, n, replace=False).tolist()) for n in sizes]
    ids = [rng.integers(0, 9, n).tolist() for n in sizes]
    batch = C.pa.RecordBatch.from_pydict({"row": list(range(10)), "pos": C.pa.array(pos, C.pa.list_(C.pa.int32())), "id": C.pa.array(ids, C.pa.list_(C.pa.int64()))})
    for part in (batch, batch.slice(2, 7)):
        want = {(r["row"], p, a, b) for r in part.to_pylist() for (p, a), (q, b) in zip(zip(r["pos"], r["id"]), list(zip(r["pos"], r["id"]))[1:]) if q == p + 1}
        for entries in (1, 10, 50, 1000):
            found, rows = set(), []
            for few in C.few_rows([part], entries):
                own = few.column("row").to_numpy()
                rows += own.tolist()
                found |= {(int(own[i]), int(p), int(a), int(b)) for i, p, a, b in zip(*C.adjacent(few))}
            assert rows == part.column("row").to_pylist() and found == want
