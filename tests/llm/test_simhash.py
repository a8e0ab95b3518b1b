import hashlib
import random

import xxhash
from plain import simhash

from tallyframe.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, block string"


def texts():
    rng = random.Random(5)
    words = ["the", "of", "Ünder", "çoi", "x" * 40, "a", "blethi", "ntion", "42"]
    out = [(i * 3, " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 60))), "x", "y") for i in range(40)]
    out += [(200, None, "x", "y"), (201, "", "x", "y"), (202, " \t\n", "x", "y"), (203, "one", "x", "y"), (204, "😀 é", "x", "y")]
    out += [(300, "long " * (2 * S.CHUNK) + "tail end", "x", "y"), (None, "no id at all", "x", "y")]
    return out + [(5, "twice the same row here", "x", "y")] * 2 + [(6, "tied b", "x", "y"), (6, "tied a", "x", "y")] + [(400, out[7][1], "x", "y")]


def test_fingerprints_edits_and_next_documents(spark):
    rows = texts()
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64((t or "").encode(), seed=42).intdigest())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    want = []
    for (doc, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        fps = [simhash(x) for x in (text, edited, after)]
        like = [1 - (fps[0] ^ x).bit_count() / 64 for x in fps[1:]]
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{fps[0]:016x}", f"{fps[1]:016x}", *like))
    df = spark.createDataFrame(rows, SCHEMA)
    found = S.neighbours(df, every=1).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:7]) for r in found)
    values = [simhash(r[1]) for r in rows]
    for r in found:
        near = sum((int(r.fingerprint, 16) ^ x).bit_count() <= S.RADIUS for x in values) - 1
        assert r.n_near == near if r.doc_id is not None else r.n_near is None


def test_blocks_of_ids_do_not_change_the_next_document(spark):
    df = spark.createDataFrame([r for r in texts() if r[0] != 6], SCHEMA)
    rows = lambda blocks: sorted(map(str, S.fingerprints(df, blocks=blocks).collect()))
    assert rows(1) == rows(3) == rows(50)


def test_search_finds_everything_within_the_radius(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values):
        for flips in (1, 2, 3, 4):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), flips)))
    values += values[:20]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values] + [(None,)], "fp long")
    for radius, blocks in ((3, 6), (3, 4), (0, 1), (1, 5)):
        found = {r.fp: (r.n_rows, r.n_values) for r in S.search(df, df, radius, blocks).collect()}
        near = lambda v, of: sum((v ^ x).bit_count() <= radius for x in of)
        assert found == {signed(v): (near(v, values), near(v, set(values))) for v in values}


def test_one_pair_of_long_words_over_and_over(spark):
    rows = [(20 * k, f"{word} " * n, "x", "y") for k, (word, n) in enumerate([("internationalisation", 2200), ("x" * 15, 4400), ("é" * 30, 9000)])]
    found = S.neighbours(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    assert [r.fingerprint for r in found] == [f"{simhash(t):016x}" for _, t, *_ in rows]
    edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for (_, t, *_), (_, after, *_) in zip(rows, rows[1:] + [(0, "")])]
    assert [r.edited_fingerprint for r in found] == [f"{simhash(t):016x}" for t in edited]


def test_empty_table_and_a_single_document(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.neighbours(empty).collect() == []
    (r,) = S.neighbours(spark.createDataFrame([(20, "abcd efgh", "x", "y")], SCHEMA)).collect()
    assert (r.n_chars, r.edited_sha256, r.n_near) == (9, hashlib.sha256(b"abcd efab").hexdigest(), 0) and r.near_next == 1.0
