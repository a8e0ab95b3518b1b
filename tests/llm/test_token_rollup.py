from pyspark.sql import functions as F

from tallyframe.llm import packing
from tallyframe.llm.token_rollup import TokenLedger, revised, signed, with_tokenizer_counts

ROWS = [(1, "one two, three.", "a", "en"), (2, None, None, None), (3, "x", "a", "en"), (3, "x", "a", "en"), (4, "w " * 30000, "b", None)]


def test_totals_survive_repeated_and_reordered_batches(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string").withColumn("version", F.lit("clash")).withColumn("t", F.lit(1))
    ledger = TokenLedger(spark, str(tmp_path))
    batches = {0: signed(docs, 1, "words-1"), 1: revised(docs.filter("doc_id = 1"), "words-1", "words-2"), 2: signed(docs.filter("doc_id = 3"), -1, "words-1")}
    for b in (2, 0, 1, 1, 0, 2):
        ledger.commit(b, batches[b])
    rows = lambda df: {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in df.collect()}
    expected = {("a", "en", "words-1"): (0, 0), ("a", "en", "words-2"): (1, 5), (None, None, "words-1"): (1, 0), ("b", None, "words-1"): (1, 30000)}
    assert rows(ledger.totals([0, 1, 2])) == rows(ledger.totals([2, 1, 0, 1])) == expected
    assert ("a", "en", "words-1") not in rows(ledger.totals([0, 1, 2], drop_empty=True))
    assert rows(ledger.totals([0]))["a", "en", "words-1"] == (3, 5)


def test_no_batches_and_empty_batch(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    ledger = TokenLedger(spark, str(tmp_path))
    ledger.commit(0, signed(docs, 1, "words-1"))
    assert ledger.totals([]).count() == 0 and ledger.totals([0]).count() == 0


def test_unpublished_and_replaced_batches(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    ledger = TokenLedger(spark, str(tmp_path))
    total = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    ledger.commit(0, signed(docs, 1, "words-1"))
    before = total()
    ledger.write(1, signed(docs, 1, "words-1"))  # dies before its row appears
    assert total() == before and list(ledger.published()) == [0]
    ledger.write(0, signed(docs.limit(0), 1, "words-1"))  # a second delivery that dies
    assert total() == before
    ledger.commit(0, signed(docs.filter("doc_id = 1"), 1, "words-1"))
    assert total() == {("a", "en"): (1, 3)}
    assert TokenLedger(spark, str(tmp_path)).totals().collect() == ledger.totals().collect()


def test_counts_of_a_real_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    counted = with_tokenizer_counts(docs)
    ids = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert sorted((r.doc_id, r.n_ids) for r in counted.collect()) == sorted((d, ids(t)) for d, t, *_ in ROWS)
    ledger = TokenLedger(spark, str(tmp_path))
    ledger.commit(0, signed(counted, 1, "word_bpe_49k", F.col("n_ids")))
    ledger.commit(1, signed(counted.filter("doc_id = 3"), -1, "word_bpe_49k", F.col("n_ids")))
    assert {(r.source, r.lang): r.n_tokens for r in ledger.totals().collect()} == {
        ("a", "en"): ids(ROWS[0][1]), (None, None): 0, ("b", None): ids(ROWS[4][1])
    }
