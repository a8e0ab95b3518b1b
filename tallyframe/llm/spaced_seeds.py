"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A fixed mask looks at some of a few consecutive words and ignores the others, so a replaced word hides few seeds. Hashes
of all masked windows of the documents meet those of the benchmark. Each distinct alignment (document, item, shift) is
then verified word by word: it counts if some ``WINDOW`` aligned words of the item (all of it, if shorter) agree in at
least ``AGREE`` percent. The masks are complete for this rule: wherever the words that may differ lie, some mask looks at
equal words only. Items of fewer than ``SPAN`` words count where all their words are quoted; those that are shorter than any
mask are found by the hash of their whole sequence.

The benchmark side is broadcast only after its rows were counted against ``BROADCAST_ROWS``; beyond that the hashes meet
in a shuffled join, with the same result.

Defined cases: words are runs of letters and digits, lower-cased; null or empty text has none. Items of fewer than
``LEAST_WORDS`` words are no passage and find nothing. Repeated rows and items are judged alike (an item id that occurs twice stands for both
texts); a null document id is never flagged. Empty tables flag nothing; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.columns import let
from tallyframe.llm.registry import query
from tallyframe.llm.shared import cut, table, text_of

# The masks; 1 is compared, 0 is ignored. tests/llm/test_spaced_seeds.py proves them complete by enumeration.
MASKS = ["111011", "11001011", "11111", "101111", "11110001", "10100111", "11010101"]
SPAN = 8
LEAST_WORDS = 3
WINDOW = 13
AGREE = 75
BROADCAST_ROWS = 2_000_000


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, keep: list[str], short: list[int] = ()) -> DataFrame:
    """(keep..., at, key): one row per window and mask of the hash array ``h``, and per window of each of the ``short`` lengths."""
    windows = F.arrays_zip(F.sequence(F.lit(0), F.size("h") - 1).alias("at"), *[F.slice("h", k + 1, F.size("h")).alias(f"w{k}") for k in range(SPAN)])
    flat = rows.filter(F.size("h") > 0).select(*keep, F.inline(windows))
    # Behind the last word the columns are null; a window counts if its last compared word is there.
    hashed = lambda tag, mask: F.when(
        F.col(f"w{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(tag), *[F.col(f"w{k}") for k, bit in enumerate(mask) if bit == "1"])
    )
    keys = [hashed(m, mask) for m, mask in enumerate(MASKS)] + [hashed(-n, "1" * n) for n in short]
    return flat.select(*keep, "at", F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL")


def agreement(doc: Column, item: Column, shift: Column) -> Column:
    """Most agreeing words in any window of the item at this alignment, and the window's length: struct<best, of>."""
    of = F.least(F.size(item), F.lit(WINDOW))
    before = F.array_repeat(F.lit(None).cast("long"), F.greatest(-shift, F.lit(0)))
    aligned = F.concat(before, F.slice(doc, F.greatest(shift, F.lit(0)) + 1, F.size(item)))
    equal = F.slice(F.zip_with(item, aligned, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(1), F.size(item))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    # The equal words are bound once; inside a lambda they would be found anew for each window.
    best = let(equal, lambda e: F.array_max(F.transform(F.sequence(F.lit(1), F.size(item) - of + 1), lambda i: total(F.slice(e, i, of)))))
    return F.struct(best.alias("best"), of.alias("of"))


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Verified alignments: doc_id, item_id, shift (first item word's place in the document), best, of."""
    items = cut(benchmark.select("item_id", word_hashes(text_of()).alias("h")))
    least = min(map(len, MASKS))
    lengths = items.select(F.size("h").alias("n")).filter(F.col("n").between(LEAST_WORDS, least - 1)).distinct()
    short = sorted(r["n"] for r in lengths.collect())  # a few numbers below the shortest mask
    long = seeds(items.filter(F.size("h") >= least), ["item_id"])
    whole = [seeds(items.filter(F.size("h") == n), ["item_id"], [n]) for n in short]
    targets = cut(reduce(DataFrame.union, whole, long).withColumnRenamed("at", "item_at").distinct())
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", text_of().alias("text"))
    if targets.count() <= broadcast_rows:
        targets = F.broadcast(targets)
    found = seeds(texts.select("doc_id", word_hashes(F.col("text")).alias("h")), ["doc_id"], short).join(targets, "key")
    found = cut(found.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    words = items.withColumnRenamed("h", "item")
    pairs = texts.join(found, "doc_id").join(words, "item_id")
    checked = pairs.select("doc_id", "item_id", "shift", agreement(word_hashes(F.col("text")), F.col("item"), F.col("shift")).alias("a"))
    return checked.select("doc_id", "item_id", "shift", "a.best", "a.of").filter(f"100 * best >= IF(of < {SPAN}, 100, {AGREE}) * of")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_id (smallest one found, or -1), max_words."""
    found = overlaps(docs, benchmark).groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("item_id"), F.max("best").cast("long").alias("max_words")
    )
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_id", F.lit(-1)).cast("long").alias("item_id"), F.coalesce("max_words", F.lit(0)).cast("long").alias("max_words"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that share no verified passage with the benchmark."""
    flagged = overlaps(docs, benchmark).select("doc_id").distinct()
    return docs.join(flagged, "doc_id", "left_anti")


def _masked_sql(at: str) -> str:
    """A list of one text per mask, the mask's number before the words; null where the window does not fit."""
    words = lambda mask: ", ".join(f"w[{at} + {k}]" for k, bit in enumerate(mask) if bit == "1")
    return "[" + ", ".join(f"CASE WHEN len(w) >= {at} + {len(m) - 1} THEN concat_ws(' ', '{n}:', {words(m)}) END" for n, m in enumerate(MASKS)) + "]"


SQL4 = rf"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM dw),
ip AS (SELECT item_id, w, unnest(generate_series(1, len(w))) AS j FROM iw),
dk AS (SELECT doc_id, i, unnest({_masked_sql('i')}) AS k FROM dp),
ik AS (SELECT item_id, j, unnest({_masked_sql('j')}) AS k FROM ip),
short AS (SELECT DISTINCT len(w) AS n FROM iw WHERE len(w) BETWEEN {LEAST_WORDS} AND 4),
hit AS (SELECT DISTINCT doc_id, item_id, i - j AS s FROM dk JOIN ik USING (k) UNION
  SELECT doc_id, item_id, i - 1 FROM dp JOIN short ON i + n - 1 <= len(w) JOIN iw ON len(iw.w) = n AND iw.w = dp.w[i:i + n - 1]),
eq AS (SELECT hit.doc_id, hit.item_id, s, len(iw.w) AS n, list_transform(generate_series(1, len(iw.w)),
    lambda p: CASE WHEN p + s >= 1 AND dw.w[p + s] = iw.w[p] THEN 1 ELSE 0 END) AS e
  FROM hit JOIN dw USING (doc_id) JOIN iw USING (item_id)),
b AS (SELECT doc_id, item_id, least(n, 13) AS o,
    list_max(list_transform(generate_series(1, n - least(n, 13) + 1), lambda q: list_sum(e[q:q + least(n, 13) - 1]))) AS best FROM eq),
f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, min(item_id) AS item_id, max(best) AS max_words FROM b
  WHERE 100 * best >= CASE WHEN o < 8 THEN 100 ELSE 75 END * o GROUP BY 1)
SELECT d.doc_id, f.n_items IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(item_id, -1) AS item_id,
  CAST(coalesce(max_words, 0) AS BIGINT) AS max_words
FROM documents d LEFT JOIN f USING (doc_id)
"""


@query(SQL4)
def op4_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
