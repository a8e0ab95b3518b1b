"""Token counts as a delta-maintained rollup.

A batch holds signed rows: an insert adds a document's count, a delete takes it back, a revised count does both. Each
batch is summed per (source, lang, version) and written to a new folder; one row of the ledger's log then publishes it. A
batch that is sent again is written beside its old folder and takes its place when its row appears, so a repeated, half-written
or dying commit leaves the totals right at every moment. Totals are the sum over the published batches; they are additive, so
batches may be summed in any order. One writer at a time.

The counts of a version are a column (words, words and marks) or come from a real tokenizer, :func:`with_tokenizer_counts`.

Defined cases: null source or lang is a group of its own; null text has no tokens but is a document; a row that occurs
twice in one batch counts twice. Groups whose documents all went stay with zeros unless ``drop_empty``. No batch or an
empty batch gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyframe.llm import packing, textnp
from tallyframe.llm.registry import query
from tallyframe.llm.shared import shared_dir, table, text_of, words_of

KEYS = ["source", "lang", "version"]
# Version names with their count: white-space words, and words plus punctuation marks.
COUNTERS = {
    "words-1": lambda t: F.size(words_of(t)).cast("long"),
    "words-2": lambda t: (F.size(words_of(t)) + F.length(t) - F.length(F.translate(t, ".,;:!?", ""))).cast("long"),
}


def signed(docs: DataFrame, sign: int, version: str, counter: Column | None = None) -> DataFrame:
    """Rows of a batch: ``sign`` is 1 for inserts and -1 for deletes."""
    count = counter if counter is not None else COUNTERS[version](text_of())
    return docs.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("version"), F.lit(sign).cast("long").alias("n_docs"), (count * sign).alias("n_tokens"),
    )


def revised(docs: DataFrame, before: str, after: str) -> DataFrame:
    """Rows that replace the count by tokenizer version ``before`` by the count by ``after``; the text is read once."""
    both = F.array(*[
        F.struct(F.lit(v).alias("version"), F.lit(s).cast("long").alias("n_docs"), (COUNTERS[v](F.col("t")) * s).alias("n_tokens"))
        for v, s in ((before, -1), (after, 1))
    ])
    rows = docs.select("source", "lang", text_of().alias("t"))
    return rows.select("source", "lang", F.inline(both)).select(*KEYS, "n_docs", "n_tokens")


def with_tokenizer_counts(docs: DataFrame, tokenizer: str = packing.TOKENIZER, text_col: str = "text", name: str = "n_ids") -> DataFrame:
    """``docs`` with the number of ids that a public tokenizer gives each whole text; a null text has none."""
    place = docs.columns.index(text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = packing.unit_ids(packing.tokenizer_path(tokenizer))
        for batch in batches:
            data, at = textnp.buffers(batch.column(place))
            for first, last in textnp.row_chunks(at, 4 * textnp.CHUNK):
                _, n = own.rows(data[at[first] : at[last]], at[first : last + 1] - at[first])
                columns = [c.slice(first, last - first) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], [*batch.schema.names, name])

    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


LOG = "seq long, batch long, folder string"
SUMS = "source string, lang string, version string, n_docs long, n_tokens long"


class TokenLedger:
    """Published batches below one shared folder: ``data/<folder>`` holds sums, ``log`` says which folder is a batch's."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def published(self) -> dict[int, str]:
        """The folder of every published batch; the latest row of a batch counts. One row per commit is read."""
        try:
            log = self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException:
            return {}
        return {r["batch"]: r["folder"] for r in log.groupBy("batch").agg(F.max_by("folder", "seq").alias("folder")).collect()}

    def write(self, batch: int, rows: DataFrame) -> str:
        """Sums of a batch in a new folder that no total reads yet."""
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        folder = f"{batch}-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def publish(self, batch: int, folder: str) -> None:
        """One row in one file: the batch is the folder's from the moment it appears."""
        try:
            last = self.spark.read.schema(LOG).parquet(f"{self.path}/log").agg(F.max("seq")).first()[0]
        except AnalysisException:
            last = None
        row = self.spark.createDataFrame([(0 if last is None else last + 1, batch, folder)], LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def commit(self, batch: int, rows: DataFrame) -> None:
        """Write and publish a batch; sending it again replaces what it counted before."""
        self.publish(batch, self.write(batch, rows))

    def totals(self, batches: list[int] | None = None, drop_empty: bool = False) -> DataFrame:
        """Totals over all published batches, or over those of them that are named."""
        folders = [f for b, f in sorted(self.published().items()) if batches is None or b in batches]
        rows = self.spark.read.schema(SUMS).parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], SUMS)
        out = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.filter("n_docs <> 0 OR n_tokens <> 0") if drop_empty else out


SQL10 = r"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
c AS (SELECT *, len(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w,
      length(t) - length(regexp_replace(t, '[.,;:!?]', '', 'g')) AS p FROM d),
r AS (
  SELECT source, lang, 'words-1' AS version, 1 AS n_docs, w AS n_tokens FROM c
  UNION ALL SELECT source, lang, 'words-1', -1, -w FROM c WHERE lang = 'en'
  UNION ALL SELECT source, lang, 'words-2', 1, w + p FROM c WHERE lang = 'en'
  UNION ALL SELECT source, lang, 'words-1', -1, -w FROM c WHERE (lang <> 'en' OR lang IS NULL) AND w < 10)
SELECT source, lang, version, CAST(sum(n_docs) AS BIGINT) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens
FROM r GROUP BY ALL
"""


@query(SQL10)
def op10_token_rollup(spark, sf_dir):
    """All documents enter; English ones move to the next tokenizer version; short others leave; two batches come twice."""
    docs = table(spark, sf_dir, "documents")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    short = docs.filter(~english & (F.size(words_of(text_of())) < 10))
    ledger = TokenLedger(spark, f"{shared_dir(spark).rstrip('/')}/token-ledger-{uuid.uuid4().hex}")
    batches = {0: signed(docs, 1, "words-1"), 1: revised(docs.filter(english), "words-1", "words-2"), 2: signed(short, -1, "words-1")}
    for batch in (0, 1, 1, 2, 2):
        ledger.commit(batch, batches[batch])
    return ledger.totals()
