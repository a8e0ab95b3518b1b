"""Resumable jobs as file streams: n-gram indexes and growing score tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tallyframe.operators.ngrams import word_ngrams
from tallyframe.session import small_parts
from tallyframe.sources.ngram_store import TEXT_BYTES, NgramStore


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str, files: str = "*", per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .format(fmt)
        .option("maxFilesPerTrigger", per_batch)
        .option("pathGlobFilter", files)
        .load(path)
    )


def stream_ngram_index(docs: DataFrame, key: str, text: str, store: NgramStore, checkpoint: str) -> StreamingQuery:
    """Add the (ngram, key) rows of new corpus files to an index, one run per batch.

    N-grams are made inside the row, so the stream keeps no state; a batch's texts are dealt to tasks that sort theirs in
    memory. The index takes a batch once, by its number: a batch that is run again after a failure either finds itself
    published or replaces files that were never published.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        texts = small_parts(batch, "text", TEXT_BYTES)
        store.append(word_ngrams(texts, ["doc_id"], "text", store.n, once=True), f"{checkpoint}#{batch_id}")

    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_scores(samples: DataFrame, keys: list[str], newest: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append samples whose keys have no result yet; of a batch's rows of one key, the one with the largest ``newest``.

    The engine keeps one row per key in its keyed state store (RocksDB, saved with the checkpoint): the earliest batch's
    best row. A batch touches the state of its own keys only; nothing that was written before is read again, however long
    the history is. A key that the batch did not bring in anew is left out of the batch's output.

    A batch's time is fixed in the checkpoint, so a batch that is run again after a failure finds the same rows, and it
    replaces its own output folder. Rows that agree in keys and ``newest`` are settled by their other columns. Null keys are
    keys; a null ``newest`` loses to any other.
    """
    names = samples.columns
    arrival = F.unix_micros(F.current_timestamp())
    ranked = samples.withColumn("_order", F.struct((-arrival).alias("before"), F.col(newest).alias("newest"), F.struct(*names).alias("row")))
    best = ranked.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max("_order").alias("_best"))
    fresh = best.filter(F.col("_best.before") == -arrival).select("_best.row.*")

    with state_store(samples.sparkSession):
        return (
            fresh.writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, out))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def write_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """One folder per batch, replaced when the batch is run again."""
    batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKSDB):
    """A query started inside keeps its state in the given store; the session's own setting returns afterwards."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, provider)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
