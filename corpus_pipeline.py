"""From raw documents to packed sequences: each stage calls one operator, is written as Parquet and read again.

Rows with null texts pass every filter (they score, match and hold nothing) and are packed as the end id alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm import neardup, packing, pii, spaced_seeds, toxicity
from tallyframe.llm.shared import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Similarity of word shingles, in percent, from which two documents are near duplicates here; op7 has its own threshold.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the model learns from the labels outside the held-out quarter."""
    docs = docs.select(COLUMNS)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return neardup.keep_one(docs.select(COLUMNS), NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a verified passage of the benchmark go."""
    return spaced_seeds.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span becomes its kind in brackets; ``n_chars`` follows the new text."""
    docs = docs.select(COLUMNS)
    masked = pii.redact(pii.find_spans(docs, pii.fit(docs)))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: A trained tagger and a tokenizer are no SQL; tests/llm/test_pipeline.py compares the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows are returned."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
