"""Writers and readers against each other: each query writes to the shared folder, reads back and returns rows."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tallyframe.operators import ngrams as N
from tallyframe.plans import bindings as B
from tallyframe.plans.attempt_queries import MATRIX, attempt_matrix
from tallyframe.plans.registry import query
from tallyframe.plans.stream_queries import fresh_folder
from tallyframe.plans.table_queries import results_json
from tallyframe.session import small_parts
from tallyframe.sources import sinks, tables
from tallyframe.sources.ngram_store import TEXT_BYTES


@query("S1", "select p_partkey, lower(p_name) as name, p_brand as brand, row_number() over (order by p_partkey) - 1 as idx from part")
def read_eval_table(spark, sf):
    """JSON lines with mixed-case keys; the files already carry an idx in key order."""
    from tallyframe.operators.ordering import dense_index

    path = fresh_folder(spark, "eval")
    p = dense_index(B.table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("NAME"), F.col("p_brand").alias("Brand")), ["p_partkey"], "idx")
    p.write.json(path)
    schema = p.limit(0).schema
    return tables.read_eval_table(spark, path, schema=schema).select("p_partkey", "name", "brand", "idx")


@query(
    "S6",
    """select source as part, count(*) as n_docs, sum(length(text))::bigint as n_chars from documents group by 1""",
)
def read_corpus(spark, sf):
    """Text as one string for even ids and as paragraph lists for odd ones, one folder per source."""
    path = fresh_folder(spark, "corpus")
    d = B.table(spark, sf, "documents")
    whole = F.to_json(F.struct("text"))
    parts = F.to_json(F.struct(F.split("text", "\n\n").alias("text")))
    line = F.when(F.col("doc_id") % 2 == 0, whole).otherwise(parts)
    d.select("source", line.alias("value")).write.partitionBy("source").option("compression", "gzip").text(path)
    back = tables.read_corpus(spark, path).withColumn("part", F.regexp_extract("file", "source=([^/]*)/", 1))
    return back.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query("S8", "select conv_id, turn, 'm' || (conv_id % 3) as model, role as task, text as target, turn::varchar as filtered from conversations")
def write_sample_logs(spark, sf):
    path = fresh_folder(spark, "logs")
    c = B.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"), F.col("role").alias("task"), F.col("text").alias("target"),
        F.array(F.array("role")).alias("arguments"), F.array(F.array("conv_id")).alias("resps"), F.array("turn").alias("filtered_resps"),
    )
    sinks.write_sample_logs(c, path)
    back = spark.read.schema("conv_id long, turn long, target string, filtered_resps array<string>, model string, task string").json(path)
    return back.select("conv_id", "turn", "model", "task", "target", F.get("filtered_resps", F.lit(0)).alias("filtered"))


@query("S3 S8", "select conv_id, turn, role as task, 'm' || (conv_id % 2) as model, text as target from conversations")
def read_sample_logs(spark, sf):
    """Logs of two models in files named by task and time, read back with the task from the name of each file."""
    path = fresh_folder(spark, "sample-logs")
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("target"))
    for k, role in itertools.product(range(2), ("system", "user", "assistant")):
        rows = c.filter((F.col("conv_id") % 2 == k) & (F.col("role") == role)).drop("role")
        tables.write_sample_log(rows, f"{path}/m{k}", role, f"2024-0{k + 1}-02T03-04-05")
    schema = c.drop("role").schema
    back = tables.read_sample_logs(spark, path, schema)
    return back.select("conv_id", "turn", "task", F.regexp_extract("path", "/(m[0-9])/samples_", 1).alias("model"), "target")


@query(
    "S4 S9",
    """select 'model_' || (user_id % 3) as model, event_type as task, 'acc,none' as metric, round(avg(value), 6) as value from events group by 1, 2""",
)
def write_results(spark, sf):
    """One JSON document per model, written, read as the newest result file and taken apart."""
    path = fresh_folder(spark, "results")
    results_json(spark, sf).write.partitionBy("model").text(path)
    files = spark.read.schema("value string, model string").text(path).withColumn("path", F.lit("results_2024.json"))
    out = tables.extract_main_metrics(tables.latest_results(files), ["acc"])
    return out.withColumn("value", F.round("value", 6))


@query("S10", f"select l_orderkey, {MATRIX} from {B.ATTEMPTS_SQL} where attempt <= 16 group by l_orderkey")
def write_attempt_summary(spark, sf):
    path = fresh_folder(spark, "attempts")
    matrix = attempt_matrix(spark, sf)
    sinks.write_attempt_summary(matrix, path)
    return spark.read.schema(matrix.schema).option("header", "true").csv(path)


@query(
    "S11",
    """select p_brand || '_' || p_size as "Model", p_type as "Metric", printf('%.4f', avg(p_retailprice)) as "Value" from part group by 1, 2""",
)
def write_model_summary(spark, sf):
    path = fresh_folder(spark, "models")
    p = B.table(spark, sf, "part").groupBy(F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("model"), F.col("p_type").alias("metric"))
    sinks.write_model_summary(p.agg(F.avg("p_retailprice").alias("value")), path)
    return spark.read.schema("Model string, Metric string, Value string").option("header", "true").csv(path)


@query(
    "S12 N5 J4",
    f"select distinct item_id from {B.bench_ngrams_sql(13)} where ngram in (select ngram from {B.doc_ngrams_sql(13)})",
)
def stored_index_matches(spark, sf):
    """The corpus index is written once, sorted and in buckets; the benchmark is matched with what is read back."""
    path = fresh_folder(spark, "ngram-index")
    texts = small_parts(B.table(spark, sf, "documents").select("doc_id", "text"), "text", TEXT_BYTES)
    grams = N.word_ngrams(texts, ["doc_id"], "text", 13, once=True)
    sinks.write_ngram_index(grams, path, 13, n_buckets=32)
    index, n = sinks.read_ngram_index(spark, path)
    bench = N.word_ngrams(B.table(spark, sf, "benchmark"), ["item_id"], "text", n).distinct()
    return N.match_ngrams(index.select("ngram"), bench).select("item_id").distinct()
