"""Writers and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.columns import argmax
from tallyframe.sources.ngram_store import create_store, open_store


def sample_log_rows(df: DataFrame) -> DataFrame:
    """Log rows with text-only responses and named arguments.

    ``arguments`` (array of argument arrays) becomes ``gen_args_<i>`` / ``arg_<j>`` maps,
    ``resps`` and ``filtered_resps`` are turned into text, ``target`` into a string.
    """

    def named(prefix: str, values: Column) -> Column:
        keyed = F.transform(values, lambda v, i: F.struct(F.concat(F.lit(prefix), i.cast("string")).alias("key"), v.alias("value")))
        return F.map_from_entries(keyed)

    args = F.transform("arguments", lambda a: named("arg_", F.transform(a, lambda x: x.cast("string"))))
    return (
        df.withColumn("arguments", named("gen_args_", args))
        .withColumn("resps", F.transform("resps", lambda r: F.transform(r, lambda x: x.cast("string"))))
        .withColumn("filtered_resps", F.transform("filtered_resps", lambda x: x.cast("string")))
        .withColumn("target", F.col("target").cast("string"))
    )


def write_sample_logs(df: DataFrame, path: str) -> None:
    """JSON lines in one folder per model and task."""
    sample_log_rows(df).write.mode("overwrite").partitionBy("model", "task").json(path)


def results_json(results: DataFrame, config: dict[str, str]) -> DataFrame:
    """One JSON document per model with the metrics and facts of every task.

    ``results``: model, task, metric, filter, value, n, version, n_shot. The pairs of
    one model are as many as its tasks, not its samples, so the grouping is small.
    """
    key = F.concat_ws(",", "metric", "filter")

    def ordered(k: Column, v: Column) -> Column:
        return F.array_sort(F.collect_list(F.struct(k.alias("key"), v.alias("value"))))

    def entries(k: Column, v: Column) -> Column:
        return F.map_from_entries(ordered(k, v))

    per_task = results.groupBy("model", "task").agg(
        ordered(key, F.col("value")).alias("metrics"), *[F.max(c).alias(c) for c in ("n", "version", "n_shot")]
    )
    # maps cannot be ordered, so the metrics become maps after the tasks are in order
    tasks = F.transform(ordered(F.col("task"), F.col("metrics")), lambda t: F.struct(t["key"], F.map_from_entries(t["value"])))
    per_model = per_task.groupBy("model").agg(
        F.map_from_entries(tasks).alias("results"),
        entries(F.col("task"), F.col("n")).alias("n-samples"),
        entries(F.col("task"), F.col("version")).alias("versions"),
        entries(F.col("task"), F.col("n_shot")).alias("n-shot"),
    )
    fixed = F.map_from_arrays(F.array(*map(F.lit, config)), F.array(*map(F.lit, config.values())))
    doc = F.struct("results", "`n-samples`", "versions", "`n-shot`", fixed.alias("config"))
    return per_model.select("model", F.to_json(doc).alias("value"))


def write_results(results: DataFrame, path: str, config: dict[str, str]) -> None:
    results_json(results, config).write.mode("overwrite").partitionBy("model").text(path)


def write_ngram_index(index: DataFrame, path: str, n: int, n_buckets: int = 500) -> None:
    """Hash-bucketed, sorted, compressed n-gram records and a small info file: a store of one batch."""
    id_type = index.schema["doc_id"].dataType.simpleString()
    create_store(index.sparkSession, path, n, n_buckets, id_type).append(index, "all")


def read_ngram_index(spark, path: str) -> tuple[DataFrame, int]:
    store = open_store(spark, path)
    return store.read(), store.n


def write_attempt_summary(matrix: DataFrame, path: str) -> None:
    """CSV ``task, sample_id, attempt_1 .. attempt_16``."""
    matrix.write.mode("overwrite").option("header", "true").csv(path)


def model_order(model: Column) -> tuple[Column, Column]:
    """Sort keys: name before a trailing ``_<number>``, then the number (none sorts last)."""
    num = F.regexp_extract(model, r"^.+?_(\d+)$", 1).try_cast("long")
    prefix = F.when(num.isNotNull(), F.regexp_extract(model, r"^(.+?)_\d+$", 1)).otherwise(model)
    return prefix, num


def model_summary(results: DataFrame) -> DataFrame:
    """Model, Metric, Value at four decimals, ordered by model prefix, number and metric."""
    prefix, num = model_order(F.col("model"))
    rows = results.select(
        F.col("model").alias("Model"), F.col("metric").alias("Metric"), F.format_string("%.4f", "value").alias("Value"),
        prefix.alias("_p"), num.alias("_n"),
    )
    return rows.orderBy("_p", F.col("_n").asc_nulls_last(), "Metric").drop("_p", "_n")


def write_model_summary(results: DataFrame, path: str) -> None:
    model_summary(results).write.mode("overwrite").option("header", "true").csv(path)


def results_table(results: DataFrame) -> DataFrame:
    """Printed result rows: metric keys ``name,filter`` with their ``name_stderr,filter`` partner.

    Needs task, metric_key, value, version, n_shot, higher_is_better.
    """
    split = results.withColumn("metric", F.split_part("metric_key", F.lit(","), F.lit(1))).withColumn(
        "filter", F.substring_index("metric_key", ",", -1)
    )
    is_err = F.col("metric").endswith("_stderr")
    err = split.filter(is_err).select(
        "task", "filter", F.regexp_replace("metric", "_stderr$", "").alias("metric"), F.col("value").alias("stderr")
    )
    rows = split.filter(~is_err).join(err, ["task", "filter", "metric"], "left")
    arrow = F.when(F.col("higher_is_better"), "↑").when(~F.col("higher_is_better"), "↓").otherwise("")
    four = lambda c: F.format_string("%.4f", c)
    return rows.select(
        F.col("task").alias("Task"),
        F.col("version").alias("Version"),
        F.col("filter").alias("Filter"),
        F.col("n_shot").alias("n-shot"),
        F.col("metric").alias("Metric"),
        arrow.alias("Direction"),
        four(F.col("value")).alias("Value"),
        F.when(F.col("stderr").isNotNull(), "±").otherwise("").alias("PM"),
        F.when(F.col("stderr").isNotNull(), four(F.col("stderr"))).otherwise("").alias("Stderr"),
    )


def samples_to_report(df: DataFrame) -> DataFrame:
    """Flat report rows per output type.

    Needs doc_id, target, output_type, context, continuation, choices (texts), lls,
    is_greedy, resp, filtered_resp.
    """
    kind = F.col("output_type")
    greedy = F.when(F.get("is_greedy", F.lit(0)), "be").otherwise("not be")
    ll_text = F.concat(
        F.lit("log probability of continuation is "), F.get("lls", F.lit(0)).cast("string"),
        F.lit("\n\ncontinuation will "), greedy, F.lit(" generated with greedy sampling"),
    )
    best = argmax(F.col("lls")).cast("string")
    raw = F.when(kind == "loglikelihood", ll_text).when(kind == "multiple_choice", best).otherwise(F.col("resp"))
    filtered = F.when(kind == "loglikelihood", ll_text).when(kind == "multiple_choice", best).otherwise(F.col("filtered_resp"))
    numbered = F.array_join(F.transform("choices", lambda c, i: F.concat(i.cast("string"), F.lit(". "), c)), "\n")
    return df.select(
        F.col("doc_id").alias("id"),
        F.col("context").alias("data"),
        F.when(kind == "multiple_choice", numbered).alias("choices"),
        F.length("context").alias("input_len"),
        F.when(kind == "loglikelihood", F.col("continuation")).otherwise(F.col("target")).alias("labels"),
        kind.alias("output_type"),
        raw.alias("raw_predictions"),
        filtered.alias("filtered_predictions"),
    )
