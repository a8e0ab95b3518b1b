"""Readers and loaders: benchmark tables, sample logs, result files, corpora, problem sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tallyframe.functions.columns import all_of, any_of
from tallyframe.operators.ordering import running_totals, scan_index


def lower_keys(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def with_idx(df: DataFrame) -> DataFrame:
    """Add the scan position as ``idx`` where the table has none."""
    return df if "idx" in df.columns else scan_index(df)


def read_eval_table(
    spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType | None = None, ordered: bool = False
) -> DataFrame:
    """A benchmark table with lower-case keys and an ``idx``.

    Give ``schema`` for JSON on a cluster, else the files are read once more to infer
    it. Rows are sorted by ``idx`` only on request.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = with_idx(lower_keys(reader.format(fmt).load(path)))
    return df.orderBy("idx") if ordered else df


def union_subsets(subsets: dict[str, DataFrame], tag: str = "type") -> DataFrame:
    """Concatenate subsets and keep the name of each in ``tag``."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in subsets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def task_from_sample_path(path: Column, prefix: str = "samples_", suffix: str = ".jsonl") -> Column:
    """Task name in a sample file name: up to the first part that begins with four digits."""
    name = F.substring_index(path, "/", -1)
    pattern = "^" + prefix + r"(.*?)(?:_\d{4}.*)?" + suffix.replace(".", r"\.") + "$"
    return F.regexp_extract(name, pattern, 1)


def write_sample_log(df: DataFrame, root: str, task: str, time: str) -> None:
    """JSON lines of one task and run time in a folder ``samples_<task>_<time>.jsonl``, whose parts carry its name."""
    df.write.mode("overwrite").json(f"{root}/samples_{task}_{time}.jsonl")


def read_sample_logs(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All ``samples_<task>_<time>.jsonl`` below ``root`` with their task name; such a log is a file or a folder of parts.

    The filter on the file's own path is applied when files are listed, so other files are not read.
    """
    path = F.col("_metadata.file_path")
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").json(root)
    logs = raw.filter(path.rlike(r"/samples_[^/]*\.jsonl(/[^/]*)?$"))
    logs = logs.select("*", F.regexp_replace(path, r"(\.jsonl)/[^/]*$", "$1").alias("path"))
    return logs.withColumn("task", task_from_sample_path(F.col("path")))


RESULTS = T.StructType([T.StructField("results", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))])


def latest_results(files: DataFrame) -> DataFrame:
    """Metrics of the newest result file per model.

    ``files``: model, path, value (the JSON text). One aggregate picks the newest
    path, so a model with very many files needs no sort.
    """
    newest = files.groupBy("model").agg(F.max_by("value", F.struct(_result_time(F.col("path")), F.col("path"))).alias("value"))
    parsed = newest.select("model", F.from_json("value", RESULTS).alias("r"))
    tasks = parsed.select("model", F.explode("r.results").alias("task", "metrics"))
    return tasks.select("model", "task", F.explode("metrics").alias("metric", "value"))


def _result_time(path: Column) -> Column:
    return F.regexp_extract(path, r"results_([^/]*)\.json$", 1)


def read_latest_results(spark: SparkSession, root: str) -> DataFrame:
    """Newest ``results_<time>.json`` of each model folder below ``root``."""
    files = (
        spark.read.option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "results_*.json")
        .text(root)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    model = F.regexp_extract("path", r"([^/]+)/results_[^/]*\.json$", 1)
    return latest_results(files.withColumn("model", model))


def extract_main_metrics(results: DataFrame, names: list[str]) -> DataFrame:
    """Named metrics without their errors, numeric values only."""
    name = F.col("metric")
    wanted = any_of([(name == n) | name.startswith(n + ",") for n in names])
    return (
        results.filter(wanted & ~name.endswith("stderr"))
        .withColumn("value", F.col("value").try_cast("double"))
        .filter(F.col("value").isNotNull())
    )


def corpus_text(raw: Column, paragraphs: Column | None = None) -> Column:
    """Text as one string; paragraph lists are joined by an empty line."""
    return raw if paragraphs is None else F.coalesce(F.array_join(paragraphs, "\n\n"), raw)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"text": str or list, "meta": {}}`` or plain JSON strings, compressed or not.

    Returns file, text, meta (JSON text, NULL where absent).
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    obj = F.from_json("line", T.StructType([T.StructField("text", T.StringType()), T.StructField("meta", T.StringType())]))
    body = lines.withColumn("o", obj)
    as_list = F.when(F.col("o.text").startswith("["), F.from_json(F.col("o.text"), T.ArrayType(T.StringType())))
    plain = F.when(F.col("line").startswith('"'), F.from_json(F.concat(F.lit("["), "line", F.lit("]")), T.ArrayType(T.StringType()))[0])
    text = F.coalesce(corpus_text(F.col("o.text"), as_list), plain, F.col("line"))
    return body.select("file", text.alias("text"), F.col("o.meta").alias("meta"))


def corpus_stats(df: DataFrame, file: str, text: str) -> DataFrame:
    """Documents and characters per file with the document offset of each file."""
    per = df.groupBy(file).agg(F.count("*").alias("n_docs"), F.sum(F.length(text)).alias("n_chars"))
    return running_totals(per, [file], {"doc_offset": F.col("n_docs")}, before=True)


def combine_shards(shards: list[DataFrame], key: str, expected: int | None = None) -> DataFrame:
    """Union of shard results; overlapping keys or a wrong row count are errors."""
    both = reduce(lambda a, b: a.unionByName(b), shards)
    per = both.groupBy(key).agg(F.count("*").alias("n"))
    check = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("dups")).first()
    if check["dups"]:
        raise ValueError(f"{check['dups']} keys occur in more than one shard")
    if expected is not None and check["rows"] != expected:
        raise ValueError(f"expected {expected} rows, found {check['rows']}")
    return both


TESTS = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("input", "output", "testtype")])
)

# The wording of code-generation prompts.
CODE_PROMPT_HEAD = (
    "You will be given a question (problem specification) and will generate a correct Python program that matches "
    "the specification and passes all tests. You will NOT return anything except for the program.\n\n"
)
WITH_STARTER = (
    "You will use the following starter code to write the solution to the problem and enclose your code within delimiters."
)
WITHOUT_STARTER = (
    "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample "
    "inputs). Enclose your code within delimiters as follows."
)


def convert_problems(df: DataFrame) -> DataFrame:
    """Problem rows to prompt rows with packed tests.

    Needs question_content, starter_code, public_test_cases, private_test_cases and
    metadata (JSON texts). ``sampling_cluster`` is the scan position.
    """
    tests = F.concat(F.from_json("public_test_cases", TESTS), F.from_json("private_test_cases", TESTS))
    fn_name = F.get_json_object("metadata", "$.func_name")
    starter = F.coalesce("starter_code", F.lit("")) != ""
    code = F.when(
        starter, F.concat(F.lit(WITH_STARTER + "\n```python\n"), "starter_code", F.lit("\n```\n\n"))
    ).otherwise(F.lit(WITHOUT_STARTER + "\n```python\n# YOUR CODE HERE\n```\n\n"))
    prompt = F.concat(F.lit(CODE_PROMPT_HEAD), F.lit("Question: "), "question_content", F.lit("\n\n"), code)
    packed = F.to_json(
        F.struct(
            F.transform(tests, lambda t: t["input"]).alias("inputs"),
            F.transform(tests, lambda t: t["output"]).alias("outputs"),
            fn_name.alias("fn_name"),
        )
    )
    rows = df.select(
        *[c for c in ("question_id",) if c in df.columns],
        prompt.alias("prompt"),
        packed.alias("test"),
        F.size(tests).alias("n_tests"),
        F.col("starter_code").alias("entry_point"),
    )
    return scan_index(rows, "sampling_cluster")
