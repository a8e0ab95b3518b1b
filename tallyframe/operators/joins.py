"""Joins between samples, problems, runs, caches and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def join_solutions(samples: DataFrame, problems: DataFrame, key: str) -> DataFrame:
    """Samples with their problem; samples of unknown problems fall away."""
    return samples.join(problems, key)


def unknown_samples(samples: DataFrame, problems: DataFrame, key: str) -> DataFrame:
    return samples.join(problems.select(key).distinct(), key, "left_anti")


def missing_problems(samples: DataFrame, problems: DataFrame, key: str) -> DataFrame:
    return problems.join(samples.select(key).distinct(), key, "left_anti")


def completeness(samples: DataFrame, problems: DataFrame, key: str, expected: int) -> DataFrame:
    """Samples per problem against the expected number."""
    n = samples.groupBy(key).agg(F.count("*").alias("n"))
    joined = problems.select(key).join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("complete", F.col("n") >= expected)


def merge_seed_runs(runs: DataFrame, keys: list[str], seed: str, seeds: list, answer: str, gold: str) -> DataFrame:
    """One row per question with the answer of every seed side by side."""
    cols = [F.max(F.when(F.col(seed) == s, F.col(answer))).alias(f"answer_{s}") for s in seeds]
    return runs.groupBy(*keys).agg(F.max(gold).alias("gold"), *cols)


def seed_accuracy(runs: DataFrame, seed: str, category: str, answer: str, gold: str) -> DataFrame:
    """Accuracy per seed, averaged over categories."""
    per = runs.groupBy(seed, category).agg(F.avg((F.col(answer) == F.col(gold)).cast("double")).alias("a"))
    return per.groupBy(seed).agg(F.round(F.avg("a"), 4).alias("accuracy"))


# Coefficients of a Chebyshev fit of the complementary error function
# with relative error below 1.2e-7 (published numerical tables).
ERFC = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def erfc(x: Column) -> Column:
    """Complementary error function of a non-negative column."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def compare_runs(a: DataFrame, b: DataFrame, task: str, alpha: float = 0.05) -> DataFrame:
    """Two results per task: Z score, two-tailed p value, and whether they agree at ``alpha``."""
    left = a.select(task, F.col("value").alias("value_a"), F.col("stderr").alias("stderr_a"))
    right = b.select(task, F.col("value").alias("value_b"), F.col("stderr").alias("stderr_b"))
    se = F.sqrt(F.col("stderr_a") * F.col("stderr_a") + F.col("stderr_b") * F.col("stderr_b"))
    z = (F.col("value_a") - F.col("value_b")) / F.nullif(se, F.lit(0.0))
    joined = left.join(right, task).withColumn("z", z)
    p = erfc(F.abs("z") / F.sqrt(F.lit(2.0)))
    return joined.withColumn("p_value", p).withColumn("same", F.col("p_value") > alpha)


def diff_runs(a: DataFrame, b: DataFrame, task: str) -> DataFrame:
    """Difference in percentage points with its sign, as printed."""
    joined = a.select(task, F.col("value").alias("value_a")).join(b.select(task, F.col("value").alias("value_b")), task)
    d = 100 * F.col("value_b") - 100 * F.col("value_a")
    text = F.when(d > 0, F.format_string("**+%.2f**", d)).otherwise(F.format_string("%.2f", d))
    return joined.withColumn("diff", text)


def request_key(method: Column, *args: Column) -> Column:
    return F.sha2(F.to_json(F.array(method, *[a.cast("string") for a in args])), 256)


def cache_hits(requests: DataFrame, cache: DataFrame, sampled: Column) -> DataFrame:
    """Requests with a stored response; sampled generations are never served."""
    return requests.filter(~sampled).join(cache.select("key", "response"), "key")


def cache_misses(requests: DataFrame, cache: DataFrame, sampled: Column) -> DataFrame:
    fixed = requests.filter(~sampled).join(cache.select("key"), "key", "left_anti")
    return fixed.unionByName(requests.filter(sampled))


def resume_remaining(examples: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Examples that have no result yet."""
    return examples.join(done.select(*keys).distinct(), keys, "left_anti")


def append_results(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new results, the newest per key."""
    from tallyframe.operators.selection import keep_last

    both = old.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)))
    return keep_last(both, keys, F.col("_run")).drop("_run")


def fix_answers(docs: DataFrame, corrections: DataFrame, key: str, answer: str) -> DataFrame:
    """Answers overridden by a correction table; Spark broadcasts it where its size allows."""
    fixed = corrections.select(key, F.col("answer").alias("_fixed"))
    return docs.join(fixed, key, "left").withColumn(answer, F.coalesce("_fixed", F.col(answer))).drop("_fixed")
