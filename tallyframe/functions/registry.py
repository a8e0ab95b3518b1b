"""Names for metrics, aggregations and row functions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyframe.functions import text
from tallyframe.operators import aggregates as A


@dataclass(frozen=True)
class Metric:
    """A sample metric: how to score one row, how to aggregate, and which way is better."""

    name: str
    score: Callable[..., Column]
    aggregation: str = "mean"
    higher_is_better: bool = True
    output_types: tuple[str, ...] = ("generate_until",)


AGGREGATIONS: dict[str, Callable[[Column], Column]] = {
    "mean": A.mean,
    "nanmean": A.nanmean,
    "harmonic": A.harmonic,
    "perplexity": A.perplexity,
    "weighted_perplexity": lambda x: A.weighted_perplexity(x["num"], x["den"]),
    "bits_per_byte": lambda x: A.bits_per_byte(x["num"], x["den"]),
    "f1": lambda x: A.binary_f1(x["gold"], x["pred"]),
    "brier_score": lambda x: A.brier(x["probs"], x["gold"]),
}

METRICS: dict[str, Metric] = {}

# Metrics used where a task names none.
DEFAULT_METRICS = {
    "loglikelihood": ["perplexity", "acc"],
    "loglikelihood_rolling": ["word_perplexity", "byte_perplexity", "bits_per_byte"],
    "multiple_choice": ["acc", "acc_norm"],
    "generate_until": ["exact_match"],
}


def register_metric(metric: Metric) -> Metric:
    if metric.name in METRICS:
        raise ValueError(f"metric {metric.name} exists already")
    if metric.aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {metric.aggregation}")
    METRICS[metric.name] = metric
    return metric


def register_aggregation(name: str, builder: Callable[[Column], Column]) -> None:
    """``builder`` turns the metric column into an aggregate column, so it combines on the map side."""
    if name in AGGREGATIONS:
        raise ValueError(f"aggregation {name} exists already")
    AGGREGATIONS[name] = builder


for _m in [
    Metric("exact_match", text.exact_match),
    Metric("token_f1", text.token_f1),
    Metric("contains", lambda pred, ref: F.contains(F.lower(pred), F.lower(ref)).cast("double")),
    Metric("acc", lambda pred, gold: (pred == gold).cast("double"), output_types=("loglikelihood", "multiple_choice")),
    Metric("acc_norm", lambda pred, gold: (pred == gold).cast("double"), output_types=("multiple_choice",)),
    Metric("acc_mutual_info", lambda pred, gold: (pred == gold).cast("double"), output_types=("multiple_choice",)),
    Metric("f1", lambda pred, gold: F.struct(gold.alias("gold"), pred.alias("pred")), "f1", output_types=("multiple_choice",)),
    Metric("brier_score", lambda pred, gold: F.struct(gold.alias("gold"), pred.alias("probs")), "brier_score", False, ("multiple_choice",)),
    Metric("perplexity", lambda ll, _=None: ll, "perplexity", False, ("loglikelihood",)),
    Metric("word_perplexity", lambda ll, n: F.struct(ll.alias("num"), n.alias("den")), "weighted_perplexity", False, ("loglikelihood_rolling",)),
    Metric("byte_perplexity", lambda ll, n: F.struct(ll.alias("num"), n.alias("den")), "weighted_perplexity", False, ("loglikelihood_rolling",)),
    Metric("bits_per_byte", lambda ll, n: F.struct(ll.alias("num"), n.alias("den")), "bits_per_byte", False, ("loglikelihood_rolling",)),
]:
    register_metric(_m)


def score_samples(df: DataFrame, metrics: list[str], pred: Column, ref: Column) -> DataFrame:
    """One column per metric."""
    return df.select("*", *[METRICS[m].score(pred, ref).alias(m) for m in metrics])


def aggregate_samples(scored: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Long result rows: by, metric, value, stderr (for means), n (scored rows), higher_is_better; one pass."""
    aggs = []
    for m in metrics:
        spec = METRICS[m]
        aggs.append(AGGREGATIONS[spec.aggregation](F.col(m)).cast("double").alias(f"{m}__value"))
        aggs.append(F.count(m).alias(f"{m}__n"))
        err = A.mean_stderr(F.col(m)) if spec.aggregation == "mean" else F.lit(None)
        aggs.append((err if spec.aggregation == "mean" else F.max(err)).cast("double").alias(f"{m}__stderr"))
    wide = scored.groupBy(*by).agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.col(f"{m}__n").alias("n"), F.lit(m).alias("metric"), F.col(f"{m}__value").alias("value"), F.col(f"{m}__stderr").alias("stderr"),
            F.lit(METRICS[m].higher_is_better).alias("higher_is_better"),
        )
        for m in metrics
    ])
    return wide.select(*by, F.inline(rows))


def map_rows(df: DataFrame, fn: Callable[[dict], dict | list[dict]], schema: str) -> DataFrame:
    """A user's row function on Arrow batches; a list result gives several rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_dict("records"):
                got = fn(row)
                out.extend(got if isinstance(got, list) else [got])
            if out:
                yield pd.DataFrame(out)

    return df.mapInPandas(run, schema)


SQL_FUNCTIONS = {
    "eval_pass_at_k(n BIGINT, c BIGINT, k INT)": (
        "DOUBLE",
        "CASE WHEN n - c < k THEN 1D ELSE 1D - aggregate(sequence(0, k - 1), 1D, (a, j) -> a * (n - c - j) / (n - j)) END",
    ),
    "eval_f1(tp BIGINT, t BIGINT, p BIGINT)": ("DOUBLE", "coalesce(try_divide(2D * tp, t + p), 0D)"),
    "eval_numeric_equal(a DOUBLE, b DOUBLE)": ("BOOLEAN", "abs(a - b) <= 1e-4 * greatest(abs(a), abs(b))"),
}


def register_sql_functions(spark: SparkSession) -> None:
    """Metric functions for use in SQL text; Spark inlines them into the plan."""
    for signature, (kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
