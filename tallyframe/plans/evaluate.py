"""Responses to results in one plan: filter pipelines, metrics, errors, group roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions import likelihood as L
from tallyframe.functions.filters import apply_filters
from tallyframe.functions.registry import DEFAULT_METRICS, aggregate_samples, score_samples


def evaluate_generation(
    responses: DataFrame, target: str, filters: dict[str, list[tuple[str, dict]]], metrics: list[str], task: str = "task"
) -> DataFrame:
    """Result rows per task, filter and metric.

    ``responses``: task, resps (array of texts) and a target column. The first filtered
    response of a document is scored. Filtering and scoring stay inside the row, so the
    only shuffle carries partial sums.
    """
    filtered = apply_filters(responses, "resps", filters)
    scored = score_samples(filtered, metrics, F.get("filtered_resps", F.lit(0)), F.col(target))
    return aggregate_samples(scored, metrics, [task, "filter"])


def evaluate_loglikelihood(
    requests: DataFrame, responses: DataFrame, keys: list[str], metrics: list[str] = DEFAULT_METRICS["loglikelihood"], task: str = "task"
) -> DataFrame:
    """Result rows per task and metric for one continuation per document.

    ``requests``: task and ``keys``; ``responses``: ``keys``, ll, is_greedy. A request without a response is counted as
    wrong in ``acc`` and left out of ``perplexity``, whose n tells so.
    """
    both = requests.select(task, *keys).join(responses.select(*keys, "ll", "is_greedy"), keys, "left")
    scored = both.select(
        task, F.col("ll").alias("perplexity"), F.coalesce(F.col("is_greedy").cast("double"), F.lit(0.0)).alias("acc")
    )
    return aggregate_samples(scored, metrics, [task])


def evaluate_multiple_choice(
    responses: DataFrame, golds: DataFrame, doc: str, metrics: list[str] = DEFAULT_METRICS["multiple_choice"], task: str = "task"
) -> DataFrame:
    """Result rows per task and metric for documents with one likelihood row per choice.

    ``responses``: doc, idx (from 0), choice, ll, is_greedy; ``golds``: task, doc, gold. The rows of a document, as many
    as its choices, meet in one row; everything after is a partial sum. Documents without responses count as wrong.
    """
    choice = F.struct("idx", F.col("ll").cast("double").alias("ll"), "is_greedy", "choice")
    listed = responses.groupBy(doc).agg(F.sort_array(F.collect_list(choice)).alias("_c"))
    part = lambda name: F.transform("_c", lambda c: c[name])
    scores = L.choice_scores(part("ll"), part("is_greedy"), part("choice"), F.col("gold"))
    scored = golds.select(task, doc, "gold").join(listed, doc, "left").withColumn("_s", F.when(F.col("_c").isNotNull(), scores))
    values = {
        "acc": F.coalesce("_s.acc", F.lit(0.0)), "acc_norm": F.coalesce("_s.acc_norm", F.lit(0.0)),
        "exact_match": F.coalesce(F.col("_s.exact_match").cast("double"), F.lit(0.0)),
        "brier_score": F.when(F.col("_s").isNotNull(), F.struct("gold", F.col("_s.probs").alias("probs"))),
    }
    return aggregate_samples(scored.select(task, *[values[m].alias(m) for m in metrics]), metrics, [task])


def evaluate_rolling(
    windows: DataFrame, docs: DataFrame, doc: str, text: str, metrics: list[str] = DEFAULT_METRICS["loglikelihood_rolling"], task: str = "task"
) -> DataFrame:
    """Result rows per task and metric for texts whose likelihood comes in windows.

    ``windows``: doc, ll; ``docs``: task, doc and the whole text. Window sums join the texts' counts, not the texts.
    """
    sums = windows.groupBy(doc).agg(F.sum("ll").alias("_ll"))
    counts = docs.select(task, doc, L.count_words(F.col(text)).alias("_words"), L.count_bytes(F.col(text)).alias("_bytes"))
    both = counts.join(sums, doc)
    value = lambda den: F.struct(F.col("_ll").alias("num"), F.col(den).alias("den"))
    values = {"word_perplexity": value("_words"), "byte_perplexity": value("_bytes"), "bits_per_byte": value("_bytes")}
    return aggregate_samples(both.select(task, *[values[m].alias(m) for m in metrics]), metrics, [task])
