"""Question groups of reading comprehension: several references, and no-answer thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.text import normalize_answer, token_f1
from tallyframe.operators.ordering import running_totals


def group_exact_match(df: DataFrame, group: str, pred: str, ref: str) -> DataFrame:
    """Mean over the predictions of all groups of the best match with a reference of the group.

    Predictions are counted per distinct text and matched with the distinct references
    by equality, so no pairs within a group are built.
    """
    norm = df.select(group, normalize_answer(F.col(pred)).alias("p"), normalize_answer(F.col(ref)).alias("r"))
    refs = norm.select(group, F.col("r").alias("p")).distinct().withColumn("_hit", F.lit(1))
    preds = norm.groupBy(group, "p").agg(F.count("*").alias("n"))
    joined = preds.join(refs, [group, "p"], "left")
    return joined.agg((F.sum(F.col("n") * F.coalesce("_hit", F.lit(0))) / F.sum("n")).alias("em"))


def group_f1(df: DataFrame, group: str, order: Column, pred: str, ref: str) -> DataFrame:
    """Mean over groups of the first prediction's F1 with the first reference.

    A group is opened by its first row and later rows of the group do not add to it.
    """
    first = df.groupBy(group).agg(F.min_by(F.struct(F.col(pred).alias("p"), F.col(ref).alias("r")), order).alias("x"))
    return first.agg(F.avg(token_f1(F.col("x.p"), F.col("x.r"))).alias("f1"))


def no_answer_scores(df: DataFrame) -> DataFrame:
    """Exact match and F1 over all, answerable and unanswerable questions, in percent.

    Needs id, exact, f1 (raw scores of the given answer), has_answer and na_prob. For a
    question without an answer the raw score is 1 for an empty prediction.
    """
    has = F.col("has_answer")
    pct = lambda c, cond=None: 100 * F.avg(F.when(cond, F.col(c)) if cond is not None else F.col(c))
    return df.agg(
        pct("exact").alias("exact"), pct("f1").alias("f1"),
        pct("exact", has).alias("HasAns_exact"), pct("f1", has).alias("HasAns_f1"),
        pct("exact", ~has).alias("NoAns_exact"), pct("f1", ~has).alias("NoAns_f1"),
    )


def best_threshold(df: DataFrame, score: str) -> DataFrame:
    """Best achievable score when the answer is withheld above a no-answer probability.

    Start with every answer withheld (all unanswerable questions right) and admit
    questions by rising probability: an answerable one adds its score, an unanswerable
    one with a given answer costs one. Questions of equal probability are ordered by id.
    """
    gain = F.when(F.col("has_answer"), F.col(score)).otherwise(F.when(F.col("answered"), F.lit(-1.0)).otherwise(0.0))
    running = running_totals(df.withColumn("_gain", gain), ["na_prob", "id"], {"_run": F.col("_gain")})
    return running.agg(
        (100.0 * (F.count_if(~F.col("has_answer")) + F.greatest(F.max("_run"), F.lit(0.0))) / F.count("*")).alias(f"best_{score}")
    )
