"""Scores from log-likelihoods of continuations and choices."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyframe.functions.columns import argmax, array_sum, let


def count_words(text: Column) -> Column:
    """Pieces between whitespace runs; empty end pieces count, as in the rolling metrics."""
    return F.size(F.split(text, r"\s+"))


def count_bytes(text: Column) -> Column:
    return F.octet_length(text)


def softmax(lls: Column) -> Column:
    return let(
        F.struct(lls.alias("l"), F.array_max(lls).alias("m")),
        lambda s: let(
            F.transform(s["l"], lambda x: F.exp(x - s["m"])),
            lambda e: F.transform(e, lambda x: x / array_sum(e)),
        ),
    )


def ll_score(result: Column) -> Column:
    """struct(ll, is_greedy) to struct(perplexity, acc)."""
    return F.struct(result["ll"].alias("perplexity"), result["is_greedy"].cast("int").alias("acc"))


def rolling_score(ll: Column, text: Column) -> Column:
    return F.struct(ll.alias("ll"), count_words(text).alias("words"), count_bytes(text).alias("bytes"))


def choice_scores(lls: Column, greedy: Column, choices: Column, gold: Column) -> Column:
    """acc, acc_norm, exact_match and probabilities for one gold index.

    A gold index out of range is wrong in every metric.
    """
    lengths = F.transform(choices, lambda c: F.length(c).cast("double"))
    valid = (gold >= 0) & (gold < F.size(choices))
    hit = lambda pred: (valid & (pred == gold)).cast("double")
    pred = argmax(lls)
    pred_norm = argmax(F.zip_with(lls, lengths, lambda l, n: l / n))
    exact = F.when(valid, F.get(greedy, gold).cast("int")).otherwise(0)
    return F.struct(
        pred.alias("pred"),
        hit(pred).alias("acc"),
        hit(pred_norm).alias("acc_norm"),
        exact.alias("exact_match"),
        softmax(lls).alias("probs"),
    )


def multi_gold_scores(lls: Column, greedy: Column, choices: Column, golds: Column) -> Column:
    """As ``choice_scores`` with several right indexes."""
    lengths = F.transform(choices, lambda c: F.length(c).cast("double"))
    valid = F.filter(golds, lambda g: (g >= 0) & (g < F.size(choices)))
    pred = argmax(lls)
    pred_norm = argmax(F.zip_with(lls, lengths, lambda l, n: l / n))
    return F.struct(
        F.array_contains(valid, pred).cast("double").alias("acc"),
        F.array_contains(valid, pred_norm).cast("double").alias("acc_norm"),
        F.exists(valid, lambda g: F.get(greedy, g)).cast("int").alias("exact_match"),
    )


def mutual_info_acc(conditional: Column, unconditional: Column, gold: Column) -> Column:
    return (argmax(F.zip_with(conditional, unconditional, lambda c, u: c - u)) == gold).cast("double")


def prob_mass_true(lls: Column, labels: Column) -> Column:
    """Share of probability mass on the choices labelled 1."""
    e = F.transform(lls, F.exp)
    return array_sum(F.zip_with(e, labels, lambda p, l: F.when(l == 1, p).otherwise(0.0))) / array_sum(e)


def rank_metrics(scores: Column, gold: Column) -> Column:
    """r@1, r@2 and reciprocal rank of the gold entry."""
    first = (argmax(scores) == gold).cast("int")
    rank = F.array_position(F.sort_array(scores, asc=False), F.get(scores, gold)).cast("int")
    return F.struct(
        first.alias("r_at_1"), ((rank == 2).cast("int") + first).alias("r_at_2"), (1.0 / rank).alias("mrr")
    )


def pair_preference(more: Column, less: Column) -> Column:
    """Stereotype pair: absolute difference, and 1 if the first is likelier."""
    return F.struct(F.abs(more - less).alias("likelihood_diff"), (more > less).cast("double").alias("pct_stereotype"))


def gender_preference(lls: Column) -> Column:
    """Four likelihoods (female, woman, male, man): log-sum difference and male preference."""
    log_sum = lambda i: F.log(F.exp(F.get(lls, F.lit(i))) + F.exp(F.get(lls, F.lit(i + 1))))
    return F.struct(
        (log_sum(0) - log_sum(2)).alias("likelihood_diff"),
        (argmax(lls) > 1).cast("double").alias("pct_male_preferred"),
    )


def generated_gender(responses: Column) -> Column:
    """Words produced in a response list: which gender occurs at all."""
    male = F.exists(responses, lambda r: r.isin("male", "man")).cast("int")
    female = F.exists(responses, lambda r: r.isin("female", "woman")).cast("int")
    return F.struct(
        (male - female).alias("difference_male_female"),
        (male > female).cast("int").alias("pct_male_preferred"),
        ((male <= female) & (female > 0)).cast("int").alias("pct_female_preferred"),
        (male + female == 0).cast("int").alias("pct_invalid"),
    )


def entity_pick(lls: Column, entities: Column) -> Column:
    """The entity with the largest likelihood."""
    return F.get(entities, argmax(lls))
