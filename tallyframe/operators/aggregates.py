"""Metric aggregates: plain aggregate columns first, then the ones that need a small plan.

Everything here is a partial + final hash aggregate, so a hot task or class only
moves its partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.columns import array_sum

# ---------------------------------------------------------------- aggregate columns


def mean(x) -> Column:
    return F.avg(x)


def nanmean(x) -> Column:
    """Mean without NaN entries; NULL where nothing is left."""
    x = F.col(x) if isinstance(x, str) else x
    return F.avg(F.when(~F.isnan(x), x))


def harmonic(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.count(x) / F.sum(1.0 / (x + 0.01))


def perplexity(ll) -> Column:
    return F.exp(-F.avg(ll))


def weighted_perplexity(ll, weight) -> Column:
    return F.exp(-F.sum(ll) / F.sum(weight))


def bits_per_byte(ll, n_bytes) -> Column:
    return -(F.sum(ll) / F.sum(n_bytes)) / F.log(F.lit(2.0))


def sample_stddev(x) -> Column:
    return F.stddev_samp(x)


def pop_stddev(x) -> Column:
    return F.stddev_pop(x)


def mean_stderr(x) -> Column:
    """Standard error of the mean; NULL below two values."""
    return F.when(F.count(x) > 1, F.stddev_samp(x) / F.sqrt(F.count(x)))


def binary_f1(gold, pred) -> Column:
    """F1 of class 1; 0 where it is undefined."""
    g = (F.col(gold) if isinstance(gold, str) else gold) == 1
    p = (F.col(pred) if isinstance(pred, str) else pred) == 1
    tp, wrong = F.count_if(g & p), F.count_if(g != p)
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + wrong), F.lit(0.0))


def brier(probs: Column, gold: Column) -> Column:
    """Mean over rows of the squared distance to the one-hot gold vector."""
    row = array_sum(F.transform(probs, lambda p, i: F.pow(p - F.when(i == gold, 1.0).otherwise(0.0), 2.0)))
    return F.avg(row)


def flag_mean(flags: Column) -> Column:
    """Share of true entries over all flag arrays together."""
    return F.sum(F.size(F.filter(flags, lambda f: f))) / F.sum(F.size(flags))


def score_ratio(scores: Column) -> Column:
    return F.sum(array_sum(scores)) / F.sum(F.size(scores))


# ---------------------------------------------------------------- confusion counts


def confusion(df: DataFrame, gold: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Cell counts; every class metric is computed from these few rows."""
    return df.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_counts(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per class: true positives, gold total, predicted total."""
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = cells.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("gold").alias("cls"), hit.alias("tp"), F.col("n").alias("t"), zero.alias("p")),
                F.struct(F.col("pred").alias("cls"), zero.alias("tp"), zero.alias("t"), F.col("n").alias("p")),
            )
        ),
    )
    return sides.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))


def _f1(tp: Column, t: Column, p: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, t + p), F.lit(0.0))


def class_f1(df: DataFrame, gold: str, pred: str, by: list[str] = ()) -> DataFrame:
    counts = class_counts(confusion(df, gold, pred, by), by)
    return counts.withColumn("f1", _f1(F.col("tp"), F.col("t"), F.col("p")))


def f1_averages(df: DataFrame, gold: str, pred: str, by: list[str] = (), labels: list | None = None) -> DataFrame:
    """Macro, micro and support-weighted F1, optionally over a class subset."""
    per = class_f1(df, gold, pred, by)
    if labels is not None:
        per = per.filter(F.col("cls").isin(labels))
    n_classes = F.lit(len(labels)) if labels is not None else F.count("*")
    return per.groupBy(*by).agg(
        (F.sum("f1") / n_classes).alias("f1_macro"),
        _f1(F.sum("tp"), F.sum("t"), F.sum("p")).alias("f1_micro"),
        (F.sum(F.col("f1") * F.col("t")) / F.sum("t")).alias("f1_weighted"),
    )


def f1_without_last_class(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Macro F1 over all classes but the largest label (the "other" class of entity tagging)."""
    per = class_f1(df, gold, pred)
    last, n = F.max_by("f1", "cls"), F.count("*")
    return per.agg(F.when(n > 1, (F.sum("f1") - last) / (n - 1)).otherwise(F.max("f1")).alias("f1"))


def matthews(df: DataFrame, gold: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Multi-class correlation coefficient from the confusion cells; 0 where undefined."""
    counts = class_counts(confusion(df, gold, pred, by), by)
    sums = counts.groupBy(*by).agg(
        F.sum("tp").cast("double").alias("c"),
        F.sum("t").cast("double").alias("s"),
        F.sum(F.col("t").cast("double") * F.col("p")).alias("tp"),
        F.sum(F.col("t").cast("double") * F.col("t")).alias("tt"),
        F.sum(F.col("p").cast("double") * F.col("p")).alias("pp"),
    )
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    value = (F.col("c") * F.col("s") - F.col("tp")) / den
    return sums.select(*by, F.when(den == 0, 0.0).otherwise(value).alias("mcc"))


def two_axis_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Four-way sentiment (0 pos, 1 neg, 2 neutral, 3 mixed) scored on two yes/no axes."""
    cells = confusion(df, gold, pred)

    def axis(c: str, positive: list[int]) -> Column:
        return F.col(c).isin(positive).cast("int")

    def f1(axis_gold: Column, axis_pred: Column, cls: int) -> Column:
        n = F.col("n")
        tp = F.sum(F.when((axis_gold == cls) & (axis_pred == cls), n).otherwise(0))
        t = F.sum(F.when(axis_gold == cls, n).otherwise(0))
        p = F.sum(F.when(axis_pred == cls, n).otherwise(0))
        return _f1(tp, t, p)

    parts = []
    for positive in ([0, 3], [1, 3]):
        for cls in (0, 1):
            parts.append(f1(axis("gold", positive), axis("pred", positive), cls))
    return cells.filter(F.col("gold").between(0, 3) & F.col("pred").between(0, 3)).agg(
        ((parts[0] + parts[1]) / 2 / 2 + (parts[2] + parts[3]) / 2 / 2).alias("f1")
    )


# ---------------------------------------------------------------- grouped questions


def all_answers_right(df: DataFrame, keys: list[str], correct: Column) -> DataFrame:
    """One row per question: 1 if every answer of it is right."""
    return df.groupBy(*keys).agg(F.min(correct.cast("int")).alias("all_right"))


def acc_all(df: DataFrame, paragraph: str, question: str, correct: Column) -> DataFrame:
    """Mean over (paragraph, question), with the stderr over questions alone."""
    per_pair = all_answers_right(df, [paragraph, question], correct)
    right = F.col("all_right").cast("double")
    per_question = per_pair.groupBy(question).agg(F.sum(right).alias("_right"), F.count("all_right").alias("_n"), F.min(right).alias("_all"))
    return per_question.agg((F.sum("_right") / F.sum("_n")).alias("acc_all"), mean_stderr("_all").alias("acc_all_stderr"))


def arrival_median(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """The entry at position n // 2 in arrival order (not the sorted median); one row per group, a null group included."""
    from tallyframe.operators.ordering import group_index

    numbered = group_index(df.select(*group, order, value), group, [order], "_rn")
    sizes = numbered.groupBy(*[F.col(c).alias(f"_s_{c}") for c in group]).agg(F.max("_rn").alias("_n"))
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in group]
    middle = numbered.join(sizes, same).filter(F.col("_rn") - 1 == F.floor(F.col("_n") / 2))
    return middle.select(*group, F.col(value).alias("median"))


def length_bucket_mean(df: DataFrame, length: str, score: str) -> DataFrame:
    """Mean score per context length; rows with -1 do not count."""
    return df.filter(F.col(score) != -1).groupBy(length).agg(F.avg(score).alias("score"))


def lexical_substitution_f1(df: DataFrame, precision: str, answered: str, annotated: str) -> DataFrame:
    total = F.sum(precision)
    p = total / F.greatest(F.sum(answered), F.lit(1))
    r = total / F.greatest(F.sum(annotated), F.lit(1))
    return df.agg(F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


# ---------------------------------------------------------------- bias scores


def bias_scores(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy and bias per context kind.

    Needs ``acc``, ``biased``, ``non_unknown`` (1.0/0.0, NULL = not applicable) and
    ``disambiguated`` (boolean).
    """

    def bias(part: Column) -> Column:
        known = F.count(F.when(part, F.col("non_unknown")))
        biased = F.sum(F.when(part, F.col("biased")))
        total = F.sum(F.when(part, F.col("non_unknown")))
        return F.when(known == 0, F.lit(None)).when(biased == 0, 0.0).otherwise(2.0 * F.try_divide(biased, total) - 1)

    dis, amb = F.col("disambiguated"), ~F.col("disambiguated")
    acc_amb = F.avg(F.when(amb, F.col("acc")))
    return df.groupBy(*by).agg(
        F.avg("acc").alias("acc"),
        acc_amb.alias("accuracy_amb"),
        F.avg(F.when(dis, F.col("acc"))).alias("accuracy_disamb"),
        bias(dis).alias("disamb_bias_score"),
        ((1 - acc_amb) * bias(amb)).alias("amb_bias_score"),
    )
