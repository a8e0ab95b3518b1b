"""Several attempts per problem: pass@k, majority, best-of-k, consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.operators.ordering import first_k


def pass_at_k_value(n: Column, c: Column, k: int) -> Column:
    """Chance that at least one of k draws out of n attempts is among the c right ones.

    One minus C(n-c, k) / C(n, k), written as k factors; the number of factors does
    not depend on how many attempts a problem has.
    """
    miss = reduce(lambda a, b: a * b, [(n - c - j) / (n - j) for j in range(k)])
    return F.when(n - c < k, 1.0).otherwise(1.0 - miss)


def attempt_counts(df: DataFrame, keys: list[str], correct: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(correct).alias("c"))


def pass_at_k(df: DataFrame, problem: str, correct: Column, ks: list[int], by: list[str] = ()) -> DataFrame:
    """Mean over problems that have at least k attempts, one column per k."""
    n, c = F.col("n"), F.col("c")
    counts = attempt_counts(df, [*by, problem], correct)
    return counts.groupBy(*by).agg(
        *[F.avg(F.when(n >= k, pass_at_k_value(n, c, k))).alias(f"pass_at_{k}") for k in ks]
    )


def pass_at_k_padded(df: DataFrame, problem: str, order: list[Column], correct: Column, ks, width: int = 16):
    """Report form: exactly ``width`` attempts per problem, a missing one is wrong."""
    kept = first_k(df.withColumn("_ok", correct), [problem], order, width, "_rn")
    counts = kept.groupBy(problem).agg(F.count_if("_ok").alias("c"))
    n = F.lit(width)
    return counts.agg(*[F.avg(pass_at_k_value(n, F.col("c"), k)).alias(f"pass_at_{k}") for k in ks])


def attempt_matrix(df: DataFrame, keys: list[str], attempt: str, correct: str, width: int = 16) -> DataFrame:
    """Wide 0/1 columns ``attempt_1`` .. ``attempt_<width>``; missing attempts are 0."""
    cell = F.col(correct).cast("int")
    cols = [
        F.coalesce(F.max(F.when(F.col(attempt) == i, cell)), F.lit(0)).alias(f"attempt_{i}")
        for i in range(1, width + 1)
    ]
    return df.groupBy(*keys).agg(*cols)


def pass_any_k(df: DataFrame, problem: str, order: list[Column], correct: Column, k: int) -> DataFrame:
    """Share of problems with a right answer among the first k attempts."""
    kept = first_k(df.withColumn("_ok", correct), [problem], order, k, "_rn")
    per = kept.groupBy(problem).agg(F.max(F.col("_ok").cast("int")).alias("hit"))
    return per.agg(F.avg("hit").alias(f"pass_any_{k}"), F.round(F.avg("hit") * 100, 1).alias("acc_pass"))


def majority_votes(df: DataFrame, keys: list[str], answer: str, seen: Column) -> DataFrame:
    """Most frequent answer per key; the one seen first wins a tie."""
    votes = df.groupBy(*keys, answer).agg(F.count("*").alias("votes"), F.min(seen).alias("first_seen"))
    best = F.min_by(
        F.struct(F.col(answer).alias("answer"), F.col("votes"), F.col("first_seen")),
        F.struct(-F.col("votes"), F.col("first_seen")),
    )
    return votes.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def majority_at_k(df: DataFrame, problem: str, order: list[str], answer: str, score: str, k: int) -> DataFrame:
    """Accuracy of the first member of the winning answer among the first k attempts."""
    kept = first_k(df, [problem], [F.col(c) for c in order], k, "_rn")
    votes = kept.groupBy(problem, answer).agg(
        F.count("*").alias("v"), F.min(F.struct("_rn", score)).alias("head")
    )
    win = votes.groupBy(problem).agg(
        F.min_by(F.col(f"head.{score}"), F.struct(-F.col("v"), F.col("head._rn"))).alias("s")
    )
    return win.agg(F.avg(F.col("s").cast("double")).alias(f"maj_at_{k}"))


def best_of_k_by_reward(df: DataFrame, problem: str, order: list[str], reward: str, score: str, k: int) -> DataFrame:
    """Score of the attempt with the highest reward, the earlier one on a tie."""
    kept = first_k(df, [problem], [F.col(c) for c in order], k, "_rn")
    best = kept.groupBy(problem).agg(F.max_by(score, F.struct(F.col(reward), -F.col("_rn"))).alias("s"))
    return best.agg(F.avg(F.col("s").cast("double")).alias(f"rm_at_{k}"))


def attempt_matrix_mean(df: DataFrame, problem: str, order: Column, score: Column, pred: Column) -> DataFrame:
    """Mean score with short rows padded by their last score; percentages at one decimal."""
    per = df.groupBy(problem).agg(
        F.count("*").alias("n"),
        F.sum(score.cast("double")).alias("s"),
        F.max_by(score.cast("double"), order).alias("last"),
        F.max_by(pred, order).alias("last_pred"),
        F.max(score.cast("int")).alias("any_right"),
    )
    m = per.agg(
        F.max("n").alias("w"),
        F.count("*").alias("num_samples"),
        F.sum("n").alias("num_scores"),
        F.sum("s").alias("s"),
        F.sum("last").alias("l"),
        F.sum(F.col("last") * F.col("n")).alias("ln"),
        F.count_if((F.col("last_pred") == "") | F.col("last_pred").isNull()).alias("empty_samples"),
        F.avg("any_right").alias("any"),
    )
    total = F.col("s") + F.col("w") * F.col("l") - F.col("ln")
    return m.select(
        "num_samples",
        "num_scores",
        "empty_samples",
        F.round(total / (F.col("w") * F.col("num_samples")) * 100, 1).alias("acc"),
        F.round(F.col("any") * 100, 1).alias("acc_pass"),
    )


def last_attempt_accuracy_by(df: DataFrame, problem: str, by: str, order: Column, score: Column) -> DataFrame:
    per = df.groupBy(problem).agg(F.max_by(F.struct(F.col(by).alias(by), score.cast("double").alias("s")), order).alias("x"))
    return per.groupBy(F.col(f"x.{by}").alias(by)).agg(F.round(F.avg("x.s") * 100, 1).alias("acc"))


def consistency_rate(df: DataFrame, question: list[str], answer: str) -> DataFrame:
    """Equal answer pairs over all pairs within a question, from counts instead of pairs."""
    cells = df.groupBy(*question, answer).agg(F.count("*").cast("double").alias("c"))
    per = cells.groupBy(*question).agg(
        F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"), F.sum("c").alias("n")
    )
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    return per.agg(F.when(pairs > 0, F.sum("same") / pairs).otherwise(0.0).alias("consistency_rate"))


def option_consistency_rate(df: DataFrame, question: list[str], answer: str, moved_label: str, original_label: str):
    """Consistency after the moved correct option is mapped back to its first label.

    An answer equal to the original label or to the moved label counts as the
    original label.
    """
    a = F.col(answer)
    back = F.when(a.isin(F.col(original_label), F.col(moved_label)), F.col(original_label)).otherwise(a)
    return consistency_rate(df.withColumn("_back", back), question, "_back")


def accuracy_by_variant(df: DataFrame, variant: list[str], category: str, correct: Column) -> DataFrame:
    """Accuracy per prompt or option variant, averaged over categories, at four decimals."""
    per = df.groupBy(*variant, category).agg(F.avg(correct.cast("double")).alias("a"))
    return per.groupBy(*variant).agg(F.round(F.avg("a"), 4).alias("accuracy"))


def pass_rate_by_difficulty(df: DataFrame, difficulty: str, score: str) -> DataFrame:
    """Mean score per difficulty and over all problems."""
    rows = df.rollup(difficulty).agg(F.avg(score).alias("pass_at_1"))
    return rows.select(F.coalesce(difficulty, F.lit("all")).alias("difficulty"), "pass_at_1")


def temperature_table(df: DataFrame, model: list[str], temperature: str, values: list[tuple[float, str]]) -> DataFrame:
    """One row per model with the metric read at given temperatures, e.g. (0.2, "pass_at_1")."""
    cols = [F.max(F.when(F.col(temperature) == t, F.col(m))).alias(f"{m}_t{t}") for t, m in values]
    return df.groupBy(*model).agg(*cols).orderBy(*model)


def ground_truth_rate(df: DataFrame, status: str, warn_at: float = 0.99) -> DataFrame:
    rate = F.avg((F.col(status) == "pass").cast("double"))
    return df.agg(rate.alias("rate"), (rate <= warn_at).alias("warn"))


def checkpoint_progress(df: DataFrame, model: str, trained_prefixes: list[str], metrics: list[str]) -> DataFrame:
    """Model names ``type_step`` split into trained series and baselines."""
    kind = F.split_part(model, F.lit("_"), F.lit(1))
    step = F.split_part(model, F.lit("_"), F.lit(2)).try_cast("int")
    trained = reduce(lambda a, b: a | b, [F.col(model).startswith(p + "_") for p in trained_prefixes])
    return (
        df.withColumn("trained", trained)
        .withColumn("model_type", F.when(trained, kind).otherwise(F.col(model)))
        .withColumn("step", F.when(trained, step))
        .filter(~trained | F.col("step").isNotNull())
        .groupBy("trained", "model_type", "step")
        .agg(*[F.avg(m).alias(m) for m in metrics])
        .orderBy("trained", "model_type", "step")
    )


def failing_problems(outcomes: DataFrame, problem: str, status: str) -> DataFrame:
    """All outcome rows of problems where not every result passes."""
    failing = outcomes.groupBy(problem).agg(F.min((F.col(status) == "pass").cast("int")).alias("_ok"))
    return outcomes.join(failing.filter("_ok = 0").select(problem), problem, "left_semi")
