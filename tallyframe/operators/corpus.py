"""Corpus text metrics: BLEU, chrF and ROUGE.

Each row yields a few counts (matches, totals, lengths) inside the task; only their
sums are aggregated.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions.columns import let, occurrences, words
from tallyframe.operators.bootstrap import bootstrap_stderr

# The mteval-13a tokenizer steps.
TOKENIZE_13A = [
    ("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    (r"^|$", " "), (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
TINY = 2.2250738585072014e-308


def tokens_13a(text: Column) -> Column:
    return words(reduce(lambda t, step: F.regexp_replace(t, *step), TOKENIZE_13A, text))


def tokens_code_text(text: Column) -> Column:
    """Lower-case words and single marks, underscores apart."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"), F.lit(1))
    return words(F.replace(F.array_join(parts, " "), F.lit("_"), F.lit(" _ ")))


def tokens_rouge(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), "")


def grams(tokens: Column, n: int) -> Column:
    """All n-grams of a token array: the tokens themselves, or 64-bit hashes over the tokens of each longer gram."""
    if n == 1:
        return tokens
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)]))
    return F.coalesce(hashed, F.array().cast("array<bigint>"))


def clipped_matches(pred: Column, refs: Column) -> Column:
    """Matches of prediction n-grams, each at most as often as in the best reference."""
    return F.size(F.array_intersect(occurrences(pred), F.flatten(F.transform(refs, occurrences))))


def bleu_counts(pred_tokens: Column, ref_tokens: Column, closest: bool = True) -> Column:
    """struct(m1..m4, t1..t4, pred_len, ref_len) of one row; ``ref_tokens`` is an array of token arrays."""

    def counts(s: Column) -> Column:
        n_pred = F.size(s["p"])
        lens = F.transform(s["r"], lambda r: F.size(r))
        nearest = F.array_min(F.transform(lens, lambda l: F.struct(F.abs(l - n_pred).alias("d"), l.alias("l"))))["l"]
        fields = []
        for n in range(1, 5):
            fields.append(clipped_matches(grams(s["p"], n), F.transform(s["r"], lambda r: grams(r, n))).alias(f"m{n}"))
            fields.append(F.greatest(n_pred - n + 1, F.lit(0)).alias(f"t{n}"))
        ref_len = nearest if closest else F.array_min(lens)
        return F.struct(*fields, n_pred.alias("pred_len"), ref_len.alias("ref_len"))

    return let(F.struct(pred_tokens.alias("p"), ref_tokens.alias("r")), counts)


def bleu_from_sums(m: list[Column], t: list[Column], pred_len: Column, ref_len: Column) -> Column:
    """Corpus BLEU (0-100); an order without matches gets a halved count per such order."""
    logs, smooth = [], F.lit(1.0)
    for k in range(4):
        smooth = F.when((m[k] == 0) & (t[k] > 0), smooth * 2).otherwise(smooth)
        p = F.when(m[k] > 0, m[k] / F.nullif(t[k], F.lit(0))).otherwise(1.0 / (smooth * F.nullif(t[k], F.lit(0))))
        logs.append(F.log(p))
    brevity = F.when(pred_len < ref_len, F.exp(1 - ref_len / F.nullif(pred_len, F.lit(0)))).otherwise(1.0)
    score = 100 * brevity * F.exp(reduce(lambda a, b: a + b, logs) / 4)
    return F.when(m[0] == 0, 0.0).otherwise(F.coalesce(score, F.lit(0.0)))


def corpus_bleu(df: DataFrame, pred: Column, refs: Column, by: list[str] = ()) -> DataFrame:
    rows = df.select(*by, bleu_counts(tokens_13a(pred), F.transform(refs, tokens_13a)).alias("c")).select(*by, "c.*")
    s = lambda c: F.sum(c).cast("double")
    score = bleu_from_sums(
        [s(f"m{n}") for n in range(1, 5)], [s(f"t{n}") for n in range(1, 5)], s("pred_len"), s("ref_len")
    )
    return rows.groupBy(*by).agg(score.alias("bleu"))


def smoothed_bleu4(pred: Column, refs: Column) -> Column:
    """Sentence BLEU (0-1) with one added to the counts above single words."""

    def score(c: Column) -> Column:
        logs = []
        for n in range(1, 5):
            add = 0 if n == 1 else 1
            logs.append(F.log(c[f"m{n}"] + F.lit(add + TINY)) - F.log(c[f"t{n}"] + F.lit(add + TINY)))
        short = F.least(F.lit(0.0), 1 - (c["ref_len"] + 1) / (c["pred_len"] + 1))
        return F.exp(reduce(lambda a, b: a + b, logs) / 4 + short)

    return let(bleu_counts(tokens_code_text(pred), F.transform(refs, tokens_code_text), closest=False), score)


def chrf_counts(pred: Column, ref: Column, order: int = 6) -> Column:
    chars = lambda t: F.filter(F.split(F.regexp_replace(t, r"[\s\p{Z}]+", ""), ""), lambda c: c != "")

    def counts(s: Column) -> Column:
        fields = []
        for n in range(1, order + 1):
            n_pred = F.greatest(F.size(s["p"]) - n + 1, F.lit(0))
            n_ref = F.greatest(F.size(s["r"]) - n + 1, F.lit(0))
            fields.append(clipped_matches(grams(s["p"], n), F.array(grams(s["r"], n))).alias(f"m{n}"))
            fields.append(F.when(n_ref > 0, n_pred).otherwise(0).alias(f"p{n}"))
            fields.append(n_ref.alias(f"r{n}"))
        return F.struct(*fields)

    return let(F.struct(chars(pred).alias("p"), chars(ref).alias("r")), counts)


def corpus_chrf(df: DataFrame, pred: Column, ref: Column, by: list[str] = (), order: int = 6, beta: float = 2.0) -> DataFrame:
    """Character n-gram F-score (0-100): mean precision and recall over the orders."""
    rows = df.select(*by, chrf_counts(pred, ref, order).alias("c")).select(*by, "c.*")
    sums = rows.groupBy(*by).agg(*[F.sum(c).cast("double").alias(c) for c in rows.columns if c not in by])
    return sums.select(*by, chrf_from_sums({c: F.col(c) for c in sums.columns}, order, beta).alias("chrf"))


def chrf_from_sums(s: dict[str, Column], order: int = 6, beta: float = 2.0) -> Column:
    """chrF (0-100) from summed n-gram counts; an order that one side lacks does not count."""
    used = [((s[f"p{n}"] > 0) & (s[f"r{n}"] > 0)) for n in range(1, order + 1)]
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    n_used = F.nullif(total([u.cast("double") for u in used]), F.lit(0.0))
    prec = total([F.when(u, s[f"m{n}"] / s[f"p{n}"]).otherwise(0.0) for n, u in enumerate(used, 1)]) / n_used
    rec = total([F.when(u, s[f"m{n}"] / s[f"r{n}"]).otherwise(0.0) for n, u in enumerate(used, 1)]) / n_used
    b2 = beta * beta
    score = 100 * (1 + b2) * prec * rec / F.nullif(b2 * prec + rec, F.lit(0.0))
    return F.coalesce(score, F.lit(0.0))


def bleu_stderr(df: DataFrame, pred: Column, refs: Column, by: list[str] = (), **options) -> DataFrame:
    """Bootstrap error of corpus BLEU: resampled rows are summed counts, no text is scored twice."""
    rows = df.select(*by, bleu_counts(tokens_13a(pred), F.transform(refs, tokens_13a)).alias("c")).select(*by, "c.*")
    names = [*[f"{k}{n}" for k in "mt" for n in range(1, 5)], "pred_len", "ref_len"]
    score = lambda s: bleu_from_sums([s[f"m{n}"] for n in range(1, 5)], [s[f"t{n}"] for n in range(1, 5)], s["pred_len"], s["ref_len"])
    return bootstrap_stderr(rows, list(by), {c: F.col(c) for c in names}, score, **options)


def chrf_stderr(df: DataFrame, pred: Column, ref: Column, by: list[str] = (), order: int = 6, beta: float = 2.0, **options) -> DataFrame:
    """Bootstrap error of corpus chrF."""
    rows = df.select(*by, chrf_counts(pred, ref, order).alias("c")).select(*by, "c.*")
    names = [f"{k}{n}" for k in "mpr" for n in range(1, order + 1)]
    return bootstrap_stderr(rows, list(by), {c: F.col(c) for c in names}, lambda s: chrf_from_sums(s, order, beta), **options)


def rouge_n(pred: Column, ref: Column, n: int) -> Column:
    """F-measure of n-gram overlap."""

    def f(s: Column) -> Column:
        matches = clipped_matches(grams(s["p"], n), F.array(grams(s["r"], n)))
        made = lambda tokens: F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        # bound once: the matches are the whole cost
        return let(matches, lambda same: F.when(same > 0, 2.0 * same / (made(s["p"]) + made(s["r"]))).otherwise(0.0))

    return let(F.struct(tokens_rouge(pred).alias("p"), tokens_rouge(ref).alias("r")), f)


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common token subsequence, one bit per token of ``a``."""

    def length(x, y) -> int:
        masks: dict = {}
        for i, w in enumerate(x):
            masks[w] = masks.get(w, 0) | (1 << i)
        full = (1 << len(x)) - 1
        state = full
        for w in y:
            hit = state & masks.get(w, 0)
            state = ((state + hit) | (state - hit)) & full
        return len(x) - bin(state).count("1")

    return pd.Series([length(x, y) for x, y in zip(a, b)])


def with_rouge_l(df: DataFrame, pred: str, ref: str, name: str = "rouge_l") -> DataFrame:
    toks = df.withColumn("_p", tokens_rouge(F.col(pred))).withColumn("_r", tokens_rouge(F.col(ref)))
    scored = toks.withColumn("_l", common_subsequence("_p", "_r"))
    both = F.size("_p") + F.size("_r")
    return scored.withColumn(name, F.when(F.col("_l") > 0, 2.0 * F.col("_l") / both).otherwise(0.0)).drop("_p", "_r", "_l")


def summary_sentences(text: Column) -> Column:
    """Token arrays of the sentences: a spaced full stop ends one, as does a line feed."""
    lines = F.filter(F.split(F.replace(text, F.lit(" . "), F.lit(".\n")), "\n"), lambda x: x != "")
    return F.transform(lines, tokens_rouge)


def subsequence_places(ref: list[str], other: list[str]) -> list[int]:
    """Places in ``ref`` of one longest common subsequence.

    The table of lengths is kept as one bit row per token of ``ref`` (a cleared bit is a step up by one), so a pair of
    sentences needs one bit per cell. The walk back goes diagonally over equal tokens, else to the longer neighbour, up on a tie.
    """
    masks: dict = {}
    for j, w in enumerate(other):
        masks[w] = masks.get(w, 0) | (1 << j)
    full = (1 << len(other)) - 1
    rows = [full]
    for w in ref:
        hit = rows[-1] & masks.get(w, 0)
        rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & full)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    out, i, j = [], len(ref), len(other)
    while i and j:
        if ref[i - 1] == other[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return out


@F.pandas_udf(T.IntegerType())
def union_subsequence_hits(refs: pd.Series, preds: pd.Series) -> pd.Series:
    """Tokens of the reference sentences that lie in the union of their common subsequences with all predicted sentences, each
    token at most as often as both texts have it."""

    def hits(ref, pred) -> int:
        ref, pred = [list(x) for x in ref], [list(x) for x in pred]
        left = Counter(w for x in pred for w in x)
        found = Counter(x[i] for x in ref for i in set().union(*(subsequence_places(x, y) for y in pred)))
        return sum(min(n, left[w]) for w, n in found.items())

    return pd.Series([hits(r, p) for r, p in zip(refs, preds)])


def with_rouge_lsum(df: DataFrame, pred: str, ref: str, name: str = "rouge_lsum") -> DataFrame:
    """Summary-level ROUGE-L: F-measure over the union of common subsequences per reference sentence."""
    toks = df.withColumn("_p", summary_sentences(F.col(pred))).withColumn("_r", summary_sentences(F.col(ref)))
    toks = toks.withColumn("_l", union_subsequence_hits("_r", "_p"))
    size = lambda c: F.size(F.flatten(c))
    return toks.withColumn(name, F.when(F.col("_l") > 0, 2.0 * F.col("_l") / (size("_p") + size("_r"))).otherwise(0.0)).drop("_p", "_r", "_l")


def true_false_scores(scores_true: Column, scores_false: Column, name: str) -> list[Column]:
    """max, difference and acc of a similarity against true and false references."""
    t, f = F.array_max(scores_true), F.array_max(scores_false)
    return [t.alias(f"{name}_max"), (t - f).alias(f"{name}_diff"), (t > f).cast("int").alias(f"{name}_acc")]
