"""Requests to a model: building, batching, windows, fingerprints, cost."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions.columns import let, words
from tallyframe.operators.ordering import dense_index, group_index


def build_requests(
    df: DataFrame,
    output_type: str,
    keys: list[str],
    repeats: int = 1,
    delimiter: str = " ",
    mutual_info: bool = False,
) -> DataFrame:
    """Request rows: keys, idx, request_type, context, continuation, is_unconditional, repeat.

    Uses the columns ``context``, ``target``, ``choices`` and, for generation,
    ``gen_kwargs`` of the prepared documents. The fan-out stays inside the row.
    """
    null = F.lit(None).cast("string")
    request = lambda i, ctx, cont, unc: F.struct(
        i.cast("int").alias("idx"), ctx.alias("context"), cont.alias("continuation"), unc.alias("is_unconditional")
    )
    no, yes, zero = F.lit(False), F.lit(True), F.lit(0)
    if output_type == "loglikelihood":
        rows = F.array(request(zero, F.col("context"), F.concat(F.lit(delimiter), "target"), no))
    elif output_type == "multiple_choice":
        rows = F.transform("choices", lambda c, i: request(i, F.col("context"), F.concat(F.lit(delimiter), c), no))
        if mutual_info:
            alone = F.transform("choices", lambda c, i: request(i, F.lit(""), F.concat(F.lit(delimiter), c), yes))
            rows = F.concat(rows, alone)
    elif output_type == "loglikelihood_rolling":
        rows = F.array(request(zero, F.lit(""), F.col("target"), no))
    elif output_type == "generate_until":
        rows = F.array(request(zero, F.col("context"), null, no))
    else:
        raise ValueError(output_type)
    out = df.select(*keys, F.inline(rows), *(["gen_kwargs"] if output_type == "generate_until" else []))
    kind = "loglikelihood" if output_type == "multiple_choice" else output_type
    return out.withColumn("request_type", F.lit(kind)).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))


def batch_requests(df: DataFrame, group: list[str], text: str, key: str, n: int) -> DataFrame:
    """Fixed-size batches per group, longest first; ``key`` restores the old order.

    A group may hold most requests, so numbering goes through key ranges.
    """
    sized = df.withColumn("_neg", -F.length(text))
    numbered = group_index(sized, group, ["_neg", key], "_rn")
    return numbered.withColumn("batch", F.floor((F.col("_rn") - 1) / n)).drop("_neg", "_rn")


def group_contexts(df: DataFrame, key: str, context: str, continuation: str) -> DataFrame:
    """Requests whose context and continuation agree but for the last token, under one representative.

    ``context`` and ``continuation`` are token arrays. A model scores a representative once; its members differ only in the
    token that is looked up in the result. Adds ``representative`` (the smallest ``key`` of the group), ``n_prefix`` and
    ``last_token``. The prefix is compared by its length and two hash chains over its tokens, 128 bits together, so no text
    is exchanged; a prefix that very many requests share becomes one row per task before it meets the others. An empty
    continuation has no last token, and the whole context is its prefix. Null arrays are empty.
    """
    none = F.array().cast(df.schema[continuation].dataType)
    body, tail = F.coalesce(F.col(context), none), F.coalesce(F.col(continuation), none)
    prefix = F.concat(body, F.slice(tail, F.lit(1), F.greatest(F.size(tail) - 1, F.lit(0))))
    rows = df.withColumns({
        "last_token": F.try_element_at(tail, F.lit(-1)), "n_prefix": F.size(prefix),
        "_a": F.xxhash64(prefix), "_b": F.xxhash64(F.lit("second"), prefix),
    })
    marks = ["n_prefix", "_a", "_b"]
    return rows.join(rows.groupBy(*marks).agg(F.min(key).alias("representative")), marks).drop("_a", "_b")


def batch_contexts(grouped: DataFrame, key: str, n: int) -> DataFrame:
    """(representative, place, batch) of the representatives, longest prefix first; a batch has ``n`` of them."""
    firsts = grouped.filter(F.col(key) == F.col("representative")).select("representative", (-F.col("n_prefix")).alias("_neg"))
    placed = dense_index(firsts, ["_neg", "representative"], "place")
    return placed.select("representative", "place", F.floor(F.col("place") / n).alias("batch"))


def spread_results(grouped: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Results of the representatives, one row per request again, in the order of ``key``."""
    return grouped.join(results, "representative").orderBy(key)


def rolling_windows(tokens: Column, prefix: Column, max_len: int, context_len: int) -> Column:
    """Array of (input, predicted) windows that cover every token once."""
    step = max_len - context_len + 1

    def windows(t: Column) -> Column:
        n = F.size(t)
        first = F.least(F.lit(max_len), n)
        more = F.ceil(F.greatest(n - max_len, F.lit(0)) / F.lit(step)).cast("int")

        def window(w: Column) -> Column:
            done = first + (w - 1) * step
            take = F.least(n - done, F.lit(step))
            end = done + take
            lo = F.greatest(end - max_len - 1, F.lit(0))
            head = F.concat(F.array(prefix), F.slice(t, F.lit(1), F.greatest(first - 1, F.lit(0))))
            return F.struct(
                F.when(w == 0, head).otherwise(F.slice(t, lo + 1, F.greatest(end - 1 - lo, F.lit(0)))).alias("input"),
                F.when(w == 0, F.slice(t, F.lit(1), first))
                .otherwise(F.slice(t, F.greatest(end - take, F.lit(0)) + 1, F.greatest(take, F.lit(0))))
                .alias("predicted"),
            )

        all_ = F.transform(F.sequence(F.lit(0), more), window)
        return F.when(n > 0, all_).otherwise(F.slice(all_, 1, 0))

    return let(tokens, windows)


def disjoint_window(window: Column) -> Column:
    """Shorten the input so that it does not overlap the predicted tokens."""
    keep = F.size(window["input"]) - (F.size(window["predicted"]) - 1)
    return F.struct(F.slice(window["input"], F.lit(1), F.greatest(keep, F.lit(0))).alias("input"), window["predicted"].alias("predicted"))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def sha_fingerprints(df: DataFrame, doc: list[str], prompt: str, target: str) -> DataFrame:
    """Hashes of the document (as JSON), the prompt and the target."""
    return (
        df.withColumn("doc_hash", F.sha2(F.to_json(F.struct(*doc)), 256))
        .withColumn("prompt_hash", F.sha2(F.col(prompt), 256))
        .withColumn("target_hash", F.sha2(F.col(target).cast("string"), 256))
    )


def task_hashes(df: DataFrame, task: list[str], order: str, hash_col: str) -> DataFrame:
    """SHA-256 of a task's sample hashes, concatenated in order.

    The hashes stream past one digest per task, sorted inside their partition, so no task's hashes are gathered in a row or
    in memory. Equal places are ordered by the hash; a null hash adds nothing; null tasks are a task. :func:`block_hashes`
    spreads one very large task over many workers, at the price of another rule.
    """
    rows = df.select(*task, order, F.col(hash_col).cast("string").alias("_hash")).repartition(*task).sortWithinPartitions(*task, order, "_hash")
    keys = rows.select(*task)
    types = keys.limit(0).toArrow().schema.types

    def made(out):
        columns = list(zip(*out)) or [()] * (len(task) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.string()])], [*task, "task_hash"])

    def digests(batches):
        now, key = None, None
        for batch in batches:
            out = []
            for *own, value in zip(*(batch.column(c).to_pylist() for c in [*task, "_hash"])):
                if now is None or own != key:
                    if now is not None:
                        out.append([*key, now.hexdigest()])
                    now, key = hashlib.sha256(), own
                now.update((value or "").encode())
            yield made(out)
        if now is not None:
            yield made([[*key, now.hexdigest()]])

    return rows.mapInArrow(digests, T.StructType([*keys.schema.fields, T.StructField("task_hash", T.StringType())]))


def block_hashes(df: DataFrame, task: list[str], order: str, hash_col: str, block: int = 10_000) -> DataFrame:
    """One hash of a task's sample hashes in order that many workers make together.

    The sample hashes are joined and hashed in blocks, then the block hashes in blocks of the same size, until one is left
    for every task. No row of the plan holds more than ``block`` hashes, however many samples a task has.
    """
    numbered = group_index(df.select(*task, order, hash_col), task, [order], "_rn")
    level = numbered.select(*task, (F.col("_rn") - 1).alias("_p"), F.col(hash_col).alias("_h"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda x: x["_h"]), ""), 256)
    most = level.agg(F.max("_p")).first()[0] or 0
    while True:
        blocked = level.withColumn("_b", F.floor(F.col("_p") / block))
        level = blocked.groupBy(*task, "_b").agg(joined.alias("_h")).withColumnRenamed("_b", "_p")
        most //= block
        if not most:
            return level.select(*task, F.col("_h").alias("block_hash"))


def prune_by_length(df: DataFrame, text: str, max_tokens: int, token_count: Column | None = None) -> DataFrame:
    """Drop documents whose prompt has more than ``max_tokens`` tokens (whitespace by default)."""
    return df.filter((F.size(words(F.col(text))) if token_count is None else token_count) <= max_tokens)


# Tokens added per request type, and prices per 1,000 tokens.
EXTRA_TOKENS = {"loglikelihood": 0, "generate_until": 256, "loglikelihood_rolling": 2048}
PRICES = {"ada": 0.0008, "babbage": 0.0012, "curie": 0.006, "davinci": 0.06}


def cost_estimate(requests: DataFrame, task: str, prices: dict[str, float] = PRICES, tokens: Column | None = None) -> DataFrame:
    """Tokens and price per task with a total row, most expensive first."""
    text = F.concat(F.coalesce("context", F.lit("")), F.coalesce("continuation", F.lit("")))
    count = F.size(words(text)) if tokens is None else tokens
    extra = F.lit(0)
    for kind, n in EXTRA_TOKENS.items():
        extra = F.when(F.col("request_type") == kind, n).otherwise(extra)
    rows = requests.rollup(task).agg(F.sum(count + extra).alias("tokens"), F.grouping(task).alias("_total"))
    priced = rows.select(
        F.when(F.col("_total") == 1, "**Total**").otherwise(F.col(task)).alias(task),
        "tokens",
        *[(F.col("tokens") / 1000 * p).alias(name) for name, p in prices.items()],
        "_total",
    )
    return priced.orderBy("_total", F.col("tokens").desc()).drop("_total")
