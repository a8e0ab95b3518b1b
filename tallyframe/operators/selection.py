"""Row selection, set operations and ordering of tables."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.columns import all_of, any_of
from tallyframe.operators.ordering import dense_index


def filter_category(df: DataFrame, col: str, value, mode: str = "equals") -> DataFrame:
    """``mode``: equals, startswith, in, excludes (text does not contain the value)."""
    c = F.col(col)
    test = {
        "equals": lambda: c == value,
        "startswith": lambda: c.startswith(value),
        "in": lambda: c.isin(list(value)),
        "excludes": lambda: ~c.contains(value),
    }[mode]()
    return df.filter(test)


def filter_nonempty(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.filter(all_of([F.coalesce(F.col(c), F.lit("")) != "" for c in cols]))


def filter_date_range(df: DataFrame, col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive ISO bounds; plain comparisons, so the scan can use them."""
    if start is not None:
        df = df.filter(F.col(col) >= F.to_timestamp(F.lit(start)))
    if end is not None:
        df = df.filter(F.col(col) <= F.to_timestamp(F.lit(end)))
    return df


def limit_docs(df: DataFrame, key: str, limit: int | float) -> DataFrame:
    """The first ``limit`` documents in key order, or the first share of them below 1."""
    numbered = dense_index(df, [key], "_pos")
    k = math.ceil(numbered.count() * limit) if limit < 1 else int(limit)
    return numbered.filter(F.col("_pos") < k).drop("_pos")


def slice_docs(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Documents at positions start <= p < end in key order."""
    return dense_index(df, [key], "_pos").filter((F.col("_pos") >= start) & (F.col("_pos") < end)).drop("_pos")


def assign_shard(df: DataFrame, key: str, world_size: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.col(key), F.lit(world_size)).cast("int"))


def glob_to_regex(pattern: str) -> str:
    """Shell-style pattern to an anchored regular expression."""
    marks = {"*": ".*", "?": "."}
    return "^(?s:" + "".join(marks.get(ch, re.escape(ch)) for ch in pattern) + ")$"


def match_names(df: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    hit = any_of([F.col(col).rlike(glob_to_regex(p)) for p in patterns])
    return df.filter(hit).select(col).distinct().orderBy(col)


# ---------------------------------------------------------------- sets


def tasks_of_all_models(df: DataFrame, model: str, task: str) -> DataFrame:
    """Tasks that every model has."""
    pairs = df.select(model, task).distinct()
    n_models = pairs.agg(F.countDistinct(model).alias("_n"))
    per = pairs.groupBy(task).agg(F.count("*").alias("_c"))
    return per.join(n_models, F.col("_c") == F.col("_n")).select(task)


def collect_outputs(df: DataFrame, key: str, pos: str, output: str, keep: list[str] = ()) -> DataFrame:
    """One row per id: outputs in order of appearance, other columns from the first row.

    The list of one id is part of the result by definition.
    """
    first = [F.min_by(c, pos).alias(c) for c in keep]
    outs = F.transform(F.array_sort(F.collect_list(F.struct(pos, output))), lambda x: x[output])
    return df.groupBy(key).agg(F.min(pos).alias(pos), *first, outs.alias("outputs"))


def keep_last(df: DataFrame, key: list[str], pos: Column) -> DataFrame:
    """The last row per key, as one aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), pos).alias("_r"))
    return last.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


# ---------------------------------------------------------------- ordering


def order_results(df: DataFrame, path: str, alias: str) -> DataFrame:
    """Rows in tree order (``path`` is ``group/subgroup/task``) with an indented name."""
    depth = F.size(F.split(path, "/")) - 1
    name = F.concat(F.repeat(F.lit(" "), depth), F.when(depth > 0, "- ").otherwise(""), F.col(alias))
    return df.withColumn("alias", name).orderBy(path)
