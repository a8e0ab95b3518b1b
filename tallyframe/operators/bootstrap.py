"""Bootstrap errors without resampled copies of the data.

A resample of n rows is n draws with replacement. The rows of a group are dealt by a hash of their values to leaves of a
binary tree. At every node a seeded binomial splits the draws between its halves, for all resamples in one vector, so each
leaf learns from the counts along its own path how often it is drawn and needs to hear from no other leaf. Inside a leaf the
draws fall on its values by one multinomial. The result is exactly a draw of n out of n, whatever the number of leaves, and
a task that is run again draws the same.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.session import broadcast_if_small, cut_lineage

#: Distinct values per leaf, on average at most.
LEAF = 2048
#: Resamples that one vector of weights covers.
BLOCK = 256


def _leaves(cells: DataFrame, by: list[str], leaf: int) -> DataFrame:
    """Cells with their group's number ``_grouphash``, the tree's depth ``_d`` and the leaf's number ``_leaf``."""
    groups = cells.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.count("*").alias("_cells"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_cells") / leaf))).cast("int").alias("_d")
    groups = groups.select(*[f"_by_{c}" for c in by], depth)
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    dealt = cells.join(broadcast_if_small(groups, [f"_by_{c}" for c in by]), same).drop(*[f"_by_{c}" for c in by])
    # The upper bits of the hash, so that a leaf's ancestors are its prefixes.
    prefix = F.when(F.col("_d") > 0, F.call_function("shiftrightunsigned", F.col("_h"), 64 - F.col("_d"))).otherwise(F.lit(0))
    return dealt.withColumn("_leaf", prefix.cast("long"))


def _paths(leaves: DataFrame, key: list[str]) -> DataFrame:
    """Per leaf the nodes above it: level, node, rows in the node and in its left half, and the side that the leaf lies on."""
    counts = leaves.groupBy(*key, "_d", "_leaf").agg(F.sum("_c").alias("_n"))
    up = counts.filter("_d > 0").select(*key, "_d", "_leaf", "_n", F.explode(F.sequence(F.lit(0), F.col("_d"))).alias("_level"))
    up = up.withColumn("_node", F.call_function("shiftright", F.col("_leaf"), F.col("_d") - F.col("_level")))
    nodes = up.groupBy(*key, "_level", "_node").agg(F.sum("_n").alias("_n"))
    inner = up.filter("_level < _d").select(*key, "_leaf", "_level", "_node", F.call_function("shiftright", F.col("_leaf"), F.col("_d") - F.col("_level") - 1).alias("_below"))
    match = lambda t, level, node: [F.col(f"a.{k}").eqNullSafe(F.col(f"{t}.{k}")) for k in key] + [level == F.col(f"{t}._level"), node == F.col(f"{t}._node")]
    a = inner.alias("a").join(nodes.alias("n"), match("n", F.col("a._level"), F.col("a._node")))
    left = match("l", F.col("a._level") + 1, F.col("a._node") * 2)
    a = a.join(nodes.alias("l"), left, "left")
    return a.select(
        *[F.col(f"a.{k}").alias(k) for k in [*key, "_leaf", "_level", "_node"]], F.col("n._n").alias("_n"),
        F.coalesce(F.col("l._n"), F.lit(0)).alias("_left"), (F.col("a._below") % 2 == 1).alias("_right"),
    )


def resampled_sums(df: DataFrame, by: list[str], sums: dict[str, Column], iters: int = 1000, seed: int = 1234, leaf: int = LEAF) -> DataFrame:
    """(by, ``_iter``, ``n``, sums) of every resample. Rows with a null in any sum do not count."""
    names = list(sums)
    cells = df.groupBy(*by, *[e.cast("double").alias(c) for c, e in sums.items()]).agg(F.count("*").alias("_c"))
    cells = cells.dropna(subset=names).withColumn("_h", F.xxhash64(F.lit(seed), *by, *names)).withColumn("_grouphash", F.xxhash64(F.lit(seed), *by))
    leaves = cut_lineage(_leaves(cells, by, leaf))  # used three times
    key = [*by, "_grouphash"]
    totals = leaves.groupBy(*key, "_d", "_leaf").agg(F.sum("_c").alias("_n"))
    whole = totals.groupBy(*key).agg(F.sum("_n").alias("_n"))
    # The root's row carries the number of draws; levels below it carry the splits.
    root = totals.select(*key, "_leaf").join(whole.select(*[F.col(k).alias(f"w_{k}") for k in key], "_n"), [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in key])
    root = root.select(*key, "_leaf", F.lit(-1).alias("_level"), F.lit(0).cast("long").alias("_node"), "_n", F.lit(0).cast("long").alias("_left"), F.lit(False).alias("_right"))
    paths = root.unionByName(_paths(leaves, key))
    paths = paths.select(*[F.col(c).alias(f"p{c}") for c in paths.columns])
    schema = T.StructType([leaves.schema[c] for c in by] + [T.StructField("_iter", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ["n", *names]])

    def rng(*where: int) -> np.random.Generator:
        return np.random.default_rng([seed & 0xFFFFFFFF, *(w & 0xFFFFFFFFFFFFFFFF for w in where)])

    def draw(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        path = path.set_axis([c[1:] for c in path.columns], axis=1).sort_values("_level")
        group, leaf_no = int(path["_grouphash"].iloc[0]), int(path["_leaf"].iloc[0])
        draws = np.full(iters, int(path["_n"].iloc[0]))
        for level, node, n, left, right in path[["_level", "_node", "_n", "_left", "_right"]].iloc[1:].itertuples(index=False):
            first = rng(group, int(level) + 1, int(node)).binomial(draws, left / n)
            draws = draws - first if right else first
        rows = rows.sort_values(names)
        values = np.column_stack([np.ones(len(rows)), rows[names].to_numpy(dtype=float)])
        share = rows["_c"].to_numpy(dtype=float)
        share /= share.sum()
        own = rng(group, 0, leaf_no)
        parts = [own.multinomial(draws[k : k + BLOCK], share).astype(float) @ values for k in range(0, iters, BLOCK)]
        out = pd.DataFrame(np.concatenate(parts), columns=["n", *names])
        out.insert(0, "_iter", np.arange(iters, dtype="int32"))
        for i, c in enumerate(by):
            out.insert(i, c, pd.Series([rows[c].iloc[0]] * iters, dtype=rows[c].dtype, index=out.index))
        return out

    drawn = leaves.groupBy(*key, "_leaf").cogroup(paths.groupBy(*[f"p{c}" for c in [*key, "_leaf"]])).applyInPandas(draw, schema)
    return drawn.groupBy(*by, "_iter").agg(*[F.sum(c).alias(c) for c in ["n", *names]])


def bootstrap_stderr(
    df: DataFrame,
    by: list[str],
    sums: dict[str, Column],
    statistic: Callable[[dict[str, Column]], Column],
    iters: int = 1000,
    seed: int = 1234,
    leaf: int = LEAF,
) -> DataFrame:
    """Standard deviation of a statistic over resamples of n out of n rows, per group.

    The statistic is a function of column sums over the drawn rows and of their number ``n`` (means, perplexity, F1, BLEU,
    chrF, correlation from sums). Equal rows are first counted; tasks add up what their leaves draw, and only those sums are
    shuffled. A null group is a group; without ``by`` the whole table is one.
    """
    asked = by
    if not by:
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    per_iter = resampled_sums(df, by, sums, iters, seed, leaf)
    stat = per_iter.select(*by, statistic({c: F.col(c) for c in ["n", *sums]}).alias("s"))
    return stat.groupBy(*by).agg(F.stddev_samp("s").alias("stderr")).select(*asked, "stderr")
