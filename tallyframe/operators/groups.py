"""Scores of tasks rolled up over a group tree, and the errors that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.operators.aggregates import mean_stderr


def tree_edges(tree: dict) -> list[tuple[str, str]]:
    """(group, child) pairs of ``{group: {subgroup or task: ... or None}}``, one per line of the written tree."""
    found, todo = [], list((name, children) for name, children in tree.items())
    while todo:
        group, children = todo.pop()
        for name, below in (children or {}).items():
            found.append((group, name))
            todo.append((name, below))
    return found


CYCLE = "the groups form a cycle: "


def tree_closure(edges: DataFrame, group: str = "group", child: str = "task") -> DataFrame:
    """(group, task, depth): everything below each group, by a recursive query over the edges.

    The edges are a table of any depth; a task may lie in several groups and is below each of them once, at its least depth.
    A group that lies below itself is an error. Null names are no edges. The depth is bounded by the session's
    ``spark.sql.cteRecursionLevelLimit``, the rows by ``spark.sql.cteRecursionRowLimit``.
    """
    pairs = edges.select(F.col(group).cast("string").alias("g"), F.col(child).cast("string").alias("c")).dropna().distinct()
    walk = pairs.sparkSession.sql(
        f"""WITH RECURSIVE walk(top, node, depth, trail) AS (
              SELECT g, c, 1, array(g, c) FROM {{pairs}} WHERE IF(g = c, raise_error('{CYCLE}' || g), true)
              UNION ALL
              SELECT top, c, depth + 1, array_append(trail, c) FROM walk JOIN {{pairs}} ON g = node
              WHERE IF(array_contains(trail, c), raise_error('{CYCLE}' || array_join(trail, ' > ')), true))
            SELECT top, node, min(depth) AS depth FROM walk GROUP BY top, node""",
        pairs=pairs,
    )
    return walk.select(F.col("top").alias("group"), F.col("node").alias("task"), "depth")


def leaf_edges(edges: DataFrame, group: str = "group", child: str = "task") -> DataFrame:
    """(group, task) pairs of every group with the tasks below it that are no groups themselves."""
    groups = edges.select(F.col(group).cast("string").alias("task")).dropna().distinct()
    return tree_closure(edges, group, child).join(groups, "task", "left_anti").select("group", "task")


def tree_order(edges: DataFrame, group: str = "group", child: str = "task") -> DataFrame:
    """(name, depth, path, alias) of every place in the tree, each group before what lies in it, names in order.

    Roots are the groups that lie in no group. A task of two groups has two places. ``path`` is the array of names from the root.
    """
    pairs = edges.select(F.col(group).cast("string").alias("g"), F.col(child).cast("string").alias("c")).dropna().distinct()
    walk = pairs.sparkSession.sql(
        f"""WITH RECURSIVE walk(node, path) AS (
              SELECT g, array(g) FROM (SELECT DISTINCT g FROM {{pairs}}) r LEFT ANTI JOIN {{pairs}} p ON p.c = r.g
              UNION ALL
              SELECT c, array_append(path, c) FROM walk JOIN {{pairs}} ON g = node
              WHERE IF(array_contains(path, c), raise_error('{CYCLE}' || array_join(path, ' > ')), true))
            SELECT node, path FROM walk""",
        pairs=pairs,
    )
    depth = F.size("path") - 1
    alias = F.concat(F.repeat(F.lit(" "), depth), F.when(depth > 0, "- ").otherwise(""), F.col("node"))
    return walk.select(F.col("node").alias("name"), depth.alias("depth"), "path", alias.alias("alias")).orderBy("path")


def pooled_stderr(stderr: Column, size: Column) -> Column:
    """Stderr of the concatenated subtasks; NULL if one subtask has none."""
    n = F.sum(size)
    pooled = F.sum((size - 1) * stderr * stderr * size) / (n - F.count(size))
    return F.when(F.count(stderr) == F.count(size), F.sqrt(pooled / n))


def combined_stderr(stderr: Column, size: Column, value: Column) -> Column:
    """Variance merge that also counts the spread of the subtask means.

    The per-task variance is stderr squared. The merge is the standard one-pass
    form: within part plus between part over N - 1.
    """
    n = F.sum(size)
    total = F.sum(size * value)
    within = F.sum((size - 1) * stderr * stderr)
    between = F.sum(size * value * value) - total * total / n
    return F.sqrt((within + F.greatest(between, F.lit(0.0))) / (n - 1))


def weighted_mean(value: Column, size: Column) -> Column:
    return F.sum(value * size) / F.sum(size)


def harmonic_mean(value: Column, size: Column) -> Column:
    return F.sum(size) / F.sum(size / (value + 0.01))


def group_rollup(
    scores: DataFrame,
    edges: DataFrame,
    how: str = "mean",
    weight_by_size: bool = True,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Metric of every group over its leaf tasks.

    ``scores``: task, value, stderr, n.  ``edges``: group, task (flattened, as :func:`leaf_edges` makes them of a tree).
    ``extra`` adds user aggregates over the joined rows, such as a difference of two
    subtasks.
    """
    size = F.col("n").cast("double")
    weight = size if weight_by_size else F.lit(1.0)
    agg = {"mean": weighted_mean, "harmonic": harmonic_mean}[how]
    joined = edges.join(scores, "task")
    return joined.groupBy("group").agg(
        agg(F.col("value"), weight).alias("value"),
        pooled_stderr(F.col("stderr"), size).alias("stderr"),
        F.sum("n").alias("n"),
        *[e.alias(c) for c, e in (extra or {}).items()],
    )


def task_scores(df: DataFrame, task: list[str], value: str) -> DataFrame:
    """Mean, stderr and sample count per task."""
    return df.groupBy(*task).agg(
        F.avg(value).alias("value"), mean_stderr(value).alias("stderr"), F.count(value).alias("n")
    )


def consolidate_results(
    samples: DataFrame, tasks: DataFrame, value: str = "value", keys: tuple[str, ...] = ("metric", "filter")
) -> DataFrame:
    """One row per task, metric and filter with value, error, sizes and task facts.

    ``tasks``: task, version, n_shot, n_original, higher_is_better (one row per task).
    """
    per = samples.groupBy("task", *keys).agg(
        F.avg(value).alias("value"), mean_stderr(value).alias("stderr"), F.count(value).alias("n_effective")
    )
    return per.join(tasks, "task")


def group_direction(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """``higher_is_better`` of a group; NULL where its subtasks disagree."""
    joined = edges.join(scores.select("task", "higher_is_better").distinct(), "task")
    up, down = F.bool_or("higher_is_better"), F.bool_and("higher_is_better")
    return joined.groupBy("group").agg(F.when(up == down, up).alias("higher_is_better"))
