"""Row numbers and running sums that do not send one group to one task.

A window without a bounded partition sorts everything in a single task. Here Spark range-partitions and sorts the rows by
the keys, the result is written to the shared checkpoint folder (so that every later read sees the same ranges), numbers
and sums start anew in every range, and the range totals, one row per range, give the offsets.

Keys must identify a row: rows of equal keys stay in one range, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.session import cut_lineage


def _ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in key order with ``_range`` and ``_row``, the row's number from 0 inside its range."""
    return _located(df.repartitionByRange(*keys).sortWithinPartitions(*keys))


def _located(df: DataFrame) -> DataFrame:
    """The rows, written once, with their task's number (``_range``) and their number from 0 in there (``_row``)."""
    placed = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits of the id are the task, the lower 33 bits the row.
    row = F.col("_at") - F.shiftleft(F.shiftright("_at", 33), 33)
    return placed.select(*df.columns, F.shiftright("_at", 33).alias("_range"), row.alias("_row"))


def _numbered(located: DataFrame, columns: list[str], name: str) -> DataFrame:
    sums = located.groupBy("_range").agg(F.count("*").alias("_t_n"))
    offsets = _offsets(sums, {"n": F.lit(1)})
    return located.join(offsets, "_range").select(*columns, (F.col("_o_n") + F.col("_row")).cast("long").alias(name))


def _offsets(sums: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """What lies before each range; the table has one row per range."""
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: F.coalesce(F.sum("_t_" + c).over(ahead), F.lit(0)).alias("_o_" + c) for c in totals}
    return sums.select(F.col("_range"), *names.values())


def running_totals(df: DataFrame, keys: list[str], totals: dict[str, Column], before: bool = False) -> DataFrame:
    """Add running sums in ascending order of ``keys``, nulls first.

    ``totals`` maps the new column to the summed expression. With ``before`` the current row is left out of its own sum.
    """
    ranged = _ranges(df, keys)
    sums = ranged.groupBy("_range").agg(*[F.sum(e).alias("_t_" + c) for c, e in totals.items()])
    frame = Window.partitionBy("_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    joined = ranged.join(_offsets(sums, totals), "_range")
    cols = [(F.coalesce(F.sum(e).over(frame), F.lit(0)) + F.col("_o_" + c)).alias(c) for c, e in totals.items()]
    return joined.select(*df.columns, *cols)


def dense_index(df: DataFrame, keys: list[str], name: str = "idx") -> DataFrame:
    """Consecutive numbers from 0 in ascending order of ``keys``, nulls first; no window over the rows."""
    return _numbered(_ranges(df, keys), df.columns, name)


def group_index(df: DataFrame, group: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Numbers from 1 inside each group, a null group included; a group may span many tasks.

    The overall number minus the smallest one of the group is the group number, so no group is ever sorted as a whole.
    """
    numbered = dense_index(df, [*group, *order], "_all")
    first = numbered.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group]).agg(F.min("_all").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    return numbered.join(first, same).select(*df.columns, (F.col("_all") - F.col("_first") + 1).alias(name))


def scan_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """Consecutive numbers from 0 in scan order, without a shuffle of the rows.

    The rows are written once with the number inside their scan task, so a later read cannot number them differently.
    """
    return _numbered(_located(df), df.columns, name)


def first_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group.

    Spark prunes every task to ``k`` rows per group before the shuffle, so a
    group that holds most of the table still moves only ``k`` rows per task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
