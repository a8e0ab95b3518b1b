"""Session set-up and the few helpers that need to look at cluster settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(name: str = "tallyframe", cpus: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a scratch one only in local mode, where one machine has all tasks."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tallyframe-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new folder of the shared one and read it back: narrow columns take less than rows of a checkpoint."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 4) -> DataFrame:
    """Rows of a table in few files over all cores, for work that costs far more per row than moving the row."""
    return df.repartition(per_core * df.sparkSession.sparkContext.defaultParallelism)


def small_tasks(df: DataFrame, text: str, task_bytes: int = 8 * 1024 * 1024) -> DataFrame:
    """Texts dealt to tasks of about ``task_bytes``, measured first, for work that makes many times their size in memory.

    Moving the texts once costs less than spilling what a task makes of a whole file. Few texts stay where they are.
    """
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-size // task_bytes)
    return df.repartition(n) if n > df.sparkSession.sparkContext.defaultParallelism else df


#: Most times that a text is read again in place of being moved.
READINGS = 32


def small_parts(df: DataFrame, text: str, part_bytes: int) -> DataFrame:
    """Texts in tasks of about ``part_bytes``, for work that makes so much of them that a task has to start with little.

    Nothing moves: a piece of the table is read by several tasks, each keeps the rows whose hash is its own. Pieces are
    measured first; where one is so large that it would be read more than ``READINGS`` times, texts are dealt as by
    :func:`small_tasks`. Not for tables that cost much to read.
    """
    pieces = df.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length(text)).alias("b"))
    n = -(-(pieces.agg(F.max("b")).first()[0] or 0) // part_bytes)
    if n < 2:
        return df
    if n > READINGS:
        return small_tasks(df, text, part_bytes)
    own = F.pmod(F.xxhash64(*df.columns), F.lit(n))
    return reduce(DataFrame.unionAll, [df.filter(own == k) for k in range(n)])


def is_small(df: DataFrame, text_cols: list[str], limit: int = BROADCAST_BYTES) -> bool:
    """Measure a table: the bytes of the named columns plus a fixed cost per row."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in text_cols), F.lit(64))
    size = df.agg(F.sum(width.cast("long")).alias("b")).first()["b"] or 0
    return size <= limit


def broadcast_if_small(df: DataFrame, text_cols: list[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring ``df``; otherwise leave the join to shuffle."""
    return F.broadcast(df) if is_small(df, text_cols, limit) else df
