"""A log-structured n-gram index: sorted bucket runs, published by a manifest, merged by compaction.

Every batch of (ngram, doc_id) rows becomes one run: a folder of sorted files, each of one bucket. A run counts only once a
new version of the manifest names it, so a batch that died half way leaves files that no reader sees, and a batch that is
delivered again is recognised by its id and left out. Compaction writes all live runs as one sorted run and publishes that.

N-grams are many times their texts, so they do not travel: with up to ``FEW_BUCKETS`` buckets every task sorts the rows it
makes and deals them to a file per bucket, and compaction sorts a bucket in ranges that a task holds in memory, a file each. Callers
keep the tasks small (:data:`TEXT_BYTES`). With more buckets such files would be tiny; the rows are exchanged by bucket then.

Runs are partitions of one bucketed Spark table, so a join on the n-gram takes the buckets as they lie: only the other side
is exchanged. One writer at a time; any number of readers. Replaced runs stay until :func:`unpublished_runs` is acted on.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "run string, batches array<string>, rows long, version int"
INFO = "ngram_size int, buckets int, id_type string"
#: Text whose n-grams one task sorts in memory.
TEXT_BYTES = 16 * 1024 * 1024
#: Rows of a bucket that compaction sorts in one task, and n-grams drawn to cut a bucket into such ranges (any cuts give the same rows).
MERGE_ROWS = 2_000_000
CUT_ROWS = 20_000
#: Up to so many buckets every task writes its own file per bucket, all open at once.
FEW_BUCKETS = 64
#: Sorted texts begin alike, which the second writer version makes use of; a dictionary of them would only take memory.
FILES = "compression 'zstd', 'parquet.compression.codec.zstd.level' '6', 'parquet.writer.version' 'v2', 'parquet.enable.dictionary#ngram' 'false'"
#: So many files of a task may be open; with less a task would sort its rows by bucket once more.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
#: Spark reads bucket by bucket only where it sees a use for it, unless the first is off, and joins a bucket's ranges to one task, unless the second is off.
APART = ("spark.sql.sources.bucketing.autoBucketedScan.enabled", "spark.sql.unionOutputPartitioning")


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """Settings of one write."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@dataclass(frozen=True)
class NgramStore:
    """An index of n-grams below ``path``; ``table`` is its bucketed table in the session's catalog."""

    spark: SparkSession
    path: str
    n: int
    buckets: int
    id_type: str
    table: str

    def runs(self) -> list:
        """Live runs of the newest complete manifest: run, batches, rows."""
        try:
            log = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:
            return []
        newest = log.agg(F.max("version")).first()[0]
        # One row per live run; compaction keeps them few.
        return [] if newest is None else [r for r in log.filter(F.col("version") == newest).collect() if r["run"]]

    def version(self) -> int:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def read(self) -> DataFrame:
        """(ngram, doc_id) rows of all published batches, in buckets."""
        self.spark.catalog.refreshTable(self.table)
        live = [r["run"] for r in self.runs()]
        rows = self.spark.table(self.table)
        return rows.filter(F.col("run").isin(live) if live else F.lit(False)).select("ngram", "doc_id")

    def write_run(self, rows: DataFrame, name: str) -> str:
        """Sorted bucket files of a run that nobody sees yet."""
        run = f"{name}-{uuid.uuid4().hex}"
        dealt = rows.select("ngram", F.col("doc_id").cast(self.id_type).alias("doc_id"), F.lit(run).alias("run"))
        if self.buckets > FEW_BUCKETS:
            dealt = dealt.repartition(self.buckets, "ngram")
        self.sort_and_write(dealt)
        return run

    def sort_and_write(self, rows: DataFrame, **settings: str) -> None:
        """Sorted files of every task's rows; a sort by n-gram serves all buckets, for the writer takes them apart."""
        with _settings(rows.sparkSession, **{OPEN_FILES: str(self.buckets + 1)}, **settings):
            rows.sortWithinPartitions("ngram", "doc_id").write.insertInto(self.table)

    def publish(self, runs: list[tuple[str, list[str], int]]) -> None:
        """Make exactly these runs (run, batches, rows) the live ones: a single file, so all of it appears or none."""
        version = self.version() + 1
        # A row without a run keeps an empty list readable.
        rows = self.spark.createDataFrame([("", [], 0), *runs], "run string, batches array<string>, rows long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Add a batch once; False where its id has been published before."""
        live = [(r["run"], list(r["batches"]), r["rows"]) for r in self.runs()]
        if any(str(batch) in batches for _, batches, _ in live):
            return False
        run = self.write_run(rows, "batch")
        self.publish([*live, (run, [str(batch)], self.count(run))])
        return True

    def count(self, run: str) -> int:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table).filter(F.col("run") == run).count()

    def compact(self) -> bool:
        """Merge all live runs into one; every bucket is merged by itself, range by range, without an exchange."""
        live = self.runs()
        if len(live) < 2:
            return False
        run = f"merged-{uuid.uuid4().hex}"
        rows = self.read().select("ngram", "doc_id", F.lit(run).alias("run"))
        at, cuts = F.col("ngram"), self.cuts(live)
        ends = [at.isNull() | (at < cuts[0]), *[(at >= low) & (at < high) for low, high in zip(cuts, cuts[1:])], at >= cuts[-1]] if cuts else [F.lit(True)]
        pieces = [rows.filter(inside) for inside in ends]  # files are sorted: a range reads only the pages that can hold it
        self.sort_and_write(reduce(DataFrame.unionAll, pieces), **dict.fromkeys(APART, "false"))
        batches = sorted({b for r in live for b in r["batches"]})
        found, want = self.count(run), sum(r["rows"] for r in live)
        if found != want:
            raise RuntimeError(f"the merged run has {found} rows instead of {want}")
        self.publish([(run, batches, found)])
        return True

    def cuts(self, live: list) -> list[str]:
        """N-grams that cut a bucket of these runs into ranges of about ``MERGE_ROWS`` rows, drawn from the first bucket."""
        per_bucket = sum(r["rows"] for r in live) / self.buckets
        ranges = math.ceil(per_bucket / MERGE_ROWS)
        if ranges < 2:
            return []
        paths = [f"{self.path}/runs/run={r['run']}" for r in live]
        drawn = self.spark.read.schema("ngram string").option("pathGlobFilter", "*_00000.*").parquet(*paths)
        found = drawn.filter("ngram IS NOT NULL").sample(min(1.0, CUT_ROWS / per_bucket), seed=1).orderBy("ngram").collect()
        return sorted({found[len(found) * k // ranges]["ngram"] for k in range(1, ranges)}) if found else []

    def unpublished_runs(self) -> list[str]:
        """Runs that no reader uses: left by batches that died, or replaced by compaction."""
        self.spark.catalog.refreshTable(self.table)
        there = {r["run"] for r in self.spark.table(self.table).select("run").distinct().collect()}
        return sorted(there - {r["run"] for r in self.runs()})


def _attach(spark: SparkSession, path: str, n: int, buckets: int, id_type: str) -> NgramStore:
    # Not SORTED BY: that would make Spark sort by the hash of the n-gram first. The rows come sorted.
    name = "ngram_store_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (ngram STRING, doc_id {id_type}, run STRING) USING parquet "
        f"OPTIONS ({FILES}) PARTITIONED BY (run) CLUSTERED BY (ngram) INTO {buckets} BUCKETS LOCATION '{path}/runs'"
    )
    return NgramStore(spark, path, n, buckets, id_type, name)


def create_store(spark: SparkSession, path: str, n: int, buckets: int = 500, id_type: str = "bigint") -> NgramStore:
    """An empty index; an existing one is left as it is."""
    try:
        return open_store(spark, path)
    except AnalysisException:
        spark.createDataFrame([(n, buckets, id_type)], INFO).coalesce(1).write.parquet(f"{path}/info")
        return _attach(spark, path, n, buckets, id_type)


def open_store(spark: SparkSession, path: str) -> NgramStore:
    """The index below ``path``, from any session that reaches the folder."""
    info = spark.read.schema(INFO).parquet(f"{path}/info").first()
    return _attach(spark, path, info["ngram_size"], info["buckets"], info["id_type"])
