"""Times the headline queries and prints one JSON line.

The text tables come as one file of one row group each, which a single task would read. They are laid out in several files
first, as a cluster's tables are; that step is timed and counts in the total.
"""

import json
import os
import tempfile
import time

from tallyframe.plans import load_all
from tallyframe.session import build_session

HEADLINE = [
    "pass_at_k", "majority_at_k", "best_of_k_by_reward", "consistency_rate", "attempt_matrix_mean", "task_means",
    "group_rollup_weighted", "f1_averages", "word_ngrams", "contaminated_items", "frequent_ngrams", "contamination_report",
    "clean_corpus", "corpus_bleu", "rouge_n", "token_f1", "normalize_answer", "regex_filter", "filter_fanout",
    "results_consolidate", "compare_runs", "fewshot_random", "batch_requests", "best_threshold_f1", "numeric_equal",
    "check_instructions_strict", "bootstrap_mean_stderr",
]
TEXT_TABLES = ("documents", "pages", "conversations")


def lay_out(spark, sf_dir: str) -> str:
    """A folder with the same tables, the text tables in as many files as there are cores."""
    out = tempfile.mkdtemp(prefix="tallyframe-bench-")
    for file in sorted(os.listdir(sf_dir)):
        name = file.removesuffix(".parquet")
        if name in TEXT_TABLES:
            spark.read.parquet(f"{sf_dir}/{file}").repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{out}/{file}")
        else:
            os.symlink(os.path.abspath(f"{sf_dir}/{file}"), f"{out}/{file}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = build_session("bench")
    queries = load_all().QUERIES
    queries["pass_at_k"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not measured
    start = time.time()
    laid = lay_out(spark, sf_dir)
    times = {"lay_out": round(time.time() - start, 3)}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, laid).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
