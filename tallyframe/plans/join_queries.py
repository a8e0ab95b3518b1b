"""Queries over joins of samples, runs, caches and corrections (inventory J6-J11, A30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import joins as J
from tallyframe.operators.bootstrap import bootstrap_stderr
from tallyframe.plans import bindings as B
from tallyframe.plans.registry import query


def solutions(spark, sf):
    return B.table(spark, sf, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("completion_id"), "o_orderstatus")


def problems(spark, sf):
    """All customers, with every seventh key moved out of the orders' key range, so that both sides miss some."""
    key = F.col("c_custkey")
    return B.table(spark, sf, "customer").select(F.when(key % 7 == 0, -key).otherwise(key).alias("task_id"), "c_mktsegment")


PROBLEMS = "(select case when c_custkey % 7 = 0 then -c_custkey else c_custkey end as task_id, c_mktsegment from customer)"
SOLUTIONS = "(select o_custkey as task_id, o_orderkey as completion_id, o_orderstatus from orders)"


@query("J6", f"select task_id, completion_id, o_orderstatus, c_mktsegment from {SOLUTIONS} join {PROBLEMS} using (task_id)")
def join_solutions(spark, sf):
    return J.join_solutions(solutions(spark, sf), problems(spark, sf), "task_id")


@query("J6 U3", f"select task_id, completion_id from {SOLUTIONS} where task_id not in (select task_id from {PROBLEMS})")
def unknown_samples(spark, sf):
    return J.unknown_samples(solutions(spark, sf), problems(spark, sf), "task_id").select("task_id", "completion_id")


@query("J6 U3", f"select task_id, c_mktsegment from {PROBLEMS} where task_id not in (select task_id from {SOLUTIONS})")
def missing_problems(spark, sf):
    return J.missing_problems(solutions(spark, sf), problems(spark, sf), "task_id")


@query("J6", f"select task_id, count(completion_id) as n, count(completion_id) >= 10 as complete from {PROBLEMS} p left join {SOLUTIONS} s using (task_id) group by task_id")
def completeness(spark, sf):
    return J.completeness(solutions(spark, sf), problems(spark, sf), "task_id", 10)


RUNS_SQL = "(select l_orderkey as question, l_linestatus as category, l_linenumber as seed, max(l_returnflag) as answer, 'R' as gold from lineitem group by 1, 2, 3)"


def runs(spark, sf):
    li = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("question"), F.col("l_linestatus").alias("category"), F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("answer")
    )
    return li.groupBy("question", "category", "seed").agg(F.max("answer").alias("answer"), F.lit("R").alias("gold"))


@query(
    "J7",
    f"select question, category, max(gold) as gold, " + ", ".join(f"max(case when seed = {i} then answer end) as answer_{i}" for i in range(1, 8))
    + f" from {RUNS_SQL} group by 1, 2",
)
def merge_seed_runs(spark, sf):
    return J.merge_seed_runs(runs(spark, sf), ["question", "category"], "seed", list(range(1, 8)), "answer", "gold")


@query("J7 A23", f"with c as (select seed, category, avg((answer = gold)::int) as a from {RUNS_SQL} group by 1, 2) select seed, round(avg(a), 4) as accuracy from c group by seed")
def seed_accuracy(spark, sf):
    return J.seed_accuracy(runs(spark, sf), "seed", "category", "answer", "gold")


def two_runs(spark, sf):
    from tallyframe.operators.groups import task_scores

    e = B.table(spark, sf, "events").withColumnRenamed("event_type", "task")
    return [task_scores(e.filter(F.col("event_id") % 2 == i), ["task"], "value") for i in (0, 1)]


HALF = "select event_type as task, avg(value) as value, stddev_samp(value) / sqrt(count(*)) as stderr from events where event_id % 2 = {} group by 1"
POLY = str(J.ERFC[-1])
for _c in reversed(J.ERFC[:-1]):
    POLY = f"({_c} + t * {POLY})"


@query(
    "J8",
    f"""with a as ({HALF.format(0)}), b as ({HALF.format(1)}),
        z as (select task, (a.value - b.value) / sqrt(a.stderr * a.stderr + b.stderr * b.stderr) as z from a join b using (task)),
        t as (select *, abs(z) / sqrt(2.0) as x, 1.0 / (1.0 + 0.5 * abs(z) / sqrt(2.0)) as t from z)
        select task, round(z, 6) as z, round(t * exp(-x * x + {POLY}), 6) as p_value, t * exp(-x * x + {POLY}) > 0.05 as same from t""",
)
def compare_runs(spark, sf):
    a, b = two_runs(spark, sf)
    return J.compare_runs(a, b, "task").select("task", F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"), "same")


@query(
    "J8",
    f"""with a as ({HALF.format(0)}), b as ({HALF.format(1)}), d as (select task, 100 * b.value - 100 * a.value as d from a join b using (task))
        select task, case when d > 0 then printf('**+%.2f**', d) else printf('%.2f', d) end as diff from d""",
)
def diff_runs(spark, sf):
    a, b = two_runs(spark, sf)
    return J.diff_runs(a, b, "task").select("task", "diff")


def requests_and_cache(spark, sf):
    c = B.table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", (F.col("turn") % 3 == 2).alias("do_sample"), J.request_key(F.lit("generate_until"), F.col("text")).alias("key")
    )
    stored = c.filter(F.col("conv_id") % 2 == 0).select("key", F.length("text").alias("response")).dropDuplicates(["key"])
    return c, stored


@query(
    "J9",
    """with k as (select distinct text from conversations where conv_id % 2 = 0) select conv_id, turn, length(text)::int as response from conversations
       where turn % 3 <> 2 and text in (select text from k)""",
)
def cache_hits(spark, sf):
    c, stored = requests_and_cache(spark, sf)
    return J.cache_hits(c, stored, F.col("do_sample")).select("conv_id", "turn", "response")


@query(
    "J9",
    """with k as (select distinct text from conversations where conv_id % 2 = 0) select conv_id, turn from conversations
       where turn % 3 = 2 or text not in (select text from k)""",
)
def cache_misses(spark, sf):
    c, stored = requests_and_cache(spark, sf)
    return J.cache_misses(c, stored, F.col("do_sample")).select("conv_id", "turn")


@query("J10", "select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def resume_remaining(spark, sf):
    done = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.resume_remaining(B.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query(
    "J10 U5",
    """select c_custkey, coalesce(n.v, c_mktsegment) as v from customer left join (select o_custkey, max(o_orderstatus) as v from orders group by 1) n on o_custkey = c_custkey""",
)
def append_results(spark, sf):
    old = B.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    new = B.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("v"))
    return J.append_results(old, new, ["c_custkey"])


@query(
    "J11",
    """select p_partkey, case when s_suppkey is not null then s_name else p_brand end as answer from part left join supplier on p_partkey = s_suppkey""",
)
def fix_answers(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("answer"))
    fixes = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("answer"))
    return J.fix_answers(p, fixes, "p_partkey", "answer")


@query(
    "A30",
    "select event_type as task, count(value) as n, round(stddev_pop(value) / sqrt(count(value)), 6) as formula, true as agrees from events group by 1",
)
def bootstrap_mean_stderr(spark, sf):
    """The bootstrap error of the mean beside its formula; they have to agree within ``AGREE``."""
    e = B.table(spark, sf, "events").withColumnRenamed("event_type", "task")
    boot = bootstrap_stderr(e, ["task"], {"value": F.col("value")}, lambda s: s["value"] / s["n"], iters=200)
    formula = e.groupBy("task").agg(F.count("value").alias("n"), (F.stddev_pop("value") / F.sqrt(F.count("value"))).alias("formula"))
    return agreeing(formula.join(boot, "task"), "task")


def agreeing(both, *keys):
    near = F.abs(F.col("stderr") / F.col("formula") - 1) < B.AGREE
    return both.select(*keys, "n", F.round("formula", 6).alias("formula"), near.alias("agrees"))


@query(
    "A30",
    f"""with s as (select sum(gold * pred)::double as tp, sum(gold + pred)::double as tot, count(*) as n from {B.GOLD_PRED_SQL}),
        f as (select 2 * tp / tot as f1, tot, n from s)
        select 'labels' as task, any_value(n) as n, round(sqrt(sum(pow((2 * gold * pred - f1 * (gold + pred)) / tot, 2))), 6) as formula, true as agrees from {B.GOLD_PRED_SQL}, f""",
)
def bootstrap_f1_stderr(spark, sf):
    """The bootstrap error of F1 beside the delta method's."""
    g = B.gold_pred(spark, sf).withColumn("task", F.lit("labels"))
    both, gold, pred = (F.col("gold") * F.col("pred")), F.col("gold"), F.col("pred")
    boot = bootstrap_stderr(g, ["task"], {"tp": both, "t": gold, "p": pred}, lambda s: 2 * s["tp"] / (s["t"] + s["p"]), iters=200)
    # Sums of squares and products of the two counts give the error without a second pass.
    x, y = 2 * both, gold + pred
    s = g.groupBy("task").agg(*[F.sum(e.cast("double")).alias(c) for c, e in {"x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}.items()], F.count("*").alias("n"))
    f1 = F.col("x") / F.col("y")
    formula = s.select("task", "n", (F.sqrt(F.col("xx") - 2 * f1 * F.col("xy") + f1 * f1 * F.col("yy")) / F.col("y")).alias("formula"))
    return agreeing(formula.join(boot, "task"), "task")
