"""Queries over several attempts per problem (inventory A21-A28, A40, A42-A44, O5, S10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import attempts as T
from tallyframe.plans import bindings as B
from tallyframe.plans.registry import query

KS = [1, 2, 4]


def pass_sql(k: int, n: str = "n", c: str = "c") -> str:
    """The textbook product over i = n-c+1 .. n."""
    return (
        f"case when {n} - {c} < {k} then 1.0 when {c} = 0 then 0.0 "
        f"else 1.0 - list_product(list_transform(range({n} - {c} + 1, {n} + 1), lambda i: 1.0::double - {k}::double / i)) end"
    )


COUNTS = "select l_orderkey, count(*) as n, count(*) filter (l_returnflag = 'R') as c from lineitem group by l_orderkey"


@query(
    "A24",
    f"with p as ({COUNTS}) select "
    + ", ".join(f"round((select avg({pass_sql(k)}) from p where n >= {k}), 9) as pass_at_{k}" for k in KS),
)
def pass_at_k(spark, sf):
    out = T.pass_at_k(B.attempts(spark, sf), "l_orderkey", F.col("correct"), KS)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "A24 A44",
    f"""with p as (select l_linestatus, l_orderkey, count(*) as n, count(*) filter (l_returnflag = 'R') as c from lineitem group by 1, 2)
        select l_linestatus, """
    + ", ".join(f"round(avg({pass_sql(k)}) filter (n >= {k}), 9) as pass_at_{k}" for k in KS)
    + " from p group by l_linestatus",
)
def pass_at_k_by_type(spark, sf):
    out = T.pass_at_k(B.attempts(spark, sf), "l_orderkey", F.col("correct"), KS, by=["l_linestatus"])
    return out.select("l_linestatus", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query(
    "A24",
    f"""with p as (select l_orderkey, 16 as n, count(*) filter (correct) as c from {B.ATTEMPTS_SQL} where attempt <= 16 group by 1)
        select """
    + ", ".join(f"round(avg({pass_sql(k)}), 9) as pass_at_{k}" for k in (1, 2, 4, 8, 16))
    + " from p",
)
def pass_at_k_report(spark, sf):
    out = T.pass_at_k_padded(
        B.attempts(spark, sf), "l_orderkey", [F.col(c) for c in B.ATTEMPT_ORDER], F.col("correct"), [1, 2, 4, 8, 16]
    )
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


MATRIX = ", ".join(f"max(case when attempt = {i} then correct::int else 0 end) as attempt_{i}" for i in range(1, 17))


@query("S10 A24", f"select l_orderkey, {MATRIX} from {B.ATTEMPTS_SQL} where attempt <= 16 group by l_orderkey")
def attempt_matrix(spark, sf):
    from tallyframe.operators.ordering import first_k

    kept = first_k(B.attempts(spark, sf), ["l_orderkey"], [F.col(c) for c in B.ATTEMPT_ORDER], 16, "attempt")
    return T.attempt_matrix(kept, ["l_orderkey"], "attempt", "correct")


@query(
    "A25 O4",
    f"""with p as (select l_orderkey, max(correct::int) as hit from {B.ATTEMPTS_SQL} where attempt <= 3 group by 1)
        select round(avg(hit), 9) as pass_any_3, round(avg(hit) * 100, 1) as acc_pass from p""",
)
def pass_any_k(spark, sf):
    out = T.pass_any_k(B.attempts(spark, sf), "l_orderkey", [F.col(c) for c in B.ATTEMPT_ORDER], F.col("correct"), 3)
    return out.withColumn("pass_any_3", F.round("pass_any_3", 9))


@query(
    "A26 H5",
    f"""with v as (select l_orderkey, l_returnflag, count(*) as votes, min(attempt) as first_seen from {B.ATTEMPTS_SQL} group by 1, 2)
        select l_orderkey, l_returnflag as answer, votes from v
        qualify row_number() over (partition by l_orderkey order by votes desc, first_seen) = 1""",
)
def majority_vote(spark, sf):
    seen = F.struct(*B.ATTEMPT_ORDER)
    return T.majority_votes(B.attempts(spark, sf), ["l_orderkey"], "l_returnflag", seen).drop("first_seen")


@query(
    "A26",
    f"""with k as (select * from {B.ATTEMPTS_SQL} where attempt <= 4),
        v as (select l_orderkey, l_returnflag, count(*) as votes, min(attempt) as first_seen, min_by(correct, attempt) as ok from k group by 1, 2),
        w as (select l_orderkey, ok from v qualify row_number() over (partition by l_orderkey order by votes desc, first_seen) = 1)
        select round(avg(ok::int), 9) as maj_at_4 from w""",
)
def majority_at_k(spark, sf):
    out = T.majority_at_k(B.attempts(spark, sf), "l_orderkey", B.ATTEMPT_ORDER, "l_returnflag", "correct", 4)
    return out.select(F.round("maj_at_4", 9).alias("maj_at_4"))


@query(
    "A27",
    f"""with w as (select l_orderkey, correct from {B.ATTEMPTS_SQL} where attempt <= 4
        qualify row_number() over (partition by l_orderkey order by l_extendedprice desc, attempt) = 1)
        select round(avg(correct::int), 9) as rm_at_4 from w""",
)
def best_of_k_by_reward(spark, sf):
    out = T.best_of_k_by_reward(B.attempts(spark, sf), "l_orderkey", B.ATTEMPT_ORDER, "l_extendedprice", "correct", 4)
    return out.select(F.round("rm_at_4", 9).alias("rm_at_4"))


@query(
    "A28",
    f"""with p as (select l_orderkey, count(*) as n, sum(correct::int) as s, max_by(correct::int, attempt) as l,
        max_by(l_linestatus, attempt) as lp, max(correct::int) as hit from {B.ATTEMPTS_SQL} group by 1), w as (select max(n) as w from p)
        select count(*) as num_samples, sum(n)::bigint as num_scores, count(*) filter (lp = '') as empty_samples,
        round(sum(s + l * (w - n)) / (max(w) * count(*)) * 100, 1) as acc, round(avg(hit) * 100, 1) as acc_pass from p, w""",
)
def attempt_matrix_mean(spark, sf):
    a = B.attempts(spark, sf)
    return T.attempt_matrix_mean(a, "l_orderkey", F.struct(*B.ATTEMPT_ORDER), F.col("correct"), F.col("l_linestatus"))


@query(
    "A28",
    f"""with p as (select l_orderkey, max_by(l_linestatus, attempt) as t, max_by(correct::int, attempt) as s from {B.ATTEMPTS_SQL} group by 1)
        select t as l_linestatus, round(avg(s) * 100, 1) as acc from p group by t""",
)
def last_attempt_accuracy(spark, sf):
    return T.last_attempt_accuracy_by(
        B.attempts(spark, sf), "l_orderkey", "l_linestatus", F.struct(*B.ATTEMPT_ORDER), F.col("correct")
    )


@query(
    "A21",
    """with c as (select l_orderkey, l_returnflag, count(*) as c from lineitem group by 1, 2),
       q as (select l_orderkey, sum(c * (c - 1) / 2) as same, sum(c) as n from c group by 1)
       select round(sum(same) / sum(n * (n - 1) / 2), 9) as consistency_rate from q""",
)
def consistency_rate(spark, sf):
    out = T.consistency_rate(B.attempts(spark, sf), ["l_orderkey"], "l_returnflag")
    return out.select(F.round("consistency_rate", 9).alias("consistency_rate"))


OPTION_SQL = """(select l_orderkey, case l_returnflag when 'R' then 'A' when 'A' then 'B' else 'C' end as answer,
  ['A', 'B', 'C'][(l_linenumber % 3) + 1] as moved, ['A', 'B', 'C'][(l_orderkey % 3) + 1] as original from lineitem)"""


@query(
    "A22",
    f"""with m as (select l_orderkey, case when answer in (moved, original) then original else answer end as a from {OPTION_SQL}),
        c as (select l_orderkey, a, count(*) as c from m group by 1, 2),
        q as (select l_orderkey, sum(c * (c - 1) / 2) as same, sum(c) as n from c group by 1)
        select round(sum(same) / sum(n * (n - 1) / 2), 9) as consistency_rate from q""",
)
def option_consistency_rate(spark, sf):
    labels = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    f = F.col("l_returnflag")
    a = B.attempts(spark, sf).select(
        "l_orderkey",
        F.when(f == "R", "A").when(f == "A", "B").otherwise("C").alias("answer"),
        F.get(labels, F.col("l_linenumber") % 3).alias("moved"),
        F.get(labels, (F.col("l_orderkey") % 3).cast("int")).alias("original"),
    )
    out = T.option_consistency_rate(a, ["l_orderkey"], "answer", "moved", "original")
    return out.select(F.round("consistency_rate", 9).alias("consistency_rate"))


@query(
    "A23",
    """with c as (select l_linenumber, l_linestatus, avg((l_returnflag = 'R')::int) as a from lineitem group by 1, 2)
       select l_linenumber as prompt_id, round(avg(a), 4) as accuracy from c group by 1""",
)
def accuracy_by_variant(spark, sf):
    a = B.attempts(spark, sf).withColumnRenamed("l_linenumber", "prompt_id")
    return T.accuracy_by_variant(a, ["prompt_id"], "l_linestatus", F.col("correct"))


@query(
    "A40",
    """with p as (select o_orderpriority as d, (o_orderstatus = 'F')::int as s from orders)
       select d as difficulty, round(avg(s), 9) as pass_at_1 from p group by d
       union all select 'all', round(avg(s), 9) from p""",
)
def pass_rate_by_difficulty(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("s"))
    return T.pass_rate_by_difficulty(o, "o_orderpriority", "s").withColumn("pass_at_1", F.round("pass_at_1", 9))


@query(
    "A42",
    """with r as (select p_brand, p_type, case when p_size <= 25 then 0.2 else 0.8 end as t, avg(p_retailprice) as pass_at_1,
       max(p_retailprice) as pass_at_5 from part group by 1, 2, 3)
       select p_brand as model, p_type as mode, round(max(case when t = 0.2 then pass_at_1 end), 6) as p1,
       round(max(case when t = 0.8 then pass_at_5 end), 6) as p5 from r group by 1, 2 order by 1, 2""",
)
def temperature_table(spark, sf):
    p = B.table(spark, sf, "part")
    runs = p.groupBy(
        F.col("p_brand").alias("model"), F.col("p_type").alias("mode"), F.when(F.col("p_size") <= 25, 0.2).otherwise(0.8).alias("t")
    ).agg(F.avg("p_retailprice").alias("pass_at_1"), F.max("p_retailprice").alias("pass_at_5"))
    out = T.temperature_table(runs, ["model", "mode"], "t", [(0.2, "pass_at_1"), (0.8, "pass_at_5")])
    return out.select("model", "mode", F.round("`pass_at_1_t0.2`", 6).alias("p1"), F.round("`pass_at_5_t0.8`", 6).alias("p5"))


@query("A43", "select round(avg((event_type <> 'error')::int), 9) as rate, avg((event_type <> 'error')::int) <= 0.99 as warn from events")
def ground_truth_rate(spark, sf):
    e = B.table(spark, sf, "events").withColumn("status", F.when(F.col("event_type") != "error", "pass").otherwise("fail"))
    return T.ground_truth_rate(e, "status").withColumn("rate", F.round("rate", 9))


PROGRESS_SQL = """(select case when p_size % 4 = 0 then p_type else p_type || '_' || (p_size * 10) end as model, p_retailprice as score from part)"""


@query(
    "A44",
    f"""with m as (select *, regexp_matches(model, '^(SMALL|ECONOMY|PROMO)_') as trained from {PROGRESS_SQL})
        select trained, case when trained then split_part(model, '_', 1) else model end as model_type,
        case when trained then try_cast(split_part(model, '_', 2) as int) end as step, round(avg(score), 6) as score
        from m group by 1, 2, 3""",
)
def checkpoint_progress(spark, sf):
    p = B.table(spark, sf, "part")
    name = F.when(F.col("p_size") % 4 == 0, F.col("p_type")).otherwise(F.concat_ws("_", "p_type", (F.col("p_size") * 10).cast("string")))
    runs = p.select(name.alias("model"), F.col("p_retailprice").alias("score"))
    return T.checkpoint_progress(runs, "model", ["SMALL", "ECONOMY", "PROMO"], ["score"]).withColumn("score", F.round("score", 6))


@query(
    "O5",
    """select l_orderkey, l_linenumber, l_partkey, l_returnflag as status from lineitem
       where l_orderkey in (select l_orderkey from lineitem where l_returnflag <> 'N')""",
)
def failing_problems(spark, sf):
    li = B.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_returnflag") == "N", "pass").otherwise("fail").alias("status"),
    )
    return T.failing_problems(li, "l_orderkey", "status").select("l_orderkey", "l_linenumber", "l_partkey", F.col("flag").alias("status"))
