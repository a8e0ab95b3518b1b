"""Queries over metric aggregates (inventory A1-A23, A29-A39)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import aggregates as A
from tallyframe.operators import groups as G
from tallyframe.operators.ordering import dense_index
from tallyframe.plans import bindings as B
from tallyframe.plans.registry import query


@query(
    "A1 A2 A3 A29",
    """select event_type as task, round(avg(value), 6) as mean,
       round(avg(case when value < 100 then value end), 6) as nanmean,
       round(count(value) / sum(1 / (value + 0.01)), 6) as harmonic,
       round(stddev_pop(value), 6) as pop_stddev, round(stddev_samp(value), 6) as sample_stddev,
       round(stddev_samp(value) / sqrt(count(value)), 6) as stderr
       from events group by event_type""",
)
def task_means(spark, sf):
    e = B.table(spark, sf, "events").withColumn("v", F.when(F.col("value") < 100, F.col("value")).otherwise(F.lit(float("nan"))))
    r = lambda c, name: F.round(c, 6).alias(name)
    return e.groupBy(F.col("event_type").alias("task")).agg(
        r(A.mean("value"), "mean"),
        r(A.nanmean("v"), "nanmean"),
        r(A.harmonic("value"), "harmonic"),
        r(A.pop_stddev("value"), "pop_stddev"),
        r(A.sample_stddev("value"), "sample_stddev"),
        r(A.mean_stderr("value"), "stderr"),
    )


@query(
    "A4",
    """select event_type as task, list(value order by event_id)[(count(*) // 2) + 1] as median
       from events group by event_type""",
)
def arrival_median(spark, sf):
    e = B.table(spark, sf, "events").withColumnRenamed("event_type", "task")
    return A.arrival_median(e, ["task"], "event_id", "value")


@query(
    "A5 A6 A7 H11 P17",
    """with r as (select lang, -0.7 * n_chars as ll, len(string_split_regex(text, '\\s+')) as words,
                 octet_length(encode(text)) as bytes from documents)
       select lang, round(exp(-avg(ll / 1000)), 6) as perplexity,
       round(exp(-sum(ll) / sum(words)), 6) as word_perplexity, round(exp(-sum(ll) / sum(bytes)), 6) as byte_perplexity,
       round(-(sum(ll) / sum(bytes)) / ln(2), 6) as bits_per_byte from r group by lang""",
)
def rolling_perplexity(spark, sf):
    from tallyframe.functions.likelihood import count_bytes, count_words

    d = B.table(spark, sf, "documents").select(
        "lang",
        (F.lit(-0.7) * F.col("n_chars")).alias("ll"),
        count_words(F.col("text")).alias("w"),
        count_bytes(F.col("text")).alias("b"),
    )
    r = lambda c, name: F.round(c, 6).alias(name)
    return d.groupBy("lang").agg(
        r(A.perplexity(F.col("ll") / 1000), "perplexity"),
        r(A.weighted_perplexity("ll", "w"), "word_perplexity"),
        r(A.weighted_perplexity("ll", "b"), "byte_perplexity"),
        r(A.bits_per_byte("ll", "b"), "bits_per_byte"),
    )


CELLS = """with c as (select gold, pred, count(*) as n from {src} group by gold, pred),
  k as (select distinct unnest([gold, pred]) as cls from c),
  q as (select cls, (select coalesce(sum(n), 0) from c where gold = cls and pred = cls) as tp,
               (select coalesce(sum(n), 0) from c where gold = cls) as t,
               (select coalesce(sum(n), 0) from c where pred = cls) as p from k),
  f as (select *, 2.0 * tp / (t + p) as f1 from q)"""


@query(
    "A8",
    f"""select round(2.0 * count(*) filter (gold = 1 and pred = 1) /
        (2 * count(*) filter (gold = 1 and pred = 1) + count(*) filter (gold <> pred)), 9) as f1 from {B.GOLD_PRED_SQL}""",
)
def binary_f1(spark, sf):
    return B.gold_pred(spark, sf).agg(F.round(A.binary_f1("gold", "pred"), 9).alias("f1"))


PRIORITY_SQL = """(select o_orderkey, o_orderstatus as gold,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'F' when o_orderpriority = '3-MEDIUM' then 'O' else 'P' end as pred
  from orders)"""


def status_guess(spark, sf):
    p = F.col("o_orderpriority")
    guess = F.when(p.isin("1-URGENT", "2-HIGH"), "F").when(p == "3-MEDIUM", "O").otherwise("P")
    return B.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("gold"), guess.alias("pred"))


@query(
    "A9",
    CELLS.format(src=PRIORITY_SQL)
    + """ select round(avg(f1), 9) as f1_macro, round(2.0 * sum(tp) / (sum(t) + sum(p)), 9) as f1_micro,
         round(sum(f1 * t) / sum(t), 9) as f1_weighted from f""",
)
def f1_averages(spark, sf):
    out = A.f1_averages(status_guess(spark, sf), "gold", "pred")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "A9",
    CELLS.format(src=PRIORITY_SQL) + " select cls, tp::bigint as tp, t::bigint as t, p::bigint as p, round(f1, 9) as f1 from f",
)
def class_f1(spark, sf):
    return A.class_f1(status_guess(spark, sf), "gold", "pred").withColumn("f1", F.round("f1", 9))


@query("A9", CELLS.format(src=PRIORITY_SQL) + " select round(sum(f1) / 2, 9) as f1_macro from f where cls in ('F', 'P')")
def f1_label_subset(spark, sf):
    return A.f1_averages(status_guess(spark, sf), "gold", "pred", labels=["F", "P"]).select(F.round("f1_macro", 9).alias("f1_macro"))


@query("A9 H32", CELLS.format(src=PRIORITY_SQL) + " select round(avg(f1), 9) as f1 from f where cls < (select max(cls) from f)")
def f1_without_last_class(spark, sf):
    out = A.f1_without_last_class(status_guess(spark, sf), "gold", "pred")
    return out.select(F.round("f1", 9).alias("f1"))


@query(
    "A10",
    CELLS.format(src=PRIORITY_SQL)
    + """ select round((sum(tp) * sum(t) - sum(t * p)) /
         sqrt((sum(t) * sum(t) - sum(p * p))::double * (sum(t) * sum(t) - sum(t * t))), 9) as mcc from f""",
)
def matthews(spark, sf):
    return A.matthews(status_guess(spark, sf), "gold", "pred").select(F.round("mcc", 9).alias("mcc"))


@query(
    "A13",
    f"""with p as (select gold, list_transform(lls, lambda x: exp(x) / list_sum(list_transform(lls, lambda y: exp(y)))) as probs
        from {B.choice_scores_sql()})
        select gold as label, round(avg(list_sum(list_transform(probs, lambda q, i: pow(q - (case when i - 1 = gold then 1 else 0 end), 2)))), 6) as brier
        from p group by gold""",
)
def brier_score(spark, sf):
    from tallyframe.functions.likelihood import softmax

    c = B.choice_scores(spark, sf).withColumn("probs", softmax(F.col("lls")))
    return c.groupBy(F.col("gold").alias("label")).agg(F.round(A.brier(F.col("probs"), F.col("gold")), 6).alias("brier"))


@query(
    "A14",
    """with p as (select l_orderkey, l_linenumber, min((l_returnflag <> 'R')::int) as ok from lineitem group by 1, 2),
       q as (select l_linenumber, min(ok) as ok from p group by 1)
       select (select round(avg(ok), 9) from p) as acc_all,
              (select round(stddev_samp(ok) / sqrt(count(*)), 9) from q) as acc_all_stderr""",
)
def all_answers_right(spark, sf):
    li = B.table(spark, sf, "lineitem")
    out = A.acc_all(li, "l_orderkey", "l_linenumber", F.col("l_returnflag") != "R")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


BIAS_SQL = """(select event_type as category, (value > 20)::int::double as acc,
  case when value < 50 then (event_id % 3 = 0)::int::double end as biased,
  case when value < 50 then (event_id % 7 <> 0)::int::double end as non_unknown, user_id % 2 = 0 as disambiguated from events)"""


@query(
    "A17 A18",
    f"""with s as (select category, avg(acc) as acc, avg(acc) filter (not disambiguated) as aa, avg(acc) filter (disambiguated) as ad,
        sum(biased) filter (disambiguated) as bd, sum(non_unknown) filter (disambiguated) as nd,
        sum(biased) filter (not disambiguated) as ba, sum(non_unknown) filter (not disambiguated) as na from {BIAS_SQL} group by category)
        select category, round(acc, 9) as acc, round(aa, 9) as accuracy_amb, round(ad, 9) as accuracy_disamb,
        round(case when bd = 0 then 0 else 2.0 * bd / nd - 1 end, 9) as disamb_bias_score,
        round((1 - aa) * case when ba = 0 then 0 else 2.0 * ba / na - 1 end, 9) as amb_bias_score from s""",
)
def bias_scores(spark, sf):
    known = F.col("value") < 50
    e = B.table(spark, sf, "events").select(
        F.col("event_type").alias("category"),
        (F.col("value") > 20).cast("double").alias("acc"),
        F.when(known, (F.col("event_id") % 3 == 0).cast("double")).alias("biased"),
        F.when(known, (F.col("event_id") % 7 != 0).cast("double")).alias("non_unknown"),
        (F.col("user_id") % 2 == 0).alias("disambiguated"),
    )
    out = A.bias_scores(e, ["category"])
    return out.select("category", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query(
    "A19",
    """select lang, round(sum(len(list_filter(f, lambda x: x))) / sum(len(f)), 9) as flag_mean
       from (select lang, [n_chars > 500, contains(text, ','), contains(text, 'the')] as f from documents) group by lang""",
)
def instance_flag_mean(spark, sf):
    d = B.table(spark, sf, "documents")
    flags = F.array(F.col("n_chars") > 500, F.col("text").contains(","), F.col("text").contains("the"))
    return d.groupBy("lang").agg(F.round(A.flag_mean(flags), 9).alias("flag_mean"))


@query(
    "A20",
    """select n_chars // 1000 * 1000 as max_length, round(avg(s), 9) as score from
       (select n_chars, case when doc_id % 4 = 0 then -1 else (doc_id % 10) / 10.0 end as s from documents)
       where s <> -1 group by 1""",
)
def length_bucket_mean(spark, sf):
    d = B.table(spark, sf, "documents").select(
        (F.floor(F.col("n_chars") / 1000) * 1000).alias("max_length"),
        F.when(F.col("doc_id") % 4 == 0, -1.0).otherwise((F.col("doc_id") % 10) / 10.0).alias("s"),
    )
    return A.length_bucket_mean(d, "max_length", "s").withColumn("score", F.round("score", 9))


TREE = {
    "cte": """with e as (select c_nationkey as task, avg(c_acctbal) as value, stddev_samp(c_acctbal) / sqrt(count(*)) as stderr,
              count(*) as n from customer group by 1),
              g as (select r_name as grp, n_nationkey as task from nation join region on n_regionkey = r_regionkey
                    union all select 'WORLD', n_nationkey from nation),
              j as (select * from g join e using (task))""",
}


def nation_scores(spark, sf):
    c = B.table(spark, sf, "customer").withColumnRenamed("c_nationkey", "task")
    return G.task_scores(c, ["task"], "c_acctbal")


def nation_edges(spark, sf):
    n, r = B.table(spark, sf, "nation"), B.table(spark, sf, "region")
    inner = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("group"), F.col("n_nationkey").alias("task"))
    return inner.unionByName(n.select(F.lit("WORLD").alias("group"), F.col("n_nationkey").alias("task")))


@query(
    "A31 A32",
    TREE["cte"]
    + """ select grp as "group", round(sum(value * n) / sum(n), 6) as value,
         round(sqrt(sum((n - 1) * stderr * stderr * n) / (sum(n) - count(*)) / sum(n)), 6) as stderr, sum(n)::bigint as n
         from j group by grp""",
)
def group_rollup_weighted(spark, sf):
    out = G.group_rollup(nation_scores(spark, sf), nation_edges(spark, sf))
    return out.select("group", F.round("value", 6).alias("value"), F.round("stderr", 6).alias("stderr"), "n")


@query(
    "A31",
    TREE["cte"] + """ select grp as "group", round(count(*) / sum(1 / (value + 0.01)), 6) as value from j group by grp""",
)
def group_rollup_harmonic(spark, sf):
    out = G.group_rollup(nation_scores(spark, sf), nation_edges(spark, sf), "harmonic", weight_by_size=False)
    return out.select("group", F.round("value", 6).alias("value"))


@query(
    "A31",
    TREE["cte"]
    + """ select grp as "group", round(max(value) - min(value), 6) as spread, round(avg(value), 6) as value from j group by grp""",
)
def group_rollup_difference(spark, sf):
    spread = F.max("value") - F.min("value")
    out = G.group_rollup(nation_scores(spark, sf), nation_edges(spark, sf), weight_by_size=False, extra={"spread": spread})
    return out.select("group", F.round("spread", 6).alias("spread"), F.round("value", 6).alias("value"))


SEGMENT_TREE = """with c as (select r_name, n_name, n_name || '/' || c_mktsegment as task, c_acctbal as v from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
  s as (select r_name, n_name, task, avg(v) as value, stddev_samp(v) / sqrt(count(*)) as stderr, count(*) as n from c group by all),
  j as (select unnest(['WORLD', r_name, n_name]) as grp, * from s)"""


def segment_edges(spark, sf):
    """A tree of three levels as a table: the world, regions, nations, and the nations' market segments."""
    n, r = B.table(spark, sf, "nation"), B.table(spark, sf, "region")
    pair = lambda df, a, b: df.select(a.alias("group"), b.alias("task"))
    nations = n.join(r, n.n_regionkey == r.r_regionkey)
    segments = B.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.concat_ws("/", "n_name", "c_mktsegment").alias("task")).distinct()
    return (
        pair(r, F.lit("WORLD"), F.col("r_name")).unionByName(pair(nations, F.col("r_name"), F.col("n_name")))
        .unionByName(pair(segments, F.col("n_name"), F.col("task")))
    )


@query(
    "A31 A32 A34",
    SEGMENT_TREE
    + """ select grp as "group", round(sum(value * n) / sum(n), 6) as value,
         case when count(stderr) = count(*) then round(sqrt(sum((n - 1) * stderr * stderr * n) / (sum(n) - count(*)) / sum(n)), 6) end as stderr,
         sum(n)::bigint as n, count(*) as n_tasks from j group by grp""",
)
def tree_rollup(spark, sf):
    n = B.table(spark, sf, "nation")
    c = B.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("task", F.concat_ws("/", "n_name", "c_mktsegment"))
    out = G.group_rollup(G.task_scores(c, ["task"], "c_acctbal"), G.leaf_edges(segment_edges(spark, sf)), extra={"n_tasks": F.count("*")})
    return out.select("group", F.round("value", 6).alias("value"), F.round("stderr", 6).alias("stderr"), "n", "n_tasks")


@query(
    "O2 A31",
    """with s as (select distinct r_name, n_name, n_name || '/' || c_mktsegment as task from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
       p as (select ['WORLD'] as p union all select ['WORLD', r_name] from region union all select ['WORLD', r_name, n_name] from nation join region on n_regionkey = r_regionkey
             union all select ['WORLD', r_name, n_name, task] from s)
       select array_to_string(p, ' > ') as path, (len(p) - 1)::int as depth, repeat(' ', len(p) - 1) || case when len(p) > 1 then '- ' else '' end || p[-1] as alias,
       row_number() over (order by p) as place from p""",
)
def tree_places(spark, sf):
    """Every place of the tree with its indented name, numbered in tree order."""
    rows = G.tree_order(segment_edges(spark, sf)).select("path", "depth", "alias")
    return dense_index(rows, ["path"], "at").select(F.array_join("path", " > ").alias("path"), "depth", "alias", (F.col("at") + 1).alias("place"))


@query(
    "A33",
    TREE["cte"]
    + """ select grp as "group", round(sqrt((sum((n - 1) * stderr * stderr) + sum(n * value * value) - pow(sum(n * value), 2) / sum(n))
         / (sum(n) - 1)), 6) as combined from j group by grp""",
)
def combined_stderr(spark, sf):
    joined = nation_edges(spark, sf).join(nation_scores(spark, sf), "task")
    n = F.col("n").cast("double")
    return joined.groupBy("group").agg(F.round(G.combined_stderr(F.col("stderr"), n, F.col("value")), 6).alias("combined"))


@query(
    "A34",
    """with s as (select event_type as task, 'value' as metric, 'none' as filter, value from events
       union all select event_type, 'flag', 'strict', (value > 10)::int::double from events),
       t as (select event_type as task, 1 as version, 0 as n_shot, count(*) as n_original, event_type <> 'error' as higher_is_better
             from events group by event_type)
       select task, metric, filter, round(avg(value), 6) as value, round(stddev_samp(value) / sqrt(count(*)), 6) as stderr,
       count(*) as n_effective, any_value(version) as version, any_value(n_shot) as n_shot, any_value(n_original) as n_original,
       any_value(higher_is_better) as higher_is_better from s join t using (task) group by task, metric, filter""",
)
def results_consolidate(spark, sf):
    e = B.table(spark, sf, "events").withColumnRenamed("event_type", "task")
    a = e.select("task", F.lit("value").alias("metric"), F.lit("none").alias("filter"), "value")
    b = e.select("task", F.lit("flag").alias("metric"), F.lit("strict").alias("filter"), (F.col("value") > 10).cast("double").alias("value"))
    tasks = e.groupBy("task").agg(F.count("*").alias("n_original")).select(
        "task", F.lit(1).alias("version"), F.lit(0).alias("n_shot"), "n_original", (F.col("task") != "error").alias("higher_is_better")
    )
    out = G.consolidate_results(a.unionByName(b), tasks)
    return out.withColumn("value", F.round("value", 6)).withColumn("stderr", F.round("stderr", 6))


@query(
    "A34",
    """with t as (select distinct event_type as task, event_type <> 'error' as up from events),
       g as (select 'all' as grp, task from t union all select 'good', task from t where task <> 'error')
       select grp as "group", case when bool_or(up) = bool_and(up) then bool_or(up) end as higher_is_better
       from g join t using (task) group by grp""",
)
def group_direction(spark, sf):
    t = B.table(spark, sf, "events").select(F.col("event_type").alias("task")).distinct()
    scores = t.withColumn("higher_is_better", F.col("task") != "error")
    edges = t.select(F.lit("all").alias("group"), "task").unionByName(
        t.filter("task <> 'error'").select(F.lit("good").alias("group"), "task")
    )
    return G.group_direction(scores, edges)


@query(
    "A36",
    """with s as (select (n_chars % 7) / 7.0 as p, (n_chars % 5 <> 0)::int as a, (n_chars % 3 <> 0)::int as t from documents),
       r as (select sum(p) / greatest(sum(a), 1) as prec, sum(p) / greatest(sum(t), 1) as rec from s)
       select round(2 * prec * rec / (prec + rec), 9) as f1 from r""",
)
def lexical_substitution_f1(spark, sf):
    d = B.table(spark, sf, "documents").select(
        ((F.col("n_chars") % 7) / 7.0).alias("p"), (F.col("n_chars") % 5 != 0).cast("int").alias("a"), (F.col("n_chars") % 3 != 0).cast("int").alias("t")
    )
    return A.lexical_substitution_f1(d, "p", "a", "t").select(F.round("f1", 9).alias("f1"))


AXIS = " + ".join(
    f"(2.0 * count(*) filter ({g} = {c} and {p} = {c}) / (count(*) filter ({g} = {c}) + count(*) filter ({p} = {c})))"
    for g, p in (("gp", "pp"), ("gn", "pn"))
    for c in (0, 1)
)


@query(
    "A37",
    f"""with s as (select label % 4 as gold, (vec_id % 4)::int as pred from embeddings),
        m as (select (gold in (0, 3))::int as gp, (pred in (0, 3))::int as pp, (gold in (1, 3))::int as gn, (pred in (1, 3))::int as pn from s)
        select round(({AXIS}) / 4, 9) as f1 from m""",
)
def sentiment_two_axis_f1(spark, sf):
    e = B.table(spark, sf, "embeddings").select((F.col("label") % 4).alias("gold"), (F.col("vec_id") % 4).cast("int").alias("pred"))
    return A.two_axis_f1(e, "gold", "pred").select(F.round("f1", 9).alias("f1"))


@query(
    "A38",
    f"""select gold as label, round(sum(list_sum(lls)) / sum(len(lls)), 9) as ratio from {B.choice_scores_sql(6)} group by gold""",
)
def score_ratio(spark, sf):
    return B.choice_scores(spark, sf, 6).groupBy(F.col("gold").alias("label")).agg(F.round(A.score_ratio(F.col("lls")), 9).alias("ratio"))


@query("A39", f"select role, round(avg(len({B.sql_words('text')})), 9) as avg_length from conversations group by role")
def average_length(spark, sf):
    from tallyframe.functions.columns import words

    return B.table(spark, sf, "conversations").groupBy("role").agg(F.round(F.avg(F.size(words(F.col("text")))), 9).alias("avg_length"))
