"""Queries over sources, sinks, selection, sets, ordering and requests (inventory S, P1-P6, P15-P21, U, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.columns import words
from tallyframe.operators import requests as R
from tallyframe.operators import selection as L
from tallyframe.plans import bindings as B
from tallyframe.plans.registry import query
from tallyframe.sources import sinks, tables


@query("S1", "select p_partkey, p_name, p_brand, p_partkey as idx from part")
def eval_table(spark, sf):
    df = tables.lower_keys(B.table(spark, sf, "part").withColumnRenamed("p_name", "P_NAME"))
    from tallyframe.operators.ordering import dense_index

    return dense_index(df, ["p_partkey"], "idx").select("p_partkey", "p_name", "p_brand", "idx")


@query(
    "S2 U1",
    "select lower(split_part(o_orderpriority, '-', 2)) as type, o_orderkey, o_totalprice from orders",
)
def union_subsets(spark, sf):
    o = B.table(spark, sf, "orders")
    part = lambda p: o.filter(F.col("o_orderpriority") == p).select("o_orderkey", "o_totalprice")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return tables.union_subsets({p.split("-", 1)[1].lower(): part(p) for p in names})


@query(
    "S3",
    """select event_id, event_type as task from events""",
)
def sample_log_tasks(spark, sf):
    e = B.table(spark, sf, "events")
    path = F.concat(F.lit("/runs/m/samples_"), "event_type", F.lit("_"), F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss"), F.lit(".jsonl"))
    return e.select("event_id", tables.task_from_sample_path(path).alias("task"))


@query(
    "S4 S5",
    """with f as (select 'model_' || (user_id % 5) as model, event_id, event_type, value from events),
       l as (select model, max(event_id) as event_id from f group by model)
       select model, event_type as task, 'accuracy,none' as metric, round(value, 6) as value from f join l using (model, event_id)""",
)
def latest_main_metrics(spark, sf):
    e = B.table(spark, sf, "events")
    cell = F.create_map(
        F.lit("accuracy,none"), F.col("value").cast("string"), F.lit("accuracy_stderr,none"), F.lit("0.1"), F.lit("alias"), F.lit("x")
    )
    model = F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string"))
    path = F.concat(F.lit("/r/"), model, F.lit("/results_"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(".json"))
    files = e.select(
        model.alias("model"), path.alias("path"), F.to_json(F.struct(F.create_map("event_type", cell).alias("results"))).alias("value")
    )
    out = tables.extract_main_metrics(tables.latest_results(files), ["accuracy", "score"])
    return out.withColumn("value", F.round("value", 6))


@query(
    "S6 S7",
    """with p as (select source as file, count(*) as n_docs, sum(length(text))::bigint as n_chars from documents group by source)
       select *, coalesce(sum(n_docs) over (order by file rows between unbounded preceding and 1 preceding), 0)::bigint as doc_offset from p""",
)
def corpus_stats(spark, sf):
    return tables.corpus_stats(B.table(spark, sf, "documents").withColumnRenamed("source", "file"), "file", "text")


@query(
    "S8",
    """select conv_id, turn, text as target, json_object('gen_args_0', json_object('arg_0', role, 'arg_1', turn::varchar)) as arguments,
       [[conv_id::varchar]] as resps, [turn::varchar] as filtered_resps from conversations""",
)
def sample_log_rows(spark, sf):
    c = B.table(spark, sf, "conversations")
    rows = c.select(
        "conv_id", "turn", F.col("text").alias("target"),
        F.array(F.array("role", F.col("turn").cast("string"))).alias("arguments"),
        F.array(F.array("conv_id")).alias("resps"), F.array("turn").alias("filtered_resps"),
    )
    return sinks.sample_log_rows(rows).withColumn("arguments", F.to_json("arguments"))


@query(
    "S9",
    """with t as (select 'model_' || (user_id % 3) as m, event_type as t, avg(value) as v, count(*) as n from events group by 1, 2)
       select m as model, '{"results":{' || string_agg('"' || t || '":{"acc,none":' || round(v, 6) || '}', ',' order by t) || '},"n-samples":{'
         || string_agg('"' || t || '":' || n, ',' order by t) || '},"versions":{' || string_agg('"' || t || '":1', ',' order by t)
         || '},"n-shot":{' || string_agg('"' || t || '":0', ',' order by t) || '},"config":{"num_fewshot":"0"}}' as value from t group by m""",
)
def results_json(spark, sf):
    from tallyframe.operators.groups import task_scores

    e = B.table(spark, sf, "events").select(
        F.concat(F.lit("model_"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("event_type").alias("task"), "value"
    )
    scores = task_scores(e, ["model", "task"], "value").select(
        "model", "task", F.lit("acc").alias("metric"), F.lit("none").alias("filter"), F.round("value", 6).alias("value"), "n", F.lit(1).alias("version"), F.lit(0).alias("n_shot")
    )
    return sinks.results_json(scores, {"num_fewshot": "0"})


@query(
    "S11 O1",
    """select p_brand || '_' || p_size as "Model", p_type as "Metric", printf('%.4f', avg(p_retailprice)) as "Value" from part group by 1, 2""",
)
def model_summary(spark, sf):
    p = B.table(spark, sf, "part")
    r = p.groupBy(F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("model"), F.col("p_type").alias("metric")).agg(
        F.avg("p_retailprice").alias("value")
    )
    return sinks.model_summary(r)


@query(
    "S16 O2",
    """with s as (select event_type as t, avg(value) as v, stddev_samp(value) / sqrt(count(*)) as e from events group by 1)
       select t as "Task", 1 as "Version", 'none' as "Filter", 0 as "n-shot", 'acc' as "Metric", '↑' as "Direction",
       printf('%.4f', v) as "Value", '±' as "PM", printf('%.4f', e) as "Stderr" from s""",
)
def results_table(spark, sf):
    from tallyframe.operators.groups import task_scores

    s = task_scores(B.table(spark, sf, "events").withColumnRenamed("event_type", "task"), ["task"], "value")
    rows = s.select(
        "task",
        F.inline(
            F.array(
                F.struct(F.lit("acc,none").alias("metric_key"), F.col("value").alias("value")),
                F.struct(F.lit("acc_stderr,none").alias("metric_key"), F.col("stderr").alias("value")),
            )
        ),
        F.lit(1).alias("version"), F.lit(0).alias("n_shot"), F.lit(True).alias("higher_is_better"),
    )
    return sinks.results_table(rows)


@query(
    "S13 U6",
    "select o_orderkey, o_totalprice from orders",
)
def combine_shards(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    shards = L.assign_shard(o, "o_orderkey", 2)
    return tables.combine_shards([shards.filter(F.col("shard") == i).drop("shard") for i in (0, 1)], "o_orderkey", expected=o.count())


@query(
    "S14",
    """select p_partkey as question_id, 2 as n_tests, case when p_size % 2 = 0 then 'def f():' else '' end as entry_point, p_name as q_name,
       '{"inputs":["' || p_size || '","' || p_brand || '"],"outputs":["' || p_type || '","x"],"fn_name":"f' || p_size || '"}' as test from part""",
)
def convert_problems(spark, sf):
    p = B.table(spark, sf, "part")
    case = lambda i, o: F.to_json(F.array(F.struct(i.cast("string").alias("input"), o.alias("output"), F.lit("stdin").alias("testtype"))))
    rows = p.select(
        F.col("p_partkey").alias("question_id"), F.col("p_name").alias("question_content"),
        F.when(F.col("p_size") % 2 == 0, "def f():").otherwise("").alias("starter_code"),
        case(F.col("p_size"), F.col("p_type")).alias("public_test_cases"), case(F.col("p_brand"), F.lit("x")).alias("private_test_cases"),
        F.to_json(F.struct(F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("func_name"))).alias("metadata"),
    )
    out = tables.convert_problems(rows)
    return out.select("question_id", "n_tests", "entry_point", "test", F.regexp_extract("prompt", r"Question: (.*)\n\n", 1).alias("q_name"))


@query(
    "S15",
    f"""select doc_id as id, 'doc ' || doc_id as data, length('doc ' || doc_id)::int as input_len, gold::varchar as labels, 'multiple_choice' as output_type,
        (list_position(lls, list_max(lls)) - 1)::varchar as raw_predictions, (list_position(lls, list_max(lls)) - 1)::varchar as filtered_predictions,
        '0. a' || chr(10) || '1. b' as choices from {B.choice_scores_sql(2)}""",
)
def samples_to_report(spark, sf):
    c = B.choice_scores(spark, sf, 2).select(
        "doc_id", F.col("gold").cast("string").alias("target"), F.lit("multiple_choice").alias("output_type"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("context"), F.lit("").alias("continuation"),
        F.array(F.lit("a"), F.lit("b")).alias("choices"), "lls", F.array(F.lit(True), F.lit(False)).alias("is_greedy"),
        F.lit("").alias("resp"), F.lit("").alias("filtered_resp"),
    )
    return sinks.samples_to_report(c)


# ---------------------------------------------------------------- predicates


@query("P1", "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus = 'F'")
def filter_category(spark, sf):
    o = L.filter_category(B.table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"], "in")
    return L.filter_category(o, "o_orderstatus", "F").select("o_orderkey")


@query("P1", "select p_partkey from part where p_name like 'small%' and not contains(p_brand, '7')")
def filter_category_text(spark, sf):
    p = L.filter_category(B.table(spark, sf, "part"), "p_name", "small", "startswith")
    return L.filter_category(p, "p_brand", "7", "excludes").select("p_partkey")


@query("P2", f"select conv_id, turn from {B.REPLIES_SQL} where coalesce(pred, '') <> '' and coalesce(ref, '') <> ''")
def filter_nonempty(spark, sf):
    return L.filter_nonempty(B.replies(spark, sf), ["pred", "ref"]).select("conv_id", "turn")


@query("P3", "select o_orderkey, o_orderdate from orders where o_orderdate between '1996-01-01' and '1997-06-30'")
def filter_date_range(spark, sf):
    return L.filter_date_range(B.table(spark, sf, "orders"), "o_orderdate", "1996-01-01", "1997-06-30").select("o_orderkey", "o_orderdate")


@query("P4", "select doc_id, lang from documents where doc_id < (select ceil(count(*) * 0.3) from documents)")
def limit_docs_share(spark, sf):
    return L.limit_docs(B.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 0.3)


@query("P4", "select o_orderkey, o_custkey from orders order by o_orderkey limit 1900 offset 100")
def slice_docs(spark, sf):
    return L.slice_docs(B.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 2000)


@query("P5", "select (o_orderkey % 8)::int as shard, count(*) as n, sum(o_orderkey)::bigint as s from orders group by 1")
def assign_shard(spark, sf):
    o = L.assign_shard(B.table(spark, sf, "orders"), "o_orderkey", 8)
    return o.groupBy("shard").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("P6", "select distinct p_name from part where p_name like 'small%' or p_name like '%bol_' order by p_name")
def match_names(spark, sf):
    return L.match_names(B.table(spark, sf, "part"), "p_name", ["small*", "*bol?"])


# ---------------------------------------------------------------- sets and order


@query(
    "U2",
    """select p_type as task from (select distinct p_brand, p_type from part) group by p_type
       having count(*) = (select count(distinct p_brand) from part)""",
)
def tasks_of_all_models(spark, sf):
    return L.tasks_of_all_models(B.table(spark, sf, "part"), "p_brand", "p_type").withColumnRenamed("p_type", "task")


@query(
    "U4",
    """select conv_id, min(turn) as turn, min_by(role, turn) as role, list(text order by turn) as outputs from conversations group by conv_id""",
)
def collect_outputs(spark, sf):
    return L.collect_outputs(B.table(spark, sf, "conversations"), "conv_id", "turn", "text", keep=["role"])


@query(
    "U5",
    """select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1""",
)
def keep_last(spark, sf):
    e = B.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return L.keep_last(e, ["user_id"], F.col("event_id"))


@query("U6", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, sf):
    return L.duplicate_keys(B.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "O2",
    """select r_name || '/' || n_name as path, ' - ' || n_name as alias from nation join region on n_regionkey = r_regionkey
       union all select r_name, r_name from region""",
)
def tree_order(spark, sf):
    n, r = B.table(spark, sf, "nation"), B.table(spark, sf, "region")
    leaves = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat_ws("/", "r_name", "n_name").alias("path"), F.col("n_name").alias("alias"))
    return L.order_results(leaves.unionByName(r.select(F.col("r_name").alias("path"), F.col("r_name").alias("alias"))), "path", "alias")


@query("O3", "select conv_id, turn, role from conversations order by conv_id, turn")
def order_samples(spark, sf):
    return B.table(spark, sf, "conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


# ---------------------------------------------------------------- requests

MC_SQL = """(select p_partkey, p_name as context, [p_brand, p_type, p_name] as choices from part)"""


@query(
    "P19",
    f"""with c as (select *, unnest(range(0, 3)) as i from {MC_SQL})
        select p_partkey, i::int as idx, context, ' ' || choices[i + 1] as continuation, false as is_unconditional, 'loglikelihood' as request_type, 1 as repeat from c
        union all select p_partkey, i::int, '', ' ' || choices[i + 1], true, 'loglikelihood', 1 from c""",
)
def build_choice_requests(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("context"), F.array("p_brand", "p_type", "p_name").alias("choices"))
    return R.build_requests(p, "multiple_choice", ["p_partkey"], mutual_info=True)


@query(
    "P19",
    """select conv_id, turn, text as context, r as repeat, 'generate_until' as request_type from conversations, range(1, 4) t(r) where role = 'user'""",
)
def build_generation_requests(spark, sf):
    c = B.table(spark, sf, "conversations").filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("context"), F.create_map(F.lit("until"), F.lit("\n")).alias("gen_kwargs")
    )
    return R.build_requests(c, "generate_until", ["conv_id", "turn"], repeats=3).select("conv_id", "turn", "context", "repeat", "request_type")


@query(
    "P19",
    """select doc_id, '' as context, text as continuation, 'loglikelihood_rolling' as request_type from documents""",
)
def build_rolling_requests(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.col("text").alias("target"))
    return R.build_requests(d, "loglikelihood_rolling", ["doc_id"]).select("doc_id", "context", "continuation", "request_type")


@query(
    "P20",
    """select doc_id, lang, (row_number() over (partition by lang order by length(text) desc, doc_id) - 1) // 16 as batch from documents""",
)
def batch_requests(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return R.batch_requests(d, ["lang"], "text", "doc_id", 16).select("doc_id", "lang", "batch")


CONTEXTS = f"""(select (conv_id * 1000 + turn) * 3 + i as id, {B.sql_words("text")} as ctx, (case i when 0 then ['yes'] when 1 then ['no'] else ['it', 'is', role] end) as cont
  from conversations, (select unnest(range(0, 3)) as i))"""


@query(
    "P20",
    f"""with r as (select *, ctx || cont[1:len(cont) - 1] as p, cont[-1] as last_token from {CONTEXTS}), g as (select p, min(id) as representative from r group by p),
        b as (select p, representative, (row_number() over (order by len(p) desc, representative) - 1) // 16 as batch from g)
        select r.id, representative, len(r.p)::int as n_prefix, last_token, batch from r join b on r.p = b.p""",
)
def batch_contexts(spark, sf):
    """Three continuations of every turn: two of one token share their context, and so do equal turns of other conversations."""
    c = B.table(spark, sf, "conversations")
    conts = F.array(F.array(F.lit("yes")), F.array(F.lit("no")), F.array(F.lit("it"), F.lit("is"), F.col("role")))
    rows = c.select("conv_id", "turn", words(F.col("text")).alias("ctx"), F.posexplode(conts).alias("i", "cont"))
    requests = rows.select(((F.col("conv_id") * 1000 + F.col("turn")) * 3 + F.col("i")).alias("id"), "ctx", "cont")
    grouped = R.group_contexts(requests, "id", "ctx", "cont").drop("ctx", "cont")
    out = R.spread_results(grouped, R.batch_contexts(grouped, "id", 16), "id")
    return out.select("id", "representative", "n_prefix", "last_token", "batch")


WINDOWS = f"""with t as (select doc_id, {B.sql_words('text')} as t from documents), n as (select *, len(t) as n from t where len(t) > 0),
  w as (select *, unnest(range(0, 1 + ceil(greatest(n - 100, 0) / 81.0)::int)) as w from n),
  b as (select *, least(100, n) as f, case when w = 0 then 0 else least(100, n) + (w - 1) * 81 end as done from w),
  e as (select *, case when w = 0 then f else least(n - done, 81) end as take from b)
  select doc_id, w::int as window_id, array_to_string(case when w = 0 then list_prepend('<s>', t[1:f - 1]) else t[done + take - 100:done + take - 1] end, ' ') as input,
  array_to_string(t[done + 1:done + take], ' ') as predicted from e"""


@query("P21", WINDOWS)
def rolling_windows(spark, sf):
    d = B.table(spark, sf, "documents")
    win = R.rolling_windows(words(F.col("text")), F.lit("<s>"), 100, 20)
    out = d.select("doc_id", F.posexplode(win).alias("window_id", "w"))
    return out.select("doc_id", "window_id", F.array_join("w.input", " ").alias("input"), F.array_join("w.predicted", " ").alias("predicted"))


@query(
    "P21",
    f"""select doc_id, window_id, len(string_split(input, ' ')) - (len(string_split(predicted, ' ')) - 1) as context_len from ({WINDOWS})""",
)
def disjoint_windows(spark, sf):
    d = B.table(spark, sf, "documents")
    win = R.rolling_windows(words(F.col("text")), F.lit("<s>"), 100, 20)
    out = d.select("doc_id", F.posexplode(win).alias("window_id", "w"))
    return out.select("doc_id", "window_id", F.size(R.disjoint_window(F.col("w"))["input"]).alias("context_len"))


HASHES = """h as (select lang, doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' || sha256(text) || sha256(lang)) as h,
                 row_number() over (partition by lang order by doc_id) - 1 as p from documents)"""


def sample_hashes(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return d.withColumn("sample_hash", R.fingerprint(F.to_json(F.struct("doc_id", "lang")), F.sha2("text", 256), F.sha2("lang", 256)))


@query("P16", f"with {HASHES} select lang, sha256(string_agg(h, '' order by p)) as task_hash from h group by lang")
def task_hashes(spark, sf):
    return R.task_hashes(sample_hashes(spark, sf), ["lang"], "doc_id", "sample_hash")


# As many levels as the largest task needs: its number of samples, divided by ten until nothing is left.
@query(
    "P16",
    f"""with recursive {HASHES}, n as (select max(p) as most from h),
       l as (select 0 as k, lang, p::bigint as p, h from h
             union all select k, lang, p, h from (select k + 1 as k, lang, p // 10 as p, sha256(string_agg(h, '' order by p)) as h from l group by k, lang, p // 10), n
             where k = 1 or most // pow(10, k - 1)::bigint > 0)
       select lang, h as block_hash from l where k = (select max(k) from l)""",
)
def block_hashes(spark, sf):
    return R.block_hashes(sample_hashes(spark, sf), ["lang"], "doc_id", "sample_hash", block=10)


@query(
    "P16",
    """select o_orderkey, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') as doc_hash,
       sha256(o_orderpriority) as prompt_hash, sha256(o_custkey::varchar) as target_hash from orders""",
)
def sha_fingerprints(spark, sf):
    o = R.sha_fingerprints(B.table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"], "o_orderpriority", "o_custkey")
    return o.select("o_orderkey", "doc_hash", "prompt_hash", "target_hash")


@query("P15", f"select doc_id from documents where len({B.sql_words('text')}) <= 100")
def prune_by_length(spark, sf):
    return R.prune_by_length(B.table(spark, sf, "documents"), "text", 100).select("doc_id")


@query(
    "P18",
    f"""with t as (select role as task, sum(len({B.sql_words('text')}) + case when role = 'user' then 256 else 2048 end)::bigint as tokens from conversations group by role),
        a as (select * from t union all select '**Total**', sum(tokens)::bigint from t)
        select task, tokens, round(tokens / 1000 * 0.0008, 9) as ada, round(tokens / 1000 * 0.06, 9) as davinci from a""",
)
def cost_estimate(spark, sf):
    c = B.table(spark, sf, "conversations").select(
        F.col("role").alias("task"), F.col("text").alias("context"), F.lit(None).cast("string").alias("continuation"),
        F.when(F.col("role") == "user", "generate_until").otherwise("loglikelihood_rolling").alias("request_type"),
    )
    out = R.cost_estimate(c, "task")
    return out.select("task", "tokens", F.round("ada", 9).alias("ada"), F.round("davinci", 9).alias("davinci"))
