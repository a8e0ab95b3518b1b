"""Queries over resumable streams, registries and the whole evaluation (inventory W1, W2, F1-F6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyframe.functions import registry as R
from tallyframe.operators import ngrams as N
from tallyframe.plans import bindings as B
from tallyframe.plans import evaluate as E
from tallyframe.plans.evaluate import evaluate_generation
from tallyframe.plans.registry import query
from tallyframe.session import checkpoint_dir
from tallyframe.sources.ngram_store import create_store, open_store
from tallyframe.streaming import resume as S


def fresh_folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


ROUNDS = 4


def arrive(df, base: str, k: int) -> None:
    """Round ``k`` of a table's rows lands in the folder that a stream watches."""
    df.filter(F.pmod(df.columns[0], F.lit(ROUNDS)) == k).write.mode("append").option("compression", "zstd").parquet(base + "/in")


@query("W1 N5 S12", f"select doc_id, count(distinct ngram) as n, min(ngram) as lo from {B.doc_ngrams_sql(13)} group by doc_id")
def stream_ngram_index(spark, sf):
    """Documents arrive in four rounds, the stream ends after each one; a batch is delivered twice and one dies unpublished."""
    docs = B.table(spark, sf, "documents").select("doc_id", "text")
    base = fresh_folder(spark, "ngrams")
    for k in range(ROUNDS):
        arrive(docs, base, k)
        store = create_store(spark, base + "/index", 13, buckets=32)
        arrived = S.read_files(spark, base + "/in", docs.schema, "parquet")
        S.stream_ngram_index(arrived, "doc_id", "text", store, base + "/state").awaitTermination()
        if k == 1:
            some = N.word_ngrams(docs.limit(5), ["doc_id"], "text", 13, once=True)
            store.append(some, base + "/state#0")
            store.write_run(some, "torn")
            store.compact()
    return open_store(spark, base + "/index").read().groupBy("doc_id").agg(F.count("*").alias("n"), F.min("ngram").alias("lo"))


@query(
    "W2 J10",
    f"""with e as (select *, event_id % {ROUNDS} as round from events),
        f as (select user_id, event_type, min(round) as round from e group by 1, 2)
        select user_id, event_type as task, max(event_id) as event_id, max_by(value, event_id) as value, f.round::int as round
        from e join f using (user_id, event_type) where e.round = f.round group by all""",
)
def stream_scores(spark, sf):
    """Events arrive in four rounds; the stream ends after each one and is started again from its checkpoint."""
    events = B.table(spark, sf, "events")
    base = fresh_folder(spark, "scores")
    for k in range(ROUNDS):
        arrive(events, base, k)
        arrived = S.read_files(spark, base + "/in", events.schema, "parquet")
        S.stream_scores(arrived, ["user_id", "event_type"], "event_id", base + "/out", base + "/state").awaitTermination()
    done = spark.read.parquet(base + "/out")
    return done.select("user_id", F.col("event_type").alias("task"), "event_id", "value", F.col("batch_id").cast("int").alias("round"))


@query(
    "F1 F2 F3 A34",
    """with r as (select lang as task, case when regexp_matches(text, '[0-9]') then regexp_extract(text, '[0-9]+') else '[invalid]' end as n, lower(text) as l, substr(source, 4) as t from documents),
       s as (select task, 'number' as filter, unnest(['exact_match', 'contains']) as metric, unnest([n = t, contains(lower(n), t)])::int as v from r
             union all select task, 'lower', unnest(['exact_match', 'contains']), unnest([l = t, contains(l, t)])::int from r)
       select task, filter, metric, count(*) as n, round(avg(v), 9) as value, round(stddev_samp(v) / sqrt(count(*)), 9) as stderr, true as higher_is_better
       from s group by task, filter, metric""",
)
def evaluate_documents(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("lang").alias("task"), F.array("text").alias("resps"), F.substr("source", F.lit(4)).alias("target"))
    out = evaluate_generation(
        d, "target",
        {"number": [("regex", {"regex_pattern": "[0-9]+"}), ("take_first", {})], "lower": [("lowercase", {}), ("take_first", {})]},
        ["exact_match", "contains"],
    )
    return out.withColumn("value", F.round("value", 9)).withColumn("stderr", F.round("stderr", 9))


def rounded(out):
    return out.withColumn("value", F.round("value", 8)).withColumn("stderr", F.round("stderr", 8))


RESULT = "round({v}, 8) as value, {s} as stderr, {n} as n, {h} as higher_is_better"
MEAN = lambda c: f"round(avg({c}), 8) as value, round(stddev_samp({c}) / sqrt(count(*)), 8) as stderr, count(*) as n, true as higher_is_better"


@query(
    "F1 F2 H8 A34",
    f"""with r as (select (label % 3)::varchar as task, embedding[1]::double as ll, (embedding[2] > 0)::int as g from embeddings)
       select task, 'perplexity' as metric, {RESULT.format(v='exp(-avg(ll))', s='null::double', n='count(*)', h='false')} from r group by task
       union all select task, 'acc', {MEAN('g')} from r group by task""",
)
def evaluate_loglikelihood(spark, sf):
    e = B.table(spark, sf, "embeddings")
    requests = e.select((F.col("label") % 3).cast("string").alias("task"), "vec_id")
    responses = e.select("vec_id", F.col("embedding")[0].cast("double").alias("ll"), (F.col("embedding")[1] > 0).alias("is_greedy"))
    return rounded(E.evaluate_loglikelihood(requests, responses, ["vec_id"]))


@query(
    "F1 F2 H9 A13 A34",
    f"""with r as (select (label % 3)::varchar as task, label as gold, list_transform(embedding, lambda x: x::double) as l,
         list_transform(embedding, lambda x, i: x::double / (1 + i % 7)) as z from embeddings),
       s as (select task, gold, (list_position(l, list_max(l)) - 1 = gold)::int::double as acc, (list_position(z, list_max(z)) - 1 = gold)::int::double as norm,
         (l[gold + 1] > 0)::int as em from r)
       select task, 'acc' as metric, {MEAN('acc')} from s group by task union all select task, 'acc_norm', {MEAN('norm')} from s group by task
       union all select task, 'exact_match', {MEAN('em')} from s group by task""",
)
def evaluate_multiple_choice(spark, sf):
    e = B.table(spark, sf, "embeddings")
    rows = e.select("vec_id", F.posexplode("embedding").alias("idx", "ll"))
    responses = rows.select(
        "vec_id", "idx", F.col("ll").cast("double").alias("ll"), (F.col("ll") > 0).alias("is_greedy"), F.repeat(F.lit("x"), 1 + (F.col("idx") + 1) % 7).alias("choice")
    )
    golds = e.select((F.col("label") % 3).cast("string").alias("task"), "vec_id", F.col("label").alias("gold"))
    return rounded(E.evaluate_multiple_choice(responses, golds, "vec_id", ["acc", "acc_norm", "exact_match"]))


@query(
    "F1 F2 H11 A6 A7 A34",
    f"""with r as (select lang as task, -0.5 * (length(text) - (len(string_split(text, chr(10))) - 1)) as ll,
         len(string_split_regex(text, '\\s+')) as w, octet_length(encode(text)) as b from documents)
       select task, 'word_perplexity' as metric, {RESULT.format(v='exp(-sum(ll) / sum(w))', s='null::double', n='count(*)', h='false')} from r group by task
       union all select task, 'byte_perplexity', {RESULT.format(v='exp(-sum(ll) / sum(b))', s='null::double', n='count(*)', h='false')} from r group by task
       union all select task, 'bits_per_byte', {RESULT.format(v='-sum(ll) / sum(b) / ln(2)', s='null::double', n='count(*)', h='false')} from r group by task""",
)
def evaluate_rolling(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("lang").alias("task"), "doc_id", "text")
    windows = d.select("doc_id", F.explode(F.split("text", "\n")).alias("w")).select("doc_id", (F.length("w") * -0.5).alias("ll"))
    return rounded(E.evaluate_rolling(windows, d, "doc_id", "text"))


@query(
    "F1 A24",
    """select p_partkey, case when 50 - p_size < 3 then 1.0 else round(1 - (50.0 - p_size) * (49 - p_size) * (48 - p_size) / (50 * 49 * 48), 9) end as pass_at_3 from part""",
)
def sql_functions(spark, sf):
    R.register_sql_functions(spark)
    p = B.table(spark, sf, "part")
    return p.select("p_partkey", F.round(F.expr("eval_pass_at_k(50L, cast(p_size as bigint), 3)"), 9).alias("pass_at_3"))


@query("F4 F5", "select p_partkey, unnest([p_name, p_brand]) as item from part")
def row_callables(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    rows = lambda r: [{"p_partkey": r["p_partkey"], "item": r[c]} for c in ("p_name", "p_brand")]
    return R.map_rows(p, rows, "p_partkey long, item string")
