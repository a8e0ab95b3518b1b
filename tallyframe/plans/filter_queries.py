"""Queries over response filters and likelihood scores (inventory H1-H15, F3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import filters as X
from tallyframe.functions import likelihood as L
from tallyframe.plans import bindings as B
from tallyframe.plans.registry import query


def pages(spark, sf):
    return B.table(spark, sf, "pages")


@query(
    "H1",
    """select page_id, coalesce(trim(regexp_extract_all(html, 'href="/([^"]*)"', 1)[1]), '[invalid]') as first_link,
       coalesce(trim(list_last(regexp_extract_all(html, '(-?[$0-9.,]{2,})|(-?[0-9]+)', 0))), '[invalid]') as last_number,
       coalesce(trim(regexp_extract_all(html, '#### ([0-9]+)', 1)[1]), '[invalid]') as strict from pages""",
)
def regex_filter(spark, sf):
    h = F.col("html")
    return pages(spark, sf).select(
        "page_id",
        X.regex_extract(h, r'href="/([^"]*)"').alias("first_link"),
        X.regex_extract(h, r"(-?[$0-9.,]{2,})|(-?[0-9]+)", -1).alias("last_number"),
        X.regex_extract(h, r"#### ([0-9]+)").alias("strict"),
    )


@query("H1", "select event_id, regexp_extract(props, '\"k\": ([0-9]+)', 1) as answer from events")
def json_number_filter(spark, sf):
    return B.table(spark, sf, "events").select("event_id", X.regex_extract(F.col("props"), r'"k": ([0-9]+)').alias("answer"))


@query(
    "H2",
    """with c as (select conv_id, turn, text, [' the', 'and', 'que'] as ch, regexp_extract(lower(text), 'the|and|que') as f from conversations)
       select conv_id, turn, case f when 'the' then '(A)' when 'and' then '(B)' when 'que' then '(C)' else '[invalid]' end as answer from c""",
)
def multi_choice_filter(spark, sf):
    c = B.table(spark, sf, "conversations").withColumn("choices", F.array(F.lit(" the"), F.lit("and"), F.lit("que")))
    out = X.multi_choice_extract(F.col("text"), F.col("choices"), r"#### ([A-Z])", ignore_case=True)
    return c.select("conv_id", "turn", out.alias("answer"))


@query(
    "H3 H4 H5 H6 F3 O4",
    """with r as (select p_partkey, ['  ' || upper(p_name), p_brand, p_brand] as resps from part)
       select p_partkey, 'first' as filter, ltrim(lower(resps[1])) as resp from r union all select p_partkey, 'majority', resps[2] from r
       union all select p_partkey, 'two', resps[1] || '|' || resps[2] from r
       union all select p_partkey, 'mapped', case when resps[2] = 'Brand#2' then 'two' else 'other' end from r""",
)
def filter_fanout(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", F.array(F.concat(F.lit("  "), F.upper("p_name")), "p_brand", "p_brand").alias("resps"))
    out = X.apply_filters(
        p, "resps",
        {
            "first": [("lowercase", {}), ("remove_whitespace", {}), ("take_first", {})],
            "majority": [("majority_vote", {})],
            "two": [("take_first_k", {"k": 2})],
            "mapped": [("map", {"mapping_dict": {"Brand#2": "two"}, "default_value": "other"}), ("majority_vote", {})],
        },
    )
    return out.select("p_partkey", "filter", F.array_join("filtered_resps", "|").alias("resp"))


@query(
    "H7 F4",
    "select p_partkey, 'P:' || reverse(p_name) as resp from part",
)
def custom_filter(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", F.array("p_name").alias("resps"))
    fn = lambda r: F.transform(r, lambda x: F.concat(F.lit("P:"), F.reverse(x)))
    return X.apply_filters(p, "resps", {"c": [("custom", {"filter_fn": fn})]}).select("p_partkey", F.col("filtered_resps")[0].alias("resp"))


@query("H8", "select vec_id, round(embedding[1]::double, 9) as perplexity, (embedding[2] > 0)::int as acc from embeddings")
def loglikelihood_score(spark, sf):
    e = B.table(spark, sf, "embeddings")
    r = F.struct(F.col("embedding")[0].cast("double").alias("ll"), (F.col("embedding")[1] > 0).alias("is_greedy"))
    out = e.select("vec_id", L.ll_score(r).alias("s"))
    return out.select("vec_id", F.round("s.perplexity", 9).alias("perplexity"), "s.acc")


CHOICES = "list_transform(range(1, 65), lambda i: repeat('x', i::int))"


@query(
    "H9",
    f"""with s as (select doc_id, gold, lls, list_transform(lls, lambda x, i: x / i) as nl from {B.choice_scores_sql()})
        select doc_id, (list_position(lls, list_max(lls)) - 1 = gold)::int::double as acc, (list_position(nl, list_max(nl)) - 1 = gold)::int::double as acc_norm,
        (gold % 2 = 0)::int as exact_match, round(exp(lls[gold + 1]) / list_sum(list_transform(lls, lambda x: exp(x))), 9) as prob from s""",
)
def choice_scores(spark, sf):
    c = B.choice_scores(spark, sf)
    choices = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.repeat(F.lit("x"), i))
    greedy = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 2 == 0)
    out = c.select("doc_id", "gold", L.choice_scores(F.col("lls"), greedy, choices, F.col("gold")).alias("s"))
    return out.select("doc_id", "s.acc", "s.acc_norm", "s.exact_match", F.round(F.get("s.probs", F.col("gold")), 9).alias("prob"))


@query(
    "H9",
    f"""with s as (select doc_id, list_position(lls, list_max(lls)) - 1 as p, [gold, (gold + 3) % 10, 99] as golds from {B.choice_scores_sql()})
        select doc_id, list_contains(golds, p)::int::double as acc from s""",
)
def multi_gold_scores(spark, sf):
    c = B.choice_scores(spark, sf)
    choices = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.repeat(F.lit("x"), i))
    golds = F.array(F.col("gold"), (F.col("gold") + 3) % 10, F.lit(99))
    greedy = F.transform("lls", lambda x: x > 0)
    return c.select("doc_id", L.multi_gold_scores(F.col("lls"), greedy, choices, golds)["acc"].alias("acc"))


@query(
    "H10",
    """with s as (select vec_id, label, list_transform(range(1, 33), lambda i: embedding[i]::double - embedding[i + 32]::double) as d from embeddings)
       select vec_id, (list_position(d, list_max(d)) - 1 = label)::int::double as acc from s""",
)
def mutual_info_accuracy(spark, sf):
    e = B.table(spark, sf, "embeddings")
    d = lambda a: F.transform(F.slice("embedding", a, 32), lambda x: x.cast("double"))
    return e.select("vec_id", L.mutual_info_acc(d(1), d(33), F.col("label")).alias("acc"))


@query("H11", "select doc_id, -0.5 * n_chars as ll, len(string_split_regex(text, '\\s+'))::int as words, octet_length(encode(text))::int as bytes from documents")
def rolling_score(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", L.rolling_score(F.lit(-0.5) * F.col("n_chars"), F.col("text")).alias("s")).select("doc_id", "s.*")


@query(
    "H12",
    f"""select doc_id, round(list_sum(list_transform(lls, lambda x, i: case when (i - 1) % 3 = 0 then exp(x) else 0 end)) / list_sum(list_transform(lls, lambda x: exp(x))), 9) as acc
        from {B.choice_scores_sql()}""",
)
def probability_mass(spark, sf):
    labels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 3 == 0).cast("int"))
    return B.choice_scores(spark, sf).select("doc_id", F.round(L.prob_mass_true(F.col("lls"), labels), 9).alias("acc"))


@query(
    "H13",
    f"""with r as (select doc_id, list_position(list_reverse_sort(lls), lls[gold + 1]) as rank, (list_position(lls, list_max(lls)) - 1 = gold)::int as first from {B.choice_scores_sql()})
        select doc_id, first as r_at_1, (rank = 2)::int + first as r_at_2, round(1.0 / rank, 9) as mrr from r""",
)
def rank_metrics(spark, sf):
    out = B.choice_scores(spark, sf).select("doc_id", L.rank_metrics(F.col("lls"), F.col("gold")).alias("s"))
    return out.select("doc_id", "s.r_at_1", "s.r_at_2", F.round("s.mrr", 9).alias("mrr"))


@query(
    "H14",
    f"""select doc_id, round(abs(lls[1] - lls[2]), 9) as likelihood_diff, (lls[1] > lls[2])::int::double as pct_stereotype,
        round(ln(exp(lls[1]) + exp(lls[2])) - ln(exp(lls[3]) + exp(lls[4])), 9) as gender_diff,
        (list_position(lls, list_max(lls)) > 2)::int::double as pct_male_preferred from {B.choice_scores_sql(4)}""",
)
def bias_likelihoods(spark, sf):
    l = F.col("lls")
    c = B.choice_scores(spark, sf, 4).select("doc_id", L.pair_preference(l[0], l[1]).alias("p"), L.gender_preference(l).alias("g"))
    return c.select(
        "doc_id", F.round("p.likelihood_diff", 9).alias("likelihood_diff"), "p.pct_stereotype",
        F.round("g.likelihood_diff", 9).alias("gender_diff"), "g.pct_male_preferred",
    )


@query(
    "H14",
    """with r as (select p_partkey, case when p_size % 3 = 0 then ['male', 'x'] when p_size % 3 = 1 then ['woman', 'man'] else ['[invalid]'] end as r from part),
       c as (select p_partkey, list_has_any(r, ['male', 'man'])::int as m, list_has_any(r, ['female', 'woman'])::int as f from r)
       select p_partkey, m - f as difference_male_female, (m > f)::int as pct_male_preferred, (m <= f and f > 0)::int as pct_female_preferred, (m + f = 0)::int as pct_invalid from c""",
)
def generated_gender(spark, sf):
    s = F.col("p_size") % 3
    lits = lambda *xs: F.array(*map(F.lit, xs))
    r = F.when(s == 0, lits("male", "x")).when(s == 1, lits("woman", "man")).otherwise(lits("[invalid]"))
    return B.table(spark, sf, "part").select("p_partkey", L.generated_gender(r).alias("s")).select("p_partkey", "s.*")


@query(
    "H15",
    f"""with s as (select doc_id, gold, list_position(lls, list_max(lls)) - 1 as p from {B.choice_scores_sql()}),
        t as (select doc_id, ['unit', p::varchar, 'of', (p % 7)::varchar] as p,
                unnest([['unit', gold::varchar, 'of', (gold % 7)::varchar], ['unit', ((gold * 5) % 64)::varchar]]) as r from s),
        f as (select doc_id, {B.sql_overlap('p', 'r')} as n, len(p) as a, len(r) as b, (p = r)::int::double as em from t)
        select doc_id, max(em) as em, round(max(case when n > 0 then 2.0 * n / (a + b) else 0 end), 9) as f1 from f group by doc_id""",
)
def entity_scores(spark, sf):
    from tallyframe.functions.text import picked_scores

    c = B.choice_scores(spark, sf)
    name = lambda i: F.concat(F.lit("Unit "), i.cast("string"), F.lit(" of "), (i % 7).cast("string"))
    entities = F.transform(F.sequence(F.lit(0), F.lit(63)), name)
    answers = F.array(F.concat(F.lit("the "), name(F.col("gold"))), F.concat(F.lit("unit "), ((F.col("gold") * 5) % 64).cast("string"), F.lit(".")))
    s = picked_scores(L.entity_pick(F.col("lls"), entities), answers)
    return c.select("doc_id", s.alias("s")).select("doc_id", "s.em", F.round("s.f1", 9).alias("f1"))


@query(
    "H15",
    f"""select doc_id, ['a', 'b', 'c', 'd'][list_position(lls, list_max(lls))] as entity from {B.choice_scores_sql(4)}""",
)
def entity_pick(spark, sf):
    return B.choice_scores(spark, sf, 4).select("doc_id", L.entity_pick(F.col("lls"), F.array(*map(F.lit, "abcd"))).alias("entity"))
