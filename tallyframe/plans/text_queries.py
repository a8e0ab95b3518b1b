"""Queries over text match and task parsers (inventory H16-H33, A15, A16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text as X
from tallyframe.operators import aggregates as A
from tallyframe.operators import reading as R
from tallyframe.plans import bindings as B
from tallyframe.plans.registry import query


def sql_norm(text: str, articles: str = "a|an|the") -> str:
    quoted = ", ".join(f"'{a}'" for a in articles.split("|"))
    w = B.sql_words(B.sql_drop_punctuation(f"lower({text})"))
    return f"list_filter({w}, lambda z: z not in ({quoted}))"


TOK = f"(select conv_id, turn, pred, ref, {sql_norm('pred')} as p, {sql_norm('ref')} as r from {B.REPLIES_SQL})"


@query(
    "H16",
    """select event_id, (event_type = lower(event_type))::int::double as plain, 1.0::double as folded,
       (regexp_replace(props, '[0-9]', '', 'g') = '{"k": }')::int::double as no_numbers from events""",
)
def exact_match(spark, sf):
    t = F.col("event_type")
    return B.table(spark, sf, "events").select(
        "event_id",
        X.exact_match(F.lower(t), t).alias("plain"),
        X.exact_match(F.concat(F.upper(t), F.lit("!?")), t, ignore_case=True, ignore_punctuation=True).alias("folded"),
        X.exact_match(F.col("props"), F.lit('{"k": 1}'), ignore_numbers=True).alias("no_numbers"),
    )


@query(
    "H16",
    "select p_partkey, (p_type in ('PROMO', 'SMALL'))::int::double as hit from part",
)
def exact_match_any(spark, sf):
    refs = F.array(F.lit("promo"), F.lit("xsmall"))
    return B.table(spark, sf, "part").select(
        "p_partkey", X.exact_match_any(F.col("p_type"), refs, ignore_case=True, regexes_to_ignore=["^x"]).alias("hit")
    )


@query("H17", f"select doc_id, md5(array_to_string({sql_norm('text')}, ' ')) as h from documents")
def normalize_answer(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.normalize_answer(F.col("text"))).alias("h"))


LANGS = ["en", "es", "fr", "de"]


@query(
    "H17",
    "select doc_id, md5(array_to_string(case lang "
    + " ".join(f"when '{l}' then {sql_norm('text', X.ARTICLES[l])}" for l in LANGS)
    + " end, ' ')) as h from documents",
)
def normalize_by_language(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.normalize_by_language(F.col("text"), F.col("lang"), LANGS)).alias("h"))


@query(
    "H18",
    f"""with s as (select conv_id, turn, {B.sql_overlap('p', 'r')} as n, len(p) as a, len(r) as b from {TOK})
        select conv_id, turn, round(case when n > 0 then 2.0 * n / (a + b) else 0 end, 9) as f1 from s""",
)
def token_f1(spark, sf):
    return B.replies(spark, sf).select("conv_id", "turn", F.round(X.token_f1(F.col("pred"), F.col("ref")), 9).alias("f1"))


def sql_chars(text: str) -> str:
    joined = f"lower(array_to_string({B.sql_words(text)}, ''))"
    return f"list_filter(string_split({B.sql_drop_punctuation(joined)}, ''), lambda w: w <> '')"


@query(
    "H18",
    f"""with c as (select conv_id, turn, {sql_chars('pred')} as p, {sql_chars('ref')} as r from {B.REPLIES_SQL}),
        s as (select conv_id, turn, {B.sql_overlap('p', 'r')} as n, len(p) as a, len(r) as b from c)
        select conv_id, turn, round(case when n > 0 then 2.0 * n / (a + b) else 0 end, 9) as f1 from s""",
)
def character_f1(spark, sf):
    return B.replies(spark, sf).select("conv_id", "turn", F.round(X.character_f1(F.col("pred"), F.col("ref")), 9).alias("f1"))


GOLDS = "list_transform(string_split(ref, chr(10)), lambda g: trim(g))"


@query(
    "H19",
    f"""with g as (select conv_id, turn, list_transform({GOLDS}, lambda g: (pred = g or contains(pred, g))::int::double) as s from {B.REPLIES_SQL})
        select conv_id, turn, round(case when len(s) = 1 then s[1] else list_sum(list_transform(s, lambda x, i:
        list_max(list_filter(list_transform(s, lambda y, j: case when j <> i then y end), lambda z: z is not null)))) / len(s) end, 9) as score from g""",
)
def leave_one_out(spark, sf):
    golds = F.transform(F.split("ref", "\n"), lambda g: F.trim(g))
    score = lambda g: ((F.col("pred") == g) | F.contains(F.col("pred"), g)).cast("double")
    return B.replies(spark, sf).select("conv_id", "turn", F.round(X.leave_one_out(golds, score), 9).alias("score"))


@query(
    "H19",
    f"""with t as (select conv_id, turn, p, list_transform(string_split(ref, chr(10)), lambda g: {sql_norm('g')}) as golds from {TOK}),
        f as (select conv_id, turn, list_transform(golds, lambda r: struct_pack(n := {B.sql_overlap('p', 'r')}, a := len(p), b := len(r))) as c from t),
        s as (select conv_id, turn, list_transform(c, lambda x: case when x.a = 0 or x.b = 0 then (x.a = x.b)::int::double when x.n = 0 then 0.0::double else 2.0::double * x.n / (x.a + x.b) end) as s from f)
        select conv_id, turn, round(case when len(s) = 1 then s[1] else list_sum(list_transform(s, lambda x, i:
        list_max(list_filter(list_transform(s, lambda y, j: case when j <> i then y end), lambda z: z is not null)))) / len(s) end, 9) as f1 from s""",
)
def leave_one_out_f1(spark, sf):
    golds = F.split("ref", "\n")
    f1 = X.leave_one_out(golds, lambda g: X.squad_f1(F.col("pred"), g))
    return B.replies(spark, sf).select("conv_id", "turn", F.round(f1, 9).alias("f1"))


@query(
    "H20",
    """select doc_id, (contains(lower(text), 'the') or contains(lower(text), 'und'))::int as contains_any, contains(text, source) as included from documents""",
)
def contains_score(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select(
        "doc_id", X.contains_any(F.col("text"), F.array(F.lit("THE"), F.lit("und"))).alias("contains_any"),
        X.is_included(F.col("source"), F.col("text")).alias("included"),
    )


@query(
    "H21",
    """with s as (select doc_id, (contains(lower(text), 'the')::int + contains(lower(text), 'la')::int + contains(lower(text), 'zz')::int) / 3.0 as a,
       (contains(lower(source), 'the')::int + contains(lower(source), 'la')::int + contains(lower(source), 'zz')::int) / 3.0 as b from documents)
       select doc_id, round((a + b) / 2, 9) as match_all, round(greatest(a, b) / 2, 9) as match_part from s""",
)
def string_match(spark, sf):
    refs = F.array(F.lit("The"), F.lit("LA"), F.lit("zz"))
    preds = F.array("text", "source")
    return B.table(spark, sf, "documents").select(
        "doc_id", F.round(X.string_match_all(preds, refs), 9).alias("match_all"), F.round(X.string_match_part(preds, refs), 9).alias("match_part")
    )


@query(
    "H22",
    """with n as (select page_id, regexp_extract_all(html, '([0-9]+)', 1) as n from pages)
       select page_id, round(case when len(n) = 0 then 0 else len(list_filter(n, lambda x: x = '0')) / len(n) end, 9) as count_score,
       round(case when len(n) = 0 then 0 else len(list_filter(n, lambda x: x = (page_id % 7)::varchar)) / len(n) end, 9) as retrieval_score from n""",
)
def number_scores(spark, sf):
    p = B.table(spark, sf, "pages")
    gold = F.concat(F.lit("see Paragraph "), (F.col("page_id") % 7).cast("string"))
    return p.select(
        "page_id", F.round(X.count_score(F.col("html"), F.lit("0")), 9).alias("count_score"),
        F.round(X.retrieval_score(F.col("html"), gold), 9).alias("retrieval_score"),
    )


@query(
    "H23",
    """with c as (select p_partkey, p_name, p_type, list_filter(['ring', 'small', 'small ring', 'bolt', 'PROMO'], lambda c: contains(p_name || ' ' || p_type, c) and not (contains(p_name, c) and c <> p_name)) as f from part)
       select p_partkey, round(case when list_contains(f, p_name) then 1.0 / len(f) else 0 end, 9) as score from c""",
)
def classification_score(spark, sf):
    classes = F.array(*map(F.lit, ["ring", "small", "small ring", "bolt", "PROMO"]))
    return B.table(spark, sf, "part").select(
        "p_partkey", F.round(X.classification_score(F.concat_ws(" ", "p_name", "p_type"), F.col("p_name"), classes), 9).alias("score")
    )


@query(
    "H24",
    """select o_orderkey, (abs(o_totalprice * (0.903 + (o_orderkey % 20) / 100.0) - o_totalprice) / o_totalprice <= 0.05)::int::double as relaxed,
       (o_orderkey % 3 = 0)::int::double as words, (o_orderkey % 2 = 0)::int::double as final from orders""",
)
def relaxed_accuracy(spark, sf):
    k = F.col("o_orderkey")
    o = B.table(spark, sf, "orders")
    near = F.format_string("The Answer**: $%.6f.\n", F.col("o_totalprice") * (F.lit(0.903) + (k % 20) / 100.0))
    target = F.array(F.format_string("%.2f", "o_totalprice"))
    said = F.when(k % 3 == 0, "I think it is urgent now").otherwise("no idea")
    final = F.when(k % 2 == 0, "so\nFinal Answer: Blue.").otherwise("Final Answer: red")
    return o.select(
        "o_orderkey", X.relaxed_accuracy(near, target).alias("relaxed"),
        X.anywhere_accuracy(said, F.array(F.lit("urgent"))).alias("words"), X.final_answer_match(final, F.lit(" blue")).alias("final"),
    )


@query(
    "H25",
    """select p_partkey, p_size % 4 <> 3 as ok from part""",
)
def reasoning_match(spark, sf):
    s = F.col("p_size") % 4
    sample = F.when(s == 0, F.concat(F.lit("So the answer is: (b). "), F.lit("The answer is (B)."))).when(
        s == 1, F.concat(F.lit("Thus **Answer:** $\\boxed{"), "p_name", F.lit("}$"))
    ).when(s == 2, F.concat(F.lit("The final answer is: "), F.col("p_partkey").cast("string"), F.lit(".0."))).otherwise("I do not know")
    ref = F.when(s == 0, "b").when(s == 1, F.upper("p_name")).when(s == 2, F.col("p_partkey").cast("string")).otherwise("(c)")
    return B.table(spark, sf, "part").select("p_partkey", X.reasoning_match(sample, ref).alias("ok"))


@query(
    "H26",
    """select p_partkey, p_size % 2 = 0 as same, case when p_size % 3 = 0 then 1 when p_size % 3 = 1 then 0 else 1 - p_size % 2 end as label from part""",
)
def referent_and_label(spark, sf):
    size = F.col("p_size")
    pred = F.when(size % 2 == 0, F.concat(F.lit("The "), "p_name")).otherwise(F.concat("p_name", F.lit("'s hat")))
    word = F.when(size % 3 == 0, "True").when(size % 3 == 1, "False").otherwise("maybe")
    return B.table(spark, sf, "part").select(
        "p_partkey", X.referent_match(pred, F.col("p_name")).alias("same"), X.label_or_wrong(word, ["False", "True"], size % 2).alias("label")
    )


@query("H27", "select p_partkey, case p_size % 5 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 1 else -1 end as answer from part")
def bias_answer(spark, sf):
    s = F.col("p_size") % 5
    resp = F.when(s == 0, "It was the Grandfather.").when(s == 1, "Probably grandson, yes").when(s == 2, "This is not known at all").when(
        s == 3, "An young person").otherwise("zzz")
    choices = F.array(F.lit("The grandfather"), F.lit("the grandson"), F.lit("Not known"))
    groups = F.array(F.array(F.lit("old")), F.array(F.lit("young"), F.lit("kid")))
    return B.table(spark, sf, "part").select("p_partkey", X.parse_bias_answer(resp, choices, groups).alias("answer"))


SCALE = "case when {d} = 0 then 0 when {d} <= 5 then 6.5 / (1 + exp(-1.2 * ({d} - 4))) else {d} end"


@query(
    "H28",
    f"""with d as (select p_partkey, p_size, abs(p_size % 11 - 5) as d from part)
        select p_partkey, round(case when p_size % 7 = 0 then 0 else (10 - 0.7477 * (({SCALE.format(d='d')}) + ({SCALE.format(d='2')}))) * 10 end, 6) as eqbench,
        case when p_size % 7 = 0 then 0 else 100 end as percent_parseable from d""",
)
def emotion_score(spark, sf):
    p = B.table(spark, sf, "part")
    size = F.col("p_size")
    resp = F.concat(F.lit("Joy: "), (size % 11).cast("string"), F.lit("\nFear: 2\nAnger: 3"), F.when(size % 7 == 0, "").otherwise("\nCalm: 8"))
    names, scores = F.array(*map(F.lit, ["Joy", "Fear", "Anger", "Calm"])), F.array(*map(F.lit, [5.0, 4.0, 3.0, 8.0]))
    out = p.select("p_partkey", X.emotion_score(resp, names, scores).alias("s"))
    return out.select("p_partkey", F.round("s.eqbench", 6).alias("eqbench"), "s.percent_parseable")


@query(
    "H29",
    """select p_partkey, (p_size % 2 = 0)::int::double as em, case when p_size % 2 = 0 then 1.0::double else 0.67::double end as f1 from part""",
)
def drop_scores(spark, sf):
    size = F.col("p_size")
    pred = F.when(size % 2 == 0, F.concat(F.lit("The "), size.cast("string"), F.lit(" yards"))).otherwise(size.cast("string"))
    golds = F.array(F.lit("something else"), F.concat(size.cast("string"), F.lit(".0 yards")), F.lit(" "))
    out = B.table(spark, sf, "part").select("p_partkey", X.drop_scores(pred, golds).alias("s"))
    return out.select("p_partkey", "s.em", "s.f1")


@query(
    "H30 A38",
    """select p_partkey, case when p_size % 2 = 0 then 1.0 else 0.0 end + case when p_size % 3 = 0 then 1.0 else 0 end as total from part""",
)
def puzzle_scores(spark, sf):
    size = F.col("p_size")
    body = F.concat(
        F.lit("Sure: {'1.1': '"), F.when(size % 2 == 0, F.concat(F.upper("p_name"), F.lit("."))).otherwise("x"), F.lit("', '1.2': '"),
        F.when(size % 3 == 0, "yes").otherwise(""), F.lit("'}"),
    )
    answers = F.array(F.array(F.lit("q"), F.col("p_name")), F.array(F.lit("Yes")))
    out = B.table(spark, sf, "part").select("p_partkey", X.puzzle_scores(body, F.array(F.lit("1.1"), F.lit("1.2")), answers).alias("s"))
    return out.select("p_partkey", (F.col("s")[0] + F.col("s")[1]).alias("total"))


@query(
    "H32 A36",
    """select p_partkey, round(case when p_size % 2 = 0 then 0.75 else 0.25 end, 9) as precision, 1 as answered from part""",
)
def lexical_substitution_row(spark, sf):
    resp = F.concat("p_brand", F.lit(", "), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("zzz"), F.lit(", promo!\nrest"))
    syn = F.array(F.col("p_name"), F.lit("promo"))
    out = B.table(spark, sf, "part").select("p_partkey", X.lexical_substitution_row(resp, syn, F.array(F.lit(2), F.lit(1))).alias("s"), "p_size")
    # two hits of counts 2 and 1 out of 4
    return out.select("p_partkey", F.round(F.col("s.precision") * 3 / 4, 9).alias("precision"), "s.answered")


@query(
    "H32 A9",
    """with e as (select p_type as gold, case when p_size % 3 = 0 then p_type else 'x' end as pred from part),
       l as (select case gold when 'PROMO' then 0 when 'SMALL' then 1 else 2 end as g, gold = pred as hit from e)
       select g as gold, case when hit then g else 3 end as pred, count(*) as n from l group by 1, 2""",
)
def entity_label_counts(spark, sf):
    code = F.when(F.col("p_type") == "PROMO", "PER").when(F.col("p_type") == "SMALL", "LOC").otherwise("ORG")
    item = lambda t, k: F.array(F.struct(t.alias("text"), k.alias("type")))
    said = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("x")
    pairs = B.table(spark, sf, "part").select(F.inline(X.entity_labels(item(F.col("p_name"), code), item(said, code))))
    return A.confusion(pairs, "gold", "pred")


@query(
    "H33",
    """select p_partkey, p_size % 3 <> 2 as ok, ['A', 'B'][p_size % 2 + 1] as letter from part""",
)
def open_answer(spark, sf):
    size = F.col("p_size")
    resp = F.when(size % 3 == 0, F.concat(F.lit("We compute.\nSo the result is "), F.format_number(size.cast("double") * 1000, 0), F.lit("."))).when(
        size % 3 == 1, F.concat(F.lit("Therefore it is a "), "p_name")).otherwise("x = nothing")
    gold = F.when(size % 3 == 0, (size * 1000).cast("string")).otherwise(F.upper("p_name"))
    letter = F.when(size % 2 == 0, "maybe (B), but finally (A)").otherwise("I say B .")
    letters = F.array(F.lit("A"), F.lit("B"))
    return B.table(spark, sf, "part").select(
        "p_partkey", X.open_answer_match(X.parse_open_response(resp), F.array(gold)).alias("ok"), X.parse_choice_response(letter, letters, letters).alias("letter")
    )


# ---------------------------------------------------------------- grouped reading scores


@query(
    "A15",
    f"""with n as (select o_custkey, array_to_string({sql_norm('o_orderpriority')}, ' ') as p,
        array_to_string({sql_norm("case when o_orderkey % 2 = 0 then 'the ' || o_orderpriority else o_orderstatus end")}, ' ') as r from orders)
        select round(avg(exists(select 1 from n b where b.o_custkey = a.o_custkey and b.r = a.p)::int), 9) as em from n a""",
)
def group_exact_match(spark, sf):
    ref = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("the "), "o_orderpriority")).otherwise(F.col("o_orderstatus"))
    o = B.table(spark, sf, "orders").withColumn("ref", ref)
    return R.group_exact_match(o, "o_custkey", "o_orderpriority", "ref").select(F.round("em", 9).alias("em"))


@query(
    "A15",
    f"""with f as (select conv_id, p, r from {TOK} qualify row_number() over (partition by conv_id order by turn) = 1),
        s as (select {B.sql_overlap('p', 'r')} as n, len(p) as a, len(r) as b from f)
        select round(avg(case when n > 0 then 2.0 * n / (a + b) else 0 end), 9) as f1 from s""",
)
def group_f1(spark, sf):
    return R.group_f1(B.replies(spark, sf), "conv_id", F.col("turn"), "pred", "ref").select(F.round("f1", 9).alias("f1"))


SQUAD = """(select o_orderkey as id, o_orderstatus <> 'P' as has_answer, o_orderkey % 3 <> 0 as answered,
  case when o_orderstatus = 'P' then (o_orderkey % 3 = 0)::int::double else (o_orderkey % 5 = 0)::int::double end as exact,
  case when o_orderstatus = 'P' then (o_orderkey % 3 = 0)::int::double else (o_orderkey % 5) / 4.0 end as f1, (o_custkey % 97) / 97.0::double as na_prob from orders)"""


def squad_rows(spark, sf):
    k, no = F.col("o_orderkey"), F.col("o_orderstatus") == "P"
    empty = (k % 3 == 0).cast("double")
    return B.table(spark, sf, "orders").select(
        k.alias("id"), (~no).alias("has_answer"), (k % 3 != 0).alias("answered"),
        F.when(no, empty).otherwise((k % 5 == 0).cast("double")).alias("exact"), F.when(no, empty).otherwise((k % 5) / 4.0).alias("f1"),
        ((F.col("o_custkey") % 97) / 97.0).alias("na_prob"),
    )


@query(
    "A16",
    f"""select round(100 * avg(exact), 9) as exact, round(100 * avg(f1), 9) as f1, round(100 * avg(exact) filter (has_answer), 9) as "HasAns_exact",
        round(100 * avg(f1) filter (has_answer), 9) as "HasAns_f1", round(100 * avg(exact) filter (not has_answer), 9) as "NoAns_exact",
        round(100 * avg(f1) filter (not has_answer), 9) as "NoAns_f1" from {SQUAD}""",
)
def no_answer_scores(spark, sf):
    out = R.no_answer_scores(squad_rows(spark, sf))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "A16",
    f"""with g as (select *, sum(case when has_answer then f1 when answered then -1.0 else 0 end) over (order by na_prob, id rows unbounded preceding) as run from {SQUAD})
        select round(100.0 * (count(*) filter (not has_answer) + greatest(max(run), 0)) / count(*), 6) as best_f1 from g""",
)
def best_threshold_f1(spark, sf):
    return R.best_threshold(squad_rows(spark, sf), "f1").select(F.round("best_f1", 6).alias("best_f1"))
