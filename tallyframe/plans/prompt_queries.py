"""Queries over prompts and few-shot contexts (inventory P7-P14, P22, P23, J1-J3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import clean as C
from tallyframe.operators import prompts as P
from tallyframe.plans import bindings as B
from tallyframe.plans.registry import query

Q = "''"


def items(spark, sf):
    """Choice items: a part with three options, one of them right."""
    return B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("question"), F.array("p_brand", "p_type", "p_name").alias("options"),
        (F.col("p_size") % 3).cast("int").alias("answer_index"),
        F.get(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("p_size") % 3).alias("answer"),
    )


ITEMS_SQL = """(select p_partkey as doc_id, p_name as question, [p_brand, p_type, p_name] as options, (p_size % 3)::int as answer_index,
  ['A', 'B', 'C'][p_size % 3 + 1] as answer from part)"""


@query("P7 F5", """select o_orderkey, unnest([o_orderstatus, o_orderpriority]) as answer from orders""")
def explode_answers(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("answers"))
    return P.explode_answers(o, "answers").select("o_orderkey", "answer")


TYPED = """(select o_orderkey, case when o_orderkey % 11 = 0 then 'unanswerable' when o_orderkey % 3 = 0 then 'bool'
   when o_orderkey % 5 = 0 then 'free form answer' when o_orderkey % 7 = 0 then 'extractive_spans' when o_orderkey % 3 = 1 then 'bool' end as kind,
   case when o_orderkey % 11 = 0 then 'unanswerable' when o_orderkey % 3 = 0 then 'yes' when o_orderkey % 5 = 0 then o_orderpriority
   when o_orderkey % 7 = 0 then o_orderstatus || ', ' || o_orderpriority when o_orderkey % 3 = 1 then 'no' end as answer from orders)"""


def typed_orders(spark, sf):
    k = F.col("o_orderkey")
    blob = F.struct(
        (k % 11 == 0).alias("unanswerable"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("yes_no"),
        F.when(k % 5 == 0, F.col("o_orderpriority")).otherwise("").alias("free_form"),
        F.when(k % 7 == 0, F.array("o_orderstatus", "o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("spans"),
    )
    return B.table(spark, sf, "orders").select("o_orderkey", F.array(blob).alias("answers"))


@query("P7", f"select o_orderkey, answer from {TYPED} where kind = 'bool'")
def explode_yes_no_answers(spark, sf):
    return P.explode_typed_answers(typed_orders(spark, sf), "answers", "bool").select("o_orderkey", "answer")


@query("P7", f"select o_orderkey, answer from {TYPED} where kind = 'extractive_spans'")
def explode_span_answers(spark, sf):
    return P.explode_typed_answers(typed_orders(spark, sf), "answers", "extractive_spans").select("o_orderkey", "answer")


@query(
    "P7 H29",
    """with c as (select o_orderkey, case when o_orderkey % 2 = 0 then o_custkey::varchar when o_orderkey % 3 = 0 then o_orderstatus || '|' || o_orderpriority
       else strftime(o_orderdate, '%d %m %Y') end as a, case when o_custkey % 2 = 0 then o_custkey::varchar else strftime(o_orderdate, '%d %m %Y') end as b from orders)
       select o_orderkey, case when a = b then a else a || ';' || b end as answers from c""",
)
def valid_answers(spark, sf):
    o = B.table(spark, sf, "orders")
    day, month, year = [F.date_format("o_orderdate", p).alias(n) for p, n in (("dd", "day"), ("MM", "month"), ("yyyy", "year"))]
    none = F.array().cast("array<string>")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    first = F.struct(
        F.when(k % 2 == 0, c.cast("string")).otherwise("").alias("number"),
        F.when(k % 3 == 0, F.array("o_orderstatus", "o_orderpriority")).otherwise(none).alias("spans"), day, month, year,
    )
    second = F.struct(F.when(c % 2 == 0, c.cast("string")).otherwise("").alias("number"), none.alias("spans"), day, month, year)
    out = o.select("o_orderkey", P.valid_answers(first, F.array(second)).alias("a"))
    return out.select("o_orderkey", F.array_join(F.transform("a", lambda t: F.array_join(t, "|")), ";").alias("answers"))


TEMPLATES = ["Q: {q}", "Answer this: {q}", "{q}?"]


@query(
    "P8",
    f"""select doc_id, i as prompt_id, ['Q: {{q}}', 'Answer this: {{q}}', '{{q}}?'][i + 1] as prompt from {ITEMS_SQL}, (select unnest([0, 1, 2]) as i)""",
)
def expand_prompt_variants(spark, sf):
    return P.expand_prompt_variants(items(spark, sf).select("doc_id"), TEMPLATES)


@query(
    "P9",
    f"""select doc_id, l as always_same_option, answer_index as original_answer_index, case when p < 3 then p else answer_index end as answer_index,
        case when p < 3 then l else answer end as answer,
        array_to_string(case when p < 3 then list_transform(options, lambda x, i: case when i - 1 = answer_index then options[p + 1] when i - 1 = p then options[answer_index + 1] else x end)
        else options end, '|') as options from {ITEMS_SQL}, (select unnest(['A', 'B', 'C', 'D']) as l, unnest([0, 1, 2, 3]) as p)""",
)
def expand_option_orders(spark, sf):
    out = P.expand_option_orders(items(spark, sf), ["A", "B", "C", "D"])
    return out.select("doc_id", "always_same_option", "original_answer_index", "answer_index", "answer", F.array_join("options", "|").alias("options"))


SHUFFLED = f"""with o as (select doc_id, answer_index, options, list_sort(list_transform([0, 1, 2], lambda i: [md5('7:' || doc_id || ':' || i), i::varchar])) as s from {ITEMS_SQL}),
  t as (select doc_id, answer_index, options, list_transform(s, lambda x: x[2]::int) as ord from o)
  select doc_id, list_position(ord, answer_index)::int - 1 as answer_index, array_to_string(list_transform(ord, lambda i: options[i + 1]), '|') as options,
  ['A', 'B', 'C'][list_position(ord, answer_index)] as gold_letter from t"""


@query("P10", SHUFFLED)
def shuffle_choices(spark, sf):
    out = P.shuffle_choices(items(spark, sf), "doc_id", "options", "answer_index", seed=7)
    return out.select("doc_id", "answer_index", F.array_join("options", "|").alias("options"), "gold_letter")


@query(
    "P11 F6",
    f"""select doc_id, 'Question: ' || trim(question) || chr(10) || 'A. ' || options[1] || chr(10) || 'B. ' || options[2] || chr(10) || 'C. ' || options[3] || chr(10) || 'Answer:' as prompt,
        options[1] || ' / ' || upper(regexp_replace(options[3], '[aeiou]+', '_', 'g')) as extra, options[answer_index + 1] as target from {ITEMS_SQL}""",
)
def render_template(spark, sf):
    it = items(spark, sf).withColumn("listed", P.option_list(F.col("options")))
    return it.select(
        "doc_id",
        P.render_template("Question: {{question.strip()}}\n{{listed}}Answer:", it.columns).alias("prompt"),
        P.render_template("{{options[0]}} / {{options[-1]|regex_replace('[aeiou]+', '_')|upper}}", it.columns).alias("extra"),
        P.target_value(F.col("answer_index").cast("string"), F.col("options")).alias("target"),
    )


@query(
    "P11",
    f"""select doc_id, array_to_string(list_transform(options, lambda x, i: '(' || ['I', 'II', 'III'][i] || ') ' || x || ' [' || i || chr(96 + i::int) || ']'), '') as text from {ITEMS_SQL}""",
)
def roman_options(spark, sf):
    style = "({roman_numeral}) {option} [{numeral}{lower_case_letter}]"
    return items(spark, sf).select("doc_id", P.option_list(F.col("options"), style).alias("text"))


def replace_chain(profile: str, col: str = "text") -> str:
    esc = lambda x: x.replace("'", "''")
    out = col
    for kind, old, new in C.PROFILES[profile]:
        new = new.replace("$1", "\\1")
        out = f"regexp_replace({out}, '{esc(old)}', '{esc(new)}', 'g')" if kind == "r" else f"replace({out}, '{esc(old)}', '{esc(new)}')"
    return out


PROFILE_NAMES = ["general_detokenize", "dialogue_detokenize", "wiki_detokenize", "squeeze_spaces", "brackets"]


@query("P12", "select doc_id, " + ", ".join(f"md5({replace_chain(n)}) as {n}" for n in PROFILE_NAMES) + " from documents")
def clean_text(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", *[F.md5(C.clean_text(F.col("text"), n)).alias(n) for n in PROFILE_NAMES])


@query(
    "P13",
    """with e as (select p_partkey, list_sort(list_distinct([p_brand, p_type, p_type, p_name])) as e from part)
       select p_partkey, array_to_string(list_transform(e, lambda x: '  - the ' || x || ' thing'), '|') as choices from e""",
)
def entity_choices(spark, sf):
    p = B.table(spark, sf, "part")
    c = P.entity_choices(F.array("p_brand", "p_type", "p_type", "p_name"), F.lit("the @placeholder thing"))
    return p.select("p_partkey", F.array_join(c, "|").alias("choices"))


UNKNOWN_SQL = ", ".join("'" + u.replace("'", "''") + "'" for u in P.UNKNOWN_RESPONSES)


@query("P13", f"select p_partkey, array_to_string(list_concat([p_brand, p_name], [{UNKNOWN_SQL}]), '|') as choices from part")
def choices_with_unknown(spark, sf):
    p = B.table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(P.choices_with_unknown(F.array("p_brand", F.lit("Not known"), "p_name")), "|").alias("choices"))


@query(
    "P14",
    """with d as (select p_partkey, p_brand, p_name, case when p_size % 2 = 0 then 'neg' else 'nonneg' end as pol,
       case p_type when 'PROMO' then ['f', 'black'] when 'SMALL' then ['low ses', 'x'] else ['m', 'man'] end as g0,
       case when p_size % 3 = 0 then ['f', 'girl'] else ['non disabled'] end as g1, case p_size % 4 when 0 then ['f', 'x'] when 1 then ['man'] else ['non disabled'] end as s from part),
       b as (select *, list_has_any(g0, s) as h0, list_has_any(g1, s) as h1 from d)
       select p_partkey, array_to_string(g0, '_') as ans0_groups, array_to_string(g1, '_') as ans1_groups,
       array_to_string(list_concat(case when (pol = 'neg') = h0 then [p_brand] else []::varchar[] end, case when (pol = 'neg') = h1 then [p_name] else []::varchar[] end), '|') as biased from b""",
)
def bias_annotate(spark, sf):
    p, size = B.table(spark, sf, "part"), F.col("p_size")
    lits = lambda *xs: F.array(*map(F.lit, xs))
    info0 = F.when(F.col("p_type") == "PROMO", lits("F-Black")).when(F.col("p_type") == "SMALL", lits("lowSES-X")).otherwise(lits("man"))
    info1 = F.when(size % 3 == 0, lits("girl", "")).otherwise(lits("nonDisabled"))
    info1 = F.filter(info1, lambda x: x != "")
    stereo = F.when(size % 4 == 0, lits("F", "x")).when(size % 4 == 1, lits("man")).otherwise(lits("Non Disabled"))
    d = p.select(
        "p_partkey", F.col("p_brand").alias("ans0"), F.col("p_name").alias("ans1"), F.lit("Not known").alias("ans2"),
        F.struct(info0.alias("ans0"), info1.alias("ans1"), lits("unknown").alias("ans2")).alias("answer_info"),
        stereo.alias("stereotyped_groups"), F.when(size % 2 == 0, "neg").otherwise("nonneg").alias("question_polarity"),
    )
    out = P.bias_annotate(d)
    return out.select(
        "p_partkey", F.array_join("ans0_groups", "_").alias("ans0_groups"), F.array_join("ans1_groups", "_").alias("ans1_groups"),
        F.array_join("biased_answers", "|").alias("biased"),
    )


# ---------------------------------------------------------------- few-shot


def pool(spark, sf):
    return B.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("q"), F.concat(F.lit("n"), (F.col("item_id") % 4).cast("string")).alias("a"))


@query("J1", "select d.doc_id, p.item_id as pool_id, (p.item_id + 1)::int as rank from documents d, benchmark p where p.item_id < 5")
def fewshot_first_n(spark, sf):
    out = P.sample_fewshot(B.table(spark, sf, "documents"), "doc_id", pool(spark, sf), "item_id", 5, sampler="first_n")
    return out.select("doc_id", "pool_id", "rank")


# A walk over a ring of prime size with start and step from the document's hashes.
WALK = """with q as (select unnest(range((select count(*) from {pool}), 2 * (select count(*) from {pool}) + 3)) as q),
       r as (select min(q) as r from q where q >= 2 and not exists (select 1 from range(2, 1000) t(d) where d * d <= q and q % d = 0)),
       p as (select {id} as pool_id, row_number() over (order by md5('3:' || {id}), {id}) - 1 as pos, count(*) over () as n from {pool}),
       d as (select doc_id, r, (('0x' || substr(md5('3:' || doc_id), 1, 15))::bigint) % r as b,
             1 + (('0x' || substr(md5('3b:' || doc_id), 1, 15))::bigint) % (r - 1) as a from documents, r),
       c as (select doc_id, pool_id, row_number() over (partition by doc_id order by j) as rank
             from d, range(0, 60) t(j), p where j <= {k} + d.r - p.n and p.pos = (d.b + d.a * j) % d.r {own})
       select doc_id, pool_id, rank::int as rank from c where rank <= {k}"""


@query("J1", WALK.format(pool="benchmark", id="item_id", k=4, own=""))
def fewshot_random(spark, sf):
    out = P.sample_fewshot(B.table(spark, sf, "documents"), "doc_id", pool(spark, sf), "item_id", 4, seed=3)
    return out.select("doc_id", "pool_id", "rank")


@query("J1", WALK.format(pool="documents", id="doc_id", k=3, own="and pool_id <> doc_id"))
def fewshot_same_split(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "lang")
    return P.sample_fewshot(d, "doc_id", d, "doc_id", 3, seed=3, same_split=True).select("doc_id", "pool_id", "rank")


SHOTS = "(select string_agg({e}, '' order by item_id) as s from benchmark where item_id < 2)"


@query(
    "J2",
    f"""select conv_id, turn, 'Solve.' || chr(10) || s || text || ' A:' as context from conversations,
        {SHOTS.format(e="text || ' A: n' || (item_id % 4) || chr(10) || chr(10)")} where role = 'user'""",
)
def build_context(spark, sf):
    c = user_turns(spark, sf)
    shots = P.first_shots(pool(spark, sf), "item_id", 2)
    out = P.build_context(c, "key", "text", shots, "pool_q", "pool_a", description="Solve.\n", gen_prefix="A:")
    return out.select("conv_id", "turn", "context")


def user_turns(spark, sf):
    c = B.table(spark, sf, "conversations").filter("role = 'user'")
    return c.withColumn("key", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


@query(
    "J3",
    f"""select conv_id, turn, 'system:S|' || s || 'user:' || text as chat from conversations,
        {SHOTS.format(e="'user:' || text || '|assistant:n' || (item_id % 4) || '|'")} where role = 'user'""",
)
def build_chat(spark, sf):
    c = user_turns(spark, sf)
    shots = P.first_shots(pool(spark, sf), "item_id", 2)
    out = P.build_chat(c, "key", "text", shots, "pool_q", "pool_a", system="S")
    line = F.array_join(F.transform("chat", lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|")
    return out.select("conv_id", "turn", line.alias("chat"))


@query(
    "J3",
    f"""select conv_id, turn, 'user:' || s || text as chat from conversations,
        {SHOTS.format(e="text || ' n' || (item_id % 4) || chr(10) || chr(10)")} where role = 'user'""",
)
def build_chat_single_turn(spark, sf):
    c = user_turns(spark, sf)
    shots = P.first_shots(pool(spark, sf), "item_id", 2)
    out = P.build_chat(c, "key", "text", shots, "pool_q", "pool_a", multiturn=False)
    line = F.array_join(F.transform("chat", lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|")
    return out.select("conv_id", "turn", line.alias("chat"))


# ---------------------------------------------------------------- sheets and adapters


@query(
    "P22 F5",
    """select p_partkey, i as question_index, chr(10) || ['Translate', 'Explain'][i + 1] || chr(10) || [p_brand || ' ' || p_type, '2 ' || p_name][i + 1] || chr(10) as question,
       '{"' || [p_brand, '2'][i + 1] || '":""}' as answer_form, '{"' || [p_brand, '2'][i + 1] || '":"' || [p_name, p_type][i + 1] || '"}' as answers from part, (select unnest([0, 1]) as i)""",
)
def sheet_questions(spark, sf):
    part = lambda n, q, a: F.array(F.struct(n.alias("questionpart_n"), q.alias("question"), a.alias("answer")))
    c = F.col
    qs = F.array(
        F.struct(F.lit("Translate").alias("prompt"), part(c("p_brand"), c("p_type"), c("p_name")).alias("subprompts")),
        F.struct(F.lit("Explain").alias("prompt"), part(F.lit("2"), c("p_name"), c("p_type")).alias("subprompts")),
    )
    p = B.table(spark, sf, "part").select("p_partkey", F.lit("Pre").alias("preamble"), F.lit("Ctx").alias("context"), F.to_json(qs).alias("questions"))
    out = P.load_sheet_questions(p, "p_partkey", "preamble", "context", "questions")
    return out.select("p_partkey", "question_index", "question", "answer_form", "answers")


@query(
    "P23",
    """select p_partkey, 'the ' || p_brand as a, 'the ' || p_type as b, 'is ' || p_name as target, (p_size % 2)::int as gold from part""",
)
def adapt_blank_sentence(spark, sf):
    p = B.table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("the _ is "), "p_name").alias("sentence"), F.col("p_brand").alias("option1"), F.col("p_type").alias("option2"),
        (F.col("p_size") % 2 + 1).cast("string").alias("answer"),
    )
    out = C.adapt_item(p, "winogrande")
    return out.select("p_partkey", F.col("contexts")[0].alias("a"), F.col("contexts")[1].alias("b"), "target", "gold")


@query(
    "P23",
    """select p_partkey, 'Article: ' || p_name || chr(10) || chr(10) || 'Question: ' || p_brand || chr(10) || 'Answer: ' || p_type || chr(10) || p_type || '?' as text,
       'w|x|y|z' as choices, (p_size % 4)::int as gold from part""",
)
def adapt_last_problem(spark, sf):
    letters = F.array(*map(F.lit, "ABCD"))
    prob = lambda q, a, o: F.struct(q.alias("question"), a.alias("answer"), o.alias("options"))
    qs = F.array(
        prob(F.col("p_brand"), F.lit("B"), F.array(F.lit("q"), F.col("p_type"), F.lit("r"), F.lit("s"))),
        prob(F.concat("p_type", F.lit("?")), F.get(letters, F.col("p_size") % 4), F.array(*map(F.lit, "wxyz"))),
    )
    p = B.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("article"), F.to_json(qs).alias("problems"))
    return C.adapt_item(p, "race").select("p_partkey", "text", F.array_join("choices", "|").alias("choices"), "gold")


@query("P23", "select p_partkey, p_brand || '|' || p_type || '|' || p_name || '|4|5' as choices from part")
def adapt_lettered_options(spark, sf):
    text = F.concat(F.lit("a ) "), "p_brand", F.lit(" , b ) "), "p_type", F.lit(" , c ) "), "p_name", F.lit(" , d ) 4 , e ) 5"))
    p = B.table(spark, sf, "part").select("p_partkey", text.alias("options"))
    return C.adapt_item(p, "mathqa").select("p_partkey", F.array_join("choices", "|").alias("choices"))


@query(
    "P23",
    """select p_partkey, 'It was ' || p_name || case when p_size % 2 = 0 then ' because' else ' so' end as text, lower(substr(p_brand, 1, 1)) || substr(p_brand, 2) as c1 from part""",
)
def adapt_connected_premise(spark, sf):
    p = B.table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit(" It was "), "p_name", F.lit(". ")).alias("premise"),
        F.when(F.col("p_size") % 2 == 0, "cause").otherwise("effect").alias("question"), F.col("p_brand").alias("choice1"), F.col("p_type").alias("choice2"),
    )
    out = C.adapt_item(p, "copa", connectors={"cause": "because", "effect": "so"})
    return out.select("p_partkey", "text", F.col("choices")[0].alias("c1"))


@query(
    "P23",
    """select conv_id, turn, case when instr(text, chr(10)) > 0 then substr(text, 1, instr(text, chr(10)) - 1) else text end as question from conversations""",
)
def adapt_prepended_question(spark, sf):
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("input"))
    return C.adapt_item(c, "scrolls").select("conv_id", "turn", "question")


@query(
    "P23",
    """select p_partkey, p_name || '.|' || p_brand || '.|I have no comment.' as correct, p_type || '.' as incorrect from part""",
)
def adapt_truthful_references(spark, sf):
    p = B.table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("question"), F.array(F.concat(F.lit(" "), "p_name"), F.lit("  "), F.concat("p_brand", F.lit(". "))).alias("correct_answers"),
        F.array("p_type").alias("incorrect_answers"),
    )
    out = C.adapt_item(p, "truthfulqa")
    return out.select("p_partkey", F.array_join("correct_answers", "|").alias("correct"), F.array_join("incorrect_answers", "|").alias("incorrect"))


@query("P23", "select p_partkey, (p_size % 3)::int as gold, case p_size % 3 when 0 then p_name when 1 then p_brand else p_type end as target from part")
def adapt_one_based_answer(spark, sf):
    p = B.table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") % 3 + 1).cast("string").alias("correct_answer_id"), F.array("p_name", "p_brand", "p_type").alias("answer_options")
    )
    return C.adapt_item(p, "qa4mre").select("p_partkey", "gold", "target")


@query(
    "P23",
    """select p_partkey, 'Question: ' || p_name || '?' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || p_size || chr(10) || 'D. none' || chr(10) || 'Answer:' as text from part""",
)
def adapt_four_endings(spark, sf):
    p = B.table(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.lit("?")).alias("sent1"), F.col("p_brand").alias("ending0"), F.col("p_type").alias("ending1"),
        F.col("p_size").cast("string").alias("ending2"), F.lit("none").alias("ending3"),
    )
    return C.adapt_item(p, "medqa").select("p_partkey", "text")


@query(
    "P23",
    """select p_partkey, 'The ' || p_name || ' met it. ' || p_brand as text,
         'the ' || p_name || case when p_size % 2 = 0 then chr(39) || 's' else '' end || '|' || p_brand || case when p_size % 2 = 0 then chr(39) || 's' else '' end as options from part""",
)
def adapt_pronoun_options(spark, sf):
    """A possessive pronoun asks for possessive options; "The" inside a sentence is lower-cased."""
    p = B.table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("The  "), "p_name", F.lit(" met  it. "), "p_brand").alias("text"), F.array(F.concat(F.lit("The "), "p_name"), F.col("p_brand")).alias("options"),
        F.when(F.col("p_size") % 2 == 0, "His").otherwise("it").alias("pronoun"), F.lit(6).alias("pronoun_loc"),
    )
    return C.adapt_item(p, "wsc273").select("p_partkey", "text", F.array_join("options", "|").alias("options"))


@query(
    "P23",
    """select p_partkey, upper(p_name[1]) || lower(p_name[2:]) || ' ' || upper(p_type[1]) || lower(p_type[2:]) || ' ' || upper(p_brand[1]) || lower(p_brand[2:]) as query,
         p_type || '|' || p_brand as choices, 0 as label from part""",
)
def adapt_moral_story(spark, sf):
    p = B.table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("norm"), F.col("p_type").alias("situation"), F.col("p_brand").alias("intention"),
        F.col("p_type").alias("moral_action"), F.col("p_brand").alias("immoral_action"),
    )
    return C.adapt_item(p, "moral_stories").select("p_partkey", "query", F.array_join("choices", "|").alias("choices"), "label")


@query("P23", "select p_partkey from part where p_size % 5 <> 0 and p_size % 7 <> 0 and p_size % 11 <> 0 and p_size % 13 <> 0")
def adapt_prescriptions(spark, sf):
    """Rows without a diagnosis, without medicines, or with either in an Indic script go."""
    n, name = F.col("p_size"), F.col("p_name")
    p = B.table(spark, sf, "part").select(
        "p_partkey", F.when(n % 5 == 0, "NA").when(n % 7 == 0, F.concat(name, F.lit(" ब"))).otherwise(name).alias("diagnosis"),
        F.when(n % 11 == 0, F.array().cast("array<string>")).when(n % 13 == 0, F.array(name, F.lit("दव"))).otherwise(F.array("p_brand")).alias("medicines"),
    )
    return C.adapt_item(p, "prescriptions").select("p_partkey")
