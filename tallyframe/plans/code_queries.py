"""Queries over code answers, trajectories and instruction checks (inventory H43-H51)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import code as C
from tallyframe.functions import instructions as I
from tallyframe.functions import language as L
from tallyframe.operators import aggregates as A
from tallyframe.operators import attempts as T
from tallyframe.plans import bindings as B
from tallyframe.plans.registry import query


def parts(spark, sf):
    return B.table(spark, sf, "part")


def cat(*xs):
    return F.concat(*[F.lit(x) if isinstance(x, str) and not x.startswith("p_") else F.col(x).cast("string") if isinstance(x, str) else x for x in xs])


NL = "chr(10)"


@query(
    "H43",
    f"select p_partkey, 'print(' || p_size || ')' || {NL} || '# ' || p_name as chat, 'x = ' || p_size as tagged, 'a' || {NL} || 'b' as trimmed, '' as missing from part",
)
def extract_code_block(spark, sf):
    chat = cat("Here:\n```python\nprint(", "p_size", ")\n# ", "p_name", "\n```\nand ```")
    return parts(spark, sf).select(
        "p_partkey", C.extract_code_block(chat).alias("chat"),
        C.extract_code_block(cat("[PYTHON]\nx = ", "p_size", "\n[/PYTHON]\n```\nno\n```"), "tagged").alias("tagged"),
        C.trim_last_fence(F.lit("a\nb```\nc")).alias("trimmed"), C.extract_code_block(F.col("p_name")).alias("missing"),
    )


@query("H44", "select p_partkey, '[' || p_size || ', 2]' as expected, p_size % 2 = 0 as equal from part")
def extract_assert(spark, sf):
    text = cat("assert f(1) == 3\ntext\nassert f(", "p_size", ") == [", "p_size", ", 2]\nend")
    right = C.assert_right_side(C.extract_assert(text))
    other = F.when(F.col("p_size") % 2 == 0, cat("[", "p_size", ",  2]")).otherwise("[0]")
    return parts(spark, sf).select("p_partkey", right.alias("expected"), C.literal_equal(right, other).alias("equal"))


@query("H45", "select p_partkey, p_size || '' as output, 'f(' || p_size || ')' as input from part")
def answer_tag(spark, sf):
    return parts(spark, sf).select(
        "p_partkey", C.answer_tag(cat("think == 3 [ANSWER] f(2) == ", "p_size", " [ANSWER]"), "output", cot=True).alias("output"),
        C.answer_tag(cat("assert f(", "p_size", ") == 9"), "input").alias("input"),
    )


@query(
    "H46",
    f"""select conv_id, turn, case when instr(text, {NL}) > 0 then trim(substr(text, 1, instr(text, {NL}) - 1)) else trim(text) end as cut from conversations""",
)
def stop_truncate(spark, sf):
    c = B.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", C.stop_truncate(F.col("text"), ["</s>", "\n"]).alias("cut"))


@query(
    "H47",
    f"""select p_partkey, 'rationale|program|output|rationale|program|output|rationale' as roles, 'import ' || p_brand || {NL} || 'x = ' || p_size || {NL} as program, 'v' || p_size as output from part""",
)
def split_trajectory(spark, sf):
    text = cat(
        "Try.\n```python\nimport ", "p_brand", "\nbad()\n```\n```output\nNameError\n```\nAgain.\n```python\nx = ", "p_size",
        "\n```\n```output\nv", "p_size", "\n```\nDone.",
    )
    t = C.split_trajectory(text)
    return parts(spark, sf).select(
        "p_partkey", F.array_join(F.transform(t, lambda x: x["role"]), "|").alias("roles"), C.merge_programs(t).alias("program"),
        C.program_output(text).alias("output"),
    )


@query(
    "H48 A24",
    """with g as (select l_orderkey, l_tax > 0 and l_discount > 0 as ok from lineitem), p as (select l_orderkey, count(*) as n, count(*) filter (ok) as c from g group by 1)
       select round(avg(c::double / n), 9) as pass_at_1 from p""",
)
def grade_tests(spark, sf):
    codes = F.array(F.when(F.col("l_tax") > 0, 1).otherwise(-2), F.when(F.col("l_discount") > 0, 1).otherwise(0))
    li = B.table(spark, sf, "lineitem").select("l_orderkey", codes.alias("results"))
    counts = C.grade_tests(li, "l_orderkey", "results")
    return counts.agg(F.round(F.avg(T.pass_at_k_value(F.col("n"), F.col("c"), 1)), 9).alias("pass_at_1"))


@query("H49", "select conv_id, turn, true as same, length(text) = 0 as other from conversations")
def output_compare(spark, sf):
    c = B.table(spark, sf, "conversations")
    padded = F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit(" \n")), F.lit("\n"))
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda l: F.trim(l)), "\n")
    return c.select("conv_id", "turn", C.output_compare(padded, lines).alias("same"), C.output_compare(F.lit("x"), F.col("text")).alias("other"))


@query("H50", "select event_id, true as fenced, (event_id % 2 = 0) as broken from events")
def json_valid(spark, sf):
    e = B.table(spark, sf, "events")
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    broken = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("{"), "props"))
    return e.select("event_id", C.json_valid(fenced).alias("fenced"), C.json_valid(broken).alias("broken"))


IDS = [
    "punctuation:no_comma", "length_constraints:number_words", "keywords:frequency", "keywords:existence", "detectable_content:number_placeholders",
    "keywords:letter_frequency", "startend:quotation", "keywords:forbidden_words",
]
KWARGS = [{}, {"relation": "at least", "num_words": "60"}, {"keyword": "the", "relation": "less than", "frequency": "3"}, {"keywords": "the|an"},
          {"num_placeholders": "1"}, {"letter": "q", "let_relation": "at least", "let_frequency": "4"}, {}, {"forbidden_words": "of|zz"}]


def instruction_rows(spark, sf):
    one = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else F.create_map().cast("map<string,string>")
    d = B.table(spark, sf, "documents").select("doc_id", "text")
    return d.withColumn("ids", F.array(*map(F.lit, IDS))).withColumn("kwargs", F.array(*map(one, KWARGS)))


FLAGS = """[text not like '%,%', len(regexp_extract_all(text, '[\\p{L}\\p{N}_\\p{M}]+')) >= 60, len(regexp_extract_all(lower(text), 'the')) < 3,
  contains(lower(text), 'the') and contains(lower(text), 'an'), regexp_matches(text, '\\[[^\\n]*?\\]'), len(text) - len(replace(lower(text), 'q', '')) >= 4, false,
  not regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(of|zz)($|[^\\p{L}\\p{N}_])')]"""


@query("H51", f"select doc_id, array_to_string(list_transform({FLAGS}, lambda f: case when f then '1' else '0' end), '') as flags from documents")
def check_instructions_strict(spark, sf):
    out = I.check_instructions(instruction_rows(spark, sf), ["doc_id"], "ids", "kwargs", "text", known=IDS, loose=False)
    return out.select("doc_id", F.array_join(F.transform("inst_level_strict", lambda f: f.cast("int").cast("string")), "").alias("flags"))


# Whole texts with marks spliced in by id, so that each check meets texts that pass and texts that fail.
SPLICED = """(select doc_id, case when doc_id % 3 = 0 then '* ' else '' end || text
  || case doc_id % 4 when 1 then chr(10) || '- x' when 2 then ' <<A title>>' when 3 then chr(10) || 'P.S. bye' else '' end
  || case when doc_id % 5 = 0 then chr(10) || chr(10) || 'Section 1' || chr(10) || chr(10) || 'Section 2' else '' end
  || case when doc_id % 7 = 0 then ' ****** other' else '' end
  || case when doc_id % 11 = 0 then ' My answer is no.' else '' end || case when doc_id % 13 = 0 then ' *bold* **x** THE END' else '' end as r from documents)"""
MORE_IDS = [
    "detectable_content:postscript", "detectable_format:number_bullet_lists", "detectable_format:constrained_response",
    "detectable_format:number_highlighted_sections", "detectable_format:multiple_sections", "detectable_format:title",
    "combination:two_responses", "startend:end_checker", "length_constraints:number_sentences", "combination:repeat_prompt",
    "change_case:capital_word_frequency", "detectable_format:json_format",
]
MORE_KWARGS = [
    {"postscript_marker": "P.S."}, {"num_bullets": "1"}, {}, {"num_highlights": "2"}, {"section_spliter": "Section", "num_sections": "2"}, {}, {},
    {"end_phrase": "the end"}, {"relation": "at least", "num_sentences": "12"}, {"prompt_to_repeat": "the"},
    {"capital_relation": "less than", "capital_frequency": "3"}, {},
]
TRIMMED = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
MORE_FLAGS = f"""[regexp_matches(lower(r), 'p\\.\\s?s\\.'),
  len(regexp_extract_all(r, '(?m)^\\s*\\*[^\\*].*$')) + len(regexp_extract_all(r, '(?m)^\\s*-.*$')) = 1,
  contains(r, 'My answer is yes.') or contains(r, 'My answer is no.') or contains(r, 'My answer is maybe.'),
  len(list_filter(regexp_extract_all(r, '\\*[^\\n\\*]*\\*'), lambda h: trim(replace(h, '*', '')) <> ''))
    + len(list_filter(regexp_extract_all(r, '\\*\\*[^\\n\\*]*\\*\\*'), lambda h: trim(h[3:-3]) <> '')) >= 2,
  len(regexp_extract_all(r, '\\s?Section\\s?[0-9]+\\s?')) >= 2, regexp_matches(r, '<<[^\\n]*[^<>\\s][^\\n]*>>'),
  len(list_filter(string_split(r, '******'), lambda x: {TRIMMED('x')} <> '')) = 2 and {TRIMMED("string_split(r, '******')[1]")} <> {TRIMMED("string_split(r, '******')[2]")},
  ends_with(lower({TRIMMED('r')}), 'the end'),
  len(list_filter(string_split_regex(r, '[.!?。！？]+'), lambda x: {TRIMMED('x')} <> '')) >= 12,
  starts_with(lower({TRIMMED('r')}), 'the'),
  len(list_filter(string_split_regex(r, '[^\\p{{L}}\\p{{N}}\\-'']+'), lambda w: regexp_matches(w, '\\p{{Lu}}') and upper(w) = w)) < 3, false]"""


@query(
    "H51",
    f"select doc_id, array_to_string(list_transform({MORE_FLAGS}, lambda f: case when f then '1' else '0' end), '') as flags from {SPLICED}",
)
def check_instructions_more(spark, sf):
    one = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else F.create_map().cast("map<string,string>")
    d = B.table(spark, sf, "documents").select("doc_id", F.expr(SPLICED[len("(select doc_id, "):SPLICED.rindex(" as r from")].replace("chr(10)", "char(10)")).alias("r"))
    d = d.withColumn("ids", F.array(*map(F.lit, MORE_IDS))).withColumn("kwargs", F.array(*map(one, MORE_KWARGS)))
    out = I.check_instructions(d, ["doc_id"], "ids", "kwargs", "r", known=MORE_IDS, loose=False)
    return out.select("doc_id", F.array_join(F.transform("inst_level_strict", lambda f: f.cast("int").cast("string")), "").alias("flags"))


BARE = "regexp_replace(array_to_string({}, chr(10)), '^\\s+|\\s+$', '', 'g')"


@query(
    "H51 A19",
    f"""with d as (select doc_id, text, string_split(text, chr(10)) as l from documents),
       v as (select doc_id, 0 as k, text from d union all select doc_id, 1, {BARE.format('l[2:]')} from d
             union all select doc_id, 2, {BARE.format('l[1:len(l) - 1]')} from d union all select doc_id, 3, {BARE.format('l[2:len(l) - 1]')} from d),
       w as (select * from v union all select doc_id, k + 4, replace(text, '*', '') from v),
       f as (select doc_id, k, list_transform({FLAGS}, lambda x: x and regexp_matches(text, '\\S')) as f from w),
       a as (select doc_id, any_value(f) filter (where k = 0) as s, [{', '.join(f'bool_or(f[{i}])' for i in range(1, 9))}] as l from f group by doc_id),
       n as (select list_sum(list_transform(s, lambda x: x::int)) as s, list_sum(list_transform(l, lambda x: x::int)) as l from a)
       select avg((s = 8)::int) as prompt_level_strict_acc, avg(s / 8) as inst_level_strict_acc,
              avg((l = 8)::int) as prompt_level_loose_acc, avg(l / 8) as inst_level_loose_acc from n""",
)
def instruction_accuracy(spark, sf):
    out = I.check_instructions(instruction_rows(spark, sf), ["doc_id"], "ids", "kwargs", "text", known=IDS)
    return out.agg(
        F.avg(F.col("prompt_level_strict").cast("int")).alias("prompt_level_strict_acc"), A.flag_mean(F.col("inst_level_strict")).alias("inst_level_strict_acc"),
        F.avg(F.col("prompt_level_loose").cast("int")).alias("prompt_level_loose_acc"), A.flag_mean(F.col("inst_level_loose")).alias("inst_level_loose_acc"),
    )


# Stated anew: the query must not take its word lists from the code that it checks.
VOTES = {
    "en": "the of and to in is that for it with was as on are by this", "fr": "le la les de des et un une que qui dans est pour pas en du",
    "de": "der die das und ist nicht ein eine mit für auf von zu den sich sch", "es": "el la los las de y que en un una por con para es se no",
    "it": "il la di che e un una per con non sono del si lo gli nel", "pt": "o a os as de e que um uma não para com em do da por",
}
VOTE_SQL = ", ".join(
    f"struct_pack(n := len(list_filter(w, lambda x: list_contains(string_split('{known}', ' '), x))), i := -{i}, c := '{code}')"
    for i, (code, known) in enumerate(VOTES.items())
)


@query(
    "H51",
    f"""with t as (select lang, list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') as w from documents),
       b as (select lang, list_max([{VOTE_SQL}]) as m from t)
       select lang, case when m.n > 0 then m.c end as detected, count(*) as n from b group by 1, 2""",
)
def detected_language(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.groupBy("lang", I.detect_language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


# Learned from three quarters of the documents, tried on the last one; the same counts, logarithms and sums in SQL.
LANGUAGES = """with t as (select doc_id, lang, list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda x: x <> '') as w from documents),
  e as (select doc_id, lang, flatten(list_transform(w, lambda x: ['^' || left(x, 3), right(x, 3) || '$'])) as g from t),
  c as (select lang, gram, count(*) as n from (select lang, unnest(g) as gram from e where doc_id % 4 <> 0) group by 1, 2),
  v as (select distinct gram from (select *, row_number() over (partition by lang order by n desc, gram) as k from c) where k <= 150),
  m as (select l.lang, v.gram, coalesce(c.n, 0) as n from (select distinct lang from c) l cross join v left join c on c.lang = l.lang and c.gram = v.gram),
  s as (select lang, gram, round(16 * ln((n + 1)::double / (sum(n) over (partition by lang) + (select count(*) from v))))::bigint as w from m),
  z as (select doc_id, s.lang, sum(w) as w from (select doc_id, unnest(g) as gram from e where doc_id % 4 = 0) p join s on s.gram = p.gram group by 1, 2),
  b as (select doc_id, lang, row_number() over (partition by doc_id order by w desc, lang) as k from z),
  o as (select e.doc_id, e.lang, b.lang as detected from e left join b on b.doc_id = e.doc_id and k = 1 where e.doc_id % 4 = 0)"""


def held_out_languages(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "lang", "text")
    profile = L.train_languages(d.filter("doc_id % 4 <> 0"), "text", "lang")
    return d.filter("doc_id % 4 = 0"), profile


@query("H51", LANGUAGES + " select lang, detected, count(*) as n from o group by 1, 2")
def language_confusion(spark, sf):
    """Languages of held-out documents against those that the trained profile finds."""
    d, profile = held_out_languages(spark, sf)
    return d.groupBy("lang", profile.detect(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


@query("H51", LANGUAGES + " select doc_id, coalesce(detected = lang, true) and regexp_matches(text, '\\S') as follows from o join documents using (doc_id, lang)")
def check_response_language(spark, sf):
    """The language instruction with the trained profile as detector."""
    d, profile = held_out_languages(spark, sf)
    asked = d.select("doc_id", "text", F.array(F.lit("language:response_language")).alias("ids"), F.array(F.create_map(F.lit("language"), "lang")).alias("kwargs"))
    out = I.check_instructions(asked, ["doc_id"], "ids", "kwargs", "text", known=["language:response_language"], loose=False, detect=profile.detect)
    return out.select("doc_id", F.col("prompt_level_strict").alias("follows"))
