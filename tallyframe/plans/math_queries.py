"""Queries over mathematics answers (inventory H34-H42, S1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import maths as M
from tallyframe.functions.text import best_answer, translate_label
from tallyframe.plans import bindings as B
from tallyframe.plans.registry import query
from tallyframe.session import spread


def parts(spark, sf):
    """The parts, dealt to all cores: a large table of them is few splits of a file, and an answer costs far more than its row."""
    return spread(B.table(spark, sf, "part"))


def cat(*xs):
    return F.concat(*[F.lit(x) if isinstance(x, str) and not x.startswith("p_") else F.col(x).cast("string") if isinstance(x, str) else x for x in xs])


@query(
    "H34",
    """select p_partkey, '\\frac{' || p_size || '}{' || (p_size + 1) || '}' as boxed, 'v' || p_size as plain, p_name || '|' || p_brand as entries from part""",
)
def extract_boxed(spark, sf):
    up = (F.col("p_size") + 1).cast("string")
    braces = cat("so \\boxed{no} and $\\boxed{\\frac{", "p_size", "}{", up, "}}$ holds {here}")
    plain = cat("thus boxed v", "p_size", "$ done")
    return parts(spark, sf).select(
        "p_partkey", M.extract_boxed(braces).alias("boxed"), M.extract_boxed(plain).alias("plain"),
        F.array_join(M.boxed_entries(cat("a \\boxed{", "p_name", "} b \\boxed{", "p_brand", "} c")), "|").alias("entries"),
    )


@query(
    "H35 H46",
    """select p_partkey, p_size || '' as minerva, p_size || '' as phrase, round(p_retailprice, 2)::varchar as last, p_size || '' as chinese from part""",
)
def extract_answer(spark, sf):
    price = F.format_string("%.2f", "p_retailprice")
    last = M.last_number(F.concat(F.lit("first 12, then 1,5 and "), F.regexp_replace(price, r"0\z", ""), F.lit(" in the end")))
    return parts(spark, sf).select(
        "p_partkey",
        M.extract_answer(cat("The final answer is $", "p_size", "$. I hope it is right 77"), "minerva_math").alias("minerva"),
        M.extract_answer(cat("2 + 2. The answer is: ", "p_size", " miles.")).alias("phrase"),
        last.alias("last"),
        M.extract_answer(cat("因此答案是 ", "p_size", "\n\n其他 5")).alias("chinese"),
    )


@query(
    "H36",
    """with l as (select *, ['A', 'B', 'C', 'D', 'E'][p_size % 5 + 1] as l from part) select p_partkey, l as triggered, l as last, l as searched, l as settled from l""",
)
def choice_answers(spark, sf):
    l = F.get(F.array(*map(F.lit, "ABCDE")), F.col("p_size") % 5)
    return parts(spark, sf).select(
        "p_partkey",
        M.choice_clean(F.concat(F.lit("A or B? The answer is ("), l, F.lit("), not A."))).alias("triggered"),
        M.choice_clean(F.concat(F.lit("A, B and finally "), l, F.lit("."))).alias("last"),
        M.extract_multi_choice(F.concat(F.lit("The choice is ("), F.lower(l), F.lit(") Problem: answer is a"))).alias("searched"),
        M.settle_choice(F.lit("12"), F.concat(F.lit("correct option is "), l, F.lit(".")), l).alias("settled"),
    )


@query(
    "H37",
    """select p_partkey, p_size || '' as units, '\\frac{' || p_size || '}{7}' as slash, '\\frac{1}{' || p_size % 10 || '}' as bare, p_size || '' as decimals,
       '\\sqrt{' || p_size || '}' as root, ['zero', 'one', 'two'][p_size % 3 + 1] is not null as word from part""",
)
def strip_string(spark, sf):
    digit = (F.col("p_size") % 10).cast("string")
    word = F.get(F.array(*map(F.lit, ["zero", "one", "two"])), F.col("p_size") % 3)
    return parts(spark, sf).select(
        "p_partkey",
        M.strip_string(cat(" $", "p_size", "$ square feet.")).alias("units"),
        M.strip_string(cat("x = ", "p_size", "/7"), skip_unit=True).alias("slash"),
        M.strip_string(F.concat(F.lit("\\dfrac1"), digit)).alias("bare"),
        M.strip_string(cat("p_size", ".000\\%")).alias("decimals"),
        M.strip_string(cat("\\left\\sqrt", "p_size", "\\right")).alias("root"),
        (M.strip_string(word) == (F.col("p_size") % 3).cast("string")).alias("word"),
    )


@query(
    "H38",
    """select o_orderkey, o_orderkey % 4 <> 3 as equal from orders""",
)
def numeric_equal(spark, sf):
    k, p = F.col("o_orderkey") % 4, F.col("o_totalprice")
    pred = (
        F.when(k == 0, F.format_number(p, 2)).when(k == 1, F.concat(F.format_string("%.2f", p), F.lit("\\%")))
        .when(k == 2, F.format_string("%.4f", p * 100)).otherwise(F.format_string("%.2f", p * 1.01))
    )
    return B.table(spark, sf, "orders").select("o_orderkey", M.numeric_equal(pred, F.format_string("%.2f", p)).alias("equal"))


@query(
    "H39",
    """select p_partkey, p_size % 6 <> 5 as equal from part""",
)
def math_equal(spark, sf):
    k, n, b = F.col("p_size") % 6, F.col("p_size").cast("string"), F.col("p_name")
    pred = (
        F.when(k == 0, F.upper(b)).when(k == 1, cat("(", n, ", 2.0)")).when(k == 2, cat("y=", n))
        .when(k == 3, cat("{", b, "}")).when(k == 4, cat("\\begin{pmatrix}", n, " & 2 \\\\ 3 & 4\\end{pmatrix}")).otherwise(cat("(", n, ",3)"))
    )
    ref = (
        F.when(k == 0, cat(" ", b)).when(k == 1, cat("(", n, ".0,2)")).when(k == 2, n)
        .when(k == 3, b).when(k == 4, cat("\\begin{pmatrix}", n, ".0 & 2\\\\3 & 4.00\\end{pmatrix}")).otherwise(cat("(", n, ",2)"))
    )
    return parts(spark, sf).select("p_partkey", M.math_equal(pred, ref).alias("equal"))


@query(
    "H39",
    """select p_partkey, case p_partkey % 9 when 1 then p_size = 2 when 3 then false when 5 then false when 8 then false else true end as equal from part""",
)
def nested_answers(spark, sf):
    """Tuples of tuples, unions of intervals and matrices in tuples made of whole columns; the SQL states them by their parts."""
    k, n, x = F.col("p_partkey") % 9, F.col("p_size").cast("string"), F.format_string("%.2f", "p_retailprice")
    more, longer = F.format_string("%.2f", F.col("p_retailprice") * 1.01), F.format_string("%.4f", "p_retailprice")
    matrix = lambda a: cat("(\\begin{pmatrix}", a, " & 1 \\\\ 2 & 3\\end{pmatrix}, ", x, ")")
    pred = (
        F.when(k == 0, cat("((", n, ", 2.0), ", x, ")")).when(k == 1, cat("((", n, ".0,2),", x, ")")).when(k == 2, cat("(-\\infty, ", n, "] \\cup [", x, ", \\infty)"))
        .when(k == 3, cat("(0,", n, "]\\cup[", x, ",y)")).when(k == 4, matrix(cat(n, ".0"))).when(k == 5, cat("((", n, ".0,2),", x, ")"))
        .when(k == 6, cat("x=((", n, ",1),2)")).when(k == 7, cat("(((", n, ",1),2),(3,", x, "))")).otherwise(cat("((", n, ".0,1),", x))
    )
    ref = (
        F.when(k == 0, cat("((", n, ".0,2),", longer, ")")).when(k == 1, cat("((2,", n, "),", x, ")")).when(k == 2, cat("[", longer, ",\\infty)\\cup(-\\infty,", n, ".0]"))
        .when(k == 3, cat("(0,", n, "]\\cup[", more, ",y)")).when(k == 4, matrix(n)).when(k == 5, cat("(", n, ",(2,", x, "))"))
        .when(k == 6, cat("((", n, ".0,1),2)")).when(k == 7, cat("(((", n, ".0, 1.0), 2), (3, ", longer, "))")).otherwise(cat("((", n, ",1),", x))
    )
    return parts(spark, sf).select("p_partkey", M.math_equal(pred, ref).alias("equal"))


@query(
    "H40",
    """select p_partkey, p_size || '' as gt, 'How many ' || p_name || 's?' as question_text from part""",
)
def parse_ground_truth(spark, sf):
    p = parts(spark, sf).select("p_partkey", cat("Reason. #### ", "p_size").alias("answer"), cat(" How many ", "p_name", "s? ").alias("question"))
    out = M.parse_question(M.parse_ground_truth(p, "gsm8k"), "gsm8k")
    return out.select("p_partkey", "gt", "question_text")


@query(
    "H40 S2",
    """select p_partkey, case when p_size % 2 = 0 then '0.5' else '1200' end as gt,
       'Read the following table regarding "T" and answer a question:' || chr(10) || p_name || chr(10) || 'q' || case when p_size % 2 = 0 then ' Please select from the following options: x' else '' end as question_text from part""",
)
def parse_table_question(spark, sf):
    even = F.col("p_size") % 2 == 0
    p = parts(spark, sf).select(
        "p_partkey", F.lit("s").alias("solution"), F.when(even, "1/2").otherwise("1,200").alias("answer"), F.lit("decimal_number").alias("ans_type"),
        F.lit("T").alias("table_title"), F.col("p_name").alias("table"), F.lit("q").alias("question"), F.when(even, "x").alias("choices"),
    )
    return M.parse_question(M.parse_ground_truth(p, "tabmwp"), "tabmwp").select("p_partkey", "gt", "question_text")


@query(
    "H40",
    """select p_partkey, 'pick' || chr(10) || 'Answer Choices: (A) ' || p_name || ' (B) ' || p_brand as question_text, ['A', 'B'][p_size % 2 + 1] as gt from part""",
)
def parse_choice_question(spark, sf):
    p = parts(spark, sf).select("p_partkey", F.lit("pick").alias("question"), F.array("p_name", "p_brand").alias("choices"), (F.col("p_size") % 2).alias("answer"))
    # option letters hold no units
    out = M.parse_ground_truth(p, "mmlu_stem")
    return M.parse_question(out, "mmlu_stem").select("p_partkey", "question_text", "gt")


@query(
    "H41",
    """select p_partkey, case p_size % 4 when 0 then 'True' when 1 then 'False' when 2 then 'it is (b)' else p_size || '*3.14' end as answer from part""",
)
def theorem_answer(spark, sf):
    k = F.col("p_size") % 4
    text = F.when(k == 0, "Yes, it holds").when(k == 1, "That is false").when(k == 2, "it is (b)").otherwise(cat("x = ", "p_size", "\\pi"))
    return parts(spark, sf).select("p_partkey", M.theorem_answer(text).alias("answer"))


@query(
    "H42",
    """select p_partkey, ['A', 'B', 'C'][p_size % 3 + 1] as roman, ['A', 'B', 'C'][p_size % 3 + 1] as numeral, ['A', 'B', 'C'][p_size % 3 + 1] as best from part""",
)
def label_translate(spark, sf):
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("p_size") % 3)
    return parts(spark, sf).select(
        "p_partkey",
        translate_label(pick(["i", "II", "iii"]), list("ABC"), "{roman_numeral}").alias("roman"),
        translate_label(pick(["1", "2", "3"]), list("ABC"), "{numeral}").alias("numeral"),
        best_answer(F.concat(F.lit("I think The best answer is ("), pick(["a", "b", "c"]), F.lit("). ok\nno"))).alias("best"),
    )


@query("H34 H35", """select doc_id, coalesce(list_last(regexp_extract_all(replace(text, ',', ''), '(-?\\d*\\.?\\d+)', 1)), '') as last from documents""")
def last_number_of_documents(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", M.last_number(F.col("text")).alias("last"))


@query(
    "H39 A25 A26",
    """with n as (select page_id, coalesce(list_last(regexp_extract_all(replace(html, ',', ''), '(-?\\d*\\.?\\d+)', 1)), '') as l from pages)
       select page_id, regexp_replace(regexp_replace(l, '(\\d+)\\.0*$', '\\1'), '^\\.', '0.') as pred, true as score from n""",
)
def scored_replies(spark, sf):
    """Answers extracted from page titles and compared with the last number of the page."""
    p = B.table(spark, sf, "pages")
    pred = M.extract_answer(F.col("html"))
    return p.select("page_id", pred.alias("pred"), M.math_equal(pred, M.last_number(F.col("html"))).alias("score"))
