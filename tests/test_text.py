import pytest
from pyspark.sql import functions as F

from tallyframe.functions import code as C
from tallyframe.functions import instructions as I
from tallyframe.functions import maths as M
from tallyframe.functions import text as X
from tallyframe.functions.filters import multi_choice_extract, regex_extract
from tallyframe.operators import requests as R


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("12 \\text{ miles}", "12"), ("\\frac12", "\\frac{1}{2}"), ("\\frac1{72}", "\\frac{1}{72}"), ("3/4", "\\frac{3}{4}"), ("x=5", "5"),
    ("50\\%", "50"), ("3.000", "3"), (".5", "0.5"), ("twenty one", "21"), ("5 feet", "5"), ("\\sqrt2", "\\sqrt{2}"), ("inf", "\\infty"),
    ("\\left( 1 , 2 \\right)", "(1,2)"), ("90^\\circ", "90"), ("\\text{yes}", "yes"), ("a/b", "/b"), ("u/v", "u/v"), ("07/8", "07/8"),
])
def test_strip_string(spark, raw, want):
    assert one(spark, M.strip_string(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [
    ("so \\boxed{\\frac{1}{2}} end", "\\frac{1}{2}"), ("boxed x+1$ rest", "x+1"), ("open \\boxed{a{b", "a{b"), ("tail boxed", ""),
])
def test_extract_boxed(spark, raw, want):
    assert one(spark, M.extract_boxed(F.lit(raw))) == want


def test_extract_answer_prefers_the_first_rule(spark):
    assert one(spark, M.extract_answer(F.lit("He answer is 3. \\boxed{4}"))) == "4"
    assert one(spark, M.extract_answer(F.lit("The answer is 1,000."))) == "1,000"
    assert one(spark, M.extract_answer(F.lit("we get 7 and 8.5 at last"))) == "8.5"
    assert one(spark, M.extract_answer(F.lit("no digits"))) == ""


@pytest.mark.parametrize("a, b, want", [
    ("33.3", str(100 / 3), False), ("50", "0.5", True), ("1,000", "1000", True), ("(1, 2)", "(1,2.0)", True), ("[1,2]", "(1,2)", True),
    ("x=3", "3", True), ("B.", "B", True), ("abc", "ABC", True), ("", "1", False), ("{2}", "2", True),
])
def test_math_equal(spark, a, b, want):
    assert one(spark, M.math_equal(F.lit(a), F.lit(b))) is want


def test_regex_filters(spark):
    flexible = r"(-?[$0-9.,]{2,})|(-?[0-9]+)"
    assert one(spark, regex_extract(F.lit("a 12 then $34.50 or 7"), flexible, -1)) == "7"
    assert one(spark, regex_extract(F.lit("#### 42"))) == "42"
    assert one(spark, regex_extract(F.lit("none"))) == "[invalid]"
    choices = F.array(F.lit("red apple"), F.lit("green (pear)"))
    ask = lambda t: one(spark, multi_choice_extract(F.lit(t), choices, r"\(([A-Z])\)"))
    assert ask("it is (B)") == "B" and ask("a green (pear) it is") == "(B)" and ask("answer: A") == "(A)" and ask("?") == "[invalid]"


def test_token_scores(spark):
    assert one(spark, X.token_f1(F.lit("The cat sat sat"), F.lit("a cat sat"))) == pytest.approx(2 * 2 / 5)
    assert one(spark, X.drop_scores(F.lit("3 yards"), F.array(F.lit("3.0 yards")))["em"]) == 1.0
    assert one(spark, X.drop_scores(F.lit("4 yards"), F.array(F.lit("3 yards")))["f1"]) == 0.0
    assert one(spark, X.reasoning_match(F.lit("The answer is (b)"), F.lit("b"))) is True
    assert one(spark, X.reasoning_match(F.lit("The answer is: [a, b]."), F.lit("a, b"))) is True


def test_code_text(spark):
    assert one(spark, C.extract_code_block(F.lit("x\n```py\na\nb\n```\n"))) == "a\nb"
    assert one(spark, C.assert_right_side(F.lit("assert f(1) == [1, 2]"))) == "[1, 2]"
    assert one(spark, C.literal_equal(F.lit("[1, 2]"), F.lit("[1,2]"))) is True
    assert one(spark, C.json_valid(F.lit('```json\n{"a": 1}\n```'))) is True
    text = "why\n```python\nx\n```\n```output\n1\n```\nso"
    assert one(spark, C.join_trajectory(C.split_trajectory(F.lit(text)))) == text


@pytest.mark.parametrize("name, kwargs, good, bad", [
    ("punctuation:no_comma", {}, "no mark", "a, b"),
    ("startend:quotation", {}, '"q"', "q"),
    ("detectable_format:title", {}, "<<t>>\nx", "<< >>"),
    ("combination:two_responses", {}, "a******b", "a******a"),
    ("length_constraints:number_paragraphs", {"num_paragraphs": "2"}, "a\n***\nb", "a"),
    ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": "2", "nth_paragraph": "2", "first_word": "so"}, "a\n\nSo, b", "a\n\nno"),
    ("detectable_format:number_bullet_lists", {"num_bullets": "2"}, "* a\n- b", "* a"),
    ("detectable_format:number_highlighted_sections", {"num_highlights": "1"}, "*h*", "h"),
    ("detectable_content:postscript", {"postscript_marker": "P.S."}, "x\nP.S. y", "x"),
    ("detectable_format:multiple_sections", {"section_spliter": "Section", "num_sections": "2"}, "Section 1 a Section 2 b", "Section"),
    ("keywords:forbidden_words", {"forbidden_words": "cat|dog"}, "category", "a CAT"),
    ("keywords:letter_frequency", {"letter": "e", "let_relation": "less than", "let_frequency": "2"}, "E", "ee"),
    ("change_case:english_lowercase", {}, "the end of it", "The end"),
    ("change_case:capital_word_frequency", {"capital_relation": "at least", "capital_frequency": "1"}, "a BIG one", "a big one"),
    ("length_constraints:number_sentences", {"relation": "at least", "num_sentences": "2"}, "One. Two", "One."),
    ("startend:end_checker", {"end_phrase": "Bye."}, 'well "bye."', "bye. now"),
    ("detectable_format:constrained_response", {}, "My answer is yes.", "yes"),
    ("combination:repeat_prompt", {"prompt_to_repeat": "Say it"}, "say it: x", "x"),
])
def test_instruction_checks(spark, name, kwargs, good, bad):
    kw = F.create_map(*[F.lit(x) for kv in kwargs.items() for x in kv]) if kwargs else F.create_map().cast("map<string,string>")
    row = spark.range(1).select(*[I.follows(F.lit(name), kw, F.lit(t), [name]).alias(n) for n, t in (("g", good), ("b", bad))]).first()
    assert (row["g"], row["b"]) == (True, False)


def test_loose_checks_drop_lines(spark):
    df = spark.createDataFrame([(1, ["punctuation:no_comma"], [{}], "Sure, here:\nplain")], "id long, i array<string>, k array<map<string,string>>, r string")
    got = I.check_instructions(df, ["id"], "i", "k", "r", known=["punctuation:no_comma"]).first()
    assert (got["prompt_level_strict"], got["prompt_level_loose"]) == (False, True)


def test_rolling_windows(spark):
    toks = F.array(*[F.lit(i) for i in range(34)])
    wins = one(spark, R.rolling_windows(toks, F.lit(-100), 10, 1))
    assert [w["predicted"] for w in wins] == [list(range(0, 10)), list(range(10, 20)), list(range(20, 30)), list(range(30, 34))]
    assert wins[0]["input"] == [-100, *range(0, 9)] and wins[3]["input"] == list(range(23, 33))
    assert one(spark, R.rolling_windows(F.array().cast("array<int>"), F.lit(-100), 10, 1)) == []
    pair = F.struct(F.array(*map(F.lit, range(1, 6))).alias("input"), F.array(*map(F.lit, (4, 5, 6))).alias("predicted"))
    got = one(spark, R.disjoint_window(pair))
    assert got["input"] == [1, 2, 3] and got["predicted"] == [4, 5, 6]
