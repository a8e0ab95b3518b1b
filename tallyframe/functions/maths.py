"""Answers of mathematics questions as text: extraction, clean-up and comparison."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.columns import after_first, any_of, before_first, let, literal_array, steps, strip, to_number

UNICODE = "(?U)"

# Unit words removed from answers, in order (each also with a plural s).
UNITS = [
    "east", "degree", "mph", "kmph", "ft", "m sqaure", " m east", "sq m", "deg", "mile", "q .", "monkey", "prime", "ratio",
    "profit of rs", "rd", "o", "gm", "p . m", "lb", "tile", "per", "dm", "lt", "gain", "ab", "way", "west", "a .", "b .", "c .",
    "d .", "e .", "f .", "g .", "h .", "t", "a", "h", "no change", "men", "soldier", "pie", "bc", "excess", "st", "inches", "noon",
    "percent", "by", "gal", "kmh", "c", "acre", "rise", "a . m", "th", "π r 2", "sq", "mark", "l", "toy", "coin", "sq . m", "gallon",
    "° f", "profit", "minw", "yr", "women", "feet", "am", "pm", "hr", "cu cm", "square", "v â € ™", "are", "rupee", "rounds", "cubic",
    "cc", "mtr", "s", "ohm", "number", "kmph", "day", "hour", "minute", "min", "second", "man", "woman", "sec", "cube", "mt",
    "sq inch", "mp", "∏ cm ³", "hectare", "more", "sec", "unit", "cu . m", "cm 2", "rs .", "rs", "kg", "g", "month", "km", "m", "cm",
    "mm", "apple", "liter", "loss", "yard", "pure", "year", "increase", "decrease", "d", "less", "Surface", "litre", "pi sq m", "s .",
    "metre", "meter", "inch",
]

# Number words.
SMALL_NUMBERS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
LARGE_NUMBERS = {"hundred": 100, "thousand": 1000, "million": 1000000, "billion": 1000000000}


def number_words() -> dict[str, int]:
    out = {w: i for i, w in enumerate(SMALL_NUMBERS)} | dict(LARGE_NUMBERS)
    for i, ten in enumerate(TENS):
        out[ten] = 20 + 10 * i
        for unit in range(1, 10):
            for sep in (" ", "-"):
                out[f"{ten}{sep}{SMALL_NUMBERS[unit]}"] = 20 + 10 * i + unit
    for n in range(1, 10):
        for word, value in LARGE_NUMBERS.items():
            out[f"{SMALL_NUMBERS[n]} {word}"] = n * value
    return out


def word_to_number(text: Column) -> Column:
    pairs = [F.lit(str(x)) for kv in number_words().items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(strip(text))), text)


#: Patterns of all unit words, each also with a plural s, and the numbers of those that begin with a word.
UNIT_PATTERNS = [UNICODE + rf"(^|\W)(?:{u})($|\W)" for u in UNITS + [u + "s" for u in UNITS]]
UNITS_BY_WORD: dict[str, list[int]] = {}
for _i, _u in enumerate(UNITS + [u + "s" for u in UNITS]):
    UNITS_BY_WORD.setdefault(re.findall(r"\w+", _u)[0], []).append(_i)


def remove_units(text: Column) -> Column:
    """Delete unit words between non-word marks, in list order, twice; never to an empty text.

    A unit is cut out between marks, so no cut makes a new word: only units whose first word stands in the text can ever
    match, and the others are not tried. Few patterns are left, and each costs its compilation.
    """
    numbers = F.create_map(*[x for w, own in UNITS_BY_WORD.items() for x in (F.lit(w), F.array(*map(F.lit, own)))])
    patterns = literal_array(UNIT_PATTERNS)
    tried = lambda w: F.coalesce(F.try_element_at(numbers, w), F.array().cast("array<int>"))

    def drop(acc: Column, i: Column) -> Column:
        return let(F.regexp_replace(acc, F.get(patterns, i), F.lit("$1$2")), lambda r: F.when(r != "", r).otherwise(acc))

    own = F.sort_array(F.flatten(F.transform(F.array_distinct(F.split(text, UNICODE + r"\W+")), tried)))
    return let(F.struct(text.alias("t"), own.alias("i")), lambda s: F.aggregate(F.concat(s["i"], s["i"]), s["t"], drop))


def _swap(*pairs: tuple[str, str]):
    def step(s: Column) -> Column:
        for old, new in pairs:
            s = F.replace(s, F.lit(old), F.lit(new))
        return s

    return step


def _sub(pattern: str, new: str):
    return lambda s: F.regexp_replace(s, pattern, new)


def fix_fractions(text: Column) -> Column:
    r"""``\frac12`` and ``\frac1{72}`` to braced form; unreadable fractions stay as they are."""

    def piece(p: Column, i: Column) -> Column:
        a, b, rest = F.substring(p, 1, 1), F.substring(p, 2, 1), F.substr(p, F.lit(3))
        second = F.when(b == "{", F.concat(b, rest)).otherwise(F.concat(F.lit("{"), b, F.lit("}"), rest))
        fixed = F.concat(F.lit("{"), a, F.lit("}"), second)
        return F.when((i == 0) | F.startswith(p, F.lit("{")), p).otherwise(fixed)

    def fix(parts: Column) -> Column:
        short = F.exists(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~F.startswith(p, F.lit("{")) & (F.length(p) < 2))
        return F.when(short, F.array_join(parts, "\\frac")).otherwise(F.array_join(F.transform(parts, piece), "\\frac"))

    return let(F.split(text, r"\\frac"), fix)


SLASH_SIDE = r"(0|-?[1-9]\d*|[^/]*sqrt[^/]*)"


def strip_string(text: Column, skip_unit: bool = False) -> Column:
    """Normal form of a LaTeX-like answer: marks, units, percent, decimals, fractions."""

    def text_unit(s: Column) -> Column:
        cut = strip(F.regexp_replace(s, r"\\text\{.*?\}$", ""))
        return let(cut, lambda c: F.when((c != "") & (c != s), c).otherwise(s))

    def infinity(s: Column) -> Column:
        long = F.replace(s, F.lit("infinity"), F.lit("\\infty"))
        return let(long, lambda l: F.when(F.contains(l, F.lit("\\infty")), l).otherwise(F.replace(l, F.lit("inf"), F.lit("\\infty"))))

    def imaginary(s: Column) -> Column:
        only_j = F.contains(s, F.lit("j")) & ~F.contains(s, F.lit("i"))
        return F.when(only_j, F.replace(s, F.lit("j"), F.lit("i"))).otherwise(s)

    def short_left_side(s: Column) -> Column:
        sides = F.split(s, "=")
        return F.when((F.size(sides) == 2) & (F.length(sides[0]) <= 2), F.get(sides, F.lit(1))).otherwise(s)

    return steps(
        strip(text),
        _swap(("\n", "")),
        _sub(r"\.+\z", ""),
        _swap(("\\!", "")),
        _sub(r"\\begin\{array\}\{.*?\}", r"\\begin{pmatrix}"),
        _sub(r"\\end\{array\}", r"\\end{pmatrix}"),
        _swap(("bmatrix", "pmatrix"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\neq", "\\ne"), ("\\leq", "\\le"), ("\\geq", "\\ge")),
        _swap(("\\left", ""), ("\\right", ""), ("\\{", "{"), ("\\}", "}")),
        text_unit,
        *([] if skip_unit else [remove_units]),
        _swap(("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("$", ""), ("\\(", ""), ("\\)", "")),
        word_to_number,
        _sub(r"\\text\{(.*?)\}", "$1"),
        _swap(*[(k, "") for k in ("x=", "y=", "z=", "x\\in", "y\\in", "z\\in", "x\\to", "y\\to", "z\\to")]),
        _swap(("\\emptyset", "{}"), ("(-\\infty,\\infty)", "\\mathbb{R}"), ("\\%", ""), ("%", ""), (" .", " 0."), ("{.", "{0.")),
        infinity,
        _swap(("+\\inity", "\\infty"), ("and", ""), ("\\mathbf", "")),
        _sub(r"\\mbox\{.*?\}", ""),
        imaginary,
        _sub(r"(\d+)\.0*([^\d])", "$1$2"),
        _sub(r"(\d+)\.0*\z", "$1"),
        _sub(r"^\.", "0."),
        short_left_side,
        _sub(UNICODE + r"\\sqrt(\w+)", r"\\sqrt{$1}"),
        _swap((" ", "")),
        fix_fractions,
        _sub(f"^{SLASH_SIDE}/{SLASH_SIDE}$", r"\\frac{$1}{$2}"),
    )


# ---------------------------------------------------------------- extraction


def braced(text: Column) -> Column:
    """Content of the brace group a text starts with; to the end where it never closes."""

    def close(chars: Column) -> Column:
        # depth after each character; the first zero ends the group
        start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(0).alias("end"))

        def step(acc: Column, ch: Column) -> Column:
            d = acc["d"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
            done = (acc["end"] == 0) & (d == 0)
            return F.struct(d.alias("d"), (acc["i"] + 1).alias("i"), F.when(done, acc["i"] + 1).otherwise(acc["end"]).alias("end"))

        return F.aggregate(chars, start, step, lambda acc: F.when(acc["end"] > 0, acc["end"] - 2).otherwise(acc["i"] - 1))

    return let(text, lambda t: F.substr(t, F.lit(2), close(F.filter(F.split(t, ""), lambda c: c != ""))))


def extract_boxed(text: Column) -> Column:
    """What stands in the last ``boxed``: its brace group, or the text up to a dollar sign."""
    tail = F.substring_index(text, "boxed", -1)
    return let(
        tail,
        lambda t: F.when(t == "", "").when(F.startswith(t, F.lit("{")), braced(t)).otherwise(strip(before_first(t, "$"))),
    )


def last_boxed_expression(text: Column) -> Column:
    r"""The last ``\boxed{..}`` or, without one, ``\fbox{..}`` content; NULL if absent or never closed."""

    def inner(mark: str) -> Column:
        tail = F.concat(F.lit("{"), F.substring_index(text, mark + "{", -1))
        balanced = F.size(F.split(tail, r"\{")) <= F.size(F.split(tail, r"\}"))
        return F.when(F.contains(text, F.lit(mark + "{")) & balanced, braced(tail))

    spaced = F.when(F.contains(text, F.lit("\\boxed ")), before_first(F.substring_index(text, "\\boxed ", -1), "$"))
    return F.coalesce(spaced, inner("\\boxed"), F.when(~F.contains(text, F.lit("\\boxed")), inner("\\fbox")))


def boxed_entries(text: Column) -> Column:
    """All top-level boxed entries in order; equal entries count once."""
    pieces = F.split(text, r"\\boxed\{")
    tails = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    found = F.transform(tails, lambda t: braced(F.concat(F.lit("{"), t)))
    return let(found, lambda f: F.when(F.size(F.array_distinct(f)) == 1, F.slice(f, 1, 1)).otherwise(f))


def last_number(text: Column) -> Column:
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"(-?\d*\.?\d+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


CHOICE_TRIGGERS = r"choice is|answer is|correct \w+ is"


def choice_clean(text: Column, letters: str = "ABCDE") -> Column:
    """Option letter: the first one behind a trigger phrase, else the last one."""
    pieces = F.split(F.regexp_replace(text, r"^\n+|\n+\z", ""), UNICODE + CHOICE_TRIGGERS)

    def pick(p: Column) -> Column:
        tail = F.element_at(p, -1)
        found = F.regexp_extract_all(tail, F.lit(UNICODE + rf"\b([{letters}])\b"), F.lit(1))
        plain = F.regexp_replace(strip(tail), r"^\.+|\.+\z", "")
        first, last = F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(-1))
        return F.coalesce(F.when(F.size(p) > 1, first).otherwise(last), plain)

    return F.regexp_replace(F.regexp_replace(let(pieces, pick), r"\.+\z", ""), r"/+\z", "")


def choice_clean_last(text: Column) -> Column:
    """The last option letter in upper-cased text, else the trimmed text."""
    found = F.regexp_extract_all(F.upper(text), F.lit(UNICODE + r"\b([A-E])\b"), F.lit(1))
    plain = F.regexp_replace(strip(text), r"^[.:]+|[./]+\z", "")
    return F.coalesce(F.try_element_at(found, F.lit(-1)), plain)


def extract_multi_choice(text: Column) -> Column:
    head = F.replace(before_first(text, "Problem:"), F.lit("choice is"), F.lit("answer is"))
    letter = F.upper(F.regexp_extract(F.lower(head), r"answer is \(?([abcde])\)?", 1))
    return F.coalesce(F.nullif(letter, F.lit("")), F.lit("placeholder"))


# Datasets with option letters, and those whose units stay.
CHOICE_DATASETS = ["mmlu_stem", "sat_math", "aqua", "gaokao2023", "gpqa_main", "gpqa_diamond"]
KEEP_UNITS = ["carp_en", "minerva_math"]
PLAIN_TRUTH = ["carp_en", "minerva_math", "gpqa_diamond", "gpqa_main"]


def extract_answer(text: Column, dataset: str = "math", use_last_number: bool = True) -> Column:
    """Answer of a solution text by the first rule that applies, then its normal form."""
    text = F.replace(text, F.lit("\u043a\u0438"), F.lit(""))
    if dataset in CHOICE_DATASETS:
        return choice_clean(text, "ABCDEFGHIJ" if "mmlu" in dataset else "ABCDE")
    has = lambda s: F.contains(text, F.lit(s))
    chinese = F.get(F.split(text, "答案是"), F.lit(1))
    raw = (
        F.when(has("final answer is $") & has("$. I hope"), strip(before_first(after_first(text, "final answer is $"), "$. I hope")))
        .when(has("boxed"), extract_boxed(text))
        .when(has("he answer is"), strip(F.substring_index(text, "he answer is", -1)))
        .when(has("final answer is"), strip(F.substring_index(text, "final answer is", -1)))
        .when(has("答案是"), strip(before_first(strip(chinese), "\n\n")))
        .otherwise(last_number(text) if use_last_number else F.lit(""))
    )
    tidy = steps(raw, _sub(r"\n\s*", ""), _sub("^:", ""), _sub(r"\.\z", ""), _sub(r"/\z", ""))
    return strip_string(tidy, skip_unit=dataset in KEEP_UNITS)


def theorem_units(text: Column) -> Column:
    """π as a number, percent as a quotient, currency and degree marks away."""
    return steps(
        text,
        _swap(("\\pi", "π")),
        _sub(r"(?<![\d}])\\?π", "3.14"),
        _sub(r"(\d)(\\?π)", "$1*3.14"),
        _sub(r"\{(\\?π)\}", "3.14"),
        _sub(r"\*(\\?π)", "*3.14"),
        _swap(("%", "/100"), ("$", ""), ("¥", ""), ("°C", ""), (" C", ""), ("°", "")),
    )


def theorem_answer(text: Column) -> Column:
    """Yes/no, option or number of a theorem question; expressions are not evaluated."""
    low = F.lower(text)
    word = lambda *ws: any_of([F.contains(low, F.lit(w)) for w in ws])
    boxed = F.when(F.contains(text, F.lit("boxed")), extract_boxed(text)).otherwise(text)
    value = theorem_units(strip(F.substring_index(boxed, "=", -1)))
    number = let(value, lambda v: F.when(v.rlike(r"^-?[\d\.]+\s\D+$") | v.rlike(r"^-?[\d\.]+\s[^\s]+$"), before_first(v, " ")).otherwise(v))
    return (
        F.when(word("yes", "true"), "True")
        .when(word("no", "false"), "False")
        .when(word("(a)", "(b)", "(c)", "(d)", "(e)", "(f)"), text)
        .otherwise(number)
    )


# ---------------------------------------------------------------- comparison


def parse_number(text: Column) -> Column:
    """Number without thousands commas; a percentage becomes a share."""
    bare = F.replace(text, F.lit(","), F.lit(""))
    share = to_number(F.regexp_replace(bare, r"\\?%\z", "")) / 100
    return F.coalesce(to_number(bare), F.when(F.endswith(bare, F.lit("%")), share))


def close(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def numeric_equal(pred: Column, ref: Column) -> Column:
    """Equal within 1e-4 to the reference, a hundredth or the hundredfold of it; NULL if not both numbers."""
    p, r = parse_number(pred), parse_number(ref)
    return let(
        F.struct(p.alias("p"), r.alias("r")),
        lambda n: F.when(
            n["p"].isNotNull() & n["r"].isNotNull(),
            close(n["p"], n["r"]) | close(n["p"], n["r"] / 100) | close(n["p"], n["r"] * 100),
        ),
    )


def plain_equal(pred: Column, ref: Column) -> Column:
    """Equality without structure: case, option letter, number, brackets ignored."""
    same = F.lower(strip(pred)) == F.lower(strip(ref))
    choice = ref.isin("A", "B", "C", "D", "E") & (choice_clean_last(pred) == ref)
    p, r = strip(pred), strip(ref)
    ends = lambda s, a, b: F.startswith(s, F.lit(a)) & F.endswith(s, F.lit(b))
    unwrap = (ends(p, "[", "]") & ~F.startswith(r, F.lit("("))) | (ends(p, "(", ")") & ~F.startswith(r, F.lit("[")))
    outer = lambda s: F.regexp_replace(s, r"^[\[\]()]+|[\[\]()]+\z", "")
    bare = lambda s: F.lower(F.translate(F.when(unwrap, outer(s)).otherwise(s), "{}()", ""))
    return F.when(same | choice, True).otherwise(F.coalesce(numeric_equal(pred, ref), (pred != "") & (bare(p) == bare(r))))


# Structure of an answer in one character each: brackets open and close, matrices too; commas, rows and unions divide.
BRACKETS_OPEN, BRACKETS_CLOSE = "(\x01", ")\x02"
MARKS = r"()\x01\x02,;∪"


def structure_marks(text: Column) -> Column:
    """The text with matrices, their rows and cells, unions and square brackets written as single marks."""
    body = r"(?s)\\begin\{[pb]matrix\}(.*?)\\end\{[pb]matrix\}"
    # Inside a matrix rows end with a double backslash and cells with an ampersand; elsewhere neither stands in an answer.
    rows = lambda t: F.regexp_replace(F.replace(F.regexp_replace(t, r"\s*\\\\\s*", ";"), F.lit("&"), F.lit(",")), r"[;\s]*\x02", "\x02")
    matrices = lambda t: rows(F.regexp_replace(t, body, "\x01$1\x02"))
    plain = F.translate(F.regexp_replace(text, r"\\cup(?![a-z])", "∪"), "[]", "()")
    return F.when(plain.rlike(body), matrices(plain)).otherwise(plain)


def top_level_parts(text: Column, mark: str) -> Column:
    """The parts between the ``mark``s outside all brackets; NULL where brackets do not match.

    A fold over the pieces keeps the depth: while it is not zero, the next piece belongs to the same part.
    """
    opens = lambda t: F.length(t) - F.length(F.translate(t, BRACKETS_OPEN, ""))
    closes = lambda t: F.length(t) - F.length(F.translate(t, BRACKETS_CLOSE, ""))
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("depth"))

    def step(acc: Column, piece: Column) -> Column:
        part = F.when(acc["open"].isNull(), piece).otherwise(F.concat(acc["open"], F.lit(mark), piece))
        depth = F.when(acc["depth"] < 0, acc["depth"]).otherwise(acc["depth"] + opens(piece) - closes(piece))
        return F.struct(
            F.when(depth == 0, F.array_append(acc["done"], part)).otherwise(acc["done"]).alias("done"),
            F.when(depth == 0, F.lit(None)).otherwise(part).alias("open"), depth.alias("depth"),
        )

    pieces = F.split(text, mark if mark != "|" else "[|]")
    return F.aggregate(pieces, none, step, lambda acc: F.when(acc["depth"] == 0, acc["done"]))


def same_tree(a: Column, b: Column) -> Column:
    """Equal nesting, and equal answers at every leaf: the marks alone are compared first, then what lies between them."""
    shape = lambda t: F.regexp_replace(t, f"[^{MARKS}]+", "")
    leaves = lambda t: F.split(t, f"[{MARKS}]")
    return F.when(shape(a) == shape(b), F.forall(F.zip_with(leaves(a), leaves(b), lambda x, y: plain_equal(x, y)), lambda e: e)).otherwise(False)


def nested_equal(pred: Column, ref: Column) -> Column:
    """Equality of structured answers of any depth: tuples of tuples, matrices in tuples, intervals; unions in any order."""

    def compare(s: Column) -> Column:
        sides = F.struct(top_level_parts(s["p"], "∪").alias("p"), top_level_parts(s["r"], "∪").alias("r"))
        covered = lambda a, b: F.forall(a, lambda x: F.exists(b, lambda y: same_tree(x, y)))
        sets = lambda u: F.when(F.size(u["p"]) == F.size(u["r"]), F.when(F.size(u["p"]) == 1, same_tree(s["p"], s["r"])).otherwise(covered(u["p"], u["r"]) & covered(u["r"], u["p"])))
        structured = s["p"].rlike(f"[{MARKS}]") & s["r"].rlike(f"[{MARKS}]")
        return F.when(structured, F.coalesce(let(sides, sets), F.lit(False))).otherwise(False)

    return let(F.struct(structure_marks(strip(pred)).alias("p"), structure_marks(strip(ref)).alias("r")), compare)


def math_equal(pred: Column, ref: Column) -> Column:
    """Text equality of two answers: tuples, intervals, matrices and their nesting to any depth, and ``x =``.

    Symbolic equality is not tested.
    """

    def all_equal(a: Column, b: Column) -> Column:
        return F.when(F.size(a) == F.size(b), F.forall(F.zip_with(a, b, lambda x, y: plain_equal(x, y)), lambda e: e)).otherwise(False)

    def decide(s: Column) -> Column:
        p, r = strip(s["p"]), strip(s["r"])
        numeric = parse_number(s["p"]).isNotNull() & parse_number(s["r"]).isNotNull()
        bracketed = lambda x: x.rlike(r"^[(\[].+[)\]]")
        inside = lambda x: F.split(F.substr(x, F.lit(2), F.greatest(F.length(x) - 2, F.lit(0))), ",")
        tuples = bracketed(p) & bracketed(r) & all_equal(inside(p), inside(r))
        matrix_form = r"(?s)^\\begin\{[pb]matrix\}(.*)\\end\{[pb]matrix\}$"
        matrix = lambda x: F.filter(
            F.transform(F.split(F.regexp_extract(x, matrix_form, 1), r"\\\\"), lambda l: strip(l)), lambda l: l != ""
        )
        cells = lambda x: F.flatten(F.transform(matrix(x), lambda l: F.split(l, "&")))
        widths = lambda x: F.transform(matrix(x), lambda l: F.size(F.split(l, "&")))
        matrices = p.rlike(matrix_form) & r.rlike(matrix_form) & (widths(p) == widths(r)) & all_equal(cells(p), cells(r))
        one_eq = lambda x: (F.size(F.split(x, "=")) == 2) & (F.length(strip(F.split(x, "=")[0])) <= 2)
        none = lambda x: ~F.contains(x, F.lit("="))
        right = lambda x: F.coalesce(F.get(F.split(x, "="), F.lit(1)), F.lit(""))
        named = F.when(one_eq(p) & none(r), F.struct(right(p).alias("p"), r.alias("r"))).when(one_eq(r) & none(p), F.struct(p.alias("p"), right(r).alias("r")))
        by_name = F.coalesce(let(named, lambda n: plain_equal(n["p"], n["r"]) | nested_equal(n["p"], n["r"])), F.lit(False))
        flat = plain_equal(s["p"], s["r"])
        return F.when(flat, True).when(numeric | (p == ""), False).otherwise(tuples | matrices | by_name | nested_equal(p, r))

    both = F.struct(pred.alias("p"), ref.alias("r"))
    return F.when(pred.isNull() | ref.isNull(), False).otherwise(let(both, decide))


def is_multi_choice(text: Column) -> Column:
    return text.rlike("^[ABCDE]+$")


def settle_choice(pred: Column, response: Column, gold: Column) -> Column:
    """Predictions of option questions: letter from the response, or letters only."""
    one = gold.isin("A", "B", "C", "D", "E") & ~pred.isin("A", "B", "C", "D", "E")
    several = is_multi_choice(gold) & ~is_multi_choice(pred)
    return F.when(one, choice_clean(response)).when(several, F.regexp_replace(pred, "[^ABCDE]", "")).otherwise(pred)


def numbers_within(pred: Column, ref: Column, tolerance: float = 1e-3) -> Column:
    """Plain numeric comparison within an absolute tolerance."""
    bare = lambda s: F.translate(s, ",$", "")
    p = F.when(F.endswith(bare(pred), F.lit("%")), to_number(F.regexp_replace(bare(pred), "%+$", "")) / 100).otherwise(to_number(bare(pred)))
    return F.coalesce(F.abs(p - to_number(bare(ref))) < tolerance, F.lit(False))


# ---------------------------------------------------------------- datasets


def table_ratio(answer: Column) -> Column:
    """Ratio, thousands and percent answers of table questions as a number in text."""
    ratio = to_number(before_first(answer, "/")) / F.nullif(to_number(F.substring_index(answer, "/", -1)), F.lit(0.0))
    return (
        F.when(F.contains(answer, F.lit("/")), ratio)
        .when(F.contains(answer, F.lit(",")), to_number(F.replace(answer, F.lit(","), F.lit(""))))
        .when(F.contains(answer, F.lit("%")), to_number(before_first(answer, "%")) / 100)
        .otherwise(to_number(answer))
    ).cast("string")


TRUTH = {
    "math": lambda: (F.col("solution"), extract_answer(F.col("solution"), "math")),
    "minerva_math": lambda: (F.col("solution"), extract_answer(F.col("solution"), "minerva_math")),
    "gsm8k": lambda: (F.split_part("answer", F.lit("####"), F.lit(1)), F.split_part("answer", F.lit("####"), F.lit(2))),
    "svamp": lambda: (F.col("equation"), F.col("answer")),
    "asdiv": lambda: (F.col("formula"), F.regexp_replace("answer", r"\(.*?\)", "")),
    "mawps": lambda: (F.lit(None).cast("string"), F.col("target")),
    "tabmwp": lambda: (
        F.col("solution"),
        F.when(F.col("ans_type").isin("integer_number", "decimal_number"), table_ratio(F.col("answer"))).otherwise(F.col("answer")),
    ),
    "carp_en": lambda: (F.col("steps"), F.col("answer")),
    "mmlu_stem": lambda: (F.lit(None).cast("string"), F.substr(F.lit("ABCD"), F.col("answer").cast("int") + 1, F.lit(1))),
    "aqua": lambda: (F.lit(None).cast("string"), F.col("correct")),
    "gaokao2023en": lambda: (F.lit(None).cast("string"), strip(F.replace("answer", F.lit("$"), F.lit("")))),
    "gaokao_math_qa": lambda: (F.lit(None).cast("string"), F.col("label")),
    "cn_middle_school": lambda: (
        F.lit(None).cast("string"), F.when(F.coalesce("choice_answer", F.lit("")) != "", F.col("choice_answer")).otherwise(F.col("answer")),
    ),
    "olympiadbench": lambda: (F.lit(None).cast("string"), F.regexp_replace(F.col("final_answer")[0], r"^\$+|\$+\z", "")),
}
ALIASES = {
    "math500": "math", "mmlu": "mmlu_stem", "college_math": "gaokao2023en", "gaokao_math_cloze": "gaokao2023en", "gaokao2024_mix": "cn_middle_school",
}


def parse_ground_truth(df: DataFrame, dataset: str) -> DataFrame:
    """Add ``gt_cot`` and ``gt`` by the column rules of a dataset (answer column by default)."""
    rule = TRUTH.get(ALIASES.get(dataset, dataset), lambda: (F.lit(None).cast("string"), F.col("answer")))
    cot, gt = rule()
    if dataset in PLAIN_TRUTH:
        gt = _swap(("\\neq", "\\ne"), ("\\leq", "\\le"), ("\\geq", "\\ge"))(gt)
    else:
        gt = strip_string(gt)
    return df.withColumn("gt_cot", strip(F.coalesce(cot, F.lit("None")))).withColumn("gt", gt)


def _labelled(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.lit("("), F.chr(i + 65), F.lit(") "), strip(o))), " ")


def _table_question() -> Column:
    title = F.when(F.coalesce("table_title", F.lit("")) != "", F.concat(F.lit('regarding "'), "table_title", F.lit('" '))).otherwise("")
    options = F.when(F.coalesce("choices", F.lit("")) != "", F.concat(F.lit(" Please select from the following options: "), "choices")).otherwise("")
    return F.concat(F.lit("Read the following table "), title, F.lit("and answer a question:\n"), "table", F.lit("\n"), "question", options)


def _with_period(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit(".")), text).otherwise(F.concat(text, F.lit(".")))


QUESTIONS = {
    "asdiv": lambda: F.concat(strip(F.col("body")), F.lit(" "), strip(F.col("question"))),
    "svamp": lambda: F.concat(_with_period(strip(F.col("body"))), F.lit(" "), strip(F.col("question"))),
    "tabmwp": _table_question,
    "carp_en": lambda: F.col("content"),
    "mmlu_stem": lambda: F.concat(strip(F.col("question")), F.lit("\nAnswer Choices: "), _labelled(F.col("choices"))),
    "sat_math": lambda: F.concat(
        strip(F.col("question")), F.lit("\nAnswer Choices: ("), F.regexp_replace(strip(F.col("options")), r" ([BCD])\) ", " ($1) ")
    ),
    "aqua": lambda: F.concat(
        strip(F.col("question")), F.lit("\nAnswer Choices: "),
        strip(_swap(("(", " ("), (")", ") "))(F.concat(F.lit("("), F.array_join("options", "(")))),
    ),
    "gaokao_math_qa": lambda: F.concat(
        strip(F.col("question")), F.lit("\n选项: "),
        F.array_join(F.transform(F.map_entries("options"), lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), e["value"])), " "),
    ),
}


def parse_question(df: DataFrame, dataset: str) -> DataFrame:
    """Add ``question_text``; true/false and yes/no questions say so at the end. Needs ``gt``."""
    if dataset in QUESTIONS:
        q = QUESTIONS[dataset]()
    else:
        names = [c for c in ("question", "problem", "input") if c in df.columns]
        q = F.col(names[0])
    low = F.lower("gt")
    hint = F.when(low.isin("true", "false"), " (True or False)").when(low.isin("yes", "no"), " (Yes or No)").otherwise("")
    return df.withColumn("question_text", strip(F.concat(q, hint)))
