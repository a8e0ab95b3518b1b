"""Checks whether a response follows formatting instructions."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.code import json_valid
from tallyframe.functions.columns import SPACE_CLASS, all_of, any_of, let, literal_array, strip, words

Args = Callable[[str], Column]
UNICODE = "(?U)"

# The answers of the constrained-response instruction.
CONSTRAINED_RESPONSES = ["My answer is yes.", "My answer is no.", "My answer is maybe."]

# Frequent function words per language; the language with most hits wins.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "was", "as", "on", "are", "by", "this"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "dans", "est", "pour", "pas", "en", "du"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "für", "auf", "von", "zu", "den", "sich", "sch"],
    "es": ["el", "la", "los", "las", "de", "y", "que", "en", "un", "una", "por", "con", "para", "es", "se", "no"],
    "it": ["il", "la", "di", "che", "e", "un", "una", "per", "con", "non", "sono", "del", "si", "lo", "gli", "nel"],
    "pt": ["o", "a", "os", "as", "de", "e", "que", "um", "uma", "não", "para", "com", "em", "do", "da", "por"],
}


def count_matches(text: Column, pattern: Column | str) -> Column:
    return F.regexp_count(text, F.lit(pattern) if isinstance(pattern, str) else pattern)


def compare(n: Column, relation: Column, threshold: Column) -> Column:
    return F.when(relation == "less than", n < threshold).otherwise(n >= threshold)


def detect_language(text: Column) -> Column:
    """Language by stop-word votes; NULL where no word is known (approximate)."""

    def vote(w: Column) -> Column:
        votes = F.array(*[
            F.struct(F.size(F.filter(w, lambda x: x.isin(known))).alias("n"), F.lit(-i).alias("i"), F.lit(code).alias("code"))
            for i, (code, known) in enumerate(STOP_WORDS.items())
        ])
        best = F.array_max(votes)
        return F.when(best["n"] > 0, best["code"])

    return let(words(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), vote)


def count_words(text: Column) -> Column:
    return count_matches(text, UNICODE + r"\w+")


def count_sentences(text: Column) -> Column:
    """Runs of text that is not blank between sentence marks; one pass, whatever the length of a run."""
    return F.size(F.filter(F.split(text, "[.!?。！？]+"), lambda part: strip(part) != ""))


def ints(arg: Column) -> Column:
    return arg.try_cast("int")


def _list(arg: Column) -> Column:
    return F.split(arg, r"\|")


def _paragraphs(r: Column, arg: Args) -> Column:
    def check(parts: Column) -> Column:
        blank = F.transform(parts, lambda p: strip(p) == "")
        n = F.size(parts)
        ends = F.get(blank, F.lit(0)).cast("int") + F.when(n > 1, F.get(blank, n - 1).cast("int")).otherwise(0)
        inner = F.exists(F.slice(blank, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda b: b)
        return ~inner & (n - ends == ints(arg("num_paragraphs")))

    return let(F.split(r, r"\s?\*\*\*\s?"), check)


def _nth_paragraph(r: Column, arg: Args) -> Column:
    def check(parts: Column) -> Column:
        n = F.size(F.filter(parts, lambda p: strip(p) != ""))
        nth = ints(arg("nth_paragraph"))
        para = strip(F.get(parts, nth - 1))
        word = F.regexp_replace(F.regexp_replace(F.get(words(para), F.lit(0)), "^'+", ""), '^"+', "")
        first = F.lower(F.regexp_extract(word, r"^([^.,?!'\"]*)", 1))
        ok = (nth <= n) & (para != "") & (n == ints(arg("num_paragraphs"))) & (first == arg("first_word"))
        return F.coalesce(ok, F.lit(False))

    return let(F.split(r, "\n\n"), check)


def _highlights(r: Column, arg: Args) -> Column:
    found = lambda p: F.regexp_extract_all(r, F.lit(p), F.lit(0))
    single = F.filter(found(r"\*[^\n\*]*\*"), lambda h: strip(F.translate(h, "*", "")) != "")
    double = F.filter(found(r"\*\*[^\n\*]*\*\*"), lambda h: strip(F.regexp_replace(h, r"^\*\*|\*\*$", "")) != "")
    return F.size(single) + F.size(double) >= ints(arg("num_highlights"))


def _postscript(r: Column, arg: Args) -> Column:
    mark = arg("postscript_marker")
    pattern = F.when(mark == "P.P.S", r"(?m)\s*p\.\s?p\.\s?s.*$").when(mark == "P.S.", r"(?m)\s*p\.\s?s\..*$").otherwise(
        F.concat(F.lit(r"(?m)\s*"), F.lower(strip(mark)), F.lit(".*$"))
    )
    return F.regexp_like(F.lower(r), pattern)


def _two_responses(r: Column, arg: Args) -> Column:
    def check(parts: Column) -> Column:
        n = F.size(parts)
        inner = F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0)))
        valid = F.transform(F.filter(parts, lambda p: strip(p) != ""), lambda p: strip(p))
        return ~F.exists(inner, lambda p: strip(p) == "") & (F.size(valid) == 2) & (F.get(valid, F.lit(0)) != F.get(valid, F.lit(1)))

    return let(F.split(r, r"\*{6}"), check)


def _letters(r: Column, arg: Args) -> Column:
    low = F.lower(r)
    n = F.length(low) - F.length(F.replace(low, F.lower(strip(arg("letter"))), F.lit("")))
    return compare(n, arg("let_relation"), ints(arg("let_frequency")))


def _english(r: Column) -> Column:
    return F.coalesce(detect_language(r), F.lit("en")) == "en"


def _all_case(r: Column, up: bool, english: Callable[[Column], Column] = _english) -> Column:
    cased = r.rlike(r"[\p{Lu}\p{Ll}]")
    same = (F.upper(r) if up else F.lower(r)) == r
    return cased & same & english(r)


def _capital_words(r: Column, arg: Args) -> Column:
    tokens = words(F.regexp_replace(r, r"[^\p{L}\p{N}\-']+", " "))
    caps = F.filter(tokens, lambda w: w.rlike(r"\p{Lu}") & (F.upper(w) == w))
    return compare(F.size(caps), arg("capital_relation"), ints(arg("capital_frequency")))


# Each check gets the response and a lookup of the instruction arguments (text; lists joined by |).
CHECKS: dict[str, Callable[[Column, Args], Column]] = {
    "keywords:existence": lambda r, a: F.forall(_list(a("keywords")), lambda k: F.regexp_like(r, F.concat(F.lit("(?i)"), k))),
    "keywords:frequency": lambda r, a: compare(
        count_matches(r, F.concat(F.lit("(?i)"), strip(a("keyword")))), a("relation"), ints(a("frequency"))
    ),
    "keywords:forbidden_words": lambda r, a: ~F.exists(
        _list(a("forbidden_words")), lambda k: F.regexp_like(r, F.concat(F.lit(r"(?iU)\b"), k, F.lit(r"\b")))
    ),
    "keywords:letter_frequency": _letters,
    "language:response_language": lambda r, a: F.coalesce(detect_language(r) == a("language"), F.lit(True)),
    "length_constraints:number_sentences": lambda r, a: compare(count_sentences(r), a("relation"), ints(a("num_sentences"))),
    "length_constraints:number_paragraphs": _paragraphs,
    "length_constraints:number_words": lambda r, a: compare(count_words(r), a("relation"), ints(a("num_words"))),
    "length_constraints:nth_paragraph_first_word": _nth_paragraph,
    "detectable_content:number_placeholders": lambda r, a: count_matches(r, r"\[.*?\]") >= ints(a("num_placeholders")),
    "detectable_content:postscript": _postscript,
    "detectable_format:number_bullet_lists": lambda r, a: count_matches(r, r"(?m)^\s*\*[^\*].*$") + count_matches(r, r"(?m)^\s*-.*$") == ints(a("num_bullets")),
    "detectable_format:constrained_response": lambda r, a: any_of([F.contains(r, F.lit(c)) for c in CONSTRAINED_RESPONSES]),
    "detectable_format:number_highlighted_sections": _highlights,
    "detectable_format:multiple_sections": lambda r, a: count_matches(
        r, F.concat(F.lit(r"\s?"), strip(a("section_spliter")), F.lit(r"\s?\d+\s?"))
    ) >= ints(a("num_sections")),
    "detectable_format:json_format": lambda r, a: json_valid(r),
    "detectable_format:title": lambda r, a: F.exists(
        F.regexp_extract_all(r, F.lit(r"<<[^\n]+>>"), F.lit(0)), lambda t: strip(F.regexp_replace(t, "^<+|>+$", "")) != ""
    ),
    "combination:two_responses": _two_responses,
    "combination:repeat_prompt": lambda r, a: F.startswith(F.lower(strip(r)), F.lower(strip(a("prompt_to_repeat")))),
    "startend:end_checker": lambda r, a: F.endswith(
        F.lower(F.regexp_replace(strip(r), '^"+|"+$', "")), F.lower(strip(a("end_phrase")))
    ),
    "change_case:capital_word_frequency": _capital_words,
    "change_case:english_capital": lambda r, a: _all_case(r, True),
    "change_case:english_lowercase": lambda r, a: _all_case(r, False),
    "punctuation:no_comma": lambda r, a: ~F.contains(r, F.lit(",")),
    "startend:quotation": lambda r, a: let(strip(r), lambda s: (F.length(s) > 1) & F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"'))),
}


def checks_with(detect: Callable[[Column], Column]) -> dict[str, Callable[[Column, Args], Column]]:
    """The checks with another language detector, such as a trained profile's; an unknown language passes as before."""
    english = lambda r: F.coalesce(detect(r), F.lit("en")) == "en"
    return CHECKS | {
        "language:response_language": lambda r, a: F.coalesce(detect(r) == a("language"), F.lit(True)),
        "change_case:english_capital": lambda r, a: _all_case(r, True, english),
        "change_case:english_lowercase": lambda r, a: _all_case(r, False, english),
    }


def follows(
    instruction: Column, kwargs: Column, response: Column, known: list[str] | None = None, detect: Callable[[Column], Column] = detect_language
) -> Column:
    """True if the response follows one instruction; blank responses and unknown instructions fail."""
    arg = lambda name: F.try_element_at(kwargs, F.lit(name))
    checks, out = checks_with(detect), F.lit(False)
    for name in known or checks:
        out = F.when(instruction == name, F.coalesce(checks[name](response, arg), F.lit(False))).otherwise(out)
    return not_blank(response) & out


def not_blank(text: Column) -> Column:
    """Something other than space: the first such character decides, the text is not stripped."""
    return text.rlike(SPACE_CLASS.replace("[", "[^", 1))


def loose_variants(response: Column) -> Column:
    """The response without first and/or last line, each also without asterisks."""

    def variants(lines: Column) -> Column:
        n = F.size(lines)
        cut = lambda start, less: strip(F.array_join(F.slice(lines, F.lit(start), F.greatest(n - less, F.lit(0))), "\n"))
        forms = F.array(response, cut(2, 1), cut(1, 1), cut(2, 2))
        return F.concat(forms, F.transform(forms, lambda f: F.replace(f, F.lit("*"), F.lit(""))))

    return let(F.split(response, "\n"), variants)


def check_instructions(
    df: DataFrame, key: list[str], ids: str, kwargs: str, response: str, known: list[str] | None = None, loose: bool = True,
    detect: Callable[[Column], Column] = detect_language,
) -> DataFrame:
    """Per document: instruction flags in order, strict and (if asked) loose, and the all-true flags.

    ``ids``: array of instruction names; ``kwargs``: array of string maps. Variants and
    checks stay arrays of the row, so nothing is shuffled. ``known`` narrows the tests
    to the instruction names that occur in the data. Without ``loose`` no variant is made. ``detect`` names the language of
    a text: a trained profile's ``detect`` (functions/language.py), or the vote of frequent words.
    """
    pairs = F.arrays_zip(F.col(ids).alias("i"), F.col(kwargs).alias("k"))
    test = lambda r: F.transform(pairs, lambda p: follows(p["i"], p["k"], r, known, detect))
    all_true = lambda name: F.forall(f"inst_level_{name}", lambda f: f).alias(f"prompt_level_{name}")
    if not loose:
        return df.select(*key, test(F.col(response)).alias("inst_level_strict")).select("*", all_true("strict"))
    # the response itself comes first; equal variants are tested once
    table = F.transform(F.array_distinct(loose_variants(F.col(response))), test)
    flags = df.select(*key, table.alias("_t"))
    any_variant = F.transform(F.get("_t", F.lit(0)), lambda _, j: F.exists("_t", lambda row: F.get(row, j)))
    both = flags.select(*key, F.get("_t", F.lit(0)).alias("inst_level_strict"), any_variant.alias("inst_level_loose"))
    return both.select("*", all_true("strict"), all_true("loose"))
