"""Response filters: each maps an array of responses to an array of responses."""

from __future__ import annotations

import re
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.columns import let, strip, strip_left


def java_regex(pattern: str) -> str:
    """Named groups and the end anchor in the spelling Spark knows."""
    return pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")


def regex_match(text: Column, pattern: str, group_select: int = 0) -> Column:
    """The chosen match of a pattern, NULL without one.

    With several groups the first non-empty group of the match counts.
    """
    groups = re.compile(pattern).groups
    at = F.lit(group_select + 1 if group_select >= 0 else group_select)
    pick = lambda g: F.try_element_at(F.regexp_extract_all(text, F.lit(java_regex(pattern)), F.lit(g)), at)
    if groups <= 1:
        return pick(groups)
    return F.coalesce(*[F.nullif(pick(g), F.lit("")) for g in range(1, groups + 1)])


def regex_extract(text: Column, pattern: str = r"#### (\-?[0-9\.\,]+)", group_select: int = 0, fallback: str = "[invalid]"):
    return F.coalesce(strip(regex_match(text, pattern, group_select)), F.lit(fallback))


def multi_choice_extract(
    text: Column, choices: Column, pattern: str, group_select: int = 0, fallback: str = "[invalid]",
    ignore_case: bool = False, ignore_punctuation: bool = False, regexes_to_ignore: list[str] = (),
) -> Column:
    """Pattern first, then a choice text as ``(A)``, then ``: A``, then the fallback."""
    at = F.lit(group_select + 1 if group_select >= 0 else group_select)

    def plain(s: Column) -> Column:
        for r in regexes_to_ignore:
            s = F.regexp_replace(s, java_regex(r), "")
        s = F.lower(s) if ignore_case else s
        return F.regexp_replace(s, r"\p{P}", "") if ignore_punctuation else s

    letter = lambda i: F.concat(F.lit("("), F.chr(i + 65), F.lit(")"))
    wanted = F.transform(choices, lambda c: plain(strip(c)))
    quoted = F.array_join(F.transform(wanted, lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))), "|")

    def by_text(w: Column) -> Column:
        found = strip(F.try_element_at(F.regexp_extract_all(plain(text), quoted, F.lit(0)), at))
        # the last choice with this text names it
        last = F.array_max(F.filter(F.transform(w, lambda c, i: F.when(c == found, i)), lambda i: i.isNotNull()))
        return F.coalesce(letter(last), found)

    letters = F.array_join(F.transform(choices, lambda c, i: F.chr(i + 65)), "|")
    colon = F.regexp_extract_all(text, F.concat(F.lit(r":[\s]*("), letters, F.lit(")")), F.lit(1))
    by_letter = F.concat(F.lit("("), F.try_element_at(colon, at), F.lit(")"))
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(strip(regex_match(text, pattern, group_select))), some(let(wanted, by_text)), some(by_letter), F.lit(fallback))


def majority(resps: Column) -> Column:
    """Most frequent response of an array; the first seen wins a tie."""

    def best(r: Column) -> Column:
        ranked = F.transform(
            F.array_distinct(r),
            lambda v: F.struct(
                F.size(F.filter(r, lambda x: x == v)).alias("n"), (-F.array_position(r, v)).alias("p"), v.alias("v")
            ),
        )
        return F.array_max(ranked)["v"]

    return let(resps, best)


def map_value(text: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), F.lit(default))


ArrayFilter = Callable[..., Column]


def each(fn: Callable[..., Column]) -> Callable[..., ArrayFilter]:
    """Lift a text function to a filter over the response array."""

    def build(**options) -> ArrayFilter:
        return lambda resps, docs=None: F.transform(resps, lambda r: fn(r, **options))

    return build


def take_first_k(k: int) -> ArrayFilter:
    """The first k responses; fewer raise an error when the rows are read."""

    def apply(resps: Column, docs=None) -> Column:
        short = F.raise_error(F.lit(f"need at least {k} responses per document"))
        return F.when(F.size(resps) >= k, F.slice(resps, 1, k)).otherwise(short.cast("array<string>"))

    return apply


FILTERS: dict[str, Callable[..., ArrayFilter]] = {
    "regex": each(lambda r, regex_pattern=r"#### (\-?[0-9\.\,]+)", group_select=0, fallback="[invalid]": regex_extract(r, regex_pattern, group_select, fallback)),
    "multi_choice_regex": lambda choices="choices", regex_pattern=r"#### (\-?[0-9\.\,]+)", **o: (
        lambda resps, docs=None: F.transform(resps, lambda r: multi_choice_extract(r, F.col(choices), regex_pattern, **o))
    ),
    "take_first": lambda: lambda resps, docs=None: F.slice(resps, 1, 1),
    "take_first_k": take_first_k,
    "majority_vote": lambda: lambda resps, docs=None: F.array(majority(resps)),
    "lowercase": each(F.lower),
    "uppercase": each(F.upper),
    "remove_whitespace": each(strip_left),
    "map": each(lambda r, mapping_dict=None, default_value=None: map_value(r, mapping_dict or {"": ""}, default_value)),
    "custom": lambda filter_fn: lambda resps, docs=None: filter_fn(resps),
}


def register_filter(name: str, builder: Callable[..., ArrayFilter]) -> None:
    if name in FILTERS:
        raise ValueError(f"filter {name} exists already")
    FILTERS[name] = builder


def apply_filters(df: DataFrame, resps: str, filters: dict[str, list[tuple[str, dict]]]) -> DataFrame:
    """Fan named filter lists out over the same responses.

    ``filters``: name to an ordered list of (filter, options). One row per name with
    the columns ``filter`` and ``filtered_resps``; the responses are not shuffled.
    """
    rows = []
    for name, steps in filters.items():
        value = reduce(lambda v, s: FILTERS[s[0]](**s[1])(v), steps, F.col(resps))
        rows.append(F.struct(F.lit(name).alias("filter"), value.alias("filtered_resps")))
    return df.select("*", F.inline(F.array(*rows)))
