"""Small column helpers shared by the function modules."""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, functions as F

# ASCII letters, ASCII punctuation, whitespace as text splitting sees it.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE_CLASS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
# Every character of SPACE_CLASS.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PUNCTUATION_CLASS = r"[!-/:-@\[-`{-~]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A lambda variable is bound once, whereas a plain column reference is inlined at
    each use when projections are merged. The finish step of a fold over one element
    binds it without wrapping the result in an array, so nested bindings stay cheap
    to analyse.
    """
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _: acc, body)


def steps(value: Column, *fns: Callable[[Column], Column]) -> Column:
    """Apply text-to-text steps one after the other, as one fold over the step number.

    Every step may use its input many times; the nesting does not grow with the
    number of steps.
    """

    def apply(acc: Column, i: Column) -> Column:
        out = None
        for n, fn in enumerate(fns):
            out = F.when(i == n, fn(acc)) if out is None else out.when(i == n, fn(acc))
        return out

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(fns) - 1)), value, apply) if fns else value


def words(text: Column) -> Column:
    """Whitespace tokens without empty ends."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """Join the whitespace tokens by one space."""
    return F.array_join(words(text), " ")


def strip(text: Column, chars: str = SPACE_CLASS) -> Column:
    """The text without the characters at both ends; for spaces only the ends are looked at, no pattern runs over the text."""
    if chars == SPACE_CLASS:
        return F.btrim(text, F.lit(SPACES))
    return F.regexp_replace(text, f"^{chars}+|{chars}+$", "")


def strip_left(text: Column, chars: str = SPACE_CLASS) -> Column:
    return F.regexp_replace(text, f"^{chars}+", "")


def strip_right(text: Column, chars: str = SPACE_CLASS) -> Column:
    return F.regexp_replace(text, f"{chars}+$", "")


def drop_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def after_last(text: Column, mark: str) -> Column:
    """The part behind the last ``mark``; the whole text where it is absent."""
    return F.substring_index(text, mark, -1)


def before_first(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def after_first(text: Column, mark: str) -> Column:
    """The part behind the first ``mark``; the whole text where it is absent."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substr(text, at + len(mark))).otherwise(text)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def running_sums(values: Column, chunk: int = 64) -> Column:
    """Sums up to and with each entry, made in chunks: an array that grows by one entry is copied, so none grows long."""
    none = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
    add = lambda acc, x: F.array_append(acc, last(acc) + x)
    inside = lambda v: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(chunk)), lambda s: s <= F.size(v)), lambda s: F.aggregate(F.slice(v, s, chunk), none, add)
    )
    before = lambda parts: F.concat(F.array(F.lit(0).cast("long")), F.aggregate(parts, none, lambda acc, p: F.array_append(acc, last(acc) + last(p))))
    joined = lambda parts: F.flatten(F.zip_with(parts, F.slice(before(parts), F.lit(1), F.size(parts)), lambda p, b: F.transform(p, lambda x: x + b)))
    return let(values, lambda v: let(inside(v), joined))


def argmax(values: Column) -> Column:
    """Zero-based position of the largest entry, the first one on a tie."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(text: Column) -> Column:
    """A double, or NULL where the text is no plain number; outer whitespace is allowed."""
    bare = strip(text)
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def occurrences(tokens: Column) -> Column:
    """Numbers that stand for the tokens with their occurrence, so that a multiset becomes a set.

    A token's first occurrence is its 64-bit hash, further ones are hashes of that and their number, so most tokens cost one
    hash and no text. Two different tokens of a pair of texts share a number with a probability of their product / 2^64.
    """

    def further(d: Column, runs: Column) -> Column:
        length = lambda e, i: F.coalesce(F.get(runs, i + 1)["p"], F.size(d)) - e["p"]
        one = lambda e, i: F.transform(F.sequence(F.lit(2), length(e, i) + 1), lambda k: F.xxhash64(e["h"], k))
        return F.flatten(F.transform(runs, one))

    def starts(d: Column) -> Column:
        marked = F.transform(d, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.filter(marked, lambda e: (e["p"] == 0) | (e["h"] != F.get(d, e["p"] - 1)))

    repeats = lambda s: F.filter(s, lambda h, i: (i > 0) & (h == F.get(s, i - 1)))
    more = lambda d: let(starts(d), lambda runs: further(d, runs))
    return let(F.sort_array(F.transform(tokens, lambda w: F.xxhash64(w))), lambda s: F.concat(F.array_distinct(s), let(repeats(s), more)))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays (hash based, not token by token)."""
    return F.size(F.array_intersect(occurrences(a), occurrences(b)))
