"""Text match: exact, token overlap, contained answers, and the parsers of single tasks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyframe.functions.columns import (
    PUNCTUATION_CLASS, any_of, array_sum, drop_punctuation, let, literal_array, multiset_overlap, squeeze, steps, strip, to_number,
    words,
)
from tallyframe.operators.prompts import UNKNOWN_RESPONSES

WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# Articles that normalization removes.
ARTICLES = {
    "en": "a|an|the",
    "es": "un|una|unos|unas|el|la|los|las",
    "fr": "un|une|des|le|la|les",
    "de": "ein|eine|einen|einem|eines|einer|der|die|das|den|dem|des",
    "vi": "của|là|cái|chiếc|những",
}
CHINESE_PUNCTUATION = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏"


def exact_match(
    pred: Column, ref: Column, regexes_to_ignore: list[str] = (), ignore_case: bool = False,
    ignore_punctuation: bool = False, ignore_numbers: bool = False,
) -> Column:
    def plain(s: Column) -> Column:
        for r in regexes_to_ignore:
            s = F.regexp_replace(s, r, "")
        s = F.lower(s) if ignore_case else s
        s = drop_punctuation(s) if ignore_punctuation else s
        return F.translate(s, "0123456789", "") if ignore_numbers else s

    return (plain(pred) == plain(ref)).cast("double")


def exact_match_any(pred: Column, refs: Column, **options) -> Column:
    return F.exists(refs, lambda r: exact_match(pred, r, **options) == 1.0).cast("double")


def normalize_answer(text: Column, lang: str = "en") -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    s = drop_punctuation(F.lower(text))
    if lang == "zh":
        spaced = F.regexp_replace(s, "([\\u4e00-\\u9fa5])", " $1 ")
        return squeeze(spaced)
    if lang == "ar":
        s = F.regexp_replace(s, r"\sال^|ال", " ")
    elif lang in ARTICLES:
        s = F.regexp_replace(s, f"{WORD_START}({ARTICLES[lang]}){WORD_END}", " ")
    return squeeze(s)


def normalize_by_language(text: Column, lang: Column, languages: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for code in languages:
        out = F.when(lang == code, normalize_answer(text, code)).otherwise(out)
    return out


def normalize_characters(text: Column) -> Column:
    """Chinese form: lower case, all punctuation and whitespace removed."""
    s = F.translate(drop_punctuation(F.lower(text)), CHINESE_PUNCTUATION, "")
    return F.array_join(words(s), "")


def f1_from(same: Column, n_pred: Column, n_ref: Column) -> Column:
    """Harmonic mean of precision and recall; 0 without common tokens."""
    return F.when(same > 0, 2.0 * same / (n_pred + n_ref)).otherwise(0.0)


def overlap_f1(pred: Column, ref: Column) -> Column:
    """F1 of two token arrays as multisets."""
    return let(
        F.struct(pred.alias("p"), ref.alias("r")),
        lambda s: f1_from(multiset_overlap(s["p"], s["r"]), F.size(s["p"]), F.size(s["r"])),
    )


def token_f1(pred: Column, ref: Column, lang: str = "en") -> Column:
    return overlap_f1(words(normalize_answer(pred, lang)), words(normalize_answer(ref, lang)))


def character_f1(pred: Column, ref: Column) -> Column:
    chars = lambda t: F.filter(F.split(normalize_characters(t), ""), lambda c: c != "")
    return overlap_f1(chars(pred), chars(ref))


def squad_f1(pred: Column, ref: Column) -> Column:
    """Token F1 where two empty answers agree fully and one empty answer not at all."""
    both = F.struct(words(normalize_answer(pred)).alias("p"), words(normalize_answer(ref)).alias("r"))
    return let(
        both,
        lambda s: F.when((F.size(s["p"]) == 0) | (F.size(s["r"]) == 0), (F.size(s["p"]) == F.size(s["r"])).cast("double"))
        .otherwise(f1_from(multiset_overlap(s["p"], s["r"]), F.size(s["p"]), F.size(s["r"]))),
    )


def squad_exact(pred: Column, ref: Column) -> Column:
    return (normalize_answer(pred) == normalize_answer(ref)).cast("double")


def best_over(refs: Column, score) -> Column:
    return F.array_max(F.transform(refs, score))


def picked_scores(picked: Column, answers: Column) -> Column:
    """Exact match and token F1 of a picked answer, the best over the right answers; without any, 0."""
    best = lambda score: F.coalesce(best_over(answers, lambda a: score(picked, a)), F.lit(0.0))
    return F.struct(best(squad_exact).alias("em"), best(squad_f1).alias("f1"))


def leave_one_out(golds: Column, score) -> Column:
    """Mean over golds of the best score against the other golds; one gold counts itself."""
    scores = F.transform(golds, score)

    def average(s: Column) -> Column:
        rest = F.transform(s, lambda x, i: F.array_max(F.filter(s, lambda y, j: j != i)))
        return F.when(F.size(s) > 1, array_sum(rest) / F.size(s)).otherwise(F.get(s, F.lit(0)))

    return let(scores, average)


def contains_any(pred: Column, labels: Column) -> Column:
    return F.exists(labels, lambda l: F.contains(F.lower(pred), F.lower(l))).cast("int")


def is_included(ref: Column, pred: Column) -> Column:
    return F.contains(pred, ref)


def share_found(pred: Column, refs: Column) -> Column:
    """Share of references that occur in the prediction, ignoring case."""
    hit = F.filter(refs, lambda r: F.contains(F.lower(pred), F.lower(r)))
    return F.size(hit) / F.size(refs)


def printable(pred: Column) -> Column:
    return strip(F.regexp_replace(strip(pred), r"[\x00-\x1f]", "\n"))


def string_match_all(preds: Column, refs: Column) -> Column:
    return array_sum(F.transform(preds, lambda p: share_found(p, refs))) / F.size(preds)


def string_match_part(preds: Column, refs: Column) -> Column:
    """Best share, divided by the number of predictions."""
    return F.array_max(F.transform(preds, lambda p: share_found(p, refs))) / F.size(preds)


def share_of_numbers(pred: Column, wanted: Column) -> Column:
    numbers = F.regexp_extract_all(pred, F.lit(r"(\d+)"), F.lit(1))
    return F.coalesce(F.try_divide(F.size(F.filter(numbers, lambda n: n == wanted)), F.size(numbers)), F.lit(0.0))


def count_score(pred: Column, gold: Column) -> Column:
    return share_of_numbers(pred, gold)


def retrieval_score(pred: Column, gold: Column, lang: str = "en") -> Column:
    pattern = {"en": r"Paragraph (\d+)", "zh": r"段落(\d+)"}[lang]
    return share_of_numbers(pred, F.regexp_extract(gold, pattern, 1))


def classification_score(pred: Column, gold: Column, classes: Column) -> Column:
    """1 / matched classes if the gold class is one of them.

    A matched class that is only a part of the gold class name does not count; all of
    these are left out, also where two of them follow each other in the class list.
    """
    found = F.filter(classes, lambda c: F.contains(pred, c) & ~(F.contains(gold, c) & (c != gold)))
    return F.when(F.array_contains(found, gold), 1.0 / F.size(found)).otherwise(0.0)


# ---------------------------------------------------------------- relaxed numbers


def _unquote(s: Column) -> Column:
    return F.when(s.rlike(r'(?s)^".*"$') | s.rlike(r"(?s)^'.*'$"), F.substr(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))).otherwise(s)


TAIL_MARKS = r"[\s!-$&-/:-@\[-`{-~]+$"


def relaxed_text(s: Column) -> Column:
    bare = F.translate(F.regexp_replace(s, TAIL_MARKS, ""), ",$", "")
    return F.when(s.rlike(r"\p{Nd}"), bare).otherwise(_unquote(s))


def relaxed_match(pred: Column, targets: Column, tolerance: float = 0.05) -> Column:
    """1.0 if the prediction equals a target within a relative tolerance, as letter, or as text."""

    def close(p: Column, t: Column) -> Column:
        return F.abs(p - t) / F.greatest(F.abs(t), F.lit(1e-10)) <= tolerance

    def score(p: Column, raw: Column) -> Column:
        def inner(s: Column) -> Column:
            pn, tn = to_number(F.regexp_replace(s["p"], "%+$", "")), to_number(F.regexp_replace(s["t"], "%+$", ""))
            pp, tp = F.endswith(s["p"], F.lit("%")), F.endswith(s["t"], F.lit("%"))
            numeric = close(pn, tn) | (pp & close(pn / 100, tn)) | (tp & close(pn, tn / 100))
            letter = s["t"].rlike(r"^\p{L}$") & (F.length(s["p"]) > 0)
            same_letter = F.lower(F.substring(s["p"], 1, 1)) == F.lower(s["t"])
            text = F.lower(F.regexp_replace(s["p"], PUNCTUATION_CLASS + "+$", "")) == F.lower(s["t"])
            return F.when(pn.isNotNull() & tn.isNotNull(), numeric).when(letter, same_letter).otherwise(text)

        return let(F.struct(strip(p).alias("p"), strip(relaxed_text(raw)).alias("t")), inner)

    return let(relaxed_text(pred), lambda p: F.exists(targets, lambda t: score(p, t))).cast("double")


def stated_answer(generation: Column) -> Column:
    """First non-empty line behind the last "answer:", without markdown; empty if absent."""
    tidy = F.regexp_replace(generation, r"([aA]nswer)\**:\**", "$1:")

    def cut(g: Column) -> Column:
        last = F.length(F.substring_index(F.lower(g), "answer:", -1))
        tail = F.right(g, last)
        lines = F.filter(F.transform(F.split(tail, "\n"), lambda l: strip(l)), lambda l: l != "")
        return F.when(F.contains(F.lower(g), F.lit("answer:")), F.coalesce(F.get(lines, F.lit(0)), F.lit(""))).otherwise("")

    return F.regexp_replace(let(tidy, cut), r"[*_\[\]\(\)]", "")


def relaxed_accuracy(generation: Column, targets: Column) -> Column:
    return let(stated_answer(generation), lambda a: F.when(a == "", 0.0).otherwise(relaxed_match(a, targets)))


def anywhere_accuracy(generation: Column, targets: Column) -> Column:
    """As above; without a stated answer a target may stand anywhere in typical phrases."""

    def phrase(t: Column) -> Column:
        low = F.lower(t)
        forms = [F.concat(F.lit("is "), low), F.concat(F.lit("was "), low), F.concat(F.lit(" "), low, F.lit(".")),
                 F.concat(F.lit("are "), low), F.concat(F.lit("\n\n"), low)]
        return any_of([F.contains(generation, f) for f in forms])

    def anywhere(t: Column) -> Column:
        n = to_number(t)
        whole = F.when(n == F.floor(n), n.try_cast("long"))
        plain = F.coalesce(whole.cast("string"), n.cast("string"))
        commas = F.coalesce(F.format_number(whole, 0), F.concat(F.format_number(F.floor(n), 0), F.regexp_extract(plain, r"(\.\d+)$", 1)))
        return F.when(n.isNotNull(), F.contains(generation, commas) | F.contains(generation, plain)).otherwise(phrase(t))

    return let(
        stated_answer(generation),
        lambda a: F.when(a != "", relaxed_match(a, targets)).otherwise(F.exists(targets, anywhere).cast("double")),
    )


def final_answer_match(pred: Column, ref: Column) -> Column:
    """Text behind "Final Answer: " at the end of the response, without a final period."""
    found = F.regexp_extract(pred, r"(?i)(?:Final Answer|FINAL ANSWER): ([^\n]+)\n?\z", 1)
    said = F.regexp_replace(F.lower(strip(found)), r"\.\z", "")
    return ((found != "") & (said == F.lower(strip(ref)))).cast("double")


# ---------------------------------------------------------------- hard-reasoning answers

# Phrases in front of a final answer, in the order they are cut.
ANSWER_PREFIXES = [
    "</think>", "The answer is:", "The final answer is: ", "The correct answer is:", "The correct answer is", "is:\n",
    "The answer is ", "**Answer:**", "**Final Answer:**", "**option ", "Answer:", "boxed{",
]


def reasoning_answer(sample: Column) -> Column:
    def cut(prefix: str):
        tail = lambda s: F.when(F.contains(F.lower(s), F.lit(prefix.lower())), strip(F.substring_index(s, prefix, -1))).otherwise(s)
        return lambda s: F.regexp_replace(tail(s), r"\.\z", "")

    def unwrap(mark: str):
        body = lambda s: F.get(F.split(F.regexp_replace(s, r"\}\z", ""), mark.replace("{", r"\{")), F.lit(1))
        return lambda s: F.when(F.contains(s, F.lit(mark)) & F.endswith(s, F.lit("}")), body(s)).otherwise(s)

    dollars = lambda s: F.when(s.rlike(r"(?s)^\$.*\$\z") & (F.length(s) > 1), F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    found = steps(strip(sample), *[cut(p) for p in ANSWER_PREFIXES], dollars, *[unwrap(m) for m in ("boxed{", "text{", "texttt{")])
    return F.replace(F.lower(found), F.lit(", "), F.lit(","))


def reasoning_match(sample: Column, reference: Column) -> Column:
    """Loose equality of a reasoning answer: letters, numbers, quotes, brackets, prefixes."""
    ref = F.replace(F.lower(strip(reference)), F.lit(", "), F.lit(","))

    def decide(s: Column) -> Column:
        p, r = s["p"], s["r"]
        p1, p2, r2 = F.substring(p, 1, 1), F.substring(p, 2, 1), F.substring(r, 2, 1)
        in_parens = lambda x: x.rlike(r"^\(.\)$")
        short = (F.length(p) == 1) | ((F.length(p) == 2) & (p2 == ")"))
        loose = (p1 == r2) & ~p2.rlike(r"[\p{L}\p{N}]")
        numbers = F.coalesce(to_number(p) == to_number(r), F.lit(False))
        no_quote = lambda x: F.replace(x, F.lit("'"), F.lit(""))
        wrap = lambda x: F.concat(F.lit("["), x, F.lit("]"))
        bare = lambda x: F.regexp_replace(x, "[^a-z0-9]", "")
        rest = any_of([
            numbers, no_quote(p) == no_quote(r), wrap(r) == p, wrap(p) == r, p == F.concat(r, F.lit("?")),
            F.startswith(p, r), F.startswith(r, p), bare(p) == bare(r),
        ])
        return (
            F.when(s["raw"] == "", False)
            .when(p == r, True)
            .when(in_parens(p), p2 == r)
            .when(in_parens(r) & short, r2 == p1)
            .when(in_parens(r) & loose, True)
            .otherwise(rest)
        )

    raw = reasoning_answer(sample)
    return let(raw, lambda a: let(F.struct(a.alias("raw"), strip(a).alias("p"), strip(ref).alias("r")), decide))


# ---------------------------------------------------------------- single tasks

# Determiners ignored when referents are compared.
DETERMINERS = ["a", "an", "few", "her", "his", "each", "every", "many", "much", "my", "our", "some", "that", "the", "their", "these", "this", "those", "which", "whose", "your"]


def referent_match(pred: Column, ref: Column) -> Column:
    """True if one cleaned word set is part of the other and both or none hold a quote."""
    clean = lambda s: F.filter(F.split(F.lower(strip(s)), " "), lambda w: ~w.isin(DETERMINERS))

    def decide(x: Column) -> Column:
        p, r = F.array_distinct(x["p"]), F.array_distinct(x["r"])
        quote = lambda a: F.exists(a, lambda w: F.contains(w, F.lit("'")))
        return (quote(p) == quote(r)) & ((F.size(F.array_except(p, r)) == 0) | (F.size(F.array_except(r, p)) == 0))

    return let(F.struct(clean(pred).alias("p"), clean(ref).alias("r")), decide)


def label_or_wrong(pred: Column, labels: list[str], gold: Column) -> Column:
    """Index of a label word; an unknown word becomes the opposite of the binary gold."""
    at = F.array_position(literal_array(labels), pred).cast("int") - 1
    return F.when(at >= 0, at).otherwise(F.when(gold == 0, 1).otherwise(0))


def label_or_default(pred: Column, labels: list[str], default: int = 0) -> Column:
    at = F.array_position(literal_array(labels), pred).cast("int") - 1
    return F.when(at >= 0, at).otherwise(default)


def clean_bias_answer(text: Column) -> Column:
    # words that are a part of "the" are dropped, as in a membership test on the word
    kept = F.filter(F.split(F.lower(text), " "), lambda w: ~w.isin("", "t", "h", "e", "th", "he", "the"))
    return drop_punctuation(strip(F.array_join(kept, " ")))


def parse_bias_answer(response: Column, choices: Column, groups: Column) -> Column:
    """Index of the chosen answer: choice word, else unknown phrase, else group mention, else -1."""
    unknown = literal_array(UNKNOWN_RESPONSES + ["Don't know", "Do not know", "Can't know", "Cannot know"])
    said_unknown = F.exists(unknown, lambda u: F.contains(F.lower(response), F.lower(u)))

    def decide(w: Column) -> Column:
        by_choice = F.transform(
            choices, lambda c: F.array_contains(w, clean_bias_answer(c)) | (F.array_contains(unknown, c) & said_unknown)
        )
        by_group = F.transform(groups, lambda g: F.exists(g, lambda x: F.array_contains(w, clean_bias_answer(x))))
        first = F.array_position(by_choice, True).cast("int") - 1
        last = F.coalesce(F.array_max(F.filter(F.transform(by_group, lambda b, i: F.when(b, i)), lambda i: i.isNotNull())), F.lit(-1))
        return F.when(first >= 0, first).otherwise(last)

    return let(F.split(clean_bias_answer(response), " "), decide)


def emotion_score(response: Column, names: Column, scores: Column) -> Column:
    """Four ``name: number`` pairs against reference emotions on an S-shaped scale.

    struct(score, parseable); a response without exactly the four emotions scores 0.
    """
    pattern = r"([\p{L}\p{N}_]+):\s+(\d+)"
    grab = lambda g: F.regexp_extract_all(response, F.lit(pattern), F.lit(g))

    def value_of(found: Column, name: Column) -> Column:
        hits = F.filter(found, lambda f: f["k"] == name)
        return F.try_element_at(hits, F.lit(-1))["v"].try_cast("double")

    def tally(found: Column) -> Column:
        seen = F.array_distinct(F.transform(found, lambda f: f["k"]))
        ok = (F.size(seen) == 4) & (F.size(F.array_intersect(seen, names)) == 4)
        diffs = F.zip_with(names, scores, lambda n, s: F.abs(value_of(found, n) - s))
        scaled = F.transform(
            diffs, lambda d: F.when(d == 0, 0.0).when(d <= 5, 6.5 / (1 + F.exp(-1.2 * (d - 4)))).otherwise(d)
        )
        total = (10 - array_sum(scaled) * 0.7477) * 10
        return F.struct(F.when(ok, total).otherwise(0.0).alias("eqbench"), F.when(ok, 100).otherwise(0).alias("percent_parseable"))

    return let(F.arrays_zip(grab(1).alias("k"), grab(2).alias("v")), tally)


def drop_normalize(text: Column) -> Column:
    """Reading-comprehension normal form: numbers as decimals, no articles or punctuation."""

    def token(t: Column) -> Column:
        bare = F.when(to_number(t).isNull(), drop_punctuation(t)).otherwise(t)
        n = to_number(bare)
        shown = F.when(n.isNotNull(), n.cast("string")).otherwise(bare)
        return squeeze(F.regexp_replace(shown, f"{WORD_START}(a|an|the){WORD_END}", " "))

    tokens = F.transform(F.split(F.lower(text), " |-"), token)
    return strip(F.array_join(F.filter(tokens, lambda t: t != ""), " "))


def drop_scores(pred: Column, golds: Column) -> Column:
    """struct(em, f1) of a single-span answer, best over the golds; F1 on word sets at two decimals.

    A gold with a number needs a common number, otherwise its F1 is 0.
    """
    numbers = lambda bag: F.filter(bag, lambda w: to_number(w).isNotNull())

    def one(p: Column, gold: Column) -> Column:
        def inner(s: Column) -> Column:
            a, b = F.array_distinct(words(s["p"])), F.array_distinct(words(s["g"]))
            common = F.size(F.array_intersect(a, b))
            prec = F.when(F.size(a) == 0, 1.0).otherwise(F.try_divide(common, F.size(a)))
            rec = F.when(F.size(b) == 0, 1.0).otherwise(F.try_divide(common, F.size(b)))
            f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
            allowed = (F.size(numbers(b)) == 0) | F.arrays_overlap(numbers(a), numbers(b))
            return F.struct((s["p"] == s["g"]).cast("double").alias("em"), F.round(F.when(allowed, f1).otherwise(0.0), 2).alias("f1"))

        return let(F.struct(p.alias("p"), drop_normalize(gold).alias("g")), inner)

    kept = F.filter(golds, lambda g: strip(g) != "")
    scores = let(drop_normalize(pred), lambda p: F.transform(kept, lambda g: one(p, g)))
    return let(
        scores,
        lambda s: F.struct(
            F.coalesce(F.array_max(F.transform(s, lambda x: x["em"])), F.lit(0.0)).alias("em"),
            F.coalesce(F.array_max(F.transform(s, lambda x: x["f1"])), F.lit(0.0)).alias("f1"),
        ),
    )


def clean_puzzle_answer(text: Column) -> Column:
    s = F.regexp_replace(strip(text), r"^\.+|\.+$", "")
    s = F.replace(F.lower(F.regexp_replace(s, " +", " ")), F.lit("+"), F.lit(""))
    return F.translate(s, "‘’“”", "''\"\"")


def puzzle_scores(response: Column, keys: Column, answers: Column) -> Column:
    """Score per key of a JSON-like answer: best exact match over the allowed answers.

    ``answers``: array of answer arrays, one per key. An empty allowed answer scores 1.
    """
    body = F.substr(response, F.locate("{", response))
    closed = F.when(F.endswith(body, F.lit("}")), body).otherwise(F.concat(body, F.lit("}")))
    # single-quoted forms become JSON, as both spellings are accepted
    parsed = F.coalesce(
        F.from_json(F.when(F.contains(response, F.lit("{")), closed), "map<string,string>"),
        F.from_json(F.when(F.contains(response, F.lit("{")), F.replace(closed, F.lit("'"), F.lit('"'))), "map<string,string>"),
    )

    def score(m: Column) -> Column:
        def one(k: Column, allowed: Column) -> Column:
            said = F.coalesce(F.try_element_at(m, k), F.lit(""))
            empty = (F.size(allowed) == 0) | F.array_contains(allowed, "")
            hit = F.exists(allowed, lambda a: clean_puzzle_answer(a) == clean_puzzle_answer(said))
            return F.when(empty, 1.0).when(said == "", 0.0).otherwise(hit.cast("double"))

        return F.zip_with(keys, answers, one)

    return let(parsed, score)


# Words in front of the part of a sentence that holds the answer.
ANSWER_INDICATORS = ["could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result "]
NUMBER_FORMS = [r"-?\b\d{1,3}(?:,\d{3})+\b", r"-?\d+(?:\.\d+)?[eE][+-]?\d+", r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])"]


def normalize_open(text: Column) -> Column:
    """Numbers at two decimals as ``#n``, single letters padded, other texts in lower case."""
    s = strip(text)
    n = to_number(F.replace(s, F.lit(","), F.lit("")))
    low = F.lower(s)
    padded = F.array(F.concat(F.lit(" "), low), F.concat(low, F.lit(" ")))
    return F.when(n.isNotNull(), F.array(F.concat(F.lit("#"), F.round(n, 2).cast("string")))).when(F.length(low) == 1, padded).otherwise(F.array(low))


def parse_open_response(response: Column) -> Column:
    """Candidate answers of an open response, normalized and distinct."""
    whole = F.lower(F.regexp_replace(strip(response), r"^\.+|\.+$", ""))

    def key_parts(lines: Column) -> Column:
        def shortest(line: Column, i: Column) -> Column:
            tails = [F.when(F.contains(line, F.lit(m)), strip(F.substring_index(line, m, -1))) for m in ANSWER_INDICATORS]
            tails.append(F.when((i == F.size(lines) - 1) & F.contains(line, F.lit("=")), strip(F.substring_index(line, "=", -1))))
            kept = F.filter(F.array(*tails), lambda t: t != "")
            return F.array_min(F.transform(kept, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]

        found = F.filter(F.transform(lines, shortest), lambda t: t.isNotNull() & ~t.isin(":", ",", ".", "!", "?", ";", "'"))
        return F.when(F.size(found) > 0, found).otherwise(F.array(whole))

    numbers = lambda t: F.concat(*[F.regexp_extract_all(t, F.lit("(" + p + ")"), F.lit(1)) for p in NUMBER_FORMS])
    return let(
        let(F.split(whole, "\n"), key_parts),
        lambda parts: F.array_distinct(
            F.flatten(F.transform(F.concat(parts, F.flatten(F.transform(parts, numbers))), normalize_open))
        ),
    )


def open_answer_match(parsed: Column, golds: Column) -> Column:
    """A number equals a gold number, or a gold text stands inside a candidate text."""
    wanted = F.flatten(F.transform(golds, normalize_open))
    is_number = lambda x: F.startswith(x, F.lit("#"))
    return let(
        wanted,
        lambda w: F.exists(
            parsed,
            lambda p: F.when(is_number(p), F.array_contains(w, p)).otherwise(
                F.exists(w, lambda g: ~is_number(g) & F.contains(p, g))
            ),
        ),
    )


def parse_choice_response(response: Column, letters: Column, answers: Column) -> Column:
    """Chosen letter: ``(A)``, else `` A ``, else answer text; the last mention wins, NULL if none."""
    s = response
    for ch in [",", r"\.", "!", r"\?", ";", ":", "'"]:
        s = F.regexp_replace(s, f"^{ch}+|{ch}+$", "")
    padded = F.concat(F.lit(" "), s, F.lit(" "))

    def last_mention(text: Column, form) -> Column:
        spots = F.transform(letters, lambda l, i: F.struct(_rfind(text, form(l, i)).alias("at"), (-i).alias("o"), l.alias("l")))
        return F.array_max(F.filter(spots, lambda x: x["at"] >= 0))["l"]

    return let(
        padded,
        lambda t: F.coalesce(
            last_mention(t, lambda l, i: F.concat(F.lit("("), l, F.lit(")"))),
            last_mention(t, lambda l, i: F.concat(F.lit(" "), l, F.lit(" "))),
            F.when(F.size(words(t)) > 5, last_mention(F.lower(t), lambda l, i: F.lower(F.get(answers, i)))),
        ),
    )


def _rfind(text: Column, part: Column) -> Column:
    """Last position of a part (0-based), -1 if absent."""
    behind = F.position(F.reverse(part), F.reverse(text))
    return F.when(behind > 0, F.length(text) - behind - F.length(part) + 1).otherwise(-1)


def lexical_substitution_row(response: Column, synonyms: Column, counts: Column) -> Column:
    """struct(precision, answered, annotated) of up to ten comma-separated substitutes on the first line.

    A hit earns the annotator count of the word; the sum is divided by all counts.
    """
    pieces = F.regexp_extract_all(F.substring_index(response, "\n", 1), F.lit("([^,]+)"), F.lit(1))
    kept = F.filter(pieces, lambda p: p != '""')
    said = F.slice(F.transform(kept, lambda p: F.replace(strip(p), F.lit('"'), F.lit(""))), 1, 10)
    letters = lambda w: F.regexp_replace(w, r"[^\p{L}]", "")

    def score(s: Column) -> Column:
        tidy = F.transform(s, lambda w, i: F.when(i == F.size(s) - 1, letters(w)).otherwise(w))
        count_of = lambda w: F.get(counts, F.array_position(synonyms, w).cast("int") - 1).cast("double")
        gained = array_sum(F.transform(F.filter(tidy, lambda w: F.array_contains(synonyms, w)), count_of))
        total = array_sum(F.transform(counts, lambda c: c.cast("double")))
        return F.struct(
            F.when(total > 0, gained / total).otherwise(gained).alias("precision"),
            (F.size(s) > 0).cast("int").alias("answered"),
            (F.size(synonyms) > 0).cast("int").alias("annotated"),
        )

    return let(said, score)


# Label numbers of entity types; 3 stands for "other".
ENTITY_CODES = {"PER": 0, "LOC": 1, "ORG": 2}
OTHER = 3


def entity_labels(gold: Column, pred: Column) -> Column:
    """Label pairs ``struct(gold, pred)`` of entity lists ``struct(text, type)``.

    A gold entity needs the same text and type. Surplus predictions add pairs
    (other, organisation); a missed entity counts as other, but as label 0 where there
    are more predictions than gold entities. Two empty lists agree on other.
    """
    codes = F.create_map(*[F.lit(x) for kv in ENTITY_CODES.items() for x in kv])
    pair = lambda g, p: F.struct(g.cast("int").alias("gold"), p.cast("int").alias("pred"))
    surplus = F.size(pred) - F.size(gold)
    missed = F.when(surplus > 0, 0).otherwise(OTHER)

    def one(g: Column) -> Column:
        hit = F.exists(pred, lambda p: (p["text"] == g["text"]) & (p["type"] == g["type"]))
        code = F.try_element_at(codes, g["type"])
        return pair(code, F.when(hit, code).otherwise(missed))

    extra = F.array_repeat(pair(F.lit(OTHER), F.lit(2)), F.greatest(surplus, F.lit(0)))
    empty = (F.size(gold) == 0) & (F.size(pred) == 0)
    return F.when(empty, F.array(pair(F.lit(OTHER), F.lit(OTHER)))).otherwise(F.concat(F.transform(gold, one), extra))


def relation_labels(gold: Column, pred: Column) -> Column:
    """Label pairs ``struct(gold, pred)`` of relation lists ``struct(a, b)``.

    Found gold relations are (1, 1), missed ones (1, 0). Predictions beyond the number
    of gold relations are (0, 1) unless the one at that place was a hit. An empty gold
    list is one pair with gold label 0.
    """
    pair = lambda g, p: F.struct(F.lit(g).alias("gold"), p.cast("int").alias("pred"))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"])

    def hit(g: Column, i: Column) -> Column:
        """The nth of several equal gold relations needs n equal predictions."""
        nth = F.size(F.filter(F.slice(gold, F.lit(1), i + 1), lambda x: same(x, g)))
        return pair(1, F.size(F.filter(pred, lambda p: same(p, g))) >= nth)

    found = F.transform(gold, hit)
    surplus = F.greatest(F.size(pred) - F.size(gold), F.lit(0))
    extra = F.filter(F.slice(pred, F.lit(1), surplus), lambda p: ~F.exists(gold, lambda g: same(p, g)))
    wrong = F.transform(extra, lambda p: pair(0, F.lit(1)))
    none = F.array(pair(0, (F.size(pred) > 0)))
    return F.when(F.size(gold) == 0, none).otherwise(F.concat(found, wrong))


def translate_label(answer: Column, labels: list[str], option_format: str | None = None) -> Column:
    """Numerals or roman numerals to option letters."""
    up = F.upper(answer)
    if not option_format or "numeral" not in option_format:
        return up
    roman = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]
    marks = roman if "roman" in option_format else [str(i + 1) for i in range(len(roman))]
    pairs = [F.lit(x) for m, l in zip(marks, labels) for x in (m, l)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), up), up)


def best_answer(response: Column) -> Column:
    """The word behind "the best answer is "; the response itself if the phrase is absent."""
    low = F.lower(response)
    tail = F.substring_index(F.substring_index(F.substring_index(low, "the best answer is ", -1), "\n", 1), " ", 1)
    said = F.upper(F.regexp_replace(tail, "[^a-zA-Z0-9]", ""))
    return F.when(F.contains(low, F.lit("the best answer is")), said).otherwise(response)
