"""From documents to prompts: answers, variants, templates, few-shot contexts, chats."""

from __future__ import annotations

import math
import re
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.columns import let, literal_array, strip
from tallyframe.operators.ordering import dense_index
from tallyframe.session import broadcast_if_small

# ---------------------------------------------------------------- answers and variants


def explode_answers(df: DataFrame, answers: str, name: str = "answer") -> DataFrame:
    """One row per listed answer."""
    return df.withColumn(name, F.explode(answers))


def answer_kind(blob: Column) -> Column:
    """struct(answer, kind) of a paper-question answer; the first applicable kind wins.

    Order: unanswerable, yes, free form, spans, no.
    """
    kind = lambda a, k: F.struct(a.alias("answer"), F.lit(k).alias("kind"))
    return (
        F.when(blob["unanswerable"], kind(F.lit("unanswerable"), "unanswerable"))
        .when(blob["yes_no"], kind(F.lit("yes"), "bool"))
        .when(F.coalesce(blob["free_form"], F.lit("")) != "", kind(blob["free_form"], "free form answer"))
        .when(F.size(F.coalesce(blob["spans"], literal_array([]))) > 0, kind(F.array_join(blob["spans"], ", "), "extractive_spans"))
        .when(~blob["yes_no"], kind(F.lit("no"), "bool"))
    )


def explode_typed_answers(df: DataFrame, blobs: str, wanted: str) -> DataFrame:
    """One row per answer blob of the wanted kind."""
    rows = df.withColumn("_a", F.explode(F.transform(blobs, answer_kind)))
    return rows.filter(F.col("_a.kind") == wanted).withColumn("answer", F.col("_a.answer")).drop("_a", blobs)


def number_span_date(answer: Column) -> Column:
    """Answer tuple: the number, else the spans, else the date as text."""
    date = strip(F.concat_ws(" ", answer["day"], answer["month"], answer["year"]))
    return (
        F.when(answer["number"] != "", F.array(answer["number"]))
        .when(F.size(answer["spans"]) > 0, answer["spans"])
        .otherwise(F.array(date))
    )


def valid_answers(first: Column, validated: Column) -> Column:
    """Distinct answer tuples in order of appearance."""
    return F.array_distinct(F.transform(F.concat(F.array(first), validated), number_span_date))


def expand_prompt_variants(df: DataFrame, templates: list[str]) -> DataFrame:
    """Every document with every prompt template; templates travel as a literal array."""
    return df.select("*", F.posexplode(literal_array(templates)).alias("prompt_id", "prompt"))


def expand_option_orders(df: DataFrame, labels: list[str]) -> DataFrame:
    """One row per label with the correct option swapped to that position.

    Needs ``options``, ``answer_index`` and ``answer``. A label beyond the option list
    leaves the document as it is.
    """
    rows = df.withColumn("original_answer_index", F.col("answer_index")).select(
        "*", F.posexplode(literal_array(labels)).alias("_pos", "always_same_option")
    )
    inside = F.col("_pos") < F.size("options")
    right, other = F.get("options", F.col("original_answer_index")), F.get("options", F.col("_pos"))
    swapped = F.transform(
        "options",
        lambda x, i: F.when(i == F.col("original_answer_index"), other).when(i == F.col("_pos"), right).otherwise(x),
    )
    return (
        rows.withColumn("options", F.when(inside, swapped).otherwise(F.col("options")))
        .withColumn("answer_index", F.when(inside, F.col("_pos")).otherwise(F.col("answer_index")))
        .withColumn("answer", F.when(inside, F.col("always_same_option")).otherwise(F.col("answer")))
        .drop("_pos")
    )


def shuffle_choices(df: DataFrame, key: str, choices: str, gold: str, seed: int = 0) -> DataFrame:
    """Permute the choices per document by a hash order and move the gold index along."""
    tag = lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")))
    order = F.array_sort(F.transform(choices, lambda c, i: F.struct(tag(i).alias("h"), i.alias("i"), c.alias("c"))))
    shuffled = df.withColumn("_o", order)
    new_gold = F.array_position(F.transform("_o", lambda x: x["i"]), F.col(gold).cast("int")).cast("int") - 1
    return (
        shuffled.withColumn(gold, new_gold)
        .withColumn(choices, F.transform("_o", lambda x: x["c"]))
        .withColumn("gold_letter", F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col(gold) + 1, F.lit(1)))
        .drop("_o")
    )


# ---------------------------------------------------------------- templates

FIELD = re.compile(r"\{\{\s*(.*?)\s*\}\}")
REPLACE = re.compile(r"""\s*\|\s*regex_replace\(\s*(['"])(.*?)\1\s*,\s*(['"])(.*?)\3\s*(?:,\s*(\d+)\s*)?\)""")
PART = re.compile(r"\.(strip|lstrip|rstrip|lower|upper|title)\(\)|\[(-?\d+)\]|\.(\w+)|\s*\|\s*(\w+)")


def regex_replace(col: Column, pattern: str, repl: str, count: int = 0) -> Column:
    """Replace all matches, or the first ``count`` ones; groups (``\\1``) can be used where all are replaced."""
    if count and re.search(r"\\\d", repl):
        raise ValueError("a counted replacement cannot refer to groups")
    if count:
        return F.array_join(F.split(col, pattern, count + 1), repl)
    return F.regexp_replace(col, pattern, re.sub(r"\\(\d)", r"$\1", repl.replace("$", "\\$")))


def field_reference(text: str) -> Column:
    """``name``, ``name[0]``, ``name.inner``, ``name.strip()``, ``name|trim`` as a column."""
    name = re.match(r"\w+", text)
    if not name:
        raise ValueError(f"cannot read template field {text!r}")
    col, pos = F.col(name.group()), name.end()
    calls = {"strip": strip, "trim": strip, "lower": F.lower, "upper": F.upper, "title": F.initcap}
    calls["lstrip"] = lambda c: F.regexp_replace(c, r"^\s+", "")
    calls["rstrip"] = lambda c: F.regexp_replace(c, r"\s+$", "")
    while pos < len(text):
        m = REPLACE.match(text, pos)
        if m:
            col, pos = regex_replace(col, m.group(2), m.group(4), int(m.group(5) or 0)), m.end()
            continue
        m = PART.match(text, pos)
        if not m:
            raise ValueError(f"cannot read template field {text!r}")
        call, index, inner, filt = m.groups()
        if call or filt:
            col = calls[call or filt](col)
        elif index is not None:
            i = int(index)
            col = F.try_element_at(col, F.lit(i + 1 if i >= 0 else i))
        else:
            col = col[inner]
        pos = m.end()
    return col


def render_template(template: str, columns: list[str]) -> Column:
    """A column name, or literal text with ``{{field}}`` references."""
    if template in columns:
        return F.col(template)
    parts, pos = [], 0
    for m in FIELD.finditer(template):
        parts += [F.lit(template[pos : m.start()]), field_reference(m.group(1)).cast("string")]
        pos = m.end()
    return F.concat(*[F.coalesce(p, F.lit("")) for p in [*parts, F.lit(template[pos:])]])


# Labels of answer options.
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]


def option_list(options: Column, style: str = "{letter}. {option}\n") -> Column:
    """Options as text; ``style`` may use letter, lower_case_letter, numeral, roman_numeral, option."""

    def line(x: Column, i: Column) -> Column:
        marks = {
            "letter": F.chr(i + 65),
            "lower_case_letter": F.chr(i + 97),
            "numeral": (i + 1).cast("string"),
            "roman_numeral": F.get(literal_array(ROMAN), i),
            "option": x,
        }
        pieces = re.split(r"\{(\w+)\}", style)
        return F.concat(*[marks[p] if n % 2 else F.lit(p) for n, p in enumerate(pieces)])

    return F.array_join(F.transform(options, line), "")


def target_value(target: Column, choices: Column | None = None) -> Column:
    """Target text: a digit string picks the choice at that position."""
    if choices is None:
        return target
    index = F.when(target.rlike(r"^\d+$"), target.try_cast("int"))
    return F.coalesce(F.get(choices, index), target)


# ---------------------------------------------------------------- choice texts and bias

# Answers that mean "unknown".
UNKNOWN_RESPONSES = [
    "Unknown", "Cannot answer", "Can't be determined", "Cannot be determined", "Can't answer", "Not known",
    "Not enough info", "Not enough information", "Not answerable", "Undetermined",
]


def entity_choices(entities: Column, query: Column) -> Column:
    """Sorted distinct entities put into the query in place of ``@placeholder``."""
    return F.transform(
        F.array_sort(F.array_distinct(entities)),
        lambda e: F.concat(F.lit("  - "), F.replace(query, F.lit("@placeholder"), e)),
    )


def choices_with_unknown(answers: Column) -> Column:
    """The answers without their own "unknown" entry, followed by all unknown phrases."""
    known = literal_array(UNKNOWN_RESPONSES)
    return F.concat(F.filter(answers, lambda a: ~F.array_contains(known, a)), known)


def answer_groups(info: Column, answer: Column) -> Column:
    """Group names of one answer: rewritten, lower case, intersectional groups split."""
    text = F.when(F.exists(info, lambda x: x != ""), F.array_join(info, "_")).when(answer.contains("Latina"), "Latino")
    for old, new in [("M-", "M_"), ("F-", "F_"), ("lowSES-", "lowSES_"), ("highSES-", "highSES_"), ("lowSES", "low SES"),
                     ("highSES", "high SES"), ("nonObese", "non Obese"), ("nonDisabled", "non Disabled"), ("nonTrans", "non Trans")]:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = let(
        text,
        lambda t: F.when(t.contains("woman"), F.replace(t, F.lit("woman"), F.lit("F_woman"))).otherwise(
            F.replace(t, F.lit("man"), F.lit("M_man"))
        ),
    )
    for old, new in [("girl", "F_girl"), ("boy", "M_boy")]:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.split(F.lower(text), "_")


def bias_annotate(df: DataFrame) -> DataFrame:
    """Add ``ans<i>_groups`` and ``biased_answers``.

    Needs ans0..ans2, answer_info (struct of arrays), stereotyped_groups and
    question_polarity. Negative questions: answers of a stereotyped group are biased;
    otherwise answers of the other known group.
    """
    for i in range(3):
        df = df.withColumn(f"ans{i}_groups", answer_groups(F.col(f"answer_info.ans{i}"), F.col(f"ans{i}")))
    stereo = F.transform("stereotyped_groups", F.lower)
    neg = F.col("question_polarity") == "neg"

    def biased(i: int) -> Column:
        groups = F.col(f"ans{i}_groups")
        hit = F.arrays_overlap(groups, stereo)
        return (neg & hit) | ((F.col("question_polarity") == "nonneg") & ~hit & (F.element_at(groups, -1) != "unknown"))

    cells = F.array(*[F.struct(biased(i).alias("b"), F.col(f"ans{i}").alias("a")) for i in range(3)])
    return df.withColumn("biased_answers", F.transform(F.filter(cells, lambda c: c["b"]), lambda c: c["a"]))


# ---------------------------------------------------------------- few-shot


def hash_number(*parts: Column) -> Column:
    """A non-negative number from an md5 over the parts; the same on every engine."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), F.lit(1), F.lit(15)), 16, 10).cast("long")


def next_prime(n: int) -> int:
    """The smallest prime from ``n`` on."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def sample_fewshot(
    docs: DataFrame, key: str, pool: DataFrame, pool_key: str, k: int, sampler: str = "random", seed: int = 0,
    same_split: bool = False, doc_cols: list[str] = (),
) -> DataFrame:
    """(key, rank, pool columns): k examples per document, never the document itself.

    The pool gets consecutive positions (``first_n``: by key; ``random``: by a seeded
    hash). With ``first_n`` a document takes the first k others. With ``random`` it walks a
    ring of prime size with a start and a step of its own, so any two of its draws are
    independent of each other and of other documents' draws. The positions are joined by
    equality, so neither side is multiplied by the other, and only a pool measured as small
    is broadcast.
    """
    renamed = pool.select(F.col(pool_key).alias("pool_id"), *[F.col(c).alias(f"pool_{c}") for c in pool.columns if c != pool_key])
    if sampler == "first_n":
        # at most k + 1 rows are ever needed
        head = renamed.orderBy("pool_id").limit(k + 1)
        found = head.count()
        if found < k + (1 if same_split else 0):
            raise ValueError(f"{k} examples asked from a pool of {found}")
        placed = dense_index(head, ["pool_id"], "_at")
        size, start, step = found, F.lit(0).cast("long"), F.lit(1).cast("long")
        ring = size
    elif sampler == "random":
        size = pool.count()
        if size < k + (1 if same_split else 0):
            raise ValueError(f"{k} examples asked from a pool of {size}")
        hashed = renamed.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pool_id").cast("string"))))
        placed = dense_index(hashed, ["_h", "pool_id"], "_at").drop("_h")
        ring = next_prime(size)
        start = F.pmod(hash_number(F.lit(seed), F.col(key)), F.lit(ring))
        step = 1 + F.pmod(hash_number(F.lit(f"{seed}b"), F.col(key)), F.lit(ring - 1))
    else:
        raise ValueError(sampler)
    placed = broadcast_if_small(placed, [c for c in placed.columns if c != "_at"])
    base = docs.select(key, *doc_cols).withColumn("_start", start).withColumn("_step", step)
    own = F.lit(None).cast("long")
    if same_split:
        base = base.join(placed.select(F.col("pool_id").alias(key), F.col("_at").alias("_own")), key, "left")
        own = F.col("_own")
    # The walk meets every position once; of its first steps, at most ``ring - size`` lie outside and one is the document.
    walk = F.transform(F.sequence(F.lit(0), F.lit(k + ring - size).cast("int")), lambda j: F.pmod(F.col("_start") + F.col("_step") * j, F.lit(ring)))
    right = F.filter(walk, lambda at: (at < size) & (own.isNull() | (at != own)))
    steps = base.select(key, *doc_cols, F.posexplode(F.slice(right, 1, k)).alias("_j", "_at")).withColumn("rank", F.col("_j") + 1)
    return steps.join(placed, "_at").drop("_at", "_j")


def first_shots(pool: DataFrame, pool_key: str, k: int) -> list[dict]:
    """The first k pool rows in key order, as literals for every document: no example travels with the documents."""
    names = {c: c if c == pool_key else f"pool_{c}" for c in pool.columns}
    rows = pool.orderBy(pool_key).limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{k} examples asked from a pool of {len(rows)}")
    return [{names[c]: v for c, v in r.asDict().items()} for r in rows]


def with_shots(docs: DataFrame, key: str, shots: DataFrame | list[dict], one: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """``docs`` with ``_shots``: an array of ``one`` per example in order, null where a document has none."""
    if isinstance(shots, list):
        literals = [one(lambda name, row=row: F.lit(row[name])) for row in shots]
        return docs.withColumn("_shots", F.array(*literals) if literals else F.lit(None))
    listed = F.array_sort(F.collect_list(F.struct("rank", one(F.col).alias("t"))))
    ex = shots.groupBy(key).agg(F.transform(listed, lambda x: x["t"]).alias("_shots"))
    return docs.join(ex, key, "left")


def build_context(
    docs: DataFrame, key: str, question: str, shots: DataFrame | list[dict], shot_text: str, shot_target: str, description: str = "",
    target_delimiter: str = " ", fewshot_delimiter: str = "\n\n", gen_prefix: str = "",
) -> DataFrame:
    """Description, labelled examples and question in one text; at most k examples per document."""
    prefix = gen_prefix + " " if gen_prefix else ""
    one = lambda get: F.concat(
        get(shot_text),
        F.when(get(shot_target) != "", F.concat(F.lit(target_delimiter + prefix), get(shot_target), F.lit(fewshot_delimiter))).otherwise(""),
    )
    tail = F.lit(target_delimiter + gen_prefix if gen_prefix else "")
    examples = F.coalesce(F.array_join("_shots", ""), F.lit(""))
    context = F.concat(F.lit(description), examples, F.col(question), tail)
    return with_shots(docs, key, shots, one).withColumn("context", context).drop("_shots")


def chat_turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_chat(
    docs: DataFrame, key: str, question: str, shots: DataFrame | list[dict], shot_text: str, shot_target: str, system: str = "",
    multiturn: bool = True, target_delimiter: str = " ", fewshot_delimiter: str = "\n\n", gen_prefix: str = "",
) -> DataFrame:
    """Chat as an array of (role, content).

    Multi-turn: examples alternate user and assistant. Otherwise all examples and the
    question share one user turn. A generation prefix becomes a last assistant turn.
    """
    prefix = gen_prefix + " " if gen_prefix else ""
    none = F.array().cast("array<struct<role:string,content:string>>")
    if multiturn:
        one = lambda get: F.array(chat_turn("user", get(shot_text)), chat_turn("assistant", F.concat(F.lit(prefix), get(shot_target))))
        user = F.array(chat_turn("user", F.col(question)))
        middle = F.concat(F.coalesce(F.flatten("_shots"), none), user)
    else:
        one = lambda get: F.concat(get(shot_text), F.lit(target_delimiter + prefix), get(shot_target), F.lit(fewshot_delimiter))
        middle = F.array(chat_turn("user", F.concat(F.coalesce(F.array_join("_shots", ""), F.lit("")), F.col(question))))
    head = F.array(chat_turn("system", F.lit(system))) if system else none
    tail = F.array(chat_turn("assistant", F.lit(gen_prefix))) if gen_prefix else none
    return with_shots(docs, key, shots, one).withColumn("chat", F.concat(head, middle, tail)).drop("_shots")


# ---------------------------------------------------------------- question sheets

SHEET = (
    "array<struct<prompt:string,subprompts:array<struct<questionpart_n:string,question:string,answer:string>>>>"
)


def load_sheet_questions(df: DataFrame, key: str, preamble: str, context: str, questions: str) -> DataFrame:
    """One row per question of a sheet: texts of the sheet and the question, empty and filled answers."""
    parsed = df.withColumn("_q", F.from_json(questions, SHEET))
    part = lambda p: F.concat(p["questionpart_n"], F.lit(" "), p["question"], F.lit("\n"))
    block = lambda q: F.concat(F.lit("\n"), q["prompt"], F.lit("\n"), F.array_join(F.transform(q["subprompts"], part), ""))
    sheet = parsed.withColumn("_all", F.array_join(F.transform("_q", block), ""))
    rows = sheet.select(key, preamble, context, "_all", F.posexplode("_q").alias("question_index", "_one"))
    parts = F.col("_one.subprompts")
    keys = F.transform(parts, lambda p: p["questionpart_n"])
    empty = F.map_from_arrays(keys, F.transform(parts, lambda p: F.lit("")))
    filled = F.map_from_arrays(keys, F.transform(parts, lambda p: p["answer"]))
    return rows.select(
        key,
        "question_index",
        F.concat(F.col(preamble), F.lit("\n"), F.col(context), F.lit("\n"), F.col("_all")).alias("sheet"),
        F.concat(F.col(preamble), F.lit("\n"), F.col("_all")).alias("sheet_no_context"),
        block(F.col("_one")).alias("question"),
        F.to_json(empty).alias("answer_form"),
        F.to_json(filled).alias("answers"),
    )
