"""Named clean-up chains for benchmark texts, and adapters for single datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.columns import after_first, before_first, strip, words

# Fixed values: (kind, pattern, replacement); kind "r" is a regular expression, "t" plain text.
PROFILES: dict[str, list[tuple[str, str, str]]] = {
    "brackets": [("r", r"^\s+|\s+$", ""), ("t", " [title]", ". "), ("r", r"\[.*?\]", ""), ("t", "  ", " ")],
    "general_detokenize": [
        ("t", " n't", "n't"), ("t", " )", ")"), ("t", "( ", "("), ("t", '" ', '"'), ("t", ' "', '"'), ("r", r" (['.,])", "$1"),
    ],
    "dialogue_detokenize": [
        ("t", " '", "'"), ("t", " \n", "\n"), ("t", "\n ", "\n"), ("t", " n't", "n't"), ("t", "`` ", '"'), ("t", "''", '"'),
        ("t", " :", ":"), ("t", " ;", ";"), ("t", " !", "!"), ("t", " ?", "?"), ("t", " ,", ","), ("t", " .", "."),
    ],
    "wiki_detokenize": [
        ("t", "s '", "s'"), ("t", " @-@ ", "-"), ("t", " @,@ ", ","), ("t", " @.@ ", "."), ("t", " : ", ": "), ("t", " ; ", "; "),
        ("t", " . ", ". "), ("t", " ! ", "! "), ("t", " ? ", "? "), ("t", " , ", ", "),
        ("r", r"\(\s*([^\)]*?)\s*\)", "($1)"), ("r", r"\[\s*([^\]]*?)\s*\]", "[$1]"), ("r", r"\{\s*([^}]*?)\s*\}", "{$1}"),
        ("r", r"\"\s*([^\"]*?)\s*\"", '"$1"'), ("r", r"'\s*([^']*?)\s*'", "'$1'"),
        ("t", "= = = =", "===="), ("t", "= = =", "==="), ("t", "= =", "=="), ("t", " ° ", "°"), ("t", " \n", "\n"), ("t", "\n ", "\n"),
        ("t", " N ", " 1 "), ("t", " 's", "'s"),
    ],
    "highlights": [("r", r"(\.|\?|\!|\"|')\n@highlight\n", "$1 "), ("r", r"\n@highlight\n", ". ")],
    "squeeze_spaces": [("r", " +", " ")],
    "drop_final_punctuation": [("r", r"[.,;]$", "")],
}


def clean_text(text: Column, profile: str) -> Column:
    for kind, old, new in PROFILES[profile]:
        text = F.regexp_replace(text, old, new) if kind == "r" else F.replace(text, F.lit(old), F.lit(new))
    return text


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def capitalize(text: Column) -> Column:
    """First letter upper, all others lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def sentence_pair(first: Column, second: Column) -> tuple[Column, Column]:
    """Detokenized pair; the first loses its final mark, the second starts in lower case."""
    a = clean_text(strip(clean_text(first, "general_detokenize")), "drop_final_punctuation")
    return a, lower_first(strip(clean_text(second, "general_detokenize")))


# ---------------------------------------------------------------- dataset adapters


def blank_sentence(df: DataFrame) -> DataFrame:
    """A sentence with ``_``: the options become contexts, the rest is the target."""
    head = before_first(F.col("sentence"), "_")
    return df.select(
        "*",
        F.array(F.concat(head, "option1"), F.concat(head, "option2")).alias("contexts"),
        strip(after_first(F.col("sentence"), "_")).alias("target"),
        (F.col("answer").cast("int") - 1).alias("gold"),
    )


PROBLEMS = "array<struct<question:string,answer:string,options:array<string>>>"


def last_problem(df: DataFrame) -> DataFrame:
    """A list of problems about one article: all but the last are solved examples."""
    letter = lambda a: (F.ascii(a) - 65).cast("int")

    def solved(p: Column) -> Column:
        answer = F.get(p["options"], letter(p["answer"]))
        gap = F.endswith(p["question"], F.lit("  _  ."))
        filled = F.concat(F.right(p["question"], F.lit(5)), answer, F.lit("\n"))
        plain = F.concat(F.lit("Question: "), p["question"], F.lit("\nAnswer: "), answer, F.lit("\n"))
        return F.when(gap, filled).otherwise(plain)

    parsed = df.withColumn("_p", F.from_json("problems", PROBLEMS))
    last = F.element_at("_p", -1)
    earlier = F.slice("_p", F.lit(1), F.greatest(F.size("_p") - 1, F.lit(0)))
    text = F.concat(F.lit("Article: "), "article", F.lit("\n\n"), F.array_join(F.transform(earlier, solved), ""), last["question"])
    return parsed.select(
        *df.columns, text.alias("text"), F.slice(last["options"], 1, 4).alias("choices"), letter(last["answer"]).alias("gold")
    )


def one_based_answer(df: DataFrame) -> DataFrame:
    gold = F.col("correct_answer_id").cast("int") - 1
    return df.select("*", gold.alias("gold"), F.get("answer_options", gold).alias("target"))


def lettered_options(df: DataFrame) -> DataFrame:
    """``a ) x , b ) y , … e ) z`` to a list."""
    found = F.regexp_extract_all("options", F.lit(r"([abcd] \) .*?, |e \) .*?$)"), F.lit(1))
    tidy = lambda c: F.regexp_replace(F.substr(c, F.lit(5)), "[ ,]+$", "")
    return df.withColumn("choices", F.transform(found, tidy))


def four_endings(df: DataFrame) -> DataFrame:
    from tallyframe.operators.prompts import option_list

    listed = option_list(F.array(*[f"ending{i}" for i in range(4)]))
    text = F.concat(F.lit("Question: "), "sent1", F.lit("\n"), listed, F.lit("Answer:"))
    return df.withColumn("text", text)


def connected_premise(df: DataFrame, connectors: dict[str, str]) -> DataFrame:
    """Premise without its final mark plus a connector word; choices in lower case."""
    lookup = F.create_map(*[F.lit(x) for kv in connectors.items() for x in kv])
    premise = strip(F.col("premise"))
    text = F.concat(F.substr(premise, F.lit(1), F.length(premise) - 1), F.lit(" "), F.try_element_at(lookup, F.col("question")))
    return df.select("*", text.alias("text"), F.array(lower_first(F.col("choice1")), lower_first(F.col("choice2"))).alias("choices"))


# Pronouns that are lower-cased inside a sentence, and possessives.
UPPER_PRONOUNS = ["A", "An", "The", "She", "He", "It", "They", "My", "His", "Her", "Their"]
POSSESSIVES = ["my", "his", "her", "our", "their"]


def pronoun_options(df: DataFrame) -> DataFrame:
    """Possessive options get ``'s``; a leading pronoun is lower-cased inside a sentence."""
    text = F.replace("text", F.lit("  "), F.lit(" "))
    starts = F.substr(text, F.col("pronoun_loc") - 1, F.lit(1)) == "."

    def fix(option: Column) -> Column:
        o = F.when(F.lower("pronoun").isin(POSSESSIVES), F.concat(option, F.lit("'s"))).otherwise(option)
        first = F.get(words(o), F.lit(0))
        return F.when(~starts & first.isin(UPPER_PRONOUNS), F.replace(o, first, F.lower(first))).otherwise(o)

    return df.withColumn("options", F.transform("options", fix)).withColumn("text", text)


def moral_story(df: DataFrame) -> DataFrame:
    """Norm, situation and intention as query; the moral action is always the first choice."""
    query = F.concat_ws(" ", *[capitalize(F.col(c)) for c in ("norm", "situation", "intention")])
    return df.select("*", query.alias("query"), F.array("moral_action", "immoral_action").alias("choices"), F.lit(0).alias("label"))


def truthful_references(df: DataFrame) -> DataFrame:
    """Answers end with a period; "I have no comment." counts as a right answer."""
    none = "I have no comment."

    def dotted(answers: str) -> Column:
        kept = F.filter(F.transform(answers, lambda a: strip(a)), lambda a: a != "")
        return F.transform(kept, lambda a: F.when(F.endswith(a, F.lit(".")), a).otherwise(F.concat(a, F.lit("."))))

    right = dotted("correct_answers")
    right = F.when(F.array_contains(right, none), right).otherwise(F.concat(right, F.array(F.lit(none))))
    return (
        df.withColumn("question", strip(F.col("question")))
        .withColumn("correct_answers", right)
        .withColumn("incorrect_answers", dotted("incorrect_answers"))
    )


# First and last code point of the Indic script blocks.
INDIC = "[\\u0900-\\u0D7F]"


def keep_prescriptions(df: DataFrame) -> DataFrame:
    """Keep rows with a diagnosis and medicines that hold no Indic script."""
    bad = F.exists("medicines", lambda m: m.rlike(INDIC))
    return df.filter((F.col("diagnosis") != "NA") & ~F.col("diagnosis").rlike(INDIC) & (F.size("medicines") > 0) & ~bad)


def prepended_question(df: DataFrame) -> DataFrame:
    """Question and body of an input, split at the first empty line."""
    return df.select("*", before_first(F.col("input"), "\n\n").alias("question"), after_first(F.col("input"), "\n\n").alias("text"))


ADAPTERS = {
    "winogrande": blank_sentence, "race": last_problem, "qa4mre": one_based_answer, "mathqa": lettered_options,
    "medqa": four_endings, "copa": connected_premise, "wsc273": pronoun_options, "moral_stories": moral_story,
    "truthfulqa": truthful_references, "prescriptions": keep_prescriptions, "scrolls": prepended_question,
}


def adapt_item(df: DataFrame, dataset: str, **options) -> DataFrame:
    return ADAPTERS[dataset](df, **options)
