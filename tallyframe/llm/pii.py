"""Personal data by weak supervision, inside the row and without user code.

Base spans are exact patterns and always stay. Beyond them, candidate spans (mixed letter-digit tokens, long digit
runs, capitalised name pairs) get votes from regex, gazetteer and context labelers. Expectation-maximisation over the
counted vote patterns estimates what each labeler's vote is worth, and a logistic span classifier is fitted to the
resulting posteriors. Vote and feature patterns are counted by Spark; the driver sees at most one row for each
combination of votes and features, whatever the number of documents.

Defined cases: null or empty text has no spans; repeated rows are treated alike; with no candidates at all the
classifier adds nothing; an empty table gives an empty result; extra columns are kept by :func:`find_spans` and
:func:`redact` (their own columns take precedence on a clash of names). Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.registry import query
from tallyframe.llm.shared import table, text_of

# Kinds in their listed order, then the kinds that the method adds.
KINDS = ["email", "ip", "card", "phone", "secret", "person"]
BASE = KINDS[:4]
# A match can only begin where its first run begins, or where the match before ended: no run is tried at each place.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
# Shorter digit runs fail the length test, so they need not match.
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,64}[0-9])[A-Za-z0-9+/_-]{12,}+"
# Titles and given names that open a name.
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof"]
GIVEN = [
    "James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William",
    "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Maria", "Anna",
    "Peter", "Hans", "Pierre", "Marie", "Carlos", "Juan", "Sofia", "Lucia",
]
NAME = rf"(?<![\p{{L}}])(?=[A-Z])(?:(?:{'|'.join(TITLES)})\.?|{'|'.join(GIVEN)})(?: [A-Z][\p{{Ll}}]++){{1,2}}"
KEY_PREFIX = r"^(AKIA|ASIA|AIza|sk-|ghp_|xox[abp]-|eyJ)"
HEX = r"^[0-9a-f]{32,}$|^[0-9A-F]{32,}$"
SECRET_WORDS = r"(?i)(pass(word|wd)?|pwd|secret|token|api.?key|key|credential|auth)\W{0,4}$"
NAME_WORDS = r"(?i)(name|contact|by|dear|author|from|signed)\W{0,3}$"
PLAIN_WORDS = r"(?i)(version|page|figure|chapter|isbn|build|model|section|no\.)\W{0,4}$"
CONTEXT = 24
LABELERS = ["prefix", "hex", "mixed", "gazetteer", "context", "plain", "shape"]


def matches(text: Column, pattern: str, applies: Column) -> Column:
    """All matches in order, as array<struct<start, end, text>>; offsets come from the lengths of the pieces between."""
    found = F.when(applies, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(applies, F.split(text, pattern, -1))
    pairs = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["g"])
        end = start + F.length(p["m"])
        one = F.struct(start.alias("start"), end.alias("end"), p["m"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(zero["out"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    back = F.reverse(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def octets(text: Column) -> Column:
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(text, r"\."), small)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the exact patterns, sorted."""
    digit = F.regexp_like(text, F.lit("[0-9]"))
    length = lambda m: F.length(digits(m["text"]))
    tests = {
        "email": (EMAIL, F.contains(text, F.lit("@")), None),
        "ip": (IP, digit & F.contains(text, F.lit(".")), lambda m: octets(m["text"])),
        "card": (CARD, digit, lambda m: (length(m) <= 19) & luhn(digits(m["text"]))),
        "phone": (PHONE, digit & F.contains(text, F.lit("+")), lambda m: length(m).between(9, 15)),
    }
    found = []
    for kind, (pattern, applies, test) in tests.items():
        spans = matches(text, pattern, applies)
        spans = F.filter(spans, test) if test else spans
        number = F.lit(KINDS.index(kind)).alias("kind")
        found.append(F.transform(spans, lambda m: F.struct(m["start"], number, m["end"])))
    return F.sort_array(F.concat(*found))


def candidates(text: Column, base: Column) -> Column:
    """Spans beside the base ones, with the text before them: array<struct<start, end, text, kind, before>>."""
    digit = F.regexp_like(text, F.lit("[0-9]"))
    both = []
    for kind, pattern, applies in (("secret", TOKEN, digit), ("person", NAME, F.lit(True))):
        spans = matches(text, pattern, applies)
        free = lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
        from_ = lambda m: F.greatest(m["start"] - CONTEXT, F.lit(0))
        number = F.lit(KINDS.index(kind)).alias("kind")
        both.append(F.transform(F.filter(spans, free), lambda m: F.struct(
            m["start"], m["end"], m["text"], number,
            F.substr(text, from_(m) + 1, m["start"] - from_(m)).alias("before"),
        )))
    return F.concat(*both)


def votes(c: Column) -> list[Column]:
    """One vote per labeler: 1 personal, -1 not, 0 no opinion."""
    secret = c["kind"] == KINDS.index("secret")
    text, before = c["text"], c["before"]
    opinion = lambda yes, no=None: F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)
    counts = F.length(digits(text))
    return [
        opinion(secret & text.rlike(KEY_PREFIX)),
        opinion(secret & text.rlike(HEX)),
        opinion(secret & (counts >= 3) & text.rlike("[A-Za-z]"), secret & ((counts < 2) | ~text.rlike("[A-Za-z]"))),
        opinion(~secret & text.rlike(rf"^(?:{'|'.join(GIVEN)}) |\. (?:{'|'.join(GIVEN)})")),
        opinion(F.when(secret, before.rlike(SECRET_WORDS)).otherwise(before.rlike(NAME_WORDS))),
        opinion(F.lit(False), before.rlike(PLAIN_WORDS)),
        opinion(F.when(secret, F.length(text) >= 20).otherwise(text.rlike(r"^(?:" + "|".join(TITLES) + ")")), secret & (F.length(text) < 14)),
    ]


def features(c: Column) -> list[Column]:
    """Small whole numbers that describe the span; the classifier gets them one-hot, beside the votes."""
    share = lambda part: F.floor(F.lit(4) * F.length(part) / F.greatest(F.length(c["text"]), F.lit(1)))
    return [
        c["kind"], F.least(F.floor(F.length(c["text"]) / 8), F.lit(6)),
        share(digits(c["text"])), share(F.regexp_replace(c["text"], "[^A-Z]", "")),
    ]


def coded(values: list[Column]) -> Column:
    return F.array(*[v.cast("int") for v in values])


#: What a labeler is believed to do before any data: P(vote | personal) and P(vote | not), and the weight of that
#: belief as a share of the candidates. It ties the two classes to their meaning.
BELIEF = {1: {-1: 0.05, 0: 0.5, 1: 0.45}, 0: {-1: 0.3, 0: 0.65, 1: 0.05}}
BELIEF_SHARE = 0.5


def estimate(patterns: list[tuple[tuple, float]], rounds: int = 40) -> dict[tuple, float]:
    """Posterior of each counted vote pattern by expectation-maximisation, started from the majority vote."""
    post = {v: min(max(0.5 + 0.2 * sum(v), 0.05), 0.95) for v, _ in patterns}
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        prior = (1 + sum(post[v] * n for v, n in patterns)) / (2 + total)
        held = 1 + BELIEF_SHARE * total
        mass = {y: held + sum((post[v] if y else 1 - post[v]) * n for v, n in patterns) for y in (0, 1)}
        rate = {
            (j, x, y): (held * BELIEF[y][x] + sum((post[v] if y else 1 - post[v]) * n for v, n in patterns if v[j] == x)) / mass[y]
            for j in range(len(LABELERS)) for x in (-1, 0, 1) for y in (0, 1)
        }
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[j, x, 1] / rate[j, x, 0]) for j, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(min(odds, 30), -30)))
    return post


def fit_classifier(rows: list[tuple[tuple, float, float]], rounds: int = 200) -> dict[tuple[int, int], float]:
    """Logistic regression on one-hot codes with soft labels: (codes, target, count) -> weight by (place, value)."""
    weight: dict[tuple[int, int], float] = {(-1, 0): 0.0}
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        slope = dict.fromkeys(weight, 0.0)
        for codes, target, n in rows:
            keys = [(-1, 0), *enumerate(codes)]
            p = 1 / (1 + math.exp(-max(min(sum(weight.get(k, 0.0) for k in keys), 30), -30)))
            for k in keys:
                slope[k] = slope.get(k, 0.0) + (target - p) * n / total
        for k, g in slope.items():
            weight[k] = weight.get(k, 0.0) + 4.0 * (g - 1e-4 * weight.get(k, 0.0))
    return weight


def fit(docs: DataFrame, text_col: str = "text") -> dict[tuple[int, int], float]:
    """Classifier weights from the candidates of all documents; no candidates, no weights."""
    rows = docs.select(text_of(text_col).alias("t")).select("t", base_spans(F.col("t")).alias("b"))
    rows = rows.select(F.explode(candidates(F.col("t"), F.col("b"))).alias("c"))
    counted = rows.groupBy(coded(votes(F.col("c"))).alias("v"), coded(features(F.col("c"))).alias("f")).count().collect()
    by_votes: dict[tuple, float] = {}
    for r in counted:
        by_votes[tuple(r.v)] = by_votes.get(tuple(r.v), 0) + r["count"]
    post = estimate(sorted(by_votes.items()))
    return fit_classifier([((*r.f, *r.v), post[tuple(r.v)], r["count"]) for r in counted]) if counted else {}


def score(c: Column, weights: dict[tuple[int, int], float]) -> Column:
    """Log-odds of a candidate."""
    out = F.lit(weights.get((-1, 0), 0.0))
    for place, value in enumerate([*features(c), *votes(c)]):
        known = {v: w for (p, v), w in weights.items() if p == place}
        for v, w in sorted(known.items()):
            out = out + F.when(value == v, F.lit(w)).otherwise(F.lit(0.0))
    return out


def find_spans(docs: DataFrame, weights: dict[tuple[int, int], float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (all of them): sorted array<struct<start, kind, end>>."""
    out = docs.withColumn("base_spans", base_spans(text_of(text_col)))
    if not weights:
        return out.withColumn("spans", F.col("base_spans"))
    added = F.filter(candidates(text_of(text_col), F.col("base_spans")), lambda c: score(c, weights) > 0)
    added = F.transform(added, lambda c: F.struct(c["start"], c["kind"], c["end"]))
    return out.withColumn("spans", F.sort_array(F.concat("base_spans", added)))


def joined(spans: Column) -> Column:
    kind = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every span by its kind in brackets; overlapping spans become one."""
    text = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    kind = lambda s: F.get(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"])

    def step(acc: Column, s: Column) -> Column:
        more = F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), kind(s))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"),
        )

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1))
    return docs.withColumn(text_col, F.when(F.size("spans") > 0, F.aggregate("spans", zero, step, end)).otherwise(text))


@query()
def op1_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit(docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
