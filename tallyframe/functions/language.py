"""Languages of texts by naive Bayes over the edges of words, learned from labelled texts.

The features are the first and the last three letters of every word. Training counts them per language in one aggregate;
the most frequent ones of each language make up the profile, whose size depends on the number of languages alone. Weights are
whole numbers (scaled logarithms), so that sums do not depend on their order. Detection is a column: a look-up per feature
and a sum per language inside the row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions.columns import let

EDGE = 3
SCALE = 16
PER_LANGUAGE = 150


def edge_grams(text: Column) -> Column:
    """First and last letters of the words, marked on their outer side; repeats stay."""
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    edges = lambda w: F.array(F.concat(F.lit("^"), F.left(w, F.lit(EDGE))), F.concat(F.right(w, F.lit(EDGE)), F.lit("$")))
    return F.flatten(F.transform(tokens, edges))


@dataclass(frozen=True)
class LanguageProfile:
    """Languages in order of their names, and the weight of every known feature for each of them."""

    languages: tuple[str, ...]
    weights: dict[str, tuple[int, ...]]

    def detect(self, text: Column) -> Column:
        """The likeliest language, the first one by name on a tie; NULL where no feature of the text is known."""
        if not self.weights:
            return F.lit(None).cast("string")
        known = F.create_map(*[x for g, w in self.weights.items() for x in (F.lit(g), F.array(*map(F.lit, w)))])

        def best(found: Column) -> Column:
            total = lambda k: F.aggregate(found, F.lit(0).cast("long"), lambda acc, w: acc + F.get(w, F.lit(k)))
            scores = [F.struct(total(k).alias("score"), F.lit(-k).alias("place"), F.lit(x).alias("language")) for k, x in enumerate(self.languages)]
            return F.when(F.size(found) > 0, F.array_max(F.array(*scores))["language"])

        look_up = F.filter(F.transform(edge_grams(text), lambda g: F.try_element_at(known, g)), lambda w: w.isNotNull())
        return let(look_up, best)


def train_languages(docs: DataFrame, text: str, language: str, per_language: int = PER_LANGUAGE) -> LanguageProfile:
    """Learn from labelled texts; rows without a text or a language do not count.

    What reaches the driver are the counts of the chosen features, at most ``per_language`` times the languages squared.
    """
    grams = docs.filter(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.explode(edge_grams(F.col(text))).alias("gram"))
    counts = grams.groupBy("language", "gram").agg(F.count("*").alias("n"))
    first = Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    chosen = counts.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language).select("gram").distinct()
    rows = counts.join(F.broadcast(chosen), "gram", "left_semi").collect()
    languages = tuple(sorted({r["language"] for r in rows}))
    found = {(r["language"], r["gram"]): r["n"] for r in rows}
    vocabulary = sorted({g for _, g in found})
    size = {x: sum(found.get((x, g), 0) for g in vocabulary) + len(vocabulary) for x in languages}
    weight = lambda x, g: round(SCALE * math.log((found.get((x, g), 0) + 1) / size[x]))
    return LanguageProfile(languages, {g: tuple(weight(x, g) for x in languages) for g in vocabulary})
