"""Licence scan of paragraphs: sparse word n-gram logistic regression, a calibrated unknown class, template comparison.

Each line is a paragraph, and so is each run of lines with words, so that hard-wrapped notices are read in one piece;
``n_paragraphs`` counts the lines. Paragraphs of more than ``WINDOW`` words are looked at in overlapping windows, so whole
texts are read. A hit of a run names the line of its first words and takes the place of less similar hits in its own lines.
Features are the 1- to 3-word sequences of the templates. A softmax over the families and "unknown" is trained on varied
templates and on about ``SAMPLE`` pieces of at most ``WINDOW`` words without licence text, chosen by a hash of their words
from all pieces of all texts. The least probability of a family is calibrated on held-out unknown pieces. A prediction counts if the paragraph also
holds ``SIMILAR`` of the n-grams of one template of that family.

Defined cases: null and empty texts have no paragraphs; repeated rows are scanned alike; without any sample only the
templates and fixed negatives train the model; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm import textnp
from tallyframe.llm.registry import query
from tallyframe.llm.shared import table, words_of

# Wordings by which licence families are commonly declared.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Distributed under the Apache 2.0 license.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GPL version 2 or later.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.", "This code is licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the MPL 2.0.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This work has been dedicated to the public domain.", "To the extent possible under law, the author has waived all copyright (CC0 1.0)."],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL version 3 or later.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL version 3 or later.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "unlicense": [
        "Released under the Unlicense.", "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "epl-2.0": [
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ],
    "proprietary": ["All rights reserved.", "Copyright 2020 the authors. All rights reserved. No part may be reproduced without written permission."],
}
# Sentences that use words of licences without granting one.
OTHERS = [
    "The driver showed a license to the officer.", "All of the people reserved a table by the window.", "The public library has a version of the work.",
    "This work is part of a general study.", "He was released under the terms of an agreement.", "You may use this room, and you may obtain a key at the desk.",
    "Copyright law is a field of private law.", "The software was distributed to all the authors.", "Rights of the public are subject to the terms of law.",
]
FAMILIES = [*TEMPLATES, "unknown"]
WINDOW = 64
SAMPLE = 8000
SIMILAR = 0.6
FALSE_RATE = 0.001
OUTPUT = (
    "doc_id long, n_paragraphs long, "
    "licenses array<struct<line:int,family:string,probability:double,similarity:double,confirmed:boolean>>"
)


def ngrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the 1- to 3-word sequences (words x 3, 0 where a row ends), row and place in the row of each word."""
    starts, ends, rows = textnp.word_bounds(data, at, textnp.IS_MARK)
    one = textnp.word_hashes(textnp.LOWER[data], starts, ends)
    out = np.zeros((len(one), 3), np.uint64)
    out[:, 0] = one
    for k in (1, 2):
        same = rows[k:] == rows[:-k] if len(rows) > k else np.zeros(0, bool)
        out[: len(same), k] = np.where(same, textnp.mix((out[: len(same), k - 1] + one[k:][: len(same)]) * textnp.BASE), 0)
    counts = np.bincount(rows, minlength=len(at) - 1)
    return out, rows, np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]


def lines_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of all rows, and the row of each line."""
    bounds = np.unique(np.concatenate([at, np.flatnonzero(data == 10) + 1]))
    return bounds, np.searchsorted(at, bounds[:-1], "right") - 1


def grouped_hits(vocabulary: np.ndarray, grams: np.ndarray, rows: np.ndarray, place: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, feature) pairs; a group is row * 2^32 + window."""
    at = np.minimum(np.searchsorted(vocabulary, grams), len(vocabulary) - 1)
    word, column = np.nonzero((vocabulary[at] == grams) & (grams != 0))
    long = np.bincount(rows, minlength=n_rows)[rows[word]] > WINDOW
    window = np.where(long, place[word] // (WINDOW // 2), 0)
    feature = at[word, column]
    group = rows[word].astype(np.int64) << 32 | window
    before = long & (window > 0)
    group, feature = np.concatenate([group, group[before] - 1]), np.concatenate([feature, feature[before]])
    order = np.lexsort((feature, group))
    group, feature = group[order], feature[order]
    fresh = np.ones(len(group), bool)
    fresh[1:] = (np.diff(group) != 0) | (np.diff(feature) != 0)
    return group[fresh], feature[fresh]


@dataclass
class Model:
    """Template n-grams, weights (features x classes), bias, least probability, and the templates' features."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    least: float
    templates: np.ndarray
    family: np.ndarray

    def predict(self, group: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct groups and their class probabilities."""
        groups, inverse = np.unique(group, return_inverse=True)
        logits = np.stack([np.bincount(inverse, self.weights[feature, c], len(groups)) for c in range(len(FAMILIES))], 1) + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        return groups, p / p.sum(1, keepdims=True)


def variants(text: str) -> list[str]:
    """Wordings near a template: as it is, with a holder and a year, in upper case, and without one word."""
    words = text.split()
    out = [text, f"Copyright (c) 2021 Example. {text}", text.upper(), f"{text} See the file for details."]
    return out + [" ".join(words[:i] + words[i + 1 :]) for i in range(len(words)) if len(words) > 4]


def fit(unknown: list[str]) -> Model:
    """Train on varied templates against fixed and sampled unknown paragraphs; every fifth sampled one calibrates."""
    texts = [t for group in TEMPLATES.values() for t in group]
    family = np.array([i for i, group in enumerate(TEMPLATES.values()) for _ in group])
    of = lambda rows: textnp.buffers(pa.array(rows, pa.large_string()))
    vocabulary = np.unique(ngrams(*of(texts))[0])
    vocabulary = vocabulary[vocabulary != 0]

    def matrix(rows: list[str]) -> np.ndarray:
        grams, row, place = ngrams(*of(rows))
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        if len(row):
            group, feature = grouped_hits(vocabulary, grams, row, place, len(rows))
            x[group >> 32, feature] = 1
        return x

    templates = matrix(texts)
    sampled = matrix(unknown)
    if len(unknown):  # paragraphs that hold most of a template are licence text, whatever the sample says
        sampled = sampled[((sampled @ templates.T) / templates.sum(1)).max(1) < 0.5]
    held, used = sampled[::5], np.delete(sampled, np.arange(0, len(sampled), 5), 0)
    positive = [(i, v) for i, t in zip(family, texts) for v in variants(t)]
    x = np.concatenate([matrix([v for _, v in positive]), matrix(OTHERS), used])
    y = np.zeros((len(x), len(FAMILIES)), np.float32)
    y[np.arange(len(positive)), [i for i, _ in positive]] = 1
    y[len(positive) :, -1] = 1
    weight = np.ones(len(x), np.float32)
    weight[len(positive) :] = max(1.0, len(positive) / max(1, len(x) - len(positive)))
    weight /= weight.sum()
    w, b = np.zeros((len(vocabulary), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    speed = np.zeros_like(w)
    for _ in range(150):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (y - p / p.sum(1, keepdims=True)) * weight[:, None]
        slope = x.T @ g - 1e-5 * w
        speed += slope**2
        w += 0.3 * slope / (np.sqrt(speed) + 1e-6)
        b += 2.0 * g.sum(0)
    z = held @ w + b
    p = np.exp(z - z.max(1, keepdims=True))
    top = (p / p.sum(1, keepdims=True))[:, :-1].max(1) if len(held) else np.zeros(1)
    least = max(0.5, float(np.quantile(top, 1 - FALSE_RATE)))
    return Model(vocabulary, w, b, least, templates, family)


def train(docs: DataFrame) -> Model:
    """Fit to a bounded sample of the pieces of all texts.

    The pieces are counted first; the hash bound that leaves about twice ``SAMPLE`` of them follows from their number, so that
    only these are compared with each other and ordered.
    """
    lines = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line"))
    words = lines.select(words_of(F.col("line")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.size("w"), F.lit(WINDOW))
    pieces = words.select(F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, WINDOW), " "))).alias("p"))
    n = words.agg(F.sum(F.ceil(F.size("w") / WINDOW))).first()[0] or 0
    share = min(1.0, 2 * SAMPLE / max(n, 1))
    low = F.xxhash64("p").between(-(1 << 63), int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1)
    rows = pieces.filter(low).distinct().orderBy(F.xxhash64("p"), "p").limit(SAMPLE)
    return fit(sorted(r["p"] for r in rows.collect()))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Licence paragraphs of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = textnp.buffers(batch.column(1))
            for first, last in textnp.row_chunks(at):
                part, own = data[at[first] : at[last]], at[first : last + 1] - at[first]
                lines, row = lines_of(part, own)
                grams, word_row, place = ngrams(part, lines)
                filled = np.bincount(word_row, minlength=len(row)) > 0
                found: list[dict[tuple, dict]] = [{} for _ in range(last - first)]
                if len(word_row):
                    group, feature = grouped_hits(model.vocabulary, grams, word_row, place, len(row))
                    for g, p, hits in _predicted(model, group, feature):
                        line = g >> 32
                        c = int(p[:-1].argmax())
                        share = (model.templates[:, hits].sum(1) / model.templates.sum(1))[model.family == c].max()
                        one = {
                            "line": int(line - np.searchsorted(row, row[line])), "family": FAMILIES[c], "probability": float(p[c]),
                            "similarity": float(share), "confirmed": bool(share >= SIMILAR),
                        }
                        # Overlapping windows of one line may find the same text: the most similar one counts.
                        best = found[row[line]].setdefault((one["line"], one["family"]), one)
                        if one["similarity"] > best["similarity"]:
                            found[row[line]][one["line"], one["family"]] = one
                    for first_line, last_line, c, probability, share in _wrapped(model, part, lines, row, filled, word_row):
                        r, top = row[first_line], int(np.searchsorted(row, row[first_line]))
                        inside = [k for k in found[r] if k[1] == FAMILIES[c] and first_line <= k[0] + top <= last_line]
                        if any(found[r][k]["similarity"] >= share for k in inside):
                            continue
                        for k in inside:
                            del found[r][k]
                        found[r][first_line - top, FAMILIES[c]] = {
                            "line": first_line - top, "family": FAMILIES[c], "probability": probability, "similarity": share, "confirmed": share >= SIMILAR,
                        }
                found = [sorted(x.values(), key=lambda one: one["line"]) for x in found]
                n = np.bincount(row[filled], minlength=last - first).astype(np.int64)
                kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n), pa.array(found, kind)], names=["doc_id", "n_paragraphs", "licenses"]
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, OUTPUT)


def _wrapped(
    model: Model, data: np.ndarray, lines: np.ndarray, row: np.ndarray, filled: np.ndarray, word_line: np.ndarray
) -> list[tuple[int, int, int, float, float]]:
    """Hits in runs of two or more lines with words: first and last line, family, probability, similarity."""
    fresh = np.ones(len(row), bool)
    fresh[1:] = ~(filled[1:] & filled[:-1] & (row[1:] == row[:-1]))
    grams, run, place = ngrams(data, np.append(lines[:-1][fresh], lines[-1]))
    n_runs = int(fresh.sum())
    group, feature = grouped_hits(model.vocabulary, grams, run, place, n_runs)
    several = np.bincount(np.cumsum(fresh) - 1, minlength=n_runs)[group >> 32] > 1
    counts = np.bincount(run, minlength=n_runs)
    heads = np.cumsum(counts) - counts
    hits: list[tuple[int, int, int, float, float]] = []
    latest: dict[int, int] = {}
    for g, p, features in _predicted(model, group[several], feature[several]):
        c, own = int(p[:-1].argmax()), g >> 32
        shares = np.where(model.family == c, model.templates[:, features].sum(1) / model.templates.sum(1), -1)
        best = int(shares.argmax())
        a = heads[own] + (g & 0xFFFFFFFF) * (WINDOW // 2)
        words = grams[a : min(a + WINDOW, heads[own] + counts[own])]
        at = np.minimum(np.searchsorted(model.vocabulary, words), len(model.vocabulary) - 1)
        seen = (model.vocabulary[at] == words) & (words != 0) & (model.templates[best][at] > 0)
        # The longest sequences found tell where the notice is; single words occur anywhere.
        size = int(np.flatnonzero(seen.any(0)).max())
        where = np.flatnonzero(seen[:, size])
        one = (int(a + where[0]), int(min(a + where[-1] + size, heads[own] + counts[own] - 1)), c, float(p[c]), float(shares[best]))
        # A window overlaps the one before it, which may have seen the same words: the more similar hit counts.
        before = hits[latest[c]] if c in latest else None
        if before and before[0] <= one[1] and one[0] <= before[1]:
            if before[4] < one[4]:
                hits[latest[c]] = one
            continue
        latest[c] = len(hits)
        hits.append(one)
    return [(int(word_line[a]), int(word_line[b]), c, p, share) for a, b, c, p, share in hits]


def _predicted(model: Model, group: np.ndarray, feature: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if not len(group):
        return
    groups, p = model.predict(group, feature)
    for i in np.flatnonzero(p[:, :-1].max(1) >= model.least):
        a, b = np.searchsorted(group, groups[i]), np.searchsorted(group, groups[i], "right")
        yield int(groups[i]), p[i], feature[a:b]


@query()
def op6_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = scan(docs, train(docs))
    sure = F.filter("licenses", lambda x: x["confirmed"])
    names = F.array_join(F.sort_array(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",")
    return out.select("doc_id", "n_paragraphs", F.size(sure).cast("long").alias("n_confirmed"), names.alias("families"), "licenses")
