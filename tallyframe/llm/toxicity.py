"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given per document, so tokens are labelled first: a token of a toxic document is toxic if one of its features
(the word, its first 4, 5 or 6 bytes) is far more frequent in toxic than in other documents. The chain is trained on
these tokens, its forward-backward marginals tag every token of every text, and a logistic function of the expected and
the largest marginal gives the document's score.

Training uses at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents of at most ``MAX_BYTES`` bytes, chosen by a hash
of their id; scoring always covers whole texts. Nothing but the text enters a score.

Defined cases: null or empty texts get the score of a text without toxic tokens. Without labels of both classes every
score is the share of toxic labels (0 without any). Null labels are ignored; repeated rows are scored alike; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm import textnp
from tallyframe.llm.registry import query
from tallyframe.llm.shared import table

MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 2000, 3000, 8_000
PREFIXES = (4, 5, 6)
#: A feature marks tokens if it is this many times likelier in toxic documents, at this log-likelihood ratio.
MIN_RATIO, MIN_EVIDENCE = 4.0, 10.0
#: Features with less evidence either way get no weight.
USE_EVIDENCE = 4.0
VOCABULARY = 40_000
BUCKETS = 1 << 22
ROUNDS = 20
BLOCK = 64
FAINT = 0.1
THRESHOLD = 0.3
OUTPUT = "doc_id long, score double, n_toxic_tokens long, spans array<struct<start:long,end:long>>"


def token_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature hashes (tokens x features); 0 where a word is shorter than a prefix."""
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = textnp.word_hashes(data, starts, ends)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    head = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))[starts]).view(np.uint64).ravel()
    for k, p in enumerate(PREFIXES, 1):
        mask = np.uint64((1 << 8 * p) - 1)
        out[:, k] = np.where(ends - starts >= p, textnp.mix((head & mask) * textnp.BASE + np.uint64(p)), np.uint64(0))
    return out


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, token offsets per row, and features of lower-cased runs of letters and digits."""
    starts, ends, rows = textnp.word_bounds(data, at, textnp.IS_MARK)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(at) - 1))])
    return starts, ends, bounds, token_features(textnp.LOWER[data], starts, ends)


class Chain:
    """Forward-backward over many documents at once.

    Documents are cut into blocks of tokens. Products of transition matrices over whole blocks carry the messages from
    block to block, so the chain is exact over the whole text and the loops are as long as a block and the largest
    number of blocks.
    """

    def __init__(self, odds: np.ndarray, bounds: np.ndarray, trans: np.ndarray):
        counts = np.diff(bounds)
        blocks = -(-counts // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        n = int(self.first[-1])
        doc = np.repeat(np.arange(len(counts)), blocks)
        start = bounds[doc] + (np.arange(n) - self.first[doc]) * BLOCK
        self.size = np.minimum(bounds[doc + 1] - start, BLOCK)
        at = start[:, None] + np.arange(BLOCK)
        self.valid = np.arange(BLOCK) < self.size[:, None]
        self.at = np.where(self.valid, at, 0)
        self.odds = np.where(self.valid, odds[self.at] if len(odds) else 1.0, 1.0)
        self.t, self.blocks, self.n = trans, blocks, n
        self._forward_backward()

    def _forward_backward(self) -> None:
        t, n = self.t, self.n
        prod = np.zeros((n, 2, 2))
        prod[:, 0, 0] = prod[:, 1, 1] = 1
        for k in range(BLOCK):
            live = self.valid[:, k]
            step = prod @ t
            step[:, :, 1] *= self.odds[:, k, None]
            step /= step.sum((1, 2), keepdims=True)
            prod = np.where(live[:, None, None], step, prod)
        enter, leave = np.zeros((n, 2)), np.ones((n, 2))
        a = np.tile([1.0, 0.0], (len(self.blocks), 1))
        for j in range(int(self.blocks.max(initial=0))):
            docs = np.flatnonzero(self.blocks > j)
            b = self.first[docs] + j
            enter[b] = a[docs]
            a[docs] = np.einsum("ni,nij->nj", a[docs], prod[b])
            a[docs] /= a[docs].sum(1, keepdims=True)
        z = np.ones((len(self.blocks), 2))
        for j in range(int(self.blocks.max(initial=0)) - 1, -1, -1):
            docs = np.flatnonzero(self.blocks > j)
            b = self.first[docs] + j
            leave[b] = z[docs]
            z[docs] = np.einsum("nij,nj->ni", prod[b], z[docs])
            z[docs] /= z[docs].sum(1, keepdims=True)
        alpha = np.zeros((n, BLOCK, 2))
        a = enter
        for k in range(BLOCK):
            step = a @ t
            step[:, 1] *= self.odds[:, k]
            step /= step.sum(1, keepdims=True)
            a = np.where(self.valid[:, k, None], step, a)
            alpha[:, k] = a
        beta = np.ones((n, BLOCK, 2))
        z = leave
        for k in range(BLOCK - 1, -1, -1):
            beta[:, k] = z
            step = z.copy()
            step[:, 1] *= self.odds[:, k]
            step = step @ t.T
            step /= step.sum(1, keepdims=True)
            z = np.where(self.valid[:, k, None], step, z)
        self.alpha, self.beta, self.enter = alpha, beta, enter

    def marginals(self, n_tokens: int) -> np.ndarray:
        both = self.alpha * self.beta
        out = np.zeros(n_tokens)
        out[self.at[self.valid]] = (both[..., 1] / both.sum(2))[self.valid]
        return out

    def expected_pairs(self) -> np.ndarray:
        before = np.concatenate([self.enter[:, None], self.alpha[:, :-1]], 1)
        after = self.beta.copy()
        after[..., 1] *= self.odds
        pair = before[..., :, None] * self.t * after[..., None, :]
        return (pair / pair.sum((2, 3), keepdims=True))[self.valid].sum(0)


@dataclass
class Model:
    """Sorted feature hashes with their weights, the bias, the transition weights and the calibration."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    scale: np.ndarray
    rate: float

    def emissions(self, found: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.weights[found].sum(1) + self.bias, -30, 30))

    def known(self, features: np.ndarray) -> np.ndarray:
        """Place of each feature among the weights; the last place has weight 0."""
        at = np.searchsorted(self.features, features)
        at[at == len(self.features)] = 0
        none = len(self.features)
        return np.where(self.features[at] == features, at, none) if none else np.zeros_like(at)

    def document_scores(self, marginals: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.full(len(bounds) - 1, self.rate)
        x = summary(marginals, bounds)
        return 1 / (1 + np.exp(-np.clip(x @ self.scale, -30, 30)))


def summary(marginals: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document: 1, log of the expected number of toxic tokens (faint marginals of long texts left out), largest marginal."""
    total = np.concatenate([[0.0], np.cumsum(np.where(marginals >= FAINT, marginals, 0.0))])
    full = np.flatnonzero(np.diff(bounds))
    top = np.zeros(len(bounds) - 1)
    if len(full):
        top[full] = np.maximum.reduceat(marginals, bounds[:-1][full])
    return np.stack([np.ones(len(top)), np.log1p(np.maximum(total[bounds[1:]] - total[bounds[:-1]], 0)), top], 1)


def one_per_family(texts: list[str]) -> list[int]:
    """Places of the texts that share none of three minima with an earlier one: copies must not count as evidence."""
    seen, out, factors = set(), [], np.array([7, 155, 2469], np.uint64) * textnp.BASE
    for first, _, values, at in textnp.shingle_sets(pa.array(texts, pa.large_string())):
        for i in range(len(at) - 1):
            own = values[at[i] : at[i + 1]]
            keys = [(k, int((textnp.mix(own) * f).min())) for k, f in enumerate(factors)] if len(own) else [(-1, 0)]
            if not seen.intersection(keys):
                out.append(first + i)
            seen.update(keys)
    return out


def token_chunks(texts: list[str], rows: int = 250) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, token features and token offsets of some rows at a time."""
    for first in range(0, len(texts), rows):
        _, _, bounds, features = tokens(*textnp.buffers(pa.array(texts[first : first + rows], pa.large_string())))
        yield first, features, bounds


def document_counts(texts: list[str], toxic: np.ndarray, key, size: int) -> np.ndarray:
    """Number of clean and toxic documents (2 x size) that hold each key; ``key`` maps features to 0 .. size - 1 or -1."""
    out = np.zeros((2, size), np.int32)
    for first, features, bounds in token_chunks(texts):
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        keys = key(features)
        pair = np.unique((keys + row[:, None] * size)[(keys >= 0) & (features != 0)])
        for y in (0, 1):
            own = pair[toxic[first + pair // size] == y] % size
            np.add.at(out[y], own, 1)
    return out


def support(documents: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio and ratio of rates of features counted in clean and toxic documents."""
    n = [int((toxic == y).sum()) for y in (0, 1)]
    ratio = ((documents[1] + 0.5) / (n[1] + 1)) / ((documents[0] + 0.5) / (n[0] + 1))
    seen, prior = documents.sum(0), n[1] / (n[0] + n[1])
    share = np.clip(documents[1] / np.maximum(seen, 1), 1e-12, 1 - 1e-12)
    return seen * (share * np.log(share / prior) + (1 - share) * np.log((1 - share) / (1 - prior))), ratio


def supported_features(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features with evidence either way, and their document counts.

    Hash buckets are counted first, so the many rare features need no table of their own; features in buckets with
    evidence are then counted exactly.
    """
    buckets = document_counts(texts, toxic, lambda f: (f & np.uint64(BUCKETS - 1)).astype(np.int64), BUCKETS)
    open_ = support(buckets, toxic)[0] >= USE_EVIDENCE
    some = [np.unique(f[open_[(f & np.uint64(BUCKETS - 1)).astype(np.int64)]]) for _, f, _ in token_chunks(texts)]
    hashes = np.unique(np.concatenate(some))
    hashes = hashes[hashes != 0]

    def place(f: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(hashes, f), max(len(hashes) - 1, 0))
        return np.where(hashes[at] == f, at, -1) if len(hashes) else np.full(f.shape, -1)

    documents = document_counts(texts, toxic, place, max(len(hashes), 1))[:, : len(hashes)]
    evidence = support(documents, toxic)[0]
    use = np.flatnonzero(evidence >= USE_EVIDENCE)
    use = np.sort(use[np.argsort(-evidence[use], kind="stable")[:VOCABULARY]])
    return hashes[use], documents[:, use]


def fit(texts: list[str], toxic: np.ndarray, shares: tuple[float, float]) -> Model:
    """Train on a bounded sample; ``shares`` are the numbers of (clean, toxic) documents that it stands for."""
    rate = shares[1] / max(sum(shares), 1)
    none = Model(np.zeros(0, np.uint64), np.zeros(1), 0.0, np.ones((2, 2)), np.zeros(3), rate)
    if not 0 < toxic.sum() < len(toxic):
        return none
    alone = one_per_family(texts)
    texts, toxic = [texts[i] for i in alone], toxic[alone]
    if not 0 < toxic.sum() < len(toxic):
        return none
    chosen, documents = supported_features(texts, toxic)
    evidence, ratio = support(documents, toxic)
    marks = (evidence >= MIN_EVIDENCE) & (ratio >= MIN_RATIO)
    if not marks.any():
        return none
    model = Model(chosen, np.zeros(len(chosen) + 1), 0.0, np.ones((2, 2)), np.zeros(3), rate)
    found, bounds = [], [np.zeros(1, np.int64)]
    for _, features, own in token_chunks(texts):
        found.append(model.known(features).astype(np.int32))
        bounds.append(own[1:] + bounds[-1][-1])
    found, bounds = np.concatenate(found), np.concatenate(bounds)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))
    label = np.append(marks, False)[found].any(1) & (toxic[row] == 1)
    if not label.any():
        return none
    model.bias = float(np.log(label.mean()))
    n = [int((toxic == y).sum()) for y in (0, 1)]
    counts = np.zeros((2, 2))
    before = np.concatenate([[0], label[:-1].astype(int)])
    before[bounds[:-1][np.diff(bounds) > 0]] = 0
    np.add.at(counts, (before, label.astype(int)), 1)
    theta, target = np.zeros((2, 2)), counts
    speed = [np.full(len(chosen) + 1, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    parts = np.unique(np.append(np.searchsorted(bounds[:-1], np.arange(0, len(row), 200_000)), len(texts)))
    parts[0] = 0
    for _ in range(ROUNDS):
        slope, pairs = np.zeros(len(chosen) + 1), np.zeros((2, 2))
        for a, b in zip(parts[:-1], parts[1:]):
            lo, hi = bounds[a], bounds[b]
            chain = Chain(model.emissions(found[lo:hi]), bounds[a : b + 1] - lo, model.trans)
            rest = label[lo:hi] - chain.marginals(hi - lo)
            for k in range(found.shape[1]):
                slope += np.bincount(found[lo:hi, k], rest, len(chosen) + 1)
            pairs += chain.expected_pairs()
        slope[-1] = 0
        slope -= 1e-2 * model.weights
        speed[0] += slope**2
        model.weights = model.weights + 1.5 * slope / np.sqrt(speed[0])
        slope = target - pairs
        speed[2] += slope**2
        theta = theta + 0.2 * slope / np.sqrt(speed[2])
        model.trans = np.exp(theta)
    marginals = np.zeros(len(row))
    for a, b in zip(parts[:-1], parts[1:]):
        lo, hi = bounds[a], bounds[b]
        marginals[lo:hi] = Chain(model.emissions(found[lo:hi]), bounds[a : b + 1] - lo, model.trans).marginals(hi - lo)
    x, weight = summary(marginals, bounds), np.where(toxic == 1, shares[1] / n[1], shares[0] / n[0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ model.scale, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(3)
        model.scale = model.scale + np.linalg.solve(hess, x.T @ (weight * (toxic - p)) - model.scale)
    keep = np.flatnonzero(np.abs(model.weights[:-1]) > 1e-3)
    model.features, model.weights = model.features[keep], np.append(model.weights[keep], 0.0)
    return model


def held_out(doc_id) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit a model to the labelled documents outside the held-out quarter."""
    own = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.octet_length("text").between(1, MAX_BYTES))
    sample = None
    for y, most in ((0, MAX_CLEAN), (1, MAX_TOXIC)):
        # Some of the chosen ids have long texts or none; twice the number is drawn and the first ones are kept.
        ids = own.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)
        rows = texts.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("text", "toxic").distinct()
        sample = rows if sample is None else sample.union(rows)
    counts = (shares.get(0, 0), shares.get(1, 0))

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        model = fit([text for text, _ in rows], np.array([y for _, y in rows], np.int64), counts)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model))], pa.binary())], ["model"])

    # The sample is bounded; one task fits it, and the driver sees the finished weights alone.
    one = sample.repartition(1).sortWithinPartitions("toxic", F.xxhash64("text"), "text").mapInArrow(in_task, "model binary").collect()
    return Model(**pickle.loads(one[0]["model"])) if one else fit([], np.zeros(0, np.int64), counts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, number of toxic tokens and their offsets (code points, neighbours joined)."""

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = textnp.buffers(batch.column(1))
            for first, last in textnp.row_chunks(at):
                part, own = data[at[first] : at[last]], at[first : last + 1] - at[first]
                starts, ends, bounds, features = tokens(part, own)
                odds = model.emissions(model.known(features))
                p = Chain(odds, bounds, model.trans).marginals(len(starts)) if len(model.features) else np.zeros(len(starts))
                hit = p >= 0.5
                point = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                where = np.flatnonzero(hit)
                row = np.searchsorted(bounds, where, "right") - 1
                fresh = np.ones(len(where), bool)
                fresh[1:] = (where[1:] != where[:-1] + 1) | (row[1:] != row[:-1])
                heads = np.flatnonzero(fresh)
                tails = np.append(heads[1:], len(where)) - 1 if len(where) else heads
                begin = point[starts[where[heads]]] - point[own[row[heads]]]
                end = point[ends[where[tails]]] - point[own[row[heads]]]
                per_row = np.bincount(row[heads], minlength=last - first)
                spans = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64))], ["start", "end"]),
                )
                n_hits = np.bincount(row, minlength=last - first).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(model.document_scores(p, bounds)), pa.array(n_hits), spans],
                    names=["doc_id", "score", "n_toxic_tokens", "spans"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tag, OUTPUT)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = textnp.buffers(batch.column(place))
            for first, last in textnp.row_chunks(at):
                starts, _, bounds, features = tokens(data[at[first] : at[last]], at[first : last + 1] - at[first])
                p = Chain(model.emissions(model.known(features)), bounds, model.trans).marginals(len(starts)) if len(model.features) else np.zeros(len(starts))
                yield batch.slice(first, last - first).filter(pa.array(model.document_scores(p, bounds) < threshold))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that is trained on the labelled ones."""
    out = score(docs, train(docs, labels))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@query()
def op5_toxicity(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_toxic_tokens", "spans")
