"""Pattern packing of token pieces into sequences of fixed capacity.

1. Texts become token ids inside tasks; only documents longer than the capacity are cut. Pieces are written once.
2. The histogram of piece lengths (at most ``CAPACITY`` rows) goes to the driver. Patterns of two to five length classes
   that fill a sequence are enumerated, their repeat counts fitted to the histogram by non-negative least squares, and
   rounded. Each pattern is realised with real lengths, its last slot by the best-fitting one.
3. What is left is packed best-fit decreasing into the gaps and into new sequences, many equal pieces at a time.
4. The plan is a list of runs (length, first rank, count, first sequence, offset). Its size depends on the capacity, not
   on the number of pieces. Each piece gets a rank among the pieces of its length, counted in salted groups, and looks
   up its place.

Defined cases: null and empty texts are the end id alone. Repeated rows are packed row by row. An empty table gives an
empty result; extra columns are ignored. Ranks among equal rows are interchangeable.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.llm import textnp
from tallyframe.llm.registry import query
from tallyframe.llm.shared import table, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CLASSES = 64
DEPTH = 5
SALTS = 256
#: Units whose ids a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_PUNCT = np.array([chr(b) in '.,!?;:()"' for b in range(256)])


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of words, cut again between ASCII letters or digits and plain punctuation.

    The tokenizer's own pattern always parts there (apostrophes, which it may join to letters, are no such mark), and it
    never joins ids over white space, so the ids of a text are those of its units.
    """
    starts, ends, _ = textnp.word_bounds(data, at)
    cut = np.zeros(len(data), bool)
    cut[1:] = (_ALNUM[data[:-1]] & _PUNCT[data[1:]]) | (_PUNCT[data[:-1]] & _ALNUM[data[1:]])
    first, last = cut.copy(), np.append(cut, False)
    first[starts], last[ends] = True, True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last), np.searchsorted(at, starts, "right") - 1


class UnitIds:
    """Ids of units; a unit that came before is not tokenized again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the tokenizer takes as one id wherever they stand.
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        #: Sorted hashes of the units and their numbers: arrays, since a dictionary of so many is ten times as large.
        self.keys = np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def rows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, joined, and the number of ids of each row.

        A row that holds an added token is encoded as a whole, because the tokenizer cuts there before it looks at words.
        """
        raw, data = data, textnp.LOWER[data]  # the tokenizer lower-cases, too
        text = data.tobytes()
        whole = [r for r in range(len(at) - 1) if any(x in text[at[r] : at[r + 1]] for x in self.added)] if any(x in text for x in self.added) else []
        ids, count = self._unit_rows(data, at)
        if whole:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for r in whole:
                parts[r] = np.array(self.tokenizer.encode(raw[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            ids, count = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, count

    def _unit_rows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, rows = units(data, at)
        hashes, back = np.unique(textnp.word_hashes(data, starts, ends), return_inverse=True)
        if len(self.keys) + len(hashes) > REMEMBERED:
            self.forget()
        spot = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inside = np.flatnonzero(spot < len(self.keys))
        known[inside] = self.keys[spot[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            some = np.empty(len(hashes), np.int64)
            some[back] = np.arange(len(back))
            text, some = data.tobytes(), some[new]
            words = [text[a:b].decode("utf-8", "replace") for a, b in zip(starts[some].tolist(), ends[some].tolist())]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            numbers = np.arange(len(self.keys), len(self.keys) + len(new))
            self.keys, self.places = np.insert(self.keys, spot[new], hashes[new]), np.insert(self.places, spot[new], numbers)
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in found])])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32)])
            spot = np.searchsorted(self.keys, hashes)
        own = self.places[spot][back]
        length = self.at[own + 1] - self.at[own]
        before = np.cumsum(length) - length
        take = np.repeat(self.at[own] - before, length) + np.arange(length.sum())
        return self.ids[take], np.bincount(rows, length, len(at) - 1).astype(np.int64)


def tokenizer_path(name: str) -> str:
    """A file path as it is, or the place of a public tokenizer on this machine."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def unit_ids(path: str) -> UnitIds:
    """One memory per Python worker, which Spark uses for many tasks."""
    return UnitIds(path)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every document, in order."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids = unit_ids(tokenizer_path(tokenizer))
        for batch in batches:
            data, at = textnp.buffers(batch.column(1))
            for first, last in textnp.row_chunks(at):
                own = at[first : last + 1] - at[first]
                ids, counts = own_ids.rows(data[at[first] : at[last]], own)
                ends = np.cumsum(counts)
                out = []
                for i, doc in enumerate(batch.column(0).slice(first, last - first).to_pylist()):
                    row = np.append(ids[ends[i] - counts[i] : ends[i]], np.uint32(END_ID)).astype("<u4")
                    for p, s in enumerate(range(0, len(row), capacity)):
                        part = row[s : s + capacity]
                        out.append((doc, p, s, len(part), zlib.crc32(part.tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut_up, PIECES)


def patterns(classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Class lists (largest first) of two to ``depth`` pieces that fill a sequence on average."""
    out = []

    def extend(head: tuple[int, ...], left: int, slots: int) -> None:
        top = head[-1] if head else classes - 1
        if slots == 1:
            if 0 <= left <= top:
                out.append((*head, left))
            return
        for c in range(min(top, left), -1, -1):
            if c * slots < left:
                break
            extend((*head, c), left - c, slots - 1)

    for d in range(2, depth + 1):
        extend((), int(classes - 0.508 * d), d)
    return out


def fit_counts(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """min ||a x - h|| over x >= 0, by an active set: at most as many patterns as classes are in use."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * a.shape[0]):
        slope = a.T @ (h - a @ x)
        slope[used] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-6 * max(1.0, np.abs(h).max()):
            break
        used[best] = True
        while True:
            own = np.flatnonzero(used)
            z = np.linalg.lstsq(a[:, own], h, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[own] = z
                break
            bad = z <= 0
            step = np.min(x[own][bad] / np.maximum(x[own][bad] - z[bad], 1e-12))
            x[own] += step * (z - x[own])
            used[own[x[own] <= 1e-9]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece, and the number of sequences."""
    left = {n: c for n, c in histogram.items() if c > 0}
    rank: Counter = Counter()
    runs: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    sequences = 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, rank[length], count, sequence, offset))
        rank[length] += count
        left[length] -= count

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in groups:
                insort(gaps, gap)
            groups.setdefault(gap, []).append((sequence, count))

    def fill(lengths: list[int], count: int) -> None:
        nonlocal sequences
        offset = 0
        for n in lengths:
            place(n, count, sequences, offset)
            offset += n
        leave(capacity - offset, sequences, count)
        sequences += count

    if left.get(capacity):
        fill([capacity], left[capacity])
    width = max(1, -(-capacity // CLASSES))
    members: list[list[int]] = [[] for _ in range(CLASSES)]
    for n in sorted(left):
        if left[n]:
            members[min((n - 1) // width, CLASSES - 1)].append(n)
    h = np.array([float(sum(left[n] for n in m)) for m in members])
    choice = patterns()
    if h.sum() and capacity >= 2 * CLASSES:
        a = np.zeros((CLASSES, len(choice)))
        for j, p in enumerate(choice):
            for c in p:
                a[c, j] += 1
        x = fit_counts(a, h)
        alive = sorted(n for n in left if left[n])
        for j in np.argsort(-x):
            want = int(x[j])
            while want > 0:
                lengths: list[int] = []
                for c in choice[j][:-1]:
                    free = next((n for n in reversed(members[c]) if left[n] > lengths.count(n)), None)
                    if free is None:
                        break
                    lengths.append(free)
                if len(lengths) < len(choice[j]) - 1:
                    break
                rest = capacity - sum(lengths)
                at = bisect_right(alive, rest) - 1
                while at >= 0 and left[alive[at]] <= lengths.count(alive[at]):
                    at -= 1
                if at < 0 or rest - alive[at] > width:
                    break
                lengths.append(alive[at])
                count = min([want, *(left[n] // lengths.count(n) for n in lengths)])
                fill(lengths, count)
                want -= count
                for n in set(lengths):
                    if not left[n]:
                        alive.pop(bisect_left(alive, n))
                        members[min((n - 1) // width, CLASSES - 1)].remove(n)
    for n in sorted(left, reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at < len(gaps):
                gap = gaps[at]
                sequence, free = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap]
                    gaps.pop(at)
                count = min(left[n], free)
                place(n, count, sequence, capacity - gap)
                leave(gap - n, sequence, count)
                leave(gap, sequence + count, free - count)
            else:
                each = capacity // n
                whole = left[n] // each
                fill([n] * (each if whole else left[n]), whole or 1)
    return runs, sequences


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its place in there."""
    cut_up = written(pieces(docs, tokenizer, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}
    runs, _ = plan(histogram, capacity)
    runs.sort()
    key = np.array([r[0] << 40 | r[1] for r in runs], np.int64)
    first, sequence, offset = (np.array([r[k] for r in runs], np.int64) for k in (1, 3, 4))

    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("n", F.row_number().over(order)).join(base, ["length", "salt"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("n") - 1).cast("long").alias("rank")
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(key, length << 40 | rank, "right") - 1
            places = [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *places], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return ranked.mapInArrow(look_up, PIECES + ", sequence_id long, offset long")


@query()
def op2_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
