"""Phrase collocations by relational mining (SETM).

The occurrence relation of phrases of ``k`` words holds (row, position, phrase), sorted by row and position, and is
persisted for every length. Positions leave a gap between two pieces of a text, so "same piece, next word" is "position
plus one". Each step merge-joins the relation with itself at the next position, which yields occurrences of ``k + 1``
words; counts them per group; and semi-joins the frequent groups back before the next length. The relation is stored
clustered, one row per text with its sorted positions and phrases, so the merge join needs no exchange; only counts that
were summed in the task travel.

Frequent phrases of a length are numbered without gaps. A task finds a word's number by a hash of 64 bits, which is exact all
the same: two words of one hash start anew with other hashes, and a longer phrase is looked up by a hash of its two parts and
then compared by the parts. Frequent groups are sent to the tasks while they measure less than ``GROUP_BYTES``; beyond it
occurrences meet them in a shuffled join and the relation is gathered again by row.

Defined cases: null text is empty, a null language is ``und``. Empty and very long texts count like any other (a text is one
row of the relation). Repeated rows count once each. Equal scores are ordered by count, then by the phrase's bytes. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.llm.registry import query
from tallyframe.llm.shared import table, text_of, written
from tallyframe.llm.textnp import BASE, LOWER, buffers, mix, row_chunks, word_bounds, word_hashes
from tallyframe.operators.ordering import dense_index

# Bytes that end a piece, and those that only end a word.
PIECE_END = np.zeros(256, bool)
PIECE_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD_END = PIECE_END.copy()
WORD_END[[ord(" "), ord("\t")]] = True
MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Frequent groups are sent to the tasks up to this measured size; above it they are joined by a shuffle.
GROUP_BYTES = 48 << 20

#: Occurrences of the relation that one numpy pass works on; a longer text is one pass of its own.
ENTRIES = 500_000

WORDS = "lang string, word string, id long, n long"
RELATION = "row long, pos array<int>, id array<long>"
PAIRS = "a long, b long, n long"


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the phrase that begins with phrase ``a`` and ends with phrase ``b``, which overlaps it or follows it."""
    return signed(mix((mix(a.view(np.uint64)) + b.view(np.uint64)) * BASE))


def occurrences(texts: pa.Array, langs: pa.Array, seed: int) -> Iterator[tuple]:
    """Per range of rows: first row, last row, bytes, word starts, ends, rows, positions and word numbers."""
    data, at = buffers(texts)
    lang_data, lang_at = buffers(langs)
    lang_ids = word_hashes(lang_data, lang_at[:-1], lang_at[1:])
    for first, last in row_chunks(at):
        part, own = LOWER[data[at[first] : at[last]]], at[first : last + 1] - at[first]
        starts, ends, rows = word_bounds(part, own, WORD_END)
        piece = np.concatenate([[0], np.cumsum(PIECE_END[part])])
        count = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=last - first))])
        pos = np.arange(len(starts)) - count[rows] + piece[starts] - piece[own[rows]]
        ids = mix((word_hashes(part ^ np.uint8(seed), starts, ends) + mix(lang_ids[first + rows])) * BASE)
        yield first, last, part, starts, ends, rows, pos, signed(ids)


def cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings between starts and ends."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    where = np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])
    values = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[where])]
    return pa.Array.from_buffers(pa.large_string(), len(starts), values).cast(pa.string())


def same_words(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the words at ``a`` and ``b``, both of ``length`` bytes, are equal; eight bytes at a time."""
    wide = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]), (len(data) + 1, 8), (1, 1))
    out, live, step = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        x, y = (np.ascontiguousarray(wide[s[live] + 8 * step]).view(np.uint64).ravel() for s in (a, b))
        left = np.minimum(length[live] - 8 * step, 8).astype(np.uint64)
        out[live] &= ((x ^ y) << ((np.uint64(8) - left) * np.uint64(8) % np.uint64(64))) * (left > 0) == 0
        live = live[length[live] > 8 * (step + 1)]
        step += 1
    return out


def counted(batches, seed: int) -> Iterator[pa.RecordBatch]:
    """(lang, word, id, n) per range of rows."""
    for batch in batches:
        langs = batch.column("lang")
        codes = langs.dictionary_encode().indices.to_numpy()
        for first, _, data, starts, ends, rows, _, ids in occurrences(batch.column("t"), langs, seed):
            _, at, of, n = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
            if not len(at):
                continue
            # Another word under the same number is a row of its own, so that the clash is seen.
            own, lang = at[of], codes[first + rows]
            equal = (ends - starts == ends[own] - starts[own]) & (lang == lang[own])
            equal[equal] = same_words(data, starts[equal], starts[own[equal]], (ends - starts)[equal])
            other = np.flatnonzero(~equal)
            n -= np.bincount(of[other], minlength=len(n))
            at, n = np.concatenate([at, other]), np.concatenate([n, np.ones(len(other), n.dtype)])
            columns = [langs.take(pa.array(first + rows[at])), cut_out(data, starts[at], ends[at]), pa.array(ids[at]), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "id", "n"])


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, id, n) of every word."""
    return docs.mapInArrow(lambda batches: counted(batches, seed), WORDS).groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def number_words(docs: DataFrame, min_count: int) -> tuple[DataFrame, int]:
    """Written counts of all words under hashes that no two words share, and the seed of these hashes; rare words lose their text."""
    for seed in range(256):
        words = word_counts(docs, seed).withColumn("word", F.when(F.col("n") >= min_count, F.col("word")))
        words = written(words, "words")
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("two words share a hash under every seed")


class Groups:
    """Frequent groups (id, a, b) in tasks: sorted hashes of (a, b), looked up and then compared by both parts."""

    def __init__(self, frequent: DataFrame):
        rows = frequent.select("id", "a", "b").toArrow()
        id_, a, b = (rows.column(c).to_numpy() for c in ("id", "a", "b"))
        hashes = pair_hashes(a, b)
        order = np.argsort(hashes)
        self.hash, self.a, self.b, self.id = hashes[order], a[order], b[order], id_[order]
        if (self.hash[1:] == self.hash[:-1]).any():
            raise RuntimeError("two frequent phrases share a hash")

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the occurrences that belong to a frequent group, and the groups' numbers."""
        if not len(self.id):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = pair_hashes(a, b)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.id) - 1)
        hit = np.flatnonzero((self.hash[at] == hashes) & (self.a[at] == a) & (self.b[at] == b))
        return hit, self.id[at[hit]]


def is_small(frequent: DataFrame, limit: int) -> bool:
    return 24 * frequent.count() <= limit


def clustered(row: np.ndarray, at: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Relation rows from flat sorted occurrences; ``at`` is the index into ``row`` of each. Rows without any are left out."""
    n = np.bincount(at, minlength=len(row))
    live = np.flatnonzero(n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(n[live])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pos.astype(np.int32), ids)]
    return pa.RecordBatch.from_arrays([pa.array(row[live]), *lists], ["row", "pos", "id"])


def gathered(flat: DataFrame, frequent: DataFrame) -> DataFrame:
    """The relation by a shuffled semi-join: occurrences (row, pos, a, b) meet the groups and return to their row."""
    kept = flat.join(frequent.select("a", "b", "id"), ["a", "b"])
    rows = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("o"))
    return rows.select("row", F.col("o.pos").alias("pos"), F.col("o.id").alias("id"))


def word_relation(docs: DataFrame, frequent: DataFrame, seed: int, limit: int) -> DataFrame:
    """Occurrences of frequent words."""
    groups = docs.sparkSession.sparkContext.broadcast(Groups(frequent)) if is_small(frequent, limit) else None

    def found(batches):
        for batch in batches:
            row = batch.column("row").to_numpy()
            for first, last, _, _, _, rows, pos, ids in occurrences(batch.column("t"), batch.column("lang"), seed):
                if groups is None:
                    yield pa.RecordBatch.from_arrays([pa.array(row[first + rows]), pa.array(pos.astype(np.int32)), pa.array(ids), pa.array(ids)], ["row", "pos", "a", "b"])
                else:
                    keep, own = groups.value.find(ids, ids)
                    yield clustered(row[first:last], rows[keep], pos[keep], own)

    rows = docs.withColumn("row", F.monotonically_increasing_id())
    if groups is None:
        return gathered(rows.mapInArrow(found, "row long, pos int, a long, b long"), frequent)
    return rows.mapInArrow(found, RELATION)


def few_rows(batches, entries: int = ENTRIES) -> Iterator[pa.RecordBatch]:
    """The relation's batches in slices of about ``entries`` occurrences."""
    for batch in batches:
        offsets, first = batch.column("pos").offsets.to_numpy(), 0
        while first < len(batch):
            last = max(int(np.searchsorted(offsets, offsets[first] + entries, "right")) - 1, first + 1)
            yield batch.slice(first, min(last, len(batch)) - first)
            first = last


def adjacent(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Merge join of the batch's relation with itself at the next position: index of the row, position, both phrases."""
    pos, ids = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pos", "id"))
    offsets = batch.column("pos").offsets.to_numpy()
    at = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    hit = np.flatnonzero((at[1:] == at[:-1]) & (pos[1:] == pos[:-1] + 1))
    return at[hit], pos[hit], ids[hit], ids[hit + 1]


def pair_counts(relation: DataFrame) -> DataFrame:
    """(a, b, n) of all adjacent occurrences, summed in the task first."""

    def count(batches):
        for batch in few_rows(batches):
            _, _, a, b = adjacent(batch)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else order
            n = np.diff(np.concatenate([new, [len(a)]]))
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(n)], ["a", "b", "n"])

    return relation.mapInArrow(count, PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"))


def extend(relation: DataFrame, frequent: DataFrame, limit: int) -> DataFrame:
    """Occurrences one word longer, semi-joined with the frequent groups."""
    groups = relation.sparkSession.sparkContext.broadcast(Groups(frequent)) if is_small(frequent, limit) else None

    def joined(batches):
        for batch in few_rows(batches):
            row = batch.column("row").to_numpy()
            at, pos, a, b = adjacent(batch)
            if groups is None:
                yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(pos), pa.array(a), pa.array(b)], ["row", "pos", "a", "b"])
            else:
                keep, own = groups.value.find(a, b)
                yield clustered(row, at[keep], pos[keep], own)

    if groups is None:
        return gathered(relation.mapInArrow(joined, "row long, pos int, a long, b long"), frequent)
    return relation.mapInArrow(joined, RELATION)


def frequent_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang", limit: int = GROUP_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, phrase, m, a) of one to ``max_words`` words found ``min_count`` times, and the words per language."""
    docs = docs.select(text_of(text_col).alias("t"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    words, seed = number_words(docs, min_count)
    often = words.filter(F.col("n") >= min_count).select(F.col("id").alias("a"), F.col("id").alias("b"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n")
    often = written(dense_index(often, ["a"], "id"), "phrases-1")
    found, phrases = [often], often
    relation = written(word_relation(docs, often, seed, limit), "relation-1")
    for m in range(2, max_words + 1):
        often = written(pair_counts(relation).filter(F.col("n") >= min_count), f"counts-{m}")  # numbered below without counting again
        often = written(dense_index(often, ["a", "b"], "id"), f"groups-{m}")
        if often.isEmpty():
            break
        head = phrases.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head"))
        tail = phrases.select(F.col("id").alias("b"), "last")
        phrase = F.concat_ws(" ", "head", "last").alias("phrase")
        phrases = written(often.join(head, "a").join(tail, "b").select("id", "a", "b", "lang", phrase, "last", "n"), f"phrases-{m}")
        found.append(phrases)
        if m < max_words:
            relation = written(extend(relation, often, limit), f"relation-{m}")
    out = None
    for m, part in enumerate(found, 1):
        part = part.select("lang", "phrase", F.lit(m).alias("m"), F.col("n").alias("a"))
        out = part if out is None else out.unionByName(part)
    return out, words.groupBy("lang").agg(F.sum("n").alias("n"))


def parts(words: str, first, length) -> F.Column:
    return F.array_join(F.slice(words, first, length), " ")


def collocations(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates that no longer phrase explains, with the weakest of their cuts: lang, phrase, a, l, r, n, score."""
    counts = phrases.select("lang", "phrase", "a")
    longer = phrases.filter("m > 1").withColumn("w", F.split("phrase", " "))
    spot = F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("m") - k + 1), lambda i: parts("w", i, k)))
    inside = longer.filter("m > 2").select("lang", F.explode(F.array_distinct(F.flatten(spot))).alias("phrase"), "a")
    covered = inside.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    kept = longer.join(covered, ["lang", "phrase"], "left").filter("cover IS NULL OR cover < a").drop("cover")
    cuts = kept.select("lang", "phrase", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", parts("w", F.lit(1), F.col("k")).alias("x"), parts("w", F.col("k") + 1, F.col("m") - F.col("k")).alias("y"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("x"), F.col("a").alias("l")), ["lang", "x"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("y"), F.col("a").alias("r")), ["lang", "y"])
    # Products of counts are decimals of 38 digits, divided as whole numbers.
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(15,0)) * CAST(n AS DECIMAL(18,0))) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    scored = cuts.join(F.broadcast(totals), "lang").withColumn("score", score.cast("long"))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("s")
    return scored.groupBy("lang", "phrase", "a", "n").agg(weakest).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")


def top(found: DataFrame, k: int = TOP) -> DataFrame:
    """The first ``k`` of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


SQL13 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
      FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 100),
i AS (SELECT lang, a, unnest(list_transform(range(1, m - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM c, (SELECT unnest(range(2, 5)) AS k) WHERE k < m),
v AS (SELECT lang, phrase, max(a) AS cover FROM i GROUP BY 1, 2),
k AS (SELECT c.* FROM c LEFT JOIN v ON v.lang = c.lang AND v.phrase = c.phrase WHERE cover IS NULL OR 100 * cover < 100 * c.a),
x AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM k, (SELECT unnest(range(1, 5)) AS k) WHERE k < m),
s AS (SELECT x.lang, x.phrase, x.a, x.k, l.a AS l, r.a AS r, n.n,
        CAST((1000::HUGEINT * x.a * n.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.x JOIN f r ON r.lang = x.lang AND r.phrase = x.y JOIN n ON n.lang = x.lang),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS first FROM s),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o WHERE first = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000
"""


@query(SQL13)
def op13_collocations(spark, sf_dir):
    phrases, totals = frequent_phrases(table(spark, sf_dir, "documents"))
    return top(collocations(phrases, totals)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
