"""Near duplicates: banded MinHash candidates, Bayesian pruning over signature batches, exact verification.

1. Every text gets its set of word shingles, a signature of ``BANDS * ROWS`` minima and a key per band. Texts with equal
   sets form one class; only the class's smallest id goes on.
2. Per bucket each member is compared with one anchor (another one in each band). This joins groups of near copies
   without their pairs. The anchors of the first bands come first; later ones are compared where these joined nothing.
3. Where a bucket still holds several components, all pairs between different components are compared in blocks of
   bounded size, so the result has every link between different texts that share a bucket. Shingles that only one open
   text has bound its similarity with every other one, exactly; texts and pairs below the threshold by this bound are
   left out.

A pair's signatures are compared in batches: minima at anchors, and among open texts a sketch of ``SKETCH`` single bits of
further minima, which says more per byte that travels. A pair is dropped as soon as the posterior probability of reaching the
threshold, from a uniform prior, falls below ``MISS``; the survivors are decided on their whole sets. The threshold is the
caller's ``percent``; a pair at it shares no bucket with probability (1 - 0.85^5)^32, about 7e-9 (3e-6 at 80 percent).

Defined cases: null or empty text (or white space only) has an empty set and is linked with nothing. Texts of fewer than
``SIZE`` words have one shingle, their whole sequence. Rows that repeat an id are one document; a null id stays alone.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm import textnp
from tallyframe.llm.graph import components
from tallyframe.llm.registry import query
from tallyframe.llm.shared import table, written

SIZE = 5
#: The threshold of op7; other callers pass their own.
PERCENT = 85
BANDS, ROWS = 32, 5
BATCH = 32
#: Chosen probability of dropping a pair that reaches the threshold.
MISS = 1e-5
#: Bits of further minima, one each, that open texts are compared by before their sets are.
SKETCH, BITS = 1024, 256
#: Members of one bucket that are compared at once.
BLOCK = 256
#: Bands whose anchors are verified first; what they join needs no further link.
FIRST_BANDS = 2
SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"


def factors(seed: int = 20240607, n: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(1, 2**63, n, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minima of each row's shingle hashes, one row of 32-bit numbers per non-empty set (zeros for empty ones)."""
    out = np.zeros((len(at) - 1, BANDS * ROWS), np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        a, b = factors()
        for k in range(BANDS * ROWS):
            out[full, k] = np.minimum.reduceat(values * a[k] + b[k], at[:-1][full]) >> np.uint64(32)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = textnp.mix((key + parts[:, :, r]) * textnp.BASE)
    return key.view(np.int64)


def set_digest(values: np.ndarray, at: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A 64-bit sum per set that does not depend on order."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(textnp.mix(values ^ seed))])
    return (sums[at[1:]] - sums[at[:-1]]).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, last, values, at in textnp.shingle_sets(batch.column(1), SIZE):
            sig, n = signatures(values, at), np.diff(at)
            keys = band_keys(sig)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, last - first), pa.array(n.astype(np.int64)),
                    pa.array(set_digest(values, at, textnp.BASE)), pa.array(set_digest(values, at, np.uint64(1))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())),
                    pa.array([row.tobytes() for row in sig], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, last, values, at in textnp.shingle_sets(batch.column(1), SIZE):
            sets = [values[at[i] : at[i + 1]].tobytes() for i in range(last - first)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, last - first), pa.array(set_digest(values, at, textnp.BASE)), pa.array(sets, pa.large_binary())],
                names=["doc_id", "set_a", "shingles"],
            )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, digest, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            own = np.frombuffer(values.as_buffer(), np.int64)
            columns = [pa.array(own), pa.array(np.full(len(own), doc)), pa.array(np.full(len(own), digest))]
            yield pa.RecordBatch.from_arrays(columns, names=["shingle", "doc_id", "set_a"])


def least_equal(n: int, share: float, miss: float = MISS) -> int:
    """Fewest equal ones among n with which the posterior of reaching ``share`` is at least ``miss``.

    From a uniform prior the posterior is P(Bin(n + 1, share) <= m).
    """
    log = lambda m: math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(share) + (n + 1 - m) * math.log(1 - share)
    below, m = 0.0, -1
    while below < miss:
        m += 1
        below += math.exp(log(m))
    return m


def least_matches(percent: int = PERCENT) -> list[int]:
    """Fewest equal minima after each batch with which a pair goes on."""
    return [least_equal(n, percent / 100) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit of each of SKETCH further minima; two sets agree in a bit with probability (1 + similarity) / 2."""
    a, b = factors(20240608, SKETCH)
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
        first = 0
        while first < len(sets):
            last, size = first, 0
            while last < len(sets) and (last == first or size < 200_000):
                size += len(sets[last])
                last += 1
            values = np.concatenate(sets[first:last])
            heads = np.cumsum([0, *map(len, sets[first : last - 1])])
            bits = np.empty((last - first, SKETCH), bool)
            for k in range(SKETCH):
                bits[:, k] = np.minimum.reduceat(values * a[k] + b[k], heads) >> np.uint64(32) & np.uint64(1)
            packed = [row.tobytes() for row in np.packbits(bits, axis=1)]
            columns = [batch.column(k).slice(first, last - first) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], names=["doc_id", "set_a", "sketch"])
            first = last


def pairs_that_go_on(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Places of the signature pairs that survive every batch."""
    live, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, least in enumerate(least_matches(percent)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        equal[live] += (a[live, part] == b[live, part]).sum(1)
        live = live[equal[live] >= least]
    return live


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), BANDS * ROWS)


def _prune(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), 4096):
            part = batch.slice(first, 4096)
            live = pairs_that_go_on(_stack(part.column(2)), _stack(part.column(3)), percent)
            yield part.select([0, 1]).take(pa.array(live))


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


def sketch_pairs_that_go_on(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Places of the sketch pairs that survive every batch of bits."""
    live, equal, words = np.arange(len(a)), np.zeros(len(a), np.int64), BITS // 64
    for i, n in enumerate(range(BITS, SKETCH + 1, BITS)):
        part = slice(i * words, (i + 1) * words)
        equal[live] += BITS - np.bitwise_count(a[live, part] ^ b[live, part]).sum(1).astype(np.int64)
        live = live[equal[live] >= least_equal(n, (1 + percent / 100) / 2)]
    return live


def _block_pairs(rows: list[tuple], percent: int) -> tuple[list[int], list[int]]:
    """Surviving pairs between the components of one block pair; a pair counts in its lowest common band only."""
    band, left, right = rows[0][0], rows[0][2], rows[0][3]
    side, ids, comp, size, alone = (np.array([r[k] for r in rows]) for k in range(4, 9))
    bands = np.array([r[9] for r in rows], np.int32)
    sketch = np.frombuffer(b"".join(r[10] for r in rows), np.uint64).reshape(len(rows), SKETCH // 64)
    shared = size - alone
    if left == right:
        i, j = np.triu_indices(len(rows), 1)
    else:
        one, two = np.flatnonzero(side == left), np.flatnonzero(side == right)
        i, j = np.repeat(one, len(two)), np.tile(two, len(one))
    common = np.minimum(shared[i], shared[j])
    able = (comp[i] != comp[j]) & (100 * common >= percent * (size[i] + size[j] - common))
    i, j = i[able], j[able]
    out_a, out_b = [], []
    for first in range(0, len(i), 8192):
        a, b = i[first : first + 8192], j[first : first + 8192]
        live = sketch_pairs_that_go_on(sketch[a], sketch[b], percent)
        a, b = a[live], b[live]
        here = np.argmax(bands[a] == bands[b], 1) == band
        out_a += ids[a[here]].tolist()
        out_b += ids[b[here]].tolist()
    return out_a, out_b


def _compare_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (band, bucket, left, right); one group is held at a time and has at most two blocks."""
    key, rows = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            a, b = _block_pairs(rows, percent)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)]):
            if row[:4] != key:
                yield from flush()
                key, rows = row[:4], []
            rows.append(row)
    yield from flush()


def _pruned(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    one = sigs.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    two = sigs.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    near = pairs.join(one, "a").join(two, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return near.select("a", "b", "sa", "sb").mapInArrow(lambda x: _prune(x, percent), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "xa", "xb")
    return joined.mapInArrow(lambda x: _confirm(x, percent), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links of ``percent`` or more), kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(texts.mapInArrow(_signed, SIGNATURE), "signatures")
    # Counted on the map side and written, so that the join back may split the rows of a large group of copies.
    classes = written(signed.filter("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    member = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["n_shingles", "set_a", "set_b"], "left")
    member = member.select("doc_id", "n_shingles", "rep")

    reps = signed.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    reps = reps.dropDuplicates(["doc_id", "set_a", "set_b"])
    keyed = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    # Flipping id bits by band lets each band choose its own anchor, and the id can be read back.
    flip = F.shiftright(F.xxhash64("band"), 1)
    buckets = keyed.groupBy("band", "key").agg(
        F.count("*").alias("members"), F.min(F.col("doc_id").bitwiseXOR(flip)).alias("low")
    ).filter("members > 1")
    members = written(
        keyed.join(buckets, ["band", "key"]).select("band", "key", "doc_id", "members", F.col("low").bitwiseXOR(flip).alias("anchor")), "members"
    )
    ids = written(members.select("doc_id").distinct(), "ids")
    known = reps.join(ids, "doc_id", "left_semi")
    sigs = known.select("doc_id", "n_shingles", "signature")
    sets = texts.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, set_a long, shingles binary")
    sets = written(sets, "shingles")

    stars = members.filter("doc_id <> anchor").select(F.greatest("doc_id", "anchor").alias("a"), F.least("doc_id", "anchor").alias("b"), "band")
    stars = stars.groupBy("a", "b").agg(F.min("band").alias("band"))
    verify = lambda pairs: _confirmed(_pruned(pairs.select("a", "b"), sigs, percent), sets, percent)
    early = components(written(verify(stars.filter(F.col("band") < FIRST_BANDS)), "links"))
    # A pair whose ends the first bands have joined adds nothing; neither its signatures nor its sets travel.
    end = lambda c: early.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    late = stars.filter(F.col("band") >= FIRST_BANDS).join(end("a"), "a", "left").join(end("b"), "b", "left")
    late = late.filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b"))
    joined = early.filter("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
    labels = components(written(joined.union(verify(late)), "links"))

    placed = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "band", "key", "members", "doc_id", F.coalesce("label", "doc_id").alias("comp")
    )
    mixed = placed.groupBy("band", "key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1")
    open_ = written(placed.join(mixed.select("band", "key"), ["band", "key"], "left_semi"), "open")
    own = sets.join(open_.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "set_a", "shingles")
    once = own.mapInArrow(_members, "shingle long, doc_id long, set_a long").groupBy("shingle").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("set_a").alias("set_a")
    ).filter("n = 1")
    alone = once.groupBy("doc_id", "set_a").agg(F.count("*").alias("alone"))
    # 32 bits of each band's key are enough to tell a pair's lowest common band (wrong with probability 7e-9).
    keys = known.select("doc_id", "set_a", "n_shingles", F.transform("bands", lambda k: F.shiftright(k, 32).cast("int")).alias("bands"))
    keys = keys.join(alone, ["doc_id", "set_a"], "left").fillna(0, "alone")
    keys = written(keys.filter(f"100 * (n_shingles - alone) >= {percent} * n_shingles"), "keys")
    sketches = own.join(keys.select("doc_id", "set_a"), ["doc_id", "set_a"], "left_semi").dropDuplicates(["doc_id", "set_a"])
    sketches = sketches.mapInArrow(_sketches, "doc_id long, set_a long, sketch binary")
    open_ = open_.join(keys.join(sketches, ["doc_id", "set_a"]), "doc_id")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    open_ = open_.withColumn("side", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "band", "key", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"), "side", "doc_id", "comp",
        "n_shingles", "alone", "bands", "sketch",
    )
    group = ["band", "key", "left", "right"]
    more = open_.repartition(*group).sortWithinPartitions(*group).mapInArrow(lambda x: _compare_blocks(x, percent), "a long, b long").distinct()
    found = _confirmed(more, sets, percent)
    joined = labels.filter("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
    labels = components(written(joined.union(found), "links"))

    labels = labels.select(F.col("node").alias("rep"), "label")
    component = F.coalesce("label", "rep", "doc_id").alias("component_id")
    out = member.join(labels, "rep", "left").select("doc_id", "n_shingles", component)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; of rows that repeat an id, one."""
    gone = near_duplicates(docs, percent=percent).filter("NOT kept").select("doc_id")
    again = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    single = docs.join(gone.union(again).distinct(), "doc_id", "left_anti").select(docs.columns)
    once = docs.join(again.join(gone, "doc_id", "left_anti"), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return single.union(once)


@query()
def op7_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=PERCENT)
