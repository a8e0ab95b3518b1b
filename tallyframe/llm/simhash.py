"""SimHash fingerprints and a Hamming-radius search over permuted block tables.

Terms are pairs of neighbouring words (the last word stands alone), lower-cased and hashed to 64 bits; a term weighs as much
as its first word has characters, up to ``MAX_WEIGHT``. Every occurrence votes for or against each bit. Four bits are
counted in one 64-bit number (lanes of 16 bits, of which ``CHUNK`` terms fill 15: the highest bit of all is the sign), so a
term costs 16 additions. The terms that a text and its edited text begin with vote once for both.

The search cuts fingerprints into ``blocks`` blocks. Two fingerprints within ``radius`` bits differ in at most ``radius`` blocks
and agree in the others, so they share the key of at least one table that keeps ``blocks - radius`` blocks; such pairs are
counted in the first table that they share. Equal fingerprints travel as one row with their number.

Neighbours are found in blocks of ids: whole texts are exchanged once, and the first row of a block is also dealt to the block
before it.

Defined cases: null text is empty; an empty text has fingerprint 0. Ids are whole numbers; a null id comes first. Rows of one
id are ordered by a hash of their text and are neighbours in one task; rows that are equal in both have one text. Very long
texts are counted in chunks. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyframe.llm.registry import query
from tallyframe.llm.shared import table, text_of, words_of, written

BITS = 64
LANE = 16
LANES = BITS // LANE
#: One bit in every lane.
ONES = sum(1 << LANE * k for k in range(LANES))
MAX_WEIGHT = 15
#: Terms whose votes, all for one bit, fit a lane without its highest bit: in the top lane that is the sign, and a long that overflows is an error.
CHUNK = ((1 << LANE - 1) - 1) // MAX_WEIGHT
RADIUS = 3
BLOCKS = 6
#: Query documents of the search are those whose id is divisible by this number.
EVERY = 20
#: Id blocks per shuffle partition.
ID_BLOCKS = 2


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _: acc, body)


def terms(words: Column, first: Column | int = 0) -> Column:
    """(hash, weight) of every pair of neighbouring words from word ``first`` on; ``words`` is bound, because every pair looks into it."""
    hashed = lambda w, i: F.xxhash64(w, F.get(words, i + 1 + first))
    one = lambda w, i: F.struct(hashed(w, i).alias("h"), F.least(F.length(w), F.lit(MAX_WEIGHT)).cast("long").alias("w"))
    return F.transform(F.slice(words, F.lit(1) + first, F.size(words)), one)


def votes(found: Column) -> Column:
    """Weight for each bit: per chunk of terms sixteen numbers of four lanes, and the chunk's whole weight."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in range(LANE)], F.lit(0).cast("long").alias("all"))
    add = lambda acc, t: F.struct(
        *[(acc[f"c{j}"] + F.shiftrightunsigned(t["h"], j).bitwiseAND(F.lit(ONES)) * t["w"]).alias(f"c{j}") for j in range(LANE)],
        (acc["all"] + t["w"]).alias("all"),
    )
    listed = lambda acc: F.array(*[acc[f"c{j}"] for j in range(LANE)], acc["all"])
    starts = lambda f: F.sequence(F.lit(1), F.greatest(F.size(f), F.lit(1)), F.lit(CHUNK))
    return bind(found, lambda f: F.transform(starts(f), lambda s: F.aggregate(F.slice(f, s, CHUNK), zero, add, listed)))


def fingerprint(chunks: Column) -> Column:
    """The SimHash of a text as a 64-bit number, from its :func:`votes`; a bit is set where more than half of the weight votes for it."""
    none = F.lit(0).cast("long")
    lane = lambda c, bit: F.call_function("shiftrightunsigned", F.get(c, bit % LANE), F.floor(bit / LANE).cast("int") * LANE).bitwiseAND(F.lit((1 << LANE) - 1))
    weight = lambda bit: F.aggregate(chunks, none, lambda acc, c: acc + lane(c, bit))
    total = F.aggregate(chunks, none, lambda acc, c: acc + F.get(c, F.lit(LANE)))
    high = lambda bit: F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    return bind(total, lambda all_: F.aggregate(bits, none, lambda out, bit: F.when(weight(bit) * 2 > all_, out.bitwiseOR(high(bit))).otherwise(out)))


def two_fingerprints(text: Column, edited: Column, kept: Column) -> Column:
    """struct(fp, edited_fp) of a text and of another one that begins with the text's part ``kept``.

    All words of the kept part but its last one stand in both texts, and so do their pairs but the last; these vote once.
    """
    cut = lambda t: words_of(F.lower(t))
    words = F.struct(cut(text).alias("a"), cut(edited).alias("b"), F.greatest(F.size(cut(kept)) - 2, F.lit(0)).alias("n"))
    part = lambda w: bind(terms(w["a"]), lambda own: F.struct(
        votes(F.slice(own, F.lit(1), w["n"])).alias("both"), votes(F.slice(own, w["n"] + 1, F.size(own))).alias("a"), votes(terms(w["b"], w["n"])).alias("b")
    ))
    both = lambda v: F.struct(
        bind(F.concat(v["both"], v["a"]), fingerprint).alias("fp"), bind(F.concat(v["both"], v["b"]), fingerprint).alias("edited_fp")
    )
    return bind(words, lambda w: bind(part(w), both))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The bits that each table keeps: every choice of ``blocks - radius`` blocks, as signed 64-bit numbers."""
    edge = [BITS * k // blocks for k in range(blocks + 1)]
    of = [sum(1 << bit for bit in range(edge[k], edge[k + 1])) for k in range(blocks)]
    kept = [sum(of[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def search(fingerprints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """For each distinct ``fp`` of ``queries``: how many rows of ``fingerprints`` lie within ``radius``, and how many values they have."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("the radius has to be smaller than the number of blocks")
    kept = masks(radius, blocks)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("m")) for t, m in enumerate(kept)]))
    keyed = lambda df: df.withColumn("k", tables).withColumn("key", F.col("fp").bitwiseAND(F.col("k.m"))).withColumn("t", F.col("k.t")).drop("k")
    rows = keyed(fingerprints.filter("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("n")))
    asked = keyed(queries.filter("fp IS NOT NULL").select("fp").distinct()).withColumnRenamed("fp", "q")
    apart = F.col("fp").bitwiseXOR(F.col("q"))
    earlier = [(F.col("t") > t) & (apart.bitwiseAND(F.lit(m).cast("long")) == 0) for t, m in enumerate(kept[:-1])]
    first = ~F.greatest(F.lit(False), *earlier) if earlier else F.lit(True)
    pairs = rows.join(asked.withColumnRenamed("t", "t2").withColumnRenamed("key", "key2"), (F.col("t") == F.col("t2")) & (F.col("key") == F.col("key2")) & (F.bit_count(apart) <= radius) & first)
    return pairs.groupBy("q").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_values")).withColumnRenamed("q", "fp")


def id_cuts(docs: DataFrame, blocks: int) -> list[int]:
    """Ids that cut the table into about equal blocks."""
    if blocks < 2:
        return []
    shares = [k / blocks for k in range(1, blocks)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 20 * blocks).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def block_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts lie below the id, by halving; null ids come first."""
    if not cuts:
        return F.lit(0)
    where = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
    found = F.lit(0)
    step = 1 << (len(cuts).bit_length() - 1)
    steps = []
    while step:
        steps.append(step)
        step >>= 1
    go = lambda acc, s: F.when((acc + s <= len(cuts)) & (F.get(where, F.least(acc + s, F.lit(len(cuts))) - 1) < doc_id), acc + s).otherwise(acc)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), found, go)


def with_next(docs: DataFrame, blocks: int | None = None) -> tuple[DataFrame, Window]:
    """Rows (doc_id, t) by blocks of ids, the copies of each next block's first row (``copied``), and the window that orders a block."""
    spark = docs.sparkSession
    blocks = blocks or ID_BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.withColumn("block", block_of(F.col("doc_id"), id_cuts(docs, blocks))).withColumn("h", F.xxhash64("t"))
    firsts = rows.groupBy("block").agg(F.min(F.struct("doc_id", "h")).alias("x")).orderBy("block").collect()  # a row per block
    schema = "first_block int, first_id long, first_h long, target int"
    before = [(r["block"], r["x"]["doc_id"], r["x"]["h"], firsts[k - 1]["block"]) for k, r in enumerate(firsts)]
    marks = F.broadcast(spark.createDataFrame(before, schema))
    same = (F.col("block") == F.col("first_block")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    place = lambda block, copied: F.struct(block.alias("block"), F.lit(copied).alias("copied"))
    own = place(F.col("block"), False)
    to = F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, place(F.col("target"), True)))
    dealt = rows.join(marks, same, "left").select("doc_id", "t", "h", F.explode(to).alias("p")).select("doc_id", "t", "h", "p.*")
    return dealt, Window.partitionBy("block").orderBy("copied", "doc_id", "h")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """Per row: n_chars, the edited text's digest, ``fp``, ``edited_fp`` and ``next_fp`` (64-bit numbers)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    dealt, order = with_next(rows, blocks)
    n = F.length("t")
    gone = F.floor(n / 4).cast("int")
    near = dealt.withColumn("next", F.lead("t").over(order))
    kept = F.substr("t", F.lit(1), n - gone)
    near = near.select("doc_id", "h", "block", "copied", n.cast("long").alias("n_chars"), "t", kept.alias("kept"), F.substr(F.coalesce("next", F.lit("")), F.lit(1), gone).alias("tail"))
    edited = F.concat("kept", "tail")
    near = near.select("doc_id", "h", "block", "copied", "n_chars", F.sha2(edited, 256).alias("edited_sha256"), two_fingerprints(F.col("t"), edited, F.col("kept")).alias("f"))
    near = near.select("doc_id", "h", "block", "copied", "n_chars", "edited_sha256", "f.fp", "f.edited_fp")
    return near.withColumn("next_fp", F.lead("fp").over(order)).filter(~F.col("copied")).drop("h", "block", "copied")


def neighbours(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, every: int = EVERY, **columns: str) -> DataFrame:
    """Fingerprints, likenesses, and for every id divisible by ``every`` the number of other rows within ``radius``."""
    found = written(fingerprints(docs, **columns), "fingerprints")
    asked = (F.col("doc_id") % every == 0)
    counts = search(found.select("fp"), found.filter(asked).select("fp"), radius, blocks).withColumnRenamed("fp", "q")
    # Rows that ask nothing carry no key, so they meet no one.
    out = found.withColumn("ask", F.when(asked, F.col("fp"))).join(counts, F.col("ask") == F.col("q"), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        (F.col("n_rows") - 1).alias("n_near"),
    )


@query()
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents"))
