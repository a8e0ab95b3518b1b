"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.

1. Every string of ``LENGTH`` bytes holds at least one anchor: the place whose ``K``-byte hash is the smallest of
   ``LENGTH - K + 1`` neighbouring ones. Equal strings have it at the same place. Only anchors whose hash is found in
   two or more documents go on.
2. The suffixes at these anchors are sorted in runs, front-coded (length of the prefix shared with the one before, and
   the rest). Inside a run, equal surroundings of an anchor are settled at once: only those of the smallest id travel,
   so a string that is everywhere travels once per run. Runs are dealt out by ranges of prefixes and merged with loser trees. A tree compares the lengths of prefixes shared
   with the last winner first and reads bytes only behind a known common prefix.
3. In the merged order, suffixes with a common prefix of ``LENGTH - o`` bytes are neighbours. Together with the ``o`` bytes
   before the anchor they are equal strings, for each offset ``o``; each class's smallest id tells which are repeated.

Blocks that travel are packed with zstd. Every step is linear in the number of anchors, apart from sorting.

Defined cases: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose nothing. Rows that repeat an id
are one document; strings repeated within a document stay. A null id is the largest of all. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm import textnp
from tallyframe.llm.registry import query
from tallyframe.llm.shared import table, written

LENGTH, K = 50, 20
SPAN = LENGTH - K + 1
SIDE = LENGTH - K
#: Suffixes that one run holds.
RUN = 50_000
#: Bytes of text whose anchors leave a task together.
CHUNK = 16 << 20
#: Documents, chosen by a hash of their id, whose anchors cut the prefix ranges.
SAMPLE = 2_000
LAST = 2**63 - 1
OFFSETS = np.arange(SIDE + 1)


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes at each place, by doubling; the last K - 1 places see zeros."""
    h = textnp.mix(data.astype(np.uint64) + np.uint64(1))
    out, size = None, 1
    at, bits = 0, K
    while True:
        if bits & 1:
            part = np.concatenate([h[at:], np.zeros(min(at, len(h)), np.uint64)])
            out = part if out is None else textnp.mix((out + part) * textnp.BASE)
            at += size
        bits >>= 1
        if not bits:
            return out
        moved = np.concatenate([h[size:], np.zeros(min(size, len(h)), np.uint64)])
        h = textnp.mix((h + moved) * textnp.BASE)
        size *= 2


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of ``span`` values from each place on; shorter by span - 1."""
    out, have = x, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row and hash of the anchors of all rows of at least LENGTH bytes."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = window_hashes(data)[: n - K + 1]
    sizes = np.diff(at)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) - at[:-1][row_of]
    # Minima of windows that leave their row are no place's hash.
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.where((place + LENGTH <= sizes[row_of])[: n - LENGTH + 1], sliding_min(h, SPAN), top)
    edge = np.full(SPAN - 1, top)
    # Windows with place p start at p - SPAN + 1 .. p. The largest of their minima is h[p] if one of them is: none is larger.
    most = ~sliding_min(np.concatenate([edge, np.where(least == top, top, ~least), edge]), SPAN)
    found = np.flatnonzero((most == h) & (most != 0))
    return row_of[found], place[found], h[found]


def packed(**arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _batch(parts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _dealt(part: np.ndarray, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One packed block per part number."""
    order = np.argsort(part, kind="stable")
    numbers, heads = np.unique(part[order], return_index=True)
    pieces = np.split(order, heads[1:]) if len(numbers) else []
    return _batch(numbers.tolist(), [packed(**{k: v[i] for k, v in arrays.items()}) for i in pieces])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows of one part number after the other; they come sorted by their first column."""
    rows = (r for b in batches for r in zip(*[b.column(k).to_pylist() for k in range(b.num_columns)]))
    return groupby(rows, key=lambda r: r[0])


def _anchor_blocks(names: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, doc, rid, place = (np.concatenate(x) for x in zip(*held))
            bucket = ((h >> np.uint64(16)) % np.uint64(len(names))).astype(np.int64)
            return _dealt(names[bucket], {"h": h >> np.uint64(12), "doc": doc, "rid": rid, "place": place})

        for batch in batches:
            data, at = textnp.buffers(batch.column(2))
            doc, rid = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, last in textnp.row_chunks(at):
                row, place, h = anchors(data[at[first] : at[last]], at[first : last + 1] - at[first])
                held.append((h, doc[first + row], rid[first + row], place.astype(np.int32)))
                size += int(at[last] - at[first])
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _repeated_blocks(names: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            blocks = [unpacked(r[1]) for r in rows]
            h, doc, rid, place = (np.concatenate([b[k] for b in blocks]) for k in ("h", "doc", "rid", "place"))
            order = np.argsort(h, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0])) if len(h) else np.zeros(0, np.int64)
            if not len(head):
                continue
            mixed = np.minimum.reduceat(doc[order], head) != np.maximum.reduceat(doc[order], head)
            keep = np.sort(order[np.repeat(mixed, np.diff(np.append(head, len(h))))])
            yield _dealt(names[np.mod(rid[keep], len(names))], {"doc": doc[keep], "rid": rid[keep], "place": place[keep]})

    return run


def surroundings(data: np.ndarray, base: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bytes from each anchor on, bytes before it (backwards), both cut at the text's ends and filled with zeros."""
    right_size, left_size = np.minimum(size - place, LENGTH), np.minimum(place, SIDE)
    wide = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    at = base + place + SIDE
    right = wide[at[:, None] + np.arange(LENGTH)] * (np.arange(LENGTH) < right_size[:, None])
    left = wide[at[:, None] - 1 - np.arange(SIDE)] * (np.arange(SIDE) < left_size[:, None])
    return right.astype(np.uint8), left.astype(np.uint8), right_size.astype(np.uint8), left_size.astype(np.uint8)


def _strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _prefixes(keys: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before; 0 for the first."""
    out = np.zeros(len(keys), np.uint8)
    differ = keys[1:] != keys[:-1]
    out[1:] = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    return out


def sorted_run(right, left, right_size, left_size, doc, rid, place) -> tuple[dict, dict]:
    """A run of suffixes (unique, sorted, front-coded, with the places they stand for) and the spans settled in it."""
    ids = (doc.astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    whole = np.concatenate([right, left, right_size[:, None], left_size[:, None], ids], 1)
    order = np.argsort(_strings(whole), kind="stable")
    whole, doc, rid, place = whole[order], doc[order], rid[order], place[order].astype(np.int32)
    head = np.ones(len(order), bool)
    head[1:] = (whole[1:, :-8] != whole[:-1, :-8]).any(1)
    lowest = doc[np.flatnonzero(head)][np.cumsum(head) - 1]
    done = doc > lowest
    rsize, lsize = whole[:, LENGTH + SIDE].astype(np.int32), whole[:, LENGTH + SIDE + 1].astype(np.int32)
    low = np.maximum(LENGTH - rsize, 0)
    settled = np.flatnonzero(done & (low <= lsize))
    spans = {"doc": doc[settled], "rid": rid[settled], "start": place[settled] - lsize[settled], "end": place[settled] - low[settled] + LENGTH}
    go = np.flatnonzero(~done)
    keys = whole[go, :LENGTH]
    shared = _prefixes(keys)
    fresh = np.flatnonzero(np.concatenate([[True], shared[1:] < LENGTH])) if len(go) else np.zeros(0, np.int64)
    run = {
        "keys": keys[fresh], "count": np.diff(np.append(fresh, len(go))).astype(np.int32), "left": whole[go, LENGTH : LENGTH + SIDE],
        "rsize": rsize[go].astype(np.uint8), "lsize": lsize[go].astype(np.uint8), "doc": doc[go], "rid": rid[go], "place": place[go],
    }
    return run, spans


def front_coded(run: dict) -> dict:
    """Shared prefix lengths and the remaining bytes in place of the keys."""
    keys = run.pop("keys")
    shared = _prefixes(keys)
    return run | {"shared": shared, "rest": keys[np.arange(LENGTH) >= shared[:, None]]}


def range_slices(run: dict, cuts: np.ndarray) -> Iterator[tuple[int, dict]]:
    """The run's slice for every prefix range; a range never parts suffixes that share K bytes."""
    number = np.searchsorted(cuts, _strings(run["keys"][:, :K]), "right")
    at = np.concatenate([[0], np.cumsum(run["count"])])
    for n, first in zip(*np.unique(number, return_index=True)):
        last = int(np.searchsorted(number, n, "right"))
        inner = {k: v[at[first] : at[last]] for k, v in run.items() if k not in ("keys", "count")}
        yield int(n), front_coded(inner | {"keys": run["keys"][first:last], "count": run["count"][first:last]})


def _runs(names: np.ndarray, cuts: np.ndarray):
    """Rows (part, kind, doc_id, rid, blob): per part first the places (kind 0), then its texts (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            places: list[dict] = []
            index: dict[tuple[int, int], tuple[int, int]] = {}
            where = np.zeros(0, np.int32)
            texts: list[tuple] = []
            waiting = 0

            def flush() -> pa.RecordBatch:
                size = np.array([len(t[2]) for t in texts])
                n = np.array([len(t[3]) for t in texts])
                base = np.repeat(np.cumsum(size) - size, n)
                place = np.concatenate([t[3] for t in texts])
                data = np.frombuffer(b"".join(t[2] for t in texts), np.uint8)
                doc, rid = (np.repeat(np.array([t[k] for t in texts], np.int64), n) for k in (0, 1))
                travel, spans = sorted_run(*surroundings(data, base, np.repeat(size, n), place), doc, rid, place)
                slices = list(range_slices(travel, cuts)) if len(travel["keys"]) else []
                settled = _dealt(names[np.mod(spans["rid"], len(names))], spans)
                kinds = [0] * len(slices) + [1] * len(settled)
                numbers = [int(names[n]) for n, _ in slices] + settled.column(0).to_pylist()
                blobs = [packed(**b) for _, b in slices] + settled.column(1).to_pylist()
                return pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.int32()), pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "part", "blob"]
                )

            for _, kind, doc, rid, blob in rows:
                if kind == 0:
                    places.append(unpacked(blob))
                    continue
                if places:
                    index, where = _by_document(places, ("place",))
                    where, places = where["place"], []
                own = index.get((doc, rid))
                if own is not None:
                    texts.append((doc, rid, zstandard.ZstdDecompressor().decompress(blob), np.unique(where[own[0] : own[1]])))
                    waiting += len(texts[-1][3])
                    if waiting >= RUN:
                        yield flush()
                        texts, waiting = [], 0
            if texts:
                yield flush()

    return run


def _by_document(blocks: list[dict], names: tuple[str, ...]) -> tuple[dict, dict]:
    """Slices of the joined arrays by (doc, rid)."""
    doc, rid = (np.concatenate([b[k] for b in blocks]) for k in ("doc", "rid"))
    order = np.lexsort((rid, doc))
    doc, rid = doc[order], rid[order]
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1])])) if len(doc) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(doc))
    index = {(d, r): (a, b) for d, r, a, b in zip(doc[head].tolist(), rid[head].tolist(), head.tolist(), tail.tolist())}
    return index, {k: np.concatenate([b[k] for b in blocks])[order] for k in names}


def _decoded(shared: np.ndarray, rest: np.ndarray) -> list[bytes]:
    out, before, at, raw = [], b"", 0, rest.tobytes()
    for n in shared.tolist():
        before = before[:n] + raw[at : at + LENGTH - n]
        at += LENGTH - n
        out.append(before)
    return out


def merge_runs(shared: list[list[int]], keys: list[list[bytes]]) -> tuple[list[int], list[int]]:
    """Run numbers in merged order, and the prefix length that each suffix shares with the one before.

    A loser tree over the runs' heads. Every head carries the length of the prefix that it shares with the last winner.
    The longer one is smaller; only at equal lengths are bytes read, and only those behind that prefix.
    """
    n = len(keys)
    size = 1
    while size < n:
        size *= 2
    at, known = [0] * n, [0] * n
    end = n  # stands for an exhausted run
    head: list[bytes | None] = [k[0] if k else None for k in keys]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser learns the prefix that it shares with the winner."""
        if a >= end or head[a] is None:
            return b, a
        if b >= end or head[b] is None:
            return a, b
        x, y = known[a], known[b]
        if x > y:
            return a, b
        if y > x:
            return b, a
        p, q = head[a][x:], head[b][x:]
        if p == q:
            known[b] = LENGTH
            return a, b
        differ = x + len(p) - ((int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_length() + 7) // 8
        if p < q:
            known[b] = differ
            return a, b
        known[a] = differ
        return b, a

    losers = [end] * size
    level = [i if i < n else end for i in range(size)]
    first = size
    while first > 1:
        first //= 2
        up = []
        for i in range(first):
            w, lost = play(level[2 * i], level[2 * i + 1])
            losers[first + i] = lost
            up.append(w)
        level = up
    winner = level[0]
    order, prefix = [], []
    while winner < end and head[winner] is not None:
        order.append(winner)
        prefix.append(known[winner])
        k = at[winner] + 1
        at[winner] = k
        own = keys[winner]
        if k < len(own):
            head[winner], known[winner] = own[k], shared[winner][k]
        else:
            head[winner] = None
        node = (size + winner) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1
    return order, prefix


def repeated_spans(blocks: list[dict]) -> dict:
    """Merge the runs of one range and mark the suffixes whose surroundings are found in a document with a smaller id."""
    keys = [_decoded(b["shared"], b["rest"]) for b in blocks]
    order, prefix = merge_runs([b["shared"].tolist() for b in blocks], keys)
    prefix = np.array(prefix, np.int64)
    # Occurrences in merged order: each item's place in its own run gives its slice there.
    run = np.array(order, np.int64)
    begin = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    nth = np.empty(len(run), np.int64)
    by_run = np.argsort(run, kind="stable")
    nth[by_run] = np.arange(len(run))
    count = np.concatenate([b["count"] for b in blocks]).astype(np.int64)
    start = np.cumsum(count) - count
    item_count, item_start = count[nth], start[nth]
    before = np.cumsum(item_count) - item_count
    take = np.repeat(item_start - before, item_count) + np.arange(item_count.sum())
    item = np.repeat(np.arange(len(run)), item_count)
    doc, rid, place, rsize, lsize, left = (np.concatenate([b[k] for b in blocks])[take] for k in ("doc", "rid", "place", "rsize", "lsize", "left"))
    # Only neighbours that share K bytes in two or more documents can be repeated.
    group = np.cumsum(prefix < K)[item]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    mixed = np.repeat(np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head), np.diff(np.append(head, len(doc))))
    item, doc, rid, place, left = item[mixed], doc[mixed], rid[mixed], place[mixed], left[mixed]
    rsize, lsize = rsize[mixed].astype(np.int64), lsize[mixed].astype(np.int64)
    first, last = np.full(len(doc), SIDE + 1), np.full(len(doc), -1)
    same_left = np.zeros(len(doc), np.int64)
    for o in OFFSETS:
        if o:
            same_left = np.unique(same_left * 256 + left[:, o - 1], return_inverse=True)[1].astype(np.int64)
        right = np.cumsum(prefix < LENGTH - o)[item]
        able = np.flatnonzero((lsize >= o) & (rsize >= LENGTH - o))
        if not len(able):
            continue
        key = right[able] * (int(same_left.max()) + 1) + same_left[able]
        by = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(key[by]) != 0]))
        lowest = np.repeat(np.minimum.reduceat(doc[able][by], heads), np.diff(np.append(heads, len(by))))
        hit = able[by[doc[able][by] > lowest]]
        first[hit] = np.minimum(first[hit], o)
        last[hit] = np.maximum(last[hit], o)
    hit = np.flatnonzero(last >= 0)
    return {"doc": doc[hit], "rid": rid[hit], "start": place[hit] - last[hit], "end": place[hit] - first[hit] + LENGTH}


def _merged(names: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            spans = repeated_spans([unpacked(r[1]) for r in rows])
            yield _dealt(names[np.mod(spans["rid"], len(names))], spans)

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, kind, doc_id, rid, blob): per part first the spans (kind 0), then its texts (kind 1)."""
    for _, rows in _groups(batches):
        blocks: list[dict] = []
        index: dict = {}
        spans: dict = {}
        out: list[tuple] = []
        for _, kind, doc, rid, blob in rows:
            if kind == 0:
                blocks.append(unpacked(blob))
                continue
            if blocks:
                (index, spans), blocks = _by_document(blocks, ("start", "end")), []
            text = zstandard.ZstdDecompressor().decompress(blob)
            own = index.get((doc, rid))
            drop = np.zeros(len(text) + 1, np.int64)
            if own is not None:
                np.add.at(drop, spans["start"][own[0] : own[1]], 1)
                np.add.at(drop, spans["end"][own[0] : own[1]], -1)
            gone = np.cumsum(drop)[:-1] > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            begins = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((None if doc == LAST else doc, len(text), int(gone.sum()), begins, hashlib.sha256(kept).hexdigest(), kept))
            if len(out) >= 256:
                yield _result(out)
                out = []
        if out:
            yield _result(out)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _compressed(names: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, at = textnp.buffers(batch.column(2))
            blobs = pa.array([press.compress(data[at[i] : at[i + 1]].tobytes()) for i in range(len(batch))], pa.binary())
            part = names[np.mod(batch.column(1).to_numpy(zero_copy_only=False), len(names))]
            columns = [pa.array(part, pa.int32()), pa.array(np.ones(len(batch)), pa.int32()), batch.column(0), batch.column(1), blobs]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "kind", "doc_id", "rid", "blob"])

    return run


def part_names(spark: SparkSession, parts: int) -> np.ndarray:
    """One whole number for each of ``parts`` hash partitions, so that every partition gets exactly one block number."""
    number = F.col("id").cast("int")
    rows = spark.range(40 * parts).groupBy(F.pmod(F.hash(number), F.lit(parts)).alias("p")).agg(F.min(number).alias("k")).collect()
    names = np.arange(parts, dtype=np.int32)
    names[[r["p"] for r in rows]] = [r["k"] for r in rows]
    return names


def _range_cuts(rows: DataFrame, parts: int) -> np.ndarray:
    """K-byte prefixes that cut the anchors of a bounded sample of documents into equal ranges."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = textnp.buffers(batch.column(2))
            for first, last in textnp.row_chunks(at):
                part = data[at[first] : at[last]]
                row, place, h = anchors(part, at[first : last + 1] - at[first])
                own = (at[first : last + 1] - at[first])[row] + place
                own = own[(h >> np.uint64(40)) % np.uint64(16) == 0]
                yield pa.RecordBatch.from_arrays([pa.array([part[i : i + K].tobytes() for i in own], pa.binary())], names=["prefix"])

    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    found = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "rid", "text").mapInArrow(prefixes, "prefix binary").collect()
    keys = np.sort(np.array([bytes(r["prefix"]) for r in found], f"S{K}"))
    return np.unique(keys[np.arange(1, parts) * len(keys) // parts]) if len(keys) else keys


def remove_repeats(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    ``parts`` is the number of blocks that anchors, ranges and texts are dealt into; each must fit a task's memory.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = part_names(spark, parts)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("rid", F.xxhash64("doc_id", "text"))
    rows = rows.select("doc_id", "rid", "text")
    block = "part int, blob binary"
    dealt = lambda df, *order: df.repartition(parts, "part").sortWithinPartitions("part", *order)
    texts = rows.mapInArrow(_compressed(names), "part int, kind int, doc_id long, rid long, blob binary")
    zero = F.lit(0).cast("long")
    beside = lambda blocks: dealt(blocks.select("part", F.lit(0).alias("kind"), zero.alias("doc_id"), zero.alias("rid"), "blob").union(texts), "kind")

    found = dealt(rows.mapInArrow(_anchor_blocks(names), block)).mapInArrow(_repeated_blocks(names), block)
    runs = written(beside(found).mapInArrow(_runs(names, _range_cuts(rows, parts)), "kind int, " + block), "runs")
    spans = dealt(runs.filter("kind = 0").select("part", "blob")).mapInArrow(_merged(names), block)
    spans = spans.union(runs.filter("kind = 1").select("part", "blob"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return beside(spans).mapInArrow(_removed, schema)


@query()
def op8_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
