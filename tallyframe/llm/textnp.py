"""Words, hashes and token counts over the bytes of Arrow string batches, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass works on; a longer document is one pass of its own.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
# The bytes of white space that separate words (space, tab to carriage return).
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
# Every ASCII byte that is no letter or digit.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def row_chunks(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(int(np.searchsorted(at, at[first] + limit, "right")) - 1, first + 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a public finaliser with shifts and odd factors)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, at: np.ndarray, gaps: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes outside ``gaps``; ``at`` are row offsets into ``data``, beginning at 0."""
    inside = np.empty(len(data) + 1, bool)
    inside[:-1] = ~gaps[data]
    inside[-1] = False
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = inside[inner]
    starts = np.flatnonzero(first)
    last = inside[:-1] & ~inside[1:]
    last[inner - 1] = inside[inner - 1]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: byte codes of eight bytes at a time, so the loop is as long as the longest word / 8."""
    length = (ends - starts).astype(np.int64)
    out = length.astype(np.uint64) * BASE
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    live = np.arange(len(starts))
    step = 0
    while len(live):
        left = length[live] - 8 * step
        block = np.ascontiguousarray(wide[starts[live] + 8 * step]).view(np.uint64).ravel()
        short = left < 8
        keep = np.where(short, left, 8).astype(np.uint64) * np.uint64(8)
        mask = np.where(short, (np.uint64(1) << np.minimum(keep, np.uint64(63))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
        out[live] = mix((out[live] + (block & mask)) * BASE)
        live = live[left > 8]
        step += 1
    return out


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every window of ``size`` words; a row with fewer words gives its whole sequence as one."""
    counts = np.bincount(rows, minlength=n_rows)
    base = np.concatenate([[0], np.cumsum(counts)])
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.full(n, size, np.uint64)
    for k in range(min(size, n)):
        acc[: n - k] = mix((acc[: n - k] + hashes[k:]) * BASE)
    whole = base[rows] + counts[rows]
    full = np.arange(n) + size <= whole
    out, out_rows = acc[full], rows[full]
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        extra = []
        for r in few:
            h = np.full(1, counts[r], np.uint64)
            for x in hashes[base[r] : base[r + 1]]:
                h = mix((h + x) * BASE)
            extra.append(h[0])
        out = np.concatenate([out, np.array(extra, np.uint64)])
        out_rows = np.concatenate([out_rows, few])
    return out, out_rows


def distinct_per_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, joined, and the row offsets."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=n_rows))])


def shingle_sets(texts: pa.Array | pa.ChunkedArray, size: int = 5, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per range of rows: first row, last row, the rows' sorted distinct shingle hashes, and their offsets."""
    data, at = buffers(texts)
    for first, last in row_chunks(at, limit):
        part, own = LOWER[data[at[first] : at[last]]], at[first : last + 1] - at[first]
        starts, ends, rows = word_bounds(part, own)
        hashes = word_hashes(part, starts, ends)
        values, value_rows = shingle_hashes(hashes, rows, last - first, size)
        yield first, last, *distinct_per_row(values, value_rows, last - first)
