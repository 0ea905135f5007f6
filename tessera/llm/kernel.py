"""Vectorised text kernels shared by the corpus operators.

Text reaches Python as Arrow string columns.  Everything here works on the
column's raw UTF-8 buffer with numpy, so no Python object is made per word.

A *token* is a maximal run of ASCII letters and digits and of bytes above 127.
ASCII letters and the two-byte letters U+00C0..U+00DE (but U+00D7) are folded
to lower case, which for Latin text equals ``lower()``.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[48:58] = _IS_TOKEN[65:91] = _IS_TOKEN[97:123] = _IS_TOKEN[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_STEP = U(0xD6E8FEB86659FD93)
#: Text bytes handled at once; one document may be longer.
CHUNK_BYTES = 1 << 21


def tidy() -> None:
    """Gives unused memory back to the system; Spark keeps Python workers for later stages, which need not pay for it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable) -> Callable:
    """A function of batches that tidies up behind its last one."""

    @functools.wraps(run)
    def tidy_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return tidy_run


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


_POWERS = _powers(_BASE, 256)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about CHUNK_BYTES; nulls are empty."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    first = 0
    for part in parts:
        part = part.cast(pa.large_string())
        n = len(part)
        if not n:
            continue
        _, off, data = part.buffers()
        offsets = np.frombuffer(off, np.int64)[part.offset : part.offset + n + 1]
        text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        if part.null_count:
            sizes = np.where(part.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            if int(sizes.sum()) != int(offsets[-1] - offsets[0]):
                part = part.fill_null("")
                part = pa.concat_arrays([part])
                _, off, data = part.buffers()
                offsets = np.frombuffer(off, np.int64)[part.offset : part.offset + n + 1]
                text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
            j = min(j, n)
            yield first + i, text[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        first += n


def tokens(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, index of the first token of each row and the number of tokens)."""
    n = len(text)
    none = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    inside = _IS_TOKEN[text]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    start[at] = inside[at]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    end[last] = inside[last]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    rows = np.searchsorted(a, offsets)
    if not len(a):
        return np.zeros(0, U), a, b, rows
    folded = _FOLD[text]
    lead = np.flatnonzero(text[:-1] == 0xC3)
    if len(lead):
        low = text[lead + 1]
        lead = lead[(low >= 0x80) & (low <= 0x9E) & (low != 0x97)]
        folded[lead + 1] += 32
    size = b - a
    width = int(size.max())
    powers = _POWERS if width <= len(_POWERS) else _powers(_BASE, width)
    where = np.flatnonzero(inside)
    ends = np.cumsum(size)
    within = np.arange(len(where)) - np.repeat(ends - size, size)
    h = np.add.reduceat((folded[where].astype(U) + U(1)) * powers[within], ends - size)
    return mix(h + size.astype(U)), a, b, rows


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n tokens from each position on; len(h) - n + 1 of them, row ends ignored.

    Grows by doubling: a window of 2m is two windows of m.
    """
    if len(h) < n:
        return np.zeros(0, U)
    done, out = 1, h
    while done < n:
        step = min(done, n - done)
        k = len(h) - done - step + 1
        out = mix(out[:k] * _STEP + out[step : step + k] + U(done + step))
        done += step
    return out


def gram_rows(rows: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose n tokens lie within one row, and that row."""
    counts = np.maximum(np.diff(rows) - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + rows[row]
    return pos, row


def distinct(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes sorted and made distinct within each row, and the offsets of the rows."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[keep], h[keep]
    return h, np.searchsorted(row, np.arange(n_rows + 1))


def often(hashes: list[np.ndarray], contents: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that occur at least so many times and once per thousand contents, and how often they do."""
    h, count = np.unique(np.concatenate([np.zeros(0, U), *hashes]), return_counts=True)
    many = count >= max(least, contents // 1000)
    return h[many], count[many]


def hash_words(words: list[str]) -> np.ndarray:
    """Token hashes of given single tokens, as tokens() makes them."""
    column = pa.array(words, pa.large_string())
    out = np.zeros(len(words), U)
    for first, text, offsets in chunks(column):
        h, _, _, rows = tokens(text, offsets)
        has = np.diff(rows) > 0
        out[first : first + len(has)][has] = h[rows[:-1][has]]
    return out
