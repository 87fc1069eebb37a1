r"""Hashes of the words [^\x20\x09-\x0D]+ of Arrow batches of texts, computed over whole byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: Bytes of a word whose weights are powers; those of further bytes are powers again, times a hash of how far they stand.
FOLD = 4096


def _pow(k: int, n: int) -> np.ndarray:
    if len(_powers[k]) < n:
        out = np.full(max(n, 64), np.uint64(_BASES[k]), np.uint64)
        out[0] = 1
        _powers[k] = np.multiply.accumulate(out)
    return _powers[k]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; nulls are empty texts."""
    arr = texts.cast(pa.large_string()).fill_null("")
    _, off, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def lower(buf: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z."""
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf)


#: Bytes of words: all but the six spaces; and of words without ASCII punctuation.
NOT_SPACE = np.array([not (i == 32 or 9 <= i <= 13) for i in range(256)])
LETTERS = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


def word_bounds(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are in a table, and how many each text has."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = table[buf]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True  # a text ends its last word
    first = word.copy()
    first[1:] &= ~word[:-1] | begins[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | begins[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from two polynomials of its bytes and its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    offset = np.arange(total) - np.repeat(first, lengths)
    data = buf[offset + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    longest = int(lengths.max())
    if longest > FOLD:
        far = np.flatnonzero(offset >= FOLD)
        data[far] *= mix((offset[far] // FOLD).astype(np.uint64)) | np.uint64(1)
        offset %= FOLD
    out = lengths.astype(np.uint64)
    for k in range(2):
        out = mix(out) + np.add.reduceat(data * _pow(k, min(longest, FOLD))[offset], first)
    return mix(out)


def chunks(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most `most` bytes together, or one row."""
    sizes = np.diff(utf8(batch.column(column))[1])
    ends, i = np.cumsum(sizes), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words of one text; a shorter text is one run, an empty one none."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        out = mix(out) + words[i : i + n]
    return mix(out)
