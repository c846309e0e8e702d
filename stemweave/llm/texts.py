"""Whole texts of Arrow batches as byte arrays: words, their hashes and slices of bounded size. Small numpy helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE_TABLE = np.zeros(256, dtype=bool)
SPACE_TABLE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash factor and of its inverse, modulo 2^64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _FACTOR, dtype=np.uint64)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _INVERSE, dtype=np.uint64)]), dtype=np.uint64)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 places where texts begin; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``most`` bytes of text each, or a single longer row."""
    sizes = np.diff(flat(batch.column(batch.schema.get_field_index(text)))[1])
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > most and i > begin:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and for each text the number of words before it (n + 1 values)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(at), dtype=np.int64)
    letter = ~SPACE_TABLE[data]
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    full = np.diff(at) > 0
    first, last = at[:-1][full], at[1:][full] - 1
    begins[first] = letter[first]
    ends[last] = letter[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, at)


WORD_BYTES = 4


def word_codes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with every word replaced by ``WORD_BYTES`` bytes of its hash, as ``flat`` gives them; begin and end of the words."""
    start, end, first = word_spans(data, at)
    codes = range_hashes(prefix_hashes(data), start, end) if len(start) else np.zeros(0, dtype=np.uint64)
    return (codes >> U64(32)).astype(np.uint32).view(np.uint8), first * WORD_BYTES, start, end


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Cumulative hash of the bytes before each place; differences give the hash of any range."""
    power, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * power[:-1], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal ranges have equal hashes wherever they stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] ^ mix((end - start).astype(np.uint64)))


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of each text, and the number of them before each text.

    A text of fewer words, but at least one, has one shingle of all its words.
    """
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    if not begin[-1]:
        return np.zeros(0, dtype=np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    short = np.repeat(np.minimum(n, size), count)
    out = np.zeros(begin[-1], dtype=np.uint64)
    for j in range(size):
        has = short > j
        out[has] = mix(out[has] * U64(_FACTOR) + words[at[has] + j]) if not has.all() else mix(out * U64(_FACTOR) + words[at + j])
    return out, begin


def ragged(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of the values, cut at ``begin``."""
    return pa.LargeListArray.from_arrays(pa.array(begin, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))


def words_of(column: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of the texts, the code of each word in order, and the number of words before each text.

    Words are told apart by 64-bit hashes; within one slice of texts two words meet with a chance below 10^-7.
    """
    data, at = flat(column)
    start, end, first = word_spans(data, at)
    if lower:
        data = LOWER_TABLE[data]
    _, where, codes = np.unique(range_hashes(prefix_hashes(data), start, end), return_index=True, return_inverse=True)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)], codes, first
