"""Seeded integer hash written the same in Spark and in ANSI SQL."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 1 << 60


def portable_hash(seed: int | Column, a: Column, b: Column | None = None) -> Column:
    """Hash below 2^60 of one or two integers: the first 15 hex digits of an MD5, so every bit depends on all input."""
    parts = [seed if isinstance(seed, Column) else F.lit(seed), a, F.lit(0) if b is None else b]
    text = F.concat_ws("|", *[F.coalesce(x.cast("long").cast("string"), F.lit("-")) for x in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def portable_hash_sql(seed, a: str, b: str = "0") -> str:
    parts = ", ".join(f"coalesce(CAST(CAST({x} AS BIGINT) AS VARCHAR), '-')" for x in (seed, a, b))
    return f"CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 15) AS BIGINT)"


def counting(n: int) -> Column:
    """The array 0, 1, ..., n-1 as 64-bit integers."""
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


# fixed values: constants, shifts and initial state of MD5; the last four digits of a number as a column each
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ENDS = np.stack([np.arange(10_000) // 10**i % 10 + ord("0") for i in (3, 2, 1, 0)]).astype(np.uint32)


def portable_hashes(seed: int, a: int, size: int) -> np.ndarray:
    """``portable_hash(seed, a, b)`` of b = 0, 1, ..., size-1, in arrays: for tasks that hash very many numbers in a row."""
    out = np.empty(size, dtype=np.uint64)
    head = f"{seed}|{a}|"
    for digits in (1, 2, 3, 4):
        low, high = 10 ** (digits - 1) if digits > 1 else 0, min(10**digits, size)
        if low < high:
            out[low:high] = _md5_start(head.encode(), _ENDS[4 - digits :, low:high])
    for begin in range(10_000, size, 10_000):
        out[begin : begin + 10_000] = _md5_start(f"{head}{begin // 10_000}".encode(), _ENDS[:, : size - begin])
    return out


def _md5_start(head: bytes, ends: np.ndarray) -> np.ndarray:
    """The first 60 bits of the MD5 of ``head`` followed by the characters in each column of ``ends``, 55 bytes at most."""
    size = len(head) + len(ends)
    words: list = list(struct.unpack("<16I", (head + bytes(len(ends)) + b"\x80").ljust(56, b"\0") + struct.pack("<Q", 8 * size)))
    for i, column in enumerate(ends, len(head)):
        words[i // 4] = words[i // 4] + (column << np.uint32(8 * (i % 4)))
    words = [np.uint32(w) if isinstance(w, int) else w for w in words]
    a, b, c, d = (np.full(ends.shape[1], x, dtype=np.uint32) for x in _STATE)
    free, other = np.empty_like(a), np.empty_like(a)
    for i, (sine, turn) in enumerate(zip(_SINES, _TURNS, strict=True)):
        f = free
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
        f += np.uint32(sine)
        np.right_shift(f, np.uint32(32 - turn), out=other)
        f <<= np.uint32(turn)
        f |= other
        f += b
        free, a, d, c, b = a, d, c, b, f
    first, second = (x + np.uint32(y) for x, y in ((a, _STATE[0]), (b, _STATE[1])))
    return first.byteswap().astype(np.uint64) << np.uint64(28) | second.byteswap().astype(np.uint64) >> np.uint64(4)
