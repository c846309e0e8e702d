"""Repeated byte strings of ``LENGTH`` bytes or more, found with enhanced suffix arrays, and their removal.

How the work is divided: every window of LENGTH bytes has a minimiser, its SEED-byte string of least hash, and equal
windows have equal minimisers. Consecutive windows with one minimiser are a piece (its windows' bytes, bounded by
``MOST`` windows), so all copies of a window are in pieces under one key. Keys that one piece has alone are dropped
before any text moves; equal pieces become one with a count. What remains is grouped by key into blocks of bounded
size. A block's suffixes (those that start a window) get an enhanced suffix array: windows are classed by a rolling
hash, only suffixes whose class differs in the byte to the left can begin a maximal repeat, these are sorted with
their common-prefix lengths, and a stack scan lists the intervals of the common-prefix tree of depth LENGTH or more.
An interval whose left bytes differ is a maximal repeat; all suffixes of the interval are its occurrences. Pieces of
one key beyond a block are dealt to several, and their window classes are compared across blocks by hash.

Defined results: a null text is empty. Repeated rows are copies of each other, so all their bytes go if there are
LENGTH or more. Texts below LENGTH bytes keep all. Texts may be long: memory is bounded by the longest text and the
block. An empty table gives an empty result. Other columns are ignored by ``spans`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemweave.llm.texts import U64, WORD_BYTES, flat, prefix_hashes, ragged, range_hashes, slices, word_codes
from stemweave.plans.durable import scratch, written

LENGTH = 400
WORDS = 51
SEED = 64
MOST = 1024  # windows of a piece
BLOCK = 256 << 10  # bytes of pieces in a block
SLOT_SHIFT = U64(56)  # of a window's hash: what is above names its slot
PLACE_BITS = U64(30)  # of a place within a slice, below the bits of the hash that order minimisers


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, in three passes whatever the width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces_of(data: np.ndarray, at: np.ndarray, length: int = LENGTH, seed: int = SEED, most: int = MOST) -> tuple[np.ndarray, ...]:
    """Pieces of texts: text number, key, first window (in the text), number of windows, seed twice inside."""
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none, none.astype(bool)
    prefix = prefix_hashes(data)
    places = np.arange(n - seed + 1)
    hashed = range_hashes(prefix, places, places + seed)
    order = hashed >> PLACE_BITS << PLACE_BITS
    low = (U64(1) << PLACE_BITS) - U64(1)
    width = length - seed + 1
    left = (sliding_min(order | places.astype(np.uint64), width) & low).astype(np.int64)
    right = (low - (sliding_min(order | (low - places.astype(np.uint64)), width) & low)).astype(np.int64)
    key = hashed[left]
    sizes = np.diff(at)
    windows = np.maximum(sizes - length + 1, 0)
    begin = np.concatenate([[0], np.cumsum(windows)])
    text = np.repeat(np.arange(len(sizes)), windows)
    start = np.arange(begin[-1]) - begin[text]  # of each window in its text
    where = start + at[text]
    key, left, right = key[where], left[where], right[where]
    if not len(key):
        return none, key, none, none, none.astype(bool)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(key)]]))
    parts = -(-count // most)  # long runs are cut
    cut = np.repeat(first, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    end = np.minimum(cut + most, np.repeat(first + count, parts))
    return text[cut], key[cut], start[cut], end - cut, (left[cut] != right[end - 1]) | (np.repeat(parts, parts) > 1)


def maximal_repeats(pieces: list[bytes], windows: list[int], length: int = LENGTH) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Suffixes in order as (piece, offset), the repeat length of each, the maximal repeats as (length, first, last)
    over that order, and the hash class of every window with the windows' places.

    A suffix's repeat length is that of the longest maximal repeat that it is an occurrence of, or 0.
    """
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    base = np.concatenate([[0], np.cumsum(sizes)])
    count = np.array(windows)
    piece = np.repeat(np.arange(len(pieces)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = base[piece] + offset
    fingerprint = range_hashes(prefix_hashes(data), place, place + length)
    _, classes, members = np.unique(fingerprint, return_inverse=True, return_counts=True)
    left = np.where(offset > 0, data[place - 1].astype(np.int64), -1 - piece)  # a piece's first byte has any byte before it
    lowest = np.full(len(members), np.iinfo(np.int64).max)
    highest = np.full(len(members), np.iinfo(np.int64).min)
    np.minimum.at(lowest, classes, left)
    np.maximum.at(highest, classes, left)
    diverse = (members > 1) & ((lowest != highest) | (lowest < 0))
    chosen = np.flatnonzero(diverse[classes])
    suffixes = sorted((pieces[p][o:], p, o, b) for p, o, b in zip(piece[chosen].tolist(), offset[chosen].tolist(), left[chosen].tolist(), strict=True))
    n = len(suffixes)
    common = [0] * (n + 1)
    for i in range(1, n):
        common[i] = _common(suffixes[i - 1][0], suffixes[i][0], length)
    lefts = np.array([s[3] for s in suffixes], dtype=np.int64)
    changes = np.concatenate([[0, 0], np.cumsum(lefts[1:] != lefts[:-1])]) if n else np.zeros(1, dtype=np.int64)
    found = []
    stack: list[tuple[int, int]] = []  # (depth, first suffix)
    for i in range(1, n + 1):
        first = i - 1
        while stack and stack[-1][0] > common[i]:
            depth, first = stack.pop()
            if changes[i] != changes[first + 1] or lefts[first] < 0:
                found.append((depth, first, i - 1))
        if common[i] >= length and (not stack or stack[-1][0] < common[i]):
            stack.append((common[i], first))
    longest = [0] * n
    for depth, first, last in sorted(found):
        longest[first : last + 1] = [depth] * (last + 1 - first)
    return [(p, o) for _, p, o, _ in suffixes], longest, found, fingerprint, np.stack([piece, offset])


def _common(a: bytes, b: bytes, least: int) -> int:
    """Length of the common prefix, or 0 when it is below ``least``."""
    if a[:least] != b[:least] or len(a) < least or len(b) < least:
        return 0
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, dtype=np.uint8, count=n), np.frombuffer(b, dtype=np.uint8, count=n)
    return int(np.argmax(x != y))


class Unit(NamedTuple):
    """What repeats are made of: bytes, or words that stand for ``WORD_BYTES`` bytes of their hashes each."""

    size: int = 1
    length: int = LENGTH

    @property
    def window(self) -> int:
        return self.size * self.length

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return flat(column) if self.size == 1 else word_codes(*flat(column))[:2]


def words_of_length(n: int) -> Unit:
    return Unit(WORD_BYTES, n)


def _scan(stored: DataFrame, unit: Unit) -> DataFrame:
    """(row, n_bytes, size, sha, pieces) of stored (row, text); size is the number of units, a piece has its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                data, at = flat(part.column(1))
                whole = data.tobytes()
                sha = [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                units, to = unit.of(part.column(1))
                text, key, start, count, twice = pieces_of(units, to, unit.window)
                begin = np.searchsorted(text, np.arange(part.num_rows + 1))
                first = to[text] + start
                pid = range_hashes(prefix_hashes(units), first, first + count + unit.window - 1) if len(text) else np.zeros(0, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at)), pa.array(np.diff(to) // unit.size), pa.array(sha), ragged(key.view(np.int64), begin, pa.int64()),
                     ragged(start, begin, pa.int32()), ragged(count, begin, pa.int32()), ragged(twice, begin, pa.bool_()), ragged(pid.view(np.int64), begin, pa.int64())],
                    names=["row", "n_bytes", "size", "sha", "key", "start", "count", "twice", "pid"],
                )

    return stored.select("row", "text").mapInArrow(run, "row long, n_bytes long, size long, sha string, key array<long>, start array<int>, count array<int>, twice array<boolean>, pid array<long>")


def _texts(candidates: DataFrame, stored: DataFrame, unit: Unit) -> DataFrame:
    """Pieces with their bytes: (key, count, pid, piece); ``candidates`` has a list of places per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                columns: list[list] = [[], [], [], []]
                data, at = unit.of(part.column(1))
                whole = data.tobytes()
                for places, base in zip(part.column(0).to_pylist(), at.tolist(), strict=False):
                    for p in places:
                        begin = base + p["start"]
                        for values, value in zip(columns, (p["key"], p["count"], p["pid"], whole[begin : begin + p["count"] + unit.window - 1]), strict=True):
                            values.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["key", "count", "pid", "piece"])

    whole = candidates.join(stored.select("row", "text"), "row").select("places", "text")
    return whole.mapInArrow(run, "key long, count int, pid long, piece binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int, bool]], list[int], list[int], list[bytes]]]:
    """Sorted pieces in blocks that hold whole groups: their (key, lane, dealt), ids, windows, bytes."""
    heads: list[tuple[int, int, bool]] = []
    rest: tuple[list, list, list] = ([], [], [])
    held = 0
    for batch in batches:
        for key, lane, dealt, pid, count, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            head = (key, lane, dealt)
            if held >= BLOCK and head != heads[-1]:
                yield heads, *rest
                heads, rest, held = [], ([], [], []), 0
            heads.append(head)
            for values, value in zip(rest, (pid, count, piece), strict=True):
                values.append(value)
            held += len(piece)
    if heads:
        yield heads, *rest


def _groups(suffixes: list[tuple[int, int]], found: list[tuple[int, int, int]], pids: list[int]) -> pa.RecordBatch:
    """The maximal repeats of a block: (group, length, pid, begin), a row per occurrence."""
    rows = [(n, depth, pids[p], o) for n, (depth, first, last) in enumerate(found) for p, o in suffixes[first : last + 1]]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["group", "length", "pid", "begin"])


RANGES, CLASSES = "array<struct<begin:int,end:int>>", "array<struct<fingerprint:long,pid:long,begin:int>>"


def _outermost(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that lie in no other."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(hits, key=lambda h: (h[0], -h[1])):
        if not out or end > out[-1][1]:
            out.append((begin, end))
    return out


def _packed(columns: dict[str, tuple[list | np.ndarray, pa.DataType]], at: np.ndarray) -> pa.Array:
    """A list of structs per row; row i has the entries from ``at[i]`` to ``at[i + 1]``."""
    entries = pa.StructArray.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), entries)


def _repeats(pieces: DataFrame, length: int) -> DataFrame:
    """One row per piece with occurrences of maximal repeats, (key, pid, ranges), and for dealt keys a row per block and slot
    of hashes, (key, slot, classes), with the block's window classes; a class's pid is null if the block has it more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "pid", "ranges", "slot", "classes"]
        no_ranges, no_classes = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("fingerprint", pa.int64()), ("pid", pa.int64()), ("begin", pa.int32())]))
        for heads, pids, windows, texts in _blocks(batches):
            suffixes, longest, _, fingerprint, (piece, offset) = maximal_repeats(texts, windows, length)
            hits: dict[int, list[tuple[int, int]]] = {}
            for (p, o), n in zip(suffixes, longest, strict=True):
                if n:
                    hits.setdefault(p, []).append((o, o + n))
            kept = [_outermost(h) for h in hits.values()]
            at = np.concatenate([[0], np.cumsum([len(k) for k in kept])])
            ranges = _packed({"begin": ([x for k in kept for x, _ in k], pa.int32()), "end": ([x for k in kept for _, x in k], pa.int32())}, at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([heads[p][0] for p in hits], pa.int64()), pa.array([pids[p] for p in hits], pa.int64()), ranges, pa.nulls(len(hits), pa.int32()), pa.nulls(len(hits), no_classes)], names=names)
            dealt = np.array([h[2] for h in heads])[piece]
            if dealt.any():
                piece, offset, fingerprint = piece[dealt], offset[dealt], fingerprint[dealt]
                keys, own = np.array([h[0] for h in heads]), np.array(pids)
                values, where, members = np.unique(fingerprint, return_index=True, return_counts=True)
                slot = (values >> SLOT_SHIFT).astype(np.int64)
                order = np.lexsort((slot, keys[piece[where]]))
                values, where, members, slot = values[order], where[order], members[order], slot[order]
                key = keys[piece[where]]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])]))
                pid = pa.array(own[piece[where]], pa.int64(), mask=members > 1)
                classes = _packed({"fingerprint": (values.view(np.int64), pa.int64()), "pid": (pid, pa.int64()), "begin": (offset[where], pa.int32())}, np.append(first, len(values)))
                yield pa.RecordBatch.from_arrays([pa.array(key[first], pa.int64()), pa.nulls(len(first), pa.int64()), pa.nulls(len(first), no_ranges), pa.array(slot[first], pa.int32()), classes], names=names)

    return _arranged(pieces).mapInArrow(run, f"key long, pid long, ranges {RANGES}, slot int, classes {CLASSES}")


def _across(found: DataFrame, length: int) -> DataFrame:
    """(key, pid, begin, end) of windows whose class several blocks of one key have; the classes of a slot meet in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for i, head in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if held and head != last:
                    yield shared(last[0], held)
                    held = []
                last = head
                held.append(batch.column(2)[i].values)
        if held:
            yield shared(last[0], held)

    def shared(key: int, blocks: list[pa.StructArray]) -> pa.RecordBatch:
        values = np.concatenate([b.field("fingerprint").to_numpy() for b in blocks])
        _, group, members = np.unique(values, return_inverse=True, return_counts=True)
        entries = pa.concat_arrays(blocks).filter(pa.array(members[group] > 1))
        entries = entries.filter(entries.field("pid").is_valid())
        found = _packed({"pid": (entries.field("pid"), pa.int64()), "begin": (entries.field("begin"), pa.int32())}, np.array([0, len(entries)]))
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), found], names=["key", "windows"])

    slots = found.filter("slot IS NOT NULL").select("key", "slot", "classes").repartition("key", "slot").sortWithinPartitions("key", "slot")
    windows = slots.mapInArrow(run, "key long, windows array<struct<pid:long,begin:int>>").select("key", F.explode("windows").alias("w"))
    return windows.select("key", "w.pid", "w.begin", (F.col("w.begin") + length).alias("end"))


def _arranged(pieces: DataFrame) -> DataFrame:
    return pieces.select("key", "lane", "dealt", "pid", "count", "piece").repartition("key", "lane").sortWithinPartitions("key", "lane")


def _placed(stored: DataFrame, unit: Unit, scanned: DataFrame, same: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places (row, start, key, pid) of pieces with a repeat, the distinct pieces (key, pid, count, n), and those with
    bytes that have to be searched, dealt to blocks. A piece is known by its key and hash from the start, and of equal
    pieces the bytes of one travel; a key with one distinct piece, none of it twice inside, is not searched at all."""
    firsts = scanned.join(same.select(F.col("first").alias("row")), "row", "left_semi")
    runs = firsts.select("row", F.explode(F.arrays_zip("key", "start", "count", "twice", "pid")).alias("p")).select("row", "p.*")
    many = written(runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("any")).filter("n > 1 OR any").select("key"), "keys")
    places = written(runs.join(many, "key", "left_semi"), "places")
    one = F.min(F.struct("row", "start", "count")).alias("at")
    distinct = written(places.groupBy("key", "pid").agg(one, F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice")), "distinct")
    searched = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("twice").alias("any"), F.sum(F.col("at.count") + unit.window - 1).alias("bytes")).filter("m > 1 OR any")
    searched = written(searched.select("key", F.ceil(F.col("bytes") / BLOCK).alias("lanes")), "searched")
    wanted = distinct.join(searched, "key", "left_semi").groupBy(F.col("at.row").alias("row")).agg(F.collect_list(F.struct("key", "at.start", "at.count", "pid")).alias("places"))
    dealt = _texts(wanted, stored, unit).join(searched, "key").select(
        "key", "pid", "count", "piece", (F.col("lanes") > 1).alias("dealt"), F.pmod(F.xxhash64("pid"), F.col("lanes")).alias("lane"))
    return places, distinct, dealt


def find(stored: DataFrame, unit: Unit = Unit()) -> tuple[DataFrame, DataFrame]:
    """Of stored (row, text): (row, n_bytes, size, sha, copies, first) of every row, and (row, begin, end) ranges of units that
    are covered by repeats, for the first row of each text. Ranges may overlap; texts with copies are repeated whole."""
    scanned = written(_scan(stored, unit), "scanned")
    same = written(scanned.groupBy("sha").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")), "same")
    places, distinct, dealt = _placed(stored, unit, scanned, same)
    found = written(_repeats(dealt, unit.window), "repeats")
    inside = found.filter("slot IS NULL").select("key", "pid", F.explode("ranges").alias("r")).select("key", "pid", "r.begin", "r.end")
    across = _across(found, unit.window)
    whole = distinct.filter("n > 1").select("key", "pid", F.lit(0).alias("begin"), (F.col("at.count") + unit.window - 1).alias("end"))
    marks = inside.unionByName(across).unionByName(whole)
    ranges = places.select("row", "start", "key", "pid").join(marks, ["key", "pid"]).select("row", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end")).alias("end"))
    # whole units only, and enough of them: a hash may agree in part
    ranges = ranges.select("row", F.ceil(F.col("begin") / unit.size).cast("int").alias("begin"), F.floor(F.col("end") / unit.size).cast("int").alias("end"))
    return scanned.select("row", "n_bytes", "size", "sha").join(same, "sha"), ranges.filter(F.col("end") - F.col("begin") >= unit.length)


def maximal_repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """All maximal repeats of ``length`` bytes or more, each with every occurrence: (group, length, id, row, begin), ``row``
    telling equal ids apart. A repeat is maximal among the windows with its minimiser: at that stretch of the text it cannot
    be longer on either side and keep its occurrences.

    Copies of a text count once (``row`` is the first of them), pieces that occur in several places once for each place.
    A key's pieces stay in one block here, as a group needs all its occurrences: memory follows the distinct pieces
    around one minimiser, however often they occur.
    """
    unit = Unit(1, length)
    stored = written(_rows(docs, id_col, text_col), "docs")
    scanned = written(_scan(stored, unit), "scanned")
    same = written(scanned.groupBy("sha").agg(F.min("row").alias("first")), "same")
    places, distinct, dealt = _placed(stored, unit, scanned, same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for heads, pids, windows, texts in _blocks(batches):
            begin = 0
            while begin < len(heads):  # a group is named by its key, so keys are searched one by one
                end = begin
                while end < len(heads) and heads[end][0] == heads[begin][0]:
                    end += 1
                suffixes, _, found, *_ = maximal_repeats(texts[begin:end], windows[begin:end], length)
                batch = _groups(suffixes, found, pids[begin:end])
                yield batch.append_column("key", pa.array([heads[begin][0]] * batch.num_rows, pa.int64()))
                begin = end

    whole = _arranged(dealt.withColumn("lane", F.lit(0).cast("long"))).mapInArrow(run, "group long, length int, pid long, begin int, key long")
    # a key with one distinct piece was not searched: the piece itself is its repeat
    alone = distinct.join(dealt.select("key").distinct(), "key", "left_anti").filter("n > 1").select(
        F.lit(0).cast("long").alias("group"), (F.col("at.count") + length - 1).cast("int").alias("length"), "pid", F.lit(0).alias("begin"), "key")
    named = whole.unionByName(alone).join(places.select("row", "start", "key", "pid"), ["key", "pid"]).join(stored.select("row", "id"), "row")
    return named.select(F.concat_ws("-", F.hex("key"), "group").alias("group"), "length", F.col("id").alias(id_col), "row", (F.col("start") + F.col("begin")).alias("begin"))


def merged(ranges: list[dict], size: int) -> list[tuple[int, int]]:
    """Disjoint, non-adjacent ranges in order."""
    out: list[list[int]] = []
    for r in sorted((r["begin"], min(r["end"], size)) for r in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append([*r])
    return [(a, b) for a, b in out]


def _cut(ranges: DataFrame, stored: DataFrame, unit: Unit, whole_characters: bool) -> DataFrame:
    """(row, removed, n_spans, kept_sha, text) of the rows that have ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                out: list[tuple] = []
                data, at = flat(part.column(2))
                _, to, begins, ends = word_codes(data, at) if unit.size > 1 else (None, at, None, None)
                whole = data.tobytes()
                for k, (row, found) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    text = whole[at[k] : at[k + 1]]
                    if unit.size == 1:
                        spans = merged(found, len(text))
                    else:  # from the first byte of the first word to the last byte of the last
                        first = to[k] // unit.size
                        spans = [(int(begins[first + a] - at[k]), int(ends[first + b - 1] - at[k])) for a, b in merged(found, (to[k + 1] - to[k]) // unit.size)]
                    if whole_characters:  # a character that is cut stays
                        spans = [(_up(text, a), _down(text, b)) for a, b in spans]
                    edges = [0, *[x for s in spans for x in s], len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((row, len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8") if whole_characters else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                    names=["row", "removed", "n_spans", "kept_sha", "text"],
                )

    listed = ranges.groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    return listed.join(stored.select("row", "text"), "row").select("row", "ranges", "text").mapInArrow(run, "row long, removed long, n_spans long, kept_sha string, text string")


def _up(text: bytes, at: int) -> int:
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def _down(text: bytes, at: int) -> int:
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))


def _covered(ranges: DataFrame) -> DataFrame:
    """(row, covered): units that the ranges of a row cover together, by the gaps between them in order."""
    ordered = F.sort_array(F.collect_set(F.struct("begin", "end")))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))
    step = lambda a, r: F.struct((a.total + F.greatest(r.end - F.greatest(r.begin, a.upto), F.lit(0))).alias("total"), F.greatest(a.upto, r.end).alias("upto"))
    return ranges.groupBy("row").agg(ordered.alias("r")).select("row", F.aggregate("r", start, step).total.cast("long").alias("covered"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """One row per document: bytes, bytes removed, maximal removed runs, SHA-256 of what is left; and how many of its
    words are covered by strings of ``words`` words that also start anywhere else (``repeated``: any), whatever their bytes."""
    with scratch(docs.sparkSession) as tables:
        stored = written(_rows(docs, id_col, text_col), "docs")
        rows, ranges = find(stored, Unit(1, length))
        cut = _cut(ranges, stored, Unit(1, length), whole_characters=False).drop("text")
        gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
        joined = tables.keep(written(rows.join(cut, "row", "left").join(stored.select("row", "id"), "row").select(
            "row", F.col("id").alias(id_col), "n_bytes", "first", "copies",
            F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(gone, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        ), "spans"))
        tables.keep(stored)
    with scratch(docs.sparkSession) as tables:
        sizes, ranges = find(stored, words_of_length(words))
        whole = (F.col("copies") > 1) & (F.col("size") >= words)
        covered = sizes.join(_covered(ranges), "row", "left").select(
            "row", F.when(whole, F.col("size")).otherwise(F.coalesce("covered", F.lit(0))).cast("long").alias("n_repeated_words"))
        covered = tables.keep(written(covered, "covered"))
    return joined.drop("first", "copies").join(covered, "row").drop("row").withColumn("repeated", F.col("n_repeated_words") > 0)


def without_repeats(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", unit: Unit = Unit()) -> DataFrame:
    """The documents with repeated ranges of bytes or words taken out of their texts (to whole characters, so texts stay
    valid) and their number of characters counted anew; those of which nothing but spaces is left go."""
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.monotonically_increasing_id().alias("row"))
    with scratch(docs.sparkSession) as tables:
        stored = tables.keep(written(whole, "docs")).withColumn("text", F.col("_row").getField(text_col))
        with scratch(docs.sparkSession) as search:  # its tables go before the texts are cut
            rows, ranges = find(stored, unit)
            ranges = search.keep(written(ranges.distinct(), "ranges"))
            gone = (F.col("copies") > 1) & (F.col("size") >= unit.length)
            fate = tables.keep(search.keep(written(rows.filter(gone).select("row"), "gone")))
        cut = tables.keep(written(_cut(ranges, stored, unit, whole_characters=True).select("row", F.col("text").alias("rest")), "cut"))
    left = stored.join(fate, "row", "left_anti").join(cut, "row", "left")
    text = F.when(F.col("rest").isNotNull(), F.col("rest")).otherwise(F.col("text"))
    final = left.withColumn("_text", text).filter(F.col("rest").isNull() | F.col("rest").rlike(r"[^\x20\x09-\x0D]"))
    value = {text_col: F.col("_text"), chars_col: F.when(F.col("rest").isNotNull(), F.length("_text").cast(docs.schema[chars_col].dataType)).otherwise(F.col("_row").getField(chars_col))} if chars_col in names else {text_col: F.col("_text")}
    return final.select(*[value.get(c, F.col("_row").getField(c)).alias(c) for c in names])
