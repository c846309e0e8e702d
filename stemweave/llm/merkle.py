"""Merkle dataset manifest: trees of SHA-256 whose parents keep the hash states from before each child.

A child enters its parent as 64 hex digits, which is one block of SHA-256, so the state before a child slot is eight
32-bit words and can be stored. ``trees`` cuts every group's leaves (in order of id) into chunks of a bounded number
of nodes, hashes each chunk's levels in one task and writes a row per chunk: the digests of its levels and, of every
parent, the states before each of its slots. The chunks' top digests are the nodes of the next round, so there are
logarithmically many rounds, and the groups' tops are the leaves of one more such tree, whose top is the root.
``fold`` puts another digest in the place of a leaf and goes up: at each parent it resumes the state before the leaf's
slot, hashes the replacement and the siblings to the right, and never needs what stands to the left.

Places come from range partitions and per-partition counts, so a group with most of the rows is many chunks like any
other. Only one chunk (``Shape.span`` nodes) is ever in a task at once.

Defined results: null values are ``-`` in a leaf; the null group is a group of its own, before the others. Ids may be
null (first) or repeat: rows of one id are in order of their leaf's digest. A group of one leaf has that leaf as its
top. An empty table gives an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.plans.durable import written
from stemweave.plans.skew import attach_groups, attach_scalars, grouped_rank

WORD = np.uint32
PATH = "states array<binary>, slots array<int>, siblings array<binary>"
CHUNK_ROW = "g long, chunk long, n long, digests array<binary>, states array<binary>, top binary"


# --- SHA-256 on columns of numbers: a state is 8 rows, a block 16 rows, one column per message ---------------------


def _cube_root(x: int) -> int:
    r = round(x ** (1 / 3))
    while r**3 > x:
        r -= 1
    while (r + 1) ** 3 <= x:
        r += 1
    return r


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]
ROUND = [WORD(_cube_root(p << 96) & 0xFFFFFFFF) for p in _PRIMES]
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], dtype=WORD)[:, None]
_DIGIT = np.frombuffer(b"0123456789abcdef", dtype=np.uint8).astype(WORD)
_SHORT = np.arange(1 << 16)
#: Four hex digits of a 16-bit number, as one word.
HEX = sum(_DIGIT[(_SHORT >> (4 * i)) & 15] << WORD(8 * i) for i in range(4)).astype(WORD)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> WORD(n)) | (x << WORD(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states after one more block."""
    w = list(block)
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + w[i - 7] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> WORD(3))) + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> WORD(10))))
    a, b, c, d, e, f, g, h = state
    for k, x in zip(ROUND, w, strict=True):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & (f ^ g)) ^ g) + k + x
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return np.stack(np.broadcast_arrays(a, b, c, d, e, f, g, h)) + state


def hexed(digests: np.ndarray) -> np.ndarray:
    """The block that a digest's 64 hex digits are."""
    return np.stack([half for word in digests for half in (HEX[word >> WORD(16)], HEX[word & WORD(0xFFFF)])])


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of ``blocks`` whole blocks."""
    last = np.zeros((16, len(blocks)), dtype=WORD)
    last[0] = 0x80000000
    bits = blocks.astype(np.uint64) * np.uint64(512)
    last[14], last[15] = (bits >> np.uint64(32)).astype(WORD), bits.astype(WORD)
    return compress(state, last)


def pack(words: np.ndarray) -> bytes:
    """Columns of words one after the other."""
    return np.ascontiguousarray(words.T).astype(">u4").tobytes()


def digests_of(words: np.ndarray) -> pa.Array:
    """A binary column with one digest a row."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), words.shape[1], [None, pa.py_buffer(pack(words))]).cast(pa.binary())


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=">u4").reshape(-1, 8).T).astype(WORD)


# --- one chunk -----------------------------------------------------------------------------------------------------


def depth(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def grow(nodes: np.ndarray, fanout: int, levels: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests of each level from ``nodes`` up, and of each level the states (fanout x 8 x parents) before the slots."""
    digests, states = [nodes], []
    for _ in range(levels):
        below = digests[-1]
        n = below.shape[1]
        parents = -(-n // fanout)
        state, before = np.repeat(START, parents, axis=1), []
        for slot in range(fanout):
            before.append(state)
            child = np.arange(parents) * fanout + slot
            there = child < n
            state = np.where(there, compress(state, hexed(below[:, np.minimum(child, n - 1)])), state)
        states.append(np.stack(before))
        digests.append(finish(state, np.minimum(fanout, n - np.arange(parents) * fanout)))
    return digests, states


class Fold:
    """Replacements on their way up, and the running hash of the siblings that they pass."""

    def __init__(self, replacement: np.ndarray) -> None:
        self.digest = replacement
        self.seen = np.repeat(START, replacement.shape[1], axis=1)
        self.passed = np.zeros(replacement.shape[1], dtype=np.int64)

    def level(self, at: np.ndarray, below: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Through the parents of nodes ``at`` of a level; gives the parents' places."""
        fanout, n = len(states), below.shape[1]
        parent, slot = at // fanout, at % fanout
        state = compress(states[slot, :, parent].T, hexed(self.digest))
        for other in range(fanout):
            child = parent * fanout + other
            there, block = (child < n) & (other != slot), hexed(below[:, np.minimum(child, n - 1)])
            right = there & (other > slot)
            if right.any():
                state = np.where(right, compress(state, block), state)
            if there.any():
                self.seen = np.where(there, compress(self.seen, block), self.seen)
            self.passed += there
        self.digest = finish(state, np.minimum(fanout, n - parent * fanout))
        return parent

    def path(self, states: list[bytes], slots: list[int], siblings: list[bytes]) -> None:
        """On along a path that all replacements share."""
        for state, slot, others in zip(states, slots, siblings, strict=True):
            blocks = [hexed(w[:, None]) for w in unpack(others).T]
            at = compress(unpack(state), hexed(self.digest))
            for block in blocks[slot:]:
                at = compress(at, block)
            for block in blocks:
                self.seen = compress(self.seen, block)
            self.passed += len(blocks)
            self.digest = finish(at, np.full(self.digest.shape[1], len(blocks) + 1))

    def proof(self) -> np.ndarray:
        return finish(self.seen, self.passed)


# --- trees as tables -----------------------------------------------------------------------------------------------


def value_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 (32 bytes) of the values' texts in a row."""
    return F.unhex(F.sha2(F.concat(*[value_text(v) for v in values]).cast("binary"), 256))


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves(id, grp, leaf, ...)`` with the number g of the group, its leaves n, and the place pos in it."""
    groups = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    numbered = grouped_rank(groups, [], [F.col("grp").asc_nulls_first()], "g")
    known = attach_groups(leaves, numbered.withColumn("g", F.col("g") - 1), ["grp"])
    return grouped_rank(known, ["g"], [F.col("id").asc_nulls_first(), F.col("leaf")], "pos").withColumn("pos", F.col("pos") - 1)


class Shape(NamedTuple):
    """Children of a parent, and the levels of a whole chunk."""

    fanout: int = 2
    levels: int = 12

    @property
    def span(self) -> int:
        """Nodes of a whole chunk."""
        return self.fanout**self.levels


def chunks(nodes: DataFrame, shape: Shape) -> DataFrame:
    """One row per chunk of ``nodes(g, n, pos, leaf)``: digests and states of its levels, and its top digest."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        digests, states = grow(unpack(b"".join(table.column("leaf").to_pylist())), shape.fanout, min(shape.levels, depth(n, shape.fanout)))
        packed = [b"".join(pack(s) for s in level.transpose(2, 1, 0)) for level in states]
        return pa.table({
            "g": table.column("g").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "n": table.column("n").slice(0, 1),
            "digests": pa.array([[pack(d) for d in digests[:-1]]], pa.list_(pa.binary())), "states": pa.array([packed], pa.list_(pa.binary())),
            "top": pa.array([pack(digests[-1])], pa.binary()),
        })

    dealt = nodes.select("g", "n", "pos", "leaf", F.floor(F.col("pos") / shape.span).cast("long").alias("chunk"))
    return dealt.groupBy("g", "chunk").applyInArrow(run, CHUNK_ROW)


def _read(digests: list[bytes], states: list[bytes], fanout: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for d, s in zip(digests, states, strict=True):
        raw = np.frombuffer(s, dtype=">u4").reshape(-1, fanout, 8)
        yield unpack(d), np.ascontiguousarray(raw.transpose(1, 2, 0)).astype(WORD)


def trees(nodes: DataFrame, shape: Shape = Shape()) -> tuple[list[DataFrame], DataFrame]:
    """The written chunk tables of the rounds above ``nodes(g, n, pos, leaf)``, the lowest first, and (g, top)."""
    rounds = []
    while True:
        rounds.append(written(chunks(nodes, shape), "chunks"))
        n = F.ceil(F.col("n") / shape.span).cast("long")
        nodes = rounds[-1].select("g", n.alias("n"), F.col("chunk").alias("pos"), F.col("top").alias("leaf"))
        if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
            return rounds, nodes.select("g", F.col("leaf").alias("top"))


def paths(rounds: list[DataFrame], top: DataFrame, shape: Shape) -> DataFrame:
    """(g, pos, ``PATH``) of every node below the lowest of ``rounds``: its way to the end of the groups' ways.

    ``top`` has (g, ``PATH``): how each group's own top goes on.
    """

    fanout = shape.fanout

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = list(_read(row["digests"], row["states"], fanout))
                out: list[tuple] = []
                for first in range(levels[0][0].shape[1] if levels else 1):
                    at, way = first, ([], [], [])
                    for below, states in levels:
                        parent, slot = divmod(at, fanout)
                        others = [i for i in range(parent * fanout, min(parent * fanout + fanout, below.shape[1])) if i != at]
                        for values, value in zip(way, (pack(states[slot, :, parent][:, None]), slot, pack(below[:, others])), strict=True):
                            values.append(value)
                        at = parent
                    out.append(tuple(own + above for own, above in zip(way, (row["above_states"], row["above_slots"], row["above_siblings"]), strict=True)))
                n, begin = len(out), row["chunk"] * shape.span
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["g"]] * n, pa.int64()), pa.array(range(begin, begin + n), pa.int64()),
                     pa.array([o[0] for o in out], pa.list_(pa.binary())), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.list_(pa.binary()))],
                    names=["g", "pos", "states", "slots", "siblings"])

    known = top.withColumn("pos", F.lit(0).cast("long"))
    for level in reversed(rounds):
        above = known.select("g", F.col("pos").alias("chunk"), *[F.col(c).alias(f"above_{c}") for c in ("states", "slots", "siblings")])
        known = level.join(above, ["g", "chunk"]).mapInArrow(run, f"g long, pos long, {PATH}")
    return known


def prove(leaves: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``leaves(id, grp, leaf, other)`` (digests of 32 bytes): for every row the top of its group, the root, the digest
    of the siblings on its way to the root, and the root that follows when ``other`` stands in the leaf's place."""
    rows = written(placed(leaves), "placed")
    rounds, tops = trees(rows, shape)
    tops = written(tops, "tops")
    groups = tops.count()
    above, root = trees(tops.select(F.lit(0).cast("long").alias("g"), F.lit(groups).cast("long").alias("n"), F.col("g").alias("pos"), F.col("top").alias("leaf")), shape)
    end = root.select("g", *[F.array().cast(kind).alias(name) for name, kind in (p.split(" ") for p in PATH.split(", "))])
    upper = paths(above, end, shape).select(F.col("pos").alias("g"), "states", "slots", "siblings")
    ways = paths(rounds[1:], written(upper, "upper"), shape)
    known = attach_scalars(tops, root.select(F.col("top").alias("root")))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tree = right.to_pylist()[0]
        at = left.column("pos").to_numpy() - tree["chunk"] * shape.span
        fold = Fold(unpack(b"".join(left.column("other").to_pylist())))
        for below, states in _read(tree["digests"], tree["states"], shape.fanout):
            at = fold.level(at, below, states)
        fold.path(tree["way"], tree["slots"], tree["siblings"])
        same = lambda digest: pa.array([digest] * left.num_rows, pa.binary())
        return pa.table({
            "id": left.column("id"), "leaf": left.column("leaf"), "subroot": same(tree["subroot"]), "root": same(tree["root"]),
            "proof": digests_of(fold.proof()), "folded": digests_of(fold.digest),
        })

    own = rows.select("id", "g", "pos", "leaf", "other", F.floor(F.col("pos") / shape.span).cast("long").alias("chunk"))
    tree = (
        rounds[0].select("g", "chunk", "digests", F.col("states").alias("kept"))
        .join(ways.withColumnRenamed("pos", "chunk"), ["g", "chunk"]).join(known, "g")
        .select("g", "chunk", "digests", F.col("kept").alias("states"), F.col("states").alias("way"), "slots", "siblings", F.col("top").alias("subroot"), "root")
    )
    kind = leaves.schema["id"].dataType.simpleString()
    return own.groupBy("g", "chunk").cogroup(tree.groupBy("g", "chunk")).applyInArrow(run, f"id {kind}, leaf binary, subroot binary, root binary, proof binary, folded binary")


RECORD = ("doc_id", "source", "lang", "n_chars", "text")


def audited(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", count_col: str = "n_chars", columns: Sequence[str] = RECORD, shape: Shape = Shape()) -> DataFrame:
    """Every document with its leaf, its group's top, the root, the digest of its proof, and whether the root holds
    when the document is hashed again. Where 7 divides the CRC-32 of the id, ``count_col`` has grown by one since."""
    value = [F.col(f"`{c}`") for c in columns]
    # one more than the largest integer has no place in its own type
    later = [v.cast("decimal(38,0)") + 1 if c == count_col else v for c, v in zip(columns, value, strict=True)]
    touched = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("grp"), leaf_digest(value).alias("leaf"),
        F.when(touched, leaf_digest(later)).alias("other"),
    )
    leaves = written(leaves, "leaves").withColumn("other", F.coalesce("other", "leaf"))
    text = lambda c: F.lower(F.hex(c))
    return prove(leaves, shape).select(
        F.col("id").alias(id_col), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
