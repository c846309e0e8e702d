"""Code length of documents by prediction by partial matching over byte contexts, and a word-unigram base.

Texts become tokens in lower case (A-Z), written as their bytes with one space between words and an end symbol, so
the model is a distribution over token sequences. Every (context of up to ``ORDER`` bytes, symbol) of every training
text counts; nothing is dropped. Escape is estimated as distinct symbols over total plus distinct symbols (method C);
symbols that a longer context offers are excluded in the shorter ones; what is left is uniform over the bytes.

The cost of a symbol depends on its window (context and symbol) only. Texts are put in blocks of ``BLOCK`` bytes; a
block asks for each of its distinct windows once, and brings the windows' counts along. What is asked is shuffled by
the last ``NEAR`` bytes of the context, so one task (a shard) has all counts of the contexts of ``NEAR`` bytes or more
that its windows need, and the answers are shuffled back to the blocks' texts. Contexts under ``NEAR`` bytes are counted
apart and broadcast: at most 256^NEAR pairs, whatever the size of the corpus. ``adaptive_length`` is the same
estimator learning as it goes, for one text, and serves to check the costs.

Base: words seen in ``FREQUENT`` of all training tokens or more (at most 1 / FREQUENT) are broadcast, the others are
joined through a shuffle. Words are told apart by 64-bit hashes.

Defined results: a null text is empty: one token, the end. Repeated rows are learned and scored each. A null id
counts as the empty text for the split. An empty training set gives uniform bytes and the smoothed base. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.llm.texts import LOWER_TABLE, U64, flat, mix, prefix_hashes, range_hashes, ragged, slices, word_spans
from stemweave.plans.durable import written

ORDER = 6
NEAR = 3  # bytes of context that deal windows to shards; shorter contexts are broadcast
SHARDS = 1024
FREQUENT = 1e-6
BLOCK = 8 << 20  # bytes of text that ask for their windows together
SLICE = 1 << 20  # bytes of text worked on at once, which bounds a worker's arrays
END, GAP, NUL = 0x0A, 0x20, 0x0B  # of the bytes that words never hold; a zero byte of a word becomes NUL
WORD_BIT = U64(1 << 63)
SYMBOLS = LOWER_TABLE.copy()
SYMBOLS[0] = NUL


def stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised symbols of all texts, the n + 1 places where texts begin, word hashes and words before each text."""
    data, at = flat(column)
    start, end, first = word_spans(data, at)
    data = SYMBOLS[data]
    hashes = range_hashes(prefix_hashes(data), start, end) if len(start) else np.zeros(0, dtype=np.uint64)
    words = np.diff(first)
    empty = np.concatenate([[0], np.cumsum(words == 0)])
    sizes = end - start
    letters = np.concatenate([[0], np.cumsum(sizes)])
    begin = letters[first] + first + empty
    out = np.full(begin[-1], GAP, dtype=np.uint8)
    # a word's letters go to its place: letters and separators before it
    shift = letters[:-1] + np.arange(len(start)) + np.repeat(empty[:-1], words) - start
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[start] += 1
    inside[end] -= 1
    source = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    out[source + np.repeat(shift, sizes)] = data[source]
    out[begin[1:] - 1] = END
    return out, begin, hashes, first


def windows(symbols: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Context and symbol of every place as one number; contexts reach back to the last end symbol, and hold it."""
    n = len(symbols)
    padded = np.concatenate([np.zeros(order - 1, dtype=np.uint8), [np.uint8(END)], symbols])
    key = np.zeros(n, dtype=np.uint64)
    for j in range(order + 1):
        key = key << U64(8) | padded[j : j + n]
    ends = np.flatnonzero(symbols == END)
    back = np.arange(n) - np.concatenate([[-1], ends])[np.searchsorted(ends, np.arange(n))]
    kept = np.minimum(back, order).astype(np.uint64) + U64(1)
    return key & ((U64(1) << (kept * U64(8))) - U64(1))


class Tally:
    """Distinct keys with counts, of a bounded number of keys: what is full is handed on."""

    MOST = 1_200_000

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > 2 * self.MOST:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([np.zeros(0, dtype=np.uint64), *[k for k, _ in self.parts]])
        counts = np.concatenate([np.zeros(0, dtype=np.int64), *[c for _, c in self.parts]])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        self.parts = [(keys[first], np.add.reduceat(counts, first) if len(first) else counts)]
        self.held = len(first)

    def rows(self, last: bool) -> Iterator[pa.RecordBatch]:
        """What is held, if it is the last or many; the keys' counts are summed downstream anyway."""
        if last:
            self.merge()
        if self.held > self.MOST or last:
            for keys, counts in self.parts:
                for i in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], names=["key", "n"])
            self.parts, self.held = [], 0


def count_training(training: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n): windows of up to ``order`` bytes of context, and word hashes with the top bit set, over all ``text`` of the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                symbols, _, hashes, _ = stream(part.column(0))
                tally.add(windows(symbols, order))
                tally.add(hashes | WORD_BIT)
                if len(tally.parts) == 1:  # just merged
                    yield from tally.rows(last=False)
        yield from tally.rows(last=True)

    return training.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def low(key: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes of each key."""
    return key & ((U64(1) << U64(8 * n)) - U64(1))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@dataclass(frozen=True)
class Level:
    """Pairs of one order with counts, and their contexts: what each costs (log10) and gives to longer ones.

    ``whole``: of a symbol in the context, when nothing is excluded; ``escape``: leaving the context, when nothing is
    excluded; ``rest``: the next shorter context's whole without the symbols of this; ``chain``: leaving all shorter
    contexts, each without the symbols of the next longer one.
    """

    pair: np.ndarray
    count: np.ndarray
    context: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    whole: np.ndarray
    escape: np.ndarray
    rest: np.ndarray
    chain: np.ndarray


def level(order: int, pair: np.ndarray, count: np.ndarray, shorter: Level | None) -> Level:
    """Pairs are distinct and in order. A symbol of a context is also one of its shorter context."""
    above = pair >> U64(8)
    first = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]])[: len(pair)])
    context = above[first]
    distinct = np.diff(np.concatenate([first, [len(pair)]]))
    add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0, dtype=np.int64)
    total = add(count)
    whole = np.log10(total + distinct)
    rest, chain = np.zeros(len(context)), np.zeros(len(context))
    if shorter is not None and len(context):
        up = np.searchsorted(shorter.context, low(context, order - 1))
        gone = add(shorter.count[np.searchsorted(shorter.pair, low(pair, order))])
        more = shorter.distinct[up] - distinct
        left = np.maximum(shorter.total[up] - gone + more, 1)
        rest = np.where(more > 0, np.log10(left), 0.0)
        chain = shorter.chain[up] + np.where(more > 0, np.log10(np.maximum(more, 1)) - rest, 0.0)
    return Level(pair, count, context, total, distinct, whole, np.log10(distinct) - whole, rest, chain)


def levels(keys: np.ndarray, counts: np.ndarray, first: int, last: int, below: tuple[Level, ...] = ()) -> tuple[Level, ...]:
    """The levels of orders ``first`` to ``last`` of windows, after the shorter ones."""
    out = list(below)
    for k in range(first, last + 1):
        # a context of order k is there only where its first byte is (no padding)
        there = keys >> U64(8 * k) != 0 if k else np.ones(len(keys), dtype=bool)
        pair, count = summed(low(keys[there], k + 1), counts[there])
        out.append(level(k, pair, count, out[-1] if out else None))
    return tuple(out)


def find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value, and whether it is there."""
    if not len(values):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


def costs(model: tuple[Level, ...], keys: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each window in its context."""
    out = np.zeros(len(keys))
    rest, chain = np.zeros(len(keys)), np.zeros(len(keys))  # of the last context left
    left = np.zeros(len(keys), dtype=bool)
    open_ = np.arange(len(keys))
    for k in range(len(model) - 1, -1, -1):
        one = model[k]
        mine = open_ if not k else open_[keys[open_] >> U64(8 * k) != 0]
        pair = low(keys[mine], k + 1)
        at, there = find(one.context, pair >> U64(8))
        mine, pair, at = mine[there], pair[there], at[there]
        place, seen = find(one.pair, pair)
        hit, c = mine[seen], at[seen]
        # left contexts: the chain down to here is the whole chain without what is shorter
        out[hit] += np.log10(one.count[place[seen]]) - np.where(left[hit], chain[hit] + rest[hit], one.whole[c])
        miss, c = mine[~seen], at[~seen]
        out[miss] += np.where(left[miss], 0.0, one.escape[c] + one.chain[c])
        rest[miss], chain[miss], left[miss] = one.rest[c], one.chain[c], True
        done = np.zeros(len(keys), dtype=bool)
        done[hit] = True
        open_ = open_[~done[open_]]
    # never seen: what is left is uniform over the other bytes
    out[open_] -= np.log10(max(1, 256 - len(model[0].pair)))
    return out


def near_levels(counts: DataFrame) -> tuple[Level, ...]:
    """The levels under ``NEAR`` bytes of context, of windows of so many: at most 256^NEAR rows."""
    rows = counts.filter("key >= 0").toArrow()
    return levels(rows.column("key").to_numpy().astype(np.uint64), rows.column("n").to_numpy().astype(np.int64), 0, NEAR - 1)


def packed(values: np.ndarray) -> bytes:
    """Little-endian bytes, plane by plane, compressed."""
    flat_bytes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    return pa.compress(np.ascontiguousarray(flat_bytes.T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


def blocks(named: DataFrame) -> DataFrame:
    """The rows with the number of their block: rows that follow each other, of ``BLOCK`` bytes of text or one longer row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                size = int(flat(part.column(1))[1][-1])
                if held and held + size > BLOCK:
                    block, held = block + 1, 0
                held += size
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(part), block))], names=["id", "text", "held", "block"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    return named.mapInArrow(run, f"{kinds}, block long")


def dealt(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each window, and the order by shards."""
    shard = (mix(low(keys >> U64(8), NEAR)) % U64(SHARDS)).astype(np.int32)
    return shard, np.argsort(shard, kind="stable")


ASKED = "shard int, block long, n int, keys binary, counts binary"


def asked(rows: DataFrame) -> DataFrame:
    """For each block and shard its distinct windows, with how often they are in training rows."""

    def send(block: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, counts = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        shard, order = dealt(keys)
        keys, counts, shard = keys[order], counts[order].astype(np.uint32), shard[order]
        at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        sizes = np.diff(np.concatenate([at, [len(keys)]]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(shard[at]), pa.array(np.full(len(at), block)), pa.array(sizes.astype(np.int32)),
                pa.array([packed(keys[i : i + n]) for i, n in zip(at, sizes, strict=True)], pa.binary()),
                pa.array([packed(counts[i : i + n]) for i, n in zip(at, sizes, strict=True)], pa.binary()),
            ],
            names=["shard", "block", "n", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], 0
        for batch in batches:
            number = batch.column(2).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(number) else np.zeros(1, dtype=np.int64)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if parts and number[a] != now:
                    yield from send(now, parts)
                    parts, held = [], 0
                now = int(number[a])
                for part in slices(batch.slice(a, b - a), "text", SLICE):
                    symbols, begin, _, _ = stream(part.column(0))
                    learned = np.repeat(~part.column(1).to_numpy(zero_copy_only=False), np.diff(begin))
                    parts.append(summed(windows(symbols), learned.astype(np.int64)))
                    held += len(parts[-1][0])
                    if held > 2 * Tally.MOST:
                        parts = [summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))]
                        held = 0
        if parts:
            yield from send(now, parts)

    return rows.select("text", "held", "block").mapInArrow(run, ASKED)


def answered(asks: DataFrame, near: Broadcast) -> DataFrame:
    """(block, shard, n, costs): of the windows that a block asked of a shard, in their order."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        keys = np.concatenate([unpacked(k.as_buffer(), n, np.uint64) for k, n in zip(table.column("keys"), sizes, strict=True)])
        counts = np.concatenate([unpacked(c.as_buffer(), n, np.uint32) for c, n in zip(table.column("counts"), sizes, strict=True)]).astype(np.int64)
        distinct, n = summed(keys, counts)
        seen = n > 0
        model = levels(distinct[seen], n[seen], NEAR, ORDER, near.value)
        value = costs(model, distinct)[np.searchsorted(distinct, keys)].astype(np.float32)
        at = np.concatenate([[0], np.cumsum(sizes)])
        answers = [packed(value[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "n": table.column("n"), "costs": pa.array(answers, pa.binary())})

    return asks.groupBy("shard").applyInArrow(run, "block long, shard int, n int, costs binary")


def adaptive_length(symbols: bytes, order: int = ORDER) -> float:
    """log10 probability of one sequence, learning after each symbol; a plain form of the same estimator."""
    seen: dict[bytes, dict[int, int]] = {}
    total = 0.0
    for i, symbol in enumerate(symbols):
        excluded: set[int] = set()
        p = 1.0
        for k in range(min(order, i), -1, -1):
            found = {s: c for s, c in seen.get(symbols[i - k : i], {}).items() if s not in excluded}
            if not found:
                continue
            whole = sum(found.values()) + len(found)
            if symbol in found:
                p *= found[symbol] / whole
                break
            p *= len(found) / whole
            excluded |= found.keys()
        else:
            p /= max(1, 256 - len(excluded))
        total += np.log10(p)
        for k in range(min(order, i) + 1):
            counts = seen.setdefault(symbols[i - k : i], {})
            counts[symbol] = counts.get(symbol, 0) + 1
    return total


def held_out(id_col: str, of: int = 10, fold: int = 0) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of == fold


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.0, frequent: float = FREQUENT) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if keep:
        raise ValueError("every pair counts: keep is 0")
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held"))
    rows = blocks(named)  # read twice in the same order; other rows than those asked for are an error
    training = named.filter("NOT held")
    counts = written(count_training(training, NEAR - 1), "counts")
    near = spark.sparkContext.broadcast(near_levels(counts))
    ends = training.count()
    words = counts.filter("key < 0")
    sums = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train = (sums["n"] or 0) + ends
    distinct = sums["v"] + (ends > 0)
    common = words.filter(F.col("n") >= frequent * n_train).toArrow()  # at most 1 / frequent rows
    keys = common.column("key").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], np.log10(common.column("n").to_numpy()[order] + 0.1)))
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, held boolean, n_tokens long, n_common long, common double, score double, rare array<long>"
    names = ["id", "held", "n_tokens", "n_common", "common", "score", "rare"]

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        keys, logs = shared.value
        answers = answers.sort_by("shard")
        sizes = answers.column("n").to_pylist()
        cost = np.concatenate([unpacked(c.as_buffer(), n, np.float32) for c, n in zip(answers.column("costs"), sizes, strict=True)])
        parts = [part for batch in texts.select(["id", "text", "held"]).combine_chunks().to_batches() for part in slices(batch, "text", SLICE)]
        own_windows = [np.unique(windows(stream(part.column(1))[0]), return_inverse=True) for part in parts]
        window = np.unique(np.concatenate([each for each, _ in own_windows]))
        if len(window) != len(cost):
            raise RuntimeError("a block was read with other rows than those it asked for")
        by_window = np.empty(len(cost), dtype=np.float32)
        by_window[dealt(window)[1]] = cost
        done = []
        for part, (each, back) in zip(parts, own_windows, strict=True):
            symbols, begin, hashes, first = stream(part.column(1))
            own = (hashes | WORD_BIT).view(np.int64)
            at, known = find(keys, own)
            value = np.zeros(len(own))
            value[known] = logs[at[known]]
            value_sums = np.concatenate([[0.0], np.cumsum(value)])
            known_sums = np.concatenate([[0], np.cumsum(known)])
            rare = own[~known]
            sums = np.concatenate([[0.0], np.cumsum(by_window[np.searchsorted(window, each)][back], dtype=np.float64)])
            done.append(pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2), pa.array(np.diff(first) + 1), pa.array(np.diff(known_sums[first])),
                    pa.array(np.diff(value_sums[first])), pa.array(np.diff(sums[begin])),
                    ragged(rare, first - known_sums[first], pa.int64()),
                ],
                names=names,
            ))
        return pa.Table.from_batches(done)

    scored = rows.groupBy("block").cogroup(answered(asked(rows), near).groupBy("block")).applyInArrow(run, out)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = (
        scored.select("row", F.explode("rare").alias("key")).join(words, "key", "left")
        .groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_sum"), F.count("n").alias("rare_known"))
    )
    scale = float(np.log10(n_train + 0.1 * (distinct + 1)))
    end = float(np.log10(ends + 0.1))
    return scored.drop("rare").join(rare, "row", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens",
        (F.col("n_common") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("common") + F.coalesce("rare_sum", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )
