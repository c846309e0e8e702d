"""Near duplicates by probability Jaccard of weighted word shingles: ProbMinHash, banding, verification.

A shingle is five consecutive words in lower case (A-Z; a shorter text is one shingle); its weight is how often it
occurs. Every shingle emits a Poisson process with its weight as rate, seeded by its hash, whose points carry uniform
components; a component's sample is the shingle that arrives first. A process ends early at its first point beyond
the latest arrival that still stands, so long texts cost little more than one point a shingle. Two texts agree in a
component with a chance equal to their probability Jaccard.

Equal word sequences are one text from the start. Texts that agree in all components of a band meet in a bucket. No
bucket is expanded into pairs: its members are verified against a head, and what stays apart from the head's class is
verified block by block against the members of other classes, inside the task where two blocks meet. So every pair of
a bucket was verified, or is in one class already, or its signatures differ by five standard deviations, or a text's
weight on shingles that no other text there has (own) is above 1 - threshold, which bounds its probability Jaccard
below the threshold. Verification computes the probability Jaccard of the whole texts, whose shingles are told apart by
``HASH_BITS`` bits of their hashes.

Defined results: a text without words (null, empty) is a class of its own. The class id is the smallest document id
in it; repeated rows are copies. With null ids the class id is the smallest other id, or null. An empty table gives
an empty result. Other columns are ignored by ``classes`` and passed through by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemweave.llm.components import components
from stemweave.llm.texts import LOWER_TABLE, U64, flat, mix, powers, prefix_hashes, range_hashes, ragged, shingles, slices, word_spans
from stemweave.plans.durable import scratch, written

BANDS, ROWS = 40, 6
THRESHOLD = 0.8
HASH_BITS = 40  # of a shingle, in the key that also holds its text's place in a slice
BLOCK, BLOCK_WORDS = 256, 1 << 16  # members, and words of them, in a block
SLICE = 1 << 20  # bytes of text that a task takes apart at a time, or one longer text
SLACK = 5 * (THRESHOLD * (1 - THRESHOLD) / (BANDS * ROWS)) ** 0.5
SIGNED = "row long, words long, key1 long, key2 long, bands array<long>"


def weighted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, weight; words before each text, and two word-order hashes."""
    data, at = flat(column)
    data = LOWER_TABLE[data]
    start, end, first = word_spans(data, at)
    words = range_hashes(prefix_hashes(data), start, end) if len(start) else np.zeros(0, dtype=np.uint64)
    hashed, begin = shingles(words, first)
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(begin))
    keys, counts = np.unique(text << U64(HASH_BITS) | hashed >> U64(64 - HASH_BITS), return_counts=True)
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    power, inverse = powers(len(words) + 1)
    order = []
    for factor in (power, inverse):
        sums = np.concatenate([[U64(0)], np.cumsum(words * factor[place], dtype=np.uint64)])
        order.append(mix(sums[first[1:]] - sums[first[:-1]]))
    return (keys >> U64(HASH_BITS)).astype(np.int64), keys & U64((1 << HASH_BITS) - 1), counts, first, np.stack(order)


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, components: int) -> np.ndarray:
    """texts x components: the element that arrives first in each component (all bits set: no elements)."""
    arrival = np.full(texts * components, np.inf)
    sample = np.full(texts * components, np.iinfo(np.uint64).max, dtype=np.uint64)
    time = np.zeros(len(element))
    point = 0
    while len(element):
        point += 1
        random = mix(element * U64(0xD1342543DE82EF95) + U64(point * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log1p(-(random >> U64(11)).astype(np.float64) * 2.0**-53) / weight
        slot = text * components + (mix(random) % U64(components)).astype(np.int64)
        np.minimum.at(arrival, slot, time)
        first = time == arrival[slot]
        sample[slot[first]] = element[first]
        latest = arrival.reshape(texts, components).max(axis=1)
        on = time < latest[text]
        text, element, weight, time = text[on], element[on], weight[on], time[on]
    return sample.reshape(texts, components)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common shingles i of 1 / sum_j max(a_j / a_i, b_j / b_i), for (sorted hashes, weights) of two texts."""
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(-ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # a_j / a_i is the larger term exactly where j's ratio is at least i's; ties give equal terms
    before = np.cumsum(x)
    after = y.sum() - np.cumsum(y)
    both = (x > 0) & (y > 0)
    return float((1 / (before[both] / x[both] + after[both] / y[both])).sum())


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Signature bands of (row, text), with the number of words and a 128-bit hash of the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n = part.num_rows
                text, element, weight, first, order = weighted(part.column(1))
                sample = signatures(text, element, weight, n, bands * rows).reshape(n, bands, rows)
                band = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
                for j in range(rows):
                    band = mix(band * U64(0x9E3779B97F4A7C15) + sample[:, :, j])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(first)), *[pa.array(o.view(np.int64)) for o in order],
                     ragged(band.reshape(-1).view(np.int64), np.arange(n + 1) * bands, pa.int64())],
                    names=["row", "words", "key1", "key2", "bands"],
                )

    return docs.select("row", "text").mapInArrow(run, SIGNED)


def verify(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts have a probability Jaccard of ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta", SLICE):
                sets = []
                for i in (2, 3):
                    text, element, weight, _, _ = weighted(part.column(i))
                    cut = np.searchsorted(text, np.arange(part.num_rows + 1))
                    sets.append([(element[p:q], weight[p:q]) for p, q in zip(cut[:-1], cut[1:], strict=True)])
                similar = np.array([probability_jaccard(x, y) >= threshold - 1e-9 for x, y in zip(*sets, strict=True)], dtype=bool)
                yield part.select(["a", "b"]).filter(pa.array(similar))

    text = docs.select("row", "text")
    both = pairs.join(text.toDF("a", "ta"), "a").join(text.toDF("b", "tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def own_shares(docs: DataFrame) -> DataFrame:
    """(row, own): the share of each text's weight on shingles that no other of the texts (row, text) has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                text, element, weight, _, _ = weighted(part.column(1))
                share = weight / np.bincount(text, weight, part.num_rows)[text]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(element.view(np.int64)), pa.array(share)], names=["row", "shingle", "share"])

    shingle = docs.select("row", "text").mapInArrow(run, "row long, shingle long, share double")
    single = shingle.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"), F.first("share").alias("share")).filter("n = 1")
    return single.groupBy("row").agg(F.sum("share").alias("own"))


def shared(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], columns: int = 4_096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every left and right text (sorted hashes, weights): the number of common shingles, and the share of each one's
    weight on them. Products of incidence matrices over so many shingles at a time."""
    sides = []
    every, codes = np.unique(np.concatenate([e for e, _ in left + right]), return_inverse=True)
    at = 0
    for texts in (left, right):
        row = np.repeat(np.arange(len(texts)), [len(e) for e, _ in texts])
        weight = np.concatenate([w / w.sum() for _, w in texts])
        sides.append((row, codes[at : at + len(row)], weight, len(texts)))
        at += len(row)
    n = np.zeros((len(left), len(right)), dtype=np.float32)
    of_left, of_right = np.zeros_like(n), np.zeros_like(n)
    both = np.intersect1d(sides[0][1], sides[1][1])
    for begin in range(0, len(both), columns):
        chosen = both[begin : begin + columns]
        place = np.full(len(every), -1)
        place[chosen] = np.arange(len(chosen))
        dense = []
        for row, code, weight, size in sides:
            inside = place[code] >= 0
            has, share = np.zeros((size, len(chosen)), dtype=np.float32), np.zeros((size, len(chosen)), dtype=np.float32)
            has[row[inside], place[code[inside]]] = 1
            share[row[inside], place[code[inside]]] = weight[inside]
            dense.append((has, share))
        (x, wx), (y, wy) = dense
        n += x @ y.T
        of_left += wx @ y.T
        of_right += x @ wy.T
    return n, of_left, of_right


def similar_pairs(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the wanted (left, right) pairs have a probability Jaccard of ``threshold`` or more.

    Texts without repeated shingles have the common share of the union. For the others the shares s and t of the two
    texts' weights on common shingles bound it by st / (s + t - st), and what passes is computed one by one.
    """
    n, of_left, of_right = shared(left, right)
    flat = [np.array([w.max() == w.min() for _, w in texts]) for texts in (left, right)]
    size = [np.array([len(e) for e, _ in texts]) for texts in (left, right)]
    plain = flat[0][:, None] & flat[1][None, :]
    found = wanted & plain & (n >= (threshold - 1e-9) * (size[0][:, None] + size[1][None, :] - n))
    product = of_left * of_right
    close = product >= (threshold - 1e-4) * (of_left + of_right - product)
    for i, j in zip(*np.nonzero(wanted & ~plain & close), strict=True):
        found[i, j] = probability_jaccard(left[i], right[j]) >= threshold - 1e-9
    return found


def promising(mixed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The (bucket, row) of ``mixed`` whose signature agrees with that of another class in the bucket in nearly the
    threshold or more. ``SLACK`` is five standard deviations; eight bits of a component only ever add agreement.

    Blocks of outsiders meet the blocks of their bucket as in ``compared``, but with a byte a component instead of texts.
    """
    m = BANDS * ROWS
    least = (threshold - SLACK) * m

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                text, element, weight, _, _ = weighted(part.column(1))
                sample = signatures(text, element, weight, part.num_rows, m).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeBinaryArray.from_buffers(pa.binary(m), part.num_rows, [None, pa.py_buffer(sample.tobytes())]).cast(pa.binary())], names=["row", "sig"])

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, told = None, set()
        for batch in batches:
            for k in range(batch.num_rows):
                if (here := batch.column(2)[k].as_py()) != bucket:
                    bucket, told = here, set()
                (row, comp, sig), (row2, comp2, sig2) = (
                    (b.field(0).to_numpy(), b.field(1).to_numpy(), np.frombuffer(b"".join(b.field(2).to_pylist()), dtype=np.uint8).reshape(len(b), m))
                    for b in (batch.column(i).slice(k, 1).flatten() for i in range(2)))
                close = np.stack([(sig2 == one).sum(axis=1) for one in sig]) >= least
                x, y = np.nonzero(close & (comp[:, None] != comp2[None, :]))
                new = sorted({*row[x].tolist(), *row2[y].tolist()} - told)
                told |= set(new)
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(new), pa.int64()), pa.array(new, pa.int64())], names=["bucket", "row"])

    signs = written(texts.select("row", "text").mapInArrow(signed, "row long, sig binary"), "signatures")
    lanes = mixed.groupBy("bucket", "inside").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("lanes"))
    dealt = mixed.join(lanes, ["bucket", "inside"]).withColumn("lane", F.pmod(F.xxhash64("row"), F.col("lanes"))).join(signs, "row")
    return _met(dealt.groupBy("bucket", "inside", "lane").agg(F.collect_list(F.struct("row", "comp", "sig")).alias("block"))).mapInArrow(agree, "bucket long, row long").distinct()


def _met(blocks: DataFrame) -> DataFrame:
    """(block, other, bucket): every block of outsiders with every block of its bucket, once."""
    blocks = written(blocks, "blocks")
    other = blocks.select("bucket", F.col("inside").alias("theirs"), F.col("lane").alias("at"), F.col("block").alias("other"))
    return blocks.filter("NOT inside").join(other, "bucket").filter("theirs OR lane <= at").select("block", "other", "bucket")


def compared(mixed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join the classes of one bucket: enough of the pairs that are similar to connect all of them.

    ``mixed`` has (bucket, row, comp, inside), inside for members of the head's class. Members stand in blocks that are
    bounded in rows and words, with their shingles; each block of outsiders meets every block of its bucket once. The
    two blocks are verified where they meet and only links between what is not yet one class there leave the task,
    so neither a list of a bucket's pairs nor one of its similar pairs is ever made. A pair that shares several
    buckets is compared in that of its first common band; members of the head's class are not compared with each other.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                text, element, weight, first, _ = weighted(part.column(1))
                begin = np.searchsorted(text, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ragged(element.view(np.int64), begin, pa.int64()), ragged(weight.astype(np.int32), begin, pa.int32()), pa.array(np.diff(first))],
                    names=["row", "element", "weight", "words"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, sides = batch.column(2)[k].as_py(), []
                for i in range(2):
                    block = batch.column(i).slice(k, 1).flatten()
                    lists = block.field(2)
                    cut = np.diff(lists.offsets.to_numpy())
                    at = np.concatenate([[0], np.cumsum(cut)])
                    element, weight = lists.flatten().to_numpy(), block.field(3).flatten().to_numpy()
                    sides.append((block.field(0).to_numpy(), block.field(1).to_numpy(), [(element[p:q], weight[p:q]) for p, q in zip(at[:-1], at[1:], strict=True)], block.field(4).flatten().to_numpy().reshape(len(block), -1)))
                (row, comp, left, bands), (row2, comp2, right, bands2) = sides
                common = bands[:, None, :] == bands2[None, :, :]
                here = np.take_along_axis(np.broadcast_to(bands[:, None, :], common.shape), common.argmax(axis=2)[:, :, None], axis=2)[:, :, 0] == bucket
                wanted = here & common.any(axis=2) & (comp[:, None] != comp2[None, :])
                links = []
                if wanted.any():
                    up: dict[int, int] = {}

                    def top(x: int, up: dict[int, int] = up) -> int:
                        while (y := up.get(x, x)) != x:
                            x = y
                        return x

                    for i, j in zip(*np.nonzero(similar_pairs(left, right, wanted, threshold)), strict=True):
                        x, y = top(comp[i]), top(comp2[j])
                        if x != y:
                            up[max(x, y)] = min(x, y)
                            links.append(sorted((row[i], row2[j])))
                yield pa.RecordBatch.from_arrays([pa.array([pair[i] for pair in links], pa.int64()) for i in range(2)], names=["a", "b"])

    unable = written(own_shares(texts).filter(F.col("own") > 1 - threshold).select("row"), "unable")
    mixed = written(mixed.join(unable, "row", "left_anti"), "able")
    texts = written(texts.join(mixed.select("row").distinct(), "row", "left_semi"), "texts")
    near = written(promising(mixed, texts, threshold), "near")
    mixed = mixed.join(near, ["bucket", "row"], "left_semi")
    texts = texts.join(near.select("row").distinct(), "row", "left_semi")
    known = written(texts.select("row", "text").mapInArrow(sets, "row long, element array<long>, weight array<int>, words long").join(texts.select("row", "bands"), "row"), "sets")
    sized = written(mixed.join(known.select("row", "words"), "row"), "sized")
    lanes = sized.groupBy("bucket", "inside").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("words") / BLOCK_WORDS)).alias("lanes"))
    dealt = sized.join(lanes, ["bucket", "inside"]).withColumn("lane", F.pmod(F.xxhash64("row"), F.col("lanes"))).join(known.drop("words"), "row")
    blocks = dealt.groupBy("bucket", "inside", "lane").agg(F.collect_list(F.struct("row", "comp", "element", "weight", "bands")).alias("block"))
    return _met(blocks).mapInArrow(close, "a long, b long")


def link_texts(texts: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, comp) of the texts (row, bands) that have a near duplicate; ``docs`` has (row, text)."""
    member = texts.select("row", F.explode("bands").alias("bucket"))
    heads = member.groupBy("bucket").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    buckets = written(member.join(heads, "bucket"), "buckets")
    # the texts that can be in a pair at all; the others are never read again
    some = written(docs.join(buckets.select("row").distinct(), "row", "left_semi").select("row", "text"), "texts")
    votes = buckets.filter("row != head").groupBy("row", "head").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("row").agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("head"))
    pairs = written(best.select(F.col("head").alias("a"), F.col("row").alias("b")), "pairs")
    labels = components(written(verify(pairs, some, threshold), "links"))
    placed = (
        buckets.join(labels, "row", "left").withColumn("comp", F.coalesce("comp", "row"))
        .join(labels.toDF("head", "home"), "head", "left").withColumn("home", F.coalesce("home", "head"))
    )
    mixed = placed.join(placed.filter("comp != home").select("bucket").distinct(), "bucket", "left_semi")
    mixed = written(mixed.select("bucket", "row", "comp", (F.col("comp") == F.col("home")).alias("inside")), "mixed")
    # the second links join classes, so each pair of classes counts once
    found = written(compared(mixed, some.join(mixed.select("row").distinct(), "row", "left_semi").join(texts, "row"), threshold), "found")
    ends = found.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left")
    joined = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a != b").distinct()
    upper = written(components(written(joined, "joined")), "upper")
    alone = upper.join(labels.select("row"), "row", "left_anti").select("row", "comp")
    lower = labels.join(upper.toDF("comp", "top"), "comp", "left").select("row", F.coalesce("top", "comp").alias("comp"))
    return lower.unionByName(alone)


def _classed(stored: DataFrame, threshold: float) -> DataFrame:
    """(row, id, class) of stored (row, id, text): ``class`` is the first row of each near-duplicate class."""
    signed = written(sign(stored), "signed")
    single = written(signed.filter("words > 0").groupBy("key1", "key2").agg(F.min("row").alias("first")), "single")
    reps = signed.join(single.select(F.col("first").alias("row")), "row", "left_semi").select("row", "bands")
    labels = link_texts(written(reps, "reps"), stored, threshold)
    known = signed.join(single, ["key1", "key2"], "left").select("row", F.when(F.col("words") > 0, F.col("first")).otherwise(F.col("row")).alias("first"))
    return known.join(labels.toDF("first", "comp"), "first", "left").select("row", F.coalesce("comp", "first").alias("class"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, class id (smallest document id of its class), documents in the class, kept."""
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    with scratch(docs.sparkSession) as tables:
        stored = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "docs")
        known = tables.keep(written(_classed(stored, threshold).join(stored.select("row", "id"), "row"), "classed"))
        # a table of its own, so that the join back can split the partition of a large class
        least = tables.keep(written(known.groupBy("class").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n_class")), "least"))
    return known.join(least, "class").select(
        F.col("id").alias(id_col), F.col("least.id").alias("class_id"), "n_class", (F.col("row") == F.col("least.row")).alias("kept")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The document with the smallest id of each class, with all its columns."""
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    with scratch(docs.sparkSession) as tables:
        stored = tables.keep(written(whole.withColumn("row", F.monotonically_increasing_id()).drop("text"), "docs")).withColumn("text", F.col("_row").getField(text_col))
        known = _classed(stored.select("row", "id", "text"), threshold).join(stored.select("row", "id"), "row")
        kept = tables.keep(written(known.groupBy("class").agg(F.min(order).alias("least")).select(F.col("least.row").alias("row")), "kept"))
    return stored.join(kept, "row", "left_semi").select(*[F.col("_row").getField(c).alias(c) for c in names])
