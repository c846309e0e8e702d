"""Bootstrap over trees, ensembles and contrasts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemweave.functions.hashing import portable_hashes
from stemweave.plans.durable import scratch, written
from stemweave.plans.skew import attach_scalars, grouped_rank, running_totals


#: Numbers that a task holds while it counts draws, and distinct scores whose sums it holds while it adds up vectors.
HELD, SCORES = 16_000_000, 400
#: Trees in a part, and rows of one tree in a lane of its part.
PART, LANE = 1024, 4096


def draws(spark: SparkSession, size: int, n: int, seed: int) -> DataFrame:
    """How often each of the trees 0, ..., ``size``-1 is drawn in each of ``n`` resamples: (part, times), times a list of
    (block, times) as in ``_block_draws``."""
    return _block_draws(spark, size, n, seed).groupBy("part").agg(F.collect_list(F.struct("block", "times")).alias("times"))


def _block_draws(spark: SparkSession, size: int, n: int, seed: int, lanes: Mapping[int, int] | None = None) -> DataFrame:
    """(part, lane, block, times): the counts of a block of resamples for the part's trees, 16 bits each, tree after tree, once
    for each of the part's ``lanes`` (one if it has no number there).

    A task draws a block of resamples at a time and counts them by tree in one array, so no row per draw arises: a
    resample slot is hashed and counted where it is. The more trees, the fewer resamples are in a block. A plan can't see how
    long the rows are: join them by a shuffle.
    """
    lanes = lanes or {}
    width = max(1, min(HELD // max(size, 1), -(-n // max(8, spark.sparkContext.defaultParallelism))))
    blocks = -(-n // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                reps = range(block * width, min((block + 1) * width, n))
                counts = np.empty((len(reps), size), dtype=np.int16)
                for row, rep in zip(counts, reps, strict=True):
                    row[:] = np.bincount((portable_hashes(seed, rep, size) % np.uint64(size)).astype(np.int64), minlength=size)
                for begin in range(0, size, 64 * PART):
                    times = [np.ascontiguousarray(counts[:, i : i + PART].T).tobytes() for i in range(begin, min(begin + 64 * PART, size), PART)]
                    parts = np.arange(len(times)) + begin // PART
                    for lane in range(max([1, *[lanes.get(p, 1) for p in parts.tolist()]])):
                        own = [i for i, p in enumerate(parts.tolist()) if lane < lanes.get(p, 1)]
                        yield pa.RecordBatch.from_arrays([pa.array(parts[own]), pa.array([lane] * len(own), pa.int64()), pa.array([block] * len(own), pa.int64()), pa.array([times[i] for i in own], pa.binary())], names=["part", "lane", "block", "times"])

    return spark.range(0, blocks if size else 0, 1, max(1, blocks)).mapInArrow(run, "part long, lane long, block long, times binary")


def _times(blocks: list[dict], trees: int) -> np.ndarray:
    """(trees, resamples) of one list of blocks."""
    return np.concatenate([np.frombuffer(b["times"], dtype=np.int16).reshape(trees, -1) for b in sorted(blocks, key=lambda b: b["block"])], axis=1)


def _indexed(trees: DataFrame, key: str) -> DataFrame:
    """The trees with their place 0, 1, ... in order of the key as ``_index``."""
    return grouped_rank(trees, [], [F.col(key)], "_rank").withColumn("_index", F.col("_rank") - 1).drop("_rank")


def tree_draws(trees: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """How often each tree is drawn in each of ``n`` resamples: (key, times), times a list of n numbers."""
    indexed = written(_indexed(trees.select(key), key), "indexed")
    size = indexed.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.arange(part * PART, min((part + 1) * PART, size))
                times = _times(blocks, len(own))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * times.shape[1], pa.int32()), pa.array(times.reshape(-1), pa.int16()))
                yield pa.RecordBatch.from_arrays([pa.array(own), rows], names=["_index", "times"])

    whole = draws(trees.sparkSession, size, n, seed).mapInArrow(run, "_index long, times array<smallint>")
    return whole.hint("merge").join(indexed, "_index").select(key, "times")


def _interval(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """2.5 % and 97.5 % quantiles over resamples; a group has one row per resample."""
    aggs: list[Column] = []
    for c in columns:
        aggs.append(F.percentile(c, 0.025).alias(f"{c}_low"))
        aggs.append(F.percentile(c, 0.975).alias(f"{c}_high"))
    return df.groupBy(*by).agg(*aggs)


def _vector(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1), pa.float64()))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def cluster_bootstrap(df: DataFrame, n: int = 1000, seed: int = 42, key: str = "tree_id", by: Sequence[str] = ("model",)) -> DataFrame:
    """Intervals of average precision and AUROC when trees are resampled.

    A part of the trees brings one matrix of multiplicities. The rows of a part meet its matrix once, in order of their trees, and
    give a vector per score, summed first inside each task; a tree with very many rows has them counted per score, in several lanes.
    Scores are then cut into ranges; a range needs of the scores above it only their sum, one vector a range, to add
    up its share of the areas of all n resamples. No row per resample arises before the areas themselves.
    """
    with scratch(df.sparkSession) as tables:
        ranged = tables.keep(_ranged_sums(df, n, seed, key, list(by)))
    return _areas_interval(df, ranged, n, list(by))


def _ranged_sums(df: DataFrame, n: int, seed: int, key: str, by: list[str]) -> DataFrame:
    """(grp, score, n, pos, part): rows and positives of each score as vectors over the resamples, in ranges of falling score."""
    rows = written(df.select(*by, key, "score", "label"), "rows")
    trees = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.count("label").alias("_known"))
    indexed = written(_indexed(trees, key), "indexed")
    size = indexed.count()
    part, many = F.floor(F.col("_index") / PART).alias("part"), (F.col("_rows") > LANE) | (F.col("_known") < F.col("_rows"))
    lanes = indexed.filter(many).groupBy(part).agg(F.ceil(F.max("_rows") / LANE).alias("lanes")).filter("lanes > 1").collect()
    placed = rows.join(indexed, key)
    ones = placed.filter(~many).select(*by, "_index", F.lit(0).alias("lane"), "score", F.lit(1.0).alias("n"), F.col("label").cast("double").alias("pos"))
    amounts = [F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("pos")]
    counts = placed.filter(many).groupBy(*by, "_index", "_rows", "score").agg(*amounts)
    counts = counts.select(*by, "_index", F.pmod(F.hash("score"), F.ceil(F.col("_rows") / LANE)).alias("lane"), "score", "n", "pos")
    entries = (ones.unionByName(counts) if indexed.filter(many).limit(1).count() else ones).select(
        part, F.col("lane").cast("long"), F.lit(1).alias("kind"), (F.col("_index") % PART).alias("at"), F.lit(None).cast("binary").alias("times"), F.to_json(F.struct(*by)).alias("grp"), "score", "n", "pos")
    drawn = _block_draws(df.sparkSession, size, n, seed, {r["part"]: r["lanes"] for r in lanes}).select(
        "part", "lane", F.lit(0).alias("kind"), F.col("block").alias("at"), "times", *[F.lit(None).cast(t).alias(c) for c, t in (("grp", "string"), ("score", "double"), ("n", "double"), ("pos", "double"))])
    # a row of draws is long and means much work, so tasks are not merged by their bytes
    deal = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (16 * PART)))
    dealt = drawn.unionByName(entries).repartition(deal, "part", "lane").sortWithinPartitions("part", "lane", "kind", "at")
    sums = "grp string, score double, n array<double>, pos array<double>"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        here, blocks, times = None, [], None
        for batch in batches:
            place = [batch.column(i).to_numpy() for i in (0, 1)]
            bounds = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([p[1:] != p[:-1] for p in place])) + 1, [batch.num_rows]])
            for begin, end in itertools.pairwise(bounds.tolist()):
                if here != (here := (place[0][begin], place[1][begin])):
                    blocks, times = [], None
                first = begin + int(np.searchsorted(batch.column(2).to_numpy()[begin:end], 1))
                blocks += [{"block": b, "times": t} for b, t in zip(batch.column(3)[begin:first].to_pylist(), batch.column(4)[begin:first].to_pylist(), strict=True)]
                if first == end:
                    continue
                if times is None:
                    times = _times(blocks, min(PART, size - here[0] * PART)).astype(np.float64)
                    blocks = []
                at, *weight = (batch.column(i)[first:end].to_numpy(zero_copy_only=False) for i in (3, 7, 8))
                grp, score = (batch.column(i)[first:end].dictionary_encode(null_encoding="encode") for i in (5, 6))
                found, code = np.unique(grp.indices.to_numpy().astype(np.int64) * len(score.dictionary) + score.indices.to_numpy(), return_inverse=True)
                both = [x.tolist() for x in np.divmod(found, len(score.dictionary))]
                names = [(g, v) for g, v in zip(grp.dictionary.take(pa.array(both[0])).to_pylist(), score.dictionary.take(pa.array(both[1])).to_pylist(), strict=True)]
                order = np.argsort(code, kind="stable")
                for low in range(0, len(names), 32):
                    own = order[slice(*np.searchsorted(code[order], (low, low + 32)))]
                    trees_here, column = np.unique(at[own], return_inverse=True)
                    side = np.stack([np.bincount((code[own] - low) * len(trees_here) + column, w[own], 32 * len(trees_here)) for w in weight]).reshape(2, 32, -1)
                    for k, vectors in zip(names[low : low + 32], (side @ times[trees_here]).swapaxes(0, 1), strict=False):
                        held[k] = held[k] + vectors if k in held else vectors.copy()
                if len(held) > SCORES:
                    yield from told(held)
                    held = {}
        yield from told(held)

    def told(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for names in itertools.batched(held, 64):
            both = np.stack([held[k] for k in names])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in names], pa.string()), pa.array([k[1] for k in names], pa.float64()), _vector(both[:, 0]), _vector(both[:, 1])], names=["grp", "score", "n", "pos"])

    # ranges are sampled before they are cut, so the sums are written first
    partial = written(dealt.mapInArrow(gather, sums), "sums")
    return written(partial.repartitionByRange(F.col("grp"), F.col("score").desc()).withColumn("part", F.spark_partition_id()), "ranged")


def _areas_interval(df: DataFrame, ranged: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Intervals of the areas from the ranges of ``_ranged_sums``."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of every (part, grp)."""
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for k, x, y in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), _matrix(batch.column(2), n), _matrix(batch.column(3), n), strict=True):
                total = held.setdefault(k, np.zeros((2, n)))
                total[0] += x
                total[1] += y
        for (part, grp), total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([grp], pa.string()), _vector(total[:1]), _vector(total[1:])], names=["part", "grp", "n", "pos"])

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of (grp, part): the sums of the group's parts before."""
        last, total = None, np.zeros((2, n))
        for batch in batches:
            for part, grp, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch.column(2), n), _matrix(batch.column(3), n), strict=True):
                if grp != last:
                    last, total = grp, np.zeros((2, n))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([grp], pa.string()), _vector(total[:1]), _vector(total[1:])], names=["part", "grp", "n", "pos"])
                total = total + np.stack([x, y])

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shares of a range in the two areas and in the counts, from the sums above it and its rows in falling order of score."""
        here, score, summed = None, None, np.zeros((4, n))
        running, open_ = np.zeros((2, n)), np.zeros((2, n))

        def close() -> None:
            nonlocal running
            running = running + open_
            with np.errstate(invalid="ignore", divide="ignore"):
                summed[0] += np.where(running[0] > 0, open_[1] * running[1] / running[0], 0.0)
            summed[1] += (open_[0] - open_[1]) * (running[1] - open_[1] / 2)
            summed[2:] += open_
            open_[:] = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([here[1]], pa.string()), *[_vector(x[None, :]) for x in summed]], names=["grp", "ap", "u", "n", "pos"])

        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for (part, grp, kind, at), x, y in zip(names, _matrix(batch.column(4), n), _matrix(batch.column(5), n), strict=True):
                if kind == 0:
                    if here is not None:
                        close()
                        yield told()
                    here, score, running = (part, grp), None, np.stack([x, y])
                    summed, open_ = np.zeros((4, n)), np.zeros((2, n))
                    continue
                if score is not None and at != score:
                    close()
                score = at
                open_[0] += x
                open_[1] += y
        if here is not None:
            close()
            yield told()

    kinds = "part int, grp string, n array<double>, pos array<double>"
    # a file may be read by several tasks, so the sums of a range are added up once more; as many rows as there are ranges
    held = ranged.select("part", "grp", "n", "pos").mapInArrow(totals, kinds).repartition("part").mapInArrow(totals, kinds)
    offsets = held.repartition("grp").sortWithinPartitions("grp", "part").mapInArrow(above, kinds)
    rows = offsets.select("part", "grp", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("score"), "n", "pos").unionByName(ranged.select("part", "grp", F.lit(1).alias("kind"), "score", "n", "pos"))
    shares = rows.repartition("part").sortWithinPartitions("part", "grp", "kind", F.col("score").desc()).mapInArrow(areas, "grp string, ap array<double>, u array<double>, n array<double>, pos array<double>")
    each = shares.select("grp", F.posexplode(F.arrays_zip("ap", "u", "n", "pos")).alias("rep", "v")).groupBy("grp", "rep").agg(*[F.sum(f"v.{c}").alias(c) for c in ("ap", "u", "n", "pos")])
    negatives = F.col("n") - F.col("pos")
    fields = ", ".join(f"{c} {t}" for c, t in df.select(*by).dtypes)
    values = each.filter((F.col("pos") > 0) & (negatives > 0)).select(
        F.from_json("grp", fields).alias("g"), (F.col("ap") / F.col("pos")).alias("average_precision"), (F.col("u") / (F.col("pos") * negatives)).alias("auroc"))
    return _interval(values.select("g.*", "average_precision", "auroc"), by, ["average_precision", "auroc"])


def bootstrap_mean(df: DataFrame, columns: Sequence[str], n: int = 2000, seed: int = 42, key: str = "tree_id") -> DataFrame:
    """Mean and interval of per-tree values, one row per column; missing values leave the pool.

    Columns with equally many values share their draws; the values of a part of the trees meet its counts once.
    """
    long = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("m")).select(key, "m.metric", "m.value").filter(F.col("value").isNotNull())
    with scratch(df.sparkSession) as tables:
        ranked = written(grouped_rank(long, ["metric"], [F.col(key)], "_rank").select("metric", "value", (F.col("_rank") - 1).alias("_index")), "ranked")
        sizes = written(ranked.groupBy("metric").agg(F.count(F.lit(1)).alias("_size"), F.avg("value").alias("mean")), "sizes")
        named: dict[int, list[str]] = {}
        for r in sizes.collect():
            named.setdefault(r["_size"], []).append(r["metric"])
        parts = [_drawn_sums(ranked.filter(F.col("metric").isin(names)), size, n, seed) for size, names in named.items()]
        tables.keep(sizes)
        sums = tables.keep(written(reduce(DataFrame.unionByName, parts), "drawn")) if parts else None
    if sums is None:
        return sizes.select("metric", "mean", F.col("mean").alias("ci95_low"), F.col("mean").alias("ci95_high"))
    means = sums.groupBy("metric", "rep").agg(F.sum("total").alias("total")).join(F.broadcast(sizes), "metric")
    ci = means.withColumn("drawn_mean", F.col("total") / F.col("_size")).groupBy("metric").agg(
        F.percentile("drawn_mean", 0.025).alias("ci95_low"), F.percentile("drawn_mean", 0.975).alias("ci95_high")
    )
    return sizes.select("metric", "mean").join(ci, "metric")


def _drawn_sums(ranked: DataFrame, size: int, n: int, seed: int) -> DataFrame:
    """(metric, rep, total): what tasks add to the sum of a resample, of metrics with ``size`` values each."""
    entry = F.struct("metric", (F.col("_index") % PART).alias("at"), "value")
    entries = ranked.groupBy(F.floor(F.col("_index") / PART).alias("part")).agg(F.collect_list(entry).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                metric, at, value = (c.to_numpy(zero_copy_only=False) for c in batch.column(1)[i].values.flatten())
                times = _times(batch.column(2)[i].as_py(), min(PART, size - part * PART))
                for name in np.unique(metric):
                    own = metric == name
                    drawn, values = times[at[own]], value[own]
                    fine = np.isfinite(values)
                    total = np.where(fine, values, 0.0) @ drawn.astype(np.float64)
                    for v, counts in zip(values[~fine], drawn[~fine], strict=True):  # not finite only where it is drawn
                        total = np.where(counts > 0, total + v, total)
                    held[name] = held[name] + total if name in held else total
        for name, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n)), pa.array(total)], names=["metric", "rep", "total"])

    whole = entries.hint("merge").join(draws(ranked.sparkSession, size, n, seed), "part").select("part", "entries", "times")
    return whole.mapInArrow(run, "metric string, rep long, total double")


# fixed values: Chebyshev coefficients of erfc, constant term first
ERFC_TERMS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, fractional error below 1.2e-7."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly: Column = F.lit(ERFC_TERMS[-1])
    for c in reversed(ERFC_TERMS[:-1]):
        poly = poly * t + F.lit(c)
    return t * F.exp(poly - x * x)


def erfc_sql(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0 + 0.5 * ({x})))"
    poly = f"{ERFC_TERMS[-1]}::DOUBLE"
    for c in reversed(ERFC_TERMS[:-1]):
        poly = f"(({poly}) * {t} + ({c}::DOUBLE))"
    return f"({t} * exp({poly} - ({x}) * ({x})))"


def signed_rank_p(deltas: DataFrame, value: str = "delta") -> DataFrame:
    """Two-sided Wilcoxon signed-rank p by the normal approximation with tie correction."""
    used = deltas.filter(F.abs(F.col(value)) > 1e-12).select(F.col(value), F.abs(F.col(value)).alias("size"))
    ties = used.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) > 0).alias("ups"))
    running = running_totals(ties, [], [F.col("size")], {"upto": F.col("n")})
    n = F.col("n").cast("double")
    rank = F.col("upto") - (n - 1) / 2
    sums = running.agg(
        F.coalesce(F.sum(F.col("ups") * rank), F.lit(0.0)).alias("up"),
        F.coalesce(F.sum(n), F.lit(0.0)).alias("n"),
        F.coalesce(F.sum(n * n * n - n), F.lit(0.0)).alias("tie"),
    )
    m = F.col("n")
    centre = m * (m + 1) / 4
    spread = F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("tie") / 2) / 24)
    low = F.least(F.col("up"), m * (m + 1) / 2 - F.col("up"))
    z = F.abs(low - centre) / spread
    return sums.select(F.when(m > 0, erfc(z / F.sqrt(F.lit(2.0)))).otherwise(1.0).alias("p_value"))


def paired_delta(pairs: DataFrame, a: str, b: str, n: int = 2000, seed: int = 42, key: str = "tree_id") -> DataFrame:
    """Mean of b - a with its bootstrap interval and signed-rank p."""
    deltas = pairs.select(key, (F.col(b) - F.col(a)).alias("delta")).filter(F.col("delta").isNotNull())
    means = bootstrap_mean(deltas, ["delta"], n, seed, key)
    return attach_scalars(means, signed_rank_p(deltas)).select(
        F.col("mean").alias("delta"), F.col("ci95_low").alias("ci_low"), F.col("ci95_high").alias("ci_high"), "p_value"
    )


def ensemble(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Mean score over models or seeds."""
    return df.groupBy(*keys).agg(F.avg(score).alias(score), F.count(F.lit(1)).alias("members"))


def select_model(metrics: DataFrame, metric: str = "average_precision") -> DataFrame:
    """The model with the best metric, first name on ties: an aggregate, not a sort."""
    best = metrics.agg(F.max(F.col(metric)).alias("_best"))
    return attach_scalars(metrics, best).filter(F.col(metric) == F.col("_best")).groupBy(
        F.col(metric).alias(metric)
    ).agg(F.min("model").alias("model"))


def mean_contrast(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Mean of positives and negatives per column and their distance in negative deviations."""
    aggs = []
    for c in columns:
        pos, neg = F.when(F.col(label) == 1, F.col(c)), F.when(F.col(label) == 0, F.col(c))
        aggs += [F.avg(pos).alias(f"p_{c}"), F.avg(neg).alias(f"n_{c}"), F.stddev_samp(neg).alias(f"s_{c}")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"p_{c}").alias("mean_positive"),
            F.col(f"n_{c}").alias("mean_negative"),
            F.col(f"s_{c}").alias("std_negative"),
            ((F.col(f"p_{c}") - F.col(f"n_{c}")) / F.greatest(F.col(f"s_{c}"), F.lit(1e-9))).alias("standardized_shift"),
        )
        for c in columns
    ]))
    return wide.select(rows.alias("r")).select("r.*")
