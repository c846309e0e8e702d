"""Plans that stay balanced when one key holds a large part of all rows.

``running_totals``  cumulative sums and ranks inside a key without giving a key to one task
``attach_groups``   one-row-per-key table joined to rows, null keys included
``exact_quantiles`` interpolated percentiles from a distributed histogram
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemweave.plans.durable import written

def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    exclusive: bool = False,
    whole: Mapping[str, str] | None = None,
    running: str = "sum",
) -> DataFrame:
    """Add cumulative sums of ``totals`` in ``order`` within ``keys``.

    Rows are range-partitioned by (keys, order), so a heavy key is spread over consecutive
    partitions. Each partition sums on its own; the sums of a key's earlier partitions are then
    added. The number of partitions is left to the session, so small tables are coalesced. Only the
    first key of a partition can continue from an earlier one, so the table of
    offsets has fewer rows than there are partitions and is broadcast.
    ``exclusive`` leaves the current row out of its own sum. ``whole`` names columns for the sums
    over the whole key, taken from the same written rows so that the source is read once.
    ``running="max"`` keeps running maxima instead of sums.
    """
    gather = {"sum": F.sum, "max": F.max}[running]
    staged = df
    for name, value in totals.items():
        staged = staged.withColumn(f"_v_{name}", value)
    ranged = written(
        staged.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(
            "_part", F.spark_partition_id()
        ),
        "running",
    )
    block = ranged.groupBy("_part", *keys).agg(
        *[gather(f"_v_{name}").alias(f"_b_{name}") for name in totals]
    )
    blocks = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = blocks.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        block.withColumn("_first", F.min("_part").over(blocks))
        .select(
            "_part",
            *keys,
            "_first",
            *[gather(f"_b_{name}").over(earlier).alias(f"_o_{name}") for name in totals],
        )
        .filter(F.col("_part") > F.col("_first"))
        .drop("_first")
    )
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    frame = local.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    summed = ranged
    for name in totals:
        summed = summed.withColumn(f"_l_{name}", gather(f"_v_{name}").over(frame))
    joined = summed.alias("r").join(
        F.broadcast(offsets.alias("o")),
        F.col("r._part").eqNullSafe(F.col("o._part"))
        & _all_equal([(F.col(f"r.{k}"), F.col(f"o.{k}")) for k in keys]),
        "left",
    )
    zero = F.lit(0)

    def both(own: Column, carried: Column) -> Column:
        if running == "max":
            return F.greatest(own, carried)
        return F.coalesce(own, zero) + F.coalesce(carried, zero)

    result = joined.select(
        *[F.col(f"r.{c}") for c in df.columns],
        *[
            both(F.col(f"r._l_{n}"), F.col(f"o._o_{n}")).alias(n)
            for n in totals
        ],
    )
    if not whole:
        return result
    sums = [gather(f"_b_{name}").alias(column) for column, name in whole.items()]
    if keys:
        return attach_groups(result, block.groupBy(*keys).agg(*sums), keys)
    return attach_scalars(result, block.agg(*sums))


def _all_equal(pairs) -> Column:
    result = F.lit(True)
    for left, right in pairs:
        result = result & left.eqNullSafe(right)
    return result


def grouped_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Dense row numbers 1, 2, ... in ``order`` within ``keys`` (``order`` must be total)."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")})


def attach_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table with one row per key to many rows per key; null keys match each other.

    A plain equality join: adaptive execution broadcasts a small side and splits the partitions of a heavy key, so
    the one side is copied only where rows are many.
    """
    renamed = groups.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in groups.columns])
    same = _all_equal([(F.col(k), F.col(f"_k_{k}")) for k in keys])
    return rows.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(amount.alias("_n"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    name: str = "quantile",
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles, one row per (keys, prob).

    Equal values are counted first; each distinct value then knows the index range it covers and
    emits only the probabilities whose lower or upper order statistic falls into that range.
    ``weight`` is the number of times a row counts, for input that is already a histogram.
    """
    if not keys:
        pooled = df.withColumn("_all", F.lit(0))
        return exact_quantiles(pooled, ["_all"], value, probs, name, weight).drop("_all")
    counts = value_counts(df, keys, value, weight)
    joined = running_totals(counts, keys, [F.col(value)], {"_upto": F.col("_n")}, whole={"_size": "_upto"})
    asked = F.array(*[F.lit(float(p)) for p in probs])
    position = lambda p: p * (F.col("_size") - F.lit(1)).cast("double")
    inside = lambda i: (i >= F.col("_upto") - F.col("_n")) & (i < F.col("_upto"))
    hits = joined.withColumn(
        "prob",
        F.explode(F.filter(asked, lambda p: inside(F.floor(position(p))) | inside(F.ceil(position(p))))),
    )
    low = F.max(F.when(inside(F.floor(position(F.col("prob")))), F.col(value)))
    high = F.max(F.when(inside(F.ceil(position(F.col("prob")))), F.col(value)))
    share = F.max(position(F.col("prob")) - F.floor(position(F.col("prob"))))
    return (
        hits.groupBy(*keys, "prob")
        .agg(low.alias("_lo"), high.alias("_hi"), share.alias("_w"))
        .select(*keys, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).alias(name))
    )


def attach_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate next to every row (the broadcast is that one row)."""
    one = scalars.withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")
