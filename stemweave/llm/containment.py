"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact shingles.

A shingle is five consecutive words (runs of characters other than space, tab, line feed, vertical tab, form feed,
carriage return), in lower case. An item's MinHash values are kept as the shingles that take the minimum, so each is
a uniform draw from the item: the share of draws found in a document estimates |item and document| / |item| at any
document length, where a symmetric estimate would vanish for short items in long documents. Items are partitioned by
size: a class (powers of two of the shingle count) sets how many draws an item has, how many of them must be found and
the least number of shingles of a document. A second pass verifies candidates by exact containment: it counts the distinct
shingles, as 64-bit hashes, that a text shares with the item.

Only DataFrame functions. Both passes join exploded shingles to tables of the items (written, so a join broadcasts
them only when the file is below the session's threshold) and shuffle hits alone; texts are told apart by SHA-1.

Defined results: null and short texts (under five words) have no shingles and neither match nor are matched. Repeated
item rows give repeated results only if their ids differ; repeated documents give a row each. An item is a text: the
texts under one id, or without an id, are matched each on its own, and ids come back at the end. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.plans.durable import written

SIZE = 5
THRESHOLD = 0.8
#: Draws of an item by size class, the exponent of two of its shingle count; beyond the last the last holds.
DRAWS = {0: 1, 1: 3, 2: 7, 3: 12, 4: 16, 5: 16, 6: 20, 7: 24}
MISS = 1e-6


def needed(draws: int, threshold: float, miss: float = MISS) -> int:
    """The largest number of found draws that an item at the threshold reaches with a chance of 1 - miss; 1 at least."""
    below, k = 0.0, 0
    while k < draws:
        below += comb(draws, k) * threshold**k * (1 - threshold) ** (draws - k)
        if below > miss:
            break
        k += 1
    return max(1, k)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _starts(array: str) -> Column:
    return F.slice(F.col(array), 1, F.greatest(F.size(array) - (SIZE - 1), F.lit(0)))


def _hashes(array: str) -> Column:
    return F.transform(_starts(array), lambda w, i: F.xxhash64(w, *[F.get(array, i + j) for j in range(1, SIZE)]))


def _key(text_col: str) -> Column:
    return F.sha1(F.coalesce(F.col(text_col), F.lit("")))


def item_shingles(items: DataFrame, text_col: str) -> DataFrame:
    """Distinct (item, shingle hash) with the item's number of shingles; an item is the key of its text."""
    split = items.select(_key(text_col).alias("item"), words(F.col(text_col)).alias("w"))
    single = split.select("item", F.explode(_hashes("w")).alias("shingle")).distinct()
    sizes = single.groupBy("item").agg(F.count(F.lit(1)).alias("size"))
    return single.join(sizes, "item").select("item", "shingle", "size")


def signatures(shingled: DataFrame, threshold: float) -> DataFrame:
    """(hash, item, draw bit, need, least): the shingles that take each draw's minimum, by size class."""
    exponent = F.least(F.floor(F.log2("size") + 1e-9), F.lit(max(DRAWS)))
    draws = F.element_at(F.create_map(*[F.lit(x) for kv in DRAWS.items() for x in kv]), exponent.cast("int"))
    need = F.element_at(F.create_map(*[F.lit(x) for n in set(DRAWS.values()) for x in (n, needed(n, threshold))]), F.col("draws"))
    hashed = shingled.select("item", "size", F.col("shingle").alias("hash"), draws.alias("draws"))
    least = F.ceil(F.col("size") * threshold - 1e-9)
    ranked = hashed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("draws") - 1)))
    return (
        ranked.groupBy("item", "size", "draws", "draw").agg(F.min_by("hash", F.xxhash64("hash", "draw")).alias("hash"))
        .select("hash", "item", F.expr("shiftleft(1L, draw)").alias("bit"), need.alias("need"), least.alias("least"))
    )


def search(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_text: str = "text",
) -> DataFrame:
    """(text_key, item, size, shared): keys of item texts whose shingles are in a text to the share ``threshold`` at least."""
    shingled = written(item_shingles(items, item_text), "items")
    index = written(signatures(shingled, threshold), "signatures")
    texts = docs.select(_key(text_col).alias("key"), F.col(text_col).alias("text"))
    probes = texts.withColumn("w", words(F.col("text"))).select("key", F.greatest(F.size("w") - (SIZE - 1), F.lit(0)).alias("n"), F.explode(_hashes("w")).alias("hash"))
    candidates = written(
        probes.join(index, "hash").filter("n >= least")
        .groupBy("key", "item").agg(F.expr("bit_count(bit_or(bit))").alias("found"), F.max("need").alias("need"))
        .filter("found >= need").select("key", "item"),
        "candidates",
    )
    inside = probes.select("key", F.col("hash").alias("shingle")).join(shingled, "shingle").distinct()
    wanted = inside.join(candidates, ["key", "item"], "left_semi")
    found = wanted.groupBy("key", "item", "size").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= F.ceil(F.col("size") * threshold - 1e-9))
    return found.select(F.col("key").alias("text_key"), "item", "size", "shared")


def matches(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and contained item: ids, shingles of the item, shared ones, containment."""
    ids = written(items.select(F.col(item_id).alias("_item_id"), _key(item_text).alias("item")).distinct(), "ids")
    found = written(search(docs, items, threshold, text_col, item_text).join(ids, "item"), "contained")
    keyed = docs.select(F.col(id_col).alias("_id"), _key(text_col).alias("text_key"))
    return keyed.join(found, "text_key").select(
        F.col("_id").alias(id_col), F.col("_item_id").alias(item_id), F.col("size").alias("n_shingles"),
        F.col("shared").alias("n_shared"), (F.col("shared") / F.col("size")).alias("containment"),
    )


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that contain no item, with all their columns."""
    found = written(search(docs, items, threshold, text_col).select("text_key").distinct(), "leaks")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), _key(text_col).alias("_key"))
    # the keys grow with the documents, so they are shuffled at every size and never broadcast
    kept = rows.join(found.hint("merge"), F.col("_key") == F.col("text_key"), "left_anti")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])
