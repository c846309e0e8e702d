"""Names, keys and categories as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the accepted sample name, e.g. tree_7_before_view_2.jpg; the stage may be absent
SAMPLE_PATTERN = r"tree_(\d+)(?:_(before|after))?_view_(\d+)"


def parse_sample_key(name: Column, pattern: str = SAMPLE_PATTERN, tree_width: int = 3, view_width: int = 2) -> Column:
    """struct(tree_id, stage, view_id) of a file name, null where the name does not match."""
    tree, stage, view = (F.regexp_extract(name, pattern, i) for i in (1, 2, 3))
    padded = lambda c, w: F.when(F.length(c) >= w, c).otherwise(F.lpad(c, w, "0"))
    return F.when(
        name.rlike(pattern),
        F.struct(
            padded(tree, tree_width).alias("tree_id"),
            F.when(stage == "", "single").otherwise(stage).alias("stage"),
            padded(view, view_width).alias("view_id"),
        ),
    )


def is_pair(value: Column) -> Column:
    """True for an array of exactly two finite numbers, false otherwise, never null."""
    finite = lambda i: F.get(value, F.lit(i)).isNotNull() & ~F.isnan(F.get(value, F.lit(i))) & (F.abs(F.get(value, F.lit(i))) < float("inf"))
    return F.coalesce(value.isNotNull() & (F.size(value) == 2) & finite(0) & finite(1), F.lit(False))


def review_category(acceptable: Column, harmless: Column, harmful: Column) -> Column:
    """The one active of three 0/1 marks, blank when none or several are active."""
    return F.when(acceptable + harmless + harmful != 1, "").when(acceptable == 1, "acceptable").when(
        harmless == 1, "harmless"
    ).otherwise("harmful")


def split_groups(value: Column) -> Column:
    """Group ids joined by ; , or | as an array, without blanks and the spelled-out missing value."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), "[;,|]"), lambda v: F.trim(v))
    return F.filter(parts, lambda v: (v != "") & (F.lower(v) != "nan"))
