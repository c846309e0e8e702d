"""Connected components of a table of links, by labels that fall to the smallest id. Plain joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemweave.plans.durable import written


def components(links: DataFrame) -> DataFrame:
    """(row, comp) for every row in ``links`` (a, b): comp is the smallest row that it is linked to by any path.

    A round takes the least label among a row and its neighbours, then the label of that label, so a path halves at
    least; it ends when nothing changes. Minima are combined before the shuffle, so a hub is no hot task.
    """
    pairs = links.select(F.col("a").alias("row"), F.col("b").alias("to"))
    edges = written(pairs.unionByName(links.select(F.col("b").alias("row"), F.col("a").alias("to"))).distinct(), "edges")
    labels = written(edges.groupBy("row").agg(F.least(F.min("to"), F.col("row")).alias("comp")), "labels")
    while True:
        near = (
            edges.join(labels.withColumnRenamed("row", "to"), "to").groupBy("row").agg(F.min("comp").alias("near"))
            .join(labels, "row").select("row", "comp", F.least("near", "comp").alias("low"))
        )
        jump = labels.select(F.col("row").alias("low"), F.col("comp").alias("lower"))
        moved = near.join(jump, "low", "left").select("row", F.least("low", F.coalesce("lower", "low")).alias("comp"), F.col("comp").alias("was"))
        moved = written(moved, "labels")
        labels = moved.select("row", "comp")
        if moved.filter("comp != was").isEmpty():
            return labels
