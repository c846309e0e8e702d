"""Views that give the driver's tables the shapes the operators work on.

Each view is a row-wise projection (or a key join), so its size follows the table it comes from.
``SQL`` holds the same views as common table expressions for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemweave.catalog.base import table

SQL: dict[str, str] = {}


def with_views(*names: str, extra: str = "") -> str:
    parts = [f"{n} AS ({SQL[n]})" for n in names]
    if extra:
        parts.append(extra)
    return "WITH " + ", ".join(parts) + " "


# --- candidates: one row per (model, segment) -------------------------------------------------

SQL["lines"] = """
SELECT o_custkey AS tree_id, l_orderkey AS sample_id,
       concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS segment_id,
       CAST(l_returnflag = 'R' AS BIGINT) AS label,
       CASE WHEN l_linenumber % 3 = 0 THEN 'a--b' WHEN l_linenumber % 3 = 1 THEN 'b--c' ELSE 'c--c' END AS candidate_type,
       l_discount, l_tax, l_quantity, l_extendedprice, l_linenumber, l_partkey, l_suppkey, l_linestatus
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    number = F.col("l_linenumber") % 3
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("tree_id"),
        F.col("l_orderkey").alias("sample_id"),
        F.concat_ws(
            "-",
            F.col("l_linenumber").cast("string"),
            F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"),
            F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
        ).alias("segment_id"),
        (F.col("l_returnflag") == "R").cast("long").alias("label"),
        F.when(number == 0, "a--b").when(number == 1, "b--c").otherwise("c--c").alias("candidate_type"),
        "l_discount", "l_tax", "l_quantity", "l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus",
    )


SQL["candidates"] = f"""
SELECT model, tree_id, sample_id, segment_id, candidate_type, label, score, CAST(score >= 0.5 AS BIGINT) AS prediction
FROM (SELECT 'A' AS model, *, round(l_discount * 10 + l_tax, 4) AS score FROM ({SQL["lines"]}) p
      UNION ALL SELECT 'B' AS model, *, l_quantity / 50 AS score FROM ({SQL["lines"]}) q) u"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array(
        F.struct(F.lit("A").alias("model"), F.round(F.col("l_discount") * 10 + F.col("l_tax"), 4).alias("score")),
        F.struct(F.lit("B").alias("model"), (F.col("l_quantity") / 50).alias("score")),
    )
    return (
        lines(spark, sf_dir)
        .withColumn("m", F.explode(both))
        .select(
            "m.model", "tree_id", "sample_id", "segment_id", "candidate_type", "label", "m.score",
            (F.col("m.score") >= 0.5).cast("long").alias("prediction"),
        )
    )


SQL["adjacency"] = f"""
SELECT a.sample_id, a.segment_id AS src, b.segment_id AS dst FROM ({SQL["lines"]}) a
JOIN ({SQL["lines"]}) b ON a.sample_id = b.sample_id AND abs(a.l_linenumber - b.l_linenumber) <= 1 AND a.segment_id <> b.segment_id"""


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a view are adjacent when their line numbers differ by one at most."""
    rows = lines(spark, sf_dir).select("sample_id", "segment_id", "l_linenumber").filter("sample_id IS NOT NULL AND l_linenumber IS NOT NULL")
    # lines come dealt by sample from their join, so a frame over the line numbers needs no shuffle of its own
    frame = Window.partitionBy("sample_id").orderBy("l_linenumber").rangeBetween(-1, 1)
    near = rows.select("sample_id", F.col("segment_id").alias("src"), F.collect_list("segment_id").over(frame).alias("near"))
    return near.select("sample_id", "src", F.explode("near").alias("dst")).filter("src <> dst")


# --- events as strokes, marks and cut lines ----------------------------------------------------

EPOCH_2024_US = 1704067200000000

SQL["strokes"] = f"""
SELECT user_id AS sample_id, event_id AS edge_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       (epoch_us(ts) - {EPOCH_2024_US}) / 3600000000.0::DOUBLE AS x0, value AS y0,
       (epoch_us(ts) - {EPOCH_2024_US}) / 3600000000.0::DOUBLE + CAST(json_extract(props, '$.k') AS BIGINT) / 10.0::DOUBLE AS x1,
       value + (CAST(json_extract(props, '$.k') AS BIGINT) - 50) / 5.0::DOUBLE AS y1
FROM events"""


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a short stroke: x in hours, y its value."""
    k = F.get_json_object("props", "$.k").cast("long")
    x = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_2024_US)) / F.lit(3600000000.0)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample_id"), F.col("event_id").alias("edge_id"), "event_type", k.alias("k"),
        x.alias("x0"), F.col("value").alias("y0"),
        (x + k / F.lit(10.0)).alias("x1"), (F.col("value") + (k - 50) / F.lit(5.0)).alias("y1"),
    )


SQL["cut_lines"] = f"""
SELECT CAST(sample_id AS VARCHAR) AS sample_id, CASE WHEN k = 3 THEN '' ELSE concat('c', edge_id % 40) END AS cut_id, [x0, y0] AS p0,
       CASE WHEN k % 19 = 0 THEN [x1] WHEN k % 23 = 0 THEN [x0, y0] ELSE [x1, y1] END AS p1,
       CASE WHEN k % 17 = 0 THEN NULL WHEN k % 7 = 0 THEN [1.1::DOUBLE, 0.0::DOUBLE] ELSE [0.6::DOUBLE, 0.8::DOUBLE] END AS normal_pruned_side,
       CASE WHEN k % 29 = 0 THEN NULL WHEN k % 11 = 0 THEN [0.6::DOUBLE, 0.8::DOUBLE] ELSE [-0.6::DOUBLE, -0.8::DOUBLE] END AS normal_retained_side,
       CASE WHEN k % 13 = 0 THEN NULL ELSE k % 5 <> 0 END AS confirmed
FROM ({SQL["strokes"]}) s"""


def cut_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut lines with every kind of defect, decided by the number each event carries."""
    k = F.col("k")
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return strokes(spark, sf_dir).select(
        F.col("sample_id").cast("string").alias("sample_id"),
        F.when(k == 3, "").otherwise(F.concat(F.lit("c"), (F.col("edge_id") % 40).cast("string"))).alias("cut_id"),
        F.array("x0", "y0").alias("p0"),
        F.when(k % 19 == 0, F.array("x1")).when(k % 23 == 0, F.array("x0", "y0")).otherwise(F.array("x1", "y1")).alias("p1"),
        F.when(k % 17 == 0, None).when(k % 7 == 0, pair(1.1, 0.0)).otherwise(pair(0.6, 0.8)).alias("normal_pruned_side"),
        F.when(k % 29 == 0, None).when(k % 11 == 0, pair(0.6, 0.8)).otherwise(pair(-0.6, -0.8)).alias("normal_retained_side"),
        F.when(k % 13 == 0, None).otherwise(k % 5 != 0).alias("confirmed"),
    )


# --- documents as files and runs ----------------------------------------------------------------

SQL["files"] = """
SELECT doc_id, concat(source, '/', doc_id) AS path, CAST(doc_id AS VARCHAR) AS sample_id, source AS tree_id, lang AS task,
       concat('s', doc_id) AS source_id, sha256(text) AS sha256, n_chars, quality, toxic
FROM documents LEFT JOIN labels USING (doc_id)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "n_chars"
    )
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("tree_id"), F.col("lang").alias("task"),
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_id"), "sha256", "n_chars", "quality", "toxic",
    )


# --- embeddings as polylines, lineitem as boxes and pixels ---------------------------------------

SQL["path_points"] = """
SELECT vec_id // 8 AS sample_id, vec_id AS group_id, label, i AS pos, embedding[2 * i + 1]::DOUBLE * 1000 AS x, embedding[2 * i + 2]::DOUBLE * 1000 AS y
FROM embeddings, range(32) r(i)"""
# consecutive points of a path, with the arc length up to the edge
SQL["path_edges"] = f"""
SELECT *, sum(len) OVER (PARTITION BY group_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM (
  SELECT sample_id, group_id, label, pos, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ({SQL["path_points"]}) p
  WINDOW w AS (PARTITION BY group_id ORDER BY pos)) q WHERE x1 IS NOT NULL) e"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a polyline of half its length: (e0, e1), (e2, e3), ... in thousandths."""
    at = lambda i: F.get("embedding", i).cast("double") * 1000
    poly = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1),
        lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")),
    )
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 8").alias("sample_id"), F.col("vec_id").alias("group_id"), "label", poly.alias("poly")
    )


SQL["boxes"] = """
SELECT l_suppkey AS sample_id, segment_id AS box_id, sample_id AS view, l_quantity AS x1, 100 * l_discount AS y1,
       l_quantity + 4 + 50 * l_tax AS x2, 100 * l_discount + 2 + l_linenumber AS y2, l_extendedprice AS score, l_linenumber % 2 AS label, l_partkey AS partkey, tree_id AS tree_id
FROM (""" + SQL["lines"] + ") l"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return lines(spark, sf_dir).select(
        c("l_suppkey").alias("sample_id"), c("segment_id").alias("box_id"), c("sample_id").alias("view"), c("l_quantity").alias("x1"),
        (100 * c("l_discount")).alias("y1"), (c("l_quantity") + 4 + 50 * c("l_tax")).alias("x2"),
        (100 * c("l_discount") + 2 + c("l_linenumber")).alias("y2"), c("l_extendedprice").alias("score"), (c("l_linenumber") % 2).alias("label"),
        c("l_partkey").alias("partkey"), "tree_id",
    )


SQL["pixels"] = "SELECT DISTINCT l_suppkey AS sample_id, l_returnflag AS layer, l_partkey % 64 AS x, l_orderkey % 64 AS y FROM lineitem"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sample_id"), F.col("l_returnflag").alias("layer"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_orderkey") % 64).alias("y")
    ).distinct()


# --- strokes as edges, purchases as points, errors as cut lines ------------------------------------

SQL["marks"] = f"SELECT sample_id, edge_id AS mark_id, k, x0 AS px, y0 AS py, concat('g', k % 4) AS group_id FROM ({SQL['strokes']}) s WHERE event_type = 'purchase'"
SQL["edges"] = f"""SELECT sample_id, edge_id AS segment_id, 0 AS pos, concat('g', k % 5) AS group_id, k, x0, y0, x1, y1 FROM ({SQL['strokes']}) s WHERE event_type NOT IN ('purchase', 'error')"""
SQL["cuts"] = f"SELECT sample_id, edge_id AS cut_id, k, x0 AS ax0, y0 - 30 AS ay0, x1 + 4 AS ax1, y1 + 30 AS ay1, 0.6::DOUBLE AS nx, 0.8::DOUBLE AS ny FROM ({SQL['strokes']}) s WHERE event_type = 'error'"


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strokes(spark, sf_dir).filter("event_type = 'purchase'").select(
        "sample_id", F.col("edge_id").alias("mark_id"), "k", F.col("x0").alias("px"), F.col("y0").alias("py"), F.concat(F.lit("g"), (F.col("k") % 4).cast("string")).alias("group_id")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strokes(spark, sf_dir).filter("event_type NOT IN ('purchase', 'error')").select(
        "sample_id", F.col("edge_id").alias("segment_id"), F.lit(0).alias("pos"), F.concat(F.lit("g"), (F.col("k") % 5).cast("string")).alias("group_id"), "k", "x0", "y0", "x1", "y1"
    )


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strokes(spark, sf_dir).filter("event_type = 'error'").select(
        "sample_id", F.col("edge_id").alias("cut_id"), "k", F.col("x0").alias("ax0"), (F.col("y0") - 30).alias("ay0"), (F.col("x1") + 4).alias("ax1"), (F.col("y1") + 30).alias("ay1"),
        F.lit(0.6).alias("nx"), F.lit(0.8).alias("ny"),
    )


# --- embeddings as annotated groups on a pixel grid ------------------------------------------------

SQL["vertices"] = """
SELECT vec_id // 8 AS sample_id, vec_id AS group_id, i AS pos, round_even(embedding[2 * i + 1]::DOUBLE * 1000 / 1000 * 60, 0)::BIGINT AS x, round_even(embedding[2 * i + 2]::DOUBLE * 1000 / 1000 * 60, 0)::BIGINT AS y,
       (round_even(embedding[2 * i + 1]::DOUBLE * 1000 / 1000 * 60, 0)::BIGINT + 1048576) * 4194304 + round_even(embedding[2 * i + 2]::DOUBLE * 1000 / 1000 * 60, 0)::BIGINT + 1048576 AS node_id
FROM embeddings, range(32) r(i)"""
SQL["gedges"] = f"""
SELECT DISTINCT a.sample_id, a.group_id, least(a.node_id, b.node_id) AS src, greatest(a.node_id, b.node_id) AS dst
FROM ({SQL["vertices"]}) a JOIN ({SQL["vertices"]}) b ON a.group_id = b.group_id AND b.pos = a.pos + 1 AND a.node_id <> b.node_id"""
SQL["uedges"] = f"SELECT DISTINCT sample_id, src, dst FROM ({SQL['gedges']}) g"
SQL["unodes"] = f"SELECT DISTINCT sample_id, node_id, x, y FROM ({SQL['vertices']}) v"


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight embeddings to a sample; every one a group whose points snap to a coarse pixel grid."""
    p = paths(spark, sf_dir)
    pixel = F.transform("poly", lambda q: F.struct(F.rint(q.x / 1000 * 60).alias("x"), F.rint(q.y / 1000 * 60).alias("y")))
    return p.select("sample_id", "group_id", pixel.alias("points"), F.array().cast("array<array<int>>").alias("edges"), F.when(F.col("group_id") % 8 == 0, "trunk").otherwise("branch").alias("group_type"))
