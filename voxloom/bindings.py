"""Volume, graph and score tables derived from the given parquet tables.

Every view is a plain column derivation over a whole table, so it grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.support import tasks_for

LATTICE = (41, 43, 47)
CELLS = 41 * 43 * 47
EDGE_BLOCK = 150
#: Rows of lineitem one task groups to voxels.
TASK_ROWS = 250_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def voxel_tasks(spark: SparkSession, sf: str) -> int:
    """Tasks that the voxels are worth, from the number of lines (counted from footers)."""
    return tasks_for(spark, table(spark, sf, "lineitem").count(), TASK_ROWS)


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse labelled voxels: volume_id, z, y, x, gt, pred, mask, intensity."""
    code = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    lines = table(spark, sf, "lineitem")
    rows = (
        lines.select(
            F.expr("l_orderkey div 1500").alias("volume_id"),
            (F.col("l_orderkey") % 41).cast("int").alias("z"),
            (F.col("l_partkey") % 43).cast("int").alias("y"),
            ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 47).cast("int").alias("x"),
            code.alias("code"), "l_linenumber", "l_linestatus",
            F.col("l_quantity").cast("int").alias("q")))
    # more lines than the session's partitions can hold meet by slice in as many tasks as they need
    parts = voxel_tasks(spark, sf)
    if parts > tasks_for(spark, 0, TASK_ROWS):
        rows = rows.repartition(parts, "volume_id", "z")
    grouped = (
        rows.groupBy("volume_id", "z", "y", "x")
        .agg(F.min("code").alias("gt"),
             F.sum("l_linenumber").alias("lines"),
             F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("mask"),
             F.min("q").alias("intensity")))
    pred = (F.when(F.col("lines") % 7 == 0, 0)
            .when(F.col("lines") % 5 == 0, F.col("gt") % 3 + 1)
            .otherwise(F.col("gt")))
    return grouped.select("volume_id", "z", "y", "x", "gt", pred.alias("pred"), "mask", "intensity")


VOX = """vox AS (
SELECT volume_id, z, y, x, gt,
       CASE WHEN lines % 7 = 0 THEN 0 WHEN lines % 5 = 0 THEN gt % 3 + 1 ELSE gt END AS pred,
       mask, intensity
FROM (SELECT l_orderkey // 1500 AS volume_id,
             CAST(l_orderkey % 41 AS INT) AS z, CAST(l_partkey % 43 AS INT) AS y,
             CAST((l_suppkey * 7 + l_linenumber) % 47 AS INT) AS x,
             MIN(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS gt,
             SUM(l_linenumber) AS lines,
             MAX(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS mask,
             MIN(CAST(l_quantity AS INT)) AS intensity
      FROM lineitem GROUP BY 1, 2, 3, 4))"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Skeleton edges: graph_id, eid, src, dst, length."""
    c = F.col("c_custkey")
    gid = F.expr("c_custkey div 150")
    return table(spark, sf, "customer").select(
        gid.alias("graph_id"), c.alias("eid"), c.alias("src"),
        (gid * EDGE_BLOCK + ((c % EDGE_BLOCK) * 7 + F.col("c_nationkey")) % EDGE_BLOCK).alias("dst"),
        (F.abs("c_acctbal") / 1000).alias("length"))


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Skeleton vertices: graph_id, vid, z, y, x, radius (distance-map value)."""
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.expr("c_custkey div 150").alias("graph_id"), c.alias("vid"),
        (c % 41).cast("int").alias("z"), (c % 43).cast("int").alias("y"), (c % 47).cast("int").alias("x"),
        (1 + F.col("c_nationkey") % 5).alias("radius"))


GRAPH = """edge AS (
SELECT c_custkey // 150 AS graph_id, c_custkey AS eid, c_custkey AS src,
       (c_custkey // 150) * 150 + ((c_custkey % 150) * 7 + c_nationkey) % 150 AS dst,
       ABS(c_acctbal) / 1000 AS length
FROM customer),
vertex AS (
SELECT c_custkey // 150 AS graph_id, c_custkey AS vid,
       CAST(c_custkey % 41 AS INT) AS z, CAST(c_custkey % 43 AS INT) AS y, CAST(c_custkey % 47 AS INT) AS x,
       1 + c_nationkey % 5 AS radius
FROM customer)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score table: case_id, experiment, metric, value."""
    return (table(spark, sf, "events")
            .groupBy((F.col("user_id") % 10).alias("case_id"), F.col("event_type").alias("experiment"),
                     (F.col("event_id") % 3).alias("metric"))
            .agg(F.max("value").alias("value")))


SCORE = """score AS (
SELECT user_id % 10 AS case_id, event_type AS experiment, event_id % 3 AS metric, MAX(value) AS value
FROM events GROUP BY 1, 2, 3)"""


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """One loss value per (run, epoch): run = event type, epoch = day number."""
    return (table(spark, sf, "events")
            .groupBy(F.col("event_type").alias("run"),
                     F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("epoch"))
            .agg(F.max("value").alias("value")))


EPOCH = """epochs AS (
SELECT event_type AS run, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))::INT AS epoch, MAX(value) AS value
FROM events GROUP BY 1, 2)"""


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Class scores: model, voxel, class, p (one row per array element)."""
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 2).alias("model"), F.expr("vec_id div 2").alias("voxel"),
        F.posexplode("embedding").alias("class", "p"))


PROB = """prob AS (
SELECT vec_id % 2 AS model, vec_id // 2 AS voxel,
       CAST(UNNEST(range(len(embedding))) AS INT) AS class, UNNEST(embedding) AS p
FROM embeddings)"""
