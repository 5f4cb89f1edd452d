"""Skeleton graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.bindings import GRAPH, VOX, edges, table, vertices, voxels
from voxloom.catalog import query
from voxloom.operators import graph, quantify

G = ["graph_id"]

DEGREE = f"""{GRAPH}, ends AS (SELECT graph_id, src AS vid FROM edge UNION ALL SELECT graph_id, dst FROM edge),
deg AS (SELECT v.graph_id, v.vid, COUNT(e.vid) AS degree FROM vertex v LEFT JOIN ends e ON e.graph_id = v.graph_id AND e.vid = v.vid GROUP BY 1, 2),
wide AS (SELECT e.*, a.degree AS sd, b.degree AS dd, va.radius AS sr, vb.radius AS dr FROM edge e
  LEFT JOIN deg a ON a.graph_id = e.graph_id AND a.vid = e.src LEFT JOIN deg b ON b.graph_id = e.graph_id AND b.vid = e.dst
  LEFT JOIN vertex va ON va.graph_id = e.graph_id AND va.vid = e.src LEFT JOIN vertex vb ON vb.graph_id = e.graph_id AND vb.vid = e.dst)"""


@query("vertex_degree", f"WITH {DEGREE} SELECT * FROM deg")
def vertex_degree(spark, sf):
    return graph.vertex_degree(vertices(spark, sf), edges(spark, sf), G)


@query("leaf_edges", f"WITH {DEGREE} SELECT graph_id, COUNT(CASE WHEN sd = 1 OR dd = 1 THEN 1 END) AS leaf_edges FROM wide GROUP BY 1")
def leaf_edges(spark, sf):
    e = edges(spark, sf)
    return graph.leaf_edges(e, graph.vertex_degree(vertices(spark, sf), e, G), G)


@query("prune_edges", f"""WITH {DEGREE} SELECT graph_id, eid, src, dst, length FROM wide
WHERE NOT (((sd = 1 OR dd = 1) AND length < 2 * GREATEST(sr, dr)) OR (sd = 1 AND dd = 1 AND length < 5 / 0.75::DOUBLE))""")
def prune_edges(spark, sf):
    return graph.prune_edges(edges(spark, sf), vertices(spark, sf), G)


POINTS = f"""{VOX}, pt AS (SELECT o_custkey // 150 AS graph_id, o_custkey AS eid, CAST(o_orderkey % 41 AS INT) AS z, CAST(o_orderkey % 43 AS INT) AS y,
  CAST((o_custkey * 3 + o_orderkey) % 47 AS INT) AS x FROM orders),
rad AS (SELECT p.graph_id, p.eid, COALESCE(v.intensity, 0) AS radius FROM pt p LEFT JOIN vox v ON v.volume_id = p.graph_id AND v.z = p.z AND v.y = p.y AND v.x = p.x)"""


def _radii(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    points = table(spark, sf, "orders").select(
        F.expr("o_custkey div 150").alias("graph_id"), cust.alias("eid"), (key % 43 + 0.5).alias("c0"),
        (key % 41 + 0.25).alias("c1"), ((cust * 3 + key) % 47 + 0.75).alias("c2"))
    dmap = voxels(spark, sf).withColumnRenamed("volume_id", "graph_id")
    return graph.point_radius(points, dmap, G, "intensity")


@query("branch_radius", f"WITH {POINTS} SELECT graph_id, eid, ROUND(AVG(radius), 6) AS radius, COUNT(*) AS points FROM rad GROUP BY 1, 2")
def branch_radius(spark, sf):
    return graph.branch_radius(_radii(spark, sf), G)


@query("radius_histogram", f"""WITH {POINTS} SELECT graph_id, CASE WHEN radius < 0 THEN -1 WHEN radius > 50 THEN 10 ELSE LEAST(9, CAST(FLOOR(radius / 5.0::DOUBLE) AS INT)) END AS bin, COUNT(*) AS n FROM rad GROUP BY 1, 2""")
def radius_histogram(spark, sf):
    return quantify.histogram(_radii(spark, sf), G, "radius", 10, 0.0, 50.0)


@query("graph_summary", f"""WITH {DEGREE}, {POINTS},
a AS (SELECT graph_id, COUNT(*) AS vertices, ROUND(AVG(degree), 6) AS avg_degree, MAX(degree) AS max_degree,
  ROUND(AVG(CASE WHEN degree > 1 THEN degree END), 6) AS avg_branching, MAX(CASE WHEN degree > 1 THEN degree END) AS max_branching FROM deg GROUP BY 1),
b AS (SELECT graph_id, COUNT(*) AS edges, COUNT(CASE WHEN sd = 1 OR dd = 1 THEN 1 END) AS nerve_endings, MAX(GREATEST(src, dst)) AS ref_edges FROM wide GROUP BY 1),
c AS (SELECT graph_id, MAX(GREATEST(z, y, x)) AS ref_vertices FROM vertex GROUP BY 1),
d AS (SELECT graph_id, ROUND(AVG(radius), 6) AS avg_thickness_points, MAX(radius) AS max_thickness_points FROM rad GROUP BY 1),
e AS (SELECT graph_id, ROUND(AVG(r), 6) AS avg_thickness_line, ROUND(MAX(r), 6) AS max_thickness_line FROM (SELECT graph_id, eid, AVG(radius) AS r FROM rad GROUP BY 1, 2) GROUP BY 1)
SELECT * FROM a LEFT JOIN b USING (graph_id) LEFT JOIN c USING (graph_id) LEFT JOIN d USING (graph_id) LEFT JOIN e USING (graph_id)""")
def graph_summary(spark, sf):
    return graph.graph_summary(vertices(spark, sf), edges(spark, sf), _radii(spark, sf), G)


BLOCK = f"""{GRAPH}, block AS (SELECT DISTINCT graph_id, graph_id % 3 AS b0, graph_id // 3 % 3 AS b1, graph_id // 9 AS b2 FROM vertex)"""


def _blocks(spark, sf):
    g = F.col("graph_id")
    return vertices(spark, sf).select(g, (g % 3).alias("b0"), (F.expr("graph_id div 3") % 3).alias("b1"),
                                      F.expr("graph_id div 9").alias("b2")).distinct()


@query("block_adjacency", f"""WITH {BLOCK} SELECT a.graph_id, b.graph_id AS neighbour FROM block a JOIN block b
ON ABS(a.b0 - b.b0) + ABS(a.b1 - b.b1) + ABS(a.b2 - b.b2) = 1""")
def block_adjacency(spark, sf):
    return graph.block_adjacency(_blocks(spark, sf), [], "graph_id")


PLACED = f"""{BLOCK}, placed AS (SELECT v.graph_id, v.vid % 150 AS vid, v.z AS lz, v.y AS ly, v.x AS lx, b0, b1, b2,
  v.z + b0 * 41 AS z, v.y + b1 * 43 AS y, v.x + b2 * 47 AS x FROM vertex v JOIN block USING (graph_id)),
pairs AS (SELECT a.graph_id AS source_block, a.vid AS source, b.graph_id AS target_block, b.vid AS target,
  SQRT((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d FROM placed a JOIN placed b
  ON (a.b0 + 1 = b.b0 AND a.b1 = b.b1 AND a.b2 = b.b2 AND a.lz > 41 - 20 AND b.lz < 20)
  OR (a.b0 = b.b0 AND a.b1 + 1 = b.b1 AND a.b2 = b.b2 AND a.ly > 43 - 20 AND b.ly < 20)
  OR (a.b0 = b.b0 AND a.b1 = b.b1 AND a.b2 + 1 = b.b2 AND a.lx > 47 - 20 AND b.lx < 20))"""


def _pairs(spark, sf, hot=10_000):
    local = vertices(spark, sf).withColumn("vid", F.col("vid") % 150)
    placed = graph.add_block_offset(local, _blocks(spark, sf), [], "graph_id", (41, 43, 47))
    return graph.proximity_pairs(placed, [], "graph_id", "vid", (41, 43, 47), 20, hot)


@query("proximity_join", f"WITH {PLACED} SELECT source_block, source, target_block, target, ROUND(d, 6) AS distance FROM pairs WHERE d < 20")
def proximity_join(spark, sf):
    return _pairs(spark, sf)


@query("graph_fuse", f"""WITH {PLACED}, off AS (SELECT graph_id, CAST(COALESCE(SUM(n) OVER (ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o
  FROM (SELECT graph_id, COUNT(*) AS n FROM vertex GROUP BY 1))
SELECT src % 150 + o AS src, dst % 150 + o AS dst, 'inner' AS kind FROM edge JOIN off USING (graph_id)
UNION ALL SELECT source + a.o, target + b.o, 'fused' FROM pairs JOIN off a ON a.graph_id = source_block JOIN off b ON b.graph_id = target_block WHERE d < 20""")
def graph_fuse(spark, sf):
    local = edges(spark, sf).withColumns({"src": F.col("src") % 150, "dst": F.col("dst") % 150})
    return graph.fuse_graphs(vertices(spark, sf), local, _pairs(spark, sf, hot=50), [], "graph_id", "vid")


@query("degree_histogram", f"""WITH {DEGREE}, s AS (SELECT graph_id, MIN(degree)::DOUBLE AS a, MAX(degree)::DOUBLE AS b FROM deg GROUP BY 1),
e AS (SELECT graph_id, CASE WHEN a = b THEN a - 0.5 ELSE a END AS low, CASE WHEN a = b THEN b + 0.5 ELSE b END AS high FROM s)
SELECT graph_id, CAST(LEAST(4, FLOOR((degree - low) / ((high - low) / 5))) AS INT) AS bin, COUNT(*) AS n FROM deg JOIN e USING (graph_id) GROUP BY 1, 2""")
def degree_histogram(spark, sf):
    degrees = graph.vertex_degree(vertices(spark, sf), edges(spark, sf), G)
    return quantify.histogram(degrees, G, "degree", 5)
