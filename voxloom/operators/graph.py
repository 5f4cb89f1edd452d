"""Skeleton graphs: degrees, pruning, thickness, block fusion."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.support import ZYX, attach, materialize

# Isolated branches shorter than 5 um at 0.75 um per pixel are noise.
ISOLATED_LENGTH = 5 / 0.75


def vertex_degree(vertices: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edge ends per vertex; isolated vertices are 0 and a self-loop counts twice."""
    ends = (edges.select(*keys, F.explode(F.array("src", "dst")).alias("vid"))
            .groupBy(*keys, "vid").agg(F.count("*").alias("degree")))
    return (vertices.select(*keys, "vid").join(ends, [*keys, "vid"], "left")
            .withColumn("degree", F.coalesce("degree", F.lit(0))))


def _with_end_values(edges: DataFrame, values: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    out = edges
    for end in ("src", "dst"):
        side = values.select(*keys, F.col("vid").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        out = out.join(side, [*keys, end], "left")
    return out


def is_leaf() -> Column:
    return (F.col("src_degree") == 1) | (F.col("dst_degree") == 1)


def edges_with_degree(edges: DataFrame, degrees: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _with_end_values(edges, degrees, keys, ["degree"])


def leaf_edges(edges: DataFrame, degrees: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges (not vertices) with a free end, per graph."""
    return (edges_with_degree(edges, degrees, keys).groupBy(*keys)
            .agg(F.count(F.when(is_leaf(), 1)).alias("leaf_edges")))


def prune_edges(edges: DataFrame, vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges that stay: free-ended ones must be at least twice as long as the
    thicker end's radius, isolated ones at least the noise length."""
    degrees = vertex_degree(vertices, edges, keys)
    values = degrees.join(vertices.select(*keys, "vid", "radius"), [*keys, "vid"])
    wide = _with_end_values(edges, values, keys, ["degree", "radius"])
    short = is_leaf() & (F.col("length") < 2 * F.greatest("src_radius", "dst_radius"))
    speck = (F.col("src_degree") == 1) & (F.col("dst_degree") == 1) & (F.col("length") < ISOLATED_LENGTH)
    return wide.where(~(short | speck)).select(*edges.columns)


def point_radius(points: DataFrame, distance_map: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distance-map value at the truncated point; points are (c0, c1, c2) and the
    map is read at (c1, c0, c2). Outside the map the radius is 0."""
    at = {"z": F.col("c1").cast("int"), "y": F.col("c0").cast("int"), "x": F.col("c2").cast("int")}
    return (points.withColumns(at)
            .join(distance_map.select(*keys, *ZYX, F.col(value).alias("radius")), [*keys, *ZYX], "left")
            .withColumn("radius", F.coalesce("radius", F.lit(0))).drop(*ZYX))


def branch_radius(radii: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean point radius per branch."""
    return radii.groupBy(*keys, "eid").agg(F.round(F.avg("radius"), 6).alias("radius"), F.count("*").alias("points"))


def graph_summary(vertices: DataFrame, edges: DataFrame, radii: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per graph: endings, thickness, degree, and true as well as legacy counts.

    The legacy columns repeat the largest coordinate and the largest vertex
    number where older tables labelled them vertices and edges.
    """
    keys = list(keys)
    degrees = vertex_degree(vertices, edges, keys)
    by_degree = degrees.groupBy(*keys).agg(
        F.count("*").alias("vertices"), F.round(F.avg("degree"), 6).alias("avg_degree"),
        F.max("degree").alias("max_degree"),
        F.round(F.avg(F.when(F.col("degree") > 1, F.col("degree"))), 6).alias("avg_branching"),
        F.max(F.when(F.col("degree") > 1, F.col("degree"))).alias("max_branching"))
    by_edge = edges_with_degree(edges, degrees, keys).groupBy(*keys).agg(
        F.count("*").alias("edges"), F.count(F.when(is_leaf(), 1)).alias("nerve_endings"),
        F.max(F.greatest("src", "dst")).alias("ref_edges"))
    by_vertex = vertices.groupBy(*keys).agg(F.max(F.greatest(*ZYX)).alias("ref_vertices"))
    points = radii.groupBy(*keys).agg(F.round(F.avg("radius"), 6).alias("avg_thickness_points"),
                                      F.max("radius").alias("max_thickness_points"))
    lines = (radii.groupBy(*keys, "eid").agg(F.avg("radius").alias("_r")).groupBy(*keys)
             .agg(F.round(F.avg("_r"), 6).alias("avg_thickness_line"), F.round(F.max("_r"), 6).alias("max_thickness_line")))
    out = by_degree
    for part in (by_edge, by_vertex, points, lines):
        out = out.join(part, keys, "left")
    return out


def block_adjacency(blocks: DataFrame, keys: Sequence[str], block: str) -> DataFrame:
    """Pairs of blocks that share a face, in both directions."""
    axes = ("b0", "b1", "b2")
    steps = F.explode(F.array(*[F.struct(*[F.lit(s if i == a else 0).alias(f"d{i}") for i in range(3)])
                                for a in range(3) for s in (-1, 1)])).alias("_s")
    sent = blocks.select(*keys, F.col(block), *axes, steps).select(
        *keys, block, *[(F.col(f"b{i}") + F.col(f"_s.d{i}")).alias(f"b{i}") for i in range(3)])
    other = blocks.select(*keys, *axes, F.col(block).alias("neighbour"))
    return sent.join(other, [*keys, *axes]).select(*keys, block, "neighbour")


def add_block_offset(vertices: DataFrame, blocks: DataFrame, keys: Sequence[str], block: str, size: Sequence[int],
                     ) -> DataFrame:
    """Global vertex coordinates: local ones plus block index times block size."""
    moved = {a: F.col(a) + F.col(f"b{i}") * F.lit(n) for i, (a, n) in enumerate(zip(ZYX, size))}
    return attach(vertices, blocks, [*keys, block]).withColumns({f"l{a}": F.col(a) for a in ZYX}).withColumns(moved)


def proximity_pairs(placed: DataFrame, keys: Sequence[str], block: str, vid: str, size: Sequence[int],
                    threshold: float, hot: int = 10_000) -> DataFrame:
    """Vertex pairs closer than ``threshold`` (strictly) across a face of adjacent blocks.

    Only vertices near the shared face take part. They meet in grid cells of the
    threshold's size, so a vertex is compared with 27 cells. Cells with more than
    ``hot`` targets are split: targets are spread over the parts and the other
    side is repeated once per part, so no pair is lost.
    Each pair is reported once, from the lower block to the higher one.
    """
    keys = list(keys)
    cell = max(1, int(threshold))
    axes = ("b0", "b1", "b2")
    cells = ("_cz", "_cy", "_cx")

    def near(high: bool) -> Column:
        conditions = [(F.col(f"l{a}") > n - threshold) if high else (F.col(f"l{a}") < threshold)
                      for a, n in zip(ZYX, size)]
        return F.explode(F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)]),
                                  lambda v: v.isNotNull())).alias("_axis")

    def located(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.floor(F.col(a) / cell).cast("int") for c, a in zip(cells, ZYX)})
    base = placed.select(*keys, block, vid, *axes, *ZYX, *[f"l{a}" for a in ZYX])
    low = base.select("*", near(True)).withColumns(
        {b: F.col(b) + F.when(F.col("_axis") == i, 1).otherwise(0) for i, b in enumerate(axes)})
    high = located(base.select("*", near(False)))
    meet = [*keys, "_axis", *axes, *cells]
    # targets per cell: the split factor of hot cells
    parts = (high.groupBy(*meet).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
             .withColumn("_parts", F.ceil(F.col("_n") / hot).cast("int")).drop("_n"))
    parts = materialize(parts)
    right = (high.join(parts, meet, "left")
             .withColumn("_part", F.pmod(F.xxhash64(vid), F.coalesce("_parts", F.lit(1))).cast("int"))
             .select(*meet, "_part", F.col(block).alias("target_block"), F.col(vid).alias("target"),
                     *[F.col(a).alias(f"t{a}") for a in ZYX]))
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "zyx")])
                                 for o in product((-1, 0, 1), repeat=3)])).alias("_o")
    left = located(low).select("*", around).withColumns({c: F.col(c) + F.col(f"_o.{c[-1]}") for c in cells})
    left = (left.join(parts, meet, "left")
            .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
            .select(*meet, "_part", F.col(block).alias("source_block"), F.col(vid).alias("source"), *ZYX))
    square = F.lit(0.0)
    for a in ZYX:
        square = square + (F.col(a) - F.col(f"t{a}")).cast("double") * (F.col(a) - F.col(f"t{a}"))
    # a diagonal vertex pair can qualify through one shared face only: adjacency fixes the axis
    return (left.join(right, [*meet, "_part"]).where(square < threshold * threshold)
            .select(*keys, "source_block", "source", "target_block", "target", F.round(F.sqrt(square), 6).alias("distance")))


def fuse_graphs(vertices: DataFrame, edges: DataFrame, pairs: DataFrame, keys: Sequence[str], block: str, vid: str,
                ) -> DataFrame:
    """One edge list over all blocks with consecutive vertex numbers.

    A block's numbers start after those of the earlier blocks; the running sum is
    over one row per block. New edges from ``pairs`` are marked.
    """
    keys = list(keys)
    counts = vertices.groupBy(*keys, block).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offset = materialize(counts.select(*keys, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")))
    inner = edges.join(offset, [*keys, block]).select(
        *keys, (F.col("src") + F.col("_o")).alias("src"), (F.col("dst") + F.col("_o")).alias("dst"),
        F.lit("inner").alias("kind"))

    def side(name: str) -> DataFrame:
        return offset.select(*keys, F.col(block).alias(f"{name}_block"), F.col("_o").alias(f"_{name}"))
    fused = (pairs.join(side("source"), [*keys, "source_block"]).join(side("target"), [*keys, "target_block"])
             .select(*keys, (F.col("source") + F.col("_source")).alias("src"),
                     (F.col("target") + F.col("_target")).alias("dst"), F.lit("fused").alias("kind")))
    return inner.unionByName(fused)
