"""Connected components of sparse voxels, tile by tile and then across tiles.

A tile holds at most ``tile`` volume cells, or a whole volume of no more cells than
a default tile, so no task depends on the size of a volume. Voxels on tile faces are joined with their neighbours in other tiles;
the contracted graph of touching tile components is solved by alternating
min-label star steps, each an aggregation and an equi-join. Component ids are
the smallest C-order index of a member.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from voxloom.operators.geometry import SHAPE, Dims, fits, one_tile, placed
from voxloom.operators.grouped import map_groups
from voxloom.support import ZYX, attach, half_offsets, materialize, offset_array

TILE = (64, 64, 64)


def union_labels(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member index of each node's set after joining the given pairs."""
    root = np.arange(count)
    while True:
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            return root
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def label_points(points: np.ndarray, codes: np.ndarray, connectivity: int) -> np.ndarray:
    """Set index per point (sorted in C order); equal codes and adjacency connect."""
    low = points.min(axis=0)
    shape = points.max(axis=0) - low + 3
    grid = np.full(shape, -1, dtype=np.int64)
    z, y, x = (points - low + 1).T
    grid[z, y, x] = np.arange(len(points))
    pairs = []
    for dz, dy, dx in half_offsets(connectivity):
        other = grid[z + dz, y + dy, x + dx]
        here = np.nonzero(other >= 0)[0]
        there = other[here]
        same = codes[here] == codes[there]
        pairs.append((here[same], there[same]))
    left = np.concatenate([p[0] for p in pairs])
    right = np.concatenate([p[1] for p in pairs])
    return union_labels(len(points), left, right)


def star_roots(edges: DataFrame, keys: Sequence[str], hubs: bool = False) -> DataFrame:
    """(keys, node, root) with the smallest reachable node, for nodes a <> b in ``edges``.

    Alternates large-star and small-star rounds; every round is written to the
    shared folder, so the plan stays short and lost executors cost one round.
    With ``hubs`` the minima are staged before they are joined back: then both
    sides of the join are plain shuffles and AQE can split a node with very
    many neighbours, at the price of a job.
    """
    keys = list(keys)

    def stars(df: DataFrame) -> bool:
        # a node points to one root, and a root to none
        ends = df.select(*keys, F.col("a").alias("n"), F.lit(1).alias("from")).unionByName(
            df.select(*keys, F.col("b").alias("n"), F.lit(0).alias("from")))
        seen = ends.groupBy(*keys, "n").agg(F.sum("from").alias("out"), F.min("from").alias("into"))
        return seen.where((F.col("out") > 1) | (F.col("out") > 0) & (F.col("into") == 0)).isEmpty()

    def hook(df: DataFrame, large: bool) -> DataFrame:
        # df: directed (a, b); every neighbour beyond a moves to the smallest one
        low = df.groupBy(*keys, "a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
        if hubs:
            low = materialize(low)
        joined = df.join(low, [*keys, "a"])
        moved = joined.where(F.col("b") > F.col("a") if large else F.col("b") != F.col("_m"))
        out = moved.select(*keys, F.col("b").alias("a"), F.col("_m").alias("b"))
        if not large:
            out = out.unionByName(low.select(*keys, "a", F.col("_m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = materialize(edges.select(*keys, high, low).distinct())
    while not stars(current):
        both = current.unionByName(current.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        grown = hook(both, large=True)
        ordered = grown.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        current = materialize(hook(ordered, large=False))
    return current.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))


def connected_components(voxels: DataFrame, keys: Sequence[str], dims: Dims, connectivity: int = 6,
                         code: str | None = None, tile: Sequence[int] = TILE) -> DataFrame:
    """Add ``component`` to voxels (keys, z, y, x, ...), unique per position.

    With ``code`` only voxels of equal code connect.  ``dims`` is one shape or a
    geometry table; a voxel outside the shape of its volume is an error.
    """
    keys = list(keys)
    single = one_tile(dims, tile)
    rows = placed(voxels, keys, dims)
    places = ["_tz", "_ty", "_tx"]
    if not single:
        rows = rows.withColumns({name: F.floor(F.col(axis) / F.when(fits(), F.col(size)).otherwise(s)).cast("int")
                                 for name, axis, size, s in zip(places, ZYX, SHAPE, tile)})
    schema = T.StructType(list(voxels.schema.fields) + [T.StructField("component", T.LongType())])

    def label_tile(first: dict, part: dict) -> tuple:
        points = np.stack([part[a].astype(np.int64) for a in ZYX], axis=1)
        lin = (points[:, 0] * first[SHAPE[1]] + points[:, 1]) * first[SHAPE[2]] + points[:, 2]
        order = np.argsort(lin)
        codes = part[code][order] if code else np.zeros(len(lin), np.int8)
        roots = label_points(points[order], codes, connectivity)
        component = np.empty(len(lin), np.int64)
        component[order] = lin[order][roots]
        return np.arange(len(lin)), {"component": component}

    labelled = map_groups(rows, [*keys, *([] if single else places), *SHAPE], label_tile, schema,
                          [*ZYX, *([code] if code else [])], keys if single else None)
    if single:
        return labelled  # nothing can cross a tile face
    labelled = materialize(labelled)
    return _join_tiles(labelled, keys, connectivity, code, tile)


def touching_pairs(labelled: DataFrame, keys: Sequence[str], connectivity: int, code: str | None,
                   tile: Sequence[int]) -> DataFrame:
    """Distinct component pairs (a, b) that touch across a tile face."""
    face = F.lit(False)
    for a, s in zip(ZYX, tile):
        face = face | (F.pmod(F.col(a), F.lit(s)).isin(0, s - 1))
    extra = [code] if code else []
    rim = labelled.where(face).select(*keys, *ZYX, *extra, "component")
    steps = (rim.withColumn("_o", F.explode(offset_array(half_offsets(connectivity))))
             .withColumns({"_n" + a: F.col(a) + F.col("_o.d" + a) for a in ZYX}))
    crosses = F.lit(False)
    for a, s in zip(ZYX, tile):
        crosses = crosses | (F.floor(F.col(a) / s) != F.floor(F.col("_n" + a) / s))
    steps = steps.where(crosses).select(*keys, *[F.col("_n" + a).cast("int").alias(a) for a in ZYX], *extra,
                                        F.col("component").alias("a"))
    return (steps.join(rim.withColumnRenamed("component", "b"), [*keys, *ZYX, *extra])
            .where(F.col("a") != F.col("b")).select(*keys, "a", "b").distinct())


def _join_tiles(labelled, keys, connectivity, code, tile):
    pairs = touching_pairs(labelled, keys, connectivity, code, tile)
    roots = star_roots(pairs, keys)
    return (labelled.join(roots.select(*keys, F.col("node").alias("component"), "root"), [*keys, "component"], "left")
            .withColumn("component", F.coalesce("root", "component")).drop("root").select(*labelled.columns))


def component_sizes(labelled: DataFrame, keys: Sequence[str], code: str | None = None) -> DataFrame:
    return labelled.groupBy(*keys, *([code] if code else []), "component").agg(F.count("*").alias("voxels"))


def keep_components(labelled: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Voxels of the kept components. The kept list is far smaller than the
    voxels; its staged size decides how it is joined."""
    kept = materialize(kept.select(*keys, "component"))
    return labelled.join(kept, [*keys, "component"], "left_semi").select(*labelled.columns)


def largest(sizes: DataFrame, keys: Sequence[str], ties: bool = True, floor: float | None = None,
            by: str = "voxels") -> DataFrame:
    """Components of the largest size per group; with a floor, also all others
    that are not smaller than it. Without ``ties`` the lowest id wins.

    Aggregates the maximum instead of sorting a group that may hold many components.
    """
    sizes = materialize(sizes)
    top = sizes.groupBy(*keys).agg(F.max(by).alias("_top") if ties else F.max(
        F.struct(F.col(by).alias("n"), (-F.col("component")).alias("c"))).alias("_top"))
    best = F.col(by) == F.col("_top") if ties else -F.col("component") == F.col("_top.c")
    keep = best if floor is None else best | (F.col(by) >= floor)
    return attach(sizes, top, keys).where(keep).drop("_top")


def largest_n(sizes: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The n largest components per group, lowest id first on ties.

    Each partition of a group keeps its own n best before the final window.
    """
    order = [F.desc("voxels"), F.col("component")]
    local = W.partitionBy(*keys, "_part").orderBy(*order)
    first = (sizes.withColumn("_part", F.pmod(F.xxhash64("component"), F.lit(64)))
             .withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n))
    final = W.partitionBy(*keys).orderBy(*order)
    return first.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= n).drop("_r", "_part")


def small_object_filter(sizes: DataFrame, keys: Sequence[str], code: str, minimum: dict[int, float],
                        voxel_volume: float, rate: float = 1.0, keep_largest: bool = False) -> DataFrame:
    """Components whose volume exceeds rate times the minimum of their label.

    Optionally the largest component of each label stays in any case.
    """
    limits = F.create_map(*[F.lit(v) for k, m in minimum.items() for v in (k, float(m) * rate)])
    big = F.coalesce(F.col("voxels") * F.lit(voxel_volume) > limits[F.col(code)], F.lit(False))
    if not keep_largest:
        return sizes.where(big)
    group = [*keys, code]
    sizes = materialize(sizes)
    top = sizes.groupBy(*group).agg(
        F.max(F.struct(F.col("voxels").alias("n"), (-F.col("component")).alias("c"))).alias("_top"))
    return attach(sizes, top, group).where(big | (F.col("_top.c") == -F.col("component"))).drop("_top")


def left_right_fix(labelled: DataFrame, keys: Sequence[str], label: str, pairs: Sequence[tuple[int, int]], width: int,
                   ) -> DataFrame:
    """Name paired organs by side: a component whose mean column lies in the
    first half is the right one. ``component`` must connect both labels of a pair."""
    group = F.lit(None).cast("int")
    right, left = {}, {}
    for right_code, left_code in pairs:
        group = F.when(F.col(label).isin(right_code, left_code), right_code).otherwise(group)
        right[right_code], left[right_code] = right_code, left_code
    rows = materialize(labelled.withColumn("_g", group))
    means = (rows.where(F.col("_g").isNotNull()).groupBy(*keys, "_g", "component")
             .agg((F.sum("x") / F.count("*") < width / 2).alias("_first")))
    joined = rows.join(means, [*keys, "_g", "component"], "left")
    other = F.create_map(*[F.lit(v) for k, c in left.items() for v in (k, c)])
    fixed = F.when(F.col("_g").isNull(), F.col(label)).when(F.col("_first"), F.col("_g")).otherwise(other[F.col("_g")])
    return joined.withColumn(label, fixed).select(*labelled.columns)


def filter_organs(sizes: DataFrame, keys: Sequence[str], code: str, methods: dict[int, str],
                  minimum: dict[int, float], voxel_volume: float, rate: float = 1.0) -> DataFrame:
    """Kept components with a method per organ: ``largest``, ``small`` (drop small
    ones), ``small_keep_one`` (but never the largest) or ``all``. Organs without
    a method are dropped."""
    def of(method: str) -> list[int]:
        return [c for c, m in methods.items() if m == method]
    unknown = set(methods.values()) - {"largest", "small", "small_keep_one", "all"}
    if unknown:
        raise ValueError(f"unknown methods {unknown}")
    sizes = materialize(sizes)
    group = [*keys, code]
    parts = [sizes.where(F.col(code).isin(of("all")))]
    if of("largest"):
        parts.append(largest(sizes.where(F.col(code).isin(of("largest"))), group, ties=False))
    for method, keep in (("small", False), ("small_keep_one", True)):
        if of(method):
            parts.append(small_object_filter(sizes.where(F.col(code).isin(of(method))), keys, code, minimum,
                                             voxel_volume, rate, keep))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def keep_largest_per_group(voxels: DataFrame, keys: Sequence[str], label: str, dims: Dims,
                           groups: Sequence[Sequence[int]], floors: dict[tuple[int, ...], float] | None = None,
                           connectivity: int = 6, tile: Sequence[int] = TILE) -> DataFrame:
    """Apply a largest-object decision: each group of classes is one foreground
    whose largest objects (all of them on ties) stay, with objects of at least
    the group's floor. Groups are applied one after the other."""
    out = voxels
    for codes in groups:
        inside = F.col(label).isin(list(codes))
        labelled = materialize(connected_components(out.where(inside), keys, dims, connectivity, tile=tile))
        kept = largest(component_sizes(labelled, keys), keys, floor=(floors or {}).get(tuple(codes)))
        out = out.where(~inside).unionByName(keep_components(labelled, kept, keys).select(*out.columns))
    return out
