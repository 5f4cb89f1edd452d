"""Surface distances between two segmentations.

The exact distance to the nearest surface voxel is found axis by axis. A task
holds a bundle of lines along one axis (at most ``LINES`` x ``WIDTH`` of them),
never a volume, and no pairs of surface voxels are formed. Along x a block of
columns knows the sites inside it and the nearest one before and after; along y
and z the minimum over all sites is the lower envelope of parabolas, built and
read in one scan each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.metrics import SURFACE_METRICS
from voxloom.operators import geometry
from voxloom.operators.geometry import SHAPE, STEP, Dims, Spacing, fits, one_tile, placed
from voxloom.operators.grouped import map_groups
from voxloom.operators.stencil import TILE, border_voxels
from voxloom.support import ZYX, attach, div0, full_offsets, materialize, spread

WIDTH, LINES = 64, 32
#: Up to so many sites a minimum is taken over all of them at once.
FEW = 48
# Fixed value: distance reported when only one of the masks is empty.
MISSING_DISTANCE = 373.12866


def surface(voxels: DataFrame, keys: Sequence[str], code: str, dims: Dims, tile: Sequence[int] = TILE) -> DataFrame:
    """Voxels with a face neighbour of another code; the volume edge counts as one."""
    return border_voxels(voxels, keys, code, dims, full_offsets(6), outside_is_border=True, tile=tile)


def _gaps(owner: np.ndarray, site: np.ndarray, count: int) -> np.ndarray:
    """Steps from each of ``WIDTH`` columns to the nearest site of its line; sites are relative to the block."""
    far = 1 << 40
    left, right = np.full((count, WIDTH), -far), np.full((count, WIDTH), far)
    inside = (site >= 0) & (site < WIDTH)
    left[owner[inside], site[inside]] = right[owner[inside], site[inside]] = site[inside]
    np.maximum.at(left[:, 0], owner[site < 0], site[site < 0])
    np.minimum.at(right[:, -1], owner[site >= WIDTH], site[site >= WIDTH])
    left = np.maximum.accumulate(left, axis=1)
    right = np.minimum.accumulate(right[:, ::-1], axis=1)[:, ::-1]
    at = np.arange(WIDTH)
    return np.minimum(at - left, right - at)


def lower_envelope(sites: np.ndarray, height: np.ndarray, rows: np.ndarray, step: float) -> np.ndarray:
    """Minimum over sites of height + ((row - site) * step)**2 for each row and column.

    ``sites`` and ``rows`` ascend; ``height`` is (sites, columns). The parabolas of all columns are stacked side by
    side: a new one takes away those it hides, so the work grows with sites plus rows.
    """
    place, asked = sites * step, rows * step
    if len(sites) <= FEW:
        out = np.full((len(rows), height.shape[1]), np.inf)
        for p, h in zip(place, height):
            np.minimum(out, h + ((asked - p) ** 2)[:, None], out=out)
        return out
    lines = np.arange(height.shape[1])
    stack = np.zeros(height.shape, dtype=np.int64)
    begins = np.full(height.shape, -np.inf)
    top = np.zeros(height.shape[1], dtype=np.int64)
    lifted = height + (place ** 2)[:, None]
    for k in range(1, len(sites)):
        open_lines = lines
        start = np.empty(len(lines))
        while len(open_lines):
            below = stack[top[open_lines], open_lines]
            start[open_lines] = (lifted[k, open_lines] - lifted[below, open_lines]) / (2 * (place[k] - place[below]))
            open_lines = open_lines[start[open_lines] <= begins[top[open_lines], open_lines]]
            top[open_lines] -= 1
        top += 1
        stack[top, lines] = k
        begins[top, lines] = start
    out = np.empty((len(rows), len(lines)))
    reached = np.zeros(len(lines), dtype=np.int64)
    for i, at in enumerate(asked):
        go = lines
        while len(go):
            following = np.minimum(reached[go] + 1, top[go])
            go = go[(reached[go] < top[go]) & (begins[following, go] <= at)]
            reached[go] += 1
        # beside a boundary the two parabolas are equal up to rounding: the smaller value counts
        near = [stack[np.clip(reached + d, 0, top), lines] for d in (-1, 0, 1)]
        out[i] = np.min([height[v, lines] + (at - place[v]) ** 2 for v in near], axis=0)
    return out


def _blocks_of_lines(targets: DataFrame, needed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per occupied line and needed block of columns: its sites ``xs``, in it and nearest to both sides."""
    line = [*keys, *STEP, "z", "y"]
    occupied = (targets.repartition(*[F.col(c) for c in line]).withColumn("_xb", F.floor(F.col("x") / WIDTH).cast("int"))
                .groupBy(*line, "_xb").agg(F.collect_list("x").alias("xs"), F.min("x").alias("_lo"), F.max("x").alias("_hi")))
    along = W.partitionBy(*line).orderBy("_xb")
    occupied = occupied.withColumns({"_before": F.lag("_hi").over(along), "_after": F.lead("_lo").over(along),
                                     "_next": F.lead("_xb").over(along)})
    rows = attach(occupied, needed, keys)

    def blocks(first: Column, last: Column, sites: Column) -> Column:
        each = F.transform(F.sequence(first, last), lambda b: F.struct(b.alias("_xb"), sites.alias("xs")))
        return F.when(first <= last, each).otherwise(F.array().cast("array<struct<_xb:int,xs:array<int>>>"))

    own = F.array_compact(F.concat("xs", F.array("_before", "_after")))
    here = F.greatest("_xb", "_x0")
    found = F.concat(
        blocks(here, F.least("_xb", "_x1"), own),
        blocks(F.greatest(F.col("_xb") + 1, F.col("_x0")), F.least(F.coalesce(F.col("_next") - 1, F.col("_x1")), F.col("_x1")),
               F.array_compact(F.array("_hi", "_after"))),
        F.when(F.col("_before").isNull(), blocks(F.col("_x0"), F.least(F.col("_xb") - 1, F.col("_x1")), F.array("_lo")))
        .otherwise(F.array().cast("array<struct<_xb:int,xs:array<int>>>")))
    return rows.select(*line, "_y0", "_y1", F.inline(found))


def nearest_distance(points: DataFrame, targets: DataFrame, keys: Sequence[str], dims: Dims,
                     spacing: Spacing = (1.0, 1.0, 1.0)) -> DataFrame:
    """Squared distance ``d2`` from each point to its nearest target of the same keys.

    Points whose keys have no target are dropped. Shapes and spacings may come from a geometry table.
    """
    keys = list(keys)
    block = {"_yb": F.floor(F.col("y") / LINES).cast("int"), "_xb": F.floor(F.col("x") / WIDTH).cast("int")}
    # comparing the shape keeps the check of it in the plan
    asked = (placed(points.select(*keys, *ZYX), keys, dims, spacing).where(F.col(SHAPE[0]) > 0)
             .drop(*SHAPE).withColumns(block))
    sites = placed(targets.select(*keys, *ZYX), keys, dims, spacing).where(F.col(SHAPE[0]) > 0).drop(*SHAPE)
    # distances are only needed where points lie: their range of row and column blocks
    needed = asked.groupBy(*keys).agg(F.min("_yb").alias("_y0"), F.max("_yb").alias("_y1"),
                                      F.min("_xb").alias("_x0"), F.max("_xb").alias("_x1"))
    lines = _blocks_of_lines(sites, needed, keys).withColumn("_zb", F.floor(F.col("z") / LINES).cast("int"))
    key_types = [f"{points.schema[k].name} {points.schema[k].dataType.simpleString()}" for k in keys]

    def along_y(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in (*keys, *STEP, "_xb", "_y0", "_y1")}
        z, y = (np.asarray(table.column(c)).astype(np.int64) for c in ("z", "y"))
        xs = table.column("xs").combine_chunks()
        owner = np.repeat(np.arange(len(z)), np.diff(np.asarray(xs.offsets)))
        site = np.asarray(xs.flatten()).astype(np.int64) - first["_xb"] * WIDTH
        square = (_gaps(owner, site, len(z)) * first["_sx"]) ** 2
        rows = np.arange(first["_y0"] * LINES, (first["_y1"] + 1) * LINES)
        order = np.lexsort((y, z))
        z, y, square = z[order], y[order], square[order]
        cuts = [0, *(np.flatnonzero(np.diff(z)) + 1).tolist(), len(z)]
        levels, blocks, values = [], [], []
        for a, b in zip(cuts, cuts[1:]):
            best = lower_envelope(y[a:b], square[a:b], rows, first["_sy"])
            for k in range(first["_y1"] - first["_y0"] + 1):
                levels.append(int(z[a]))
                blocks.append(first["_y0"] + k)
                values.append(best[k * LINES:(k + 1) * LINES].tobytes())
        same = [pa.array([first[c]] * len(levels), table.schema.field(c).type) for c in (*keys, "_xb")]
        return pa.table([*same[:-1], pa.array(levels, pa.int32()), pa.array(blocks, pa.int32()), same[-1],
                         pa.array(values, pa.binary())], names=[*keys, "z", "_yb", "_xb", "d2"])

    flat = spread(lines, *keys, "_zb", "_xb").groupBy(*keys, "_zb", "_xb").applyInArrow(
        along_y, ", ".join([*key_types, "z int, _yb int, _xb int, d2 binary"]))
    kinds = {a: points.schema[a].dataType.simpleString() for a in ZYX}

    def along_z(query: pa.Table, planes: pa.Table) -> pa.Table:
        if not planes.num_rows:
            query = query.slice(0, 0)
        if not query.num_rows:
            best = np.zeros(0)
        else:
            step = query.column("_sz")[0].as_py()
            z, y, x = (np.asarray(query.column(a)).astype(np.int64) for a in ZYX)
            places, line = np.unique((y % LINES) * WIDTH + x % WIDTH, return_inverse=True)
            level = np.asarray(planes.column("z")).astype(np.int64)
            order = np.argsort(level)
            stored = planes.column("d2").to_pylist()
            height = np.stack([np.frombuffer(stored[k])[places] for k in order])
            rows, row = np.unique(z, return_inverse=True)
            best = lower_envelope(level[order], height, rows, step)[row, line]
        return pa.table([*[query.column(c) for c in (*keys, *ZYX)], pa.array(best, pa.float64())],
                        names=[*keys, *ZYX, "d2"])

    group = [*keys, "_yb", "_xb"]
    return (spread(asked, *group).groupBy(*group).cogroup(spread(flat, *group).groupBy(*group)).applyInArrow(
        along_z, ", ".join([*key_types, *[f"{a} {k}" for a, k in kinds.items()], "d2 double"])))


def grid_distance(points: Sequence[np.ndarray], sites: Sequence[np.ndarray], shape: Sequence[int],
                  step: Sequence[float]) -> np.ndarray:
    """Squared distance from each point to its nearest site in a volume that one task takes whole.

    Axis by axis as for larger ones.  Along y and z rows ever further away are looked at, until they are further than
    anything that is still to be improved.
    """
    width = np.arange(shape[2])
    z, y, x = sites
    held = np.zeros(tuple(shape), bool)
    held[z, y, x] = True
    lines = np.flatnonzero(held.reshape(-1, shape[2]).any(axis=1))
    own = held.reshape(-1, shape[2])[lines]
    left = np.maximum.accumulate(np.where(own, width, -1 << 40), axis=1)
    right = np.minimum.accumulate(np.where(own, width, 1 << 40)[:, ::-1], axis=1)[:, ::-1]
    flat = np.full((shape[0] * shape[1], shape[2]), np.inf)
    flat[lines] = (np.minimum(width - left, right - width) * step[2]) ** 2
    flat = flat.reshape(tuple(shape))
    # only planes with a site have anything to spread
    levels = np.unique(z)
    first = flat[levels]
    best = first.copy()
    for d in range(1, shape[1]):
        more = (d * step[1]) ** 2
        if more >= best.max():
            break
        np.minimum(best[:, d:], first[:, :-d] + more, out=best[:, d:])
        np.minimum(best[:, :-d], first[:, d:] + more, out=best[:, :-d])
    planes = np.full(tuple(shape), np.inf)
    planes[levels] = best
    z, y, x = points
    found = planes[z, y, x]
    for d in range(1, shape[0]):
        more = (d * step[0]) ** 2
        behind = np.flatnonzero(found > more)
        if not len(behind):
            break
        for side in (-d, d):
            level = z[behind] + side
            on = (level >= 0) & (level < shape[0])
            at = behind[on]
            found[at] = np.minimum(found[at], planes[level[on], y[at], x[at]] + more)
    return found


def _whole_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distance counts of placed surface voxels of volumes that one task takes whole."""
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("from_test", T.BooleanType()),
                           T.StructField("distance", T.DoubleType()), T.StructField("n", T.LongType())])

    def count(first: dict, part: dict) -> tuple | None:
        test = part["from_test"]
        if test.all() or not test.any():
            return None
        shape, step = [first[c] for c in SHAPE], [first[c] for c in STEP]
        sides, distances, numbers = [], [], []
        for side in (True, False):
            points, sites = ([part[a][test == s] for a in ZYX] for s in (side, not side))
            found, n = np.unique(np.sqrt(grid_distance(points, sites, shape, step)), return_counts=True)
            sides.append(np.full(len(n), side))
            distances.append(found)
            numbers.append(n)
        sides = np.concatenate(sides)
        return np.zeros(len(sides), np.int64), {"from_test": sides, "distance": np.concatenate(distances), "n": np.concatenate(numbers)}
    # as with cut volumes, voxels without a key are not compared
    return map_groups(rows.dropna(subset=list(keys)), [*keys, *SHAPE, *STEP], count, schema, [*ZYX, "from_test"], keys)


def distance_counts(test: DataFrame, reference: DataFrame, keys: Sequence[str], dims: Dims,
                    spacing: Spacing = (1.0, 1.0, 1.0)) -> DataFrame:
    """Number of surface voxels per (keys, from_test, distance), both directions.

    A volume of no more cells than a default tile is worked on in one task; larger ones in bundles of lines.
    """
    keys = list(keys)
    both = test.select(*keys, *ZYX, F.lit(True).alias("from_test")).unionByName(
        reference.select(*keys, *ZYX, F.lit(False).alias("from_test")))
    if one_tile(dims, (0, 0, 0)):
        return _whole_counts(placed(both, keys, dims, spacing), keys)
    both = materialize(both)
    if not isinstance(dims, DataFrame) or not geometry.WHOLE:
        return _cut_counts(both, keys, dims, spacing)
    sized = placed(both, keys, dims, spacing)
    rest = sized.where(~fits()).select(*both.columns)
    return _whole_counts(sized.where(fits()), keys).unionByName(_cut_counts(rest, keys, dims, spacing))


def _cut_counts(both: DataFrame, keys: Sequence[str], dims: Dims, spacing: Spacing) -> DataFrame:
    # each side asks for the other side's surface
    other = both.withColumn("from_test", ~F.col("from_test"))
    found = nearest_distance(both, other, [*keys, "from_test"], dims, spacing)
    return (found.groupBy(*keys, "from_test", F.sqrt("d2").alias("distance")).agg(F.count("*").alias("n")))


def distance_metrics(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hausdorff distance, its 95th percentile, and the two mean surface distances.

    Works on distance counts; distances are roots of sums of squares, so the
    number of distinct values stays far below the number of surface voxels.
    """
    def mean(side: Column) -> Column:
        n = F.when(side, F.col("n"))
        return div0(F.sum(n * F.col("distance")), F.coalesce(F.sum(n), F.lit(0)))
    stats = counts.groupBy(*keys).agg(
        F.max("distance").alias("hd"), F.expr("percentile(distance, 0.95D, n)").alias("hd95"),
        mean(F.col("from_test")).alias("asd"), mean(~F.col("from_test")).alias("_back"))
    return stats.select(*keys, F.round("hd", 6).alias("hd"), F.round("hd95", 6).alias("hd95"),
                        F.round("asd", 6).alias("asd"), F.round((F.col("asd") + F.col("_back")) / 2, 6).alias("assd"))


def with_empty_masks(metrics: DataFrame, presence: DataFrame, keys: Sequence[str], sentinel: bool = False) -> DataFrame:
    """One row per case and label of ``presence`` (test_empty, reference_empty, and
    the full flags). Undefined where a mask is empty or full; the sentinel policy
    reports 0 if both are empty and a fixed distance if one is."""
    undefined = F.col("test_empty") | F.col("reference_empty") | F.col("test_full") | F.col("reference_full")
    joined = presence.join(metrics, list(keys), "left")
    if sentinel:
        value = (F.when(F.col("test_empty") & F.col("reference_empty"), F.lit(0.0))
                 .when(F.col("test_empty") | F.col("reference_empty"), F.lit(MISSING_DISTANCE))
                 .otherwise(F.col("hd95")))
        return joined.select(*keys, value.alias("hd95"))
    return joined.select(*keys, *[F.when(~undefined, F.col(m)).alias(m) for m in ("hd", "hd95", "asd", "assd")])


def surface_dice(counts: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Share of both surfaces within the threshold, kept finite by 1e-8."""
    def share(side: Column, close: bool) -> Column:
        near = F.col("distance") <= threshold
        total = F.sum(F.when(side, F.col("n")))
        return F.coalesce(F.sum(F.when(side & (near if close else ~near), F.col("n"))), F.lit(0)) / total
    a, b = F.col("from_test"), ~F.col("from_test")
    tp = share(a, True) + share(b, True)
    return counts.groupBy(*keys).agg(
        F.round(tp / (tp + share(a, False) + share(b, False) + 1e-8), 6).alias("surface_dice"))


def metric_rows(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form with the report names of the distance metrics."""
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).alias("value"))
                      for name, c in zip(SURFACE_METRICS, ("hd", "hd95", "asd", "assd"))])
    return metrics.select(*keys, F.inline(pairs))
