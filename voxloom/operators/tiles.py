"""Tile tables: window planning, stitching, skipping and class decisions."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.geometry import tile_for
from voxloom.operators.grouped import map_groups
from voxloom.support import ZYX, div0, spread

#: Patches cut at once.
PATCH_BYTES = 4 << 20
#: Most rows that a volume can have in one task once its voxels are repeated for windows.
WINDOW_ROWS = 1 << 22


def window_starts(image: int, patch: int, step: float) -> list[int]:
    """Evenly spread starts with at most ``patch * step`` between them."""
    if not 0 < step <= 1 or patch > image:
        raise ValueError("need 0 < step <= 1 and patch <= image")
    count = math.ceil((image - patch) / (patch * step)) + 1
    stride = (image - patch) / (count - 1) if count > 1 else 0.0
    return [round(stride * i) for i in range(count)]


def window_starts_column(image: Column, patch: Column, step: Column) -> Column:
    """The same as an array column, NULL where the request is invalid."""
    room = (image - patch).cast("double")
    count = (F.ceil(room / (patch * step)) + 1).cast("int")
    stride = F.when(count > 1, room / F.greatest(count - 1, F.lit(1))).otherwise(0.0)
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.rint(stride * i).cast("int"))
    return F.when((room >= 0) & (step > 0) & (step <= 1), starts)


def scan_interval(image: Column, roi: Column, overlap: Column) -> Column:
    """Distance between windows: the window itself where it spans the image."""
    stride = F.floor(roi * (1 - overlap)).cast("int")
    return F.when(roi == image, roi).otherwise(F.greatest(stride, F.lit(1)))


def assign_windows(voxels: DataFrame, starts: Sequence[Sequence[int]], patch: Sequence[int], lists: bool = False) -> DataFrame:
    """Send each voxel to every window that covers it (columns w0, w1, w2).

    The window lists are fixed by the volume shape, so this is a projection and no range join.  With ``lists`` a voxel
    stays one row with arrays of windows for ``predict_tiles``, which repeats it in the task of its volume, unless a volume
    could have more than ``WINDOW_ROWS`` rows there.
    """
    extent = [max(s) + p - min(s) for s, p in zip(starts, patch)]
    most = [max(sum(t <= s < t + p for t in axis) for s in axis) for axis, p in zip(starts, patch)]
    lists = lists and math.prod(extent) * math.prod(most) <= WINDOW_ROWS
    out = voxels
    for i, axis in enumerate(ZYX):
        low = min(starts[i])
        covers = [[k for k, s in enumerate(starts[i]) if s <= low + at < s + patch[i]] for at in range(extent[i])]
        known = F.expr("cast(array(" + ",".join(f"array({','.join(map(str, c))})" for c in covers) + ") as array<array<int>>)")
        windows = F.get(known, F.col(axis) - low)
        out = out.withColumn(f"w{i}", windows if lists else F.explode(windows))
    return out


def skip_empty_tiles(voxels: DataFrame, tile: Sequence[str], value: str, threshold: float) -> DataFrame:
    """Tiles whose maximum exceeds the threshold, with that maximum."""
    return (voxels.groupBy(*tile).agg(F.max(value).alias("tile_max"), F.count("*").alias("voxels"))
            .where(F.col("tile_max") > threshold))


def minmax_normalize(value: Column, low: float, high: float) -> Column:
    """Clamp and scale to 0..1; a non-positive upper bound switches it off."""
    if high <= 0:
        return value.cast("double")
    return (F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / F.lit(float(high - low))


def stitch(tiles: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean of overlapping tile values per voxel (constant weight 1)."""
    w = F.lit(1.0) if weight is None else weight
    total, norm = F.sum(F.col(value) * w), F.sum(w)
    return tiles.groupBy(*keys, *ZYX).agg(div0(total, norm).alias(value), F.count("*").alias("windows"))


def binarize(value: Column, threshold: float = 0.5) -> Column:
    """1 from the threshold on; an uncovered voxel is background."""
    return F.when(value >= threshold, 1).otherwise(0)


def gaussian_importance(offset: Sequence[Column], patch: Sequence[int], scale: float = 1 / 8) -> Column:
    """Centre-weighted window importance with maximum 1."""
    exponent = F.lit(0.0)
    for o, p in zip(offset, patch):
        exponent = exponent + F.pow((o - p // 2) / F.lit(p * scale), F.lit(2.0))
    return F.exp(-exponent / 2)


def argmax_class(prob: DataFrame, keys: Sequence[str], cls: str = "class", p: str = "p") -> DataFrame:
    """Highest class score per voxel, the smallest class on ties."""
    best = F.max_by(F.struct(F.col(cls), F.col(p)), F.struct(F.col(p), -F.col(cls))).alias("_b")
    return prob.groupBy(*keys).agg(best).select(*keys, F.col("_b")[cls].alias(cls), F.col("_b")[p].alias(p))


def region_paint(prob: DataFrame, keys: Sequence[str], region: str, p: str, codes: Sequence[int]) -> DataFrame:
    """Paint codes in region order where p > 0.5, later regions on top."""
    code = F.array(*[F.lit(c) for c in codes])[F.col(region)]
    hit = F.when(F.col(p) > 0.5, F.col(region))
    return prob.groupBy(*keys).agg(F.coalesce(F.max_by(code, hit), F.lit(0)).alias("label"))


def softmax(prob: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """Softmax over an array of class scores, one row per class."""
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp(v.cast("double") - top.cast("double")))
    norm = F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)
    return (prob.withColumn("_e", e).withColumn("_n", norm)
            .select(*keys, F.posexplode(F.transform("_e", lambda v: v / F.col("_n"))).alias("class", "p")))


def predict_tiles(tiles: DataFrame, predict: Callable, schema: str, key: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Apply a tile predictor, one window at a time: ``predict(window, tile) -> (index, columns)``.

    ``window`` holds the key, ``tile`` the other columns as arrays.  Fields of ``schema`` that are not among the columns are
    copied from the rows ``index`` of the tile (see ``grouped.map_groups``), so a predictor may return other places as well.
    ``tasks`` is as for ``support.spread``.
    """
    if not any(not isinstance(tiles.schema[k].dataType, T.ArrayType) for k in key):
        for k in key:
            tiles = tiles.withColumn(k, F.explode(k))
    return map_groups(tiles, key, predict, T.StructType.fromDDL(schema), tasks=tasks)


def mirrored_mean(tiles: DataFrame, keys: Sequence[str], value: str, patch: Sequence[int],
                  predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Mean of a predictor over the eight mirrored copies of each tile.

    The copies are ordinary rows with a ``mirror`` key; the prediction is turned
    back before averaging.
    """
    mirror = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("mirror")

    def turn(df: DataFrame) -> DataFrame:
        return df.withColumns({a: F.when(F.col("mirror").bitwiseAND(1 << i) != 0, F.lit(n - 1) - F.col(a))
                              .otherwise(F.col(a)).cast("int") for i, (a, n) in enumerate(zip(ZYX, patch))})
    predicted = turn(predict(turn(tiles.select("*", mirror))))
    return predicted.groupBy(*keys, *ZYX).agg(F.avg(value).alias(value))


def patch_boxes(centres: DataFrame, patch: Sequence[int], dims: Sequence[int], padded: Sequence[int] | None = None,
                ) -> DataFrame:
    """Box of a training patch around each given voxel (columns z0..x1, half-open).

    The box may leave the volume by half the room that ``padded`` asks for
    beyond it; what lies outside is padding.
    """
    wanted = padded or patch
    out = {}
    for axis, p, w, n in zip(ZYX, patch, wanted, dims):
        room = max(w - n, w - p, 0)
        low = F.greatest(F.lit(-(room // 2)), F.col(axis) - p // 2).cast("int")
        out[axis + "0"], out[axis + "1"] = low, (low + p).cast("int")
    return centres.withColumns(out)


def forced_in_batch(index: Column, batch: int, share: float) -> Column:
    """The last part of a batch must contain foreground."""
    return index >= F.lit(round(batch * (1 - share)))


def patch_crops(voxels: DataFrame, boxes: DataFrame, keys: Sequence[str], patch_key: Sequence[str], value: str,
                patch: Sequence[int], tile: Sequence[int] = (32, 32, 32), dtype: str = "<f8", padding: float = 0.0,
                dims: Sequence[int] | None = None, tasks: int | None = None) -> DataFrame:
    """Dense padded patches (patch_key, block) for the boxes of ``patch_boxes``.

    The boxes meet the voxels of their volume, or of the tiles they overlap in volumes that are cut, as rows of one group,
    so that no voxel is repeated as a row.  A volume that the shape ``dims`` says is one tile gives its patches at once;
    otherwise a tile gives what it has of each box, and a task puts one patch together.  Cells without a voxel are 0; with
    ``dims`` those outside it hold ``padding``.  A box without any voxel gives a patch as well.  Boxes of one ``patch_key``
    are one.  ``tasks`` is as for ``support.spread``.
    """
    keys, patch_key = list(keys), list(patch_key)
    corner, place = ("z0", "y0", "x0"), ("_z", "_y", "_x")
    tile = tuple(tile) if dims is None else tuple(tile_for(dims, tile))
    single = dims is not None and all(d <= s for d, s in zip(dims, tile))
    numbers = [] if single else [f"_t{a}" for a in ZYX]
    others = [k for k in keys if k not in patch_key]
    known = F.lit(True)
    for c in corner:
        known = known & F.col(c).isNotNull()
    wanted = (boxes.where(known).groupBy(*patch_key).agg(F.min(F.struct(*others, *corner)).alias("_first"))
              .select(*patch_key, "_first.*"))
    kind = voxels.schema[value].dataType
    points = voxels.select(*keys, *[F.col(a).alias(p) for a, p in zip(ZYX, place)], F.col(value).alias("_v"), F.lit(False).alias("_box"),
                           *[F.lit(None).cast(wanted.schema[k].dataType).alias(k) for k in patch_key if k not in keys])
    met = wanted.select(*keys, *[F.col(c).cast(voxels.schema[a].dataType).alias(p) for c, a, p in zip(corner, ZYX, place)],
                        F.lit(0).cast(kind).alias("_v"), F.lit(True).alias("_box"), *[k for k in patch_key if k not in keys])
    for number, p, size, s in zip(numbers, place, patch, tile):
        first, last = (F.floor(c / s).cast("int") for c in (F.col(p), F.col(p) + (size - 1)))
        points, met = points.withColumn(number, first), met.withColumn(number, F.explode(F.sequence(first, last)))

    def grid_of(first: dict, part: dict, origin: np.ndarray) -> np.ndarray | None:
        """The voxels of a group, if there are any that a box can meet."""
        here = ~part["_box"]
        at = [part[p][here] for p in place]
        if any(a.dtype.kind == "f" and np.isnan(a).any() for a in at):
            raise ValueError("a voxel has no place")
        if not here.any() or part["_box"].sum() == 0 or any(first[k] is None for k in keys):
            return None
        at = [a.astype(np.int64) - o for a, o in zip(at, origin)]
        inside = np.logical_and.reduce([(a >= 0) & (a < s) for a, s in zip(at, dims if single else tile)])
        grid = np.zeros(dims if single else tile, dtype)
        grid[tuple(a[inside] for a in at)] = part["_v"][here][inside]
        return grid

    def overlap(low: np.ndarray, origin: np.ndarray, shape: Sequence[int]) -> tuple[tuple, tuple]:
        """Where a patch at ``low`` and a grid at ``origin`` have cells in common: in the patch and in the grid."""
        a, b = np.maximum(low, origin), np.minimum(low + np.array(patch), origin + np.array(shape))
        b = np.maximum(a, b)
        return tuple(slice(*c) for c in zip(a - low, b - low)), tuple(slice(*c) for c in zip(a - origin, b - origin))

    def crop(first: dict, part: dict) -> Iterator:
        """Patches of a volume that is one tile, a bounded number at a time."""
        asked = np.flatnonzero(part["_box"])
        grid = grid_of(first, part, np.zeros(3, np.int64))
        # a margin as wide as the boxes leave the volume; a box beyond it by more than a patch is all margin
        low = np.stack([np.clip(part[p][asked].astype(np.int64), -n, d) for p, n, d in zip(place, patch, dims)], axis=1)
        before = np.maximum(-low.min(axis=0, initial=0), 0)
        after = np.maximum((low + np.array(patch)).max(axis=0, initial=0) - np.array(dims), 0)
        wide = np.full(before + np.array(dims) + after, padding, dtype)
        wide[tuple(slice(b, b + d) for b, d in zip(before, dims))] = 0 if grid is None else grid
        views = np.lib.stride_tricks.sliding_window_view(wide, patch)
        step = max(1, PATCH_BYTES // (wide.itemsize * math.prod(patch)))
        for a in range(0, len(asked), step):
            blocks = views[tuple((low[a:a + step] + before).T)]
            yield asked[a:a + step], {"block": [b.tobytes() for b in blocks]}

    def cut(first: dict, part: dict) -> Iterator:
        """What a tile has of each box."""
        origin = np.array([first[n] or 0 for n in numbers]) * np.array(tile)
        grid = grid_of(first, part, origin)
        corners = np.stack([part[p] for p in place], axis=1)
        for k in np.flatnonzero(part["_box"]):
            low = corners[k].astype(np.int64)
            _, of = overlap(low, origin, tile)
            data = None if grid is None or not grid[of].any() else zlib.compress(grid[of].tobytes(), 1)
            yield np.array([k]), {"block": [data], **{c: low[i:i + 1].astype(np.int32) for i, c in enumerate(corner)}}

    answer = T.StructType([*[wanted.schema[k] for k in patch_key], T.StructField("block", T.BinaryType())])
    read = [*place, "_v", "_box"]
    if single:
        return map_groups(points.unionByName(met), keys, crop, answer, read, tasks=tasks)
    schema = T.StructType([*answer.fields, *[T.StructField(n, T.IntegerType()) for n in (*numbers, *corner)]])
    pieces = map_groups(points.unionByName(met), [*keys, *numbers], cut, schema, read, tasks=tasks)

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        low = pdf[list(corner)].iloc[0].to_numpy(np.int64)
        out = np.zeros(patch, dtype)
        for *number, block in zip(*[pdf[n] for n in numbers], pdf["block"]):
            if block is None:
                continue
            to, _ = overlap(low, np.array(number) * np.array(tile), tile)
            out[to] = np.frombuffer(zlib.decompress(block), dtype).reshape(out[to].shape)
        if dims is not None:
            to, _ = overlap(low, np.zeros(3, np.int64), dims)
            padded = np.full(patch, padding, dtype)
            padded[to] = out[to]
            out = padded
        row = pdf[patch_key].iloc[:1].copy()
        row["block"] = [out.tobytes()]
        return row

    return spread(pieces, *patch_key, tasks=tasks).groupBy(*patch_key).applyInPandas(assemble, answer)
