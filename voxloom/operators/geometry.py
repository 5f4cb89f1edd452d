"""Volumes of different shapes in one plan.

Spatial operators take ``dims``: the shape (z, y, x) all volumes have, or a
geometry table (keys, depth, height, width and, where it matters, spacing_z,
spacing_y, spacing_x).  Either way each row carries the shape of its own volume
to the task that works on its tile, so one plan serves any number of shapes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.support import ZYX, attach, materialize, spread

#: Axis sizes and voxel sizes of a geometry table, in the order of (z, y, x), and the names they travel under.
SIZES = ("depth", "height", "width")
SPACINGS = ("spacing_z", "spacing_y", "spacing_x")
SHAPE, STEP = ("_dz", "_dy", "_dx"), ("_sz", "_sy", "_sx")

#: A volume of at most so many cells, those of a default tile, is never cut, nor is one of so many where a task holds a dense grid only.
WHOLE, DENSE = 64 ** 3, 1 << 22
#: Longest axis of a volume that is not cut.
LONGEST = 512

Dims = Sequence[int] | DataFrame
Spacing = Sequence[float] | DataFrame


def placed(voxels: DataFrame, keys: Sequence[str], dims: Dims, spacing: Spacing | None = None) -> DataFrame:
    """Voxels with the shape of their volume in ``SHAPE`` (and its spacing in ``STEP``), as tile tasks expect them.

    A geometry table is joined on those of the ``keys`` that it has.  A voxel outside its volume's shape, or of a volume without one, is an error when the plan runs.
    """
    names = [(*n, "int") for n in zip(SIZES, SHAPE)] if isinstance(dims, DataFrame) else []
    steps = [(*n, "double") for n in zip(SPACINGS, STEP)] if isinstance(spacing, DataFrame) else []
    out = voxels
    for table, columns in ((dims, names), (spacing, steps)):
        if columns:
            on = [k for k in keys if k in table.columns]
            out = attach(out, table.select(*on, *[F.col(a).cast(kind).alias(b) for a, b, kind in columns]), on, "left")
    if not names:
        out = out.withColumns({c: F.lit(int(n)) for c, n in zip(SHAPE, dims)})
    if spacing is not None and not steps:
        out = out.withColumns({c: F.lit(float(s)) for c, s in zip(STEP, spacing)})
    inside = F.lit(True)
    for axis, size in zip(ZYX, SHAPE):
        inside = inside & (F.col(axis) >= 0) & (F.col(axis) < F.col(size))
    if steps:
        inside = inside & F.col(STEP[0]).isNotNull()
    wrong = F.raise_error(F.concat(F.lit("a voxel lies outside the shape of its volume: "), F.to_json(F.struct(*keys, *ZYX))))
    return out.withColumn(SHAPE[0], F.when(F.coalesce(inside, F.lit(False)), F.col(SHAPE[0])).otherwise(wrong.cast("int")))


def fits(cells: int | None = None, names: Sequence[str] = SHAPE) -> Column:
    """Whether the volume of a placed row has at most ``cells`` (``WHOLE``) cells, so that one task takes all of it."""
    sizes = [F.col(n).cast("long") for n in names]
    return (sizes[0] * sizes[1] * sizes[2] <= (WHOLE if cells is None else cells)) & (F.greatest(*sizes) <= LONGEST)


def tile_for(extent: Sequence[int], tile: Sequence[int], cells: int | None = None) -> Sequence[int]:
    """The tile of a volume: the volume itself where it ``fits``."""
    size = int(extent[0]) * int(extent[1]) * int(extent[2])
    return extent if size <= (WHOLE if cells is None else cells) and max(extent) <= LONGEST else tile


def one_tile(dims: Dims, tile: Sequence[int], cells: int | None = None) -> bool:
    """Whether every volume is known to be one tile; ``placed`` has then ruled out any other voxel."""
    if not isinstance(dims, DataFrame):
        return all(d <= s for d, s in zip(dims, tile_for(dims, tile, cells)))
    wider = F.lit(False)
    for name, s in zip(SIZES, tile):
        wider = wider | (F.col(name) > s)
    return dims.where(wider & ~fits(cells, SIZES)).isEmpty()


def free_cells(volumes: DataFrame, voxels: DataFrame, key: str = "volume_id") -> DataFrame:
    """Cells (key, z, y, x) of the volumes, which have a depth, height and width, that hold no voxel.

    The voxels of a plane meet its cells as one array, so that the cells themselves are not shuffled.
    """
    planes = volumes.select(key, "height", "width", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("z"))
    taken = voxels.groupBy(key, "z").agg(F.collect_set(F.struct("y", "x")).alias("_taken"))
    line = F.col("width").cast("int")
    used = F.transform("_taken", lambda p: p["y"] * line + p["x"])
    cells = F.array_except(F.sequence(F.lit(0), F.col("height") * line - 1), F.coalesce(used, F.array().cast("array<int>")))
    free = spread(planes, key, "z").join(taken, [key, "z"], "left").select(key, "z", line.alias("_w"), F.explode(cells).alias("_c"))
    return free.select(key, "z", F.expr("cast(_c div _w as int)").alias("y"), F.expr("cast(_c % _w as int)").alias("x"))


def keep_axis(new: Dims, old: Dims, axis: int, keys: Sequence[str]) -> Dims:
    """The shapes ``new`` with the size along one axis of ``old``."""
    name = SIZES[axis]
    if not isinstance(new, DataFrame) and not isinstance(old, DataFrame):
        return [*new[:axis], old[axis], *new[axis + 1:]]
    if not isinstance(old, DataFrame):
        return new.withColumn(name, F.lit(int(old[axis])))
    on = [k for k in keys if k in old.columns]
    sizes = old.select(*on, *SIZES)
    if isinstance(new, DataFrame):
        return sizes.select(*on, name).join(new.drop(name), on)
    return sizes.withColumns({n: F.lit(int(v)) for n, v in zip(SIZES, new) if n != name})


def with_shape(voxels: DataFrame, geometry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Voxels with their own volume's depth, height and width.

    A voxel outside its volume's shape, or of a volume without one, is an error.
    """
    joined = attach(voxels, geometry.select(*keys, *SIZES), keys, "left")
    inside = F.lit(True)
    for axis, size in zip(ZYX, SIZES):
        inside = inside & F.col(axis).between(0, F.col(size) - 1)
    wrong = F.raise_error(F.lit("a voxel lies outside the shape of its volume")).cast("int")
    return joined.withColumn("depth", F.when(F.coalesce(inside, F.lit(False)), F.col("depth")).otherwise(wrong))


def per_shape(voxels: DataFrame, geometry: DataFrame, keys: Sequence[str],
              run: Callable[[DataFrame, tuple[int, int, int]], DataFrame], limit: int = 64) -> DataFrame:
    """Union of ``run(voxels of one shape, shape)`` over the shapes of the geometry table.

    For operators of one shape from elsewhere; those of this library take the
    geometry table itself as ``dims``.  One branch of the plan per shape, so at
    most ``limit`` different shapes; more are an error, never a subset.
    """
    shapes = [tuple(r) for r in geometry.select(*SIZES).distinct().orderBy(*SIZES).limit(limit + 1).collect()]
    if len(shapes) > limit:
        raise ValueError(f"more than {limit} shapes: group the cases or resample them first")
    rows = materialize(with_shape(voxels, geometry, keys))
    out = None
    for shape in shapes:
        same = F.lit(True)
        for size, value in zip(SIZES, shape):
            same = same & (F.col(size) == value)
        part = run(rows.where(same).drop(*SIZES), shape)
        out = part if out is None else out.unionByName(part)
    return rows.drop(*SIZES).limit(0) if out is None else out
