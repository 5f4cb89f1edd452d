"""A store of dense tiles: one Parquet row per tile that holds anything.

The rows carry their corner, shape, smallest and largest value and count of
nonzero voxels, are sorted along the tile grid and cut into small row groups.  So
a box reads the row groups whose corners overlap it, and a threshold those whose
largest value reaches it; blocks of other tiles are never decoded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.geometry import SHAPE, Dims, placed
from voxloom.operators.grouped import WRITE, map_groups
from voxloom.operators.stencil import TILE, TILE_COLUMNS, Window, _pack, _unpack, with_halo
from voxloom.support import ZYX, materialize

#: Columns of the store besides the keys: first and end corner, what the block holds, and the block.
LOW, HIGH = ("z0", "y0", "x0"), ("z1", "y1", "x1")
ROW_GROUP = 4 << 20


def tiles_of(voxels: DataFrame, keys: Sequence[str], value: str, dims: Dims, tile: Sequence[int] = TILE,
             dtype: str = "<f8") -> DataFrame:
    """Dense tiles of sparse voxels (absent ones are 0): keys, corners, low, high, nonzero, dtype, block."""
    keys = list(keys)
    rows = with_halo(placed(voxels.select(*keys, *ZYX, value), keys, dims), tile, (0, 0, 0))
    schema = T.StructType([
        *[voxels.schema[k] for k in keys], *[T.StructField(c, T.IntegerType()) for c in (*LOW, *HIGH)],
        T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("nonzero", T.LongType()),
        T.StructField("dtype", T.StringType()), T.StructField("block", T.BinaryType())])

    def pack(first: dict, part: dict) -> tuple | None:
        window = Window(first, tile, (0, 0, 0))
        grid = np.zeros(window.shape, dtype)
        grid[window.place(part)] = part[value]
        if not grid.any():
            return None
        corners = {c: window.core_low[i:i + 1].astype(np.int32) for i, c in enumerate(LOW)}
        corners |= {c: window.core_high[i:i + 1].astype(np.int32) for i, c in enumerate(HIGH)}
        return np.zeros(1, np.int64), {
            **corners, "low": np.array([float(grid.min())]), "high": np.array([float(grid.max())]),
            "nonzero": np.array([np.count_nonzero(grid)]), "dtype": [grid.dtype.str], "block": [_pack(grid)]}
    return map_groups(rows, [*keys, *TILE_COLUMNS, *SHAPE], pack, schema, [*ZYX, value])


def write_tiles(tiles: DataFrame, keys: Sequence[str], path: str | None = None, table: str | None = None,
                buckets: int = 64, row_group: int = ROW_GROUP) -> None:
    """Save tiles below ``path``, or as a ``table`` bucketed by the keys that joins on them without a shuffle."""
    order = [*keys, *LOW]
    if table is not None:
        (tiles.repartition(buckets, *keys).sortWithinPartitions(*order).write.mode("overwrite").format("parquet")
         .option("parquet.block.size", row_group).bucketBy(buckets, *keys).sortBy(*order).saveAsTable(table))
        return
    # the bounds of the ranges are found by a pass of its own: the tiles are packed once
    tiles = materialize(tiles)
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (tiles.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite")
     .option("parquet.block.size", row_group).parquet(path))


def read_tiles(spark: SparkSession, path: str, low: Sequence[int] | None = None, high: Sequence[int] | None = None,
               least: float | None = None) -> DataFrame:
    """Stored tiles that overlap the box low <= place < high and whose largest value is at least ``least``."""
    tiles = spark.read.parquet(path)
    if low is not None:
        for first, end, a, b in zip(LOW, HIGH, low, high):
            tiles = tiles.where((F.col(first) < int(b)) & (F.col(end) > int(a)))
    return tiles if least is None else tiles.where(F.col("high") >= float(least))


def voxels_of(tiles: DataFrame, keys: Sequence[str], value: str = "value", low: Sequence[int] | None = None,
              high: Sequence[int] | None = None) -> DataFrame:
    """Nonzero voxels of the tiles, inside the box where one is given."""
    keys = list(keys)
    schema = T.StructType([*[tiles.schema[k] for k in keys], *[T.StructField(a, T.IntegerType()) for a in ZYX],
                           T.StructField(value, T.DoubleType())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            corners = np.stack([batch.column(c).to_numpy() for c in (*LOW, *HIGH)], axis=1).astype(np.int64).reshape(-1, 6)
            found, size = [], 0
            for k, (corner, kind, block) in enumerate(zip(corners, batch.column("dtype").to_pylist(), batch.column("block"))):
                first = corner[:3]
                grid = _unpack(block.as_py(), corner[3:] - first, kind)
                if low is not None:
                    # only the cells of the box are looked at
                    start = np.maximum(np.array(low) - first, 0)
                    stop = np.maximum(np.array(high) - first, start)
                    grid, first = grid[tuple(slice(a, b) for a, b in zip(start, stop))], first + start
                inside = np.nonzero(grid)
                found.append((np.full(len(inside[0]), k), *[p + o for p, o in zip(inside, first)], grid[inside].astype(np.float64)))
                size += len(inside[0])
                if size >= WRITE or k == batch.num_rows - 1:
                    rows, *points, values = (np.concatenate(c) for c in zip(*found))
                    index = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(index) for c in keys], *[pa.array(p.astype(np.int32)) for p in points], pa.array(values)],
                        names=schema.names)
                    found, size = [], 0
    return tiles.select(*keys, *LOW, *HIGH, "dtype", "block").mapInArrow(unpack, schema)


def box_slice(spark: SparkSession, path: str, keys: Sequence[str], low: Sequence[int], high: Sequence[int],
              value: str = "value") -> DataFrame:
    """Nonzero voxels of a box of the stored volumes."""
    return voxels_of(read_tiles(spark, path, low, high), keys, value, low, high)
