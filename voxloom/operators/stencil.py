"""Neighbourhood operators on tiles with a halo.

Each voxel goes to its own tile and to the tiles whose halo it lies in; a task
sees one tile plus halo, never a volume. The shape of a volume travels in its
rows (``geometry.placed``) and is one of the grouping keys inside this module.
Long-range growth runs in rounds of a few steps, each round written to the
shared folder.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators import geometry
from voxloom.operators.components import connected_components, label_points, star_roots, touching_pairs
from voxloom.operators.geometry import SHAPE, STEP, Dims, Spacing, fits, one_tile, placed, tile_for
from voxloom.operators.grouped import map_groups
from voxloom.support import ZYX, attach, full_offsets, materialize, spread, stage

TILE = (64, 64, 64)
TILE_COLUMNS = ("_tz", "_ty", "_tx")
Offsets = Sequence[tuple[int, int, int]]


def with_halo(rows: DataFrame, tile: Sequence[int], halo: Sequence[int], cells: int = 0, single: bool = False) -> DataFrame:
    """Add tile indices to placed rows, repeating the rows that neighbouring tiles need.

    A volume of at most ``cells`` cells is one tile; with ``single`` all volumes are known to be and no index is needed.
    """
    if single:
        return rows
    out = rows
    for axis, column, size, extent, reach in zip(ZYX, TILE_COLUMNS, tile, SHAPE, halo):
        if cells:
            size = F.when(fits(cells), F.col(extent)).otherwise(size)
        low = F.greatest(F.lit(0), F.floor((F.col(axis) - reach) / size)).cast("int")
        high = F.least(F.floor((F.col(extent) - 1) / size), F.floor((F.col(axis) + reach) / size)).cast("int")
        out = out.withColumn(column, F.explode(F.sequence(low, high)) if reach else low)
    return out


def group_of(keys: Sequence[str], single: bool) -> list[str]:
    """What the rows of a tile have in common."""
    return [*keys, *([] if single else TILE_COLUMNS), *SHAPE]


class Window:
    """The part of a volume one task sees: tile core, halo, and their bounds."""

    def __init__(self, first, tile, halo, cells: int = 0):
        index = np.array([first.get(c, 0) for c in TILE_COLUMNS], np.int64)
        self.extent = extent = np.array([first[c] for c in SHAPE], np.int64)
        size, reach = np.array(tile_for(extent, tile, cells)), np.array(halo)
        self.core_low = index * size
        self.core_high = np.minimum(self.core_low + size, extent)
        self.low = np.maximum(self.core_low - reach, 0)
        self.high = np.minimum(self.core_high + reach, extent)
        self.shape = tuple(self.high - self.low)

    def place(self, rows) -> tuple[np.ndarray, ...]:
        return tuple(np.asarray(rows[a], np.int64) - o for a, o in zip(ZYX, self.low))

    @property
    def core(self) -> tuple[slice, ...]:
        return tuple(slice(a - o, b - o) for a, b, o in zip(self.core_low, self.core_high, self.low))

    def in_core(self, rows) -> np.ndarray:
        return np.logical_and.reduce([(np.asarray(rows[a]) >= low) & (np.asarray(rows[a]) < high)
                                      for a, low, high in zip(ZYX, self.core_low, self.core_high)])

    def core_points(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Absolute coordinates and core-relative indices of a core-shaped mask."""
        inside = np.argwhere(mask)
        return inside + self.core_low, inside


def shifted(grid: np.ndarray, offset: Sequence[int], outside) -> np.ndarray:
    """grid[p + offset] for every p, ``outside`` beyond the array."""
    out = np.full_like(grid, outside)
    here, there = [], []
    for d, n in zip(offset, grid.shape):
        here.append(slice(max(0, -d), min(n, n - d)))
        there.append(slice(max(0, d), min(n, n + d)))
    out[tuple(here)] = grid[tuple(there)]
    return out


def reach_of(offsets: Offsets) -> np.ndarray:
    return np.abs(np.array(offsets)).max(axis=0)


def _key_frame(pdf: pd.DataFrame, keys: Sequence[str], points: np.ndarray, **values) -> pd.DataFrame:
    frame = {k: np.repeat(pdf[k].iloc[:1].to_numpy(), len(points)) for k in keys}
    frame.update({a: points[:, i].astype(np.int32) for i, a in enumerate(ZYX)})
    frame.update(values)
    return pd.DataFrame(frame)


def border_voxels(voxels: DataFrame, keys: Sequence[str], code: str, dims: Dims, offsets: Offsets,
                  outside_is_border: bool, tile: Sequence[int] = TILE) -> DataFrame:
    """Voxels that an erosion of their own code removes.

    ``offsets`` is the structuring element; ``outside_is_border`` says whether
    the volume edge erodes.
    """
    keys = list(keys)
    halo = tuple(int(r) for r in reach_of(offsets))
    columns = [*keys, *ZYX, code]
    whole, single = geometry.WHOLE, one_tile(dims, tile)
    rows = with_halo(placed(voxels.select(*columns), keys, dims), tile, halo, whole, single)
    outside = np.iinfo(np.int64).min

    def pick(first: dict, part: dict) -> tuple:
        window = Window(first, tile, halo, whole)
        # a margin as wide as the halo: cells beyond the volume differ from all others
        grid = np.full([n + 2 * r for n, r in zip(window.shape, halo)], outside)
        grid[tuple(slice(r, r + n) for n, r in zip(window.shape, halo))] = 0
        place = np.ravel_multi_index([p + r for p, r in zip(window.place(part), halo)], grid.shape)
        cells, codes = grid.reshape(-1), part[code].astype(np.int64)
        cells[place] = codes
        inside = np.flatnonzero(window.in_core(part))
        place, codes = place[inside], codes[inside]
        edge = np.zeros(len(inside), bool)
        for offset in offsets:
            near = cells[place + (offset[0] * grid.shape[1] + offset[1]) * grid.shape[2] + offset[2]]
            edge |= near != codes if outside_is_border else (near != codes) & (near != outside)
        return inside[edge], {}

    return map_groups(rows, group_of(keys, single), pick, voxels.select(*columns).schema, [*ZYX, code], keys if single else None)


def ball_offsets(radius: float, spacing: Sequence[float]) -> list[tuple[int, int, int]]:
    """Offsets of a ball of ``radius`` millimetres in voxels of the given spacing.

    A fine ball of twice as many cells as the widest axis has is read at the voxel centres, linearly between its cells;
    offsets where more than one half of it is found belong to the ball.
    """
    reach = np.rint(radius / np.asarray(spacing, float)).astype(int)
    sizes = 2 * reach + 1
    fine = 2 * int(sizes.max())
    low, share = [], []
    for n in sizes:
        at = (np.arange(n) + 0.5) * (2 * fine + 1) / n - 0.5 - fine
        low.append(np.floor(at))
        share.append(at - np.floor(at))
    found = np.zeros(sizes)
    for corner in itertools.product((0, 1), repeat=3):
        z, y, x = np.ix_(*[(b + c) ** 2 for b, c in zip(low, corner)])
        wz, wy, wx = np.ix_(*[f if c else 1 - f for f, c in zip(share, corner)])
        found += (z + y + x <= fine * fine) * wz * wy * wx
    return [tuple(int(c) for c in o) for o in np.argwhere(found > 0.5) - reach]


# Half sizes (z, y, x) of the three centre planes of a box of 7 slices by 3 by 3.
HEAD_BOXES = ((0, 1, 1), (3, 0, 1), (3, 1, 0))


def box_offsets(boxes: Sequence[Sequence[int]]) -> list[tuple[int, int, int]]:
    """All offsets of a union of centred boxes."""
    return sorted({o for box in boxes for o in itertools.product(*[range(-r, r + 1) for r in box])})


def _dilate_grid(grid: np.ndarray, offsets: Offsets) -> np.ndarray:
    out = grid.copy()
    for offset in offsets:
        if any(offset):
            np.maximum(out, shifted(grid, offset, 0), out=out)
    return out


def _widen(grid: np.ndarray, axis: int, radius: int) -> np.ndarray:
    """Maximum over ``radius`` cells to both sides of one axis."""
    out = grid.copy()
    for d in range(1, radius + 1):
        ahead, behind = [slice(None)] * 3, [slice(None)] * 3
        ahead[axis], behind[axis] = slice(d, None), slice(None, -d)
        np.maximum(out[tuple(behind)], grid[tuple(ahead)], out=out[tuple(behind)])
        np.maximum(out[tuple(ahead)], grid[tuple(behind)], out=out[tuple(ahead)])
    return out


def _dilate_boxes(grid: np.ndarray, boxes: Sequence[Sequence[int]]) -> np.ndarray:
    """Binary dilation by a union of boxes; a box is widened axis by axis."""
    shared: dict[tuple, np.ndarray] = {}

    def widened(radii: tuple) -> np.ndarray:
        if not any(radii):
            return grid
        if radii not in shared:
            last = max(a for a in range(3) if radii[a])
            shared[radii] = _widen(widened(radii[:last] + (0,) * (3 - last)), last, radii[last])
        return shared[radii]
    out = widened(tuple(boxes[0]))
    for box in boxes[1:]:
        out = np.maximum(out, widened(tuple(box)))
    return out


def _shifted_bits(words: np.ndarray, by: int) -> np.ndarray:
    """Bits along the last axis moved up (``by`` > 0) or down by less than 64 places."""
    n = np.uint64(abs(by))
    rest = np.uint64(64 - abs(by))
    out = words << n if by > 0 else words >> n
    if by > 0:
        out[..., 1:] |= words[..., :-1] >> rest
    else:
        out[..., :-1] |= words[..., 1:] << rest
    return out


def _widen_bits(words: np.ndarray, axis: int, radius: int) -> np.ndarray:
    """Bits set within ``radius`` cells of one axis; the reach doubles with each step."""
    out, reached = words.copy(), 0
    while reached < radius:
        step = min(reached + 1, radius - reached, 63)
        if axis == 2:
            out |= _shifted_bits(out, step) | _shifted_bits(out, -step)
        elif step < words.shape[axis]:
            old = out.copy()
            ahead, behind = [slice(None)] * 3, [slice(None)] * 3
            ahead[axis], behind[axis] = slice(step, None), slice(None, -step)
            out[tuple(behind)] |= old[tuple(ahead)]
            out[tuple(ahead)] |= old[tuple(behind)]
        reached += step
    return out


def dilate_bits(grid: np.ndarray, boxes: Sequence[Sequence[int]], iterations: int) -> np.ndarray:
    """Repeated dilation of a whole boolean grid by a union of boxes, 64 cells of a line in one word."""
    width = grid.shape[2]
    packed = np.packbits(grid, axis=2, bitorder="little")
    packed = np.pad(packed, ((0, 0), (0, 0), (0, -packed.shape[2] % 8)))
    words = packed.view(np.uint64)
    inside = np.packbits(np.arange(packed.shape[2] * 8) < width, bitorder="little").view(np.uint64)
    for _ in range(iterations):
        shared: dict[tuple, np.ndarray] = {}

        def widened(radii: tuple) -> np.ndarray:
            if not any(radii):
                return words
            if radii not in shared:
                last = max(a for a in range(3) if radii[a])
                shared[radii] = _widen_bits(widened(radii[:last] + (0,) * (3 - last)), last, radii[last])
            return shared[radii]
        out = words.copy()
        for box in boxes:
            out |= widened(tuple(box))
        out &= inside
        if np.array_equal(out, words):
            break
        words = out
    return np.unpackbits(words.view(np.uint8), axis=2, count=width, bitorder="little").view(bool)


def _pack(block: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(block).tobytes(), 1)


def _unpack(data: bytes, shape: Sequence[int], dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype).reshape(shape)


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _tile_fields() -> list[T.StructField]:
    return [T.StructField(c, T.IntegerType()) for c in TILE_COLUMNS]


def packed_tiles(voxels: DataFrame, keys: Sequence[str], value: str | None, tile, dtype) -> DataFrame:
    """One row per tile of placed voxels with its dense, compressed block (``block``); ``SHAPE`` is part of ``keys``."""
    rows = with_halo(voxels.select(*keys, *ZYX, *([value] if value else [])), tile, (0, 0, 0))
    schema = T.StructType([*_key_fields(voxels, keys), *_tile_fields(), T.StructField("block", T.BinaryType())])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        window = Window(pdf.iloc[0], tile, (0, 0, 0))
        grid = np.zeros(window.shape, dtype)
        grid[window.place(pdf)] = pdf[value].to_numpy() if value else 1
        out = pdf[[*keys, *TILE_COLUMNS]].iloc[:1].copy()
        out["block"] = [_pack(grid)]
        return out
    return spread(rows, *keys, *TILE_COLUMNS).groupBy(*keys, *TILE_COLUMNS).applyInPandas(pack, schema)


def unpacked_voxels(tiles: DataFrame, keys: Sequence[str], block: str, value: str | None, tile, dtype) -> DataFrame:
    """Nonzero voxels of the blocks."""
    fields = [*_key_fields(tiles, keys), *[T.StructField(a, T.IntegerType()) for a in ZYX]]
    if value:
        fields.append(T.StructField(value, T.LongType()))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i:i + 1]
                window = Window(row.iloc[0], tile, (0, 0, 0))
                grid = _unpack(row[block].iloc[0], window.shape, dtype)
                points, inside = window.core_points(grid != 0)
                extra = {value: grid[tuple(inside.T)].astype(np.int64)} if value else {}
                yield _key_frame(row, keys, points, **extra)
    return spread(tiles.select(*keys, *TILE_COLUMNS, block), *keys, *TILE_COLUMNS).mapInPandas(unpack, T.StructType(fields))


def halo_pieces(tiles: DataFrame, keys: Sequence[str], block: str, tile, halo, dtype) -> DataFrame:
    """Send each tile's block to itself and, cut to what they need, to the tiles
    whose halo overlaps it. Empty cuts are not sent."""
    corner = [T.StructField(c + a, T.IntegerType()) for c in ("_lo", "_hi") for a in ZYX]
    schema = T.StructType([*_key_fields(tiles, keys), *_tile_fields(), *corner, T.StructField("piece", T.BinaryType())])
    size, reach = np.array(tile), np.array(halo)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i:i + 1]
                window = Window(row.iloc[0], tile, (0, 0, 0))
                grid = _unpack(row[block].iloc[0], window.shape, dtype)
                first = np.maximum(window.core_low - reach, 0) // size
                last = np.minimum(window.core_high - 1 + reach, window.extent - 1) // size
                found = []
                for target in itertools.product(*[range(f, n + 1) for f, n in zip(first, last)]):
                    low = np.maximum(np.array(target) * size - reach, window.core_low)
                    high = np.minimum((np.array(target) + 1) * size + reach, window.core_high)
                    cut = grid[tuple(slice(p - o, q - o) for p, q, o in zip(low, high, window.core_low))]
                    if cut.any():
                        found.append((*target, *low, *high, _pack(cut)))
                out = pd.DataFrame(found, columns=[*TILE_COLUMNS, *[f.name for f in corner], "piece"])
                for k in keys:
                    out[k] = row[k].iloc[0]
                yield out[schema.names]
    return spread(tiles.select(*keys, *TILE_COLUMNS, block), *keys, *TILE_COLUMNS).mapInPandas(send, schema)


def _assemble(pdf: pd.DataFrame, window: Window, dtype) -> np.ndarray:
    grid = np.zeros(window.shape, dtype)
    for row in pdf.itertuples(index=False, name=None):
        data = dict(zip(pdf.columns, row))
        low = np.array([data["_lo" + a] for a in ZYX])
        high = np.array([data["_hi" + a] for a in ZYX])
        where = tuple(slice(p - o, q - o) for p, q, o in zip(low, high, window.low))
        grid[where] = _unpack(data["piece"], high - low, dtype)
    return grid


def _dilator(keys: Sequence[str], tile, halo, boxes, iterations: int) -> Callable:
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        window = Window(pdf.iloc[0], tile, halo)
        grid = _assemble(pdf, window, np.uint8)
        for _ in range(iterations):
            if grid[window.core].all():
                break
            grid = _dilate_boxes(grid, boxes)
        out = pdf[[*keys, *TILE_COLUMNS]].iloc[:1].copy()
        out["block"] = [_pack(grid[window.core])]
        return out if grid[window.core].any() else out.iloc[:0]
    return grow


def dilate(voxels: DataFrame, keys: Sequence[str], dims: Dims, boxes: Sequence[Sequence[int]],
           iterations: int = 1, per_round: int = 16, tile: Sequence[int] = TILE) -> DataFrame:
    """Binary dilation by a union of boxes, repeated ``iterations`` times inside the volume.

    A volume of at most ``geometry.DENSE`` cells is grown in one task, as bits. A larger one is cut into tiles; between
    rounds it travels as compressed tile blocks, not as voxels.
    """
    outer, keys = list(keys), [*keys, *SHAPE]
    rows = placed(voxels.select(*outer, *ZYX), outer, dims)
    cells = geometry.DENSE
    if one_tile(dims, (0, 0, 0), cells):
        return _dilated_whole(rows, keys, boxes, iterations).drop(*SHAPE)
    if isinstance(dims, DataFrame) and cells:
        rows = materialize(rows)
        small = _dilated_whole(rows.where(fits(cells)), keys, boxes, iterations).drop(*SHAPE)
        return small.unionByName(_dilated_tiles(rows.where(~fits(cells)), keys, boxes, iterations, per_round, tile))
    return _dilated_tiles(rows, keys, boxes, iterations, per_round, tile)


def _dilated_whole(rows: DataFrame, keys: Sequence[str], boxes, iterations: int) -> DataFrame:
    """Dilation of volumes that one task takes whole, as bits."""
    schema = T.StructType([*_key_fields(rows, keys), *[T.StructField(a, T.IntegerType()) for a in ZYX]])

    def grow(first: dict, part: dict) -> tuple:
        grid = np.zeros([first[c] for c in SHAPE], bool)
        grid[tuple(part[a] for a in ZYX)] = True
        found = np.flatnonzero(dilate_bits(grid, boxes, iterations)).astype(np.int32)
        line, x = np.divmod(found, np.int32(grid.shape[2]))
        z, y = np.divmod(line, np.int32(grid.shape[1]))
        return np.zeros(len(found), np.int64), {"z": z, "y": y, "x": x}
    return map_groups(rows, keys, grow, schema, ZYX, keys[:-len(SHAPE)])


def _dilated_tiles(rows: DataFrame, keys: Sequence[str], boxes, iterations: int, per_round: int, tile) -> DataFrame:
    state = packed_tiles(rows, keys, None, tile, np.uint8)
    schema = state.schema
    for start in range(0, iterations, per_round):
        steps = min(per_round, iterations - start)
        halo = tuple(int(r) * steps for r in np.max(boxes, axis=0))
        pieces = halo_pieces(state, keys, "block", tile, halo, np.uint8)
        grow = _dilator(keys, tile, halo, boxes, steps)
        state = spread(pieces, *keys, *TILE_COLUMNS).groupBy(*keys, *TILE_COLUMNS).applyInPandas(grow, schema)
        if start + steps < iterations:
            state = materialize(state)
    return unpacked_voxels(state, keys, "block", None, tile, np.uint8).drop(*SHAPE)


def expand_labels(voxels: DataFrame, keys: Sequence[str], label: str, dims: Dims, radius: int,
                  tile: Sequence[int] = TILE) -> DataFrame:
    """Every background voxel within ``radius`` takes the nearest label.

    Equal distances go to the smallest label. The squared distance and the label
    are packed into one number, so the exact search is three one-axis minima.
    """
    schema = T.StructType([*voxels.select(*keys, *ZYX).schema.fields, T.StructField(label, T.IntegerType())])
    kinds = {a: np.int64 if isinstance(schema[a].dataType, T.LongType) else np.int32 for a in ZYX}

    def listed(window: Window, names: np.ndarray, near: np.ndarray) -> tuple:
        found = np.flatnonzero(near >= 0)
        line, x = np.divmod(found, near.shape[2])
        z, y = np.divmod(line, near.shape[1])
        points = {a: (p + o).astype(kinds[a]) for a, p, o in zip(ZYX, (z, y, x), window.core_low)}
        return np.zeros(len(found), np.int64), {**points, label: names[near.reshape(-1)[found]].astype(np.int32)}
    return _expanded(voxels, keys, label, dims, radius, tile, listed, schema)


def expanded_sums(voxels: DataFrame, keys: Sequence[str], label: str, dims: Dims, radius: int,
                  tile: Sequence[int] = TILE) -> DataFrame:
    """Per label of ``expand_labels``: number of voxels ``n`` and the sums of y, x and y * x, added up tile by tile."""
    keys = list(keys)
    names = ("n", "sum_y", "sum_x", "sum_yx")
    schema = T.StructType([*_key_fields(voxels, keys), T.StructField(label, T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in names]])

    def summed(window: Window, codes: np.ndarray, near: np.ndarray) -> tuple:
        y, x = (np.arange(low, high) for low, high in zip(window.core_low[1:], window.core_high[1:]))
        flat = np.stack([(near == k).sum(axis=0) for k in range(len(codes))])
        lines, columns = flat.sum(axis=2), flat.sum(axis=1)
        sums = (lines.sum(axis=1), lines @ y, columns @ x, (flat @ x) @ y)
        some = sums[0] > 0
        return np.zeros(int(some.sum()), np.int64), {
            label: codes[some].astype(np.int32), **{c: v[some].astype(np.int64) for c, v in zip(names, sums)}}
    parts = _expanded(voxels, keys, label, dims, radius, tile, summed, schema)
    return parts.groupBy(*keys, label).agg(*[F.sum(c).alias(c) for c in names])


def nearest_labels(shape: Sequence[int], place: Sequence[np.ndarray], ranks: np.ndarray, count: int, radius: int) -> np.ndarray:
    """Rank of the nearest voxel within ``radius`` for each cell, the smallest on ties; -1 where there is none.

    Squared distance and rank are one number.  The lines, then the planes, that hold a voxel spread over those beside
    them, so the work grows with what is occupied.
    """
    most = (3 * radius * radius + 1) * count
    kind = next(k for k in (np.int16, np.int32, np.int64) if 2 * most <= np.iinfo(k).max)
    reach = range(1, radius + 1)
    z, y, x = place
    rows, row = np.unique(z * shape[1] + y, return_inverse=True)
    lines = np.full((len(rows), shape[2]), most, kind)
    np.minimum.at(lines, (row, x), ranks.astype(kind))
    best = lines.copy()
    for d in reach:
        add = kind(d * d * count)
        np.minimum(best[:, d:], lines[:, :-d] + add, out=best[:, d:])
        np.minimum(best[:, :-d], lines[:, d:] + add, out=best[:, :-d])
    levels, level = np.unique(rows // shape[1], return_inverse=True)
    planes = np.full((len(levels), shape[1], shape[2]), most, kind)
    for d in range(-radius, radius + 1):
        to = rows % shape[1] + d
        on = (to >= 0) & (to < shape[1])
        where = (level[on], to[on])
        planes[where] = np.minimum(planes[where], best[on] + kind(d * d * count))
    out = np.full(shape, most, kind)
    for at, plane in zip(levels.tolist(), planes):
        for d in range(max(-radius, -at), min(radius, shape[0] - 1 - at) + 1):
            np.minimum(out[at + d], plane + kind(d * d * count), out=out[at + d])
    return np.where(out < (radius * radius + 1) * count, out % kind(count), kind(-1))


def _expanded(voxels: DataFrame, keys: Sequence[str], label: str, dims: Dims, radius: int, tile, answer: Callable,
              schema: T.StructType) -> DataFrame:
    """What ``answer`` makes of each tile's labels and the rank of the nearest one in its core."""
    keys, halo, dense = list(keys), (radius,) * 3, geometry.DENSE
    rows = placed(voxels.where(F.col(label) > 0).select(*keys, *ZYX, label), keys, dims)
    single = one_tile(dims, tile, dense)
    rows = with_halo(rows, tile, halo, dense, single)

    def nearest(first: dict, part: dict) -> tuple:
        window = Window(first, tile, halo, dense)
        names, ranks = np.unique(part[label].astype(np.int64), return_inverse=True)
        near = nearest_labels(window.shape, window.place(part), ranks, len(names), radius)
        return answer(window, names, near[window.core])
    return map_groups(rows, group_of(keys, single), nearest, schema, [*ZYX, label], keys if single else None)


def fill_holes(mask: DataFrame, keys: Sequence[str], dims: Dims, tile: Sequence[int] = TILE) -> DataFrame:
    """Background voxels that no face path connects to the volume edge.

    Background components are labelled per tile; their face voxels are matched
    across tiles and the components that reach the edge are removed.
    """
    keys = list(keys)
    single, whole = one_tile(dims, tile), geometry.WHOLE
    rows = with_halo(placed(mask.select(*keys, *ZYX), keys, dims), tile, (0, 0, 0), whole, single)
    if not single:
        grid = rows.select(*keys, *SHAPE).distinct()
        for column, extent, s in zip(TILE_COLUMNS, SHAPE, tile):
            last = F.floor((F.col(extent) - 1) / F.when(fits(), F.col(extent)).otherwise(s)).cast("int")
            grid = grid.withColumn(column, F.explode(F.sequence(F.lit(0), last)))
        # one marker row per tile, so that tiles without any mask voxel are seen too
        rows = rows.unionByName(grid.withColumns({a: F.lit(-1) for a in ZYX}).select(*rows.columns))
    schema = T.StructType([*mask.select(*keys, *ZYX).schema.fields, T.StructField("component", T.LongType()),
                           T.StructField("open", T.BooleanType())])
    kinds = {a: np.int64 if isinstance(schema[a].dataType, T.LongType) else np.int32 for a in ZYX}

    def background(first: dict, part: dict) -> tuple | None:
        window = Window(first, tile, (0, 0, 0), whole)
        extent = window.extent
        free = np.ones(window.shape, bool)
        real = part["z"] >= 0
        free[tuple(p[real] for p in window.place(part))] = False
        points = np.argwhere(free) + window.core_low
        if not len(points):
            return None
        roots = label_points(points, np.zeros(len(points), np.int8), 6)
        lin = (points[:, 0] * extent[1] + points[:, 1]) * extent[2] + points[:, 2]
        reaches = np.zeros(len(points), bool)
        reaches[roots[((points == 0) | (points == extent - 1)).any(axis=1)]] = True
        is_open = reaches[roots]
        keep = ~is_open  # the inside of an open component is never needed
        if not single:
            keep |= ((points == window.core_low) | (points == window.core_high - 1)).any(axis=1)
        points = points[keep]
        return np.zeros(len(points), np.int64), {"component": lin[roots][keep], "open": is_open[keep],
                                                 **{a: points[:, i].astype(kinds[a]) for i, a in enumerate(ZYX)}}

    found = map_groups(rows, group_of(keys, single), background, schema, ZYX, keys if single else None)
    if single:
        return found.where(~F.col("open")).select(*keys, *ZYX)
    found = materialize(found)
    roots = star_roots(touching_pairs(found, keys, 6, None, tile), keys)
    roots = roots.withColumnRenamed("node", "component")
    # verdicts on components, not voxels: the open outside of a volume is one row per tile component
    parts = found.groupBy(*keys, "component").agg(F.bool_or("open").alias("open"))
    parts = materialize(parts.join(roots, [*keys, "component"], "left")
                        .withColumn("root", F.coalesce("root", "component")))
    closed = parts.groupBy(*keys, "root").agg(F.bool_or("open").alias("_open")).where(~F.col("_open"))
    closed = parts.join(closed.drop("_open"), [*keys, "root"], "left_semi").select(*keys, "component")
    return attach(found, closed, [*keys, "component"], "left_semi").select(*keys, *ZYX)


def growth_steps(spacing: Sequence[float], count: int, done: int = 0) -> list[Offsets]:
    """Structuring elements number ``done`` to ``done + count`` of the spacing-aware
    growth: finest axes step every time, a coarser one once it has fallen behind
    by half its spacing."""
    reached = [0.0] * 3
    out = []
    for _ in range(done + count):
        lead = max(reached)
        moves = [s == min(spacing) or r + s / 2 < lead for s, r in zip(spacing, reached)]
        out.append([(0, 0, 0)] + [tuple(sign if i == a else 0 for i in range(3))
                                  for a in range(3) if moves[a] for sign in (-1, 1)])
        reached = [r + s if m else r for r, s, m in zip(reached, spacing, moves)]
    return out[done:]


def _instance_grower(keys: Sequence[str], tile, halo, count: int, done: int) -> Callable:
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        window = Window(pdf.iloc[0], tile, halo)
        asking = pdf["asked"]
        grid = _assemble(pdf[~asking], window, np.int64)
        wanted = np.zeros([h - c for c, h in zip(window.core_low, window.core_high)], np.uint8)
        for data in pdf.loc[asking, "piece"]:
            wanted = _unpack(data, wanted.shape, np.uint8).copy()
        answer = np.zeros(wanted.shape, np.int64)
        for structure in growth_steps(tuple(pdf[list(STEP)].iloc[0]), count, done):
            free = grid[window.core] == 0
            grid = _dilate_grid(grid, structure)
            fresh = free & (wanted > 0) & (grid[window.core] > 0)
            answer[fresh] = grid[window.core][fresh]
        wanted[answer > 0] = 0
        out = pdf[[*keys, *TILE_COLUMNS]].iloc[:1].copy()
        out["block"] = [_pack(grid[window.core])]
        out["wanted"] = [_pack(wanted)]
        out["answer"] = [_pack(answer)]
        out["open"] = [int(wanted.sum())]
        out["grown"] = [bool(grid[window.core].any())]
        return out
    return grow


def grow_instances(cores: DataFrame, border: DataFrame, keys: Sequence[str], dims: Dims,
                   spacing: Spacing = (1.0, 1.0, 1.0), instance: str = "instance", per_round: int = 6,
                   tile: Sequence[int] = TILE) -> DataFrame:
    """Give each border voxel the instance whose growth reaches it first.

    Instances grow through the whole volume; where several arrive together the
    largest id wins. Volumes without any core leave their border at 0. A volume
    of no more cells than a default tile is grown in one task; in others labels and
    open border voxels travel between rounds as compressed tile blocks.
    Shapes and spacings may differ from volume to volume.
    """
    outer = list(keys)
    keys = [*outer, *SHAPE, *STEP]
    columns = [*outer, *ZYX]
    if one_tile(dims, (0, 0, 0)):
        return _grown_whole(cores, border, outer, dims, spacing, instance)
    if isinstance(dims, DataFrame) and geometry.WHOLE:
        # volumes without a shape stay with the others, where they are an error
        small = materialize(dims.where(fits(None, geometry.SIZES)).select(*[k for k in outer if k in dims.columns]))
        on = small.columns
        parts = [(cores.join(small, on, how), border.join(small, on, how)) for how in ("left_semi", "left_anti")]
        (few, edge), (cores, border) = parts
        return _grown_whole(few, edge, outer, dims, spacing, instance).unionByName(
            _grown_tiles(cores, border, outer, dims, spacing, instance, per_round, tile))
    return _grown_tiles(cores, border, outer, dims, spacing, instance, per_round, tile)


def grow_grid(grid: np.ndarray, wanted: np.ndarray, spacing: Sequence[float]) -> np.ndarray:
    """Labels of the ``wanted`` cells when the growth of the positive labels of ``grid`` first reaches them."""
    answer = np.zeros(len(wanted), grid.dtype)
    waiting = np.arange(len(wanted))
    cells = grid.copy()
    at, done = cells.reshape(-1)[wanted], 0
    answer[:] = at
    waiting = waiting[at == 0]
    while len(waiting):
        for structure in growth_steps(spacing, 8, done):
            old = cells.copy()
            for offset in structure:
                here, there = [], []
                for d, n in zip(offset, cells.shape):
                    here.append(slice(max(0, -d), max(0, min(n, n - d))))
                    there.append(slice(max(0, d), max(0, min(n, n + d))))
                if any(offset):
                    np.maximum(cells[tuple(here)], old[tuple(there)], out=cells[tuple(here)])
            found = cells.reshape(-1)[wanted[waiting]]
            answer[waiting] = found
            waiting = waiting[found == 0]
            if not len(waiting):
                break
        done += 8
    return answer


def _grown_whole(cores: DataFrame, border: DataFrame, keys: Sequence[str], dims: Dims, spacing: Spacing, instance: str) -> DataFrame:
    """Growth in volumes that one task takes whole."""
    columns = [*keys, *ZYX]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    # border of an unknown volume meets no core
    rows = cores.select(*columns, F.col(instance).cast("long").alias("label"), F.lit(0).alias("_kind")).unionByName(
        border.select(*columns, F.lit(0).cast("long").alias("label"), F.when(known, 1).otherwise(2).alias("_kind")))
    rows = placed(rows, keys, dims, spacing)
    schema = T.StructType([*cores.select(*columns).schema.fields, T.StructField(instance, T.LongType())])

    def grow(first: dict, part: dict) -> tuple:
        shape = [first[c] for c in SHAPE]
        place = np.ravel_multi_index([part[a] for a in ZYX], shape)
        label = part["label"].copy()
        core, asked = part["_kind"] == 0, np.flatnonzero(part["_kind"] == 1)
        if core.any() and len(asked):
            # ranks from 1 on keep the order of the labels, whatever these are
            names, rank = np.unique(label[core], return_inverse=True)
            grid = np.zeros(shape, np.int32)
            np.maximum.at(grid.reshape(-1), place[core], (rank + 1).astype(np.int32))
            label[asked] = names[grow_grid(grid, place[asked], tuple(first[c] for c in STEP)) - 1]
        return np.arange(len(label)), {instance: label}
    return map_groups(rows, [*keys, *SHAPE, *STEP], grow, schema, [*ZYX, "label", "_kind"], keys)


def _grown_tiles(cores: DataFrame, border: DataFrame, outer: Sequence[str], dims: Dims, spacing: Spacing, instance: str,
                 per_round: int, tile: Sequence[int]) -> DataFrame:
    """Growth in volumes that are cut into tiles, in rounds; labels travel as instance + 1, since 0 is the background."""
    keys = [*outer, *SHAPE, *STEP]
    columns = [*outer, *ZYX]
    seeds = cores.select(*columns, (F.col(instance).cast("long") + 1).alias("label"))
    state = packed_tiles(placed(seeds, outer, dims, spacing), keys, "label", tile, np.int64)
    key_fields = _key_fields(state, keys)
    left = packed_tiles(placed(border.select(*columns), outer, dims, spacing), keys, None, tile, np.uint8)
    left = left.withColumnRenamed("block", "wanted")
    schema = T.StructType([*key_fields, *_tile_fields(), *[
        T.StructField(n, T.BinaryType()) for n in ("block", "wanted", "answer")],
        T.StructField("open", T.LongType()), T.StructField("grown", T.BooleanType())])
    result = cores.select(*columns, F.col(instance).cast("long").alias(instance))
    # cases with border but no core can never be answered
    started = materialize(cores.select(*outer).distinct())
    result = result.unionByName(
        border.select(*columns).join(started, outer, "left_anti").withColumn(instance, F.lit(0).cast("long")))
    left = left.join(started, outer, "left_semi")
    # no axis moves more than once a step, whatever the spacing of a volume
    halo = ((per_round,) * 3 if isinstance(spacing, DataFrame) else None)
    done = 0
    rounds: list[str] = []
    while True:
        reach = halo or tuple(int(r) for r in sum(reach_of(s) for s in growth_steps(spacing, per_round, done)))
        pieces = halo_pieces(state, keys, "block", tile, reach, np.int64).withColumn("asked", F.lit(False))
        asking = left.select(*keys, *TILE_COLUMNS, *[F.lit(0).alias(c + a) for c in ("_lo", "_hi") for a in ZYX],
                             F.col("wanted").alias("piece"), F.lit(True).alias("asked"))
        grow = _instance_grower(keys, tile, reach, per_round, done)
        done += per_round
        rows = spread(pieces.unionByName(asking), *keys, *TILE_COLUMNS)
        rounds.append(stage(rows.groupBy(*keys, *TILE_COLUMNS).applyInPandas(grow, schema)))
        out = cores.sparkSession.read.schema(schema).parquet(rounds[-1])
        waiting = materialize(out.groupBy(*outer).agg(F.sum("open").alias("_o")).where(F.col("_o") > 0).select(*outer))
        if waiting.isEmpty():
            # the answers of all rounds as one table: the plan does not grow with their number
            answers = cores.sparkSession.read.schema(schema).parquet(*rounds)
            return result.unionByName(unpacked_voxels(answers, keys, "answer", instance, tile, np.int64)
                                      .drop(*SHAPE, *STEP).withColumn(instance, F.col(instance) - 1))
        # only the cases that still wait go on
        state = attach(out.where("grown").select(*keys, *TILE_COLUMNS, "block"), waiting, outer, "left_semi")
        left = out.where(F.col("open") > 0).select(*keys, *TILE_COLUMNS, "wanted")


def instances_from_core_and_border(voxels: DataFrame, keys: Sequence[str], code: str, dims: Dims,
                                   spacing: Spacing = (1.0, 1.0, 1.0), small_core: int | None = None,
                                   isolated_border: int | None = None, tile: Sequence[int] = TILE) -> DataFrame:
    """Instances from a map of 1 (core) and 2 (border).

    With ``small_core`` cores of at most that many voxels count as border; with
    ``isolated_border`` objects without any core become instances of their own
    when they hold at least that many voxels.
    """
    keys = list(keys)
    columns = [*keys, *ZYX]
    parts = materialize(voxels.where(F.col(code).isin(1, 2)).select(*columns, code))

    def cores_of(rows: DataFrame) -> DataFrame:
        found = connected_components(rows.where(F.col(code) == 1).select(*columns), keys, dims, 26, tile=tile)
        return materialize(found.withColumnRenamed("component", "instance"))

    cores = cores_of(parts)
    if small_core is not None:
        sizes = cores.groupBy(*keys, "instance").agg(F.count("*").alias("_n")).where(F.col("_n") <= small_core)
        demoted = cores.join(materialize(sizes.drop("_n")), [*keys, "instance"], "left_semi").select(*columns, F.lit(2).alias("_new"))
        parts = (parts.join(demoted, columns, "left").withColumn(code, F.coalesce("_new", code)).drop("_new"))
        parts = materialize(parts)
        # removing whole components leaves the others and their ids unchanged
        cores = cores.join(materialize(sizes.drop("_n")), [*keys, "instance"], "left_anti")
    grown = grow_instances(cores, parts.where(F.col(code) == 2), keys, dims, spacing, tile=tile)
    if isolated_border is None:
        return grown
    alone = isolated_objects(parts, keys, code, dims, isolated_border, tile)
    return (grown.join(alone, columns, "left")
            .withColumn("instance", F.coalesce("_own", "instance")).drop("_own"))


def isolated_objects(parts: DataFrame, keys: Sequence[str], code: str, dims: Dims, minimum: int,
                     tile: Sequence[int] = TILE) -> DataFrame:
    """Voxels (with ``_own`` object id) of objects that contain no core."""
    keys = list(keys)
    objects = materialize(connected_components(parts, keys, dims, 26, tile=tile))
    lonely = (objects.groupBy(*keys, "component")
              .agg(F.bool_or(F.col(code) == 1).alias("_core"), F.count("*").alias("_n"))
              .where(~F.col("_core") & (F.col("_n") >= minimum)).select(*keys, "component"))
    return (objects.join(lonely, [*keys, "component"], "left_semi")
            .select(*keys, *ZYX, F.col("component").alias("_own")))


def neighbour_count(voxels: DataFrame, keys: Sequence[str], code: str, dims: Dims, connectivity: int = 6,
                    tile: Sequence[int] = TILE) -> DataFrame:
    """Number of equal-code neighbours of each voxel."""
    keys = list(keys)
    columns = [*keys, *ZYX, code]
    rows = with_halo(placed(voxels.select(*columns), keys, dims), tile, (1, 1, 1))
    schema = T.StructType([*voxels.select(*columns).schema.fields, T.StructField("neighbours", T.LongType())])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        window = Window(pdf.iloc[0], tile, (1, 1, 1))
        grid = np.zeros([n + 2 for n in window.shape], np.int64)
        z, y, x = (p + 1 for p in window.place(pdf))
        codes = pdf[code].to_numpy(np.int64)
        grid[z, y, x] = codes
        inside = window.in_core(pdf)
        z, y, x, codes = z[inside], y[inside], x[inside], codes[inside]
        out = pdf.loc[inside, columns].copy()
        out["neighbours"] = sum((grid[z + dz, y + dy, x + dx] == codes).astype(np.int64)
                                for dz, dy, dx in full_offsets(connectivity))
        return out
    return spread(rows, *keys, *TILE_COLUMNS).groupBy(*keys, *TILE_COLUMNS).applyInPandas(count, schema)


def halo_map(voxels: DataFrame, keys: Sequence[str], value: str, dims: Dims, halo: Sequence[int],
             function: Callable[[np.ndarray], np.ndarray], tile: Sequence[int] = TILE, dtype: str = "f8",
             edge: str = "constant") -> DataFrame:
    """Apply a numpy function to whole volumes, tile by tile.

    ``function`` takes a dense block (absent voxels are 0) and returns one of the same shape; each of its results may
    depend on the ``halo`` cells around it.  Blocks are handed over with that halo, beyond the volume filled as
    ``np.pad`` does in mode ``edge``, and the cores of the answers are put together: nonzero voxels as keys, z, y, x,
    ``value`` (double).  Tiles without a voxel within their halo are taken to stay zero.
    """
    keys = list(keys)
    halo = tuple(int(h) for h in halo)
    rows = with_halo(placed(voxels.select(*keys, *ZYX, value), keys, dims), tile, halo)
    schema = T.StructType([*voxels.select(*keys, *ZYX).schema.fields, T.StructField(value, T.DoubleType())])

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        window = Window(pdf.iloc[0], tile, halo)
        grid = np.zeros(window.shape, dtype)
        grid[window.place(pdf)] = pdf[value].to_numpy()
        missing = [(r - (c - w), r - (v - h)) for r, c, w, v, h in zip(
            halo, window.core_low, window.low, window.high, window.core_high)]
        answer = np.asarray(function(np.pad(grid, [(int(a), int(b)) for a, b in missing], mode=edge)))
        inner = tuple(slice(r, r + int(h - c)) for r, c, h in zip(halo, window.core_low, window.core_high))
        points, inside = window.core_points(answer[inner] != 0)
        return _key_frame(pdf, keys, points, **{value: answer[inner][tuple(inside.T)].astype(np.float64)})

    return spread(rows, *keys, *TILE_COLUMNS).groupBy(*keys, *TILE_COLUMNS).applyInPandas(apply, schema)
