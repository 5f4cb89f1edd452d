"""Shape arithmetic and resampling of sparse volumes, axis by axis.

Target index i reads source coordinate scale * (i + 0.5) - 0.5, clamped to the
volume. Each source voxel computes the targets it contributes to, so resampling
is a projection plus, for interpolation, one aggregation. That aggregation runs
where the voxels of a target slice meet: source voxels are shuffled, not their
contributions, over as many tasks as the contributions need. Old and new shapes
are given for all volumes, or by geometry tables with the shapes of each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.geometry import SHAPE, SIZES, Dims, placed
from voxloom.support import ZYX, attach, materialize, spread, tasks_for

ANISOTROPY_LIMIT = 3.0
#: New axis sizes, as they travel with the voxels.
TARGET = ("_nz", "_ny", "_nx")
#: Contributions one task of an interpolation aggregates.
TASK_ROWS = 2_000_000


def new_shape(shape: Column, spacing: Column, target: Column) -> Column:
    """round(old / new * shape) per axis, halves to even."""
    return F.transform(shape, lambda n, i: F.rint(F.get(spacing, i) / F.get(target, i) * n).cast("int"))


def separate_axis(spacing: Column, target: Column, limit: float = ANISOTROPY_LIMIT) -> Column:
    """Index of the single low-resolution axis to resample apart, else NULL.

    The original spacing decides first, then the target spacing.
    """
    def lowres(s: Column) -> Column:
        top = F.array_max(s)
        ties = F.size(F.filter(s, lambda v: v == top))
        return F.when(ties == 1, F.array_position(s, top).cast("int") - 1)

    def anisotropic(s: Column) -> Column:
        return F.array_max(s) / F.array_min(s) > limit
    return F.when(anisotropic(spacing), lowres(spacing)).when(anisotropic(target), lowres(target))


Size = int | Column


def _column(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _source(i: Column, old: Size, new: Size) -> Column:
    c = (i + F.lit(0.5)) * _column(old / new) - F.lit(0.5)
    return F.least(F.greatest(c, F.lit(0.0)), _column(old - 1).cast("double"))


def _candidates(s: Column, old: Size, new: Size) -> Column:
    # targets whose clamped coordinate can lie within one step of source s
    ratio = new / old
    low = F.when(s == 0, F.lit(0)).otherwise(F.floor((s - 1) * ratio).cast("int") - 1)
    high = F.when(s == old - 1, _column(new - 1)).otherwise(F.ceil((s + 2) * ratio).cast("int") + 1)
    return F.sequence(F.greatest(low, F.lit(0)), F.least(high, _column(new - 1)))


def nearest_targets(axis: str, old: Size, new: Size) -> Column:
    s = F.col(axis)
    return F.filter(_candidates(s, old, new), lambda i: F.rint(_source(i, old, new)) == s)


def _linear_table(old: int, new: int) -> Column:
    """Targets and weights of every source index of one axis, as one literal."""
    targets: list[list[str]] = [[] for _ in range(old)]
    for i in range(new):
        c = min(max((i + 0.5) * (old / new) - 0.5, 0.0), float(old - 1))
        for s in range(max(int(c) - 1, 0), min(int(c) + 3, old)):
            if 1 - abs(c - s) > 0:
                targets[s].append(f"named_struct('i', {i}, 'w', {1 - abs(c - s)!r}D)")
    # a column of its own type, also where no source or not every one has a target
    rows = ", ".join(f"cast(array({', '.join(t)}) as array<struct<i:int,w:double>>)" for t in targets)
    return F.expr(f"array({rows})")


def linear_targets(axis: str, old: Size, new: Size) -> Column:
    s = F.col(axis)
    if not isinstance(old, Column) and not isinstance(new, Column):
        # numbers: looked up, where sizes that differ by volume are computed row by row
        return F.get(_linear_table(old, new), s)
    weighted = F.transform(_candidates(s, old, new), lambda i: F.struct(
        i.alias("i"), (1 - F.abs(_source(i, old, new) - s)).alias("w")))
    return F.filter(weighted, lambda t: t["w"] > 0)


def with_target(voxels: DataFrame, keys: Sequence[str], old: Dims, new: Dims) -> DataFrame:
    """Placed voxels with the new sizes of their volume in ``TARGET``; a volume without one is an error."""
    out = placed(voxels, keys, old)
    if not isinstance(new, DataFrame):
        return out.withColumns({c: F.lit(int(n)) for c, n in zip(TARGET, new)})
    on = [k for k in keys if k in new.columns]
    out = attach(out, new.select(*on, *[F.col(a).cast("int").alias(b) for a, b in zip(SIZES, TARGET)]), on, "left")
    missing = F.raise_error(F.lit("a volume has no new shape")).cast("int")
    return out.withColumn(TARGET[0], F.coalesce(TARGET[0], missing))


def _sized(voxels: DataFrame, keys: Sequence[str], old: Dims, new: Dims) -> tuple[DataFrame, list[tuple[str, Size, Size]]]:
    """Voxels and (axis, old size, new size) of the axes that change, as numbers or as columns of the voxels."""
    if not isinstance(old, DataFrame) and not isinstance(new, DataFrame):
        return voxels, [(axis, int(a), int(b)) for axis, a, b in zip(ZYX, old, new) if a != b]
    return with_target(voxels, keys, old, new), [(axis, F.col(a), F.col(b)) for axis, a, b in zip(ZYX, SHAPE, TARGET)]


def resample_nearest(voxels: DataFrame, old: Dims, new: Dims, keys: Sequence[str] = ()) -> DataFrame:
    """Each new voxel takes the nearest old one. Geometry tables are joined on their columns among ``keys``."""
    out, axes = _sized(voxels, keys, old, new)
    for axis, a, b in axes:
        out = out.withColumn(axis, F.explode(nearest_targets(axis, a, b)))
    return out.select(*voxels.columns)


def _spread(voxels: DataFrame, keys: Sequence[str], old: Dims, new: Dims, within: Sequence[str] | None = None) -> DataFrame:
    """Each voxel once per target it contributes to, with its weight ``_w``.

    The rows are partitioned by ``within`` (the keys) and z, so grouping by these and more needs no further shuffle.
    """
    out, axes = _sized(voxels.withColumn("_w", F.lit(1.0)), keys, old, new)
    out = materialize(out)
    shares = F.lit(1.0)
    for _, a, b in axes:
        # about two targets' worth of contributions per old voxel and new one
        shares = shares * F.greatest(F.lit(1.0), _column(b).cast("double") * 2 / _column(a))
    total = out.agg(F.sum(shares)).first()[0] or 0.0
    meet = [*(keys if within is None else within), "z"]
    parts = tasks_for(voxels.sparkSession, total, TASK_ROWS)

    def to_targets(rows: DataFrame, axis: str, a: Size, b: Size) -> DataFrame:
        return (rows.withColumn("_t", F.explode(linear_targets(axis, a, b)))
                .withColumns({axis: F.col("_t.i"), "_w": F.col("_w") * F.col("_t.w")}).drop("_t"))
    for axis, a, b in axes:
        if axis == "z":
            out = to_targets(out, axis, a, b)
    out = out.repartition(parts, *meet)
    for axis, a, b in axes:
        if axis != "z":
            out = to_targets(out, axis, a, b)
    return out


def resample_linear(voxels: DataFrame, keys: Sequence[str], value: str, old: Dims, new: Dims,
                    within: Sequence[str] | None = None) -> DataFrame:
    """Linear interpolation of the zero-background volume; zero results are absent.

    The result is partitioned by ``within``, some or all of the keys, and z: a later grouping by them and the position
    needs no shuffle.
    """
    return (_spread(voxels, keys, old, new, within).groupBy(*keys, *ZYX)
            .agg(F.sum(F.col(value) * F.col("_w")).alias(value)).where(F.col(value) != 0))


def resample_labels(voxels: DataFrame, keys: Sequence[str], label: str, old: Dims, new: Dims,
                    first_wins: bool = False) -> DataFrame:
    """Linear interpolation of each label's indicator, kept from one half on.

    On overlap the later label wins, or the first one for slice upsampling.
    """
    cover = (_spread(voxels.where(F.col(label) > 0), keys, old, new).groupBy(*keys, *ZYX, label)
             .agg(F.round(F.sum("_w"), 9).alias("_c")).where(F.col("_c") >= 0.5))
    pick = F.min if first_wins else F.max
    return cover.groupBy(*keys, *ZYX).agg(pick(label).alias(label))


def cubic_lines(lines: np.ndarray, new: int, margin: int = 12) -> np.ndarray:
    """Cubic spline interpolation with repeated edges along the first axis of (old, m) values.

    The lines are padded, the spline coefficients come from the two-pass
    recursive filter with mirrored ends, and four B-spline taps are summed at
    each new centre: time and memory grow with the length of the lines.
    """
    old = len(lines)
    pole = np.sqrt(3.0) - 2.0
    coefficient = np.pad(lines, ((margin, margin), (0, 0)), mode="edge") * (1 - pole) * (1 - 1 / pole)
    n = len(coefficient)
    powers = pole ** np.arange(n)
    mirror = powers + np.where(np.arange(n) > 0, pole ** (2 * n - 2 - np.arange(n)), 0.0)
    mirror[-1] = pole ** (n - 1)
    coefficient[0] = mirror @ coefficient / (1 - pole ** (2 * n - 2))
    for i in range(1, n):
        coefficient[i] += pole * coefficient[i - 1]
    coefficient[-1] = pole / (pole * pole - 1) * (coefficient[-1] + pole * coefficient[-2])
    for i in range(n - 2, -1, -1):
        coefficient[i] = pole * (coefficient[i + 1] - coefficient[i])
    at = (np.arange(new) + 0.5) * old / new - 0.5 + margin
    first = np.floor(at).astype(int) - 1
    out = np.zeros((new, lines.shape[1]))
    for k in range(4):
        d = np.abs(at - (first + k))
        weight = np.where(d < 1, 2 / 3 - d * d * (2 - d) / 2, np.maximum(2 - d, 0) ** 3 / 6)
        out += weight[:, None] * coefficient[np.clip(first + k, 0, n - 1)]
    return out


def resample_cubic(voxels: DataFrame, keys: Sequence[str], value: str, old: Dims, new: Dims,
                   bundle: Sequence[int] = (8, 64)) -> DataFrame:
    """Cubic spline resampling, clipped to the value range of each case.

    One pass per axis. A task filters a bundle of lines along that axis, at
    most bundle[0] x bundle[1] of them; values below 1e-12 are dropped.
    """
    keys = list(keys)
    # absent voxels are 0 and belong to the range
    limits = voxels.groupBy(*keys).agg(F.least(F.min(value), F.lit(0)).alias("_lo"), F.greatest(F.max(value), F.lit(0)).alias("_hi"))
    rows = with_target(voxels.select(*keys, *ZYX, F.col(value).cast("double").alias("_v")), keys, old, new)
    inner = [*keys, *SHAPE, *TARGET]
    rows = rows.select(*inner, *ZYX, "_v")
    schema = T.StructType(rows.schema.fields)
    fixed = not isinstance(old, DataFrame) and not isinstance(new, DataFrame)
    for axis in range(3):
        if fixed and old[axis] == new[axis]:
            continue
        rest = [x for x in ZYX if x != ZYX[axis]]
        blocks = {f"_b{i}": F.floor(F.col(c) / s).cast("int") for i, (c, s) in enumerate(zip(rest, bundle))}
        rows = spread(rows.withColumns(blocks), *keys, "_b0", "_b1").groupBy(*inner, "_b0", "_b1").applyInPandas(
            _line_resampler(inner, axis, rest, tuple(bundle)), schema)
    clipped = F.least(F.greatest(F.col("_v"), F.col("_lo")), F.col("_hi"))
    return (attach(rows, limits, keys).withColumn(value, clipped).where(F.abs(value) > 1e-12)
            .select(*keys, *ZYX, value))


def _line_resampler(keys, axis, rest, bundle):
    name = ZYX[axis]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        old, new = int(pdf[SHAPE[axis]].iloc[0]), int(pdf[TARGET[axis]].iloc[0])
        if old == new:
            return pdf[[*keys, *ZYX, "_v"]]
        corner = [int(pdf[f"_b{i}"].iloc[0]) * bundle[i] for i in range(2)]
        grid = np.zeros((old, *bundle))
        grid[pdf[name], pdf[rest[0]] - corner[0], pdf[rest[1]] - corner[1]] = pdf["_v"]
        done = cubic_lines(grid.reshape(old, -1), new).reshape(new, *bundle)
        points = np.argwhere(np.abs(done) > 1e-12)
        place = {name: points[:, 0], rest[0]: points[:, 1] + corner[0], rest[1]: points[:, 2] + corner[1]}
        out = {k: np.repeat(pdf[k].iloc[:1].to_numpy(), len(points)) for k in keys}
        out.update({a: place[a].astype(np.int32) for a in ZYX})
        out["_v"] = done[tuple(points.T)]
        return pd.DataFrame(out)
    return run


def average_pool(voxels: DataFrame, keys: Sequence[str], label: str, factors: Sequence[int], dims: Dims) -> DataFrame:
    """Share of each label per pooling window; background shares are left implicit.

    Windows of ``factors`` cells start (f - 1) // 2 cells before the edge of
    the volume of shape ``dims``.  Cells outside it are not counted, and a
    window that does not fit the padded axis is left out.
    """
    pads = [(f - 1) // 2 for f in factors]
    window = [F.floor((F.col(a) + p) / f).cast("int").alias(a) for a, f, p in zip(ZYX, factors, pads)]
    cells, fits = F.lit(1), F.lit(True)
    for a, f, p, size in zip(ZYX, factors, pads, map(F.col, SHAPE)):
        start = F.col(a) * f - p
        cells = cells * (F.least(start + f, size) - F.greatest(start, F.lit(0)))
        fits = fits & (F.col(a) < F.floor((size + (2 * p - f)) / f) + 1)
    return (placed(voxels, keys, dims).groupBy(*keys, *SHAPE, *window, label).agg(F.count("*").alias("_n")).where(fits)
            .withColumn("share", F.round(F.col("_n") / cells.cast("double"), 6)).drop("_n", *SHAPE))


def pad_to_multiple(size: Column, multiple: Column) -> Column:
    return (F.ceil(size / multiple) * multiple).cast("int")


def pool_count(patch: Column, minimum: int = 4) -> Column:
    """How often an axis can be halved before it falls below the minimum.

    Counted in integers, so powers of two do not depend on log rounding.
    """
    halvings = F.filter(F.sequence(F.lit(1), F.lit(31)),
                        lambda k: F.pow(F.lit(2.0), k.cast("double")) * minimum <= patch)
    return F.size(halvings)


def rotated_extent(patch: Sequence[Column], angles: Sequence[float], scale: float) -> list[Column]:
    """Patch size that still covers the final patch after rotation and zoom.

    The extent is the largest over the rotations about the three axes taken one
    at a time, each limited to a right angle.
    """
    a, b, c = patch
    turn = [min(abs(t), 1.5707963267948966) for t in angles]
    sin, cos = [F.sin(F.lit(t)) for t in turn], [F.cos(F.lit(t)) for t in turn]
    turned = [
        (a, b * cos[0] + c * sin[0], c * cos[0] - b * sin[0]),
        (a * cos[1] - c * sin[1], b, a * sin[1] + c * cos[1]),
        (a * cos[2] + b * sin[2], b * cos[2] - a * sin[2], c)]
    return [F.floor(F.greatest(size.cast("double"), *[F.abs(t[i]).cast("double") for t in turned]) / scale).cast("int")
            for i, size in enumerate(patch)]
