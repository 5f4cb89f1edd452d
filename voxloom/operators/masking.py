"""Boxes, masks and coordinate moves on sparse voxel tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.support import ZYX, attach


def box_slice(voxels: DataFrame, lower: Sequence[int], upper: Sequence[int]) -> DataFrame:
    """Voxels with lower <= (z, y, x) < upper; the bounds reach the file scan."""
    keep = F.lit(True)
    for axis, lo, hi in zip(ZYX, lower, upper):
        keep = keep & (F.col(axis) >= lo) & (F.col(axis) < hi)
    return voxels.where(keep)


def bounding_box(voxels: DataFrame, keys: Sequence[str], inside: Column) -> DataFrame:
    """Half-open box of the voxels where ``inside`` holds: z0,z1,y0,y1,x0,x1."""
    return voxels.where(inside).groupBy(*keys).agg(*[
        f for axis in ZYX for f in (F.min(axis).alias(axis + "0"), (F.max(axis) + 1).alias(axis + "1"))])


def within_box(axes: Sequence[str] = ZYX) -> Column:
    keep = F.lit(True)
    for axis in axes:
        keep = keep & (F.col(axis) >= F.col(axis + "0")) & (F.col(axis) < F.col(axis + "1"))
    return keep


def crop_to_box(voxels: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep voxels inside their case's box and move the origin to its corner; a case without a box stays whole."""
    joined = attach(voxels, boxes, keys, "left").where(F.col("z0").isNull() | within_box())
    moved = {a: (F.col(a) - F.coalesce(a + "0", F.lit(0))).cast("int") for a in ZYX}
    return joined.withColumns(moved).select(*voxels.columns)


def uncrop(voxels: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put cropped voxels back at their place in the zero canvas; a case without a box was not moved."""
    moved = {a: (F.col(a) + F.coalesce(a + "0", F.lit(0))).cast("int") for a in ZYX}
    return attach(voxels, boxes, keys, "left").withColumns(moved).select(*voxels.columns)


def mark_outside(seg: Column, nonzero: Column, code: int = -1) -> Column:
    """Background outside the nonzero mask gets its own code."""
    return F.when((seg == 0) & ~nonzero, F.lit(code)).otherwise(seg)


def grow_box(boxes: DataFrame, spacing: Sequence[float], distance: float, dims: Sequence[int]) -> DataFrame:
    """Widen a closed box by ceil(distance / spacing) voxels, at least one.

    The upper bound is the last occupied index plus the extension and is used
    as an exclusive bound.
    """
    grown = {}
    for axis, step, size in zip(ZYX, spacing, dims):
        extend = max(math.ceil(distance / step), 1)
        grown[axis + "0"] = F.greatest(F.lit(0), F.col(axis + "0") - extend).cast("int")
        grown[axis + "1"] = F.least(F.lit(size), F.col(axis + "1") - 1 + extend).cast("int")
    return boxes.withColumns(grown)


def keep_in_box(voxels: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attach(voxels, boxes, keys).where(within_box()).select(*voxels.columns)


def mask_out(voxels: DataFrame, masks: DataFrame, on: Sequence[str], value: str, label: str) -> DataFrame:
    """Zero the value where the mask carries a label; other rows stay as they are."""
    joined = voxels.join(masks.select(*on, F.col(label).alias("_label")), list(on), "left")
    covered = F.coalesce(F.col("_label") > 0, F.lit(False))
    return joined.withColumn(value, F.when(covered, F.lit(0)).otherwise(F.col(value))).drop("_label")


def stride_downsample(voxels: DataFrame, factors: Sequence[int], dims: Sequence[int]) -> DataFrame:
    """Every f-th slice; in-plane nearest index onto a grid of ``dim // f``.

    Target row i reads source floor(i * dim / (dim // f)), the nearest rule of
    image resizing with a truncated index.
    """
    out = voxels.where(F.col("z") % factors[0] == 0).withColumn("z", (F.expr(f"z div {factors[0]}")).cast("int"))
    for axis, factor, size in zip(ZYX[1:], factors[1:], dims[1:]):
        target = size // factor
        if target == size:
            continue
        # the only target row that can read source row s, kept if it really does
        out = (out.withColumn("_t", F.expr(f"({axis} * {target}L + {size - 1}) div {size}"))
               .where((F.col("_t") < target) & (F.expr(f"(_t * {size}) div {target}") == F.col(axis)))
               .withColumn(axis, F.col("_t").cast("int")).drop("_t"))
    return out


def flip(axis: str, size: int) -> Column:
    return (F.lit(size - 1) - F.col(axis)).cast("int")


def reorient(voxels: DataFrame, order: Sequence[str], flips: Mapping[str, int]) -> DataFrame:
    """Swap axes (new z,y,x read from ``order``) and reverse the named source axes."""
    source = {a: (flip(a, flips[a]) if a in flips else F.col(a)) for a in ZYX}
    return voxels.withColumns({new: source[old] for new, old in zip(ZYX, order)})


def split_channels(df: DataFrame, values: str, keys: Sequence[str]) -> DataFrame:
    """One row per channel of an array column, in channel order."""
    return df.select(*keys, F.posexplode(values).alias("channel", "value"))


def fold_slices(channel: Column, z: Column, depth: int) -> Column:
    return channel * depth + z


def unfold_slices(folded: Column, depth: int) -> tuple[Column, Column]:
    return F.floor(folded / depth), folded % depth


def zero_nan(value: Column) -> Column:
    return F.nanvl(value.cast("double"), F.lit(0.0))


def fill_from_sampled_slices(slices: DataFrame, sampled: DataFrame, keys: Sequence[str], factor: int,
                             z: str = "z") -> DataFrame:
    """Point every slice at the sampled slice that replaces it.

    A remainder up to factor // 2 takes the slice below, otherwise the next one,
    and the last sampled slice of the stack when the next one is missing.
    """
    below = F.col(z) - F.col(z) % factor
    wanted = F.when(F.col(z) % factor <= factor // 2, below).otherwise(below + factor)
    last = sampled.groupBy(*keys).agg(F.max(z).alias("_last"))
    have = sampled.select(*keys, F.col(z).alias("_wanted"), F.lit(True).alias("_have"))
    found = slices.withColumn("_wanted", wanted).join(have, [*keys, "_wanted"], "left")
    return (attach(found, last, keys, "left")
            .withColumn("source_z", F.when(F.col("_have"), F.col("_wanted")).otherwise(F.col("_last")))
            .drop("_wanted", "_have", "_last"))


def mask_by_channel(value: Column, mask: Column, constant: float = 0.0) -> Column:
    """Constant where the mask channel is negative (outside the image)."""
    return F.when(mask < 0, F.lit(constant)).otherwise(value)
