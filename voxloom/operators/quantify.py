"""Counts and projections over voxel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.support import ZYX, attach, div0


def overlap(labels: DataFrame, mask: DataFrame, keys: Sequence[str], label: str = "label",
            value: str = "value") -> DataFrame:
    """Voxels per label and the summed mask values inside it.

    The mask is summed, so a weighted mask contributes its weights. Partial
    aggregation runs before the only shuffle on (keys, label).
    """
    place = [*keys, *ZYX]
    hit = mask.where(F.col(value) != 0).select(*place, F.col(value).alias("_m"))
    return (labels.where(F.col(label) > 0).join(hit, place, "left")
            .groupBy(*keys, label)
            .agg(F.count("*").alias("label_n"),
                 F.coalesce(F.sum("_m"), F.lit(0)).cast("long").alias("nerve_label_n"))
            .withColumn("density", F.round(div0(F.col("nerve_label_n"), F.col("label_n")), 6)))


def to_long(counts: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Wide overlap counts as (keys, name, value) rows, the layout of the report."""
    pairs = F.array(
        F.struct(F.concat(F.lit("label_"), F.col(label).cast("string")).alias("name"),
                 F.col("label_n").alias("value")),
        F.struct(F.concat(F.lit("nerve_label_"), F.col(label).cast("string")).alias("name"),
                 F.col("nerve_label_n").alias("value")))
    return counts.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.name", "p.value")


def label_volume(voxels: DataFrame, keys: Sequence[str], label: str, spacing: Sequence[float]) -> DataFrame:
    unit = spacing[0] * spacing[1] * spacing[2]
    return (voxels.groupBy(*keys, label).agg(F.count("*").alias("voxels"))
            .withColumn("volume", F.round(F.col("voxels") * F.lit(float(unit)), 6)))


def class_slices(voxels: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(keys, label, axis, position, voxels): the slices of each axis that hold a class."""
    axes = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(a).alias("position"))
                               for i, a in enumerate(ZYX)])).alias("s")
    return (voxels.select(*keys, label, axes).groupBy(*keys, label, F.col("s.axis").alias("axis"),
                                                      F.col("s.position").alias("position"))
            .agg(F.count("*").alias("voxels")))


def max_projection(voxels: DataFrame, keys: Sequence[str], value: str, axis: str = "z") -> DataFrame:
    rest = [a for a in ZYX if a != axis]
    return voxels.groupBy(*keys, *rest).agg(F.max(value).alias(value))


def axis_sum(voxels: DataFrame, keys: Sequence[str], value: str, axes: Sequence[str], dims: Sequence[int],
             ) -> DataFrame:
    """Sum and mean over ``axes`` of the dense volume (absent voxels count as 0)."""
    rest = [a for a in ZYX if a not in axes]
    cells = 1
    for a, d in zip(ZYX, dims):
        cells *= d if a in axes else 1
    return (voxels.groupBy(*keys, *rest).agg(F.sum(value).cast("long").alias("total"))
            .withColumn("mean", F.round(F.col("total") / F.lit(float(cells)), 6)))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int, low: float | None = None,
              high: float | None = None) -> DataFrame:
    """Counts in equal bins; the top edge belongs to the last bin.

    Without bounds the bins span the values of each key (one unit around a
    single value).  With bounds, smaller values are counted in bin -1 and larger
    ones in bin ``bins``, so the counts always sum to all rows with a value.
    """
    x = F.col(value).cast("double")
    counts = df.where(x.isNotNull()).groupBy(*keys, x.alias("_x")).agg(F.count("*").alias("_n"))
    if low is None or high is None:
        span = counts.groupBy(*keys).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        half = F.when(F.col("_a") == F.col("_b"), F.lit(0.5)).otherwise(F.lit(0.0))
        counts = attach(counts, span.select(*keys, (F.col("_a") - half).alias("_low"),
                                            (F.col("_b") + half).alias("_high")), keys)
    else:
        counts = counts.withColumns({"_low": F.lit(float(low)), "_high": F.lit(float(high))})
    width = (F.col("_high") - F.col("_low")) / bins
    inside = F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_low")) / width))
    index = (F.when(F.col("_x") < F.col("_low"), F.lit(-1)).when(F.col("_x") > F.col("_high"), F.lit(bins))
             .otherwise(inside).cast("int"))
    return counts.groupBy(*keys, index.alias("bin")).agg(F.sum("_n").alias("n"))


def voxel_difference(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Voxels per case whose codes differ; a voxel absent from one side is 0 there."""
    place = [*keys, *ZYX]
    joined = (left.select(*place, F.col(a).alias("_a")).join(right.select(*place, F.col(b).alias("_b")), place, "full"))
    differs = F.coalesce("_a", F.lit(0)) != F.coalesce("_b", F.lit(0))
    return joined.groupBy(*keys).agg(F.count(F.when(differs, 1)).alias("different"))


def stack_shape(slices: DataFrame, keys: Sequence[str], z: str, height: Column, width: Column) -> DataFrame:
    """[1, 1, z, y, x] of a slice stack as columns."""
    return slices.groupBy(*keys).agg(F.count_distinct(z).alias("depth"), F.max(height).alias("height"),
                                     F.max(width).alias("width"))
