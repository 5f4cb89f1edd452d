"""Shape of connected blobs and their place among the organs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.support import ZYX, materialize


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Euclidean distance of two points given as columns per axis."""
    square = F.lit(0.0)
    for p, q in zip(a, b):
        square = square + (p - q).cast("double") * (p - q)
    return F.sqrt(square)


def _far(square: Column) -> Column:
    # farthest point, the first in C order on ties
    place = F.struct(*[(-F.col(a)).alias(a) for a in ZYX])
    return F.max(F.struct(square.alias("d"), place.alias("p")))


def _square(point: str, sign: int = 1) -> Column:
    out = F.lit(0).cast("long")
    for a in ZYX:
        step = (F.col(a) - sign * F.col(f"{point}.{a}")).cast("long")
        out = out + step * step
    return out


def characterize(labelled: DataFrame, keys: Sequence[str], blob: str = "component") -> DataFrame:
    """Offset, box, volume, rounded centre, two-pass extent and stringness.

    The extent is the distance from the point farthest from the centre to the
    point farthest from it. Three aggregations with partial maxima; the per-blob
    tables are joined back by blob.
    """
    group = [*keys, blob]
    labelled = materialize(labelled.select(*group, *ZYX))
    base = labelled.groupBy(*group).agg(
        F.count("*").alias("volume"),
        *[f for a in ZYX for f in (F.min(a).alias(f"o{a}"), (F.max(a) - F.min(a) + 1).alias(f"b{a}"),
                                   F.sum(F.col(a).cast("long")).alias(f"_s{a}"))])
    # sum of relative coordinates is exact, so the mean rounds half to even exactly
    base = base.withColumns({f"c{a}": F.rint((F.col(f"_s{a}") - F.col(f"o{a}") * F.col("volume")) / F.col("volume"))
                            .cast("int") for a in ZYX}).drop(*[f"_s{a}" for a in ZYX])
    centre = base.select(*group, F.struct(*[(F.col(f"o{a}") + F.col(f"c{a}")).alias(a) for a in ZYX]).alias("_c"))
    first = (labelled.join(centre, group).groupBy(*group).agg(_far(_square("_c")).alias("_f"))
             .select(*group, F.col("_f.p").alias("_p")))
    second = (labelled.join(first, group).groupBy(*group)
              .agg(F.max(_square("_p", -1)).alias("_d")))
    ball = 2 * F.pow(F.col("volume") / F.lit(4 / 3 * math.pi), F.lit(1 / 3))
    string = F.least(F.greatest(1 - ball / F.col("max_dist"), F.lit(0.0)), F.lit(1.0)) * 100
    return (base.join(second, group).withColumn("max_dist", F.sqrt(F.col("_d").cast("double"))).drop("_d")
            .withColumn("stringness", F.round(F.when(F.col("volume") > 1, string), 6))
            .withColumn("max_dist", F.round("max_dist", 6)))


def select_blobs(blobs: DataFrame, min_volume: int, max_stringness: float) -> DataFrame:
    """Drop small and elongated blobs; the limits have no defaults."""
    round_enough = F.col("stringness").isNull() | (F.col("stringness") <= max_stringness)
    return blobs.where((F.col("volume") >= min_volume) & round_enough)


def size_class(volume: Column, edges: Sequence[int]) -> Column:
    """0 below the first edge, 1 below the second, and so on."""
    out = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        out = F.when(volume < edge, F.lit(i)).otherwise(out)
    return out


def blobs_by_region(blobs: DataFrame, regions: DataFrame, keys: Sequence[str], region: str, edges: Sequence[int],
                    ) -> DataFrame:
    """Blobs and blob volume per region and size class; the region is the label
    at the blob centre, 0 where there is none."""
    centre = {a: (F.col(f"o{a}") + F.col(f"c{a}")).cast("int") for a in ZYX}
    placed = (blobs.withColumns(centre)
              .join(regions.select(*keys, *ZYX, F.col(region).alias("_r")), [*keys, *ZYX], "left"))
    return (placed.groupBy(*keys, F.coalesce("_r", F.lit(0)).alias(region),
                           size_class(F.col("volume"), edges).alias("size_class"))
            .agg(F.count("*").alias("blobs"), F.sum("volume").alias("voxels")))
