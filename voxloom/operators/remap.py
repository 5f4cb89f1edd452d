"""Label and intensity rewriting. Every rewrite is one simultaneous lookup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.support import attach, literal_map, materialize

# Organ codes 12 and 13 join 11, later codes move down by two.
ORGAN_MERGE = {12: 11, 13: 11, **{code: code - 2 for code in range(14, 23)}}
# Competition label order, read and written simultaneously.
TUMOUR_ORDER = {1: 2, 2: 1, 3: 4}
# Grey ranges (low, high] of the MR organ masks and their codes.
MR_RANGES = ((55, 70, 1), (110, 135, 2), (175, 200, 3), (240, 255, 4))
# Grey value written for each organ code.
MR_GREYS = {1: 63, 2: 126, 3: 189, 4: 252}
CT_GREYS = {1: 63}


def map_labels(label: Column, mapping: Mapping[int, int], other: Column | int | None = None) -> Column:
    """Look ``label`` up; codes outside the map keep their value or become ``other``."""
    fallback = label if other is None else (F.lit(other) if not isinstance(other, Column) else other)
    return F.coalesce(literal_map(dict(mapping))[label], fallback)


def bin_labels(value: Column, ranges: Sequence[tuple[int, int, int]]) -> Column:
    """Code of the half-open range (low, high] that holds ``value``; 0 outside."""
    out = F.lit(0)
    for low, high, code in reversed(ranges):
        out = F.when((value > low) & (value <= high), F.lit(code)).otherwise(out)
    return out


def replace_label(label: Column, old: int, new: int = 0) -> Column:
    return F.when(label == old, F.lit(new)).otherwise(label)


def one_hot(df: DataFrame, labels: Sequence[int], label: str = "label", prefix: str = "is_") -> DataFrame:
    return df.select("*", *[(F.col(label) == c).cast("int").alias(f"{prefix}{c}") for c in labels])


def classes_of_instances(voxels: DataFrame, metadata: DataFrame, keys: Sequence[str],
                         instance: str, order: str, ignore_code: int = 5) -> DataFrame:
    """Give each instance voxel the class of its metadata entry.

    ``metadata`` holds keys, instance, class_label and an entry order; a repeated
    instance takes its last entry, an unknown one 0 and class -1 ``ignore_code``.
    """
    last = metadata.groupBy(*keys, instance).agg(F.max_by("class_label", order).alias("class_label"))
    known = F.coalesce("class_label", F.lit(0))
    return (attach(voxels, last, [*keys, instance], "left")
            .withColumn("class_label", F.when(known == -1, ignore_code).otherwise(known)))


def region_indicator(label: Column, codes: Sequence[int]) -> Column:
    return label.isin(list(codes))


def replace_small_class(voxels: DataFrame, keys: Sequence[str], label: str, code: int,
                        minimum: int, replace_with: int) -> DataFrame:
    """Rewrite ``code`` where a case holds fewer than ``minimum`` voxels of it."""
    counts = (voxels.groupBy(*keys).agg(F.count(F.when(F.col(label) == code, 1)).alias("_n"))
              .where(F.col("_n") < minimum).select(*keys, F.lit(True).alias("_small")))
    hit = F.coalesce("_small", F.lit(False)) & (F.col(label) == code)
    return (attach(voxels, counts, keys, "left")
            .withColumn(label, F.when(hit, F.lit(replace_with)).otherwise(F.col(label))).drop("_small"))


def sample_class_locations(voxels: DataFrame, keys: Sequence[str], label: str, seed: int,
                           floor: int = 10000, share: float = 0.01) -> DataFrame:
    """Seeded sample per class of max(min(floor, n), ceil(share n)) voxels.

    A voxel is taken when its seeded key is among the smallest. The key is plain
    arithmetic modulo 2**31 - 1 on the position. Its range
    is cut into buckets, only bucket counts are ranked, and the one bucket that
    straddles the quota is ordered, so no task holds a whole class.
    """
    group = [*keys, label]
    prime = (1 << 31) - 1
    place = (F.col("z").cast("long") * 73_856_093 + F.col("y").cast("long") * 19_349_663
             + F.col("x").cast("long") * 83_492_791 + seed) % prime
    # squaring breaks up the lattice of the linear part
    hashed = (voxels.withColumn("_h", place)
              .withColumn("_h", (F.col("_h") * F.col("_h") % prime * 48_271 + F.col("_h")) % prime)
              .withColumn("_b", F.shiftright("_h", 15)))
    sizes = hashed.groupBy(*group, "_b").agg(F.count("*").alias("_c"))
    total = W.partitionBy(*group)
    before = total.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    n = F.sum("_c").over(total)
    plan = sizes.select(
        *group, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), "_c",
        F.greatest(F.least(F.lit(floor), n), F.ceil(n * share)).alias("_quota"))
    plan = plan.where(F.col("_before") < F.col("_quota"))
    picked = hashed.join(materialize(plan), [*group, "_b"])
    whole = F.col("_before") + F.col("_c") <= F.col("_quota")
    inside = W.partitionBy(*group, "_b").orderBy("_h", "z", "y", "x")
    edge = (picked.where(~whole).withColumn("_r", F.row_number().over(inside))
            .where(F.col("_before") + F.col("_r") <= F.col("_quota")))
    columns = voxels.columns
    return picked.where(whole).select(*columns).unionByName(edge.select(*columns))
