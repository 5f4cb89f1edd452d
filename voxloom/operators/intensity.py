"""Intensity statistics and normalization.

Percentiles are exact and taken over value counts, whose number is bounded by
the value range of the image (65,536 for 16-bit slices), not by its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.ranking import rank_in_buckets
from voxloom.support import attach, div0

STATS = ("median", "mean", "sd", "min", "max", "p99_5", "p0_5")


def every_nth(voxels: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Every n-th row of a case in (z, y, x) order, starting with the first."""
    ranked = rank_in_buckets(voxels, keys, [("z", F.col("z")), ("y", F.col("y"))], ["x"], "_rank")
    return ranked.where(F.col("_rank") % n == 0).drop("_rank")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))


def _summary() -> list[Column]:
    n, total = F.sum("n"), F.sum(F.col("v") * F.col("n"))
    square = F.sum((F.col("v") * F.col("v")).cast("double") * F.col("n"))
    mean = div0(total, n)
    pct = lambda p: F.expr(f"percentile(v, {p}D, n)")
    values = {"median": pct(0.5), "mean": mean,
              "sd": F.sqrt(F.greatest(div0(square, n) - mean * mean, F.lit(0.0))),
              "min": F.min("v").cast("double"), "max": F.max("v").cast("double"),
              "p99_5": pct(0.995), "p0_5": pct(0.005)}
    return [F.round(values[s], 6).alias(s) for s in STATS]


def fingerprint(voxels: DataFrame, case: str, modality: str, value: str, foreground: Column, stride: int = 10,
                ) -> DataFrame:
    """Foreground statistics per (case, modality) and pooled per modality.

    The pooled rows carry a NULL case. A case without foreground keeps a row of
    undefined statistics.
    """
    sampled = every_nth(voxels.where(foreground), [case, modality], stride)
    counts = value_counts(sampled, [case, modality], value)
    stats = counts.groupingSets([[case, modality], [modality]], case, modality).agg(
        F.grouping_id().alias("_pooled"), *_summary())
    cases = voxels.select(case, modality).distinct()
    per_case = cases.join(stats.where(F.col("_pooled") == 0).drop("_pooled"), [case, modality], "left")
    return per_case.unionByName(stats.where(F.col("_pooled") != 0).drop("_pooled"))


def envelope(slices: DataFrame, keys: Sequence[str], z: str, value: str, percent: float) -> DataFrame:
    """Lowest low and highest high percentile of the nonzero values over the slices.

    This follows the slice-by-slice rule and is not the percentile of the stack.
    """
    counts = value_counts(slices.where(F.col(value) != 0), [*keys, z], value)
    per_slice = counts.groupBy(*keys, z).agg(
        F.expr(f"percentile(v, {percent / 100}D, n)").alias("lo"),
        F.expr(f"percentile(v, {(100 - percent) / 100}D, n)").alias("hi"))
    return per_slice.groupBy(*keys).agg(
        F.round(F.least(F.lit(65535.0), F.min("lo")), 6).alias("low"),
        F.round(F.greatest(F.lit(0.0), F.max("hi")), 6).alias("high"))


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def normalize_ct(voxels: DataFrame, dataset_stats: DataFrame, keys: Sequence[str], value: str,
                 staged: bool = False) -> DataFrame:
    """Clip to the dataset percentiles, then dataset mean and deviation; NULL where the dataset has none."""
    x = clip(F.col(value), F.col("p0_5"), F.col("p99_5"))
    return (attach(voxels, dataset_stats.select(*keys, "p0_5", "p99_5", "mean", "sd"), keys, "left", staged)
            .withColumn("normalized", F.round(div0(x - F.col("mean"), F.col("sd")), 6))
            .drop("p0_5", "p99_5", "mean", "sd"))


def normalize_ct2(voxels: DataFrame, bounds: DataFrame, bound_keys: Sequence[str], case_keys: Sequence[str],
                  value: str, staged: bool = False) -> DataFrame:
    """Clip to the dataset percentiles, then the case's own mean and deviation
    over the values strictly between them."""
    bounded = attach(voxels, bounds.select(*bound_keys, "p0_5", "p99_5"), bound_keys, "left", staged)
    inner = F.when((F.col(value) > F.col("p0_5")) & (F.col(value) < F.col("p99_5")), F.col(value))
    stats = bounded.groupBy(*case_keys).agg(F.avg(inner).alias("_m"), F.stddev_pop(inner).alias("_s"))
    x = clip(F.col(value), F.col("p0_5"), F.col("p99_5"))
    return (attach(bounded, stats, case_keys).withColumn("normalized", F.round(div0(x - F.col("_m"), F.col("_s")), 6))
            .drop("p0_5", "p99_5", "_m", "_s"))


def normalize_z(voxels: DataFrame, keys: Sequence[str], value: str, inside: Column | None = None) -> DataFrame:
    """(x - mean) / (sd + 1e-8) per case; with a mask, over it, and 0 outside."""
    used = F.lit(True) if inside is None else inside
    picked = F.when(used, F.col(value))
    stats = voxels.groupBy(*keys).agg(F.avg(picked).alias("_m"), F.stddev_pop(picked).alias("_s"))
    scaled = (F.col(value) - F.col("_m")) / (F.col("_s") + 1e-8)
    return (attach(voxels, stats, keys).withColumn("normalized", F.round(F.when(used, scaled).otherwise(0.0), 6))
            .drop("_m", "_s"))


def rgb_scale(value: Column) -> Column:
    return value / F.lit(255.0)


def normalization_scheme(modality: Column) -> Column:
    return (F.when(F.lower(modality) == "ct", "CT").when(F.lower(modality) == "nonorm", "noNorm")
            .when(F.lower(modality) == "ct2", "CT2").otherwise("nonCT"))


def crop_ratio(boxes: DataFrame, cells: int) -> DataFrame:
    inside = ((F.col("z1") - F.col("z0")) * (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))
    return boxes.withColumn("ratio", F.round(inside / F.lit(float(cells)), 6))


def use_mask_for_norm(ratios: DataFrame, limit: float = 0.75) -> DataFrame:
    """Normalize inside the mask only if cropping typically removes a quarter."""
    return ratios.agg(F.round(F.median("ratio"), 6).alias("median_ratio")).withColumn(
        "use_mask", F.col("median_ratio") < limit)


def target_spacing(cases: DataFrame, keys: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Median spacing per axis; a coarse axis with few slices takes its 10th
    percentile, kept just above the other axes.

    ``cases`` holds arrays spacing and size, one row per case.
    """
    pick = lambda name, p: F.array(*[F.expr(f"percentile({name}[{i}], {p}D)") for i in range(3)])
    stats = cases.groupBy(*keys).agg(pick("spacing", 0.5).alias("t"), pick("size", 0.5).alias("s"),
                                     pick("spacing", 0.1).alias("low"))
    worst = F.array_position("t", F.array_max("t")).cast("int") - 1
    stats = stats.withColumn("w", worst)
    others = lambda name: F.filter(F.col(name), lambda _, i: i != F.col("w"))
    coarse = F.get("t", F.col("w")) > threshold * F.array_max(others("t"))
    few = F.get("s", F.col("w")) * threshold < F.array_min(others("s"))
    low, rest = F.get("low", F.col("w")), F.array_max(others("t"))
    refined = F.when(low < rest, rest + 1e-5).otherwise(low)
    final = F.when(coarse & few, F.transform("t", lambda v, i: F.when(i == F.col("w"), refined).otherwise(v))).otherwise(F.col("t"))
    return stats.withColumn("f", final).select(
        *keys, *[F.round(F.get("f", F.lit(i)), 6).alias(f"spacing_{a}") for i, a in enumerate("zyx")])
