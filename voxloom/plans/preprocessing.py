"""Crop, normalize and resample a set of cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import intensity, masking, resample
from voxloom.operators.geometry import Dims, keep_axis
from voxloom.operators.stencil import fill_holes
from voxloom.support import ZYX, attach, div0, literal_map, materialize


def crop_and_normalize(voxels: DataFrame, keys: Sequence[str], value: str, seg: str, scheme: str,
                       dataset_stats: DataFrame | None = None, modality: str = "modality",
                       staged: bool = False) -> DataFrame:
    """Crop to the nonzero box, mark outside voxels and normalize by scheme.

    The CT schemes take the pooled statistics of the voxel's modality (``staged``:
    already a table of their own, as from ``fingerprint_table``).
    """
    boxes = masking.bounding_box(voxels, keys, F.col(value) != 0)
    cropped = masking.crop_to_box(voxels, boxes, keys)
    cropped = cropped.withColumn(seg, masking.mark_outside(F.col(seg), F.col(value) != 0))
    if scheme == "noNorm":
        return cropped.withColumn("normalized", F.col(value).cast("double"))
    if scheme in ("CT", "CT2"):
        if scheme == "CT":
            return intensity.normalize_ct(cropped, dataset_stats, [modality], value, staged)
        return intensity.normalize_ct2(cropped, dataset_stats, [modality], [*keys, modality], value, staged)
    return intensity.normalize_z(cropped, keys, value, F.col(seg) >= 0)


def preprocess_cases(images: DataFrame, seg: DataFrame, keys: Sequence[str], dims: Dims,
                     schemes: Mapping[int | str, str], dataset_stats: DataFrame | None = None, use_mask: bool = False,
                     modality: str = "modality", value: str = "value", label: str = "label") -> DataFrame:
    """Cropped, normalized cases as dense rows: keys, z, y, x (in the crop), modality, normalized, label.

    A voxel belongs to a case's mask where any modality is nonzero or where the
    mask encloses it.  The case is cropped to the mask's box; background outside
    the mask gets label -1.  ``images`` and ``seg`` hold nonzero voxels, all
    others count as zero in every statistic.  ``schemes`` names CT, nonCT or
    noNorm for each modality, ``dataset_stats`` (modality, p0_5, p99_5, mean,
    sd) the pooled values of CT.  With ``use_mask`` nonCT takes its mean and
    deviation inside the mask and everything outside becomes 0.
    """
    keys = list(keys)
    place = [*keys, *ZYX]
    mask = materialize(images.where(F.col(value) != 0).select(*place).distinct())
    mask = materialize(mask.unionByName(fill_holes(mask, keys, dims).select(*place)))
    boxes = materialize(masking.bounding_box(mask, keys, F.lit(True)))
    cells = boxes
    for axis in ZYX:
        cells = cells.withColumn(axis, F.explode(F.sequence(F.col(axis + "0"), F.col(axis + "1") - 1)))
    names = F.explode(F.array(*[F.lit(m) for m in schemes])).alias(modality)
    zero = F.lit(0)
    dense = (cells.select(*place, *[a + "0" for a in ZYX])
             .join(mask.withColumn("_in", F.lit(True)), place, "left")
             .join(seg.select(*place, F.col(label).alias("_l")), place, "left")
             .withColumn(label, masking.mark_outside(F.coalesce("_l", zero), F.coalesce("_in", F.lit(False))))
             .select(*place, *[a + "0" for a in ZYX], label, names)
             .join(images.select(*place, modality, F.col(value).cast("double").alias("_v")), [*place, modality], "left")
             .withColumn("_v", F.coalesce("_v", F.lit(0.0))))
    dense = materialize(dense)
    inside = (F.col(label) >= 0) | F.lit(not use_mask)
    picked = F.when(inside, F.col("_v"))
    own = dense.groupBy(*keys, modality).agg(F.avg(picked).alias("_m"), F.stddev_pop(picked).alias("_s"))
    rows = attach(dense, own, [*keys, modality])
    scheme = literal_map(dict(schemes))[F.col(modality)]
    scaled = F.when(scheme == "nonCT", (F.col("_v") - F.col("_m")) / (F.col("_s") + 1e-8)).when(
        scheme == "noNorm", F.col("_v"))
    if dataset_stats is not None:
        rows = attach(rows, dataset_stats.select(modality, "p0_5", "p99_5", "mean", "sd"), [modality], "left")
        clipped = intensity.clip(F.col("_v"), F.col("p0_5"), F.col("p99_5"))
        scaled = F.when(scheme == "CT", div0(clipped - F.col("mean"), F.col("sd"))).otherwise(scaled)
    keep = inside | (scheme == "noNorm")
    moved = [(F.col(a) - F.col(a + "0")).cast("int").alias(a) for a in ZYX]
    return rows.select(*keys, *moved, modality, F.round(F.when(keep, scaled).otherwise(0.0), 6).alias("normalized"), label)


def resample_case_set(voxels: DataFrame, keys: Sequence[str], value: str, seg: str, old: Dims, new: Dims,
                      separate: int | None) -> DataFrame:
    """Cubic data and label-wise linear segmentation on the new grid.

    With a separate low-resolution axis that axis is read nearest for both.
    """
    middle = new if separate is None else keep_axis(new, old, separate, keys)
    data = resample.resample_cubic(voxels.select(*keys, "z", "y", "x", value), keys, value, old, middle)
    labels = resample.resample_labels(voxels, keys, seg, old, middle)
    joined = data.join(labels, [*keys, "z", "y", "x"], "full").fillna(0)
    return joined if separate is None else resample.resample_nearest(joined, middle, new, keys)


def fingerprint_table(voxels: DataFrame, case: str, modality: str, value: str, seg: str) -> DataFrame:
    """Pooled foreground statistics per modality, staged for normalization."""
    stats = intensity.fingerprint(voxels, case, modality, value, F.col(seg) > 0)
    return materialize(stats.where(F.col(case).isNull()).drop(case))


