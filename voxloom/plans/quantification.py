"""From overlapping tile predictions to mask counts per organ, as one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import components, quantify, stencil, tiles
from voxloom.operators.geometry import Dims


def nerve_quantification(tile_scores: DataFrame, organs: DataFrame, keys: Sequence[str], score: str, label: str,
                         threshold: float = 0.5) -> DataFrame:
    """Stitch tiles, binarize, join the organ labels and count per organ.

    The tile rows are aggregated by voxel once; the join with the organ voxels
    uses the same partitioning, and the counts per organ aggregate partially.
    """
    stitched = tiles.stitch(tile_scores, keys, score)
    mask = stitched.where(F.round(score, 6) >= threshold).select(*keys, "z", "y", "x", F.lit(1).alias("value"))
    return quantify.overlap(organs.withColumnRenamed(label, "label"), mask, keys)


def prepare_organs(organs: DataFrame, keys: Sequence[str], label: str, dims: Dims, head: int,
                   head_iterations: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The grown head mask, and the other organs with their labels expanded."""
    grown = stencil.dilate(organs.where(F.col(label) == head), keys, dims, stencil.HEAD_BOXES, head_iterations)
    others = stencil.expand_labels(organs.where(F.col(label) != head), keys, label, dims, radius)
    return grown, others


def clean_prediction(labels: DataFrame, keys: Sequence[str], label: str, dims: Dims, connectivity: int = 6,
                     floors: dict[int, int] | None = None) -> DataFrame:
    """Keep the largest object of each class and all objects above its floor."""
    from voxloom.support import materialize
    labelled = materialize(components.connected_components(labels, keys, dims, connectivity, code=label))
    sizes = components.component_sizes(labelled, keys, label)
    group = [*keys, label]
    kept = components.largest(sizes, group)
    if floors:
        limits = F.create_map(*[F.lit(v) for kv in floors.items() for v in kv])
        valid = sizes.where(F.col("voxels") >= limits[F.col(label)])
        kept = kept.unionByName(valid).distinct()
    return components.keep_components(labelled, kept, keys).drop("component")
