"""Voxel tables laid out for joins without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

PLACE = ("volume_id", "z", "y", "x")


def write_voxel_table(voxels: DataFrame, name: str, buckets: int, keys: Sequence[str] = PLACE) -> None:
    """Save as a bucketed and sorted table.

    Tables saved with the same keys and bucket count (labels, masks,
    predictions) join on position without moving a row; ``spark.table`` reads them.
    """
    (voxels.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
