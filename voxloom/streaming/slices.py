"""Running results over slices that keep arriving.

Slices are processed once each, in micro-batches; the stream's checkpoint
remembers the finished files, which replaces checks for existing outputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.operators.intensity import value_counts


def slice_bounds(slices: DataFrame, keys: Sequence[str], z: str, value: str, percent: float) -> DataFrame:
    """Low and high percentile of the nonzero values of every slice."""
    counts = value_counts(slices.where(F.col(value) != 0), [*keys, z], value)
    return counts.groupBy(*keys, z).agg(
        F.expr(f"percentile(v, {percent / 100}D, n)").alias("lo"),
        F.expr(f"percentile(v, {(100 - percent) / 100}D, n)").alias("hi"))


def start_bounds_stream(slices: DataFrame, keys: Sequence[str], z: str, value: str, percent: float, target: str,
                        checkpoint: str) -> StreamingQuery:
    """Write the bounds of each new slice below ``target``.

    A batch overwrites its own folder, so a repeated batch leaves no duplicates.
    A slice must arrive whole, as one file does.
    """
    def write(batch: DataFrame, number: int) -> None:
        slice_bounds(batch, keys, z, value, percent).write.mode("overwrite").parquet(f"{target}/batch={number}")
    return (slices.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def running_envelope(bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Envelope over all slices seen so far."""
    return bounds.groupBy(*keys).agg(F.round(F.least(F.lit(65535.0), F.min("lo")), 6).alias("low"),
                                     F.round(F.greatest(F.lit(0.0), F.max("hi")), 6).alias("high"))
