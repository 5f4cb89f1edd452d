"""Ranks inside groups that may be too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.support import materialize


def rank_in_buckets(df: DataFrame, keys: Sequence[str], buckets: Sequence[tuple[str, Column]],
                    order: Sequence[Column | str], rank: str = "rank", total: str | None = None) -> DataFrame:
    """0-based position of each row within ``keys`` ordered by the buckets, then ``order``.

    ``buckets`` names nested order-preserving bucket columns, coarse to fine.
    Rows are only sorted inside the finest bucket; the running offsets are taken
    over bucket counts, one window per level, so no window holds more rows than
    one bucket has children.
    """
    names = [n for n, _ in buckets]
    rows = df.withColumns(dict(buckets))
    # one row per bucket, staged because every level below reads it
    counts = materialize(rows.groupBy(*keys, *names).agg(F.count("*").alias("_n")))
    offsets = counts
    offset = F.lit(0).cast("long")
    for depth in range(len(names), 0, -1):
        # counts per bucket of this level, then the sum of the earlier siblings
        level = counts.groupBy(*keys, *names[:depth]).agg(F.sum("_n").alias("_m"))
        before = (W.partitionBy(*keys, *names[:depth - 1]).orderBy(names[depth - 1])
                  .rowsBetween(W.unboundedPreceding, -1))
        level = level.select(*keys, *names[:depth], F.coalesce(F.sum("_m").over(before), F.lit(0)).alias(f"_o{depth}"))
        offsets = offsets.join(level, [*keys, *names[:depth]])
        offset = offset + F.col(f"_o{depth}")
    wanted = [*keys, *names, offset.alias("_offset")]
    if total:
        sizes = counts.groupBy(*keys).agg(F.sum("_n").alias(total))
        offsets = offsets.join(sizes, list(keys))
        wanted.append(F.col(total))
    inside = W.partitionBy(*keys, *names).orderBy(*order)
    offsets = materialize(offsets.select(*wanted))
    return (rows.join(offsets, [*keys, *names])
            .withColumn(rank, F.col("_offset") + F.row_number().over(inside) - 1)
            .drop("_offset", *[n for n in names if n not in df.columns]))
