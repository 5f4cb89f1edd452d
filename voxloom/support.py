"""Session helpers: staging tables, grid offsets and small column utilities."""

from __future__ import annotations

import itertools
import math
import os
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZYX = ("z", "y", "x")
_local_dirs: dict[str, str] = {}
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="voxloom-")
    return _local_dirs[app]


def stage(df: DataFrame) -> str:
    """Write ``df`` to a folder of its own below the shared one; returns that folder."""
    path = os.path.join(shared_dir(df.sparkSession), "stage-" + uuid.uuid4().hex)
    df.write.parquet(path)
    _staged.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage to recompute after an executor loss, and the scan
    carries its real size, so Spark itself broadcasts it only when it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges it otherwise.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stage(df))


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables staged by this process; results built on them must be saved before."""
    context = spark.sparkContext
    dropped = 0
    while _staged:
        where = context._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        dropped += bool(where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True))
    return dropped


def half_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """One offset of every opposite pair in a 6, 18 or 26 neighbourhood."""
    reach = {6: 1, 18: 2, 26: 3}[connectivity]
    return [o for o in itertools.product((-1, 0, 1), repeat=3)
            if o > (0, 0, 0) and sum(map(abs, o)) <= reach]


def full_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    half = half_offsets(connectivity)
    return half + [tuple(-c for c in o) for o in half]


def offset_array(offsets: Iterable[Sequence[int]]) -> Column:
    """Literal array<struct<dz,dy,dx>> for use with ``explode``."""
    return F.array(*[
        F.struct(F.lit(int(z)).alias("dz"), F.lit(int(y)).alias("dy"), F.lit(int(x)).alias("dx"))
        for z, y, x in offsets])


def linear_index(dims: Sequence[int], z: str = "z", y: str = "y", x: str = "x") -> Column:
    """C-order position of a voxel in a volume of shape ``dims``; a voxel outside the shape is an error."""
    inside = F.lit(True)
    for axis, size in zip((z, y, x), dims):
        inside = inside & F.col(axis).between(0, size - 1)
    index = (F.col(z).cast("long") * dims[1] + F.col(y)) * dims[2] + F.col(x)
    outside = F.raise_error(F.lit(f"a voxel lies outside the declared shape {tuple(dims)}")).cast("long")
    return F.when(inside, index).otherwise(outside)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])


def div0(num: Column, den: Column) -> Column:
    """num/den as double, NULL when the denominator is zero."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def spread(df: DataFrame, *columns: str, tasks: int | None = None) -> DataFrame:
    """Hash-partition for numpy work per group, into the session's number of partitions unless ``tasks`` names another.

    The partition count is explicit: such groups are small in bytes but costly,
    and would otherwise be coalesced into a few tasks by size.
    """
    return df.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def tasks_for(spark: SparkSession, rows: float, per_task: float) -> int:
    """Number of shuffle partitions that hold at most ``per_task`` of so many rows, at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task))


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner",
           staged: bool = False) -> DataFrame:
    """Join large ``rows`` with a one-row-per-case table without shuffling the rows.

    The per-case table is staged first (unless it is ``staged`` already), so its measured size decides between a
    broadcast and a (skew-splitting) sort-merge join.
    """
    return rows.join(stats if staged else materialize(stats), list(keys), how)
