"""Image files written from the derived volumes and read again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from voxloom.bindings import LATTICE, VOX, voxel_tasks, voxels
from voxloom.catalog import query
from voxloom.plans import datasets
from voxloom.sinks import images as sink
from voxloom.sources import images
from voxloom.support import materialize, shared_dir

CHANNELS = f"""{VOX}, chan AS (SELECT 'mouse/' || volume_id AS volume_id, 0 AS channel, z, y, x, CAST(intensity AS DOUBLE) AS value FROM vox
UNION ALL SELECT 'mouse/' || volume_id, 1, z, y, x, intensity * gt FROM vox)"""


def _folder(spark, name):
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _planes(rows, value, dtype, tasks=None):
    named = rows.withColumn("volume_id", F.concat(F.lit("mouse/"), F.col("volume_id")))
    return sink.to_planes(named, "volume_id", value, LATTICE[1], LATTICE[2], dtype, LATTICE[0], tasks)


def _two_channels(spark, sf):
    rows = voxels(spark, sf).select("volume_id", "z", "y", "x", "intensity", (F.col("intensity") * F.col("gt")).alias("second"))
    first, second = (_planes(rows, c, "i2").withColumn("channel", F.lit(k)) for k, c in enumerate(("intensity", "second")))
    return first.unionByName(second)


@query("nifti_round_trip", f"WITH {CHANNELS} SELECT * FROM chan WHERE value <> 0")
def nifti_round_trip(spark, sf):
    folder = _folder(spark, "nifti")
    sink.write_nifti(_two_channels(spark, sf), folder, LATTICE[0])
    return images.read_nifti_voxels(spark, folder)


@query("nifti_slab", f"WITH {CHANNELS} SELECT volume_id, z, y, x, value FROM chan WHERE value <> 0 AND channel = 1 AND z >= 10 AND z < 14")
def nifti_slab(spark, sf):
    # the reader skips the other channel and the planes outside
    folder = _folder(spark, "nifti")
    sink.write_nifti(_two_channels(spark, sf), folder, LATTICE[0], compress=True)
    return images.read_nifti_voxels(spark, folder, z=(10, 14), channel=1).drop("channel")


@query("nifti_geometry", f"""WITH {VOX} SELECT DISTINCT 'mouse/' || volume_id AS volume_id, 41 AS depth, 43 AS height, 47 AS width, 2 AS channels, 1.0::DOUBLE AS spacing FROM vox""")
def nifti_geometry(spark, sf):
    folder = _folder(spark, "nifti")
    sink.write_nifti(_two_channels(spark, sf), folder, LATTICE[0])
    return images.read_geometry(spark, folder).select(
        "volume_id", *[F.col("size")[k].alias(n) for k, n in enumerate(("depth", "height", "width"))], "channels",
        F.array_max("spacing").alias("spacing"))


@query("tiff_round_trip", f"WITH {VOX} SELECT 'mouse/' || volume_id AS volume_id, z, y, x, CAST(intensity AS DOUBLE) AS value FROM vox WHERE intensity <> 0")
def tiff_round_trip(spark, sf):
    folder = _folder(spark, "tiff")
    # the voxels are needed twice: for their planes and for the planes that hold none
    rows = materialize(voxels(spark, sf).select("volume_id", "z", "y", "x", "intensity"))
    sink.write_tiff_slices(_planes(rows, "intensity", "u2", voxel_tasks(spark, sf)), folder)
    return images.planes_to_voxels(images.read_tiff_stack(spark, folder))


@query("task_import", f"""WITH {VOX}, r AS (SELECT *, 'imagesTr/' AS role FROM vox UNION ALL SELECT *, 'imagesTs/' FROM vox WHERE volume_id % 3 = 0),
f AS (SELECT role || volume_id || '_0000' AS volume_id, intensity AS v, z, y, x FROM r UNION ALL SELECT role || volume_id || '_0001', intensity * gt, z, y, x FROM r
  UNION ALL SELECT 'labelsTr/' || volume_id, gt, z, y, x FROM vox)
SELECT volume_id, COUNT(*) AS n, CAST(SUM(v * ((z * 43 + y) * 47 + x)) AS DOUBLE) AS digest FROM f WHERE v <> 0 GROUP BY 1""")
def task_import(spark, sf):
    # every third volume is a test case as well
    folder = f"{_folder(spark, 'import')}/Task07_Mouse"
    number = F.regexp_extract("volume_id", r"(\d+)$", 1)
    roles = F.array_compact(F.array(F.lit("imagesTr/"), F.when(number.cast("long") % 3 == 0, "imagesTs/")))
    named = _two_channels(spark, sf).withColumn("_role", F.explode(roles)).withColumn("volume_id", F.concat("_role", number))
    sink.write_nifti(named.drop("_role"), folder, LATTICE[0], compress=True)
    labels = _planes(voxels(spark, sf), "gt", "u1")
    sink.write_nifti(labels.withColumn("volume_id", F.concat(F.lit("labelsTr/"), number)), folder, LATTICE[0], compress=True)
    out = _folder(spark, "tasks")
    datasets.import_task(spark, folder, out, {"0": "A", "1": "B"}, {"0": "background"})
    rows = images.read_nifti_voxels(spark, datasets.output_folder(folder, out))
    place = (F.col("z") * 43 + F.col("y")) * 47 + F.col("x")
    return rows.groupBy("volume_id").agg(F.count("*").alias("n"), F.sum(F.col("value") * place).alias("digest"))
