"""Stored tiles, functions over tiles with a halo, and patches cut from tiles."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from voxloom.bindings import LATTICE, VOX, voxel_tasks, voxels
from voxloom.catalog import query
from voxloom.catalog.arrays import EXPORT, RESAMPLED, _scores_and_boxes
from voxloom.operators import stencil, tiles
from voxloom.plans import export
from voxloom.sinks import tiles as store
from voxloom.support import full_offsets, materialize, shared_dir

V = ["volume_id"]
PLACE = ["volume_id", "z", "y", "x"]
TILE = (16, 16, 16)
LOW, HIGH = (5, 10, 0), (20, 30, 25)


def _stored(spark, sf):
    path = os.path.join(shared_dir(spark), "tiles-" + uuid.uuid4().hex)
    rows = voxels(spark, sf).select(*PLACE, "intensity")
    store.write_tiles(store.tiles_of(rows, V, "intensity", LATTICE, TILE, "<i2"), V, path)
    return path


@query("tile_store_slice", f"""WITH {VOX} SELECT volume_id, z, y, x, CAST(intensity AS DOUBLE) AS value FROM vox
WHERE z >= 5 AND z < 20 AND y >= 10 AND y < 30 AND x >= 0 AND x < 25 AND intensity <> 0""")
def tile_store_slice(spark, sf):
    return store.box_slice(spark, _stored(spark, sf), V, LOW, HIGH)


@query("tile_store_bright", f"""WITH {VOX}, t AS (SELECT volume_id, z // 16 * 16 AS z0, y // 16 * 16 AS y0, x // 16 * 16 AS x0, intensity FROM vox),
c AS (SELECT *, (LEAST(z0 + 16, 41) - z0) * (LEAST(y0 + 16, 43) - y0) * (LEAST(x0 + 16, 47) - x0) AS cells FROM t)
SELECT volume_id, CAST(z0 AS INT) AS z0, CAST(y0 AS INT) AS y0, CAST(x0 AS INT) AS x0,
  CAST(CASE WHEN COUNT(*) < MIN(cells) THEN 0 ELSE MIN(intensity) END AS DOUBLE) AS low, CAST(MAX(intensity) AS DOUBLE) AS high, COUNT(*) AS nonzero
FROM c GROUP BY ALL HAVING MAX(intensity) >= 50""")
def tile_store_bright(spark, sf):
    # the statistics of the store decide, no block is decoded
    return store.read_tiles(spark, _stored(spark, sf), least=50).select(*V, *store.LOW, "low", "high", "nonzero")


def _box_mean(block):
    total = sum(np.roll(block, shift, (0, 1, 2)) for shift in np.ndindex(3, 3, 3))
    return np.round(np.roll(total, (-1, -1, -1), (0, 1, 2)) / 27, 6)


@query("halo_smooth", f"""WITH {VOX}, o(dz, dy, dx) AS (VALUES (0, 0, 0), {', '.join(map(str, full_offsets(26)))})
SELECT volume_id, z + dz AS z, y + dy AS y, x + dx AS x, ROUND(SUM(intensity) / 27.0::DOUBLE, 6) AS intensity FROM vox, o
WHERE z + dz BETWEEN 0 AND 40 AND y + dy BETWEEN 0 AND 42 AND x + dx BETWEEN 0 AND 46 GROUP BY 1, 2, 3, 4 HAVING SUM(intensity) > 0""")
def halo_smooth(spark, sf):
    return stencil.halo_map(voxels(spark, sf).select(*PLACE, "intensity"), V, "intensity", LATTICE, (1, 1, 1), _box_mean, TILE)


def _with_company(block):
    near = np.zeros(block.shape, bool)
    for axis in range(3):
        for step in (-1, 1):
            near |= np.roll(block, step, axis) == block
    return np.where(near, block, 0)


# a transform between the class decision and the uncropping: labels without an equal face neighbour go
@query("export_transform", f"""WITH {EXPORT},
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id, z, y, x ORDER BY p DESC, class) AS r FROM dense),
seg AS (SELECT volume_id, z, y, x, class FROM best WHERE r = 1 AND class <> 0), o(dz, dy, dx) AS (VALUES {', '.join(map(str, full_offsets(6)))}),
near AS (SELECT DISTINCT volume_id, z + dz AS z, y + dy AS y, x + dx AS x, class FROM seg, o)
SELECT volume_id, CAST(z + volume_id % 5 AS INT) AS z, CAST(y + 2 AS INT) AS y, CAST(x + 1 AS INT) AS x, class AS label
FROM seg JOIN near USING (volume_id, z, y, x, class)""")
def export_transform(spark, sf):
    scores, boxes = _scores_and_boxes(spark, sf)

    def transform(labels):
        return stencil.halo_map(labels, V, "label", RESAMPLED, (1, 1, 1), _with_company, (32, 32, 32), "i4").withColumn(
            "label", F.col("label").cast("int"))
    return export.export_segmentation(scores, V, LATTICE, RESAMPLED, boxes, postprocess=transform)


PATCH = (8, 12, 16)


# one patch for the first voxel of every class and slice; -1 stands for what lies outside the volume
@query("patch_crops", f"""WITH {VOX}, c AS (SELECT volume_id, gt, z, MIN(y * 100 + x) AS yx FROM vox GROUP BY 1, 2, 3),
b AS (SELECT volume_id, gt, z AS slice, GREATEST(-2, z - 4) AS z0, GREATEST(0, yx // 100 - 6) AS y0, GREATEST(-8, yx % 100 - 8) AS x0 FROM c),
w AS (SELECT *, (LEAST(z0 + 8, 41) - GREATEST(z0, 0)) * (LEAST(y0 + 12, 43) - GREATEST(y0, 0)) * (LEAST(x0 + 16, 47) - GREATEST(x0, 0)) AS inside FROM b)
SELECT w.volume_id, w.gt, slice, COUNT(*) AS filled, CAST(8 * 12 * 16 - inside AS BIGINT) AS outside,
  CAST(SUM(intensity * (((v.z - z0) * 12 + v.y - y0) * 16 + v.x - x0 + 1)) AS BIGINT) AS digest
FROM w JOIN vox v ON v.volume_id = w.volume_id AND v.z >= z0 AND v.z < z0 + 8 AND v.y >= y0 AND v.y < y0 + 12 AND v.x >= x0 AND v.x < x0 + 16
GROUP BY w.volume_id, w.gt, slice, inside""")
def patch_crops(spark, sf):
    # the centres and the patches come from the same voxels
    rows = materialize(voxels(spark, sf).select(*PLACE, "gt", "intensity"))
    first = rows.groupBy("volume_id", "gt", "z").agg(F.min(F.col("y") * 100 + F.col("x")).alias("yx"))
    centres = first.select("volume_id", "gt", F.col("z").alias("slice"), "z", F.expr("yx div 100").cast("int").alias("y"),
                           (F.col("yx") % 100).cast("int").alias("x"))
    boxes = tiles.patch_boxes(centres, PATCH, LATTICE, padded=(12, 12, 32))
    crops = tiles.patch_crops(rows.select(*PLACE, "intensity"), boxes, V, ["volume_id", "gt", "slice"], "intensity", PATCH,
                              (16, 16, 16), "<i2", -1, LATTICE, voxel_tasks(spark, sf))

    def digest(batches):
        weight = np.arange(1, np.prod(PATCH) + 1)
        for batch in batches:
            for low in range(0, len(batch), 1024):
                part = batch.iloc[low:low + 1024]
                blocks = np.frombuffer(b"".join(part["block"]), "<i2").reshape(len(part), -1)
                out = part[["volume_id", "gt", "slice"]].copy()
                out["filled"], out["outside"] = (blocks > 0).sum(axis=1), (blocks < 0).sum(axis=1)
                out["digest"] = np.maximum(blocks, 0) @ weight
                yield out
    return crops.mapInPandas(digest, "volume_id long, gt int, slice int, filled long, outside long, digest long")
