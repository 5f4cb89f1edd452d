"""Spatial operators over volumes whose shape and spacing depend on the volume, in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.bindings import VOX, voxels
from voxloom.catalog import query
from voxloom.catalog.spatial import component_sql
from voxloom.operators import components, resample, stencil, surface
from voxloom.operators.geometry import free_cells
from voxloom.support import full_offsets, materialize

V = ["volume_id"]
PLACE = ["volume_id", "z", "y", "x"]
TILE = (16, 16, 16)
LIN = "(CAST(z AS BIGINT) * h + y) * w + x"

# what lies outside a volume's own shape is cut off first; every other volume has slices twice as thick
SHAPES = f"""{VOX},
g AS (SELECT DISTINCT volume_id, CAST(41 - volume_id % 3 AS INT) AS d, CAST(43 - volume_id % 2 AS INT) AS h,
  CAST(47 - volume_id % 4 AS INT) AS w, 1 + volume_id % 2 AS thick FROM vox),
own AS (SELECT v.*, d, h, w, thick FROM vox v JOIN g USING (volume_id) WHERE z < d AND y < h AND x < w)"""


def _shaped(spark, sf):
    vox = voxels(spark, sf)
    size = {"depth": 41 - F.col("volume_id") % 3, "height": 43 - F.col("volume_id") % 2, "width": 47 - F.col("volume_id") % 4}
    size = {name: c.cast("int") for name, c in size.items()}
    geometry = materialize(vox.select("volume_id").distinct().withColumns(
        {**size, "spacing_z": (1 + F.col("volume_id") % 2).cast("double"), "spacing_y": F.lit(1.0), "spacing_x": F.lit(1.0)}))
    inside = (F.col("z") < size["depth"]) & (F.col("y") < size["height"]) & (F.col("x") < size["width"])
    return vox.where(inside), geometry


def _offsets(name, offsets):
    return f"{name}(dz, dy, dx) AS (VALUES {', '.join(f'({z}, {y}, {x})' for z, y, x in offsets)})"


FITS = "z + dz >= 0 AND z + dz < d AND y + dy >= 0 AND y + dy < h AND x + dx >= 0 AND x + dx < w"


@query("components_by_shape", f"WITH RECURSIVE {SHAPES}, {component_sql('cc', 'own', 26, 'gt', lin=LIN)} SELECT volume_id, z, y, x, code AS gt, component FROM cc")
def components_by_shape(spark, sf):
    rows, geometry = _shaped(spark, sf)
    return components.connected_components(rows.select(*PLACE, "gt"), V, geometry, 26, code="gt", tile=TILE)


@query("border_by_shape", f"""WITH {SHAPES}, {_offsets('o', full_offsets(6))}
SELECT DISTINCT i.volume_id, i.z, i.y, i.x, i.gt FROM (SELECT own.*, dz, dy, dx FROM own, o WHERE {FITS}) i LEFT JOIN own n
  ON n.volume_id = i.volume_id AND n.z = i.z + i.dz AND n.y = i.y + i.dy AND n.x = i.x + i.dx AND n.gt = i.gt WHERE n.gt IS NULL""")
def border_by_shape(spark, sf):
    rows, geometry = _shaped(spark, sf)
    return stencil.border_voxels(rows.select(*PLACE, "gt"), V, "gt", geometry, full_offsets(6), False, tile=TILE)


@query("dilate_by_shape", f"""WITH {SHAPES}, {_offsets('o', stencil.box_offsets(stencil.HEAD_BOXES))}
SELECT DISTINCT volume_id, z + dz AS z, y + dy AS y, x + dx AS x FROM own, o WHERE intensity % 23 = 5 AND {FITS}""")
def dilate_by_shape(spark, sf):
    rows, geometry = _shaped(spark, sf)
    return stencil.dilate(rows.where("intensity % 23 = 5"), V, geometry, stencil.HEAD_BOXES, tile=(32, 32, 32))


@query("expand_by_shape", f"""WITH {SHAPES}, o AS (SELECT CAST(dz - 3 AS INT) AS dz, CAST(dy - 3 AS INT) AS dy, CAST(dx - 3 AS INT) AS dx FROM range(7) a(dz), range(7) b(dy), range(7) c(dx)
  WHERE (dz - 3) * (dz - 3) + (dy - 3) * (dy - 3) + (dx - 3) * (dx - 3) <= 9)
SELECT volume_id, z + dz AS z, y + dy AS y, x + dx AS x, CAST(MIN((dz * dz + dy * dy + dx * dx) * 100 + intensity % 23) % 100 AS INT) AS organ
FROM own, o WHERE intensity % 23 NOT IN (0, 5) AND {FITS} GROUP BY ALL""")
def expand_by_shape(spark, sf):
    rows, geometry = _shaped(spark, sf)
    organs = rows.select(*PLACE, (F.col("intensity") % 23).alias("organ")).where("organ <> 5")
    return stencil.expand_labels(organs, V, "organ", geometry, 3, tile=TILE)


@query("holes_by_shape", f"""WITH RECURSIVE {SHAPES}, {component_sql('cc', 'own', 6, lin=LIN)},
open AS (SELECT DISTINCT volume_id, component FROM cc JOIN g USING (volume_id) WHERE z IN (0, d - 1) OR y IN (0, h - 1) OR x IN (0, w - 1))
SELECT volume_id, z, y, x FROM cc ANTI JOIN open USING (volume_id, component)""")
def holes_by_shape(spark, sf):
    rows, geometry = _shaped(spark, sf)
    mask = free_cells(geometry, rows)
    return stencil.fill_holes(mask, V, geometry, tile=(32, 32, 32))


# slices twice as thick are reached in step 3, 5, 7, ... : the first move once the other axes lead by more than one
@query("instances_by_shape", f"""WITH RECURSIVE {SHAPES}, {component_sql('core', 'own', 26, where='pred = 1', lin=LIN)},
cost AS (SELECT b.volume_id, b.z, b.y, b.x, c.component, GREATEST(ABS(b.z - c.z) + ABS(b.y - c.y) + ABS(b.x - c.x),
    CASE WHEN thick = 2 AND b.z <> c.z THEN 2 * ABS(b.z - c.z) + 1 ELSE 0 END) AS n
  FROM own b JOIN core c ON c.volume_id = b.volume_id WHERE b.pred = 2)
SELECT volume_id, z, y, x, component AS instance FROM core
UNION ALL SELECT volume_id, z, y, x, MAX_BY(component, -n * 1000000 + component) FROM cost GROUP BY ALL
UNION ALL SELECT volume_id, z, y, x, 0 FROM own WHERE pred = 2 AND volume_id NOT IN (SELECT volume_id FROM core)""")
def instances_by_shape(spark, sf):
    rows, geometry = _shaped(spark, sf)
    return stencil.instances_from_core_and_border(rows.select(*PLACE, "pred"), V, "pred", geometry, geometry, tile=(32, 32, 32))


@query("surface_by_shape", f"""WITH {SHAPES}, {_offsets('o', full_offsets(6))},
seg AS (SELECT volume_id, z, y, x, thick, gt AS code, FALSE AS from_test FROM own UNION ALL SELECT volume_id, z, y, x, thick, pred, TRUE FROM own WHERE pred > 0),
surf AS (SELECT DISTINCT s.volume_id, s.code, s.from_test, s.thick, s.z, s.y, s.x FROM (SELECT seg.*, dz, dy, dx FROM seg, o) s LEFT JOIN seg n
  ON n.volume_id = s.volume_id AND n.from_test = s.from_test AND n.z = s.z + s.dz AND n.y = s.y + s.dy AND n.x = s.x + s.dx AND n.code = s.code WHERE n.code IS NULL),
near AS (SELECT a.volume_id, a.code, a.from_test, a.z, a.y, a.x, SQRT(MIN((a.z - b.z) * (a.z - b.z) * a.thick * a.thick + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS distance
  FROM surf a JOIN surf b ON a.volume_id = b.volume_id AND a.code = b.code AND a.from_test <> b.from_test GROUP BY ALL)
SELECT volume_id, code, ROUND(MAX(distance), 6) AS hd, ROUND(QUANTILE_CONT(distance, 0.95), 6) AS hd95,
  ROUND(AVG(CASE WHEN from_test THEN distance END), 6) AS asd,
  ROUND((AVG(CASE WHEN from_test THEN distance END) + AVG(CASE WHEN NOT from_test THEN distance END)) / 2, 6) AS assd FROM near GROUP BY 1, 2""")
def surface_by_shape(spark, sf):
    rows, geometry = _shaped(spark, sf)
    rows = materialize(rows.select(*PLACE, "gt", "pred"))
    ref = surface.surface(rows.select(*PLACE, F.col("gt").alias("code")), V, "code", geometry)
    test = surface.surface(rows.where("pred > 0").select(*PLACE, F.col("pred").alias("code")), V, "code", geometry)
    key = ["volume_id", "code"]
    return surface.distance_metrics(surface.distance_counts(test, ref, key, geometry, geometry), key)


# half the slices, twice the rows
GRIDS = f"""{SHAPES},
gz AS (SELECT volume_id, i, LEAST(GREATEST((i + 0.5) * (d / (d // 2)::DOUBLE) - 0.5, 0), d - 1) AS c FROM (SELECT *, UNNEST(range(d // 2)) AS i FROM g)),
gy AS (SELECT volume_id, i, LEAST(GREATEST((i + 0.5) * (h / (2 * h)::DOUBLE) - 0.5, 0), h - 1) AS c FROM (SELECT *, UNNEST(range(2 * h)) AS i FROM g))"""


def _finer(geometry):
    return geometry.select("volume_id", F.expr("depth div 2").alias("depth"), (F.col("height") * 2).alias("height"), "width")


@query("resample_by_shape", f"""WITH {GRIDS}
SELECT o.volume_id, CAST(gz.i AS INT) AS z, CAST(gy.i AS INT) AS y, x, intensity FROM own o
JOIN gz ON gz.volume_id = o.volume_id AND ROUND_EVEN(gz.c, 0) = z JOIN gy ON gy.volume_id = o.volume_id AND ROUND_EVEN(gy.c, 0) = y""")
def resample_by_shape(spark, sf):
    rows, geometry = _shaped(spark, sf)
    return resample.resample_nearest(rows.select(*PLACE, "intensity"), geometry, _finer(geometry), V)


@query("linear_by_shape", f"""WITH {GRIDS}
SELECT o.volume_id, CAST(gz.i AS INT) AS z, CAST(gy.i AS INT) AS y, x, ROUND(SUM(intensity * (1 - ABS(gz.c - z)) * (1 - ABS(gy.c - y))), 7) AS intensity
FROM own o JOIN gz ON gz.volume_id = o.volume_id AND ABS(gz.c - z) < 1 JOIN gy ON gy.volume_id = o.volume_id AND ABS(gy.c - y) < 1 GROUP BY 1, 2, 3, 4""")
def linear_by_shape(spark, sf):
    rows, geometry = _shaped(spark, sf)
    out = resample.resample_linear(rows.select(*PLACE, F.col("intensity").cast("double").alias("intensity")), V, "intensity",
                                   geometry, _finer(geometry))
    return out.withColumn("intensity", F.round("intensity", 7))


@query("pool_by_shape", f"""WITH {SHAPES},
n AS (SELECT volume_id, d, h, w, CAST((z + 1) // 4 AS INT) AS z, CAST((y + 1) // 4 AS INT) AS y, CAST(x // 2 AS INT) AS x, gt, COUNT(*) AS n FROM own GROUP BY ALL)
SELECT volume_id, z, y, x, gt, ROUND(n / CAST((LEAST(4 * z + 3, d) - GREATEST(4 * z - 1, 0)) * (LEAST(4 * y + 3, h) - GREATEST(4 * y - 1, 0))
  * (LEAST(2 * x + 2, w) - 2 * x) AS DOUBLE), 6) AS share FROM n WHERE z < (d + 2 - 4) // 4 + 1 AND y < (h + 2 - 4) // 4 + 1 AND x < (w - 2) // 2 + 1""")
def pool_by_shape(spark, sf):
    rows, geometry = _shaped(spark, sf)
    return resample.average_pool(rows.select(*PLACE, "gt"), V, "gt", (4, 4, 2), geometry)
