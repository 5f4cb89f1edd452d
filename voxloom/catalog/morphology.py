"""Borders, growth, hole filling and surface distance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.bindings import CELLS, LATTICE, VOX, voxels
from voxloom.catalog import query
from voxloom.catalog.spatial import component_sql
from voxloom.operators import evaluate, geometry, stencil, surface
from voxloom.operators.geometry import free_cells
from voxloom.plans import preprocessing
from voxloom.support import full_offsets, materialize

V = ["volume_id"]
PLACE = ["volume_id", "z", "y", "x"]
SMALL_TILE = (16, 16, 16)


def _offset_values(offsets):
    return ", ".join(f"({z}, {y}, {x})" for z, y, x in offsets)


BLOCKS = f"""{VOX}, o(dz, dy, dx) AS (VALUES {_offset_values(full_offsets(6))}),
blocks AS (SELECT DISTINCT volume_id, CAST(z // 3 AS INT) AS z, CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, 1 AS code FROM vox)"""


def _blocks(spark, sf):
    # occupied 3x3x3 blocks are dense enough to have an inside
    return voxels(spark, sf).select("volume_id", *[F.expr(f"{a} div 3").cast("int").alias(a) for a in "zyx"],
                                    F.lit(1).alias("code")).distinct()


@query("border_voxels", f"""WITH {BLOCKS},
inside AS (SELECT v.*, dz, dy, dx FROM blocks v, o WHERE z + dz BETWEEN 0 AND 13 AND y + dy BETWEEN 0 AND 14 AND x + dx BETWEEN 0 AND 15)
SELECT DISTINCT i.volume_id, i.z, i.y, i.x, i.code FROM inside i LEFT JOIN blocks n
  ON n.volume_id = i.volume_id AND n.z = i.z + i.dz AND n.y = i.y + i.dy AND n.x = i.x + i.dx WHERE n.code IS NULL""")
def border_voxels(spark, sf):
    # instance borders: the volume edge itself does not erode
    return stencil.border_voxels(_blocks(spark, sf), V, "code", (14, 15, 16), full_offsets(6), False, tile=(8, 8, 8))


@query("surface_voxels", f"""WITH {BLOCKS}
SELECT DISTINCT i.volume_id, i.z, i.y, i.x, i.code FROM (SELECT v.*, dz, dy, dx FROM blocks v, o) i LEFT JOIN blocks n
  ON n.volume_id = i.volume_id AND n.z = i.z + i.dz AND n.y = i.y + i.dy AND n.x = i.x + i.dx WHERE n.code IS NULL""")
def surface_voxels(spark, sf):
    return surface.surface(_blocks(spark, sf), V, "code", (14, 15, 16), tile=(8, 8, 8))


@query("neighbour_count", f"""WITH {VOX}, o(dz, dy, dx) AS (VALUES {_offset_values(full_offsets(26))}),
s AS (SELECT volume_id, z + dz AS z, y + dy AS y, x + dx AS x, gt, COUNT(*) AS n FROM vox, o GROUP BY ALL)
SELECT volume_id, z, y, x, gt, COALESCE(n, 0) AS neighbours FROM vox LEFT JOIN s USING (volume_id, z, y, x, gt)""")
def neighbour_count(spark, sf):
    return stencil.neighbour_count(voxels(spark, sf), V, "gt", LATTICE, 26, tile=SMALL_TILE)


HEAD = stencil.box_offsets(stencil.HEAD_BOXES)


ORGANS = f"""{VOX}, organ AS (SELECT volume_id, z, y, x, intensity % 23 AS organ FROM vox)"""


def _organs(spark, sf):
    # organ 5 is the head, 0 is background
    return voxels(spark, sf).select(*PLACE, (F.col("intensity") % 23).alias("organ"))


@query("dilate", f"""WITH {ORGANS}, o(dz, dy, dx) AS (VALUES {_offset_values(HEAD)})
SELECT DISTINCT volume_id, z + dz AS z, y + dy AS y, x + dx AS x FROM organ, o
WHERE organ = 5 AND z + dz BETWEEN 0 AND 40 AND y + dy BETWEEN 0 AND 42 AND x + dx BETWEEN 0 AND 46""")
def dilate(spark, sf):
    head = _organs(spark, sf).where(F.col("organ") == 5)
    return stencil.dilate(head, V, LATTICE, stencil.HEAD_BOXES)


# n-fold growth has a closed form: |dy|,|dx| <= n, |dz| <= 3n and ceil(|dz|/3) + |dy| + |dx| <= 2n
@query("dilate_repeated", f"""WITH {ORGANS}, o AS (SELECT CAST(a - 15 AS INT) AS dz, CAST(b - 5 AS INT) AS dy, CAST(c - 5 AS INT) AS dx FROM range(31) t(a), range(11) u(b), range(11) w(c)
  WHERE (ABS(a - 15) + 2) // 3 + ABS(b - 5) + ABS(c - 5) <= 10)
SELECT DISTINCT volume_id, z + dz AS z, y + dy AS y, x + dx AS x FROM organ, o
WHERE organ = 5 AND z + dz BETWEEN 0 AND 40 AND y + dy BETWEEN 0 AND 42 AND x + dx BETWEEN 0 AND 46""")
def dilate_repeated(spark, sf):
    head = _organs(spark, sf).where(F.col("organ") == 5)
    return stencil.dilate(head, V, LATTICE, stencil.HEAD_BOXES, iterations=5, per_round=2, tile=(32, 32, 32))


@query("expand_labels", f"""WITH {ORGANS}, o AS (SELECT CAST(dz - 3 AS INT) AS dz, CAST(dy - 3 AS INT) AS dy, CAST(dx - 3 AS INT) AS dx FROM range(7) a(dz), range(7) b(dy), range(7) c(dx)
  WHERE (dz - 3) * (dz - 3) + (dy - 3) * (dy - 3) + (dx - 3) * (dx - 3) <= 9),
s AS (SELECT volume_id, z + dz AS z, y + dy AS y, x + dx AS x, (dz * dz + dy * dy + dx * dx) * 100 + organ AS near FROM organ, o WHERE organ NOT IN (0, 5))
SELECT volume_id, z, y, x, CAST(MIN(near) % 100 AS INT) AS organ FROM s WHERE z BETWEEN 0 AND 40 AND y BETWEEN 0 AND 42 AND x BETWEEN 0 AND 46 GROUP BY ALL""")
def expand_labels(spark, sf):
    return stencil.expand_labels(_organs(spark, sf).where(F.col("organ") != 5), V, "organ", LATTICE, 3, tile=SMALL_TILE)


def _complement(vox):
    sizes = {n: F.lit(int(s)) for n, s in zip(geometry.SIZES, LATTICE)}
    return free_cells(vox.select("volume_id").distinct().withColumns(sizes), vox)


# the mask is everything outside the voxels, so its holes are the closed voxel clusters
HOLES = f"""{VOX}, {component_sql('cc', 'vox', 6)},
open AS (SELECT DISTINCT volume_id, component FROM cc WHERE z IN (0, 40) OR y IN (0, 42) OR x IN (0, 46))
SELECT volume_id, z, y, x FROM cc ANTI JOIN open USING (volume_id, component)"""


@query("fill_holes", f"WITH RECURSIVE {HOLES}")
def fill_holes(spark, sf):
    return stencil.fill_holes(_complement(voxels(spark, sf).select(*PLACE)), V, LATTICE)


@query("fill_holes_tiled", f"WITH RECURSIVE {HOLES}")
def fill_holes_tiled(spark, sf):
    return stencil.fill_holes(_complement(voxels(spark, sf).select(*PLACE)), V, LATTICE, tile=(32, 32, 32))


# two modalities that cover different blocks, so that the mask needs both
CASES = f"""{VOX},
img AS (SELECT volume_id, CAST(z // 3 AS INT) AS z, CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, CASE WHEN gt = 1 THEN 0 ELSE 1 END AS modality,
  MAX(intensity) AS value FROM vox GROUP BY ALL),
seg AS (SELECT volume_id, CAST(z // 3 AS INT) AS z, CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, MAX(gt) AS label FROM vox WHERE intensity > 25 GROUP BY ALL),
mask AS (SELECT DISTINCT volume_id, z, y, x FROM img WHERE value <> 0),
free AS (SELECT v.volume_id, z, y, x FROM (SELECT DISTINCT volume_id FROM mask) v, range(14) a(z), range(15) b(y), range(16) c(x)
  EXCEPT SELECT * FROM mask),
outside AS (SELECT volume_id, z, y, x FROM free WHERE z IN (0, 13) OR y IN (0, 14) OR x IN (0, 15)
  UNION SELECT f.volume_id, f.z, f.y, f.x FROM outside o JOIN free f ON f.volume_id = o.volume_id AND ABS(f.z - o.z) + ABS(f.y - o.y) + ABS(f.x - o.x) = 1),
whole AS (SELECT * FROM mask UNION ALL (SELECT * FROM free EXCEPT SELECT * FROM outside)),
box AS (SELECT volume_id, MIN(z) AS z0, MAX(z) AS z1, MIN(y) AS y0, MAX(y) AS y1, MIN(x) AS x0, MAX(x) AS x1 FROM whole GROUP BY 1),
cell AS (SELECT volume_id, z, y, x, z0, y0, x0 FROM box, range(14) a(z), range(15) b(y), range(16) c(x)
  WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1),
dense AS (SELECT c.*, m.modality, COALESCE(i.value, 0)::DOUBLE AS v,
    CASE WHEN COALESCE(s.label, 0) = 0 AND w.volume_id IS NULL THEN -1 ELSE COALESCE(s.label, 0) END AS label
  FROM cell c CROSS JOIN (VALUES (0), (1)) m(modality)
  LEFT JOIN img i ON i.volume_id = c.volume_id AND i.z = c.z AND i.y = c.y AND i.x = c.x AND i.modality = m.modality
  LEFT JOIN seg s ON s.volume_id = c.volume_id AND s.z = c.z AND s.y = c.y AND s.x = c.x
  LEFT JOIN whole w ON w.volume_id = c.volume_id AND w.z = c.z AND w.y = c.y AND w.x = c.x)"""


def _cases(spark, sf):
    vox = voxels(spark, sf)
    block = [F.expr(f"{a} div 3").cast("int").alias(a) for a in "zyx"]
    channel = F.when(F.col("gt") == 1, 0).otherwise(1).alias("modality")
    images = vox.groupBy("volume_id", *block, channel).agg(F.max("intensity").alias("value"))
    seg = vox.where(F.col("intensity") > 25).groupBy("volume_id", *block).agg(F.max("gt").alias("label"))
    return images, seg


@query("preprocess_cases", f"""WITH RECURSIVE {CASES},
own AS (SELECT volume_id, modality, AVG(v) AS m, STDDEV_POP(v) AS s FROM dense WHERE label >= 0 GROUP BY 1, 2)
SELECT d.volume_id, CAST(z - z0 AS INT) AS z, CAST(y - y0 AS INT) AS y, CAST(x - x0 AS INT) AS x, d.modality, label,
  ROUND(CASE WHEN label < 0 THEN 0 WHEN d.modality = 0 THEN (v - m) / (s + 1e-8) ELSE (LEAST(GREATEST(v, 5), 45) - 20) / 8 END, 6) AS normalized
FROM dense d JOIN own USING (volume_id, modality)""")
def preprocess_cases(spark, sf):
    images, seg = _cases(spark, sf)
    stats = spark.createDataFrame([(1, 5.0, 45.0, 20.0, 8.0)], "modality int, p0_5 double, p99_5 double, mean double, sd double")
    return preprocessing.preprocess_cases(images, seg, V, (14, 15, 16), {0: "nonCT", 1: "CT"}, stats, use_mask=True)


@query("preprocess_unmasked", f"""WITH RECURSIVE {CASES},
own AS (SELECT volume_id, modality, AVG(v) AS m, STDDEV_POP(v) AS s FROM dense GROUP BY 1, 2)
SELECT d.volume_id, CAST(z - z0 AS INT) AS z, CAST(y - y0 AS INT) AS y, CAST(x - x0 AS INT) AS x, d.modality, label,
  ROUND(CASE WHEN d.modality = 0 THEN (v - m) / (s + 1e-8) ELSE v END, 6) AS normalized FROM dense d JOIN own USING (volume_id, modality)""")
def preprocess_unmasked(spark, sf):
    images, seg = _cases(spark, sf)
    return preprocessing.preprocess_cases(images, seg, V, (14, 15, 16), {0: "nonCT", 1: "noNorm"})


CORE = f"""{component_sql('core', 'vox', 26, where='pred = 1')},
pairs AS (SELECT b.volume_id, b.z, b.y, b.x, c.component, ABS(b.z - c.z) + ABS(b.y - c.y) + ABS(b.x - c.x) AS d
  FROM vox b JOIN core c ON c.volume_id = b.volume_id WHERE b.pred = 2)"""


@query("instance_grow", f"""WITH RECURSIVE {VOX}, {CORE}
SELECT volume_id, z, y, x, component AS instance FROM core
UNION ALL SELECT volume_id, z, y, x, MAX_BY(component, -d * 1000000 + component) AS instance FROM pairs GROUP BY ALL""")
def instance_grow(spark, sf):
    return stencil.instances_from_core_and_border(voxels(spark, sf), V, "pred", LATTICE)


REFINED = (0.2, 0.125, 0.125)


def _z_steps(spacing, reach):
    # the growth step at which the slice axis has moved 0, 1, 2, ... times
    moves = [any(o[0] for o in step) for step in stencil.growth_steps(spacing, 4 * reach)]
    return [0] + [i + 1 for i, m in enumerate(moves) if m][:reach]


@query("instance_grow_refined", f"""WITH RECURSIVE {VOX}, {component_sql('raw', 'vox', 26, where='pred = 1')},
big AS (SELECT volume_id, component FROM raw GROUP BY 1, 2 HAVING COUNT(*) > 2),
core AS (SELECT raw.* FROM raw JOIN big USING (volume_id, component)),
parts AS (SELECT v.volume_id, v.z, v.y, v.x, CASE WHEN c.component IS NULL THEN 2 ELSE 1 END AS code FROM vox v
  LEFT JOIN core c ON c.volume_id = v.volume_id AND c.z = v.z AND c.y = v.y AND c.x = v.x WHERE v.pred IN (1, 2)),
zstep(dz, k) AS (VALUES {', '.join(f'({i}, {k})' for i, k in enumerate(_z_steps(REFINED, 41)))}),
cost AS (SELECT b.volume_id, b.z, b.y, b.x, c.component, GREATEST(ABS(b.z - c.z) + ABS(b.y - c.y) + ABS(b.x - c.x), k) AS d
  FROM parts b JOIN core c ON c.volume_id = b.volume_id JOIN zstep ON dz = ABS(b.z - c.z) WHERE b.code = 2),
grown AS (SELECT volume_id, z, y, x, component AS instance FROM core
  UNION ALL SELECT volume_id, z, y, x, MAX_BY(component, -d * 1000000 + component) FROM cost GROUP BY ALL),
{component_sql('obj', 'parts', 26)},
lonely AS (SELECT o.volume_id, o.component FROM obj o JOIN parts v ON v.volume_id = o.volume_id AND v.z = o.z AND v.y = o.y AND v.x = o.x
  GROUP BY 1, 2 HAVING NOT BOOL_OR(v.code = 1) AND COUNT(*) >= 3)
SELECT g.volume_id, g.z, g.y, g.x, COALESCE(l.component, g.instance) AS instance FROM grown g
  LEFT JOIN obj o ON o.volume_id = g.volume_id AND o.z = g.z AND o.y = g.y AND o.x = g.x
  LEFT JOIN lonely l ON l.volume_id = o.volume_id AND l.component = o.component""")
def instance_grow_refined(spark, sf):
    return stencil.instances_from_core_and_border(voxels(spark, sf), V, "pred", LATTICE, REFINED,
                                                  small_core=2, isolated_border=3)


@query("isolated_border", f"""WITH RECURSIVE {VOX}, {component_sql('obj', 'vox', 26, where='pred IN (1, 2)')},
lonely AS (SELECT o.volume_id, o.component FROM obj o JOIN vox v ON v.volume_id = o.volume_id AND v.z = o.z AND v.y = o.y AND v.x = o.x
  GROUP BY 1, 2 HAVING NOT BOOL_OR(v.pred = 1) AND COUNT(*) >= 3)
SELECT volume_id, z, y, x, component AS instance FROM obj JOIN lonely USING (volume_id, component)""")
def isolated_border(spark, sf):
    parts = voxels(spark, sf).where(F.col("pred").isin(1, 2)).select(*PLACE, "pred")
    return stencil.isolated_objects(parts, V, "pred", LATTICE, 3).withColumnRenamed("_own", "instance")


SURFACE = f"""{VOX}, o(dz, dy, dx) AS (VALUES {_offset_values(full_offsets(6))}),
seg AS (SELECT volume_id, z, y, x, gt AS code, FALSE AS from_test FROM vox UNION ALL SELECT volume_id, z, y, x, pred, TRUE FROM vox WHERE pred > 0),
surf AS (SELECT DISTINCT s.* FROM (SELECT seg.*, dz, dy, dx FROM seg, o) s LEFT JOIN seg n
  ON n.volume_id = s.volume_id AND n.from_test = s.from_test AND n.z = s.z + s.dz AND n.y = s.y + s.dy AND n.x = s.x + s.dx AND n.code = s.code WHERE n.code IS NULL),
surfaces AS (SELECT volume_id, code, from_test, z, y, x FROM surf GROUP BY ALL),
near AS (SELECT a.volume_id, a.code, a.from_test, a.z, a.y, a.x, SQRT(MIN((a.z - b.z) * (a.z - b.z) * 4 + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS distance
  FROM surfaces a JOIN surfaces b ON a.volume_id = b.volume_id AND a.code = b.code AND a.from_test <> b.from_test GROUP BY ALL)"""


def _staged(spark, sf):
    # both sides of a comparison read the voxels: they are grouped once
    return materialize(voxels(spark, sf).select(*PLACE, "gt", "pred"))


def _counts(vox):
    ref = surface.surface(vox.select(*PLACE, F.col("gt").alias("code")), V, "code", LATTICE)
    test = surface.surface(vox.where(F.col("pred") > 0).select(*PLACE, F.col("pred").alias("code")), V, "code", LATTICE)
    return surface.distance_counts(test, ref, ["volume_id", "code"], LATTICE, (2.0, 1.0, 1.0))


@query("surface_distance", f"""WITH {SURFACE}
SELECT volume_id, code, ROUND(MAX(distance), 6) AS hd, ROUND(QUANTILE_CONT(distance, 0.95), 6) AS hd95,
  ROUND(AVG(CASE WHEN from_test THEN distance END), 6) AS asd,
  ROUND((AVG(CASE WHEN from_test THEN distance END) + AVG(CASE WHEN NOT from_test THEN distance END)) / 2, 6) AS assd FROM near GROUP BY 1, 2""")
def surface_distance(spark, sf):
    return surface.distance_metrics(_counts(_staged(spark, sf)), ["volume_id", "code"])


@query("surface_dice", f"""WITH {SURFACE}
SELECT volume_id, code, ROUND((AVG(CASE WHEN from_test THEN CAST(distance <= 1 AS INT) END) + AVG(CASE WHEN NOT from_test THEN CAST(distance <= 1 AS INT) END)) / (2 + 1e-8), 6) AS surface_dice
FROM near GROUP BY 1, 2""")
def surface_dice(spark, sf):
    return surface.surface_dice(_counts(_staged(spark, sf)), ["volume_id", "code"], 1.0)




@query("surface_metric_table", f"""WITH {SURFACE}, m AS (SELECT volume_id, code, MAX(distance) AS hd, QUANTILE_CONT(distance, 0.95) AS hd95, AVG(CASE WHEN from_test THEN distance END) AS asd,
  (AVG(CASE WHEN from_test THEN distance END) + AVG(CASE WHEN NOT from_test THEN distance END)) / 2 AS assd FROM near GROUP BY 1, 2),
labels(code) AS (VALUES (1), (2), (3), (4)), present AS (SELECT v.volume_id, code, COUNT(CASE WHEN gt = code THEN 1 END) AS g, COUNT(CASE WHEN pred = code THEN 1 END) AS p FROM vox v, labels GROUP BY 1, 2),
j AS (SELECT p.*, hd, hd95, asd, assd FROM present p LEFT JOIN m ON m.volume_id = p.volume_id AND m.code = p.code)
SELECT volume_id, code, 'Hausdorff Distance' AS metric, ROUND(hd, 6) AS value FROM j UNION ALL SELECT volume_id, code, 'Hausdorff Distance 95', ROUND(hd95, 6) FROM j
UNION ALL SELECT volume_id, code, 'Avg. Surface Distance', ROUND(asd, 6) FROM j UNION ALL SELECT volume_id, code, 'Avg. Symmetric Surface Distance', ROUND(assd, 6) FROM j
UNION ALL SELECT volume_id, code, 'hd95 with sentinel', CASE WHEN g = 0 AND p = 0 THEN 0.0 WHEN g = 0 OR p = 0 THEN 373.12866 ELSE ROUND(hd95, 6) END FROM j""")
def surface_metric_table(spark, sf):
    vox = _staged(spark, sf)
    pairs = evaluate.pair_counts(vox.where(F.col("gt") > 0), vox.where(F.col("pred") > 0), V, "gt", "pred")
    flags = (evaluate.confusion(pairs, V, {str(c): [c] for c in (1, 2, 3, 4)}, CELLS)
             .withColumn("code", F.col("label").cast("int")))
    key = ["volume_id", "code"]
    metrics = materialize(surface.distance_metrics(_counts(vox), key))
    plain = surface.with_empty_masks(metrics, flags, key)
    kept = surface.with_empty_masks(metrics, flags, key, sentinel=True)
    return surface.metric_rows(plain, key).unionByName(kept.select(
        *key, F.lit("hd95 with sentinel").alias("metric"), F.col("hd95").alias("value")))


REGION_SURFACE = f"""{VOX}, o(dz, dy, dx) AS (VALUES {_offset_values(full_offsets(6))}),
reg(code, lo) AS (VALUES (0, 1), (1, 2), (2, 3)),
seg AS (SELECT volume_id, z, y, x, code, FALSE AS from_test FROM vox, reg WHERE gt >= lo UNION ALL SELECT volume_id, z, y, x, code, TRUE FROM vox, reg WHERE pred >= lo),
surf AS (SELECT DISTINCT s.volume_id, s.code, s.from_test, s.z, s.y, s.x FROM (SELECT seg.*, dz, dy, dx FROM seg, o) s LEFT JOIN seg n
  ON n.volume_id = s.volume_id AND n.from_test = s.from_test AND n.code = s.code AND n.z = s.z + s.dz AND n.y = s.y + s.dy AND n.x = s.x + s.dx WHERE n.code IS NULL),
near AS (SELECT a.volume_id, a.code, a.from_test, a.z, a.y, a.x, SQRT(MIN((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS distance
  FROM surf a JOIN surf b ON a.volume_id = b.volume_id AND a.code = b.code AND a.from_test <> b.from_test GROUP BY ALL)"""


@query("region_case_table", f"""WITH {REGION_SURFACE}, h AS (SELECT volume_id, code, ROUND(QUANTILE_CONT(distance, 0.95), 6) AS hd95 FROM near GROUP BY 1, 2),
d AS (SELECT volume_id, code, ROUND(CAST(2 * COUNT(CASE WHEN gt >= lo AND pred >= lo THEN 1 END) AS DOUBLE) / (COUNT(CASE WHEN gt >= lo THEN 1 END) + COUNT(CASE WHEN pred >= lo THEN 1 END)), 6) AS dice FROM vox, reg GROUP BY 1, 2)
SELECT volume_id, CASE code WHEN 0 THEN 'whole' WHEN 1 THEN 'core' ELSE 'enh' END AS region, dice, hd95 FROM d JOIN h USING (volume_id, code)""")
def region_case_table(spark, sf):
    regions = {"whole": [1, 2, 3], "core": [2, 3], "enh": [3]}
    vox = _staged(spark, sf)
    pairs = evaluate.pair_counts(vox.where(F.col("gt") > 0), vox.where(F.col("pred") > 0), V, "gt", "pred")
    counts = evaluate.confusion(pairs, V, regions, CELLS).withColumnRenamed("label", "region")
    dice = counts.withColumn("dice", F.round(evaluate.dice_with_policy("lenient"), 6))

    def outline(column):
        member = F.array(*[F.when(F.col(column).isin(codes), F.lit(r)) for r, codes in regions.items()])
        rows = vox.select(*PLACE, F.explode(F.array_compact(member)).alias("region"), F.lit(1).alias("code"))
        return surface.surface(rows, ["volume_id", "region"], "code", LATTICE)
    key = ["volume_id", "region"]
    metrics = surface.distance_metrics(surface.distance_counts(outline("pred"), outline("gt"), key, LATTICE), key)
    hd = surface.with_empty_masks(metrics, dice, key, sentinel=True)
    return dice.select(*key, "dice").join(hd, key)
