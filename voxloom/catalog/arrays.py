"""Intensity statistics, normalization, resampling and tiling queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxloom.bindings import CELLS, LATTICE, PROB, VOX, probabilities, table, voxel_tasks, voxels
from voxloom.catalog import query
from voxloom.operators import intensity, masking, resample, tiles
from voxloom.plans import export
from voxloom.plans.preprocessing import fingerprint_table
from voxloom.plans.quantification import nerve_quantification
from voxloom.support import materialize

V = ["volume_id"]
PLACE = ["volume_id", "z", "y", "x"]

MODAL = f"""{VOX}, modal AS MATERIALIZED (SELECT volume_id, z, y, x, gt, 0 AS modality, intensity AS value FROM vox
UNION ALL SELECT volume_id, z, y, x, gt, 1, intensity * gt FROM vox)"""
STATS = """ROUND(QUANTILE_CONT(value, 0.5), 6) AS median, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_POP(value), 6) AS sd,
CAST(MIN(value) AS DOUBLE) AS min, CAST(MAX(value) AS DOUBLE) AS max,
ROUND(QUANTILE_CONT(value, 0.995), 6) AS p99_5, ROUND(QUANTILE_CONT(value, 0.005), 6) AS p0_5"""


def _modal(spark, sf):
    channels = F.explode(F.array(F.struct(F.lit(0).alias("modality"), F.col("intensity").alias("value")),
                                 F.struct(F.lit(1).alias("modality"), (F.col("intensity") * F.col("gt")).alias("value")))).alias("c")
    return voxels(spark, sf).select(*PLACE, "gt", channels).select(*PLACE, "gt", "c.modality", "c.value")


@query("intensity_fingerprint", f"""WITH {MODAL}, fg AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id, modality ORDER BY z, y, x) - 1 AS r
  FROM modal WHERE gt > 0), s AS (SELECT * FROM fg WHERE r % 10 = 0)
SELECT volume_id, modality, {STATS} FROM s GROUP BY GROUPING SETS ((volume_id, modality), (modality))""")
def intensity_fingerprint(spark, sf):
    return intensity.fingerprint(_modal(spark, sf), "volume_id", "modality", "value", F.col("gt") > 0)


@query("intensity_envelope", f"""WITH {VOX}, s AS (SELECT volume_id, z, QUANTILE_CONT(intensity, 0.02) AS lo, QUANTILE_CONT(intensity, 0.98) AS hi
FROM vox WHERE intensity <> 0 GROUP BY 1, 2)
SELECT volume_id, ROUND(LEAST(65535.0::DOUBLE, MIN(lo)), 6) AS low, ROUND(GREATEST(0.0::DOUBLE, MAX(hi)), 6) AS high FROM s GROUP BY 1""")
def intensity_envelope(spark, sf):
    return intensity.envelope(voxels(spark, sf), V, "z", "intensity", 2)


@query("crop_ratio", f"""WITH {VOX}, b AS (SELECT volume_id, ROUND((MAX(z) + 1 - MIN(z)) * (MAX(y) + 1 - MIN(y)) * (MAX(x) + 1 - MIN(x)) / {CELLS}.0::DOUBLE, 6) AS ratio
FROM vox WHERE intensity > 48 AND pred = 3 GROUP BY 1),
m AS (SELECT ROUND(MEDIAN(ratio), 6) AS median_ratio FROM b)
SELECT volume_id, ratio, median_ratio, median_ratio < 0.75 AS use_mask FROM b, m""")
def crop_ratio(spark, sf):
    boxes = masking.bounding_box(voxels(spark, sf), V, (F.col("intensity") > 48) & (F.col("pred") == 3))
    ratios = materialize(intensity.crop_ratio(boxes, CELLS).select("volume_id", "ratio", F.lit("all").alias("g")))
    decision = intensity.use_mask_for_norm(ratios).withColumn("g", F.lit("all"))
    return ratios.join(materialize(decision), "g").drop("g")


CASES = """cases AS (SELECT c_mktsegment AS dataset, 2.0::DOUBLE + c_custkey % 7 AS sz, (5 + c_nationkey % 4) / 10.0::DOUBLE AS sy,
(5 + c_nationkey % 3) / 10.0::DOUBLE AS sx, 20 + c_custkey % 13 AS nz, 200 + c_custkey % 17 AS ny, 220 + c_custkey % 11 AS nx FROM customer)"""


def _cases(spark, sf):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("dataset"),
        F.array(F.lit(2.0) + c % 7, (5 + n % 4) / F.lit(10.0), (5 + n % 3) / F.lit(10.0)).alias("spacing"),
        F.array(20 + c % 13, 200 + c % 17, 220 + c % 11).alias("size"))


@query("target_spacing", f"""WITH {CASES}, t AS (SELECT dataset, QUANTILE_CONT(sz, 0.5) AS a, QUANTILE_CONT(sy, 0.5) AS b, QUANTILE_CONT(sx, 0.5) AS c,
  QUANTILE_CONT(nz, 0.5) AS d, QUANTILE_CONT(ny, 0.5) AS e, QUANTILE_CONT(nx, 0.5) AS f, QUANTILE_CONT(sz, 0.1) AS low FROM cases GROUP BY 1)
SELECT dataset, ROUND(CASE WHEN a > 3 * GREATEST(b, c) AND d * 3 < LEAST(e, f)
  THEN CASE WHEN low < GREATEST(b, c) THEN GREATEST(b, c) + 1e-5 ELSE low END ELSE a END, 6) AS spacing_z,
  ROUND(b, 6) AS spacing_y, ROUND(c, 6) AS spacing_x FROM t""")
def target_spacing(spark, sf):
    return intensity.target_spacing(_cases(spark, sf), ["dataset"])


FG = f"""{MODAL}, fgr AS (SELECT modality, value, ROW_NUMBER() OVER (PARTITION BY volume_id, modality ORDER BY z, y, x) - 1 AS r FROM modal WHERE gt > 0),
st AS MATERIALIZED (SELECT modality, {STATS} FROM fgr WHERE r % 10 = 0 GROUP BY 1)"""


@query("normalize_ct", f"""WITH {FG}
SELECT volume_id, z, y, x, modality, ROUND((LEAST(GREATEST(value, p0_5), p99_5) - mean) / sd, 6) AS normalized FROM modal JOIN st USING (modality)""")
def normalize_ct(spark, sf):
    rows = _modal(spark, sf)
    stats = fingerprint_table(rows, "volume_id", "modality", "value", "gt")
    return intensity.normalize_ct(rows, stats, ["modality"], "value", staged=True).drop("value", "gt")


@query("normalize_ct2", f"""WITH {FG}, b AS (SELECT volume_id, z, y, x, modality, value, p0_5, p99_5 FROM modal JOIN st USING (modality)),
c AS (SELECT volume_id, modality, AVG(value) AS m, STDDEV_POP(value) AS s FROM b WHERE value > p0_5 AND value < p99_5 GROUP BY 1, 2)
SELECT volume_id, z, y, x, modality, ROUND((LEAST(GREATEST(value, p0_5), p99_5) - m) / s, 6) AS normalized FROM b JOIN c USING (volume_id, modality)""")
def normalize_ct2(spark, sf):
    rows = _modal(spark, sf)
    stats = fingerprint_table(rows, "volume_id", "modality", "value", "gt")
    return intensity.normalize_ct2(rows, stats, ["modality"], ["volume_id", "modality"], "value", staged=True).drop("value", "gt")


@query("normalize_z", f"""WITH {VOX}, s AS (SELECT volume_id, AVG(intensity) AS m, STDDEV_POP(intensity) AS s FROM vox WHERE pred > 0 GROUP BY 1)
SELECT volume_id, z, y, x, ROUND(CASE WHEN pred > 0 THEN (intensity - m) / (s + 1e-8) ELSE 0 END, 6) AS normalized FROM vox JOIN s USING (volume_id)""")
def normalize_z(spark, sf):
    rows = voxels(spark, sf).select(*PLACE, "intensity", "pred")
    return intensity.normalize_z(rows, V, "intensity", F.col("pred") > 0).drop("intensity", "pred")


@query("minmax_normalize", f"""WITH {VOX}
SELECT volume_id, z, y, x, ROUND((LEAST(GREATEST(intensity, 5.0), 40.0) - 5.0) / 35.0::DOUBLE, 6) AS value FROM vox""")
def minmax_normalize(spark, sf):
    return voxels(spark, sf).select(*PLACE, F.round(tiles.minmax_normalize(F.col("intensity"), 5.0, 40.0), 6).alias("value"))


@query("rgb_scale", f"WITH {VOX} SELECT volume_id, z, y, x, ROUND(intensity * 5 / 255.0::DOUBLE, 6) AS value FROM vox")
def rgb_scale(spark, sf):
    return voxels(spark, sf).select(*PLACE, F.round(intensity.rgb_scale(F.col("intensity") * 5), 6).alias("value"))


@query("norm_scheme", """SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'CT' WHEN 1 THEN 'noNorm' WHEN 2 THEN 'nonCT' ELSE 'CT2' END AS scheme FROM customer""")
def norm_scheme(spark, sf):
    name = F.array(*[F.lit(n) for n in ("CT", "noNorm", "T1", "ct2")])[F.col("c_nationkey") % 4]
    return table(spark, sf, "customer").select("c_custkey", intensity.normalization_scheme(name).alias("scheme"))


@query("resample_shape", """SELECT c_custkey, CAST(ROUND_EVEN((2.0::DOUBLE + c_custkey % 7) / 1.5 * (20 + c_custkey % 13), 0) AS INT) AS nz,
CAST(ROUND_EVEN((5 + c_nationkey % 4) / 10.0::DOUBLE / 0.75 * (200 + c_custkey % 17), 0) AS INT) AS ny,
CAST(ROUND_EVEN((5 + c_nationkey % 3) / 10.0::DOUBLE / 0.75 * (220 + c_custkey % 11), 0) AS INT) AS nx,
CASE WHEN (2.0::DOUBLE + c_custkey % 7) / LEAST((5 + c_nationkey % 4) / 10.0::DOUBLE, (5 + c_nationkey % 3) / 10.0::DOUBLE) > 3 THEN 0 END AS separate_axis
FROM customer""")
def resample_shape(spark, sf):
    target = F.array(F.lit(1.5), F.lit(0.75), F.lit(0.75))
    shape = resample.new_shape(F.col("size"), F.col("spacing"), target)
    return _cases(spark, sf).select(
        "c_custkey", shape.alias("s"), resample.separate_axis(F.col("spacing"), target).alias("separate_axis")).select(
        "c_custkey", *[F.get("s", F.lit(i)).alias(n) for i, n in enumerate(("nz", "ny", "nx"))], "separate_axis")


def _grid_sql(name, old, new):
    return (f"{name} AS (SELECT CAST(i AS INT) AS i, LEAST(GREATEST((i + 0.5::DOUBLE) * ({old}::DOUBLE / {new}) - 0.5::DOUBLE, 0), {old - 1}) AS c "
            f"FROM range({new}) t(i))")


RESAMPLED = (20, 60, 47)
GRIDS = ", ".join([_grid_sql("gz", 41, 20), _grid_sql("gy", 43, 60)])


@query("resample_nearest", f"""WITH {VOX}, {GRIDS}
SELECT volume_id, gz.i AS z, gy.i AS y, x, intensity FROM vox JOIN gz ON ROUND_EVEN(gz.c, 0) = z JOIN gy ON ROUND_EVEN(gy.c, 0) = y""")
def resample_nearest(spark, sf):
    return resample.resample_nearest(voxels(spark, sf).select(*PLACE, "intensity"), LATTICE, RESAMPLED)


@query("resample_linear", f"""WITH {VOX}, {GRIDS}
SELECT volume_id, gz.i AS z, gy.i AS y, x, ROUND(SUM(intensity * (1 - ABS(gz.c - z)) * (1 - ABS(gy.c - y))), 7) AS intensity
FROM vox JOIN gz ON ABS(gz.c - z) < 1 JOIN gy ON ABS(gy.c - y) < 1 GROUP BY 1, 2, 3, 4""")
def resample_linear(spark, sf):
    out = resample.resample_linear(voxels(spark, sf).select(*PLACE, F.col("intensity").cast("double").alias("intensity")),
                                   V, "intensity", LATTICE, RESAMPLED)
    return out.withColumn("intensity", F.round("intensity", 7))


@query("resample_cubic")
def resample_cubic(spark, sf):
    rows = voxels(spark, sf).select(*PLACE, F.col("intensity").cast("double").alias("intensity"))
    out = resample.resample_cubic(rows, V, "intensity", LATTICE, RESAMPLED)
    return out.withColumn("intensity", F.round("intensity", 6))


SEG = f"""{VOX}, {GRIDS}, cover AS (SELECT volume_id, gz.i AS z, gy.i AS y, x, gt,
  ROUND(SUM((1 - ABS(gz.c - z)) * (1 - ABS(gy.c - y))), 9) AS w
FROM vox JOIN gz ON ABS(gz.c - z) < 1 JOIN gy ON ABS(gy.c - y) < 1 GROUP BY 1, 2, 3, 4, 5)"""


@query("resample_labels", f"WITH {SEG} SELECT volume_id, z, y, x, MAX(gt) AS gt FROM cover WHERE w >= 0.5 GROUP BY 1, 2, 3, 4")
def resample_labels(spark, sf):
    return resample.resample_labels(voxels(spark, sf).select(*PLACE, "gt"), V, "gt", LATTICE, RESAMPLED)


@query("upsample_labels", f"""WITH {VOX}, {_grid_sql("gy", 43, 86)}, {_grid_sql("gx", 47, 141)},
cover AS (SELECT volume_id, z, gy.i AS y, gx.i AS x, gt, ROUND(SUM((1 - ABS(gx.c - x)) * (1 - ABS(gy.c - y))), 9) AS w
FROM vox JOIN gx ON ABS(gx.c - x) < 1 JOIN gy ON ABS(gy.c - y) < 1 GROUP BY 1, 2, 3, 4, 5)
SELECT volume_id, z, y, x, MIN(gt) AS gt FROM cover WHERE w >= 0.5 GROUP BY 1, 2, 3, 4""")
def upsample_labels(spark, sf):
    return resample.resample_labels(voxels(spark, sf).select(*PLACE, "gt"), V, "gt", LATTICE, (41, 86, 141), first_wins=True)


@query("avg_pool", f"""WITH {VOX}, w AS (SELECT volume_id, CAST(z // 2 AS INT) AS z, CAST((y + 1) // 4 AS INT) AS y, CAST((x + 1) // 4 AS INT) AS x, gt, COUNT(*) AS n
  FROM vox GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT *, (LEAST(2 * z + 2, 41) - 2 * z) * (LEAST(4 * y + 3, 43) - GREATEST(4 * y - 1, 0)) * (LEAST(4 * x + 3, 47) - GREATEST(4 * x - 1, 0)) AS cells FROM w)
SELECT volume_id, z, y, x, gt, ROUND(n / CAST(cells AS DOUBLE), 6) AS share FROM s
WHERE z < (41 - 2) // 2 + 1 AND y < (43 + 2 - 4) // 4 + 1 AND x < (47 + 2 - 4) // 4 + 1""")
def avg_pool(spark, sf):
    return resample.average_pool(voxels(spark, sf), V, "gt", (2, 4, 4), LATTICE)


# two class scores per voxel, on the resampling grid of the network, and where each case was cropped
EXPORT = f"""{VOX}, {GRIDS}, scores AS (SELECT volume_id, z, y, x, gt AS class, intensity / 50.0::DOUBLE AS p FROM vox
  UNION ALL SELECT volume_id, z, y, x, gt % 3, (50 - intensity) / 60.0::DOUBLE FROM vox WHERE intensity < 50),
dense AS (SELECT volume_id, gz.i AS z, gy.i AS y, x, class, ROUND(SUM(p * (1 - ABS(gz.c - z)) * (1 - ABS(gy.c - y))), 9) AS p
  FROM scores JOIN gz ON ABS(gz.c - z) < 1 JOIN gy ON ABS(gy.c - y) < 1 GROUP BY 1, 2, 3, 4, 5)"""


def _scores_and_boxes(spark, sf):
    vox = voxels(spark, sf).select(*PLACE, "gt", "intensity")
    first = vox.select(*PLACE, F.col("gt").alias("class"), (F.col("intensity") / F.lit(50.0)).alias("p"))
    second = vox.where(F.col("intensity") < 50).select(
        *PLACE, (F.col("gt") % 3).alias("class"), ((50 - F.col("intensity")) / F.lit(60.0)).alias("p"))
    boxes = vox.select("volume_id").distinct().select(
        "volume_id", (F.col("volume_id") % 5).cast("int").alias("z0"), F.lit(2).alias("y0"), F.lit(1).alias("x0"))
    return first.unionByName(second), boxes


@query("segmentation_export", f"""WITH {EXPORT},
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id, z, y, x ORDER BY p DESC, class) AS r FROM dense)
SELECT volume_id, CAST(z + volume_id % 5 AS INT) AS z, CAST(y + 2 AS INT) AS y, CAST(x + 1 AS INT) AS x, class AS label
FROM best WHERE r = 1 AND class <> 0 AND NOT (class = 2 AND x < 20)""")
def segmentation_export(spark, sf):
    scores, boxes = _scores_and_boxes(spark, sf)
    return export.export_segmentation(scores, V, LATTICE, RESAMPLED, boxes, postprocess=lambda labels: labels.where(
        (F.col("label") != 2) | (F.col("x") >= 20)))


@query("region_export", f"""WITH {EXPORT},
painted AS (SELECT volume_id, z, y, x, COALESCE(MAX_BY(CASE class WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 7 END, CASE WHEN p > 0.5 THEN class END), 0) AS label
  FROM dense GROUP BY 1, 2, 3, 4)
SELECT volume_id, CAST(z + volume_id % 5 AS INT) AS z, CAST(y + 2 AS INT) AS y, CAST(x + 1 AS INT) AS x, label FROM painted WHERE label <> 0""")
def region_export(spark, sf):
    scores, boxes = _scores_and_boxes(spark, sf)
    return export.export_segmentation(scores, V, LATTICE, RESAMPLED, boxes, regions=(1, 2, 4, 7))


@query("pad_shape", """SELECT p_partkey, CAST(CEIL(p_size / POW(2, p_partkey % 6)) * POW(2, p_partkey % 6) AS INT) AS padded,
CAST(LENGTH(BIN((64 + p_partkey % 200) // 4)) - 1 AS INT) AS pools FROM part""")
def pad_shape(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", resample.pad_to_multiple(F.col("p_size"), F.pow(F.lit(2.0), F.col("p_partkey") % 6)).alias("padded"),
        resample.pool_count(64 + F.col("p_partkey") % 200).alias("pools"))


@query("rotated_extent", """WITH r AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 90 AS DOUBLE) AS b, CAST(32 + p_partkey % 17 AS DOUBLE) AS c FROM part),
k AS (SELECT *, SIN(0.5::DOUBLE) AS s, COS(0.5::DOUBLE) AS k FROM r)
SELECT p_partkey, CAST(FLOOR(GREATEST(a, ABS(a * k - c * s), ABS(a * k + b * s)) / 0.85::DOUBLE) AS INT) AS nz,
CAST(FLOOR(GREATEST(b, ABS(b * k + c * s), ABS(b * k - a * s)) / 0.85::DOUBLE) AS INT) AS ny,
CAST(FLOOR(GREATEST(c, ABS(c * k - b * s), ABS(a * s + c * k)) / 0.85::DOUBLE) AS INT) AS nx FROM k""")
def rotated_extent(spark, sf):
    p = F.col("p_partkey")
    extent = resample.rotated_extent([F.col("p_size"), p % 90, 32 + p % 17], (0.5, 0.5, 0.5), 0.85)
    return table(spark, sf, "part").select("p_partkey", *[e.alias(n) for e, n in zip(extent, ("nz", "ny", "nx"))])


@query("tile_steps", """WITH r AS (SELECT p_partkey, 64 + p_partkey % 200 AS image, 16 + p_size % 40 AS patch, CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS step FROM part),
n AS (SELECT *, CAST(CEIL((image - patch) / (patch * step)) + 1 AS INT) AS n FROM r),
i AS (SELECT *, UNNEST(range(n)) AS i FROM n)
SELECT p_partkey, CAST(i AS INT) AS i, CAST(ROUND_EVEN(i * CASE WHEN n > 1 THEN (image - patch) / CAST(n - 1 AS DOUBLE) ELSE 0 END, 0) AS INT) AS start FROM i""")
def tile_steps(spark, sf):
    p = F.col("p_partkey")
    starts = tiles.window_starts_column(64 + p % 200, 16 + F.col("p_size") % 40, F.when(p % 3 == 0, 1.0).otherwise(0.5))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(starts).alias("i", "start"))


@query("scan_interval", """SELECT p_partkey, CASE WHEN p_size = 1 + p_partkey % 50 THEN p_size
ELSE GREATEST(CAST(FLOOR(p_size * (1 - (p_partkey % 10) / 10.0::DOUBLE)) AS INT), 1) END AS stride FROM part""")
def scan_interval(spark, sf):
    p = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", tiles.scan_interval(
        1 + p % 50, F.col("p_size"), (p % 10) / F.lit(10.0)).alias("stride"))


@query("tile_skip", f"""WITH {VOX}
SELECT volume_id, CAST(z // 8 AS INT) AS tz, CAST(y // 8 AS INT) AS ty, CAST(x // 8 AS INT) AS tx, MAX(intensity) AS tile_max, COUNT(*) AS voxels
FROM vox GROUP BY 1, 2, 3, 4 HAVING MAX(intensity) > 40""")
def tile_skip(spark, sf):
    tiled = voxels(spark, sf).withColumns({f"t{a}": F.expr(f"{a} div 8").cast("int") for a in "zyx"})
    return tiles.skip_empty_tiles(tiled, ["volume_id", "tz", "ty", "tx"], "intensity", 40)


PATCH = (16, 16, 16)
STARTS = [tiles.window_starts(n, p, 0.5) for n, p in zip(LATTICE, PATCH)]


def _windows_sql(name, size):
    # as many windows of 16 as half steps of 8 need, evenly spread up to the last possible start
    count = f"CAST(CEIL(({size} - 16) / 8.0::DOUBLE) AS INT)"
    return f"{name} AS (SELECT i AS w, CAST(ROUND_EVEN(({size} - 16) / CAST({count} AS DOUBLE) * i, 0) AS INT) AS s FROM range({count} + 1) t(i))"


TILED = f"""{VOX}, {', '.join(_windows_sql(n, s) for n, s in zip(('wz', 'wy', 'wx'), LATTICE))},
tiled AS (SELECT volume_id, z, y, x, intensity, wz.w AS w0, wy.w AS w1, wx.w AS w2, z - wz.s AS o0, y - wy.s AS o1, x - wx.s AS o2
FROM vox JOIN wz ON z >= wz.s AND z < wz.s + 16 JOIN wy ON y >= wy.s AND y < wy.s + 16 JOIN wx ON x >= wx.s AND x < wx.s + 16)"""


def _tiled(spark, sf, lists=False):
    return tiles.assign_windows(voxels(spark, sf).select(*PLACE, "intensity"), STARTS, PATCH, lists)


@query("tile_stitch", f"""WITH {TILED}
SELECT volume_id, z, y, x, ROUND(AVG((intensity + (w0 + w1 + w2) % 3) / 53.0::DOUBLE), 6) AS p, COUNT(*) AS windows FROM tiled GROUP BY 1, 2, 3, 4""")
def tile_stitch(spark, sf):
    scored = _tiled(spark, sf).withColumn(
        "p", (F.col("intensity") + (F.col("w0") + F.col("w1") + F.col("w2")) % 3) / F.lit(53.0))
    return tiles.stitch(scored, V, "p").withColumn("p", F.round("p", 6))


@query("tile_stitch_gaussian", f"""WITH {TILED}, g AS (SELECT *, EXP(-(POW((o0 - 8) / 2.0::DOUBLE, 2) + POW((o1 - 8) / 2.0::DOUBLE, 2) + POW((o2 - 8) / 2.0::DOUBLE, 2)) / 2) AS w,
  (intensity + (w0 + w1 + w2) % 3) / 53.0::DOUBLE AS p FROM tiled)
SELECT volume_id, z, y, x, ROUND(SUM(p * w) / SUM(w), 6) AS p, COUNT(*) AS windows FROM g GROUP BY 1, 2, 3, 4""")
def tile_stitch_gaussian(spark, sf):
    scored = _tiled(spark, sf).withColumn(
        "p", (F.col("intensity") + (F.col("w0") + F.col("w1") + F.col("w2")) % 3) / F.lit(53.0))
    offset = [F.col(a) - F.array(*[F.lit(s) for s in STARTS[i]])[F.col(f"w{i}")] for i, a in enumerate("zyx")]
    weight = tiles.gaussian_importance(offset, PATCH)
    return tiles.stitch(scored, V, "p", weight).withColumn("p", F.round("p", 6))


@query("binarize", f"""WITH {TILED}, s AS (SELECT volume_id, z, y, x, AVG((intensity + (w0 + w1 + w2) % 3) / 53.0::DOUBLE) AS p FROM tiled GROUP BY 1, 2, 3, 4)
SELECT volume_id, z, y, x, CASE WHEN ROUND(p, 6) >= 0.5 THEN 1 ELSE 0 END AS mask FROM s""")
def binarize(spark, sf):
    return tile_stitch(spark, sf).select(*PLACE, tiles.binarize(F.col("p")).alias("mask"))


@query("argmax_class", f"""WITH {PROB}
SELECT model, voxel, class, p FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model, voxel ORDER BY p DESC, class) AS r FROM prob) WHERE r = 1""")
def argmax_class(spark, sf):
    return tiles.argmax_class(probabilities(spark, sf), ["model", "voxel"])


@query("region_paint", f"""WITH {PROB}, r AS (SELECT model, voxel, class % 3 AS region, 1 / (1 + EXP(-10 * AVG(CAST(p AS DOUBLE)))) AS p FROM prob GROUP BY 1, 2, 3)
SELECT model, voxel, COALESCE(MAX_BY(CASE region WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END, CASE WHEN p > 0.5 THEN region END), 0) AS label FROM r GROUP BY 1, 2""")
def region_paint(spark, sf):
    # every third channel belongs to the same region; a region's score is the mean of its channels
    prob = probabilities(spark, sf).groupBy("model", "voxel", (F.col("class") % 3).alias("region")).agg(
        (1 / (1 + F.exp(-10 * F.avg(F.col("p").cast("double"))))).alias("p"))
    return tiles.region_paint(prob, ["model", "voxel"], "region", "p", (1, 2, 4))


@query("softmax", f"""WITH {PROB}, e AS (SELECT model, voxel, class, EXP(CAST(p AS DOUBLE) - MAX(CAST(p AS DOUBLE)) OVER (PARTITION BY model, voxel)) AS e FROM prob)
SELECT model, voxel, class, ROUND(e / SUM(e) OVER (PARTITION BY model, voxel), 6) AS p FROM e""")
def softmax(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 2).alias("model"), F.expr("vec_id div 2").alias("voxel"), "embedding")
    return tiles.softmax(rows, ["model", "voxel"], "embedding").withColumn("p", F.round("p", 6))


@query("mirror_mean", f"""WITH {VOX}
SELECT volume_id, z, y, x, ROUND(intensity + (x * x + (46 - x) * (46 - x)) / 200.0::DOUBLE + (y * y + (42 - y) * (42 - y)) / 100.0::DOUBLE
  + (z * z + (40 - z) * (40 - z)) / 40.0::DOUBLE, 6) AS p FROM vox""")
def mirror_mean(spark, sf):
    # a predictor that is curved along every axis, so that each mirroring matters
    rows = voxels(spark, sf).select(*PLACE, F.col("intensity").cast("double").alias("p"))
    out = tiles.mirrored_mean(rows, V, "p", LATTICE, lambda df: df.withColumn(
        "p", F.col("p") + sum(F.col(a) * F.col(a) / F.lit(d) for a, d in (("x", 100.0), ("y", 50.0), ("z", 20.0)))))
    return out.withColumn("p", F.round("p", 6))


@query("tiled_prediction", f"""WITH {TILED}, m AS (SELECT *, AVG(intensity) OVER (PARTITION BY volume_id, w0, w1, w2) AS mean FROM tiled)
SELECT volume_id, z, y, x, ROUND(AVG(CASE WHEN intensity > mean THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END), 6) AS p, COUNT(*) AS windows FROM m GROUP BY 1, 2, 3, 4""")
def tiled_prediction(spark, sf):
    def above_mean(window, tile):
        values = tile["intensity"]
        known = values[~np.isnan(values)]
        mean = known.mean() if len(known) else np.nan
        return np.arange(len(values)), {"p": (values > mean) * 0.75 + 0.25}
    predicted = tiles.predict_tiles(_tiled(spark, sf, lists=True), above_mean,
                                    "volume_id long, z int, y int, x int, w0 int, w1 int, w2 int, p double",
                                    ["volume_id", "w0", "w1", "w2"], voxel_tasks(spark, sf))
    return tiles.stitch(predicted, V, "p").withColumn("p", F.round("p", 6))


@query("nerve_report", f"""WITH {TILED}, s AS (SELECT volume_id, z, y, x, AVG((intensity + (w0 + w1 + w2) % 3) / 53.0::DOUBLE) AS p FROM tiled GROUP BY 1, 2, 3, 4)
SELECT v.volume_id, v.gt AS label, COUNT(*) AS label_n, COUNT(CASE WHEN ROUND(s.p, 6) >= 0.5 THEN 1 END) AS nerve_label_n,
  ROUND(COUNT(CASE WHEN ROUND(s.p, 6) >= 0.5 THEN 1 END) / CAST(COUNT(*) AS DOUBLE), 6) AS density
FROM vox v JOIN s ON s.volume_id = v.volume_id AND s.z = v.z AND s.y = v.y AND s.x = v.x GROUP BY 1, 2""")
def nerve_report(spark, sf):
    scored = _tiled(spark, sf).withColumn(
        "p", (F.col("intensity") + (F.col("w0") + F.col("w1") + F.col("w2")) % 3) / F.lit(53.0))
    return nerve_quantification(scored, voxels(spark, sf).select(*PLACE, "gt"), V, "p", "gt")


@query("mask_by_channel", f"""WITH {VOX} SELECT volume_id, z, y, x, CASE WHEN pred - 1 < 0 THEN -5.0::DOUBLE ELSE CAST(intensity AS DOUBLE) END AS value FROM vox""")
def mask_by_channel(spark, sf):
    value = masking.mask_by_channel(F.col("intensity").cast("double"), F.col("pred") - 1, -5.0)
    return voxels(spark, sf).select(*PLACE, value.alias("value"))


@query("patch_boxes", f"""WITH {VOX} SELECT volume_id, z, y, x, GREATEST(-2, z - 8) AS z0, GREATEST(-2, z - 8) + 16 AS z1,
GREATEST(0, y - 10) AS y0, GREATEST(0, y - 10) + 20 AS y1, GREATEST(-8, x - 16) AS x0, GREATEST(-8, x - 16) + 32 AS x1,
volume_id % 4 >= 3 AS forced FROM vox""")
def patch_boxes(spark, sf):
    centres = voxels(spark, sf).select(*PLACE)
    boxes = tiles.patch_boxes(centres, (16, 20, 32), LATTICE, padded=(20, 20, 48))
    return boxes.withColumn("forced", tiles.forced_in_batch(F.col("volume_id") % 4, 4, 0.33))


@query("cascade_argmax", f"""WITH {VOX}, {GRIDS}, p AS (SELECT volume_id, z, y, x, 0 AS class, intensity / 50.0::DOUBLE AS p FROM vox
  UNION ALL SELECT volume_id, z, y, x, 1, 1 - intensity / 50.0::DOUBLE FROM vox),
r AS (SELECT volume_id, gz.i AS z, gy.i AS y, x, class, ROUND(SUM(p * (1 - ABS(gz.c - z)) * (1 - ABS(gy.c - y))), 9) AS p
  FROM p JOIN gz ON ABS(gz.c - z) < 1 JOIN gy ON ABS(gy.c - y) < 1 GROUP BY 1, 2, 3, 4, 5)
SELECT volume_id, z, y, x, class FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id, z, y, x ORDER BY p DESC, class) AS r FROM r WHERE p <> 0) WHERE r = 1""")
def cascade_argmax(spark, sf):
    # class scores of the coarse stage on the next stage's grid, then the best class
    p = F.col("intensity") / F.lit(50.0)
    scores = voxels(spark, sf).select(*PLACE, F.posexplode(F.array(p, 1 - p)).alias("class", "p"))
    finer = resample.resample_linear(scores, ["volume_id", "class"], "p", LATTICE, RESAMPLED, within=V)
    rounded = finer.withColumn("p", F.round("p", 9)).where(F.col("p") != 0)
    return tiles.argmax_class(rounded, PLACE).drop("p")
