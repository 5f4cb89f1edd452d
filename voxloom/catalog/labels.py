"""Overlap counts, label rewriting, masks, boxes and slice queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.bindings import LATTICE, VOX, table, voxels
from voxloom.catalog import query
from voxloom.operators import masking, quantify, remap

V = ["volume_id"]
PLACE = ["volume_id", "z", "y", "x"]


@query("quantify_overlap", f"""WITH {VOX}
SELECT l.volume_id, l.gt AS label, COUNT(*) AS label_n, CAST(COALESCE(SUM(m.mask), 0) AS BIGINT) AS nerve_label_n,
       ROUND(CAST(COALESCE(SUM(m.mask), 0) AS DOUBLE) / COUNT(*), 6) AS density
FROM vox l LEFT JOIN (SELECT volume_id, z, y, x, mask FROM vox WHERE mask <> 0) m
  ON l.volume_id = m.volume_id AND l.z = m.z AND l.y = m.y AND l.x = m.x
WHERE l.gt > 0 GROUP BY 1, 2""")
def quantify_overlap(spark, sf):
    vox = voxels(spark, sf)
    return quantify.overlap(vox.select(*PLACE, F.col("gt").alias("label")),
                            vox.select(*PLACE, F.col("mask").alias("value")), V)


@query("quantify_report", f"""WITH {VOX}, counts AS (
SELECT volume_id, gt, COUNT(*) AS label_n, CAST(SUM(mask) AS BIGINT) AS nerve_n FROM vox GROUP BY 1, 2)
SELECT volume_id, 'label_' || gt AS name, label_n AS value FROM counts
UNION ALL SELECT volume_id, 'nerve_label_' || gt, nerve_n FROM counts""")
def quantify_report(spark, sf):
    return quantify.to_long(quantify_overlap(spark, sf), V, "label")


@query("stack_shape", f"""WITH {VOX}
SELECT volume_id, COUNT(DISTINCT z) AS depth, MAX(y) + 1 AS height, MAX(x) + 1 AS width FROM vox GROUP BY 1""")
def stack_shape(spark, sf):
    vox = voxels(spark, sf)
    return quantify.stack_shape(vox, V, "z", F.col("y") + 1, F.col("x") + 1)


@query("box_slice", f"""WITH {VOX}
SELECT volume_id, z, y, x, intensity FROM vox WHERE z >= 8 AND z < 24 AND y >= 10 AND y < 30 AND x >= 5 AND x < 40""")
def box_slice(spark, sf):
    return masking.box_slice(voxels(spark, sf).select(*PLACE, "intensity"), (8, 10, 5), (24, 30, 40))


@query("label_remap", f"""WITH {VOX}
SELECT volume_id, z, y, x, CASE WHEN c IN (12, 13) THEN 11 WHEN c BETWEEN 14 AND 22 THEN c - 2 ELSE c END AS organ
FROM (SELECT volume_id, z, y, x, intensity % 23 AS c FROM vox)""")
def label_remap(spark, sf):
    return voxels(spark, sf).select(*PLACE, remap.map_labels(F.col("intensity") % 23, remap.ORGAN_MERGE).alias("organ"))


@query("label_swap", f"""WITH {VOX}
SELECT volume_id, z, y, x, CASE gt WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 4 ELSE gt END AS label FROM vox""")
def label_swap(spark, sf):
    return voxels(spark, sf).select(*PLACE, remap.map_labels(F.col("gt"), remap.TUMOUR_ORDER).alias("label"))


@query("label_bins", f"""WITH {VOX}, g AS (SELECT volume_id, z, y, x, intensity * 5 AS grey FROM vox),
b AS (SELECT *, CASE WHEN grey > 55 AND grey <= 70 THEN 1 WHEN grey > 110 AND grey <= 135 THEN 2
  WHEN grey > 175 AND grey <= 200 THEN 3 WHEN grey > 240 AND grey <= 255 THEN 4 ELSE 0 END AS label FROM g)
SELECT volume_id, z, y, x, label,
  CASE label WHEN 1 THEN 63 WHEN 2 THEN 126 WHEN 3 THEN 189 WHEN 4 THEN 252 ELSE 0 END AS mr_grey,
  CASE label WHEN 1 THEN 63 ELSE 0 END AS ct_grey FROM b""")
def label_bins(spark, sf):
    binned = voxels(spark, sf).select(*PLACE, remap.bin_labels(F.col("intensity") * 5, remap.MR_RANGES).alias("label"))
    return binned.select("*", remap.map_labels(F.col("label"), remap.MR_GREYS, 0).alias("mr_grey"),
                         remap.map_labels(F.col("label"), remap.CT_GREYS, 0).alias("ct_grey"))


@query("instance_class_join", f"""WITH {VOX}, meta AS (
SELECT instance, MAX_BY(class_label, entry) AS class_label FROM (
  SELECT p_size AS instance, CAST(p_partkey % 5 AS INT) - 1 AS class_label, p_partkey AS entry FROM part) GROUP BY 1)
SELECT volume_id, z, y, x, instance,
  CASE WHEN COALESCE(class_label, 0) = -1 THEN 5 ELSE COALESCE(class_label, 0) END AS class_label
FROM (SELECT volume_id, z, y, x, intensity AS instance FROM vox) LEFT JOIN meta USING (instance)""")
def instance_class_join(spark, sf):
    meta = table(spark, sf, "part").select(
        F.col("p_size").alias("instance"), ((F.col("p_partkey") % 5).cast("int") - 1).alias("class_label"),
        F.col("p_partkey").alias("entry"))
    vox = voxels(spark, sf).select(*PLACE, F.col("intensity").alias("instance"))
    return remap.classes_of_instances(vox, meta, [], "instance", "entry").select(*PLACE, "instance", "class_label")


@query("remove_label", f"""WITH {VOX}
SELECT volume_id, z, y, x, CASE WHEN pred = 3 THEN 0 ELSE pred END AS label FROM vox""")
def remove_label(spark, sf):
    return voxels(spark, sf).select(*PLACE, remap.replace_label(F.col("pred"), 3).alias("label"))


@query("one_hot", f"""WITH {VOX}
SELECT volume_id, z, y, x, CAST(pred = 0 AS INT) AS is_0, CAST(pred = 1 AS INT) AS is_1,
       CAST(pred = 2 AS INT) AS is_2, CAST(pred = 3 AS INT) AS is_3 FROM vox""")
def one_hot(spark, sf):
    return remap.one_hot(voxels(spark, sf).select(*PLACE, "pred"), (0, 1, 2, 3), "pred").drop("pred")


@query("mask_out", f"""WITH {VOX}
SELECT volume_id, z, y, x, CASE WHEN pred > 0 THEN 0 ELSE intensity END AS intensity FROM vox""")
def mask_out(spark, sf):
    vox = voxels(spark, sf)
    return masking.mask_out(vox.select(*PLACE, "intensity"), vox.select(*PLACE, "pred"), PLACE, "intensity", "pred")


BOX = f"""{VOX}, box AS (
SELECT volume_id, MIN(z) AS z0, MAX(z) + 1 AS z1, MIN(y) AS y0, MAX(y) + 1 AS y1, MIN(x) AS x0, MAX(x) + 1 AS x1
FROM vox WHERE intensity > 45 AND pred = 3 GROUP BY 1)"""


def _boxes(vox):
    return masking.bounding_box(vox, V, (F.col("intensity") > 45) & (F.col("pred") == 3))


@query("nonzero_bbox", f"WITH {BOX} SELECT * FROM box")
def nonzero_bbox(spark, sf):
    return _boxes(voxels(spark, sf))


@query("crop_to_bbox", f"""WITH {BOX}
SELECT volume_id, z - z0 AS z, y - y0 AS y, x - x0 AS x,
       CASE WHEN pred = 0 AND NOT intensity > 10 THEN -1 ELSE pred END AS seg
FROM vox JOIN box USING (volume_id) WHERE z >= z0 AND z < z1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1""")
def crop_to_bbox(spark, sf):
    vox = voxels(spark, sf)
    seg = vox.select(*PLACE, masking.mark_outside(F.col("pred"), F.col("intensity") > 10).alias("seg"))
    return masking.crop_to_box(seg, _boxes(vox), V)


@query("uncrop", f"""WITH {BOX}
SELECT volume_id, z, y, x, pred FROM vox JOIN box USING (volume_id)
WHERE z >= z0 AND z < z1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1""")
def uncrop(spark, sf):
    vox = voxels(spark, sf)
    boxes = _boxes(vox)
    return masking.uncrop(masking.crop_to_box(vox.select(*PLACE, "pred"), boxes, V), boxes, V)


@query("bbox_extend_filter", f"""WITH {VOX}, b AS (
SELECT volume_id, GREATEST(0, MIN(z) - 4) AS z0, LEAST(41, MAX(z) + 4) AS z1,
       GREATEST(0, MIN(y) - 2) AS y0, LEAST(43, MAX(y) + 2) AS y1,
       GREATEST(0, MIN(x) - 1) AS x0, LEAST(47, MAX(x) + 1) AS x1
FROM vox WHERE intensity = 50 AND gt = 1 GROUP BY 1)
SELECT volume_id, z, y, x, pred FROM vox JOIN b USING (volume_id)
WHERE z >= z0 AND z < z1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1""")
def bbox_extend_filter(spark, sf):
    vox = voxels(spark, sf)
    boxes = masking.bounding_box(vox, V, (F.col("intensity") == 50) & (F.col("gt") == 1))
    grown = masking.grow_box(boxes, (2.0, 4.0, 8.0), 7.5, LATTICE)
    return masking.keep_in_box(vox.select(*PLACE, "pred"), grown, V)


@query("stride_downsample", f"""WITH {VOX}, ys AS (SELECT i AS ny, i * 43 // 21 AS y FROM range(21) t(i)),
xs AS (SELECT i AS nx, i * 47 // 15 AS x FROM range(15) t(i))
SELECT volume_id, CAST(z // 5 AS INT) AS z, CAST(ny AS INT) AS y, CAST(nx AS INT) AS x, intensity
FROM vox JOIN ys USING (y) JOIN xs USING (x) WHERE z % 5 = 0""")
def stride_downsample(spark, sf):
    return masking.stride_downsample(voxels(spark, sf).select(*PLACE, "intensity"), (5, 2, 3), LATTICE)


@query("nan_to_zero", """SELECT l_orderkey, l_linenumber,
CASE WHEN l_discount = 0 THEN 0.0 ELSE ROUND(l_tax / l_discount, 6) END AS value FROM lineitem""")
def nan_to_zero(spark, sf):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(
        F.round(F.col("l_tax") / F.when(F.col("l_discount") != 0, F.col("l_discount")), 6))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", masking.zero_nan(ratio).alias("value"))


@query("clean_negative_labels", f"""WITH {VOX}
SELECT volume_id, z, y, x, CASE WHEN pred - 2 < -1 THEN 0 ELSE pred - 2 END AS seg FROM vox""")
def clean_negative_labels(spark, sf):
    seg = F.col("pred") - 2
    return voxels(spark, sf).select(*PLACE, F.when(seg < -1, F.lit(0)).otherwise(seg).alias("seg"))


@query("axis_flip_swap", f"""WITH {VOX}
SELECT volume_id, 46 - x AS z, 42 - y AS y, z AS x, intensity FROM vox""")
def axis_flip_swap(spark, sf):
    return masking.reorient(voxels(spark, sf).select(*PLACE, "intensity"), ("x", "y", "z"), {"y": 43, "x": 47})


@query("split_4d", """SELECT vec_id, CAST(UNNEST(range(len(embedding))) AS INT) AS channel, UNNEST(embedding) AS value
FROM embeddings""")
def split_4d(spark, sf):
    return masking.split_channels(table(spark, sf, "embeddings"), "embedding", ["vec_id"])


@query("fold_slices", f"""WITH {VOX}
SELECT volume_id, y, x, gt * 41 + z AS folded, (gt * 41 + z) // 41 AS channel, (gt * 41 + z) % 41 AS z FROM vox""")
def fold_slices(spark, sf):
    folded = masking.fold_slices(F.col("gt"), F.col("z"), 41)
    out = voxels(spark, sf).select("volume_id", "y", "x", folded.alias("folded"))
    channel, z = masking.unfold_slices(F.col("folded"), 41)
    return out.select("*", channel.cast("int").alias("channel"), z.alias("z"))


@query("slice_asof_fill", """WITH s AS (SELECT o_orderkey // 1500 AS stack, o_orderkey % 1500 AS z FROM orders), have AS (SELECT * FROM s WHERE z % 10 = 0),
w AS (SELECT stack, z, CASE WHEN z % 10 <= 5 THEN z - z % 10 ELSE z - z % 10 + 10 END AS wanted FROM s),
l AS (SELECT stack, MAX(z) AS last FROM have GROUP BY 1)
SELECT w.stack, w.z, COALESCE(have.z, l.last) AS source_z FROM w LEFT JOIN have ON w.stack = have.stack AND w.wanted = have.z LEFT JOIN l ON l.stack = w.stack""")
def slice_asof_fill(spark, sf):
    # only every tenth slice of a stack carries labels, which is what is filled in
    slices = table(spark, sf, "orders").select(F.expr("o_orderkey div 1500").alias("stack"), (F.col("o_orderkey") % 1500).alias("z"))
    sampled = slices.where(F.col("z") % 10 == 0)
    return masking.fill_from_sampled_slices(slices, sampled, ["stack"], 10)


@query("label_volume", f"""WITH {VOX}
SELECT volume_id, gt, COUNT(*) AS voxels, ROUND(COUNT(*) * CAST(0.75 AS DOUBLE), 6) AS volume FROM vox GROUP BY 1, 2""")
def label_volume(spark, sf):
    return quantify.label_volume(voxels(spark, sf), V, "gt", (3.0, 0.5, 0.5))


@query("class_slices", f"""WITH {VOX}
SELECT volume_id, gt, 0 AS axis, z AS position, COUNT(*) AS voxels FROM vox GROUP BY 1, 2, 4
UNION ALL SELECT volume_id, gt, 1, y, COUNT(*) FROM vox GROUP BY 1, 2, 4
UNION ALL SELECT volume_id, gt, 2, x, COUNT(*) FROM vox GROUP BY 1, 2, 4""")
def class_slices(spark, sf):
    return quantify.class_slices(voxels(spark, sf), V, "gt")


@query("class_sample", f"""WITH {VOX}, p AS (SELECT volume_id, z, y, x, gt, (z::BIGINT * 73856093 + y::BIGINT * 19349663 + x::BIGINT * 83492791 + 1234) % 2147483647 AS h FROM vox),
k AS (SELECT *, (h * h % 2147483647 * 48271 + h) % 2147483647 AS k, COUNT(*) OVER (PARTITION BY volume_id, gt) AS n FROM p),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id, gt ORDER BY k, z, y, x) AS r FROM k)
SELECT volume_id, z, y, x, gt FROM r WHERE r <= GREATEST(LEAST(10000, n), CEIL(n * 0.01))""")
def class_sample(spark, sf):
    return remap.sample_class_locations(voxels(spark, sf).select(*PLACE, "gt"), V, "gt", seed=1234)


@query("class_sample_sizes", f"""WITH {VOX}
SELECT volume_id, gt, CAST(GREATEST(LEAST(10000, COUNT(*)), CEIL(COUNT(*) * 0.01)) AS BIGINT) AS n FROM vox GROUP BY 1, 2""")
def class_sample_sizes(spark, sf):
    return class_sample(spark, sf).groupBy("volume_id", "gt").agg(F.count("*").alias("n"))


@query("max_projection", f"WITH {VOX} SELECT volume_id, y, x, MAX(intensity) AS intensity FROM vox GROUP BY 1, 2, 3")
def max_projection(spark, sf):
    return quantify.max_projection(voxels(spark, sf), V, "intensity")


@query("axis_sum", f"""WITH {VOX}
SELECT volume_id, z, CAST(SUM(intensity) AS BIGINT) AS total, ROUND(SUM(intensity) / 2021.0::DOUBLE, 6) AS mean
FROM vox GROUP BY 1, 2""")
def axis_sum(spark, sf):
    return quantify.axis_sum(voxels(spark, sf), V, "intensity", ("y", "x"), LATTICE)


@query("voxel_diff", f"""WITH {VOX}
SELECT volume_id, COUNT(CASE WHEN gt <> pred THEN 1 END) AS different FROM vox GROUP BY 1""")
def voxel_diff(spark, sf):
    vox = voxels(spark, sf)
    return quantify.voxel_difference(vox.where(F.col("gt") > 0), vox.where(F.col("pred") > 0), V, "gt", "pred")


@query("min_size_replace", f"""WITH {VOX}, n AS (
SELECT volume_id, COUNT(CASE WHEN pred = 3 THEN 1 END) AS n FROM vox GROUP BY 1)
SELECT volume_id, z, y, x, CASE WHEN pred = 3 AND n < 1250 THEN 2 ELSE pred END AS pred FROM vox JOIN n USING (volume_id)""")
def min_size_replace(spark, sf):
    return remap.replace_small_class(voxels(spark, sf).select(*PLACE, "pred"), V, "pred", 3, 1250, 2)
