"""Connected components, blobs, morphology and surface queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.bindings import CELLS, LATTICE, VOX, voxels
from voxloom.catalog import query
from voxloom.operators import blobs, components, evaluate
from voxloom.plans.evaluation import determine_postprocessing
from voxloom.support import full_offsets, materialize

V = ["volume_id"]
PLACE = ["volume_id", "z", "y", "x"]
SMALL_TILE = (16, 16, 16)
LIN = "(CAST(z AS BIGINT) * 43 + y) * 47 + x"


def component_sql(name, source, connectivity, code=None, where="TRUE", lin=LIN):
    """Recursive components of ``source`` as ``name``(volume_id, lin, code, component)."""
    code = code or "1"
    offsets = ", ".join(f"({dz}, {dy}, {dx})" for dz, dy, dx in full_offsets(connectivity))
    return f"""{name}_v AS (SELECT volume_id, z, y, x, {code} AS code, {lin} AS lin FROM {source} WHERE {where}),
{name}_o(dz, dy, dx) AS (VALUES {offsets}),
{name}_e AS (SELECT a.volume_id, a.lin AS a, b.lin AS b FROM (SELECT v.*, z + dz AS nz, y + dy AS ny, x + dx AS nx FROM {name}_v v, {name}_o) a
  JOIN {name}_v b ON a.volume_id = b.volume_id AND a.nz = b.z AND a.ny = b.y AND a.nx = b.x AND a.code = b.code),
{name}_t AS (SELECT volume_id, lin AS a, lin AS b FROM {name}_v UNION SELECT t.volume_id, t.a, e.b FROM {name}_t t JOIN {name}_e e ON t.volume_id = e.volume_id AND t.b = e.a),
{name} AS (SELECT v.volume_id, v.z, v.y, v.x, v.code, v.lin, MIN(t.b) AS component FROM {name}_v v JOIN {name}_t t ON t.volume_id = v.volume_id AND t.a = v.lin GROUP BY ALL)"""


def _fg(spark, sf):
    return voxels(spark, sf).select(*PLACE, "gt", "pred")


for _c in (6, 18, 26):
    @query(f"connected_components_{_c}", f"WITH RECURSIVE {VOX}, {component_sql('cc', 'vox', _c)} SELECT volume_id, z, y, x, component FROM cc")
    def _cc(spark, sf, _c=_c):
        return components.connected_components(voxels(spark, sf).select(*PLACE), V, LATTICE, _c)


@query("connected_components_tiled", f"WITH RECURSIVE {VOX}, {component_sql('cc', 'vox', 26)} SELECT volume_id, z, y, x, component FROM cc")
def connected_components_tiled(spark, sf):
    # many tiles per volume: components are joined across tile faces
    return components.connected_components(voxels(spark, sf).select(*PLACE), V, LATTICE, 26, tile=SMALL_TILE)


GT6 = component_sql("cc", "vox", 6, "gt")
GT26 = component_sql("cc", "vox", 26, "gt")
SIZES = "sizes AS (SELECT volume_id, code, component, COUNT(*) AS voxels FROM cc GROUP BY 1, 2, 3)"


def _by_gt(spark, sf, connectivity):
    return components.connected_components(voxels(spark, sf).select(*PLACE, "gt"), V, LATTICE, connectivity, code="gt")


@query("region_sizes", f"""WITH RECURSIVE {VOX}, {GT26}, {SIZES}, n AS (SELECT volume_id, code, COUNT(*) = 1 AS single FROM sizes GROUP BY 1, 2)
SELECT volume_id, code AS gt, component, voxels, single FROM sizes JOIN n USING (volume_id, code)""")
def region_sizes(spark, sf):
    sizes = components.component_sizes(_by_gt(spark, sf, 26), V, "gt")
    single = sizes.groupBy("volume_id", "gt").agg((F.count("*") == 1).alias("single"))
    return sizes.join(single, ["volume_id", "gt"])


@query("keep_largest", f"""WITH RECURSIVE {VOX}, {GT6}, {SIZES}, m AS (SELECT volume_id, code, MAX(voxels) AS top FROM sizes GROUP BY 1, 2)
SELECT c.volume_id, c.z, c.y, c.x, c.code AS gt, c.component FROM cc c JOIN sizes s ON s.volume_id = c.volume_id AND s.component = c.component
JOIN m ON m.volume_id = c.volume_id AND m.code = c.code AND m.top = s.voxels""")
def keep_largest(spark, sf):
    labelled = materialize(_by_gt(spark, sf, 6))
    kept = components.largest(components.component_sizes(labelled, V, "gt"), ["volume_id", "gt"])
    return components.keep_components(labelled, kept, V)


@query("keep_largest_or_valid", f"""WITH RECURSIVE {VOX}, {GT6}, {SIZES}, m AS (SELECT volume_id, code, MAX(voxels) AS top FROM sizes GROUP BY 1, 2)
SELECT s.volume_id, s.code AS gt, s.component, s.voxels FROM sizes s JOIN m ON m.volume_id = s.volume_id AND m.code = s.code
WHERE s.voxels = m.top OR s.voxels >= 3""")
def keep_largest_or_valid(spark, sf):
    sizes = components.component_sizes(_by_gt(spark, sf, 6), V, "gt")
    return components.largest(sizes, ["volume_id", "gt"], floor=3)


ALL6 = component_sql("cc", "vox", 6)


@query("top2_components", f"""WITH RECURSIVE {VOX}, {ALL6}, {SIZES}
SELECT volume_id, component, voxels FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY voxels DESC, component) AS r FROM sizes) WHERE r <= 2""")
def top2_components(spark, sf):
    labelled = components.connected_components(voxels(spark, sf).select(*PLACE), V, LATTICE, 6)
    return components.largest_n(components.component_sizes(labelled, V), V, 2)


@query("largest_per_organ", f"""WITH RECURSIVE {VOX}, {GT26}, {SIZES}
SELECT volume_id, code AS gt, component, voxels FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id, code ORDER BY voxels DESC, component) AS r FROM sizes) WHERE r = 1""")
def largest_per_organ(spark, sf):
    sizes = components.component_sizes(_by_gt(spark, sf, 26), V, "gt")
    return components.largest(sizes, ["volume_id", "gt"], ties=False)


@query("largest_foreground", f"""WITH RECURSIVE {VOX}, {ALL6}, {SIZES}, one AS (
SELECT volume_id, component FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY voxels DESC, component) AS r FROM sizes) WHERE r = 1)
SELECT volume_id, z, y, x, component FROM cc JOIN one USING (volume_id, component)""")
def largest_foreground(spark, sf):
    labelled = materialize(components.connected_components(voxels(spark, sf).select(*PLACE), V, LATTICE, 6))
    kept = components.largest(components.component_sizes(labelled, V), V, ties=False)
    return components.keep_components(labelled, kept, V)


MINIMUM = {1: 2.0, 2: 4.0, 3: 6.0}


@query("small_object_filter", f"""WITH RECURSIVE {VOX}, {GT26}, {SIZES}
SELECT volume_id, code AS gt, component, voxels FROM sizes WHERE voxels * 1.5 > CASE code WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 6 END * 0.5""")
def small_object_filter(spark, sf):
    sizes = components.component_sizes(_by_gt(spark, sf, 26), V, "gt")
    return components.small_object_filter(sizes, V, "gt", MINIMUM, 1.5, 0.5)


@query("small_object_filter_keep_largest", f"""WITH RECURSIVE {VOX}, {GT26}, {SIZES}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id, code ORDER BY voxels DESC, component) AS r FROM sizes)
SELECT volume_id, code AS gt, component, voxels FROM r WHERE r = 1 OR voxels * 1.5 > CASE code WHEN 1 THEN 20 WHEN 2 THEN 40 ELSE 60 END""")
def small_object_filter_keep_largest(spark, sf):
    sizes = components.component_sizes(_by_gt(spark, sf, 26), V, "gt")
    return components.small_object_filter(sizes, V, "gt", {k: v * 10 for k, v in MINIMUM.items()}, 1.5, keep_largest=True)


@query("left_right_fix", f"""WITH RECURSIVE {VOX}, {component_sql('cc', 'vox', 26, where='gt IN (1, 2)')},
m AS (SELECT volume_id, component, AVG(x) < 23.5 AS first_half FROM cc GROUP BY 1, 2)
SELECT v.volume_id, v.z, v.y, v.x, CASE WHEN m.first_half IS NULL THEN v.gt WHEN m.first_half THEN 1 ELSE 2 END AS gt
FROM vox v LEFT JOIN cc ON cc.volume_id = v.volume_id AND cc.z = v.z AND cc.y = v.y AND cc.x = v.x
LEFT JOIN m ON m.volume_id = cc.volume_id AND m.component = cc.component""")
def left_right_fix(spark, sf):
    vox = voxels(spark, sf).select(*PLACE, "gt", (F.col("gt") == 3).cast("int").alias("other"))
    labelled = components.connected_components(vox, V, LATTICE, 26, code="other")
    return components.left_right_fix(labelled, V, "gt", [(1, 2)], LATTICE[2]).select(*PLACE, "gt")


BLOB = f"""{component_sql('cc', 'vox', 18)},
base AS (SELECT volume_id, component, COUNT(*) AS volume, MIN(z) AS oz, MAX(z) - MIN(z) + 1 AS bz, MIN(y) AS oy, MAX(y) - MIN(y) + 1 AS by,
  MIN(x) AS ox, MAX(x) - MIN(x) + 1 AS bx,
  CAST(ROUND_EVEN((SUM(z) - MIN(z) * COUNT(*)) / CAST(COUNT(*) AS DOUBLE), 0) AS INT) AS cz,
  CAST(ROUND_EVEN((SUM(y) - MIN(y) * COUNT(*)) / CAST(COUNT(*) AS DOUBLE), 0) AS INT) AS cy,
  CAST(ROUND_EVEN((SUM(x) - MIN(x) * COUNT(*)) / CAST(COUNT(*) AS DOUBLE), 0) AS INT) AS cx FROM cc GROUP BY 1, 2),
f1 AS (SELECT c.volume_id, c.component, c.z, c.y, c.x, ROW_NUMBER() OVER (PARTITION BY c.volume_id, c.component ORDER BY
  POW(c.z - oz - cz, 2) + POW(c.y - oy - cy, 2) + POW(c.x - ox - cx, 2) DESC, c.lin) AS r FROM cc c JOIN base USING (volume_id, component)),
f2 AS (SELECT c.volume_id, c.component, MAX(POW(c.z - f.z, 2) + POW(c.y - f.y, 2) + POW(c.x - f.x, 2)) AS d2
  FROM cc c JOIN f1 f ON f.volume_id = c.volume_id AND f.component = c.component AND f.r = 1 GROUP BY 1, 2),
blob AS (SELECT base.*, ROUND(SQRT(d2), 6) AS max_dist, CASE WHEN volume > 1 THEN
  ROUND(LEAST(GREATEST(1 - 2 * POW(volume / (4 / 3.0::DOUBLE * PI()), 1 / 3.0::DOUBLE) / NULLIF(SQRT(d2), 0), 0), 1) * 100, 6) END AS stringness
  FROM base JOIN f2 USING (volume_id, component))"""


def _blobs(vox):
    labelled = components.connected_components(vox.select(*PLACE), V, LATTICE, 18)
    return blobs.characterize(labelled, V)


@query("blob_stats", f"WITH RECURSIVE {VOX}, {BLOB} SELECT * FROM blob")
def blob_stats(spark, sf):
    return _blobs(voxels(spark, sf))


@query("blob_filter", f"WITH RECURSIVE {VOX}, {BLOB} SELECT volume_id, component, volume, stringness FROM blob WHERE volume >= 3 AND (stringness IS NULL OR stringness <= 45)")
def blob_filter(spark, sf):
    return blobs.select_blobs(_blobs(voxels(spark, sf)), 3, 45.0).select("volume_id", "component", "volume", "stringness")


@query("blob_by_region", f"""WITH RECURSIVE {VOX}, {BLOB}
SELECT b.volume_id, COALESCE(v.gt, 0) AS gt, CASE WHEN volume < 2 THEN 0 WHEN volume < 5 THEN 1 ELSE 2 END AS size_class, COUNT(*) AS blobs, CAST(SUM(volume) AS BIGINT) AS voxels
FROM blob b LEFT JOIN vox v ON v.volume_id = b.volume_id AND v.z = oz + cz AND v.y = oy + cy AND v.x = ox + cx GROUP BY 1, 2, 3""")
def blob_by_region(spark, sf):
    vox = voxels(spark, sf)
    return blobs.blobs_by_region(_blobs(vox), vox, V, "gt", (2, 5))


@query("point_distance", f"""WITH {VOX} SELECT volume_id, z, y, x, ROUND(SQRT(POW(z - 20, 2) + POW(y - 21, 2) + POW(x - 23, 2)), 6) AS dist FROM vox""")
def point_distance(spark, sf):
    d = blobs.distance([F.col(a) for a in "zyx"], [F.lit(v) for v in (20, 21, 23)])
    return voxels(spark, sf).select(*PLACE, F.round(d, 6).alias("dist"))


@query("postprocess_decision", f"""WITH RECURSIVE {VOX}, {component_sql('cc', 'vox', 6, where='pred > 0')},
big AS (SELECT volume_id, component FROM (SELECT volume_id, component, RANK() OVER (PARTITION BY volume_id ORDER BY COUNT(*) DESC) AS r FROM cc GROUP BY 1, 2) WHERE r = 1),
post AS (SELECT v.volume_id, v.gt, v.pred, CASE WHEN b.component IS NULL THEN 0 ELSE v.pred END AS pp FROM vox v
  LEFT JOIN cc ON cc.volume_id = v.volume_id AND cc.z = v.z AND cc.y = v.y AND cc.x = v.x LEFT JOIN big b ON b.volume_id = cc.volume_id AND b.component = cc.component),
d AS (SELECT volume_id, l, CAST(2 * COUNT(CASE WHEN gt = l AND pred = l THEN 1 END) AS DOUBLE) / NULLIF(COUNT(CASE WHEN gt = l THEN 1 END) + COUNT(CASE WHEN pred = l THEN 1 END), 0) AS raw,
  CAST(2 * COUNT(CASE WHEN gt = l AND pp = l THEN 1 END) AS DOUBLE) / NULLIF(COUNT(CASE WHEN gt = l THEN 1 END) + COUNT(CASE WHEN pp = l THEN 1 END), 0) AS changed
  FROM post, (VALUES (1), (2), (3)) t(l) GROUP BY 1, 2),
m AS (SELECT l, AVG(raw) AS raw, AVG(changed) AS changed FROM d GROUP BY 1)
SELECT ROUND(AVG(raw), 6) AS before, ROUND(AVG(changed), 6) AS after, BOOL_OR(changed > raw) AS improved, BOOL_OR(changed < raw) AS worse,
  BOOL_OR(changed > raw) AND NOT BOOL_OR(changed < raw) AS apply FROM m""")
def postprocess_decision(spark, sf):
    vox = _fg(spark, sf)
    labels = {str(c): [c] for c in (1, 2, 3)}

    def mean_dice(pred):
        pairs = evaluate.pair_counts(vox, pred, V, "gt", "pred")
        counts = evaluate.confusion(pairs, V, labels, CELLS)
        return (counts.groupBy("label").agg(F.avg(evaluate.dice_with_policy("undefined")).alias("dice"))
                .withColumn("label", F.col("label").cast("int")))
    pred = vox.where(F.col("pred") > 0).select(*PLACE, "pred")
    labelled = materialize(components.connected_components(pred, V, LATTICE, 6))
    kept = components.keep_components(
        labelled, components.largest(components.component_sizes(labelled, V), V), V)
    return evaluate.postprocess_decision(mean_dice(pred), mean_dice(kept), (1, 2, 3))




def _class_dice(name, column, source):
    return f"""{name} AS (SELECT l, AVG(d) AS dice FROM (SELECT volume_id, l, CAST(2 * COUNT(CASE WHEN gt = l AND {column} = l THEN 1 END) AS DOUBLE)
  / NULLIF(COUNT(CASE WHEN gt = l THEN 1 END) + COUNT(CASE WHEN {column} = l THEN 1 END), 0) AS d FROM {source}, (VALUES (1), (2), (3)) t(l) GROUP BY 1, 2) GROUP BY 1)"""


@query("postprocess_plan", f"""WITH RECURSIVE {VOX}, {component_sql('ca', 'vox', 6, where='pred > 0')},
ta AS (SELECT volume_id, component FROM (SELECT volume_id, component, RANK() OVER (PARTITION BY volume_id ORDER BY COUNT(*) DESC) AS r FROM ca GROUP BY 1, 2) WHERE r = 1),
jointly AS (SELECT v.volume_id, v.z, v.y, v.x, v.gt, v.pred, CASE WHEN ta.component IS NULL THEN 0 ELSE v.pred END AS joint FROM vox v
  LEFT JOIN ca ON ca.volume_id = v.volume_id AND ca.z = v.z AND ca.y = v.y AND ca.x = v.x LEFT JOIN ta ON ta.volume_id = ca.volume_id AND ta.component = ca.component),
{_class_dice('raw', 'pred', 'jointly')}, {_class_dice('j', 'joint', 'jointly')},
choice AS (SELECT BOOL_OR(j.dice > raw.dice) AND NOT BOOL_OR(j.dice < raw.dice) AS apply FROM raw JOIN j USING (l)),
source AS (SELECT volume_id, z, y, x, gt, CASE WHEN apply THEN joint ELSE pred END AS pred FROM jointly, choice),
{component_sql('cp', 'source', 6, 'pred', where='pred > 0')},
tp AS (SELECT volume_id, component FROM (SELECT volume_id, code, component, RANK() OVER (PARTITION BY volume_id, code ORDER BY COUNT(*) DESC) AS r FROM cp GROUP BY 1, 2, 3) WHERE r = 1),
single AS (SELECT s.volume_id, s.gt, s.pred, CASE WHEN tp.component IS NULL THEN 0 ELSE s.pred END AS kept FROM source s
  LEFT JOIN cp ON cp.volume_id = s.volume_id AND cp.z = s.z AND cp.y = s.y AND cp.x = s.x LEFT JOIN tp ON tp.volume_id = cp.volume_id AND tp.component = cp.component),
{_class_dice('base', 'pred', 'single')}, {_class_dice('s', 'kept', 'single')}
SELECT CAST(NULL AS INT) AS label, ROUND(AVG(raw.dice), 6) AS before, ROUND(AVG(j.dice), 6) AS after, BOOL_OR(j.dice > raw.dice) AND NOT BOOL_OR(j.dice < raw.dice) AS apply FROM raw JOIN j USING (l)
UNION ALL SELECT l, ROUND(base.dice, 6), ROUND(s.dice, 6), s.dice > base.dice FROM base JOIN s USING (l)""")
def postprocess_plan(spark, sf):
    vox = _fg(spark, sf)
    return determine_postprocessing(vox.select(*PLACE, "pred"), vox, V, "pred", "gt", LATTICE, (1, 2, 3))


@query("organ_filter_dispatch", f"""WITH RECURSIVE {VOX}, {GT26}, {SIZES}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id, code ORDER BY voxels DESC, component) AS r FROM sizes)
SELECT volume_id, code AS gt, component, voxels FROM r
WHERE (code = 1 AND r = 1) OR (code = 2 AND voxels * 1.5 > 6) OR (code = 3 AND (r = 1 OR voxels * 1.5 > 60))""")
def organ_filter_dispatch(spark, sf):
    sizes = components.component_sizes(_by_gt(spark, sf, 26), V, "gt")
    return components.filter_organs(sizes, V, "gt", {1: "largest", 2: "small", 3: "small_keep_one"},
                                    {2: 6.0, 3: 60.0}, 1.5)
