"""Confusion counts, score tables, thresholds, ranking and training curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.bindings import CELLS, EPOCH, PROB, SCORE, VOX, epochs, probabilities, scores, table, voxels
from voxloom.catalog import query
from voxloom.functions.metrics import dice, f_beta
from voxloom.operators import evaluate, selection

V = ["volume_id"]
LABELS = {"1": [1], "2": [2], "3": [3], "4": [4], "(1, 2)": [1, 2]}
REGIONS = {"whole": [1, 2, 3], "core": [2, 3], "enh": [3], "absent": [4]}

CONF = f"""{VOX}, lab(label, a, b) AS (VALUES ('1', 1, 1), ('2', 2, 2), ('3', 3, 3), ('4', 4, 4), ('(1, 2)', 1, 2)),
conf AS (SELECT volume_id, label,
  COUNT(CASE WHEN gt IN (a, b) AND pred IN (a, b) THEN 1 END) AS tp,
  COUNT(CASE WHEN gt NOT IN (a, b) AND pred IN (a, b) THEN 1 END) AS fp,
  COUNT(CASE WHEN gt IN (a, b) AND pred NOT IN (a, b) THEN 1 END) AS fn
  FROM vox, lab GROUP BY 1, 2),
full_conf AS (SELECT *, {CELLS} - tp - fp - fn AS tn FROM conf)"""


def _pairs(spark, sf):
    vox = voxels(spark, sf)
    return evaluate.pair_counts(vox.where(F.col("gt") > 0), vox.where(F.col("pred") > 0), V, "gt", "pred")


def _confusion(spark, sf, labels=None):
    return evaluate.confusion(_pairs(spark, sf), V, labels or LABELS, CELLS)


@query("pair_pred_gt", f"""WITH {VOX}
SELECT volume_id, gt AS ref, pred, COUNT(*) AS n FROM vox GROUP BY 1, 2, 3""")
def pair_pred_gt(spark, sf):
    return _pairs(spark, sf)


@query("confusion_by_label", f"""WITH {CONF}
SELECT volume_id, label, tp, fp, fn, tn, tp + fp = 0 AS test_empty, tp + fp = {CELLS} AS test_full,
       tp + fn = 0 AS reference_empty, tp + fn = {CELLS} AS reference_full FROM full_conf""")
def confusion_by_label(spark, sf):
    return _confusion(spark, sf)


def _metric_sql(source, keys):
    ratio = "CASE WHEN {1} <> 0 THEN {2}CAST({0} AS DOUBLE) / ({1}) END"
    plain = lambda n, d: ratio.format(n, d, "")
    minus = lambda n, d: ratio.format(n, d, "1 - ")
    total = "CAST({} AS DOUBLE)".format
    rows = {
        "False Positive Rate": minus("tn", "tn + fp"), "Dice": plain("2 * tp", "2 * tp + fp + fn"),
        "Jaccard": plain("tp", "tp + fp + fn"), "Precision": plain("tp", "tp + fp"), "Recall": plain("tp", "tp + fn"),
        "Accuracy": plain("(tp + tn)", "tp + fp + fn + tn"), "False Omission Rate": plain("fn", "fn + tn"),
        "Negative Predictive Value": minus("fn", "fn + tn"), "False Negative Rate": minus("tp", "tp + fn"),
        "True Negative Rate": plain("tn", "tn + fp"), "False Discovery Rate": minus("tp", "tp + fp"),
        "Total Positives Test": total("tp + fp"), "Total Negatives Test": total("tn + fn"),
        "Total Positives Reference": total("tp + fn"), "total Negatives Reference": total("tn + fp")}
    return " UNION ALL ".join(f"SELECT {keys}, label, '{name}' AS metric, {e} AS value FROM {source}"
                              for name, e in rows.items())


METRICS = f"{CONF}, m AS ({_metric_sql('full_conf', 'volume_id')})"


@query("metrics_by_label", f"WITH {METRICS} SELECT volume_id, label, metric, ROUND(value, 6) AS value FROM m")
def metrics_by_label(spark, sf):
    return evaluate.metric_table(_confusion(spark, sf), V, digits=6)


@query("f_score", f"""WITH {CONF}, pr AS (SELECT volume_id, label,
  CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS p,
  CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM conf)
SELECT volume_id, label, CASE WHEN p + r <> 0 THEN ROUND(2 * p * r / (p + r), 6) END AS f1,
       CASE WHEN 4 * p + r <> 0 THEN ROUND(5 * p * r / (4 * p + r), 6) END AS f2 FROM pr""")
def f_score(spark, sf):
    return _confusion(spark, sf).select("volume_id", "label", F.round(f_beta(1.0), 6).alias("f1"),
                                        F.round(f_beta(2.0), 6).alias("f2"))


@query("binary_metrics", f"""WITH b AS (SELECT
  COUNT(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS tp, COUNT(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS fp,
  COUNT(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS fn, COUNT(CASE WHEN quality = 0 AND toxic = 0 THEN 1 END) AS tn
  FROM labels), f AS (SELECT 'all' AS volume_id, 'binary' AS label, * FROM b)
SELECT volume_id, label, metric, ROUND(value, 6) AS value FROM ({_metric_sql('f', 'volume_id')})""")
def binary_metrics(spark, sf):
    pairs = table(spark, sf, "labels").groupBy(
        F.lit("all").alias("volume_id"), F.col("quality").alias("ref"), F.col("toxic").alias("pred")
    ).agg(F.count("*").alias("n"))
    counts = evaluate.confusion(pairs, V, {"binary": [1]}, None)
    return evaluate.metric_table(counts, V, digits=6)


@query("score_mean", f"""WITH {METRICS}
SELECT label, metric, ROUND(AVG(value), 6) AS value, COUNT(value) AS cases FROM m GROUP BY 1, 2""")
def score_mean(spark, sf):
    return evaluate.score_mean(evaluate.metric_table(_confusion(spark, sf), V), ["label", "metric"])


REGION = f"""{VOX}, reg AS (SELECT volume_id,
  COUNT(CASE WHEN gt IN (1,2,3) AND pred IN (1,2,3) THEN 1 END) * 2 AS w2, COUNT(CASE WHEN gt IN (1,2,3) THEN 1 END) + COUNT(CASE WHEN pred IN (1,2,3) THEN 1 END) AS wd,
  COUNT(CASE WHEN gt IN (2,3) AND pred IN (2,3) THEN 1 END) * 2 AS c2, COUNT(CASE WHEN gt IN (2,3) THEN 1 END) + COUNT(CASE WHEN pred IN (2,3) THEN 1 END) AS cd,
  COUNT(CASE WHEN gt = 3 AND pred = 3 THEN 1 END) * 2 AS e2, COUNT(CASE WHEN gt = 3 THEN 1 END) + COUNT(CASE WHEN pred = 3 THEN 1 END) AS ed
  FROM vox GROUP BY 1),
d AS (SELECT volume_id, CASE WHEN wd <> 0 THEN CAST(w2 AS DOUBLE) / wd END AS whole, CASE WHEN cd <> 0 THEN CAST(c2 AS DOUBLE) / cd END AS core,
  CASE WHEN ed <> 0 THEN CAST(e2 AS DOUBLE) / ed END AS enh, CAST(NULL AS DOUBLE) AS absent FROM reg)"""


@query("region_dice_summary", f"""WITH {REGION}, r AS (
SELECT CAST(volume_id AS VARCHAR) AS casename, whole, core, enh, absent FROM d
UNION ALL SELECT 'mean', AVG(whole), AVG(core), AVG(enh), AVG(absent) FROM d
UNION ALL SELECT 'median', MEDIAN(whole), MEDIAN(core), MEDIAN(enh), MEDIAN(absent) FROM d
UNION ALL SELECT 'mean (nan is 1)', AVG(COALESCE(whole, 1)), AVG(COALESCE(core, 1)), AVG(COALESCE(enh, 1)), AVG(COALESCE(absent, 1)) FROM d
UNION ALL SELECT 'median (nan is 1)', MEDIAN(COALESCE(whole, 1)), MEDIAN(COALESCE(core, 1)), MEDIAN(COALESCE(enh, 1)), MEDIAN(COALESCE(absent, 1)) FROM d)
SELECT casename, ROUND(whole, 4) AS whole, ROUND(core, 4) AS core, ROUND(enh, 4) AS enh, ROUND(absent, 4) AS absent FROM r""")
def region_dice_summary(spark, sf):
    return evaluate.region_summary(_pairs(spark, sf), "volume_id", REGIONS, CELLS)


@query("micro_dice", f"""WITH {CONF}
SELECT label, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp, CAST(SUM(fn) AS BIGINT) AS fn,
  ROUND(CAST(2 * SUM(tp) AS DOUBLE) / (2 * SUM(tp) + SUM(fp) + SUM(fn)), 6) AS dice
FROM conf GROUP BY 1 HAVING 2 * SUM(tp) + SUM(fp) + SUM(fn) <> 0""")
def micro_dice(spark, sf):
    return evaluate.micro_dice(_confusion(spark, sf), ["label"])


@query("batch_dice", f"""WITH {CONF}
SELECT volume_id, label, tp, fp, fn, ROUND(2 * tp / (2 * tp + fp + fn + 1e-8), 6) AS dice FROM conf""")
def batch_dice(spark, sf):
    return evaluate.batch_dice(_confusion(spark, sf), ["volume_id", "label"])


@query("dice_policies", f"""WITH {CONF}, g AS (SELECT volume_id, label, tp + fn = 0 AS re, tp + fp = 0 AS te,
  CASE WHEN 2 * tp + fp + fn <> 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS d FROM conf)
SELECT volume_id, label, ROUND(d, 6) AS undefined,
  ROUND(CASE WHEN re AND te THEN 1.0 WHEN re THEN 0.0 ELSE d END, 6) AS lenient, CASE WHEN NOT re THEN ROUND(d, 6) END AS present FROM g""")
def dice_policies(spark, sf):
    return _confusion(spark, sf).select(
        "volume_id", "label", *[F.round(evaluate.dice_with_policy(p), 6).alias(p)
                                for p in ("undefined", "lenient", "present")])


@query("strict_label_mean", f"""WITH {CONF}, g AS (SELECT label,
  CASE WHEN 2 * tp + fp + fn <> 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS d FROM conf)
SELECT label, CASE WHEN COUNT(d) = COUNT(*) THEN ROUND(AVG(d), 6) END AS dice FROM g GROUP BY 1""")
def strict_label_mean(spark, sf):
    scored = _confusion(spark, sf).select("label", dice().alias("d"))
    return scored.groupBy("label").agg(F.round(evaluate.strict_mean(F.col("d")), 6).alias("dice"))


@query("foreground_mean", f"""WITH {SCORE}, m AS (SELECT experiment, metric, AVG(value) AS value FROM score GROUP BY 1, 2)
SELECT experiment, ROUND(AVG(value), 6) AS foreground FROM m WHERE metric NOT IN (0, -1, 99) GROUP BY 1""")
def foreground_mean(spark, sf):
    means = scores(spark, sf).groupBy("experiment", "metric").agg(F.avg("value").alias("value"))
    return evaluate.foreground_mean(means, ["experiment"], "metric", "value")


# only groups that cover every fold count
FOLD = f"""{SCORE}, s AS (SELECT *, case_id % 5 AS fold FROM score),
ok AS (SELECT experiment, metric FROM s GROUP BY 1, 2 HAVING COUNT(DISTINCT fold) = 5)"""


def _folds(spark, sf):
    return scores(spark, sf).withColumn("fold", F.col("case_id") % 5)


@query("fold_mean_of_means", f"""WITH {FOLD}, f AS (SELECT experiment, metric, fold, AVG(value) AS m FROM s JOIN ok USING (experiment, metric) GROUP BY 1, 2, 3)
SELECT experiment, metric, ROUND(AVG(m), 6) AS mean FROM f GROUP BY 1, 2""")
def fold_mean_of_means(spark, sf):
    return evaluate.fold_mean_of_means(_folds(spark, sf), ["experiment", "metric"], "fold", range(5))


@query("fold_pooled", f"""WITH {FOLD}
SELECT experiment, metric, ROUND(AVG(value), 6) AS mean, ROUND(MEDIAN(value), 6) AS median
FROM s JOIN ok USING (experiment, metric) GROUP BY 1, 2""")
def fold_pooled(spark, sf):
    return evaluate.fold_pooled(_folds(spark, sf), ["experiment", "metric"], "fold", range(5))


@query("all_task_mean", f"""WITH {SCORE}, t AS (SELECT experiment, metric, case_id, AVG(value) AS m FROM score GROUP BY 1, 2, 3)
SELECT experiment, metric, ROUND(AVG(m), 6) AS mean FROM t GROUP BY 1, 2 HAVING COUNT(*) = 10""")
def all_task_mean(spark, sf):
    return evaluate.all_task_mean(_folds(spark, sf), ["experiment", "metric"], "case_id", range(10))


@query("unmatched_cases", """WITH a AS (SELECT DISTINCT o_custkey AS case_id FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT o_custkey AS case_id FROM orders WHERE o_orderstatus = 'O')
SELECT case_id, 'reference' AS missing_in FROM a WHERE case_id NOT IN (SELECT case_id FROM b)
UNION ALL SELECT case_id, 'test' FROM b WHERE case_id NOT IN (SELECT case_id FROM a)""")
def unmatched_cases(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderstatus")
    return evaluate.unmatched_cases(orders.where(F.col("o_orderstatus") == "F"),
                                    orders.where(F.col("o_orderstatus") == "O"), "case_id")


@query("tolerant_pairs", """SELECT DISTINCT o_custkey AS case_id, o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS predicted FROM orders""")
def tolerant_pairs(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderstatus")
    return evaluate.tolerant_pairs(orders.where(F.col("o_orderstatus") == "F"), orders, "case_id")


THRESHOLDS = (0, 10, 50, 100, 200, 500, 750, 1000, 1250, 1300, 1500, 2500, 10000)


@query("threshold_sweep", f"""WITH {VOX}, c AS (SELECT volume_id, COUNT(CASE WHEN gt = 3 AND pred = 3 THEN 1 END) AS tp,
  COUNT(CASE WHEN gt <> 3 AND pred = 3 THEN 1 END) AS fp, COUNT(CASE WHEN gt = 3 AND pred <> 3 THEN 1 END) AS fn FROM vox GROUP BY 1),
t(threshold) AS (VALUES {', '.join(f'({t})' for t in THRESHOLDS)}),
d AS (SELECT threshold, CASE WHEN tp + fp < threshold THEN CASE WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END
  WHEN tp + fn = 0 THEN CASE WHEN tp + fp = 0 THEN 1.0 ELSE 0.0 END
  ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS dice FROM c, t),
m AS (SELECT threshold, ROUND(AVG(dice), 6) AS mean_dice FROM d GROUP BY 1)
SELECT threshold, mean_dice, threshold = (SELECT threshold FROM m ORDER BY mean_dice DESC, threshold LIMIT 1) AS best FROM m""")
def threshold_sweep(spark, sf):
    return evaluate.threshold_sweep(evaluate.threshold_scores(_pairs(spark, sf), V, 3, THRESHOLDS))


@query("soft_confusion", f"""WITH {VOX}, p AS (SELECT volume_id, intensity / 50.0::DOUBLE AS p, CAST(gt = 1 AS INT) AS y FROM vox)
SELECT volume_id, ROUND(SUM(p * y), 4) AS tp, ROUND(SUM(p * (1 - y)), 4) AS fp, ROUND(SUM((1 - p) * y), 4) AS fn,
  ROUND(SUM((1 - p) * (1 - y)), 4) AS tn FROM p GROUP BY 1""")
def soft_confusion(spark, sf):
    p, y = F.col("intensity") / F.lit(50.0), (F.col("gt") == 1).cast("int")
    return evaluate.soft_confusion(voxels(spark, sf), V, p, y)


@query("sigmoid_regions", f"""WITH {VOX}, s AS (SELECT volume_id, gt, 1 / (1 + EXP(-(intensity - 25) / 10.0::DOUBLE)) > 0.5 AS pos FROM vox)
SELECT volume_id, COUNT(CASE WHEN pos AND gt >= 2 THEN 1 END) AS tp, COUNT(CASE WHEN pos AND gt < 2 THEN 1 END) AS fp,
  COUNT(CASE WHEN NOT pos AND gt >= 2 THEN 1 END) AS fn FROM s GROUP BY 1""")
def sigmoid_regions(spark, sf):
    pos = evaluate.sigmoid_positive((F.col("intensity") - 25) / F.lit(10.0))
    core = F.col("gt") >= 2
    return voxels(spark, sf).withColumn("pos", pos).groupBy("volume_id").agg(
        F.count(F.when(F.col("pos") & core, 1)).alias("tp"), F.count(F.when(F.col("pos") & ~core, 1)).alias("fp"),
        F.count(F.when(~F.col("pos") & core, 1)).alias("fn"))


@query("rank_avg", f"""WITH {SCORE}, v AS (SELECT experiment, metric, case_id,
  CASE WHEN metric = 2 THEN 373.129 - value ELSE value END AS v FROM score),
r AS (SELECT *, RANK() OVER (PARTITION BY metric, case_id ORDER BY v DESC) AS r FROM v),
m AS (SELECT experiment, metric, AVG(r) AS m FROM r GROUP BY 1, 2),
o AS (SELECT experiment, ROUND(AVG(m), 6) AS mean_rank FROM m GROUP BY 1)
SELECT experiment, mean_rank, CAST(RANK() OVER (ORDER BY mean_rank) AS INT) AS final_rank FROM o""")
def rank_avg(spark, sf):
    value = F.when(F.col("metric") == 2, selection.distance_as_score(F.col("value"))).otherwise(F.col("value"))
    return selection.rank_average(scores(spark, sf).withColumn("value", value), "experiment", "metric", "case_id", "value")


@query("rank_candidates", f"""WITH {SCORE}, b AS (SELECT case_id, experiment, MAX(value) AS best FROM score GROUP BY 1, 2),
g AS (SELECT d.case_id, n.experiment, COALESCE(b.best, 0) AS best FROM (SELECT DISTINCT case_id FROM b) d
  CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) n(experiment) LEFT JOIN b ON b.case_id = d.case_id AND b.experiment = n.experiment),
r AS (SELECT experiment, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY best DESC, experiment) - 1 AS r FROM g),
m AS (SELECT experiment, ROUND(AVG(r), 6) AS mean_rank, COUNT(*) AS datasets FROM r GROUP BY 1)
SELECT *, ROW_NUMBER() OVER (ORDER BY mean_rank, experiment) = 1 AS winner FROM m""")
def rank_candidates(spark, sf):
    return selection.rank_candidates(scores(spark, sf),
                                     ("click", "error", "purchase", "signup", "view"), "experiment", "case_id", "value")


@query("best_model", f"""WITH {SCORE}, m AS (SELECT metric, experiment, ROUND(AVG(value), 0) AS value FROM score GROUP BY 1, 2),
b AS (SELECT *, RANK() OVER (PARTITION BY metric ORDER BY value DESC) AS r FROM m)
SELECT metric, experiment, value, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY experiment DESC) = 1 AS chosen FROM b WHERE r = 1""")
def best_model(spark, sf):
    means = scores(spark, sf).groupBy("metric", "experiment").agg(F.round(F.avg("value"), 0).alias("value"))
    return selection.best_models(means, ["metric"], "experiment", "value")


@query("model_pairs", """WITH p AS (SELECT vec_id % 4 AS model, vec_id // 4 AS voxel,
  CAST(UNNEST(range(len(embedding))) AS INT) AS class, UNNEST(embedding) AS p FROM embeddings)
SELECT a.model AS first, b.model AS second, a.voxel, a.class, (CAST(a.p AS DOUBLE) + b.p) / 2 AS p
FROM p a JOIN p b ON a.model < b.model AND a.voxel = b.voxel AND a.class = b.class""")
def model_pairs(spark, sf):
    prob = table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 4).alias("model"), F.expr("vec_id div 4").alias("voxel"),
        F.posexplode("embedding").alias("class", "p"))
    pairs = selection.model_pairs(prob, "model", (0, 1, 2, 3), ["voxel", "class"], "p")
    return pairs.select(F.col("first").cast("long").alias("first"), F.col("second").cast("long").alias("second"),
                        "voxel", "class", "p")


@query("ensemble_argmax", f"""WITH {PROB}, a AS (SELECT voxel, class, AVG(CAST(p AS DOUBLE)) AS p FROM prob GROUP BY 1, 2)
SELECT voxel, class, ROUND(p, 6) AS p FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY voxel ORDER BY p DESC, class) AS r FROM a) WHERE r = 1""")
def ensemble_argmax(spark, sf):
    from voxloom.operators import tiles
    mean = probabilities(spark, sf).groupBy("voxel", "class").agg(F.avg(F.col("p").cast("double")).alias("p"))
    return tiles.argmax_class(mean, ["voxel"]).withColumn("p", F.round("p", 6))


RUN = f"""{EPOCH}, c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY epoch) AS n FROM epochs)"""


@query("ema", f"""WITH RECURSIVE {RUN}, e AS (
SELECT run, epoch, n, value AS ma FROM c WHERE n = 1
UNION ALL SELECT c.run, c.epoch, c.n, 0.9::DOUBLE * e.ma + 0.1::DOUBLE * c.value FROM e JOIN c ON c.run = e.run AND c.n = e.n + 1)
SELECT run, epoch, ROUND(ma, 6) AS ma FROM e""")
def ema(spark, sf):
    return selection.moving_average(epochs(spark, sf), ["run"], "epoch", "value", 0.9)


@query("ema_corrected", f"""WITH RECURSIVE {RUN}, e AS (
SELECT run, n, 0.02::DOUBLE * (value + 1) AS a, value + 1 AS s, value + 1 AS best, FALSE AS stop FROM c WHERE n = 1
UNION ALL SELECT run, n, a, s, CASE WHEN s < best THEN s ELSE best END, s > 4 * best FROM (
  SELECT c.run, c.n, 0.98::DOUBLE * e.a + 0.02::DOUBLE * (c.value + 1) AS a,
         (0.98::DOUBLE * e.a + 0.02::DOUBLE * (c.value + 1)) / (1 - POW(0.98::DOUBLE, c.n)) AS s, e.best
  FROM e JOIN c ON c.run = e.run AND c.n = e.n + 1 WHERE NOT e.stop))
SELECT run, CAST(n AS INT) AS step, ROUND(s, 6) AS smoothed,
       ROUND(LOG10(1e-6::DOUBLE * POW(POW(10.0::DOUBLE / 1e-6::DOUBLE, 1 / 1000.0::DOUBLE), n - 1)), 6) AS log_lr FROM e WHERE NOT stop""")
def ema_corrected(spark, sf):
    return selection.corrected_average(epochs(spark, sf), ["run"], "epoch", "value")


@query("best_epoch", f"""WITH RECURSIVE {RUN}, a AS (
SELECT run, epoch, n, value AS ma FROM c WHERE n = 1
UNION ALL SELECT c.run, c.epoch, c.n, 0.93::DOUBLE * a.ma + 0.07::DOUBLE * c.value FROM a JOIN c ON c.run = a.run AND c.n = a.n + 1),
m AS (SELECT run, epoch, n, ROUND(ma, 6) AS ma FROM a), e AS (
SELECT run, n, ma AS best, epoch AS best_epoch, CAST(NULL AS INT) AS stopped_at FROM m WHERE n = 1
UNION ALL SELECT run, n, nb, ne, CASE WHEN epoch - ne > 6 THEN epoch END FROM (
  SELECT m.run, m.n, m.epoch, CASE WHEN m.ma + 0.5 < e.best THEN m.ma ELSE e.best END AS nb,
         CASE WHEN m.ma + 0.5 < e.best THEN m.epoch ELSE e.best_epoch END AS ne
  FROM e JOIN m ON m.run = e.run AND m.n = e.n + 1 WHERE e.stopped_at IS NULL))
SELECT run, best, best_epoch, stopped_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY n DESC) AS r FROM e) WHERE r = 1""")
def best_epoch(spark, sf):
    # patience looks at the moving average of the training loss
    average = selection.moving_average(epochs(spark, sf), ["run"], "epoch", "value", 0.93)
    return selection.patience(average, ["run"], "epoch", "ma", wait=6, eps=0.5)


@query("poly_lr", f"""WITH {EPOCH} SELECT run, epoch,
  ROUND(0.01::DOUBLE * POW(1 - (epoch - 19723) / 100.0::DOUBLE, 0.9::DOUBLE), 9) AS lr FROM epochs""")
def poly_lr(spark, sf):
    return epochs(spark, sf).select("run", "epoch", F.round(
        selection.poly_lr(F.col("epoch") - 19723, 100, 0.01), 9).alias("lr"))


@query("kfold_assign", """SELECT c_custkey,
CAST(NTILE(5) OVER (ORDER BY (c_custkey + 1) * 48271 % 2147483647, c_custkey) - 1 AS INT) AS fold FROM customer""")
def kfold_assign(spark, sf):
    return selection.kfold(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 5)


@query("fold_sets", """WITH k AS (SELECT c_custkey, NTILE(5) OVER (ORDER BY (c_custkey + 1) * 48271 % 2147483647, c_custkey) - 1 AS fold FROM customer),
g AS (SELECT c_custkey, c_nationkey % 3 AS fold FROM customer),
r AS (SELECT f.fold, c_custkey, ROW_NUMBER() OVER (PARTITION BY f.fold ORDER BY (c_custkey + f.fold + 1) * 48271 % 2147483647, c_custkey) - 1 AS r,
  COUNT(*) OVER (PARTITION BY f.fold) AS n FROM customer CROSS JOIN (VALUES (7), (8)) f(fold))
SELECT 'all' AS fold, c_custkey, role FROM customer CROSS JOIN (VALUES ('train'), ('val')) v(role)
UNION ALL SELECT '2', c_custkey, CASE WHEN fold = 2 THEN 'val' ELSE 'train' END FROM k
UNION ALL SELECT 'given 1', c_custkey, CASE WHEN fold = 1 THEN 'val' ELSE 'train' END FROM g
UNION ALL SELECT CASE fold WHEN 7 THEN '7' ELSE 'given 8' END, c_custkey, CASE WHEN r < n * 8 // 10 THEN 'train' ELSE 'val' END FROM r""")
def fold_sets(spark, sf):
    cases = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    # a split table of three folds: validation by nation
    given = cases.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("fold"), "c_nationkey").select(
        "fold", "c_custkey", F.when(F.col("c_nationkey") % 3 == F.col("fold"), "val").otherwise("train").alias("role"))
    out = None
    for name, fold, splits in (("all", "all", None), ("2", 2, None), ("given 1", 1, given), ("7", 7, None),
                               ("given 8", 8, given)):
        one = selection.fold_sets(cases, "c_custkey", fold, 5, splits).withColumn("fold", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("stratified_split", """WITH r AS (SELECT c_custkey, c_mktsegment,
  ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey + 1) * 48271 % 2147483647, c_custkey) - 1 AS r,
  COUNT(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
s AS (SELECT c_custkey, c_mktsegment, CASE WHEN r < ROUND_EVEN(n * 0.8::DOUBLE, 0) THEN 'train' ELSE 'val' END AS role FROM r),
f(fold) AS (VALUES (5), (6), (7))
SELECT fold, role, c_custkey FROM s, f
WHERE role = 'val' OR fold = 7 OR (fold = 5 AND c_mktsegment = 'BUILDING') OR (fold = 6 AND c_mktsegment = 'MACHINERY')""")
def stratified_split(spark, sf):
    return selection.stratified_split(table(spark, sf, "customer"), "c_custkey", "c_mktsegment",
                                      ("BUILDING", "MACHINERY"), 0.8)
