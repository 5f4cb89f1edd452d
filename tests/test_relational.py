"""Metrics, rankings, splits, graphs, tiles and planning on hand-made rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.functions import names
from voxloom.functions.ranking import rank_in_buckets
from voxloom.operators import cases, evaluate, graph, intensity, masking, remap, resample, selection, tiles
from voxloom.plans import evaluation as model_choice


def test_empty_and_full_masks(spark):
    rows = spark.createDataFrame([("both", 0, 0, 0, 9), ("no_test", 0, 0, 4, 5), ("no_ref", 0, 4, 0, 5), ("full_ref", 4, 0, 5, 0)],
                                 "label string, tp long, fp long, fn long, tn long").withColumn("c", F.lit(0))
    got = {(r.label, r.metric): r.value for r in evaluate.metric_table(rows, ["c"]).collect()}
    assert got["both", "Dice"] is None and got["no_test", "Dice"] == 0 and got["no_ref", "Dice"] == 0
    assert got["full_ref", "Dice"] == pytest.approx(8 / 13)
    assert got["full_ref", "True Negative Rate"] is None and got["no_test", "Precision"] is None
    assert got["no_ref", "Recall"] is None
    lenient = {r.label: r.d for r in rows.select("label", evaluate.dice_with_policy("lenient").alias("d")).collect()}
    assert lenient["both"] == 1 and lenient["no_ref"] == 0


def test_joint_labels_and_absent_side(spark):
    schema = "v long, z int, y int, x int, code int"
    ref = spark.createDataFrame([(0, 0, 0, 0, 1), (0, 0, 0, 1, 2)], schema)
    test = spark.createDataFrame([(0, 0, 0, 1, 1), (0, 0, 0, 2, 2)], schema)
    pairs = evaluate.pair_counts(ref, test, ["v"], "code", "code")
    got = {r.label: (r.tp, r.fp, r.fn, r.tn) for r in evaluate.confusion(pairs, ["v"], {"1": [1], "(1, 2)": [1, 2]}, 10).collect()}
    assert got == {"1": (0, 1, 1, 8), "(1, 2)": (1, 1, 1, 7)}


def test_incomplete_folds_are_dropped(spark):
    rows = spark.createDataFrame([("a", f, float(f)) for f in range(5)] + [("b", f, 1.0) for f in range(4)],
                                 "e string, fold int, value double")
    assert [r.e for r in evaluate.fold_pooled(rows, ["e"], "fold", range(5)).collect()] == ["a"]
    assert [r["mean"] for r in evaluate.fold_mean_of_means(rows, ["e"], "fold", range(5)).collect()] == [2.0]


def test_postprocess_decision(spark):
    schema = "label int, dice double"
    before = spark.createDataFrame([(1, 0.5), (2, 0.6)], schema)
    better = spark.createDataFrame([(1, 0.7), (2, 0.6)], schema)
    mixed = spark.createDataFrame([(1, 0.9), (2, 0.5)], schema)
    assert evaluate.postprocess_decision(before, better, (1, 2)).first().apply
    assert not evaluate.postprocess_decision(before, mixed, (1, 2)).first().apply
    assert not evaluate.postprocess_decision(before, better, (1, 2), threshold=0.3).first().apply


def test_rank_ties(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0)], "n string, v double").withColumns(
        {"m": F.lit(0), "k": F.lit(0)})
    got = {r.n: r.mean_rank for r in selection.rank_average(rows, "n", "m", "k", "v").collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 3.0}


def test_patience_renewal(spark):
    rows = spark.createDataFrame([(0, i, 1.0 if i else 2.0) for i in range(12)], "run int, epoch int, value double")
    stop = selection.patience(rows, ["run"], "epoch", "value", wait=4, eps=0.1).first()
    assert (stop.best_epoch, stop.stopped_at) == (1, 6)
    on = selection.patience(rows, ["run"], "epoch", "value", wait=4, eps=0.1, may_stop=False).first()
    assert on.stopped_at is None and on.best_epoch > 1


@pytest.mark.parametrize("n", [3, 23])
def test_kfold_sizes(spark, n):
    folds = selection.kfold(spark.range(n), "id", 5).toPandas()
    sizes = folds.groupby("fold").size().reindex(range(5), fill_value=0).tolist()
    assert sizes == [n // 5 + (i < n % 5) for i in range(5)] and len(folds) == n


def test_rank_in_buckets(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), int(v)) for g, v in zip(rng.integers(0, 2, 300), rng.permutation(300))]
    df = spark.createDataFrame(rows, "g int, v int")
    got = rank_in_buckets(df, ["g"], [("_a", F.floor(F.col("v") / 100)), ("_b", F.floor(F.col("v") / 10))], ["v"], "r", "t").toPandas()
    expected = got.groupby("g")["v"].rank().astype(int) - 1
    assert (got["r"] == expected).all() and list(got.columns) == ["g", "v", "t", "r"]


def test_class_sample_size_and_seed(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("v"), F.lit(1).alias("label"), F.lit(0).alias("z"),
                                    F.floor(F.col("id") / 100).cast("int").alias("y"), (F.col("id") % 100).cast("int").alias("x"))
    a = remap.sample_class_locations(rows, ["v"], "label", 1, floor=70)
    assert a.groupBy("v").count().select("count").distinct().first()[0] == 70
    b = remap.sample_class_locations(rows, ["v"], "label", 1, floor=70)
    assert a.exceptAll(b).count() == 0
    assert a.exceptAll(remap.sample_class_locations(rows, ["v"], "label", 2, floor=70)).count() > 0


def test_fingerprint_of_an_empty_case(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, i, 1, 10 * i) for i in range(30)] + [(1, 0, 0, 0, 0, 0, 5)],
                                 "case int, m int, z int, y int, x int, gt int, value int")
    got = {r.case: r for r in intensity.fingerprint(rows, "case", "m", "value", F.col("gt") > 0).collect()}
    assert got[1].mean is None and got[0]["max"] == 200.0 and got[None].median == 100.0
    assert got[0].sd == pytest.approx(np.std([0, 100, 200]), abs=1e-6)


def test_slice_fill_and_label_maps(spark):
    slices = spark.range(0, 27).select(F.lit(0).alias("s"), F.col("id").alias("z"))
    got = {r.z: r.source_z for r in masking.fill_from_sampled_slices(
        slices, slices.where("z % 10 = 0"), ["s"], 10).collect()}
    assert got[5] == 0 and got[6] == 10 and got[26] == 20
    codes = [r.m for r in spark.range(11, 23).select(remap.map_labels(F.col("id").cast("int"), remap.ORGAN_MERGE).alias("m")).collect()]
    assert codes == [11, 11, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20]
    assert [r.m for r in spark.range(1, 4).select(remap.map_labels(F.col("id").cast("int"), remap.TUMOUR_ORDER).alias("m")).collect()] == [2, 1, 4]


def test_path_graph_and_isolated_edge(spark):
    v = spark.createDataFrame([(0, i, 0, 0, i, 1) for i in range(6)], "g int, vid long, z int, y int, x int, radius int")
    e = spark.createDataFrame([(0, 0, 0, 1, 9.0), (0, 1, 1, 2, 9.0), (0, 2, 2, 3, 9.0), (0, 3, 4, 5, 5.0)],
                              "g int, eid long, src long, dst long, length double")
    degree = {r.vid: r.degree for r in graph.vertex_degree(v, e, ["g"]).collect()}
    assert [degree[i] for i in range(4)] == [1, 2, 2, 1]
    assert graph.leaf_edges(e, graph.vertex_degree(v, e, ["g"]), ["g"]).first().leaf_edges == 3
    assert {r.eid for r in graph.prune_edges(e, v, ["g"]).collect()} == {0, 1, 2}
    loop = spark.createDataFrame([(0, 0, 3, 3, 1.0)], e.schema)
    assert {r.degree for r in graph.vertex_degree(v.where("vid = 3"), loop, ["g"]).collect()} == {2}


def test_proximity_with_split_cells(spark, sf):
    from voxloom.catalog.graphs import _pairs
    rows = lambda hot: sorted(map(tuple, _pairs(spark, sf, hot).collect()))
    assert rows(1) == rows(10_000)


@pytest.mark.parametrize("image,patch,step,expected", [
    ((128, 260), (64, 130), 0.5, [[0, 32, 64], [0, 65, 130]]),
    ((128, 260), (64, 130), 1.0, [[0, 64], [0, 130]]),
    ((64, 64), (64, 64), 0.5, [[0], [0]])])
def test_window_starts(image, patch, step, expected):
    assert [tiles.window_starts(i, p, step) for i, p in zip(image, patch)] == expected


@settings(max_examples=500, deadline=None)
@given(st.integers(1, 500), st.integers(0, 900), st.floats(0.05, 1.0))
def test_window_starts_cover(patch, extra, step):
    starts = tiles.window_starts(patch + extra, patch, step)
    assert starts[0] == 0 and starts[-1] + patch == patch + extra
    gaps = np.diff(starts)
    assert (gaps <= np.ceil(patch * step)).all() and (gaps <= patch).all()


def test_cubic_matrix():
    assert np.allclose(resample.cubic_lines(np.eye(20), 20), np.eye(20), atol=1e-6)
    x = np.arange(40)
    line = 0.01 * x ** 3 - 0.2 * x ** 2 + x
    at = (np.arange(80) + 0.5) / 2 - 0.5
    inner = slice(30, 50)
    got = resample.cubic_lines(np.eye(40), 80) @ line
    assert np.allclose(got[inner], (0.01 * at ** 3 - 0.2 * at ** 2 + at)[inner], atol=1e-3)
    assert np.allclose(resample.cubic_lines(np.eye(15), 31).sum(axis=1), 1.0)


def test_resample_against_dense(spark):
    rng = np.random.default_rng(0)
    old, new = (6, 7, 9), (4, 12, 9)
    grid = (rng.random(old) < 0.3) * rng.integers(1, 9, old)
    points = np.argwhere(grid)
    rows = spark.createDataFrame([(0, *map(int, p), float(grid[tuple(p)])) for p in points], "v long, z int, y int, x int, value double")
    cubic = grid.astype(float)
    for axis, (a, b) in enumerate(zip(old, new)):
        if a != b:
            cubic = np.moveaxis(np.tensordot(resample.cubic_lines(np.eye(a), b), cubic, (1, axis)), 0, axis)
    cubic = np.clip(cubic, 0, grid.max())
    got = np.zeros(new)
    for r in resample.resample_cubic(rows, ["v"], "value", old, new, bundle=(3, 4)).collect():
        got[r.z, r.y, r.x] = r.value
    assert np.allclose(got, cubic, atol=1e-9)
    near = np.zeros(new)
    source = [np.clip(np.rint((np.arange(b) + 0.5) * a / b - 0.5), 0, a - 1).astype(int) for a, b in zip(old, new)]
    for r in resample.resample_nearest(rows, old, new).collect():
        near[r.z, r.y, r.x] = r.value
    assert np.array_equal(near, grid[np.ix_(*source)])


def test_names_and_manifest(spark):
    row = spark.range(1).select(
        names.case_of_file(F.lit("CASE_7_0003.nii.gz")).alias("c"), names.modality_of_file(F.lit("CASE_7_0003.nii.gz")).alias("m"),
        names.task_id(F.lit("Task043_X")).alias("t"), names.block_of_file(F.lit("a_b_c_1_22_3.raw")).alias("b"),
        names.hex_rgb(F.lit("#0a10ff")).alias("h")).first()
    assert (row.c, row.m, row.t, tuple(row.b), tuple(row.h)) == ("CASE_7", 3, 43, (1, 22, 3), (10, 16, 255))
    assert cases.non_consecutive([0, 1, 3]) == [3] and cases.non_consecutive([0, 1, 2]) == []


def test_model_choice(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("b", 1, 0.9), ("b", 2, 0.8), ("b", 0, 0.1)],
                                 "model string, label int, value double")
    assert model_choice.choose_model(rows, "model", "label", "value").first().model == "b"
    prob = spark.createDataFrame([(0, 5, 0, 0.2), (0, 5, 1, 0.8), (1, 5, 0, 0.9), (1, 5, 1, 0.1)], "m int, v int, class int, p double")
    assert model_choice.ensemble_segmentation(prob, (0, 1), "m", ["v"]).first()["class"] == 0
    with pytest.raises(Exception, match="misses a value"):
        model_choice.ensemble_segmentation(prob, (0, 1, 2), "m", ["v"]).collect()


def test_unmatched_cases_fail(spark):
    schema = "v long, z int, y int, x int, code int"
    a = spark.createDataFrame([(0, 0, 0, 0, 1)], schema)
    b = spark.createDataFrame([(1, 0, 0, 0, 1)], schema)
    with pytest.raises(ValueError, match="without a partner"):
        model_choice.evaluate_cases(a, b, ["v"], "code", "code", {"1": [1]}, 5)


def test_no_row_is_lost_without_statistics_or_outside_bounds(spark):
    from voxloom.operators import intensity, masking, quantify
    rows = spark.createDataFrame([(1, "a", 0, 0, 0, 5), (1, "b", 0, 0, 1, 6), (2, "a", 1, 1, 1, 12)],
                                 "case int, modality string, z int, y int, x int, value int")
    stats = spark.createDataFrame([("a", 0.0, 10.0, 5.0, 2.0)], "modality string, p0_5 double, p99_5 double, mean double, sd double")
    got = {(r.case, r.modality): r.normalized for r in intensity.normalize_ct(rows, stats, ["modality"], "value").collect()}
    assert got == {(1, "a"): 0.0, (1, "b"): None, (2, "a"): 2.5}
    boxes = spark.createDataFrame([(1, 0, 1, 0, 1, 1, 2)], "case int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    kept = masking.crop_to_box(rows, boxes, ["case"]).collect()
    assert sorted((r.case, r.z, r.y, r.x) for r in kept) == [(1, 0, 0, 0), (2, 1, 1, 1)]
    assert {r.bin: r.n for r in quantify.histogram(rows, [], "value", 2, 0.0, 6.0).collect()} == {1: 2, 2: 1}
    assert sum(r.n for r in quantify.histogram(rows, ["case"], "value", 3).collect()) == 3


def test_a_voxel_outside_the_declared_shape_is_an_error(spark):
    from voxloom.support import linear_index
    rows = spark.createDataFrame([(0, 0, 5)], "z int, y int, x int")
    assert rows.select(linear_index((1, 1, 6))).first()[0] == 5
    with pytest.raises(Exception, match="outside the declared shape"):
        rows.select(linear_index((1, 1, 5))).collect()


def test_pooling_windows_start_before_the_edge(spark):
    from voxloom.operators import resample
    whole = spark.range(125).selectExpr("1 AS v", "CAST(id div 25 AS INT) AS z", "CAST(id div 5 % 5 AS INT) AS y",
                                        "CAST(id % 5 AS INT) AS x", "2 AS label")
    got = resample.average_pool(whole, ["v"], "label", (4, 4, 4), (5, 5, 5)).collect()
    assert [(r.z, r.y, r.x, r.share) for r in got] == [(0, 0, 0, 1.0)]


def test_cubic_lines_stay_linear():
    import tracemalloc
    peak = []
    for n in (1000, 2000):
        tracemalloc.start()
        resample.cubic_lines(np.ones((n, 8)), n // 2)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < 2.5 * peak[0]


def test_volumes_of_different_shapes(spark):
    from voxloom.operators import geometry
    rows = spark.createDataFrame([(1, 0, 0, 0), (2, 4, 0, 0)], "v int, z int, y int, x int")
    shapes = spark.createDataFrame([(1, 2, 2, 2), (2, 5, 1, 1)], "v int, depth int, height int, width int")
    halved = lambda part, s: resample.resample_nearest(part, s, ((s[0] + 1) // 2, s[1], s[2]))
    got = geometry.per_shape(rows, shapes, ["v"], halved).collect()
    assert sorted((r.v, r.z) for r in got) == [(1, 0), (2, 2)]
    with pytest.raises(Exception, match="outside the shape"):
        geometry.per_shape(rows, shapes.where("v = 1"), ["v"], halved).collect()
    with pytest.raises(ValueError, match="more than 1 shapes"):
        geometry.per_shape(rows, shapes, ["v"], halved, limit=1)


def test_extra_references_are_only_reported(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "c int"), spark.createDataFrame([(2,)], "c int")
    assert {(r.c, r.predicted) for r in evaluate.tolerant_pairs(b, a, "c").collect()} == {(1, False), (2, True)}
    with pytest.raises(Exception, match="no reference for case 1"):
        evaluate.tolerant_pairs(a, b, "c").collect()
