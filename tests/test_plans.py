"""Workflows and table layout."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import components, intensity
from voxloom.plans import evaluation, preprocessing, quantification
from voxloom.sinks.tables import write_voxel_table
from voxloom.sources import images

SCHEMA = "volume_id long, z int, y int, x int, label int"
KEY = ["volume_id"]


def rows(spark, points):
    return spark.createDataFrame([(0, *p) for p in points], SCHEMA)


def test_crop_and_normalize(spark):
    data = spark.createDataFrame([(0, 0, z, 5, 7 + x, 10 * (x + 1), x % 2) for z in (3, 4) for x in range(3)],
                                 "volume_id long, modality int, z int, y int, x int, value int, seg int")
    out = {(r.z, r.y, r.x): r for r in preprocessing.crop_and_normalize(data, KEY, "value", "seg", "nonCT").collect()}
    assert set(out) == {(z, 0, x) for z in (0, 1) for x in range(3)}
    values = np.array([10, 20, 30] * 2)
    assert out[0, 0, 0].normalized == pytest.approx((10 - values.mean()) / (values.std() + 1e-8), abs=1e-5)
    stats = preprocessing.fingerprint_table(data, "volume_id", "modality", "value", "seg")
    ct = preprocessing.crop_and_normalize(data, KEY, "value", "seg", "CT", stats)
    assert ct.count() == 6 and "normalized" in ct.columns


def test_resample_case_set(spark):
    data = spark.createDataFrame([(0, z, y, x, float(z + 1), 1 + (x > 3)) for z in range(4) for y in range(6) for x in range(6)],
                                 "volume_id long, z int, y int, x int, value double, seg int")
    out = preprocessing.resample_case_set(data, KEY, "value", "seg", (4, 6, 6), (2, 12, 12), separate=0).collect()
    assert len(out) == 2 * 12 * 12
    # the separate axis is read nearest, so only source values occur
    assert {round(r.value, 6) for r in out} == {1.0, 3.0} and {r.seg for r in out} == {1, 2}


def test_prepare_organs_and_clean(spark):
    organs = rows(spark, [(5, 5, 5, 5), (2, 2, 2, 1), (2, 2, 3, 1), (8, 8, 8, 1)])
    head, rest = quantification.prepare_organs(organs, KEY, "label", (12, 12, 12), head=5, head_iterations=1, radius=1)
    assert head.count() == 9 + 21 + 21 - 3 - 3 - 7 + 1
    assert rest.where("label = 5").count() == 0 and rest.count() == 12 + 7
    cleaned = quantification.clean_prediction(organs, KEY, "label", (12, 12, 12))
    assert {(r.z, r.label) for r in cleaned.collect()} == {(5, 5), (2, 1)}
    kept = quantification.clean_prediction(organs, KEY, "label", (12, 12, 12), floors={1: 1, 5: 1})
    assert kept.count() == 4


def test_joint_largest_and_limits(spark):
    pred = rows(spark, [(0, 0, 0, 1), (0, 0, 1, 2), (0, 0, 2, 2), (5, 5, 5, 1), (5, 5, 6, 1)])
    joint = components.keep_largest_per_group(pred, KEY, "label", (9, 9, 9), [[1, 2]])
    assert joint.count() == 3
    floors = components.keep_largest_per_group(pred, KEY, "label", (9, 9, 9), [[1, 2]], {(1, 2): 2})
    assert floors.count() == 5
    labelled = components.connected_components(pred, KEY, (9, 9, 9), 6, code="label")
    limits = {r.label: (r.largest_removed, r.smallest_kept) for r in evaluation.object_limits(labelled, KEY, "label").collect()}
    assert limits == {1: (1, 2), 2: (None, 2)}


def test_joint_step_feeds_the_class_steps(spark):
    gt = rows(spark, [(0, 0, 0, 1), (0, 0, 1, 2), (0, 0, 2, 2)])
    pred = rows(spark, [(0, 0, 0, 1), (0, 0, 1, 2), (0, 0, 2, 2), (5, 5, 5, 1)]).withColumnRenamed("label", "p")
    out = {r.label: r for r in evaluation.determine_postprocessing(pred, gt, KEY, "p", "label", (9, 9, 9), (1, 2)).collect()}
    assert out[None].apply and out[1].before == 1.0 and not out[1].apply


def test_folds_must_not_overlap(spark):
    a = rows(spark, [(0, 0, 0, 1)])
    with pytest.raises(ValueError, match="several folds"):
        evaluation.consolidate_folds([a, a], KEY)
    b = a.withColumn("volume_id", F.lit(1).cast("long"))
    assert evaluation.consolidate_folds([a, b], KEY).count() == 2


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(500).select(F.lit(0).cast("long").alias("volume_id"), *[
            (F.col("id") % n).cast("int").alias(c) for c, n in (("z", 7), ("y", 11), ("x", 13))], F.lit(1).alias("label"))
        for name in ("vox_left", "vox_right"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            write_voxel_table(a, name, 4)
        joined = spark.table("vox_left").join(spark.table("vox_right"), ["volume_id", "z", "y", "x"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 500
    finally:
        for name in ("vox_left", "vox_right"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_analyze_pair(spark, tmp_path):
    head = bytearray(348)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 4, 3, 2, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    grid = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    (tmp_path / "m.hdr").write_bytes(bytes(head))
    (tmp_path / "m.img").write_bytes(grid.tobytes())
    voxels = images.planes_to_voxels(images.read_analyze(spark, str(tmp_path)), keep_zero=True)
    got = np.zeros((2, 3, 4))
    for r in voxels.collect():
        got[r.z, r.y, r.x] = r.value
    assert np.array_equal(got, grid)
    turned = images.scanner_orientation(voxels, depth=2, height=3).collect()
    assert {(r.z, r.y, r.x): r.value for r in turned}[2, 1, 3] == grid[0, 0, 3]


def test_envelope_is_not_the_global_percentile(spark):
    values = spark.createDataFrame([(0, z, v) for z, vs in ((0, range(1, 101)), (1, range(200, 301))) for v in vs],
                                   "volume_id long, z int, v int")
    low_high = intensity.envelope(values, KEY, "z", "v", 5).first()
    assert low_high.low == pytest.approx(np.percentile(np.arange(1, 101), 5))
    assert low_high.high == pytest.approx(np.percentile(np.arange(200, 301), 95))


def test_staged_tables_can_be_dropped(spark):
    from voxloom import support
    support.drop_staged(spark)
    staged = support.materialize(spark.range(5))
    assert staged.count() == 5
    assert support.drop_staged(spark) == 1 and support.drop_staged(spark) == 0


def test_broadcast_depends_on_the_measured_size(spark):
    from voxloom.support import attach
    big = spark.range(1000).withColumn("v", F.col("id") % 10)
    stats = big.groupBy("v").agg(F.count("*").alias("n"))
    plan = lambda: attach(big, stats, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert "SortMergeJoin" in plan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
