"""Tasks grow in number, not in size, and small files share tasks."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom import bindings
from voxloom.operators import resample, tiles
from voxloom.sinks import images as sink
from voxloom.sources import volumes
from voxloom.support import tasks_for

KEY = ["volume_id"]
OLD, NEW = (5, 6, 4), (3, 9, 4)


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(5)
    rows = [(v, z, y, x, int(c), float(rng.random())) for v in range(6) for z in range(5) for y in range(6) for x in range(4)
            for c in rng.choice(3, 2, replace=False)]
    return spark.createDataFrame(rows, "volume_id long, z int, y int, x int, class int, p double").persist()


def test_tasks_follow_the_rows(spark):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, 10, 100) == own and tasks_for(spark, 100 * own + 1, 100) == own + 1


def test_interpolation_takes_as_many_tasks_as_it_needs(spark, scores, monkeypatch):
    run = lambda: resample.resample_linear(scores, [*KEY, "class"], "p", OLD, NEW, within=KEY)
    plain = {tuple(r[:5]): round(r.p, 9) for r in run().collect()}
    monkeypatch.setattr(resample, "TASK_ROWS", 100)
    many = run()
    assert many.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {tuple(r[:5]): round(r.p, 9) for r in many.collect()} == plain and plain


def test_class_decision_needs_no_second_shuffle(scores):
    best = tiles.argmax_class(resample.resample_linear(scores, [*KEY, "class"], "p", OLD, NEW, within=KEY), [*KEY, "z", "y", "x"])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("sizes", [(5, 9), (9, 5), (7, 2), (4, 4), (41, 20), (1, 3)])
def test_looked_up_targets_equal_computed_ones(spark, sizes):
    rows = spark.range(sizes[0]).select(F.col("id").cast("int").alias("x"), *[F.lit(n).alias(c) for n, c in zip(sizes, "ab")])
    both = rows.select(resample.linear_targets("x", *sizes).alias("t"), resample.linear_targets("x", F.col("a"), F.col("b")).alias("c"))
    assert all([tuple(t) for t in r.t] == [tuple(c) for c in r.c] for r in both.collect())


def test_voxels_are_grouped_in_as_many_tasks_as_the_lines_need(spark, tmp_path, monkeypatch):
    line = "id as l_orderkey, id * 7 % 200 as l_partkey, id % 10 as l_suppkey, cast(1 + id % 7 as int) as l_linenumber, " \
           "'A' as l_returnflag, 'F' as l_linestatus, cast(1 + id % 50 as double) as l_quantity"
    spark.range(3000).selectExpr(*line.split(", ")).write.parquet(str(tmp_path / "lineitem.parquet"))
    plain = sorted(map(tuple, bindings.voxels(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(bindings, "TASK_ROWS", 100)
    many = bindings.voxels(spark, str(tmp_path))
    assert many.rdd.getNumPartitions() == 30 and sorted(map(tuple, many.collect())) == plain


def test_small_files_share_a_task(spark, tmp_path):
    voxels = spark.createDataFrame([(f"v{k}", k % 3, 1, 2, k) for k in range(1, 200)], "volume_id string, z int, y int, x int, value int")
    sink.write_nifti(sink.to_planes(voxels, "volume_id", "value", 3, 4, "i2", 3), str(tmp_path), 3)
    pieces = volumes.NiftiReader({"path": str(tmp_path)}, "voxels").partitions()
    assert len(pieces) <= 100 and sum(len(p.files) for p in pieces) == 199
    found = volumes.scan(spark, str(tmp_path), "voxels").collect()
    assert sorted((r.volume_id, r.z, r.y, r.x, r.value) for r in found) == sorted((f"v{k}", k % 3, 1, 2, k) for k in range(1, 200))


def test_planes_are_filled_across_batches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    grid = (rng.random((4, 6, 7, 9)) < 0.4) * rng.integers(1, 99, (4, 6, 7, 9))
    grid[2, 3] = 0
    points = np.argwhere(grid)
    pdf = pd.DataFrame(points, columns=["v", "z", "y", "x"]).astype("int32").assign(value=grid[tuple(points.T)])
    monkeypatch.setattr(sink, "PLANE_BYTES", 3 * 7 * 9 * 2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in ("5", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            planes = sink.to_planes(spark.createDataFrame(pdf), "v", "value", 7, 9, "i2", 6).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert len(planes) == 24
        for p in planes:
            assert np.array_equal(np.frombuffer(p.pixels, p.dtype).reshape(7, 9), grid[int(p.volume_id), p.z])


def test_planes_are_built_once_for_a_write(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    where = str(marks)

    def mark(batches):
        for batch in batches:
            open(f"{where}/{uuid.uuid4().hex}", "w").close()
            yield batch
    row = [("a", z, 2, 2, "<i2", bytes(8)) for z in range(3)]
    schema = "volume_id string, z int, height int, width int, dtype string, pixels binary"
    sink.write_nifti(spark.createDataFrame(row, schema).coalesce(1).mapInPandas(mark, schema), str(tmp_path / "out"), 3, compress=True)
    assert len(list(marks.iterdir())) == 1
