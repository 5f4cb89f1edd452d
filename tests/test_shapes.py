"""Operators over volumes of different shape and spacing, and the errors of voxels outside their volume."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_spatial import flood

from voxloom.operators import components, geometry, resample, stencil, surface
from voxloom.support import full_offsets

KEY = ["volume_id"]
SHAPES = {0: (13, 11, 17), 1: (7, 20, 9), 2: (30, 5, 6)}
TILE = (5, 4, 6)


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame([(v, *s, float(v + 1), 1.0, 1.0) for v, s in SHAPES.items()],
                                 "volume_id long, depth int, height int, width int, spacing_z double, spacing_y double, spacing_x double")


@pytest.fixture(scope="module")
def grids():
    rng = np.random.default_rng(8)
    return {v: (rng.random(s) < 0.3) * rng.integers(1, 3, s) for v, s in SHAPES.items()}


def rows_of(spark, grids):
    parts = []
    for v, grid in grids.items():
        points = np.argwhere(grid)
        pdf = pd.DataFrame(points, columns=["z", "y", "x"]).astype("int32")
        pdf.insert(0, "volume_id", v)
        pdf["label"] = grid[tuple(points.T)].astype("int32")
        parts.append(pdf)
    return spark.createDataFrame(pd.concat(parts), "volume_id long, z int, y int, x int, label int")


def volumes(df, name, fill=0):
    out = {v: np.full(s, fill, float) for v, s in SHAPES.items()}
    for r in df.collect():
        out[r.volume_id][r.z, r.y, r.x] = r[name]
    return out


def test_components_of_all_shapes_in_one_plan(spark, shapes, grids):
    got = volumes(components.connected_components(rows_of(spark, grids), KEY, shapes, 18, code="label", tile=TILE), "component", -1)
    assert all(np.array_equal(got[v], flood(g, 18)) for v, g in grids.items())


def test_one_plan_equals_one_run_per_shape(spark, shapes, grids):
    rows = rows_of(spark, grids).persist()
    small = {v: ((6, 8, 10), (9, 9, 9), (11, 12, 6))[v] for v in SHAPES}
    new = spark.createDataFrame([(v, *s) for v, s in small.items()], "volume_id long, depth int, height int, width int")
    value = rows.withColumn("value", F.col("label").cast("double"))
    runs = {
        "border": lambda d, s, n: stencil.border_voxels(d.select(*KEY, "z", "y", "x", "label"), KEY, "label", s, full_offsets(6), True, tile=TILE),
        "dilate": lambda d, s, n: stencil.dilate(d.where("z = 3"), KEY, s, stencil.HEAD_BOXES, 2, 1, TILE),
        "expand": lambda d, s, n: stencil.expand_labels(d.where("x % 3 = 0"), KEY, "label", s, 2, TILE),
        "holes": lambda d, s, n: stencil.fill_holes(d, KEY, s, TILE),
        "count": lambda d, s, n: stencil.neighbour_count(d.select(*KEY, "z", "y", "x", "label"), KEY, "label", s, 26, TILE),
        "cubic": lambda d, s, n: resample.resample_cubic(d, KEY, "value", s, n),
        "linear": lambda d, s, n: resample.resample_linear(d, KEY, "value", s, n),
        "labels": lambda d, s, n: resample.resample_labels(d, KEY, "label", s, n),
        "nearest": lambda d, s, n: resample.resample_nearest(d.select(*KEY, "z", "y", "x", "label"), s, n, KEY),
        "pool": lambda d, s, n: resample.average_pool(d, KEY, "label", (2, 4, 3), s),
    }
    rounded = lambda df: sorted(tuple(round(float(c), 6) for c in r) for r in df.collect())
    for name, run in runs.items():
        together = rounded(run(value, shapes, new))
        apart = []
        for v, s in SHAPES.items():
            apart += rounded(run(value.where(F.col("volume_id") == v), s, small[v]))
        assert together == sorted(apart) and together, name
    rows.unpersist()


def test_distances_and_growth_follow_the_spacing_of_a_volume(spark, shapes, grids):
    rows = rows_of(spark, grids)
    test, reference = rows.where("label = 1"), rows.where("label = 2")
    found = surface.distance_metrics(surface.distance_counts(test, reference, KEY, shapes, shapes), KEY)
    for r in found.collect():
        g = grids[r.volume_id]
        scale = np.array([r.volume_id + 1.0, 1, 1])
        gap = np.sqrt((((np.argwhere(g == 1)[:, None] - np.argwhere(g == 2)[None]) * scale) ** 2).sum(-1))
        assert r.hd == pytest.approx(max(gap.min(0).max(), gap.min(1).max()), abs=1e-6)
        assert r.asd == pytest.approx(gap.min(1).mean(), abs=1e-6)
    cores = rows.where("label = 1 AND x % 4 = 0").withColumn("instance", F.col("z") * 1000 + F.col("y") * 30 + F.col("x"))
    border = rows.where("label = 2")
    got = sorted(map(tuple, stencil.grow_instances(cores, border, KEY, shapes, shapes, per_round=2, tile=TILE).collect()))
    apart = []
    for v, s in SHAPES.items():
        one = F.col("volume_id") == v
        apart += map(tuple, stencil.grow_instances(cores.where(one), border.where(one), KEY, s, (v + 1.0, 1.0, 1.0), tile=TILE).collect())
    assert got == sorted(apart)


def test_a_voxel_outside_its_volume_is_an_error(spark, shapes):
    rows = spark.createDataFrame([(0, 1, 1, 1, 1), (1, 7, 0, 0, 1)], "volume_id long, z int, y int, x int, label int")
    lost = spark.createDataFrame([(9, 1, 1, 1, 1)], rows.schema)
    fits = (13, 20, 9)
    runs = [
        lambda d, s: components.connected_components(d, KEY, s),
        lambda d, s: components.connected_components(d, KEY, s, tile=TILE),
        lambda d, s: stencil.border_voxels(d, KEY, "label", s, full_offsets(6), False),
        lambda d, s: stencil.dilate(d, KEY, s, stencil.HEAD_BOXES),
        lambda d, s: stencil.expand_labels(d, KEY, "label", s, 2),
        lambda d, s: stencil.fill_holes(d, KEY, s),
        lambda d, s: stencil.neighbour_count(d, KEY, "label", s),
        lambda d, s: stencil.grow_instances(d.withColumn("instance", F.col("label")), d.limit(0), KEY, s),
        lambda d, s: surface.nearest_distance(d, d, KEY, s),
        lambda d, s: resample.resample_cubic(d, KEY, "label", s, (4, 4, 4)),
        lambda d, s: resample.average_pool(d, KEY, "label", (2, 2, 2), s),
    ]
    for run in runs:
        with pytest.raises(Exception, match="outside the shape"):
            run(rows, shapes).collect()
        with pytest.raises(Exception, match="outside the shape"):
            run(rows, (7, 20, 9)).collect()
        assert run(rows, fits).count() >= 0
    for run in runs[:2]:
        with pytest.raises(Exception, match="outside the shape"):
            run(lost, shapes).collect()
    with pytest.raises(Exception, match="no new shape"):
        resample.resample_nearest(rows.where("volume_id = 0"), shapes, shapes.where("volume_id = 1"), KEY).collect()


def test_keep_axis_of_shapes_and_tables(spark, shapes):
    assert geometry.keep_axis((1, 2, 3), (4, 5, 6), 1, KEY) == [1, 5, 3]
    mixed = geometry.keep_axis((1, 2, 3), shapes, 0, KEY).select(*KEY, *geometry.SIZES).collect()
    assert sorted(map(tuple, mixed)) == [(0, 13, 2, 3), (1, 7, 2, 3), (2, 30, 2, 3)]
    table = shapes.select(*KEY, *[(F.col(c) * 2).alias(c) for c in geometry.SIZES])
    both = geometry.keep_axis(table, shapes, 2, KEY).select(*KEY, *geometry.SIZES).collect()
    assert sorted(map(tuple, both)) == [(0, 26, 22, 17), (1, 14, 40, 9), (2, 60, 10, 6)]


@pytest.mark.parametrize("count", [1, 30, 49, 400])
def test_lower_envelope_is_the_minimum(count):
    rng = np.random.default_rng(count)
    for scale in (0.01, 1.0, 50.0):
        sites = np.sort(rng.choice(1000, count, replace=False))
        height = np.round(rng.random((count, 9)) * rng.choice([0, 1, 1000], (count, 9)), 2)
        rows = np.arange(0, 1000, 7)
        want = (height[:, None, :] + (((rows[None] - sites[:, None]) * scale) ** 2)[:, :, None]).min(axis=0)
        assert np.allclose(surface.lower_envelope(sites, height, rows, scale), want, rtol=1e-12, atol=1e-12)


def test_envelope_time_grows_with_the_sites():
    def seconds(n):
        height = np.random.default_rng(1).random((n, 16)) * n
        start = time.perf_counter()
        surface.lower_envelope(np.arange(n), height, np.arange(n), 1.0)
        return time.perf_counter() - start
    seconds(200)
    assert seconds(8000) < 0.5 + 8 * seconds(2000)
