"""Tile-based operators against plain numpy on small dense volumes."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.operators import blobs, components, stencil, surface
from voxloom.support import full_offsets

DIMS = (13, 11, 17)
TILE = (5, 4, 6)


def frame(spark, grid, volume=0, name="label"):
    points = np.argwhere(grid)
    pdf = pd.DataFrame(points, columns=["z", "y", "x"]).astype("int32")
    pdf.insert(0, "volume_id", volume)
    pdf[name] = grid[tuple(points.T)].astype("int32")
    return spark.createDataFrame(pdf, f"volume_id long, z int, y int, x int, {name} int")


def dense(df, name, dims=DIMS, fill=0):
    out = np.full(dims, fill, np.int64)
    pdf = df.toPandas()
    out[pdf["z"], pdf["y"], pdf["x"]] = pdf[name]
    assert len(pdf) == len(pdf.drop_duplicates(["z", "y", "x"]))
    return out


def flood(grid, connectivity):
    """Component id (least C-order index) per nonzero voxel of equal code."""
    out = np.full(grid.shape, -1, np.int64)
    for start in map(tuple, np.argwhere(grid)):
        if out[start] >= 0:
            continue
        seed, todo = np.ravel_multi_index(start, grid.shape), [start]
        out[start] = seed
        while todo:
            here = todo.pop()
            for o in full_offsets(connectivity):
                near = tuple(a + b for a, b in zip(here, o))
                if all(0 <= n < s for n, s in zip(near, grid.shape)) and out[near] < 0 and grid[near] == grid[here]:
                    out[near] = seed
                    todo.append(near)
    return out


def random_grid(seed, density, codes=1):
    rng = np.random.default_rng(seed)
    return (rng.random(DIMS) < density) * rng.integers(1, codes + 1, DIMS)


@pytest.mark.parametrize("connectivity,density", [(6, 0.4), (18, 0.15), (26, 0.1), (6, 0.95)])
def test_components_across_tiles(spark, connectivity, density):
    grid = random_grid(connectivity, density)
    got = components.connected_components(frame(spark, grid), ["volume_id"], DIMS, connectivity, tile=TILE)
    assert np.array_equal(dense(got, "component", fill=-1), flood(grid, connectivity))


def test_components_keep_codes_and_volumes_apart(spark):
    grid = random_grid(3, 0.6, 2)
    both = frame(spark, grid).unionByName(frame(spark, grid, volume=1))
    got = components.connected_components(both, ["volume_id"], DIMS, 6, code="label", tile=TILE)
    for v in (0, 1):
        assert np.array_equal(dense(got.where(F.col("volume_id") == v), "component", fill=-1), flood(grid, 6))


def test_components_of_a_long_snake(spark):
    # one voxel-wide path through many tiles: the hardest case for label propagation
    grid = np.zeros(DIMS, int)
    for y in range(0, DIMS[1], 2):
        grid[6, y, :] = 1
        if y + 1 < DIMS[1]:
            grid[6, y + 1, -1 if y % 4 == 0 else 0] = 1
    got = components.connected_components(frame(spark, grid), ["volume_id"], DIMS, 6, tile=(3, 2, 3))
    assert got.select("component").distinct().count() == 1


def test_face_edge_corner(spark):
    grid = np.zeros(DIMS, int)
    for base, step in (((0, 0, 0), (0, 0, 1)), ((4, 4, 4), (0, 1, 1)), ((9, 8, 10), (1, 1, 1))):
        grid[base] = grid[tuple(a + b for a, b in zip(base, step))] = 1
    counts = [components.connected_components(frame(spark, grid), ["volume_id"], DIMS, c)
              .select("component").distinct().count() for c in (6, 18, 26)]
    assert counts == [5, 4, 3]


def test_star_roots_on_path_and_hub(spark):
    path = [(0, i, i + 1) for i in range(40)]
    hub = [(1, 500, i) for i in range(100, 300)]
    rows = spark.createDataFrame(path + hub, "g int, a long, b long")
    roots = components.star_roots(rows, ["g"]).toPandas()
    assert set(roots[roots.g == 0].root) == {0} and len(roots[roots.g == 0]) == 40
    assert set(roots[roots.g == 1].root) == {100} and len(roots[roots.g == 1]) == 200


def test_largest_keeps_ties_and_top_two(spark):
    sizes = spark.createDataFrame([(0, 5, 4), (0, 9, 4), (0, 11, 2)], "volume_id long, component long, voxels long")
    key = ["volume_id"]
    assert {r.component for r in components.largest(sizes, key).collect()} == {5, 9}
    assert {r.component for r in components.largest(sizes, key, ties=False).collect()} == {5}
    assert {r.component for r in components.largest_n(sizes, key, 2).collect()} == {5, 9}
    assert {r.component for r in components.largest(sizes, key, floor=2).collect()} == {5, 9, 11}


def test_left_right(spark):
    grid = np.zeros(DIMS, int)
    grid[2, 2, 1:4] = 3      # named left, lies in the first half
    grid[8, 8, 12:15] = 2    # named right, lies in the second half
    grid[5, 5, 5] = 7
    labelled = components.connected_components(
        frame(spark, grid).withColumn("other", (F.col("label") == 7).cast("int")), ["volume_id"], DIMS, 26, code="other")
    got = dense(components.left_right_fix(labelled, ["volume_id"], "label", [(2, 3)], DIMS[2]), "label")
    assert got[2, 2, 2] == 2 and got[8, 8, 13] == 3 and got[5, 5, 5] == 7


def test_blob_of_one_and_line(spark):
    grid = np.zeros(DIMS, int)
    grid[0, 0, 0] = 1
    grid[5, 5, 3:13] = 1
    labelled = components.connected_components(frame(spark, grid), ["volume_id"], DIMS, 18)
    rows = {r.volume: r for r in blobs.characterize(labelled, ["volume_id"]).collect()}
    assert rows[1].max_dist == 0 and rows[1].stringness is None
    line = rows[10]
    assert (line.bz, line.by, line.bx, line.cx, line.max_dist) == (1, 1, 10, 4, 9.0)


@pytest.mark.parametrize("edge", [True, False])
def test_border(spark, edge):
    grid = random_grid(5, 0.9, 2)
    expected = np.zeros(DIMS, bool)
    for p in map(tuple, np.argwhere(grid)):
        for o in full_offsets(6):
            n = tuple(a + b for a, b in zip(p, o))
            inside = all(0 <= c < s for c, s in zip(n, DIMS))
            expected[p] |= (grid[n] != grid[p]) if inside else edge
    got = stencil.border_voxels(frame(spark, grid), ["volume_id"], "label", DIMS, full_offsets(6), edge, tile=TILE)
    assert np.array_equal(dense(got, "label"), grid * expected)


def grow_once(grid, offsets):
    out = grid.copy()
    for p in map(tuple, np.argwhere(grid)):
        for o in offsets:
            n = tuple(a + b for a, b in zip(p, o))
            if all(0 <= c < s for c, s in zip(n, DIMS)):
                out[n] = max(out[n], grid[p])
    return out


@pytest.mark.parametrize("iterations,per_round", [(1, 16), (3, 1), (3, 2)])
def test_dilate(spark, iterations, per_round):
    grid = random_grid(7, 0.004)
    expected = grid
    for _ in range(iterations):
        expected = grow_once(expected, stencil.box_offsets(stencil.HEAD_BOXES))
    got = stencil.dilate(frame(spark, grid), ["volume_id"], DIMS, stencil.HEAD_BOXES, iterations, per_round, TILE)
    assert np.array_equal(dense(got.withColumn("one", F.lit(1)), "one"), expected > 0)


def test_expand_labels(spark):
    grid = random_grid(11, 0.01, 4)
    radius = 5
    seeds = np.argwhere(grid)
    expected = np.zeros(DIMS, int)
    for p in itertools.product(*map(range, DIMS)):
        d = ((seeds - p) ** 2).sum(axis=1)
        best = min(zip(d, grid[tuple(seeds.T)]))
        expected[p] = best[1] if best[0] <= radius ** 2 else 0
    got = stencil.expand_labels(frame(spark, grid), ["volume_id"], "label", DIMS, radius, TILE)
    assert np.array_equal(dense(got, "label"), expected)


def test_fill_holes(spark):
    grid = np.zeros(DIMS, int)
    grid[1:12, 1:10, 1:16] = 1
    grid[3:10, 3:8, 3:14] = 0          # a closed cave over several tiles
    grid[5:7, 4:6, 6:9] = 1            # with an island
    grid[0:4, 5, 15:17] = 0            # and a tunnel that does not reach it
    free = flood((grid == 0).astype(int), 6)
    edge = set()
    for axis, n in enumerate(DIMS):
        edge |= set(np.take(free, [0, n - 1], axis=axis).ravel())
    expected = (free >= 0) & ~np.isin(free, list(edge))
    for tile in (TILE, (64, 64, 64)):
        got = stencil.fill_holes(frame(spark, grid), ["volume_id"], DIMS, tile)
        assert np.array_equal(dense(got.withColumn("one", F.lit(1)), "one"), expected)
    assert expected.sum() > 300


@pytest.mark.parametrize("spacing", [(1.0, 1.0, 1.0), (0.2, 0.125, 0.125)])
def test_grow_instances(spark, spacing):
    rng = np.random.default_rng(2)
    grid = np.where(rng.random(DIMS) < 0.01, 1, np.where(rng.random(DIMS) < 0.5, 2, 0))
    cores = np.where(grid == 1, flood((grid == 1).astype(int), 26) + 1, 0)
    current, final, left = cores.copy(), cores.copy(), grid == 2
    step = 0
    while left.any():
        grown = grow_once(current, stencil.growth_steps(spacing, 1, step)[0])
        fresh = (current == 0) & (grown > 0)
        final[fresh & left] = grown[fresh & left]
        left &= ~fresh
        current, step = grown, step + 1
    got = stencil.grow_instances(frame(spark, cores, name="instance"), frame(spark, (grid == 2).astype(int)),
                                 ["volume_id"], DIMS, spacing, per_round=2, tile=TILE)
    assert np.array_equal(dense(got, "instance"), final)


def test_growth_without_core_ends(spark):
    border = frame(spark, random_grid(1, 0.01))
    got = stencil.grow_instances(frame(spark, np.zeros(DIMS, int), name="instance"), border, ["volume_id"], DIMS)
    assert {r.instance for r in got.collect()} == {0}


@pytest.mark.parametrize("dims", [DIMS, (5, 9, 150)])
def test_surface_distances(spark, dims):
    rng = np.random.default_rng(4)
    a, b = rng.random(dims) < 0.02, rng.random(dims) < 0.005
    spacing = np.array([2.0, 1.0, 0.5])
    pa, pb = np.argwhere(a), np.argwhere(b)
    gap = np.sqrt((((pa[:, None] - pb[None]) * spacing) ** 2).sum(-1))
    ab, ba = gap.min(1), gap.min(0)
    counts = surface.distance_counts(frame(spark, a.astype(int)), frame(spark, b.astype(int)), ["volume_id"], dims, spacing)
    row = surface.distance_metrics(counts, ["volume_id"]).first()
    assert row.hd == pytest.approx(max(ab.max(), ba.max()), abs=1e-6)
    assert row.hd95 == pytest.approx(np.percentile(np.hstack([ab, ba]), 95), abs=1e-6)
    assert row.asd == pytest.approx(ab.mean(), abs=1e-6)
    assert row.assd == pytest.approx((ab.mean() + ba.mean()) / 2, abs=1e-6)
    near = surface.surface_dice(counts, ["volume_id"], 3.0).first().surface_dice
    ta, tb = (ab <= 3).mean(), (ba <= 3).mean()
    assert near == pytest.approx((ta + tb) / 2, abs=1e-5)


def test_empty_mask_rules(spark):
    flags = spark.createDataFrame(
        [(0, False, False, False, False), (1, True, True, False, False), (2, True, False, False, False)],
        "volume_id long, test_empty boolean, reference_empty boolean, test_full boolean, reference_full boolean")
    metrics = spark.createDataFrame([(0, 3.0, 2.0, 1.0, 1.0)], "volume_id long, hd double, hd95 double, asd double, assd double")
    rows = {r.volume_id: r for r in surface.with_empty_masks(metrics, flags, ["volume_id"]).collect()}
    assert rows[0].hd == 3.0 and rows[1].hd is None and rows[2].hd95 is None
    rows = {r.volume_id: r.hd95 for r in surface.with_empty_masks(metrics, flags, ["volume_id"], sentinel=True).collect()}
    assert rows == {0: 2.0, 1: 0.0, 2: surface.MISSING_DISTANCE}
