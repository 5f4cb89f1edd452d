"""Volumes of no more cells than a tile are worked on whole, with the results of volumes that are cut."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom import support
from voxloom.operators import components, geometry, grouped, stencil, surface
from voxloom.sinks import tiles as store

KEY = ["volume_id"]
SIZES = {1: (7, 9, 8), 2: (5, 12, 6), 3: (11, 6, 13)}
TILE = (4, 4, 4)


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(v, *s, 1.0 + v % 2, 1.0, 0.5) for v, s in SIZES.items()]
    return spark.createDataFrame(rows, "volume_id long, depth int, height int, width int, spacing_z double, spacing_y double, spacing_x double")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    found = [(v, *map(int, p), int(rng.integers(1, 4)), int(rng.integers(0, 4)))
             for v, s in SIZES.items() for p in np.argwhere(rng.random(s) < 0.45)]
    return spark.createDataFrame(found, "volume_id long, z int, y int, x int, code int, other int").persist()


def _surfaces(rows, shapes):
    sides = [rows.where(F.col(c) > 0).select(*KEY, *"zyx", F.col(c).alias("code")) for c in ("code", "other")]
    return surface.distance_counts(*[surface.surface(s, KEY, "code", shapes, TILE) for s in sides], [*KEY, "code"], shapes, shapes
                                   ).withColumn("distance", F.round("distance", 9))


OPERATORS = {
    "components": lambda r, s: components.connected_components(r, KEY, s, 26, code="code", tile=TILE),
    "border": lambda r, s: stencil.border_voxels(r, KEY, "code", s, support.full_offsets(6), False, TILE),
    "surface": lambda r, s: stencil.border_voxels(r, KEY, "code", s, support.full_offsets(18), True, TILE),
    "dilate": lambda r, s: stencil.dilate(r.where("code = 1 and (z + y + x) % 9 = 0"), KEY, s, [(2, 0, 1), (0, 1, 1)], 3, 2, TILE),
    "expand": lambda r, s: stencil.expand_labels(r.where("code = 1 and (z + y + x) % 9 = 0"), KEY, "other", s, 3, TILE),
    "sums": lambda r, s: stencil.expanded_sums(r.where("(z + y + x) % 9 = 0"), KEY, "code", s, 2, TILE),
    "holes": lambda r, s: stencil.fill_holes(geometry.free_cells(s, r.where("code = 1")), KEY, s, TILE),
    "instances": lambda r, s: stencil.instances_from_core_and_border(r, KEY, "code", s, s, 2, 3, TILE),
    "distances": _surfaces,
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("limit", [0, 400])  # no volume whole, or one of three
def test_whole_volumes_give_what_tiles_give(rows, shapes, monkeypatch, name, limit):
    run = lambda: sorted(map(tuple, OPERATORS[name](rows, shapes).collect()))
    whole = run()
    monkeypatch.setattr(geometry, "WHOLE", limit)
    monkeypatch.setattr(geometry, "DENSE", limit)
    assert run() == whole and whole


@pytest.mark.parametrize("limit", [0, geometry.WHOLE])
def test_instance_zero_grows(spark, monkeypatch, limit):
    # a core at the first cell has component 0; its border was asked for without end
    monkeypatch.setattr(geometry, "WHOLE", limit)
    cells = [(1, 0, 0, 0, 1), (1, 0, 0, 3, 2), (1, 2, 2, 2, 2), (2, 0, 0, 0, 1), (2, 0, 0, 5, 1), (2, 0, 0, 2, 2), (2, 0, 0, 3, 2), (3, 1, 1, 1, 2)]
    voxels = spark.createDataFrame(cells, "volume_id long, z int, y int, x int, code int")
    found = stencil.instances_from_core_and_border(voxels, KEY, "code", (3, 3, 6), tile=(2, 2, 2)).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0, 0, 0), (1, 0, 0, 3, 0), (1, 2, 2, 2, 0), (2, 0, 0, 0, 0), (2, 0, 0, 2, 0),
                                         (2, 0, 0, 3, 5), (2, 0, 0, 5, 5), (3, 1, 1, 1, 0)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_volumes_take_one_shuffle(rows, shapes):
    for name in ("components", "border", "expand", "dilate"):
        assert _plan(OPERATORS[name](rows, shapes)).count("Exchange hashpartitioning") == 1, name
    sides = [rows.select(*KEY, *"zyx", c) for c in ("code", "other")]
    assert _plan(surface.distance_counts(*sides, KEY, (13, 13, 13))).count("Exchange hashpartitioning") == 1


def test_groups_after_an_aggregation_keep_their_tasks(spark, rows):
    heads = rows.groupBy("volume_id").agg(F.min("z").alias("z"), F.min("y").alias("y"), F.min("x").alias("x"))
    assert "REPARTITION_BY_NUM" in _plan(stencil.dilate(heads, KEY, (13, 13, 13), [(1, 1, 1)]))


@pytest.mark.parametrize("read, write", [(1, 1), (7, 3), (1 << 16, 1 << 18)])
def test_groups_are_whole_across_batches(spark, monkeypatch, read, write):
    monkeypatch.setattr(grouped, "READ", read)
    monkeypatch.setattr(grouped, "WRITE", write)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], 500), "n": rng.integers(0, 9, 500), "v": rng.integers(0, 99, 500)})
    want = pdf.groupby(["k", "n"], dropna=False)["v"].agg(["sum", "size"]).reset_index()
    rows = spark.createDataFrame(pdf, "k string, n long, v long")
    out = rows.selectExpr("k", "n", "v as total", "v as size")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        for runs in (None, ["k"]):
            found = grouped.map_groups(rows, ["k", "n"], lambda first, part: (np.zeros(1, np.int64), {
                "total": np.array([part["v"].sum()]), "size": np.array([len(part["v"])])}), out.schema, ["v"], runs).collect()
            assert sorted(map(str, map(tuple, found))) == sorted(
                str((None if pd.isna(r.k) else r.k, r.n, r.sum, r.size_)) for r in want.rename(columns={"size": "size_"}).itertuples())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("step", [(1.0, 1.0, 1.0), (2.0, 0.3, 1.7)])
def test_grid_distances_equal_all_pairs(step):
    rng = np.random.default_rng(4)
    shape = (9, 14, 11)
    for count in (1, 3, 200):
        points, sites = (np.stack([rng.integers(0, n, k) for n in shape]) for k in (60, count))
        scale = np.array(step)[:, None, None]
        want = (((points[:, :, None] - sites[:, None, :]) * scale) ** 2).sum(axis=0).min(axis=1)
        assert np.allclose(surface.grid_distance(points, sites, shape, step), want)


def test_bits_grow_as_cells_do():
    rng = np.random.default_rng(6)
    for width in (1, 63, 64, 65, 130):
        grid = rng.random((4, 5, width)) < 0.02
        want = grid.astype(np.uint8)
        for _ in range(3):
            want = stencil._dilate_boxes(want, [(1, 0, 70), (0, 2, 1), (3, 1, 0)])
        assert np.array_equal(stencil.dilate_bits(grid, [(1, 0, 70), (0, 2, 1), (3, 1, 0)], 3), want.astype(bool))


def test_tiles_are_packed_once_for_a_write(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    where = str(marks)

    def mark(batches):
        for batch in batches:
            open(f"{where}/{uuid.uuid4().hex}", "w").close()
            yield batch
    voxels = spark.createDataFrame([(1, z, z, z, z + 1) for z in range(9)], "volume_id long, z int, y int, x int, value int")
    tiles = store.tiles_of(voxels, KEY, "value", (9, 9, 9), (4, 4, 4), "<i2")
    store.write_tiles(tiles.coalesce(1).mapInPandas(mark, tiles.schema), KEY, str(tmp_path / "out"))
    assert len(list(marks.iterdir())) == 1
    assert sorted((r.z, r.y, r.x, r.value) for r in store.box_slice(spark, str(tmp_path / "out"), KEY, (2, 0, 0), (7, 9, 9)).collect()) == [
        (z, z, z, z + 1.0) for z in range(2, 7)]


def test_free_cells(spark, rows, shapes):
    held = {tuple(r) for r in rows.select(*KEY, *"zyx").collect()}
    want = {(v, *map(int, p)) for v, s in SIZES.items() for p in np.argwhere(np.ones(s))} - held
    assert sorted(map(tuple, geometry.free_cells(shapes, rows).collect())) == sorted(want)
