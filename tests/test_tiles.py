"""Stored tiles, tile functions, patches and the Blosc codec against numpy."""

import itertools
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_spatial import DIMS, TILE, dense, frame, random_grid

from voxloom.catalog import arrays
from voxloom.operators import geometry, grouped, stencil, tiles
from voxloom.sinks import tiles as store
from voxloom.sources import blosc, images

KEY = ["volume_id"]


def shuffled(block, width, bits):
    count = len(block) // width
    if bits:
        count = count // 8 * 8
        data = np.frombuffer(block, np.uint8, count * width).reshape(count, width)
        lanes = np.packbits(np.unpackbits(data, axis=1, bitorder="little").T, axis=1, bitorder="little").tobytes()
    else:
        lanes = np.frombuffer(block, np.uint8, count * width).reshape(count, width).T.tobytes()
    return lanes + block[count * width:]


def frame_of(data, width, kind, mode, block, whole=False, plain=False):
    """A Blosc frame; ``mode`` is 0, 1 (bytes) or 4 (bits)."""
    flags = mode | (kind << 5) | (16 if whole else 0) | (2 if plain else 0)
    if plain:
        return struct.pack("<4B3I", 2, 1, flags, width, len(data), block, 16 + len(data)) + data
    body, starts, at = b"", [], 16 + 4 * -(-len(data) // block)
    for k in range(0, len(data), block):
        part = data[k:k + block]
        lanes = shuffled(part, width, mode == 4) if mode and (width > 1 or mode == 4) else part
        split = not whole and len(part) == block and width <= 16 and block // width >= 128
        streams = width if split else 1
        starts.append(at + len(body))
        for j in range(streams):
            raw = lanes[j * len(lanes) // streams:(j + 1) * len(lanes) // streams]
            packed = {1: lambda d: pa.Codec("lz4_raw").compress(d, asbytes=True), 2: lambda d: pa.Codec("snappy").compress(d, asbytes=True),
                      3: zlib.compress, 4: lambda d: pa.Codec("zstd").compress(d, asbytes=True)}[kind](raw)
            packed = packed if len(packed) < len(raw) else raw
            body += struct.pack("<i", len(packed)) + packed
    head = struct.pack("<4B3I", 2, 1, flags, width, len(data), block, at + len(body))
    return head + struct.pack(f"<{len(starts)}I", *starts) + body


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
@pytest.mark.parametrize("mode", [0, 1, 4])
@pytest.mark.parametrize("width, block, size", [(2, 1024, 5000), (4, 256, 1030), (8, 4096, 4096), (1, 512, 700), (2, 1024, 0)])
def test_blosc_frames(kind, mode, width, block, size):
    data = (np.random.default_rng(size + width).integers(0, 3, size).cumsum() % 50).astype(np.uint8).tobytes()
    for whole in (False, True):
        assert blosc.decode(frame_of(data, width, kind, mode, block, whole)) == data
    assert blosc.decode(frame_of(data, width, kind, mode, block, plain=True)) == data


def test_other_blosc_codecs_are_refused():
    with pytest.raises(ValueError, match="not supported"):
        blosc.decode(struct.pack("<4B4I", 2, 1, 0, 1, 4, 4, 30, 20) + struct.pack("<i", 2) + b"ab" + bytes(4))
    with pytest.raises(ValueError, match="cut off"):
        blosc.decode(frame_of(bytes(2000), 2, 1, 1, 1024)[:-3])


@pytest.mark.parametrize("codec", ["blosc", "lz4"])
def test_array_in_the_default_codec(spark, tmp_path, codec):
    grid = random_grid(3, 0.4, 200).astype("<u2")
    chunk = (6, 8, 10)
    (tmp_path / ".zarray").write_text(json.dumps({
        "shape": list(DIMS), "chunks": list(chunk), "dtype": "<u2", "order": "C", "fill_value": 0,
        "compressor": {"id": codec, "cname": "lz4", "clevel": 5, "shuffle": 1, "blocksize": 0}}))
    for place in np.ndindex(*[-(-d // c) for d, c in zip(DIMS, chunk)]):
        part = np.zeros(chunk, "<u2")
        cut = grid[tuple(slice(p * c, p * c + c) for p, c in zip(place, chunk))]
        part[tuple(slice(0, n) for n in cut.shape)] = cut
        raw = part.tobytes()
        packed = frame_of(raw, 2, 1, 1, 512) if codec == "blosc" else struct.pack("<I", len(raw)) + pa.Codec("lz4_raw").compress(raw, asbytes=True)
        (tmp_path / ".".join(map(str, place))).write_bytes(packed)
    assert np.array_equal(dense(images.read_chunked_array(spark, str(tmp_path)), "value"), grid)


def test_store_reads_what_a_box_needs(spark, tmp_path):
    grid = random_grid(5, 0.3, 90)
    grid[:5, :4] = 0
    rows = frame(spark, grid).unionByName(frame(spark, grid[::-1], 1))
    path = str(tmp_path / "s")
    packed = store.tiles_of(rows, KEY, "label", DIMS, TILE, "<i2")
    store.write_tiles(packed, KEY, path, row_group=2048)
    kept = spark.read.parquet(path)
    assert kept.where("nonzero = 0").count() == 0 and kept.count() < 2 * 3 * 3 * 3
    for r in kept.where("volume_id = 0").collect():
        part = grid[r.z0:r.z1, r.y0:r.y1, r.x0:r.x1]
        assert (r.low, r.high, r.nonzero) == (part.min(), part.max(), np.count_nonzero(part))
    low, high = (2, 3, 4), (9, 8, 12)
    cut = store.box_slice(spark, path, KEY, low, high)
    want = np.zeros(DIMS, int)
    want[2:9, 3:8, 4:12] = grid[2:9, 3:8, 4:12]
    assert np.array_equal(dense(cut.where("volume_id = 0"), "value"), want)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = store.read_tiles(spark, path, low, high, 50).select("volume_id")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(z0,9)" in plan and "GreaterThan(z1,2)" in plan and "GreaterThanOrEqual(high,50.0)" in plan
    assert "block" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert np.array_equal(dense(store.voxels_of(store.read_tiles(spark, path), KEY).where("volume_id = 1"), "value"), grid[::-1])


@pytest.mark.parametrize("edge", ["constant", "edge", "reflect"])
def test_halo_map_equals_the_whole_volume(spark, edge):
    grid = random_grid(9, 0.2, 9)

    def median_like(block):
        around = [np.roll(block, s, (0, 1, 2)) for s in np.ndindex(3, 3, 3)]
        return np.roll(np.sort(np.stack(around), axis=0)[20], (-1, -1, -1), (0, 1, 2))
    got = stencil.halo_map(frame(spark, grid), KEY, "label", DIMS, (1, 1, 1), median_like, TILE, edge=edge)
    want = median_like(np.pad(grid, 1, mode=edge))[1:-1, 1:-1, 1:-1]
    assert np.array_equal(dense(got, "label"), want)


def test_patches_with_padding(spark):
    grid = random_grid(2, 0.3, 50)
    rng = np.random.default_rng(0)
    patch = (6, 5, 9)
    corners = [tuple(int(c) for c in rng.integers(-8, 14, 3)) for _ in range(40)] + [(40, 40, 40)]
    boxes = spark.createDataFrame([(0, k, *c) for k, c in enumerate(corners)], "volume_id long, patch int, z0 int, y0 int, x0 int")
    got = tiles.patch_crops(frame(spark, grid), boxes, KEY, ["volume_id", "patch"], "label", patch, (4, 4, 4), "<i4", -7, DIMS)
    rows = {r.patch: np.frombuffer(r.block, "<i4").reshape(patch) for r in got.collect()}
    wide = np.full([d + 120 for d in DIMS], -7)
    wide[60:60 + DIMS[0], 60:60 + DIMS[1], 60:60 + DIMS[2]] = grid
    assert rows.keys() == set(range(len(corners)))
    for k, c in enumerate(corners):
        assert np.array_equal(rows[k], wide[tuple(slice(60 + a, 60 + a + n) for a, n in zip(c, patch))])


@pytest.mark.parametrize("cut", [False, True])
def test_patches_of_whole_and_of_cut_volumes(spark, cut, monkeypatch):
    if cut:
        monkeypatch.setattr(geometry, "WHOLE", 0)
    monkeypatch.setattr(tiles, "PATCH_BYTES", 3 * 6 * 5 * 9 * 4)
    grids, patch = {0: random_grid(2, 0.3, 50), 1: random_grid(3, 0.01, 50)}, (6, 5, 9)
    corners = [tuple(int(c) for c in np.random.default_rng(4).integers(-8, 14, 3)) for _ in range(25)] + [(-90, 0, 0), (0, 99, 0)]
    voxels = frame(spark, grids[0]).unionByName(frame(spark, grids[1]).withColumn("volume_id", F.lit(1)))
    stray = spark.createDataFrame([(1, -1, 0, 0, 9), (None, 1, 1, 1, 9)], "volume_id long, z int, y int, x int, label int")
    asked = [(v, k, *c) for v in (0, 1, 7, None) for k, c in enumerate(corners)]
    boxes = spark.createDataFrame([*asked, asked[3], (0, 99, None, 0, 0)], "volume_id long, patch int, z0 int, y0 int, x0 int")
    rows = voxels.select(*KEY, *"zyx", F.col("label").cast("int").alias("label")).unionByName(stray)
    got = tiles.patch_crops(rows, boxes, KEY, ["volume_id", "patch"], "label", patch, (4, 4, 4), "<i4", -7, DIMS)
    # patches of volumes that are one tile are cut many per call of a worker
    assert ("FlatMapGroupsInPandas" in got._jdf.queryExecution().executedPlan().toString()) == cut
    found = got.collect()
    assert len(found) == len(asked)
    for r in found:
        wide = np.full([d + 300 for d in DIMS], -7)
        wide[150:150 + DIMS[0], 150:150 + DIMS[1], 150:150 + DIMS[2]] = grids.get(r.volume_id, 0)
        want = wide[tuple(slice(150 + a, 150 + a + n) for a, n in zip(corners[r.patch], patch))]
        assert np.array_equal(np.frombuffer(r.block, "<i4").reshape(patch), want)


def test_patches_without_a_shape(spark):
    grid = random_grid(6, 0.3, 50)
    corners = [(-3, 2, 4), (1, 1, 1), (30, 0, 0)]
    boxes = spark.createDataFrame([(0, k, *c) for k, c in enumerate(corners)], "volume_id long, patch int, z0 int, y0 int, x0 int")
    got = tiles.patch_crops(frame(spark, grid), boxes, KEY, ["patch"], "label", (5, 5, 5), (4, 4, 4), "<f8").collect()
    wide = np.pad(grid, 40)
    assert sorted(r.patch for r in got) == [0, 1, 2]
    for r in got:
        want = wide[tuple(slice(40 + c, 45 + c) for c in corners[r.patch])]
        assert np.array_equal(np.frombuffer(r.block, "<f8").reshape(5, 5, 5), want)


def test_a_voxel_without_a_place_is_no_patch(spark):
    rows = spark.createDataFrame([(0, 1, None, 1, 5)], "volume_id long, z int, y int, x int, label int")
    boxes = spark.createDataFrame([(0, 0, 0, 0, 0)], "volume_id long, patch int, z0 int, y0 int, x0 int")
    with pytest.raises(Exception, match="has no place"):
        tiles.patch_crops(rows, boxes, KEY, ["patch"], "label", (2, 2, 2), (4, 4, 4), "<i4", -1, DIMS).collect()


@pytest.mark.parametrize("key", ["volume_id", "name"])
def test_windows_are_predicted_in_the_task_of_their_volume(spark, key, monkeypatch):
    def halves(window, tile):
        above = tile["label"] > tile["label"].mean()
        return np.flatnonzero(above), {"p": above[above] * 1.0 + window["w0"], "order": np.arange(above.sum(), dtype=np.int32)}
    monkeypatch.setattr(grouped, "READ", 50)
    patch = (5, 4, 6)
    starts = [tiles.window_starts(n, p, 0.4) for n, p in zip(DIMS, patch)]
    known = [(v, *map(int, p), int(g[tuple(p)])) for v, g in enumerate([random_grid(1, 0.3, 50), random_grid(2, 0.1, 50)]) for p in np.argwhere(g)]
    known += [(7, 0, 0, 0, 3), (7, 40, 0, 0, 9), (7, -1, 0, 0, 9), (7, None, 0, 0, 9), (None, 1, 1, 1, 4), (None, 1, 1, 2, 6)]
    rows = spark.createDataFrame(known, "volume_id long, z int, y int, x int, label int").withColumn("name", F.concat(F.lit("v"), "volume_id"))
    rows = rows.select(key, *"zyx", "label")
    kind = "string" if key == "name" else "long"
    predict = lambda tiled: tiles.predict_tiles(
        tiled, halves, f"{key} {kind}, z int, y int, x int, w0 int, w2 int, w1 int, p double, order int", [key, "w0", "w1", "w2"])
    at_once, apart = tiles.assign_windows(rows, starts, patch, lists=True), tiles.assign_windows(rows, starts, patch)
    want = {}
    for v, *place, label in known:
        inside = [[k for k, s in enumerate(axis) if c is not None and s <= c < s + p] for axis, c, p in zip(starts, place, patch)]
        for w in itertools.product(*inside):
            want.setdefault((f"v{v}" if key == "name" and v is not None else v, *w), []).append((*place, label))
    want = sorted((str(k[0]), *r[:3], *k[1:], 1.0 + k[1]) for k, part in want.items() for r in part if r[3] > np.mean([q[3] for q in part]))
    for tiled in (at_once, apart):
        got = predict(tiled)
        assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((str(r[key]), r.z, r.y, r.x, r.w0, r.w1, r.w2, r.p) for r in got.collect()) == want and want
    assert at_once.count() < apart.count()
    monkeypatch.setattr(tiles, "WINDOW_ROWS", 10)
    assert sorted(map(str, tiles.assign_windows(rows, starts, patch, lists=True).collect())) == sorted(map(str, apart.collect()))


def test_windows_without_a_volume(spark):
    rows = frame(spark, random_grid(1, 0.3, 50)).drop("volume_id")
    tiled = tiles.assign_windows(rows, [[0, 4], [0], [0, 6]], (8, 8, 8), lists=True)
    got = tiles.predict_tiles(tiled, lambda window, tile: (np.zeros(1, int), {"n": np.array([len(tile["z"])])}), "w0 int, w2 int, n long", ["w0", "w1", "w2"])
    want = tiles.assign_windows(rows, [[0, 4], [0], [0, 6]], (8, 8, 8)).groupBy("w0", "w2").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_prediction_shuffles_voxels_and_not_windows(spark, sf):
    plan = arrays.tiled_prediction(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroupsInPandas" not in plan
