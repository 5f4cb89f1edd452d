"""Importers, writers and the slice stream on small files."""

import json
import struct
import zlib

import numpy as np
import pytest

from voxloom.operators.intensity import envelope
from voxloom.sinks import images as out
from voxloom.sinks import reports
from voxloom.sources import images, tabular
from voxloom.streaming import slices

DIMS = (4, 5, 6)


@pytest.fixture()
def grid():
    rng = np.random.default_rng(1)
    return ((rng.random(DIMS) < 0.5) * rng.integers(1, 900, DIMS)).astype("u2")


def voxels(spark, grid, name="a"):
    points = np.argwhere(grid)
    return spark.createDataFrame([(name, *map(int, p), float(grid[tuple(p)])) for p in points],
                                 "volume_id string, z int, y int, x int, value double")


def dense(df, dims=DIMS):
    got = np.zeros(dims)
    for r in df.collect():
        got[r.z, r.y, r.x] = r.value
    return got


@pytest.mark.parametrize("compress", [False, True])
def test_nifti_round_trip(spark, grid, tmp_path, compress):
    both = voxels(spark, grid).unionByName(voxels(spark, grid[::-1], "b"))
    planes = out.to_planes(both, "volume_id", "value", DIMS[1], DIMS[2], "u2", DIMS[0])
    out.write_nifti(planes, str(tmp_path / "o"), DIMS[0], compress)
    back = images.planes_to_voxels(images.read_nifti(spark, str(tmp_path / "o")))
    assert np.array_equal(dense(back.where("volume_id = 'a'")), grid)
    assert np.array_equal(dense(back.where("volume_id = 'b'")), grid[::-1])
    size = images.read_geometry(spark, str(tmp_path / "o")).first()
    assert size["size"] == list(DIMS) and size.spacing == [1.0, 1.0, 1.0]


def test_nifti_byte_order_and_scale():
    head = bytearray(352)
    struct.pack_into(">i", head, 0, 348)
    struct.pack_into(">8h", head, 40, 3, 3, 2, 1, 1, 1, 1, 1)
    struct.pack_into(">h", head, 70, 4)
    struct.pack_into(">3f", head, 108, 352.0, 2.0, 1.0)
    data = np.arange(6, dtype=">i2").tobytes()
    assert np.array_equal(images.nifti_volume(bytes(head) + data)[0], np.arange(6).reshape(2, 3) * 2 + 1)


def test_tiff_stack(spark, grid, tmp_path):
    planes = out.to_planes(voxels(spark, grid), "volume_id", "value", DIMS[1], DIMS[2], "u2", DIMS[0])
    out.write_tiff_slices(planes, str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "a").iterdir())[0] == "label_Z0000.tif"
    assert np.array_equal(dense(images.planes_to_voxels(images.read_tiff_stack(spark, str(tmp_path)))), grid)
    kept = (tmp_path / "a" / "label_Z0001.tif").stat().st_mtime_ns
    out.write_tiff_slices(planes, str(tmp_path), skip_existing=True)
    assert (tmp_path / "a" / "label_Z0001.tif").stat().st_mtime_ns == kept
    changed = out.to_planes(voxels(spark, grid[::-1]), "volume_id", "value", DIMS[1], DIMS[2], "u2", DIMS[0])
    out.write_tiff_slices(changed, str(tmp_path))
    assert np.array_equal(dense(images.planes_to_voxels(images.read_tiff_stack(spark, str(tmp_path)))), grid[::-1])


def test_pages_of_several_files_are_numbered_on(spark, tmp_path):
    def pages(planes):
        whole, first = bytearray(out.tiff_bytes(planes[0])), 8
        for plane in planes[1:]:
            at = struct.unpack_from("<I", whole, 4)[0] if first == 8 else first
            end = at + 2 + 12 * struct.unpack_from("<H", whole, at)[0]
            one, base = bytearray(out.tiff_bytes(plane)), len(whole)
            table = struct.unpack_from("<I", one, 4)[0]
            for k in range(struct.unpack_from("<H", one, table)[0]):
                if struct.unpack_from("<H", one, table + 2 + 12 * k)[0] == images.OFFSETS:
                    struct.pack_into("<I", one, table + 10 + 12 * k, 8 + base)
            struct.pack_into("<I", whole, end, base + table)
            whole += one
            first = base + table
        return bytes(whole)

    stack = np.random.default_rng(9).integers(1, 99, (5, 3, 4)).astype("u2")
    for folder in ("one/v", "two/v"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "a.tif").write_bytes(pages(stack[:2]))
        (tmp_path / folder / "b.tif").write_bytes(pages(stack[2:]))
    back = images.planes_to_voxels(images.read_tiff_stack(spark, str(tmp_path)))
    assert {r.volume_id for r in back.select("volume_id").distinct().collect()} == {"one/v", "two/v"}
    assert np.array_equal(dense(back.where("volume_id = 'two/v'"), stack.shape), stack)


def test_all_channels_of_a_four_dimensional_file(spark, tmp_path):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 4, 4, 3, 2, 2, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    data = np.arange(1, 49, dtype="<i2")
    (tmp_path / "f.nii").write_bytes(bytes(head) + data.tobytes())
    rows = images.planes_to_voxels(images.read_nifti(spark, str(tmp_path))).collect()
    whole = data.reshape(2, 2, 3, 4)
    assert len(rows) == 48 and all(whole[r.channel, r.z, r.y, r.x] == r.value for r in rows)
    size = images.read_geometry(spark, str(tmp_path)).first()
    assert size["size"] == [2, 3, 4] and size.channels == 2
    with pytest.raises(ValueError):
        images.nifti_volume(bytes(head) + data.tobytes())


def png(plane):
    """A PNG whose rows use filters 0 to 4 in turn."""
    width = plane.shape[1] * plane.dtype.itemsize
    step = plane.dtype.itemsize
    rows = np.zeros((plane.shape[0] + 1, width), int)
    rows[1:] = np.frombuffer(plane.astype(plane.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(-1, width)
    body = b""
    for r in range(1, len(rows)):
        mode, line = (r - 1) % 5, []
        for i, v in enumerate(rows[r]):
            left, up = (rows[r][i - step] if i >= step else 0), rows[r - 1][i]
            corner = rows[r - 1][i - step] if i >= step else 0
            p = left + up - corner
            paeth = sorted([(abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)])[0][2]
            line.append((v - [0, left, up, (left + up) // 2, paeth][mode]) % 256)
        body += bytes([mode, *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", plane.shape[1], plane.shape[0], step * 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("dtype", ["u1", "u2"])
def test_png_stack(spark, tmp_path, dtype):
    stack = np.random.default_rng(3).integers(0, 250, (2, 7, 6)).astype(dtype)
    (tmp_path / "v").mkdir()
    for i, plane in enumerate(stack):
        (tmp_path / "v" / f"s{i}.png").write_bytes(png(plane))
    assert np.array_equal(dense(images.planes_to_voxels(images.read_png_stack(spark, str(tmp_path))), stack.shape), stack)


@pytest.mark.parametrize("codec", [None, "zlib", "zstd"])
def test_chunked_array(spark, grid, tmp_path, codec):
    if codec == "zstd":
        zstandard = pytest.importorskip("zstandard")
    pack = {None: bytes, "zlib": zlib.compress}.get(codec) or zstandard.ZstdCompressor().compress
    chunk = (1, 1, 3, 3, 4)
    (tmp_path / ".zarray").write_text(json.dumps({
        "shape": [1, 1, *DIMS], "chunks": list(chunk), "dtype": "<u2", "order": "C",
        "compressor": {"id": codec} if codec else None}))
    padded = np.zeros((6, 6, 8), "u2")
    padded[:4, :5, :6] = grid
    for z in range(2):
        for y in range(2):
            for x in range(2):
                part = padded[z * 3:z * 3 + 3, y * 3:y * 3 + 3, x * 4:x * 4 + 4]
                (tmp_path / f"0.0.{z}.{y}.{x}").write_bytes(pack(part.tobytes()))
    assert np.array_equal(dense(images.read_chunked_array(spark, str(tmp_path))), grid)


def test_absent_chunks_hold_the_fill_value(spark, tmp_path):
    folder = tmp_path / "vol"
    folder.mkdir()
    (folder / ".zarray").write_text(json.dumps({"shape": [3, 2, 2], "chunks": [2, 2, 2], "dtype": "<u2", "order": "C",
                                                "compressor": None, "fill_value": 7}))
    (folder / "0.0.0").write_bytes(np.arange(8, dtype="<u2").tobytes())
    back = images.read_chunked_array(spark, str(folder))
    whole = np.full((3, 2, 2), 7)
    whole[:2] = np.arange(8).reshape(2, 2, 2)
    assert np.array_equal(dense(back, (3, 2, 2)), whole) and back.first().volume_id == "vol"


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", i % 4 == 0) for i in range(20)], "case string, is_test boolean")
    reports.write_manifest(rows, "case", str(tmp_path / "m"), "T", {"0": "CT"}, {"0": "background"}, parts=3)
    parsed = spark.read.schema(tabular.MANIFEST).json(str(tmp_path / "m"))
    train = {e.image for r in parsed.collect() for e in r.training}
    test = {e for r in parsed.collect() for e in r.test}
    assert len(train) == 15 and len(test) == 5 and "./imagesTs/c0.nii.gz" in test


def test_reports(spark, tmp_path):
    scores = spark.createDataFrame([("c", "1", "Dice", 0.5), ("c", "1", "Recall", None)], "case string, label string, metric string, value double")
    reports.write_scores(scores, scores, ["case"], str(tmp_path / "s"))
    doc = json.loads("".join(p.read_text() for p in (tmp_path / "s" / "all").glob("*.json")))
    assert doc["metrics"]["Dice"] == 0.5
    reports.write_region_summary(spark.createDataFrame([("c", 0.25, None)], "casename string, whole double, enh double"), str(tmp_path / "r"))
    assert "c,0.2500,nan" in "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv"))
    (tmp_path / "rank.csv").write_text("name,a,b,c,d,e,f\nx,0.9,0.8,0.7,10,20,373.129\n")
    rank = {r.metric: r.value for r in tabular.read_ranking_scores(spark, str(tmp_path / "rank.csv")).collect()}
    assert rank["dc_whole"] == 0.9 and rank["hd95_enh"] == 0.0


def test_slice_stream_matches_batch(spark, tmp_path):
    schema = "volume_id int, z int, value int"
    rng = np.random.default_rng(5)
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    everything = []
    for z in range(6):
        rows = [(0, z, int(v)) for v in rng.integers(0, 50, 40)]
        everything += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if z in (2, 5):
            stream = spark.readStream.schema(schema).parquet(source)
            slices.start_bounds_stream(stream, ["volume_id"], "z", "value", 2, target, state).awaitTermination(120)
    bounds = spark.read.parquet(target)
    assert bounds.count() == 6
    got = slices.running_envelope(bounds, ["volume_id"]).collect()
    assert got == envelope(spark.createDataFrame(everything, schema), ["volume_id"], "z", "value", 2).collect()


def test_stacks_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    rng, want = np.random.default_rng(8), {}
    for name in ("one/v/b.tif", "one/v/a.tif", "one/v/c.tiff", "two words/v/x1.tif", "two words/a=1/_k=2/x.tif", "top.tif",
                 "one/v/.a.tif", "_hidden/v/a.tif", "one/_v/a.tif", "one/v/a.png", "one/v/d.tif._COPYING_"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        want[name] = rng.integers(1, 99, (3, 4)).astype("u2")
        path.write_bytes(out.tiff_bytes(want[name]))
    (tmp_path / "none").mkdir()
    root = str(tmp_path / "in")
    rows = lambda path, glob="*.tif*": sorted(map(tuple, images.read_tiff_stack(spark, path, glob).collect()))
    places = [(root,), (root + "/",), ("file:" + root,), (root, "{a,x}*.tif"), (root, "[bx]?.tif"), (root + "/one/v/b.tif",),
              (root + "/*/v",), (str(tmp_path / "none"),)]
    plan = images.read_tiff_stack(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "Join" not in plan
    monkeypatch.setattr(images, "BATCH_BYTES", 50)
    found = [rows(*place) for place in places]
    assert {(r[0], r[1]): r[5] for r in found[0]} == {
        (v, z): want[n].tobytes() for v, z, n in [("one/v", 0, "one/v/a.tif"), ("one/v", 1, "one/v/b.tif"), ("one/v", 2, "one/v/c.tiff"),
                                                  ("two words/v", 0, "two words/v/x1.tif"), ("two words/a=1/_k=2", 0, "two words/a=1/_k=2/x.tif"),
                                                  ("in", 0, "top.tif")]}
    # where only Spark opens the folder its own reader gives the same
    monkeypatch.setattr(images, "_roots", lambda spark, path: None)
    assert found == [rows(*place) for place in places] and [len(f) for f in found] == [6, 6, 6, 3, 1, 1, 5, 0]


def test_a_stack_that_is_not_there_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        images.read_tiff_stack(spark, str(tmp_path / "no"))


@pytest.mark.parametrize("keep_zero", [False, True])
def test_voxels_of_planes_of_several_kinds(spark, keep_zero, monkeypatch):
    monkeypatch.setattr(images, "BATCH_CELLS", 40)
    rng, rows, want = np.random.default_rng(2), [], set()
    for z in range(30):
        kind, shape = [("<u2", (3, 4)), ("<f4", (3, 4)), ("|u1", (5, 2)), (">i2", (9, 9))][z // 4 % 4]
        plane = rng.integers(0, 3, shape).astype(kind)
        if kind == "<f4":
            plane[0, 0] = np.nan
        rows.append((f"v{z % 3}", z, *shape, kind, plane.tobytes(), z % 2))
        want |= {(f"v{z % 3}", z % 2, z, y, x, str(float(v))) for (y, x), v in np.ndenumerate(plane) if v != 0 or keep_zero}
    planes = spark.createDataFrame(rows, images.PLANE + ", channel int").coalesce(1)
    got = images.planes_to_voxels(planes, keep_zero).collect()
    assert {(r.volume_id, r.channel, r.z, r.y, r.x, str(r.value)) for r in got} == want and len(got) == len(want)
    assert images.planes_to_voxels(planes.drop("channel"), keep_zero).count() == len(want)
