"""The NIfTI data source: splits, pruning, bytes read, and writes that are published whole."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.sinks import images as out
from voxloom.sinks.volumes import write_volumes
from voxloom.sources import images, volumes


def file_of(array, spacing=(1.0, 1.0, 1.0), order="<"):
    """A NIfTI file of a (channel, z, y, x) array."""
    array = array.astype(array.dtype.newbyteorder(order))
    head = bytearray(out.nifti_header(array.shape[1:], np.dtype(array.dtype.str.replace(">", "<")), spacing, array.shape[0]))
    if order == ">":
        fields = {0: "i", 40: "8h", 70: "2h", 76: "8f", 108: "3f"}
        for at, form in fields.items():
            struct.pack_into(">" + form, head, at, *struct.unpack_from("<" + form, head, at))
    return bytes(head) + array.tobytes()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("nifti")
    rng = np.random.default_rng(6)
    arrays = {"a": rng.integers(0, 3, (1, 30, 8, 9)).astype("i2"), "sub/b": rng.integers(0, 3, (3, 10, 4, 5)).astype("u1"),
              "sub/deep/a": rng.random((1, 3, 6, 2)).astype("f4"), "packed": rng.integers(0, 9, (2, 5, 7, 3)).astype("u2")}
    for name, array in arrays.items():
        path = root / f"{name}.nii{'.gz' if name == 'packed' else ''}"
        path.parent.mkdir(parents=True, exist_ok=True)
        content = file_of(array, (2.0, 0.5, 0.25), ">" if name == "sub/b" else "<")
        path.write_bytes(gzip.compress(content) if name == "packed" else content)
    (root / "_hidden.nii").write_bytes(b"no volume")
    return root, arrays


def arrays_of(rows):
    found = {}
    for r in rows:
        plane = np.frombuffer(r.pixels, r.dtype).reshape(r.height, r.width)
        assert (r.volume_id, r.channel, r.z) not in found
        found[r.volume_id, r.channel, r.z] = plane
    return found


def expected(arrays, planes=lambda c, z: True):
    return {(v, c, z): p for v, a in arrays.items() for c, vol in enumerate(a) for z, p in enumerate(vol) if planes(c, z)}


def same(found, wanted):
    return found.keys() == wanted.keys() and all(np.array_equal(found[k], wanted[k]) for k in wanted)


def test_a_file_is_cut_into_many_tasks(spark, folder):
    root, arrays = folder
    planes = volumes.scan(spark, str(root), split_bytes=500)
    assert planes.rdd.getNumPartitions() > 12
    assert same(arrays_of(planes.collect()), expected(arrays))
    whole = volumes.scan(spark, f"file:{root}")
    assert same(arrays_of(whole.collect()), expected(arrays)) and whole.rdd.getNumPartitions() == 4


def test_voxels_leave_the_reader(spark, folder):
    root, arrays = folder
    rows = images.read_nifti_voxels(spark, str(root), z=(2, 4)).collect()
    wanted = {(v, c, z, int(y), int(x)): float(p[y, x]) for (v, c, z), p in expected(arrays, lambda c, z: 2 <= z < 4).items()
              for y, x in np.argwhere(p)}
    assert {(r.volume_id, r.channel, r.z, r.y, r.x): r.value for r in rows} == wanted and len(rows) == len(wanted)


def bytes_read(monkeypatch, reader):
    """Rows of all partitions, and the bytes asked of each file."""
    asked = []
    real = volumes.open_folder

    class File:
        def __init__(self, inner):
            self.inner = inner

        def read_at(self, size, at):
            asked.append(size)
            return self.inner.read_at(size, at)

        def __enter__(self):
            return self

        def __exit__(self, *args):
            self.inner.__exit__(*args)

    class Files:
        def __init__(self, inner):
            self.inner = inner

        def open_input_file(self, path):
            return File(self.inner.open_input_file(path))

        def __getattr__(self, name):
            return getattr(self.inner, name)

    # the rest of the file system is the real one
    with monkeypatch.context() as patch:
        patch.setattr(volumes, "open_folder", lambda path: (lambda f, p: (Files(f), p))(*real(path)))
        batches = [b for p in reader.partitions() for b in reader.read(p)]
    return batches, sum(asked)


def test_bounds_prune_what_is_read(spark, folder, monkeypatch):
    root, arrays = folder
    batches, size = bytes_read(monkeypatch, volumes.NiftiReader({"path": str(root / "a.nii"), "z_from": 10, "z_to": 13}, "planes"))
    assert sum(b.num_rows for b in batches) == 3 and size == 352 + 3 * 8 * 9 * 2
    one = volumes.NiftiReader({"path": str(root), "volume": "sub/b", "channel": "1", "split_bytes": 50}, "planes")
    batches, size = bytes_read(monkeypatch, one)
    assert sum(b.num_rows for b in batches) == 10 and size == 352 * len(one.partitions()) + 10 * 4 * 5
    rows = images.read_nifti(spark, str(root), z=(2, 4), channel=0)
    assert same(arrays_of(rows.collect()), expected(arrays, lambda c, z: 2 <= z < 4 and c == 0))


def test_a_filter_leaves_other_reads_alone(spark, folder):
    root, arrays = folder
    planes = images.read_nifti(spark, str(root))
    count = len(expected(arrays))
    assert [planes.where("z = 1").count(), planes.count(), planes.unionByName(planes.where("z = 2")).count()] == [
        len(expected(arrays, lambda c, z: z == 1)), count, count + len(expected(arrays, lambda c, z: z == 2))]


def test_geometry_reads_headers_only(spark, folder, monkeypatch):
    root, arrays = folder
    rows = {r.volume_id: r for r in images.read_geometry(spark, str(root)).collect()}
    assert {v: (r.channels, *r["size"]) for v, r in rows.items()} == {v: a.shape for v, a in arrays.items()}
    assert all(r.spacing == [2.0, 0.5, 0.25] for r in rows.values())
    _, size = bytes_read(monkeypatch, volumes.NiftiReader({"path": str(root / "sub")}, "geometry"))
    assert size == 2 * 352


def test_a_short_file_is_an_error(spark, tmp_path):
    (tmp_path / "cut.nii").write_bytes(file_of(np.ones((1, 4, 5, 6), "i2"))[:-7])
    with pytest.raises(Exception, match="ends inside plane 3"):
        images.read_nifti(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("compress", [False, True])
def test_channels_and_folders_round_trip(spark, folder, tmp_path, compress):
    root, arrays = folder
    planes = images.read_nifti(spark, str(root)).repartition(7)
    geometry = images.read_geometry(spark, str(root)).select("volume_id", F.col("size")[0].alias("depth"), *[
        F.col("spacing")[k].alias(f"spacing_{a}") for k, a in enumerate("zyx")])
    for _ in range(2):  # a second run replaces the files
        out.write_nifti(planes, str(tmp_path / "o"), geometry, compress)
    assert same(arrays_of(images.read_nifti(spark, str(tmp_path / "o")).collect()), expected(arrays))
    assert all(r.spacing == [2.0, 0.5, 0.25] for r in images.read_geometry(spark, str(tmp_path / "o")).collect())
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == sorted(
        ["sub", *[f"{n}.nii{'.gz' if compress else ''}" for n in ("a", "packed")]])
    # planes that are not given are zero
    write_volumes(planes.where("volume_id = 'sub/b' AND z % 2 = 1"), str(tmp_path / "half"), 12)
    half = np.zeros((3, 12, 4, 5), "u1")
    half[:, 1:10:2] = arrays["sub/b"][:, 1::2]
    assert same(arrays_of(images.read_nifti(spark, str(tmp_path / "half")).collect()), expected({"sub/b": half}))


def test_nothing_half_written_is_seen(spark, folder, tmp_path):
    root, _ = folder
    planes = images.read_nifti(spark, str(root))
    twice = planes.unionByName(planes.where("volume_id = 'sub/b' AND z = 3"))
    for rows, depth, message in ((twice, None, "given twice"), (planes, 4, "outside the volume"),
                                 (planes.withColumn("width", F.when(F.col("z") == 1, 1).otherwise(F.col("width"))), None, "another kind")):
        with pytest.raises(Exception, match=message):
            write_volumes(rows, str(tmp_path / "o"), depth)
        assert not [p for p in (tmp_path / "o").rglob("*") if p.is_file()]
    with pytest.raises(ValueError, match="does not know"):
        write_volumes(planes.withColumn("mask", F.lit(1)), str(tmp_path / "o"))


def test_attempts_are_apart_until_the_commit(folder, tmp_path):
    """Two attempts of one task leave the files of the one that Spark names in the commit."""
    import pyarrow as pa

    from voxloom.sinks.volumes import COLUMNS, NiftiWriter
    row = {"volume_id": "s/v", "channel": 0, "z": 0, "height": 2, "width": 2, "dtype": "<u2", "pixels": bytes(8), "depth": 1,
           "channels": 1, "spacing": None}
    writer = NiftiWriter({"path": str(tmp_path)}, list(COLUMNS))
    made = [writer.write(iter([pa.RecordBatch.from_pylist([row])])) for _ in range(2)]
    assert not (tmp_path / "s").exists()
    writer.commit([made[1], None])
    assert [p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file()] == ["s/v.nii"]
    again = NiftiWriter({"path": str(tmp_path)}, list(COLUMNS))
    again.abort([again.write(iter([pa.RecordBatch.from_pylist([row])]))])
    assert len(list(tmp_path.rglob("*"))) == 2
    with pytest.raises(ValueError, match="outside the folder"):
        again.write(iter([pa.RecordBatch.from_pylist([{**row, "volume_id": "../v"}])]))
