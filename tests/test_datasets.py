"""Import of tasks, conversions, inventories and summaries on small files."""

import json

import numpy as np
import pytest
from test_files import png
from test_volumes import file_of

from voxloom.plans import datasets
from voxloom.sinks import images as out
from voxloom.sources import images, tabular


def volume(spark, folder, name):
    rows = [r for r in images.read_nifti(spark, str(folder)).collect() if r.volume_id == name]
    return np.stack([np.frombuffer(r.pixels, r.dtype).reshape(r.height, r.width) for r in sorted(rows, key=lambda r: (r.channel, r.z))])


def test_import_of_a_task(spark, tmp_path):
    rng = np.random.default_rng(4)
    task = tmp_path / "in" / "Task05_Prostate"
    arrays = {"imagesTr/a": rng.integers(0, 9, (2, 3, 4, 5)).astype("i2"), "imagesTr/b": rng.integers(0, 9, (2, 6, 2, 3)).astype("i2"),
              "imagesTs/c": rng.integers(0, 9, (2, 2, 2, 2)).astype("f4"), "labelsTr/a": rng.integers(0, 3, (1, 3, 4, 5)).astype("u1"),
              "labelsTr/b": rng.integers(0, 3, (1, 6, 2, 3)).astype("u1")}
    for name, array in arrays.items():
        path = task / f"{name}.nii"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(file_of(array, (3.0, 2.0, 1.0)))
    (task / "imagesTr" / "._a.nii").write_bytes(b"hidden")
    files = datasets.import_task(spark, str(task), str(tmp_path / "out"), {"0": "T2", "1": "ADC"}, {"0": "background"})
    target = tmp_path / "out" / "Task005_Prostate"
    assert sorted(p.relative_to(target).as_posix() for p in target.rglob("*.nii.gz")) == sorted(
        [f"{n}_{c:04d}.nii.gz" for n in ("imagesTr/a", "imagesTr/b", "imagesTs/c") for c in (0, 1)]
        + ["labelsTr/a.nii.gz", "labelsTr/b.nii.gz"]) and files.count() == 8
    for name, array in arrays.items():
        for c, channel in enumerate(array):
            assert np.array_equal(volume(spark, target, name if name.startswith("labels") else f"{name}_{c:04d}"), channel)
    assert {tuple(r.spacing) for r in images.read_geometry(spark, str(target)).collect()} == {(3.0, 2.0, 1.0)}
    manifest = spark.read.schema(tabular.MANIFEST).json(str(target / "dataset")).first()
    assert manifest.name == "Task005_Prostate" and {e.image for e in manifest.training} == {f"./imagesTr/{c}.nii.gz" for c in "ab"}
    assert manifest.test == ["./imagesTs/c.nii.gz"]
    with pytest.raises(ValueError, match="TaskXX"):
        datasets.import_task(spark, str(tmp_path), str(tmp_path), {}, {})
    assert datasets.output_folder(str(task), "o", 12) == "o/Task012_Prostate"


def test_images_and_stacks_to_nifti_and_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    grey, seg = rng.integers(0, 200, (5, 6)).astype("u1"), rng.integers(0, 3, (5, 6)).astype("u1")
    (tmp_path / "png" / "s").mkdir(parents=True)
    (tmp_path / "png" / "s" / "one.png").write_bytes(png(grey))
    datasets.images_to_nifti(spark, str(tmp_path / "png"), str(tmp_path / "n"))
    assert np.array_equal(volume(spark, tmp_path / "n", "s/one_0000")[0], grey)
    assert images.read_geometry(spark, str(tmp_path / "n")).first().spacing == [999.0, 1.0, 1.0]
    (tmp_path / "seg").mkdir()
    (tmp_path / "seg" / "two.png").write_bytes(png(seg))
    datasets.images_to_nifti(spark, str(tmp_path / "seg"), str(tmp_path / "m"), is_seg=True,
                             transform=lambda planes: datasets.cast_planes(planes, "u4"))
    back = volume(spark, tmp_path / "m", "two")
    assert back.dtype == np.uint32 and np.array_equal(back[0], seg)
    stack = rng.integers(0, 250, (4, 3, 5)).astype("u1")
    for z, plane in enumerate(stack):
        path = tmp_path / "tif" / "v" / f"p{z}.tif"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(out.tiff_bytes(plane))
    datasets.tiff_to_nifti(spark, str(tmp_path / "tif"), str(tmp_path / "t"), (5, 1, 0.5), channel=1)
    assert np.array_equal(volume(spark, tmp_path / "t", "v_0001"), stack)
    assert images.read_geometry(spark, str(tmp_path / "t")).first().spacing == [5.0, 1.0, 0.5]
    datasets.nifti_to_tiff(spark, str(tmp_path / "t"), str(tmp_path / "back"))
    rows = images.planes_to_voxels(images.read_tiff_stack(spark, str(tmp_path / "back"))).collect()
    assert all(stack[r.z, r.y, r.x] == r.value for r in rows) and len(rows) == np.count_nonzero(stack)


def test_colour_images(spark, tmp_path):
    import struct
    import zlib
    colour = np.random.default_rng(1).integers(0, 255, (4, 5, 3)).astype("u1")
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    body = b"".join(b"\0" + row.tobytes() for row in colour)
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 4, 8, 2, 0, 0, 0))
                                     + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))
    rows = images.read_png_images(spark, str(tmp_path)).collect()
    assert len(rows) == 3
    for r in rows:
        assert np.array_equal(np.frombuffer(r.pixels, r.dtype).reshape(4, 5), colour[:, :, r.channel])


def test_cases_come_with_their_properties(spark, tmp_path):
    for name in ("a", "s/b"):
        path = tmp_path / f"{name}.nii"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(file_of(np.ones((1, 2, 3, 4), "i2")))
        path.with_suffix(".json").write_text(json.dumps({"crop": [1, 2], "classes": [0, 1]}, indent=1))
    found = {r.volume_id: r for r in datasets.load_preprocessed(spark, str(tmp_path), "crop array<int>, classes array<int>").collect()}
    assert found.keys() == {"a", "s/b"} and found["s/b"].crop == [1, 2] and found["a"]["size"] == [2, 3, 4]
    (tmp_path / "c.nii").write_bytes(file_of(np.ones((1, 2, 3, 4), "i2")))
    with pytest.raises(Exception, match="no properties for c"):
        datasets.load_preprocessed(spark, str(tmp_path), "crop array<int>").collect()


def test_crawl_names_files_by_their_folders(spark, tmp_path):
    for name in ("3d/Task001/fold0/summary.json", "3d/Task001/fold1/summary.json", "fold0/Summary.json", "fold0/x.json"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("{}")
    flat = lambda **o: sorted(r.flat_name for r in datasets.crawl_files(spark, str(tmp_path), **o).collect())
    assert flat() == ["3d__Task001__fold0summary.json", "fold0Summary.json"]
    assert flat(prefix="run_") == ["run___3d__Task001__fold0summary.json", "run___fold0Summary.json"]


def test_merged_summaries(spark, tmp_path):
    def table(shift):
        rows = ["Label,a,b,c,d,e,f"] + [f"case{k},0,0,0,9,9,9" for k in range(10)]
        return rows + [f"Mean,{0.1 + shift},{0.2 + shift},{0.3 + shift},5.5,4,3"] + ["StdDev,1,1,1,1,1,1"] * 4
    for place, shift in (("one/runA", 0.0), ("two/runA", 0.5)):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "Stats_Validation_final.csv").write_text("\n".join(table(shift)) + "\n")
    rows = {r.name: r for r in datasets.merge_summaries(spark, str(tmp_path), cases=10).collect()}
    assert rows.keys() == {"runA_one", "runA_two"}
    first = rows["runA_one"]
    assert (first.dice_whole, first.dice_core, first.dice_enh, first.hd95_whole, first.hd95_core, first.hd95_enh) == (0.2, 0.3, 0.1, 4, 3, 5.5)
    assert first.dice_mean == pytest.approx(0.2) and first.hd95_mean == pytest.approx(12.5 / 3)
    with pytest.raises(Exception, match="another number of rows"):
        datasets.merge_summaries(spark, str(tmp_path)).collect()

