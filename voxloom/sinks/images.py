"""Volume writers. Files go to a folder that all executors share."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow.fs import FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.sources.images import NIFTI_TYPES, PLANE
from voxloom.sources.volumes import open_folder
from voxloom.support import spread

HEADER_BYTES = 352
#: Planes that a task fills at once.
PLANE_BYTES = 16 << 20


def to_planes(voxels: DataFrame, key: str, value: str, height: int, width: int, dtype: str, depth: int,
              tasks: int | None = None) -> DataFrame:
    """Dense planes of sparse voxels, also the empty ones.

    Rows arrive sorted by volume and plane, so planes are filled as they come, a bounded number at a time.  ``tasks`` is as
    for ``support.spread``.
    """
    every = (voxels.select(key).distinct()
             .select(key, F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("z"))
             .withColumns({"y": F.lit(-1), "x": F.lit(-1), "_v": F.lit(0.0)}))
    rows = voxels.select(key, "z", "y", "x", F.col(value).cast("double").alias("_v")).unionByName(every)
    code = np.dtype(dtype).newbyteorder("<").str
    at_once = max(1, PLANE_BYTES // (height * width * np.dtype(dtype).itemsize))

    def frame(names: list, planes: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"volume_id": [str(k) for k, _ in names], "z": [z for _, z in names], "height": height,
                             "width": width, "dtype": code, "pixels": [p.tobytes() for p in planes]})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, last = None, None  # the plane that the next rows may still belong to
        for pdf in batches:
            if pdf.empty:
                continue
            ids = [pd.factorize(pdf[c], use_na_sentinel=False)[0] for c in (key, "z")]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(ids[0]) != 0) | (np.diff(ids[1]) != 0)]))
            ends = np.append(first[1:], len(pdf))
            k, z = pdf[key].iloc[first], pdf["z"].iloc[first]
            names = [(a, None if pd.isna(b) else int(b)) for a, b in zip(k, z)]
            names = [(None if pd.isna(a) else a, b) for a, b in names]
            if waiting is not None and names[0] != waiting:
                yield frame([waiting], last)
                waiting, last = None, None
            number = np.repeat(np.arange(len(first)), ends - first)
            real = ~(pdf["y"] < 0).to_numpy()  # a row without a place is an error below
            for low in range(0, len(first), at_once):
                high = min(low + at_once, len(first))
                planes = np.zeros((high - low, height, width), dtype)
                if low == 0 and last is not None:
                    planes[0] = last[0]
                here = np.arange(first[low], ends[high - 1])
                here = here[real[here]]
                part = pdf.iloc[here]
                planes[number[here] - low, part["y"].to_numpy(np.int64), part["x"].to_numpy(np.int64)] = part["_v"].to_numpy().astype(dtype)
                done = high - low - (high == len(first))
                if done:
                    yield frame(names[low:low + done], planes[:done])
            waiting, last = names[-1], planes[-1:].copy()
        if waiting is not None:
            yield frame([waiting], last)
    return spread(rows, key, "z", tasks=tasks).sortWithinPartitions(key, "z").mapInPandas(build, PLANE)


def nifti_header(shape: Sequence[int], dtype: np.dtype, spacing: Sequence[float] = (1.0, 1.0, 1.0), channels: int = 1,
                 ) -> bytes:
    """Header of (z, y, x) volumes, x fastest, shown with x and y reversed; several channels are a fourth axis."""
    code = {v: k for k, v in NIFTI_TYPES.items()}[dtype.str[1:]]
    z, y, x = shape
    out = bytearray(HEADER_BYTES)
    struct.pack_into("<i", out, 0, 348)
    struct.pack_into("<8h", out, 40, 3 if channels == 1 else 4, x, y, z, channels, 1, 1, 1)
    struct.pack_into("<2h", out, 70, code, dtype.itemsize * 8)
    struct.pack_into("<8f", out, 76, 1.0, spacing[2], spacing[1], spacing[0], 0, 0, 0, 0)
    struct.pack_into("<3f", out, 108, float(HEADER_BYTES), 1.0, 0.0)
    struct.pack_into("<2h", out, 252, 0, 2)
    struct.pack_into("<12f", out, 280, -spacing[2], 0, 0, 0, 0, -spacing[1], 0, 0, 0, 0, spacing[0], 0)
    out[344:348] = b"n+1\0"
    return bytes(out)


def write_nifti(planes: DataFrame, folder: str, depth: int | DataFrame | None = None, compress: bool = False) -> None:
    """One file per volume, published once all of them are whole; see ``sinks.volumes.write_volumes``."""
    from voxloom.sinks.volumes import write_volumes
    write_volumes(planes, folder, depth, compress)


def tiff_bytes(plane: np.ndarray) -> bytes:
    """A one-strip uncompressed grey TIFF."""
    kind = {"u": 1, "i": 2, "f": 3}[plane.dtype.kind]
    data = np.ascontiguousarray(plane).astype(plane.dtype.newbyteorder("<")).tobytes()
    # Tag, type (3 short, 4 long), value; tags in ascending order.
    tags = [(256, 4, plane.shape[1]), (257, 4, plane.shape[0]), (258, 3, plane.dtype.itemsize * 8), (259, 3, 1),
            (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, plane.shape[0]), (279, 4, len(data)), (339, 3, kind)]
    padded = data + b"\0" * (len(data) % 2)
    table = struct.pack("<H", len(tags))
    for tag, form, value in tags:
        table += struct.pack("<HHI", tag, form, 1) + struct.pack("<HH" if form == 3 else "<I", *((value, 0) if form == 3 else (value,)))
    return b"II*\0" + struct.pack("<I", 8 + len(padded)) + padded + table + struct.pack("<I", 0)


def write_tiff_slices(planes: DataFrame, folder: str, prefix: str = "label_Z", digits: int = 4, skip_existing: bool = False,
                      ) -> None:
    """One TIFF per plane below ``folder/volume_id``; with ``skip_existing`` finished files are kept."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = open_folder(folder)
        made = set()
        for batch in batches:
            written = 0
            for row in batch.itertuples(index=False):
                path = f"{root}/{row.volume_id}/{prefix}{row.z:0{digits}d}.tif"
                if row.volume_id not in made:
                    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    made.add(row.volume_id)
                if skip_existing and files.get_file_info(path).type != FileType.NotFound:
                    continue
                temporary = f"{path}.{uuid.uuid4().hex}"
                with files.open_output_stream(temporary) as out:
                    out.write(tiff_bytes(np.frombuffer(row.pixels, row.dtype).reshape(row.height, row.width)))
                files.move(temporary, path)
                written += 1
            yield pd.DataFrame({"planes": [written]})
    planes.mapInPandas(write, "planes long").agg(F.sum("planes")).collect()
