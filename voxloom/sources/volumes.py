"""NIfTI files as a Spark data source: planes, voxels or geometry.

A file is cut by its size alone, as Spark cuts splittable files: a task reads
the header and then the planes whose first byte lies in its range, so an
uncompressed volume is as many tasks as it has ``split_bytes``, and small files
share a task up to that size.  A range of
planes, a channel or a volume reach the reader as options; other planes are not
read.  Geometry takes the header's 352 bytes of each file.

Filters are not pushed by Spark: in 4.1 what is pushed into a Python source
stays in its relation, and a later read of the same DataFrame without the filter
loses rows.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxloom.sources.images import nifti_layout

FORMAT = "voxloom_nifti"
HEADER = 352
SPLIT_BYTES, BATCH_BYTES, GEOMETRY_FILES = 32 << 20, 8 << 20, 256
#: What opening a file counts for when small files are put into one task.
OPEN_BYTES, LEAST_PIECES = 1 << 20, 64
SCHEMAS = {
    "planes": "volume_id string, z int, height int, width int, dtype string, pixels binary, channel int",
    "voxels": "volume_id string, channel int, z int, y int, x int, value double",
    "geometry": "volume_id string, size array<int>, spacing array<double>, channels int",
}


def open_folder(path: str) -> tuple[pf.FileSystem, str]:
    """The file system of a path or URI (local, or any that Arrow reaches, as HDFS and S3) and the path in it."""
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return pf.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))
    return pf.LocalFileSystem(), posixpath.abspath(path)


@dataclass
class Piece(InputPartition):
    """Files, with the range of bytes in which the planes begin that this task reads (the whole file if packed)."""
    files: list[tuple[str, str, int, int]]

    def __init__(self, files):
        super().__init__(files)
        self.files = files


class NiftiReader(DataSourceReader):
    def __init__(self, options: dict, rows: str):
        self.path, self.glob, self.rows = options["path"], options.get("glob", "*.nii*"), rows
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.volume = options.get("volume")
        self.channel = int(options["channel"]) if "channel" in options else None
        self.z = range(int(options["z_from"]), int(options["z_to"])) if "z_from" in options else None

    def partitions(self) -> Sequence[Piece]:
        files, root = open_folder(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == pf.FileType.File else files.get_file_info(pf.FileSelector(root, recursive=True))
        base = posixpath.dirname(root) if info.type == pf.FileType.File else root
        whole: list[tuple[str, str, int, int]] = []
        ranges: list[tuple[str, str, int, int]] = []
        for f in sorted((f for f in found if f.type == pf.FileType.File), key=lambda f: f.path):
            below = posixpath.relpath(f.path, base)
            hidden = any(part[0] in "._" for part in below.split("/"))
            name = re.sub(r"\.(nii|img)(\.gz)?$", "", below)
            if hidden or not fnmatch.fnmatch(f.base_name, self.glob) or self.volume not in (None, name):
                continue
            if self.rows == "geometry":
                whole.append((name, f.path, 0, f.size))
            elif f.path.endswith(".gz"):
                ranges.append((name, f.path, 0, f.size))
            else:
                ranges += [(name, f.path, a, min(a + self.split, f.size)) for a in range(0, max(1, f.size), self.split)]
        # small files share a task, once there are more of them than a cluster runs at a time
        most = min(self.split, sum(b - a + OPEN_BYTES for _, _, a, b in ranges) // LEAST_PIECES)
        pieces, room = [], 0
        for part in ranges:
            cost = part[3] - part[2] + OPEN_BYTES
            if not pieces or cost > room:
                pieces.append(Piece([]))
                room = most
            pieces[-1].files.append(part)
            room -= cost
        pieces += [Piece(whole[k:k + GEOMETRY_FILES]) for k in range(0, len(whole), GEOMETRY_FILES)]
        return pieces or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        files, _ = open_folder(self.path)
        for name, path, start, stop in partition.files:
            if self.rows == "geometry":
                yield self._geometry(files, name, path)
            elif path.endswith(".gz"):
                yield from self._batches(name, *self._unpacked(files, path))
            else:
                yield from self._batches(name, *self._ranged(files, path, start, stop))

    def _geometry(self, files: pf.FileSystem, name: str, path: str) -> pa.RecordBatch:
        with files.open_input_file(path) as f:
            head = f.read_at(HEADER, 0)
            if head[:2] == b"\x1f\x8b":
                inflate, at, head = zlib.decompressobj(31), 0, b""
                while len(head) < HEADER and (part := f.read_at(4096, at)):
                    head += inflate.decompress(part)
                    at += len(part)
        layout = nifti_layout(head)
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([layout.shape[1:]], pa.list_(pa.int32())),
             pa.array([layout.spacing], pa.list_(pa.float64())), pa.array([layout.shape[0]], pa.int32())],
            names=["volume_id", "size", "spacing", "channels"])

    def _ranged(self, files: pf.FileSystem, path: str, start: int, stop: int):
        """Layout, and (plane number, bytes) of the wanted planes that begin in the range."""
        with files.open_input_file(path) as f:
            layout = nifti_layout(f.read_at(HEADER, 0))

        def planes():
            size = layout.plane_bytes
            first = max(0, -(-(start - layout.offset) // size))
            last = min(layout.planes, max(0, -(-(stop - layout.offset) // size)))
            with files.open_input_file(path) as f:
                for number in range(first, last):
                    if self._wanted(number, layout):
                        data = f.read_at(size, layout.offset + number * size)
                        if len(data) < size:
                            raise ValueError(f"{path} ends inside plane {number}")
                        yield number, data
        return layout, planes()

    def _unpacked(self, files: pf.FileSystem, path: str):
        stream = files.open_input_stream(path, compression="gzip")
        head = stream.read(HEADER)
        layout = nifti_layout(head)

        def planes():
            with stream:
                rest = layout.offset - len(head)
                if rest > 0:
                    stream.read(rest)
                for number in range(layout.planes):
                    data = stream.read(layout.plane_bytes)
                    if len(data) < layout.plane_bytes:
                        raise ValueError(f"{path} ends inside plane {number}")
                    if self._wanted(number, layout):
                        yield number, data
        return layout, planes()

    def _wanted(self, number: int, layout) -> bool:
        channel, z = divmod(number, layout.shape[1])
        return self.channel in (None, channel) and (self.z is None or z in self.z)

    def _batches(self, name: str, layout, planes) -> Iterator[pa.RecordBatch]:
        depth, height, width = layout.shape[1:]
        waiting: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for number, data in planes:
            plane = np.frombuffer(data, layout.dtype).reshape(height, width)
            waiting.append((*divmod(number, depth), layout.scaled(plane)))
            size += waiting[-1][2].nbytes * (1 if self.rows == "planes" else 4)
            if size >= BATCH_BYTES:
                yield self._batch(name, waiting)
                waiting, size = [], 0
        if waiting:
            yield self._batch(name, waiting)

    def _batch(self, name: str, planes: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        if self.rows == "planes":
            little = [np.ascontiguousarray(p).astype(p.dtype.newbyteorder("<"), copy=False) for _, _, p in planes]
            count = len(planes)
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * count), pa.array([z for _, z, _ in planes], pa.int32()),
                 pa.array([p.shape[0] for p in little], pa.int32()), pa.array([p.shape[1] for p in little], pa.int32()),
                 pa.array([p.dtype.str for p in little]), pa.array([p.tobytes() for p in little], pa.binary()),
                 pa.array([c for c, _, _ in planes], pa.int32())],
                names=["volume_id", "z", "height", "width", "dtype", "pixels", "channel"])
        places = [np.nonzero(p) for _, _, p in planes]
        counts = [len(y) for y, _ in places]
        column = lambda k: np.repeat(np.array([p[k] for p in planes], np.int32), counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([name]).take(pa.array(np.zeros(sum(counts), np.int64))), pa.array(column(0)), pa.array(column(1)),
             *[pa.array(np.concatenate([p[k] for p in places]).astype(np.int32)) for k in (0, 1)],
             pa.array(np.concatenate([p[at] for (_, _, p), at in zip(planes, places)]).astype(np.float64))],
            names=["volume_id", "channel", "z", "y", "x", "value"])


class NiftiSource(DataSource):
    """Options: path, rows (planes, voxels or geometry), glob, split_bytes; volume, channel, and z_from and z_to (not
    included) for what is read of them."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "planes")]

    def reader(self, schema) -> NiftiReader:
        return NiftiReader(dict(self.options), self.options.get("rows", "planes"))

    def writer(self, schema, overwrite: bool):
        from voxloom.sinks.volumes import NiftiWriter
        return NiftiWriter(dict(self.options), schema.names)


def scan(spark: SparkSession, path: str, rows: str = "planes", glob: str = "*.nii*", z: tuple[int, int] | None = None,
         channel: int | None = None, volume: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of all NIfTI files below ``path``: of one volume or channel, or of the planes z[0] <= z < z[1], where given."""
    spark.dataSource.register(NiftiSource)
    options = {"rows": rows, "glob": glob, "split_bytes": split_bytes, "volume": volume, "channel": channel,
               **({"z_from": z[0], "z_to": z[1]} if z else {})}
    return spark.read.format(FORMAT).options(**{k: v for k, v in options.items() if v is not None}).load(path)
