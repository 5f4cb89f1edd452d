"""NIfTI files written by a data source with a commit.

Each volume is one file, streamed in plane order by one task that holds one
batch of planes.  Tasks write below a staging folder of the job; the driver
moves whole files to their places once every task has ended well, and removes
the staging folder in any case.  So a failed or repeated task leaves nothing
that a reader could see.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from voxloom.sinks.images import nifti_header
from voxloom.sources.volumes import FORMAT, NiftiSource, open_folder
from voxloom.support import attach, materialize

#: Columns of the rows that the writer takes, in this order of volume_id, channel and z.
COLUMNS = ("volume_id", "channel", "z", "height", "width", "dtype", "pixels", "depth", "channels", "spacing")
BATCH_BYTES = 64 << 20
#: Pixels that one task writes, unless a volume is larger.
TASK_BYTES = 4 << 20
GZIP_LEVEL = 6


@dataclass
class Written(WriterCommitMessage):
    """Finished files: where they are, and where they belong."""
    moves: list[tuple[str, str]]


class _File:
    """One volume that is being written; planes that are not given are zero."""

    def __init__(self, files: pf.FileSystem, path: str, row: dict, compress: bool):
        self.row, self.next = row, 0
        files.create_dir(posixpath.dirname(path), recursive=True)
        self.out = files.open_output_stream(path, compression=None)
        # Arrow's own gzip stream takes the highest level, several times as long for hardly smaller files
        self.packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31) if compress else None
        kind = np.dtype(row["dtype"])
        self._put(nifti_header((row["depth"], row["height"], row["width"]), kind, row["spacing"] or (1.0, 1.0, 1.0),
                               row["channels"]))

    def _put(self, data: bytes) -> None:
        self.out.write(data if self.packer is None else self.packer.compress(data))

    def add(self, row: dict) -> None:
        same = all(row[c] == self.row[c] for c in ("height", "width", "dtype", "depth", "channels"))
        number = row["channel"] * row["depth"] + row["z"]
        inside = 0 <= row["z"] < row["depth"] and 0 <= row["channel"] < row["channels"]
        if not same or not inside or number < self.next:
            raise ValueError(f"plane {row['z']} of channel {row['channel']} of {row['volume_id']} is "
                             + ("outside the volume" if not inside else "of another kind" if not same else "given twice"))
        self._skip(number)
        self._put(row["pixels"])
        self.next += 1

    def _skip(self, number: int) -> None:
        empty = bytes(self.row["height"] * self.row["width"] * np.dtype(self.row["dtype"]).itemsize)
        while self.next < number:
            self._put(empty)
            self.next += 1

    def close(self) -> None:
        self._skip(self.row["depth"] * self.row["channels"])
        if self.packer is not None:
            self.out.write(self.packer.flush())
        self.out.close()


class NiftiWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str]):
        if sorted(names) != sorted(COLUMNS):
            raise ValueError(f"the writer takes the columns {COLUMNS}")
        self.path, self.compress = options["path"], options.get("compress", "false") == "true"
        _, root = open_folder(self.path)
        self.root, self.staging = root, posixpath.join(root, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _ = open_folder(self.path)
        attempt = posixpath.join(self.staging, uuid.uuid4().hex)
        suffix = ".nii.gz" if self.compress else ".nii"
        moves: list[tuple[str, str]] = []
        current: _File | None = None
        for batch in iterator:
            for values in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in COLUMNS]):
                row = dict(zip(COLUMNS, values))
                if current is None or row["volume_id"] != current.row["volume_id"]:
                    if current is not None:
                        current.close()
                    name = row["volume_id"] + suffix
                    if name.startswith(("/", "../")) or "/../" in name:
                        raise ValueError(f"{name} lies outside the folder")
                    moves.append((posixpath.join(attempt, name), posixpath.join(self.root, name)))
                    current = _File(files, moves[-1][0], row, self.compress)
                current.add(row)
        if current is not None:
            current.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = open_folder(self.path)
        moves = [m for message in messages if message is not None for m in message.moves]
        targets = [target for _, target in moves]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError("two tasks wrote the same volume: rows of a volume must be in one partition")
        for folder in sorted({posixpath.dirname(target) for target in targets}):
            files.create_dir(folder, recursive=True)
        for source, target in moves:
            files.move(source, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = open_folder(self.path)
        if files.get_file_info(self.staging).type == pf.FileType.Directory:
            files.delete_dir(self.staging)


def write_volumes(planes: DataFrame, folder: str, depth: int | DataFrame | None = None, compress: bool = False) -> None:
    """One file per volume below ``folder``; a volume id may name folders (``sub/a``).

    ``planes`` has volume_id, z, height, width, dtype, pixels and perhaps channel; several channels become the fourth
    axis.  ``depth`` is the number of planes of all volumes, or a geometry table (volume_id, depth and perhaps spacing_z,
    spacing_y, spacing_x); without it a volume ends with its last plane.  Planes that are not given are zero.  A plane
    given twice, of another size or type than the others of its volume, or outside its volume is an error, as is any
    other column; then no file appears.
    """
    known = ["volume_id", "z", "height", "width", "dtype", "pixels"]
    extra = set(planes.columns) - {*known, "channel"}
    if extra:
        raise ValueError(f"the writer does not know the columns {sorted(extra)}")
    # planes are costly to build and needed twice
    rows = materialize(planes if "channel" in planes.columns else planes.withColumn("channel", F.lit(0)))
    sizes = rows.groupBy("volume_id").agg((F.max("channel") + 1).alias("channels"), (F.max("z") + 1).alias("_planes"),
                                          F.max(F.length("pixels")).alias("_bytes"), F.sum(F.length("pixels")).alias("_all"))
    steps = ("spacing_z", "spacing_y", "spacing_x")
    spacing = F.lit(None).cast("array<double>")
    if isinstance(depth, DataFrame):
        if set(steps) <= set(depth.columns):
            spacing = F.array(*[F.col(s).cast("double") for s in steps])
        sizes = sizes.join(depth.select("volume_id", F.col("depth").cast("int").alias("depth"), spacing.alias("spacing")), "volume_id")
    else:
        deep = F.col("_planes") if depth is None else F.lit(int(depth))
        sizes = sizes.withColumns({"depth": deep.cast("int"), "spacing": spacing})
    sizes = materialize(sizes)
    largest, whole_bytes = (n or 1 for n in sizes.agg(F.max("_bytes"), F.sum("_all")).first())
    spark = planes.sparkSession
    spark.dataSource.register(NiftiSource)
    whole = attach(rows, sizes.drop("_planes", "_bytes", "_all"), ["volume_id"], "left", staged=True).select(
        *[F.col(c).cast("int") if c in ("channel", "channels", "depth", "z") else F.col(c) for c in COLUMNS])
    # one task has all planes of a volume in order, a bounded number of them at a time
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(int(before), BATCH_BYTES // largest))))
    try:
        parts = -(-whole_bytes // TASK_BYTES)
        (whole.repartition(parts, "volume_id").sortWithinPartitions("volume_id", "channel", "z").write.format(FORMAT)
         .option("compress", str(compress).lower()).mode("append").save(folder))
    finally:
        spark.conf.set(name, before)
