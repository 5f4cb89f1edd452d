"""Volume importers: image files become z-planes, planes become sparse voxels.

Each file (or array chunk) is one row of a binary scan, so Spark spreads the
files; decoding one of them is the only per-row work. In memory the axes are
(z, y, x) everywhere, whatever the file order.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.support import materialize, spread, tasks_for

PLANE = "volume_id string, z int, height int, width int, dtype string, pixels binary"
VOXEL = "volume_id string, z int, y int, x int, value double"

# NIfTI-1 datatype codes and the numpy types they stand for.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
# TIFF tags read here, and sample formats 1 to 3.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 273, 278, 279, 339
TIFF_KINDS = {1: "u", 2: "i", 3: "f"}
#: Folders that a task lists; files and bytes that a task decodes; pixels, and cells looked through, of a batch.
LIST_FOLDERS, TASK_FILES, TASK_BYTES, BATCH_BYTES, BATCH_CELLS = 256, 4096, 64 << 20, 8 << 20, 1 << 20


@dataclass
class Layout:
    """Where the values of an image file are and what they mean: shape is (channel, z, y, x)."""
    shape: tuple[int, int, int, int]
    spacing: list[float]
    dtype: np.dtype
    offset: int
    slope: float
    inter: float

    @property
    def plane_bytes(self) -> int:
        return self.shape[2] * self.shape[3] * self.dtype.itemsize

    @property
    def planes(self) -> int:
        return self.shape[0] * self.shape[1]

    def scaled(self, values: np.ndarray) -> np.ndarray:
        if self.slope in (0.0, 1.0) and self.inter == 0.0:
            return values
        return values.astype(np.float64) * (self.slope or 1.0) + self.inter


def nifti_layout(header: bytes) -> Layout:
    """Layout of a NIfTI-1 or ANALYZE image from its first 352 bytes.

    Axes beyond the third (time, modality, vector) together count the channels.
    """
    order = "<" if struct.unpack("<i", header[:4])[0] == 348 else ">"
    dims = struct.unpack(order + "8h", header[40:56])
    steps = struct.unpack(order + "8f", header[76:108])
    code = struct.unpack(order + "h", header[70:72])[0]
    offset, slope, inter = struct.unpack(order + "3f", header[108:120])
    axes = [max(1, int(d)) for d in dims[1:1 + dims[0]]] + [1] * (3 - dims[0])
    return Layout((int(np.prod(axes[3:], dtype=np.int64)), *axes[2::-1]), [float(s) for s in steps[3:0:-1]],
                  np.dtype(order + NIFTI_TYPES[code]), int(offset) or 352, slope, inter)


def nifti_volumes(content: bytes) -> np.ndarray:
    """(channel, z, y, x) array of a whole image, scaled if the header says so."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    layout = nifti_layout(content[:352])
    data = np.frombuffer(content, layout.dtype, count=int(np.prod(layout.shape)), offset=layout.offset)
    return layout.scaled(data.reshape(layout.shape))


def nifti_volume(content: bytes) -> np.ndarray:
    """(z, y, x) array of an image with one channel."""
    volumes = nifti_volumes(content)
    if len(volumes) != 1:
        raise ValueError(f"the image has {len(volumes)} channels")
    return volumes[0]


def tiff_page_count(content: bytes) -> int:
    """Number of pages from the chain of directories, without reading any of them."""
    order = "<" if content[:2] == b"II" else ">"
    at, pages = struct.unpack(order + "I", content[4:8])[0], 0
    while at:
        pages += 1
        entries = struct.unpack(order + "H", content[at:at + 2])[0]
        at = struct.unpack(order + "I", content[at + 2 + 12 * entries:at + 6 + 12 * entries])[0]
    return pages


def tiff_pages(content: bytes) -> Iterator[np.ndarray]:
    """Pages of a grey strip TIFF, uncompressed or deflate-packed."""
    order = "<" if content[:2] == b"II" else ">"
    at = struct.unpack(order + "I", content[4:8])[0]
    sizes = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}
    while at:
        count = struct.unpack(order + "H", content[at:at + 2])[0]
        tags: dict[int, tuple] = {}
        for i in range(count):
            tag, kind, n = struct.unpack(order + "HHI", content[at + 2 + 12 * i:at + 10 + 12 * i])
            if kind not in sizes:
                continue
            form = order + str(n) + sizes[kind]
            size, where = struct.calcsize(form), at + 10 + 12 * i
            if size > 4:
                where = struct.unpack(order + "I", content[where:where + 4])[0]
            tags[tag] = struct.unpack(form, content[where:where + size])
        packing = tags.get(COMPRESSION, (1,))[0]
        if packing not in (1, 8, 32946):
            raise ValueError(f"TIFF compression {packing} is not supported")
        strips = [content[o:o + c] for o, c in zip(tags[OFFSETS], tags[COUNTS])]
        raw = b"".join(zlib.decompress(s) if packing != 1 else s for s in strips)
        kind = order + TIFF_KINDS[tags.get(FORMAT, (1,))[0]] + str(tags[BITS][0] // 8)
        yield np.frombuffer(raw, kind).reshape(tags[HEIGHT][0], tags[WIDTH][0])
        at = struct.unpack(order + "I", content[at + 2 + 12 * count:at + 6 + 12 * count])[0]


def _unfilter(modes: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """Bytes (row, pixel, byte) from their filtered form.

    A byte depends on those to the left, above, and above left, so all pixels of one diagonal are taken at once.
    """
    height, width, step = coded.shape
    out = np.zeros((height + 1, width + 1, step), np.int64)
    for d in range(height + width - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        i = d - r
        left, above, corner = out[r + 1, i], out[r, i + 1], out[r, i]
        guess = left + above - corner
        near = np.abs(np.stack([guess - left, guess - above, guess - corner]))
        paeth = np.choose(near.argmin(axis=0), [left, above, corner])
        mode = modes[r][:, None]
        value = np.select([mode == 1, mode == 2, mode == 3, mode == 4], [left, above, (left + above) // 2, paeth], 0)
        out[r + 1, i + 1] = (coded[r, i] + value) % 256
    return out[1:, 1:].astype(np.uint8)


def png_page(content: bytes) -> np.ndarray:
    """A non-interlaced PNG of 8 or 16 bits: (height, width), or with colour (height, width, channel)."""
    at, packed, header = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at:at + 8])
        body = content[at + 8:at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    width, height, bits, colour, _, _, interlace = header
    samples = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if samples is None or interlace or bits not in (8, 16):
        raise ValueError("only non-interlaced PNG of 8 or 16 bits without palette is supported")
    step = bits // 8 * samples
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    out = _unfilter(lines[:, 0], lines[:, 1:].reshape(height, width, step))
    shape = (height, width) if samples == 1 else (height, width, samples)
    return np.frombuffer(out.tobytes(), ">u2" if bits == 16 else "u1").reshape(shape)


def _plane_row(volume_id: str, z: int, plane: np.ndarray) -> tuple:
    little = np.ascontiguousarray(plane).astype(plane.dtype.newbyteorder("<"), copy=False)
    return volume_id, z, plane.shape[0], plane.shape[1], little.dtype.str, little.tobytes()


def _frame(rows: list, *more: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["volume_id", "z", "height", "width", "dtype", "pixels", *more])


def _plane_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      names=["volume_id", "z", "height", "width", "dtype", "pixels"])


def _below(root: str, path: str = "path") -> Column:
    """A file's path below ``root``, so that equal names in different folders stay apart."""
    base = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/")
    name = F.regexp_extract(path, re.escape(base) + "/(.*)$", 1)
    return F.when(name == "", F.regexp_extract(path, r"([^/]+)$", 1)).otherwise(name)


def _binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path))


def read_nifti(spark: SparkSession, path: str, glob: str = "*.nii*", **bounds) -> DataFrame:
    """Planes of every NIfTI file below ``path``, all channels.

    The volume id is the file's path below ``path`` without its suffix.  See ``sources.volumes.scan`` for how files
    are cut, and for the bounds z, channel and volume that spare reading the rest.
    """
    from voxloom.sources.volumes import scan
    return scan(spark, path, "planes", glob, **bounds)


def read_nifti_voxels(spark: SparkSession, path: str, glob: str = "*.nii*", **bounds) -> DataFrame:
    """Nonzero voxels of every NIfTI file below ``path``, decoded where the file is read; bounds as for ``read_nifti``."""
    from voxloom.sources.volumes import scan
    return scan(spark, path, "voxels", glob, **bounds)


def read_geometry(spark: SparkSession, path: str, glob: str = "*.nii*") -> DataFrame:
    """Size and spacing per file from its header alone, for the integrity rules."""
    from voxloom.sources.volumes import scan
    return scan(spark, path, "geometry", glob)


def read_analyze(spark: SparkSession, path: str) -> DataFrame:
    """Planes of ANALYZE pairs: every .img joined with the .hdr of the same name."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, header, content in zip(batch["volume_id"], batch["header"], batch["content"]):
                # the header is 348 bytes and the pixels start at 0 of the other file
                head = bytearray(header[:348].ljust(352, b"\0"))
                order = "<" if struct.unpack("<i", head[:4])[0] == 348 else ">"
                struct.pack_into(order + "3f", head, 108, 352.0, 1.0, 0.0)
                for channel, volume in enumerate(nifti_volumes(bytes(head) + content)):
                    for z, plane in enumerate(volume):
                        yield _frame([(*_plane_row(name, z, plane), channel)], "channel")
    name = F.regexp_replace("path", r"\.(hdr|img)$", "")
    headers = _binary(spark, path, "*.hdr").select(name.alias("_p"), F.col("content").alias("header"))
    images = _binary(spark, path, "*.img").select(name.alias("_p"), "content")
    both = images.join(headers, "_p").select(_below(path, "_p").alias("volume_id"), "header", "content")
    return both.mapInPandas(decode, PLANE + ", channel int")


def _roots(spark: SparkSession, path: str) -> list[str] | None:
    """Files and folders that ``path`` names, as Arrow opens them; None where only Spark does, or if there are none."""
    from voxloom.sources.volumes import open_folder
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    uris = [status.getPath().toUri() for status in found or ()]
    roots = [u.getPath() if u.getScheme() in (None, "file") else u.toString() for u in uris]
    try:
        known = all(root.endswith(open_folder(root)[1]) for root in roots)
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        known = False
    return roots if roots and known else None


def _listed(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    """Path and length of the files below ``roots`` whose names match ``glob``.

    Tasks list the folders, one level after the other, so the driver holds no list of files.  Hidden names are left out as
    Spark's readers do.
    """
    from voxloom.sources.volumes import open_folder

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, root = open_folder(path)
                info = files.get_file_info(root)
                found = [info] if info.type == FileType.File else files.get_file_info(FileSelector(root))
                found = [f for f in found if not (f.base_name[0] == "." or f.base_name[0] == "_" and "=" not in f.base_name
                                                  or f.base_name.endswith("._COPYING_"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.removesuffix(root) + f.path for f in found], pa.string()),
                     pa.array([f.size or 0 for f in found], pa.int64()),
                     pa.array([f.type == FileType.Directory for f in found], pa.bool_())], names=["path", "length", "folder"])

    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    folders, files = spark.createDataFrame([(root,) for root in roots], "path string").coalesce(1), None
    while True:
        level = materialize(folders.mapInArrow(look, "path string, length long, folder boolean"))
        files = level if files is None else files.unionByName(level)
        folders = level.where("folder").select("path")
        count = folders.count()
        if not count:
            break
        folders = spread(folders, "path", tasks=min(count, tasks_for(spark, count, LIST_FOLDERS)))
    return files.where(~F.col("folder") & F.regexp_extract("path", r"([^/]+)$", 1).rlike(pattern)).select("path", "length")


def _contents(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The files of a batch, read here if only their paths are in it."""
    from voxloom.sources.volumes import open_folder
    if "content" in batch.schema.names:
        yield from (value.as_py() for value in batch.column("content"))
        return
    for path in batch.column("path").to_pylist():
        files, root = open_folder(path)
        with files.open_input_file(root) as f:
            yield f.read()


def _stack(spark: SparkSession, path: str, glob: str, pages, pages_in) -> DataFrame:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            names, firsts = batch.column("volume_id").to_pylist(), batch.column("z").to_pylist()
            for name, z, content in zip(names, firsts, _contents(batch)):
                for page, plane in enumerate(pages(content)):
                    waiting.append(_plane_row(name, z + page, plane))
                    size += len(waiting[-1][-1])
                    if size >= BATCH_BYTES:
                        yield _plane_batch(waiting)
                        waiting, size = [], 0
        if waiting:
            yield _plane_batch(waiting)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([pages_in(c) for c in _contents(batch)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("path"), found], names=["path", "pages"])

    # files that Arrow opens are read by the tasks that decode them, so that no file is shuffled
    roots = _roots(spark, path)
    files = _binary(spark, path, glob).select("path", "content") if roots is None else _listed(spark, roots, glob)
    if roots is not None:
        number, length = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        tasks = max(tasks_for(spark, number, TASK_FILES), tasks_for(spark, length, TASK_BYTES))
        files = spread(files.select("path"), "path", tasks=tasks)
    below = F.regexp_replace(_below(path), r"/?[^/]+$", "")
    folder = F.when(below == "", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).otherwise(below)
    # a plane's number is the count of pages in the folder's earlier files, in the order of their names
    order = (files.mapInArrow(count, "path string, pages int")
             .withColumn("volume_id", folder)
             .withColumn("z", F.coalesce(F.sum("pages").over(
                 W.partitionBy("volume_id").orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
             .drop("pages"))
    if roots is None:
        return files.join(order, "path").select("volume_id", "z", "content").mapInArrow(decode, PLANE)
    return spread(order, "path", tasks=tasks).mapInArrow(decode, PLANE)


def read_tiff_stack(spark: SparkSession, path: str, glob: str = "*.tif*") -> DataFrame:
    """Planes of TIFF stacks, one folder per volume, ordered by file name."""
    return _stack(spark, path, glob, tiff_pages, tiff_page_count)


def read_png_stack(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    return _stack(spark, path, glob, lambda content: [png_page(content)], lambda content: 1)


def read_png_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """Every PNG file as a volume of one plane for each colour channel; the volume id is its path without the suffix."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["volume_id"], batch["content"]):
                page = png_page(content)
                for channel, plane in enumerate(page[None] if page.ndim == 2 else np.moveaxis(page, 2, 0)):
                    yield _frame([(*_plane_row(name, 0, plane), channel)], "channel")
    name = F.regexp_replace(_below(path), r"\.[^./]+$", "")
    return (_binary(spark, path, glob).select(name.alias("volume_id"), "content")
            .mapInPandas(decode, PLANE + ", channel int"))


def _unpack_chunk(content: bytes, codec: str | None) -> bytes:
    if codec is None:
        return content
    if codec in ("zlib", "gzip"):
        return zlib.decompress(content, 47)
    if codec == "zstd":
        import zstandard
        return zstandard.ZstdDecompressor().decompressobj().decompress(content)
    if codec == "blosc":
        from voxloom.sources.blosc import decode
        return decode(content)
    if codec == "lz4":
        # the size of the chunk, then one raw block
        return pa.Codec("lz4_raw").decompress(content[4:], struct.unpack("<I", content[:4])[0]).to_pybytes()
    raise ValueError(f"chunk codec {codec} is not supported")


def _hidden_text(spark: SparkSession, path: str) -> str:
    # scans skip names that start with a dot, so the small header is opened directly
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = files.open(where)
    try:
        return bytes(stream.readNBytes(1 << 20)).decode()
    finally:
        stream.close()


def read_chunked_array(spark: SparkSession, path: str) -> DataFrame:
    """Nonzero voxels of a zarr v2 directory array of shape [..., z, y, x]; the volume id is the folder's name.

    Chunks that are not stored hold the fill value.

    Every chunk file is decoded by the task that reads it; leading axes must be 1.
    """
    meta = json.loads(_hidden_text(spark, f"{path}/.zarray"))
    shape, chunk, dtype = meta["shape"], meta["chunks"], np.dtype(meta["dtype"])
    codec = (meta.get("compressor") or {}).get("id")
    separator = meta.get("dimension_separator", ".")
    if meta.get("order", "C") != "C" or any(s != 1 for s in shape[:-3]):
        raise ValueError("only C-ordered arrays with three long axes are supported")
    axes = len(shape)
    fill = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}.get(meta.get("fill_value"), meta.get("fill_value"))
    volume = path.rstrip("/").rsplit("/", 1)[-1]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for index, content in zip(batch["index"], batch["content"]):
                place = np.array([int(i) for i in index[-3:]]) * np.array(chunk[-3:])
                block = (np.full(chunk[-3:], fill, dtype) if content is None else
                         np.frombuffer(_unpack_chunk(content, codec), dtype).reshape(chunk).reshape(chunk[-3:]))
                keep = np.array(shape[-3:]) - place
                block = block[:keep[0], :keep[1], :keep[2]]
                points = np.argwhere(block != 0)
                yield pd.DataFrame({
                    "volume_id": volume, **{a: (points[:, i] + place[i]).astype(np.int32) for i, a in enumerate("zyx")},
                    "value": block[tuple(points.T)].astype(np.float64)})
    pattern = r"((?:\d+" + ("/" if separator == "/" else r"\.") + r"){" + str(axes - 1) + r"}\d+)$"
    name = F.regexp_extract("path", pattern, 1)
    split = F.split(name, "/" if separator == "/" else r"\.")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(name.alias("_n"), split.alias("index"), "content").where(F.col("_n") != ""))
    stored = files.select("index", "content")
    if fill:
        counts = [-(-s // c) for s, c in zip(shape, chunk)]
        index, rest = [], F.col("id")
        for n in reversed(counts):
            index.insert(0, (rest % n).cast("long").cast("string"))
            rest = F.floor(rest / n)
        every = spark.range(int(np.prod(counts))).select(F.array(*index).alias("index"))
        stored = stored.unionByName(every.join(stored.select("index"), "index", "left_anti")
                                    .withColumn("content", F.lit(None).cast("binary")))
    return stored.mapInPandas(decode, VOXEL)


def planes_to_voxels(planes: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Voxel rows of the planes (with their channel, if they have one), without zeros unless asked for."""
    channel = "channel" in planes.columns
    kinds = {"y": pa.int32(), "x": pa.int32(), "value": pa.float64()}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = list(zip(*[batch.column(c).to_pylist() for c in ("height", "width", "dtype")]))
            low = 0
            while low < len(kind):
                # planes of one kind are looked through together, a bounded number of cells at a time
                height, width, dtype = kind[low]
                high, most = low + 1, low + max(1, BATCH_CELLS // max(1, height * width))
                while high < min(len(kind), most) and kind[high] == kind[low]:
                    high += 1
                block = np.frombuffer(b"".join(batch.column("pixels").slice(low, high - low).to_pylist()), dtype).reshape(-1, height, width)
                k, y, x = np.nonzero(np.ones_like(block, bool) if keep_zero else block)
                rows, found = pa.array(k + low), {"y": y, "x": x, "value": block[k, y, x]}
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(rows) for c in ("volume_id", *(["channel"] if channel else []), "z")],
                     *[pa.array(found[c].astype(t.to_pandas_dtype()), t) for c, t in kinds.items()]],
                    names=["volume_id", *(["channel"] if channel else []), "z", *kinds])
                low = high
    return (planes.select(F.col("volume_id").cast("string").alias("volume_id"), *([F.col("channel").cast("int").alias("channel")] if channel else []), F.col("z").cast("int").alias("z"),
                          "height", "width", "dtype", "pixels")
            .mapInArrow(unpack, VOXEL.replace(", z", ", channel int, z", 1) if channel else VOXEL))


def scanner_orientation(voxels: DataFrame, depth: int, height: int) -> DataFrame:
    """Turn raw small-animal CT volumes head up: slices and rows change places,
    then both run backwards."""
    return voxels.withColumns({"z": (F.lit(height - 1) - F.col("y")).cast("int"),
                               "y": (F.lit(depth - 1) - F.col("z")).cast("int")})
