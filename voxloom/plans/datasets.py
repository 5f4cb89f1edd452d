"""Bringing data sets in: task import, format conversion, inventories and merged summaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.sinks.images import write_tiff_slices
from voxloom.sinks.reports import write_manifest
from voxloom.sinks.volumes import write_volumes
from voxloom.sources.images import read_geometry, read_nifti, read_png_images, read_tiff_stack
from voxloom.support import materialize

Transform = Callable[[DataFrame], DataFrame]
ROLES = ("imagesTr", "imagesTs", "labelsTr")


def output_folder(folder: str, out: str, task_id: int | None = None) -> str:
    """Folder of the imported task below ``out``: the number of three digits and the name of ``folder`` (TaskXX_NAME)."""
    found = re.fullmatch(r"Task(\d+)_(.+)", folder.rstrip("/").rsplit("/", 1)[-1])
    if found is None:
        raise ValueError("a task folder is named TaskXX_NAME and holds imagesTr, imagesTs and labelsTr")
    number = int(found[1]) if task_id is None else task_id
    return f"{out.rstrip('/')}/Task{number:03d}_{found[2]}"


def import_task(spark: SparkSession, folder: str, out: str, modality: dict[str, str], labels: dict[str, str],
                task_id: int | None = None) -> DataFrame:
    """One file per case and channel from the 4-D files of a task, and its manifest: (role, case, channel, volume_id).

    Images become CASE_0000, CASE_0001, ... in imagesTr and imagesTs, label files keep their names.  All files are
    written by one pass over the planes and published together; the manifest follows from the same headers.  Hidden
    files are left out.  A task without one of its three folders is an error.
    """
    target = output_folder(folder, out, task_id)
    geometry = None
    planes = None
    for role in ROLES:
        path = f"{folder.rstrip('/')}/{role}"
        heads = read_geometry(spark, path).select(F.lit(role).alias("role"), F.col("volume_id").alias("case"), "size",
                                                  "spacing", "channels")
        rows = read_nifti(spark, path).withColumnRenamed("volume_id", "case").withColumn("role", F.lit(role))
        geometry = heads if geometry is None else geometry.unionByName(heads)
        planes = rows if planes is None else planes.unionByName(rows)
    several = (F.col("role") == "labelsTr") & (F.col("channels") > 1)
    geometry = materialize(geometry.withColumn("channels", F.when(
        several, F.raise_error(F.lit("a label file has one channel")).cast("int")).otherwise(F.col("channels"))))
    name = F.when(F.col("role") == "labelsTr", F.concat_ws("/", "role", "case")).otherwise(
        F.format_string("%s/%s_%04d", "role", "case", "channel"))
    files = geometry.withColumn("channel", F.explode(F.sequence(F.lit(0), F.col("channels") - 1))).withColumn("volume_id", name)
    shapes = files.select("volume_id", F.col("size")[0].alias("depth"), *[
        F.col("spacing")[k].alias(f"spacing_{a}") for k, a in enumerate("zyx")])
    write_volumes(planes.withColumn("volume_id", name).drop("role", "case", "channel"), target, shapes, compress=True)
    cases = geometry.where("role <> 'labelsTr'").select("case", (F.col("role") == "imagesTs").alias("is_test"))
    write_manifest(cases, "case", f"{target}/dataset", target.rsplit("/", 1)[-1], modality, labels)
    return files.select("role", "case", "channel", "volume_id")


def _converted(planes: DataFrame, transform: Transform | None) -> DataFrame:
    return planes if transform is None else transform(planes)


def _spaced(planes: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Geometry of planes with the given (z, y, x) spacing."""
    return planes.groupBy("volume_id").agg((F.max("z") + 1).alias("depth")).withColumns(
        {f"spacing_{a}": F.lit(float(s)) for a, s in zip("zyx", spacing)})


def _with_channel_files(planes: DataFrame, is_seg: bool) -> DataFrame:
    """Every channel as a volume of its own: NAME_0000, NAME_0001, ..., or NAME for a segmentation of one channel."""
    wrong = F.raise_error(F.lit("a segmentation has one channel"))
    name = (F.when(F.col("channel") > 0, wrong).otherwise(F.col("volume_id")) if is_seg else
            F.format_string("%s_%04d", "volume_id", "channel"))
    return planes.withColumn("volume_id", name).drop("channel")


def images_to_nifti(spark: SparkSession, path: str, out: str, spacing: Sequence[float] = (999, 1, 1),
                    transform: Transform | None = None, is_seg: bool = False, glob: str = "*.png") -> None:
    """2-D images, grey or in colour, as volumes of one slice and one file per colour channel."""
    planes = _with_channel_files(_converted(read_png_images(spark, path, glob), transform), is_seg)
    write_volumes(planes, out, _spaced(planes, spacing), compress=True)


def tiff_to_nifti(spark: SparkSession, path: str, out: str, spacing: Sequence[float], transform: Transform | None = None,
                  is_seg: bool = False, channel: int = 0, glob: str = "*.tif*") -> None:
    """Stacks of TIFF pages, one folder per volume, as the given channel of their cases; pages become slices."""
    planes = _converted(read_tiff_stack(spark, path, glob), transform)
    if not is_seg:
        planes = planes.withColumn("volume_id", F.format_string("%s_%04d", "volume_id", F.lit(channel)))
    write_volumes(planes, out, _spaced(planes, spacing), compress=True)


def nifti_to_tiff(spark: SparkSession, path: str, out: str, dtype: str = "u1", transform: Transform | None = None) -> None:
    """Segmentations as one TIFF per slice in a folder per volume, cast to ``dtype``."""
    write_tiff_slices(cast_planes(_converted(read_nifti(spark, path), transform), dtype), out)


def cast_planes(planes: DataFrame, dtype: str) -> DataFrame:
    """Planes with their values in another numpy type."""
    import numpy as np

    def cast(batches):
        for batch in batches:
            batch["pixels"] = [np.frombuffer(p, t).astype(dtype).tobytes() for p, t in zip(batch["pixels"], batch["dtype"])]
            batch["dtype"] = np.dtype(dtype).newbyteorder("<").str
            yield batch
    return planes.mapInPandas(cast, planes.schema)


def load_preprocessed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Cases of a preprocessed folder with their properties: volume_id, size, spacing, channels and the ``schema``.

    Each NIfTI file has a JSON document of the same name beside it.  A file without one, or the other way round, is an
    error that names it.
    """
    heads = read_geometry(spark, folder)
    base = re.sub(r"^[a-z0-9]+:/*", "/", folder).rstrip("/")
    name = F.regexp_extract(F.input_file_name(), re.escape(base) + r"/(.*)\.json$", 1)
    properties = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
                  .schema(schema).json(folder, multiLine=True).withColumn("volume_id", name).withColumn("_known", F.lit(True)))
    both = heads.withColumn("_found", F.lit(True)).join(properties, "volume_id", "full")
    lonely = F.raise_error(F.concat(F.lit("no file or no properties for "), F.col("volume_id")))
    return both.withColumn("volume_id", F.when(F.col("_found") & F.col("_known"), F.col("volume_id")).otherwise(lonely)).drop(
        "_found", "_known")


def crawl_files(spark: SparkSession, folder: str, suffix: str = "ummary.json", prefix: str = "", within: str = "fold0") -> DataFrame:
    """Files below ``folder`` with a flat name: (path, length, flat_name).

    The flat name is the prefix, the folders joined by two underscores and the file's name; only files whose path
    contains ``within`` count.  Contents are not read.
    """
    base = re.sub(r"^[a-z0-9]+:/*", "/", folder).rstrip("/")
    below = F.regexp_extract("path", re.escape(base) + "/(.*)$", 1)
    parts = F.split(below, "/")
    folders = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "__")
    start = folders if prefix == "" else F.when(folders == "", F.lit(prefix)).otherwise(F.concat(F.lit(prefix + "__"), folders))
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .where(F.col("path").endswith(suffix) & F.col("path").contains(within)))
    return found.select("path", "length", F.concat(start, F.element_at(parts, -1)).alias("flat_name"))


def merge_summaries(spark: SparkSession, base: str, cases: int = 125, file: str = "Stats_Validation_final.csv") -> DataFrame:
    """One row per evaluated folder ``base/SET/RUN``: name (RUN_SET) and whole, core, enh and mean of Dice and distance.

    The mean row stands fifth from the end; its scores come as enhancing, whole, core.  A file of another number of
    cases is an error.
    """
    text = spark.read.text(f"{base.rstrip('/')}/*/*/{file}", wholetext=True).withColumn("path", F.input_file_name())
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    wrong = F.raise_error(F.concat(F.lit("another number of rows in "), F.col("path")))
    row = F.when(F.size(lines) == cases + 6, F.element_at(lines, -5)).otherwise(wrong)
    cells = F.transform(F.split(row, ","), lambda x: F.trim(x).try_cast("double"))
    place = F.split("path", "/")
    name = F.concat_ws("_", F.element_at(place, -2), F.element_at(place, -3))
    values = text.select(name.alias("name"), cells.alias("c")).select(
        "name", F.slice("c", 2, 3).alias("d"), F.slice("c", -3, 3).alias("h"))
    columns = []
    for score, letter in (("dice", "d"), ("hd95", "h")):
        enh, whole, core = (F.get(letter, F.lit(k)) for k in range(3))
        columns += [c.alias(f"{score}_{n}") for c, n in ((whole, "whole"), (core, "core"), (enh, "enh"),
                                                         ((enh + whole + core) / 3, "mean"))]
    return values.select("name", *columns)

