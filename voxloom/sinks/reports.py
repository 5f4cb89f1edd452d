"""CSV, JSON and Parquet reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.cases import manifest_json

# Columns of the specimen table, in order.
SPECIMEN_COLUMNS = {
    "specimen": "Mouse", "nerve_endings": "Nerve Endings", "avg_thickness_points": "Avg Thickness (points)",
    "max_thickness_points": "Max Thickness (points)", "avg_thickness_line": "Avg Thickness (line)",
    "max_thickness_line": "Max Thickness (line)", "ref_vertices": "Vertices", "ref_edges": "Edges",
    "avg_degree": "Avg Degree", "max_degree": "Max Degree", "avg_branching": "Avg branching size",
    "max_branching": "Max branching size"}


def write_quantification(report: DataFrame, path: str, value_column: str = "value") -> None:
    """(name, value) rows as CSV; the old layout calls the value column DateValue."""
    report.withColumnRenamed("value", value_column).write.csv(path, header=True, mode="overwrite")


def write_specimens(summary: DataFrame, specimen: str, path: str) -> None:
    rows = summary.withColumnRenamed(specimen, "specimen")
    rows.select(*[F.col(c).alias(title) for c, title in SPECIMEN_COLUMNS.items()]).write.csv(path, header=True, mode="overwrite")


def write_region_summary(summary: DataFrame, path: str) -> None:
    """Case rows and summary rows with four decimals; undefined scores as nan."""
    regions = [c for c in summary.columns if c != "casename"]
    text = [F.when(F.col(r).isNull(), "nan").otherwise(F.format_string("%.4f", F.col(r))).alias(r) for r in regions]
    summary.select("casename", *text).write.csv(path, header=True, mode="overwrite")


def write_scores(scores: DataFrame, means: DataFrame, keys: Sequence[str], path: str) -> None:
    """One JSON document per case and label below ``all``, one per label below ``mean``.

    A document holds the metrics of one label, so no case list is gathered. The
    time of writing is left out to keep the files reproducible.
    """
    metrics = lambda: F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics")
    scores.groupBy(*keys, "label").agg(metrics()).write.json(f"{path}/all", mode="overwrite")
    means.groupBy("label").agg(metrics()).write.json(f"{path}/mean", mode="overwrite")


def write_table(rows: DataFrame, path: str, separator: str = ",") -> None:
    rows.write.csv(path, header=True, sep=separator, mode="overwrite")


def write_blobs(blobs: DataFrame, path: str, partition: str = "volume_id") -> None:
    blobs.write.partitionBy(partition).parquet(path, mode="overwrite")


def write_manifest(cases: DataFrame, case: str, path: str, name: str, modality: dict[str, str], labels: dict[str, str],
                   parts: int = 1) -> None:
    """Dataset manifest as ``parts`` documents that read back as one list.

    ``cases`` holds the case name and ``is_test``. More parts keep each document
    short when there are very many cases.
    """
    files = lambda folder: F.concat(F.lit(f"./{folder}/"), F.col(case), F.lit(".nii.gz"))
    pair = F.struct(files("imagesTr").alias("image"), files("labelsTr").alias("label"))
    grouped = cases.groupBy(F.pmod(F.xxhash64(case), F.lit(parts)).alias("_part")).agg(
        F.sort_array(F.collect_list(F.when(~F.col("is_test"), pair))).alias("training"),
        F.sort_array(F.collect_list(F.when(F.col("is_test"), files("imagesTs")))).alias("test"))
    text: Column = manifest_json(F.lit(name), modality, labels, F.col("training"), F.col("test"))
    grouped.select(text.alias("value")).write.text(path)
