"""CSV and JSON tables read with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.cases import MANIFEST
from voxloom.operators.selection import distance_as_score

INSTANCE_SCHEMA = "public_id string, label_id int, label_code int"
RANKING_SCHEMA = ("name string, dc_whole double, dc_core double, dc_enh double, "
                  "hd95_whole double, hd95_core double, hd95_enh double")


def read_instance_metadata(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Instance classes of several CSV files as one table."""
    rows = spark.read.csv(list(paths), schema=INSTANCE_SCHEMA, header=True)
    return rows.select("public_id", F.col("label_id").alias("instance"), F.col("label_code").alias("class_label"))


def instances_per_case(metadata: DataFrame) -> DataFrame:
    """Instances per case and class. Entries stay rows: a case with very many
    instances is never gathered into one list."""
    return metadata.groupBy("public_id", "class_label").agg(F.count("*").alias("instances"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def read_ranking_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score CSV in long form; distances become scores, larger is better."""
    wide = spark.read.csv(path, schema=RANKING_SCHEMA, header=True)
    metrics = wide.columns[1:]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"),
                               (distance_as_score(F.col(m)) if m.startswith("hd95") else F.col(m)).alias("value"))
                      for m in metrics])
    return wide.select("name", F.inline(pairs))


def read_centres(spark: SparkSession, path: str, excluded_vendor: str = "C") -> DataFrame:
    """Case table exported from a spreadsheet, without one vendor."""
    return spark.read.csv(path, header=True).where(F.col("Vendor") != excluded_vendor)
