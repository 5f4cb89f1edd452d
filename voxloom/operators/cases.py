"""Case files, manifests and dataset integrity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.evaluate import close_to

MANIFEST = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("modality", T.MapType(T.StringType(), T.StringType())),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("training", T.ArrayType(T.StructType([
        T.StructField("image", T.StringType()), T.StructField("label", T.StringType())]))),
    T.StructField("test", T.ArrayType(T.StringType()))])


def modality_problems(files: DataFrame, case: str, modality: str, expected: Sequence[int]) -> DataFrame:
    """Missing and unexpected modalities per case.

    Works on the set of modalities of a case, which is as short as the list of
    channels, so expected modalities are never crossed with cases.
    """
    want = F.array(*[F.lit(m) for m in expected])
    sets = files.groupBy(case).agg(F.collect_set(modality).alias("_have"))
    problems = F.concat(
        F.transform(F.array_except(want, F.col("_have")), lambda m: F.struct(m.alias("modality"), F.lit("missing").alias("problem"))),
        F.transform(F.array_except(F.col("_have"), want), lambda m: F.struct(m.alias("modality"), F.lit("unexpected").alias("problem"))))
    return sets.select(case, F.inline(problems))


def stack_modalities(files: DataFrame, case: str, modality: str, path: str, expected: Sequence[int]) -> DataFrame:
    """One row per case with a path column per modality."""
    return files.groupBy(case).agg(*[F.max(F.when(F.col(modality) == m, F.col(path))).alias(f"modality_{m}")
                                     for m in expected])


def explode_manifest(documents: DataFrame, text: str, role: str = "training") -> DataFrame:
    """(name, position, image, label) of the training list, or (name, position, image) of the test list."""
    parsed = documents.select(F.from_json(text, MANIFEST).alias("m"))
    rows = parsed.select("m.name", F.posexplode(f"m.{role}").alias("position", "e"))
    if role == "test":
        return rows.select("name", "position", F.col("e").alias("image"))
    return rows.select("name", "position", "e.image", "e.label")


def manifest_json(name: Column, modality: dict[str, str], labels: dict[str, str], training: Column, test: Column) -> Column:
    as_map = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv])
    return F.to_json(F.struct(name.alias("name"), as_map(modality).alias("modality"), as_map(labels).alias("labels"),
                              training.alias("training"), test.alias("test")))


def duplicates(cases: DataFrame, case: str) -> DataFrame:
    return (cases.groupBy(case).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
            .select(case, F.lit("duplicate").alias("rule"), F.col("_n").cast("string").alias("detail")))


def missing_files(cases: DataFrame, files: DataFrame, case: str, modalities: Sequence[int]) -> DataFrame:
    """Cases without a label file (modality NULL) or without one of the images."""
    have = files.groupBy(case).agg(F.collect_set(F.coalesce("modality", F.lit(-1))).alias("_have"))
    want = F.array(F.lit(-1), *[F.lit(m) for m in modalities])
    lost = F.array_except(want, F.coalesce("_have", F.array().cast("array<int>")))
    return (cases.select(case).distinct().join(have, case, "left").select(case, F.explode(lost).alias("_m"))
            .select(case, F.when(F.col("_m") < 0, "missing_label").otherwise("missing_image").alias("rule"),
                    F.when(F.col("_m") < 0, "").otherwise(F.col("_m").cast("string")).alias("detail")))


def stragglers(cases: DataFrame, files: DataFrame, case: str) -> DataFrame:
    listed = cases.select(case).distinct()
    return (files.join(listed, case, "left_anti").groupBy(case).agg(F.count("*").alias("_n"))
            .select(case, F.lit("not_listed").alias("rule"), F.col("_n").cast("string").alias("detail")))


def geometry_mismatch(files: DataFrame, case: str, columns: Sequence[str]) -> DataFrame:
    """Images whose geometry is not close to that of the case's label file."""
    labels = files.where(F.col("modality").isNull()).select(case, *[F.col(c).alias("_" + c) for c in columns])
    same = reduce(lambda a, b: a & b, [close_to(F.col(c), F.col("_" + c)) for c in columns])
    return (files.where(F.col("modality").isNotNull()).join(labels, case).where(~same)
            .select(case, F.lit("geometry").alias("rule"), F.col("modality").cast("string").alias("detail")))


def nan_values(voxels: DataFrame, case: str, value: str) -> DataFrame:
    return (voxels.where(F.isnan(value)).groupBy(case).agg(F.count("*").alias("_n"))
            .select(case, F.lit("nan").alias("rule"), F.col("_n").cast("string").alias("detail")))


def unexpected_labels(voxels: DataFrame, case: str, label: str, expected: Sequence[int]) -> DataFrame:
    """One row per undeclared code; voxel counts are aggregated before comparing."""
    return (voxels.groupBy(case, label).agg(F.count("*").alias("_n")).where(~F.col(label).isin(list(expected)))
            .select(case, F.lit("unexpected_label").alias("rule"), F.col(label).cast("string").alias("detail")))


def orientation_mismatch(files: DataFrame, case: str, orientation: str) -> DataFrame:
    """Files whose axis order differs from the most frequent one."""
    common = files.groupBy(orientation).agg(F.count("*").alias("_n"))
    usual = common.agg(F.max_by(orientation, F.struct("_n", orientation)).alias(orientation))
    return (files.join(usual, orientation, "left_anti").groupBy(case, orientation).agg(F.count("*"))
            .select(case, F.lit("orientation").alias("rule"), F.col(orientation).alias("detail")))


def non_consecutive(labels: Sequence[int]) -> list[int]:
    """Declared codes that break 0, 1, 2, ..."""
    return [code for i, code in enumerate(sorted(labels)) if code != i]


def violations(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)
