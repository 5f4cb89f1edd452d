"""Name parsing and building as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def modality_file(case: Column, modality: Column) -> Column:
    """CASE_0000.nii.gz: four-digit modality after the case name."""
    return F.concat(case, F.lit("_"), F.lpad(modality.cast("string"), 4, "0"), F.lit(".nii.gz"))


def case_of_file(name: Column) -> Column:
    """The name without its modality and file ending (12 characters)."""
    return F.substring(name, F.lit(1), F.length(name) - 12)


def modality_of_file(name: Column) -> Column:
    return F.substring(name, F.length(name) - 10, F.lit(4)).cast("int")


def task_name(number: Column, name: Column) -> Column:
    return F.concat(F.lit("Task"), F.lpad(number.cast("string"), 3, "0"), F.lit("_"), name)


def task_id(name: Column) -> Column:
    return F.when(name.startswith("Task"), F.try_to_number(F.substring(name, 5, 3), F.lit("999")).cast("int"))


def result_name(name: Column) -> Column:
    """task, network, trainer, plans, validation, folds of a result file name.

    ``ensemble_A--B.json`` reports A as trainer, B as plans and "ensemble" as network.
    """
    ensemble = F.contains(name, F.lit("ensemble"))
    parts = F.split(F.regexp_replace(name, r"\.json$", ""), "__")
    halves = F.split(F.regexp_replace(name, r"\.json$", ""), "--")
    first = F.regexp_replace(F.get(halves, F.lit(0)), "^.*ensemble_", "")
    return F.struct(
        F.get(parts, F.lit(0)).alias("task"),
        F.when(ensemble, F.lit("ensemble")).otherwise(F.get(parts, F.lit(1))).alias("network"),
        F.when(ensemble, first).otherwise(F.get(parts, F.lit(2))).alias("trainer"),
        F.when(ensemble, F.get(halves, F.lit(1))).otherwise(F.get(parts, F.lit(3))).alias("plans"),
        F.when(ensemble, F.lit("none")).otherwise(F.get(parts, F.lit(4))).alias("validation"),
        F.when(~ensemble, F.get(parts, F.lit(5))).alias("folds"))


def block_of_file(name: Column) -> Column:
    """Block indices z, y, x: the last three numbers before the ending, so the
    specimen part may hold any number of underscores."""
    pattern = r"_(\d+)_(\d+)_(\d+)(?:_[A-Za-z]+)*\.[^.]+$"
    return F.struct(*[F.regexp_extract(name, pattern, i + 1).cast("int").alias(f"b{i}") for i in range(3)])


def hex_rgb(code: Column) -> Column:
    """Red, green, blue of an rrggbb string."""
    digits = F.regexp_replace(code, "^#", "")
    return F.struct(*[F.conv(F.substring(digits, 1 + 2 * i, 2), 16, 10).cast("int").alias(c) for i, c in enumerate("rgb")])


def blend(grey: Column, colour: Column, labelled: Column, intensity: float) -> Column:
    """Grey pixel (0..255) with the label colour added where labelled."""
    return F.when(labelled, grey + F.lit(intensity) * colour).otherwise(grey)


def channel_suffix(channel: Column) -> Column:
    """Second channel (C02) files end in _0001, all others in _0000."""
    return F.when(F.contains(channel, F.lit("C02")), "_0001").otherwise("_0000")
