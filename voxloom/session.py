"""Local session used by tests, the benchmark and the check tool."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


ROOT = str(Path(__file__).resolve().parents[1])


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it by name."""
    folder = tempfile.mkdtemp(prefix="voxloom-package-")
    packed = shutil.make_archive(os.path.join(folder, "voxloom"), "zip", ROOT, "voxloom")
    spark.sparkContext.addPyFile(packed)


def local_session(cpus: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    # workers start with this path wherever the session was started
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("voxloom")
        .config("spark.driver.memory", os.environ.get("VOXLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
