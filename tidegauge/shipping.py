"""Makes the package importable in Python workers, wherever the driver's program was started."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Adds a copy of the package to the session's context, once."""
    context = spark.sparkContext
    if getattr(context, "_tidegauge_shipped", False):
        return
    package, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="tidegauge-")
    shutil.copytree(package, os.path.join(folder, "copy", package.name), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, package.name), "zip", os.path.join(folder, "copy")))
    context._tidegauge_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
