"""Make the package importable in the Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import rasterloom


def ship_package(spark: SparkSession) -> None:
    """Add the package to the application's Python files (once per application)."""
    context = spark.sparkContext
    if getattr(context, "_rasterloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(rasterloom.__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="rasterloom-"), "rasterloom")
    context.addPyFile(shutil.make_archive(target, "zip", root, "rasterloom"))
    context._rasterloom_shipped = True
