"""Make the package importable for Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def on_workers(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the path of this session's Python workers.

    It must exist there under the same path, or the package be installed.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark
