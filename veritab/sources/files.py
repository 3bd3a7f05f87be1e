"""Byte access to shared files from tasks, for formats whose parts only a position tells apart.

Any file system that Arrow knows by its URI (local and mounted folders, HDFS, object stores)."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; ValueError or ArrowInvalid for one that Arrow does not know."""
    plain = re.sub(r"^file:/*", "/", path)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    try:
        located(path)
    except (ValueError, OSError):
        return False
    return True


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of the files, listed by Spark; nothing is read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


def dealt(rows: DataFrame, n: int, most: int = 20_000) -> DataFrame:
    """rows in up to n tasks of about as many rows each; adaptive execution does not join them again."""
    return rows.repartition(max(1, min(n, most)))
