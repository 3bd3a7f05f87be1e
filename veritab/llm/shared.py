"""Paths and materialisation shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between the JVM and Python; bounds what a worker holds, long texts apart.
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark's own reader (any file system it knows)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a single
    machine only, a temporary one where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="veritab-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut
    and every executor can read every part, so losing one loses no work."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    path = f"{shared_dir(spark)}/veritab-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clashing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns only; everything else, whatever its name, is dropped."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


#: A table up to this many bytes and rows is copied to every executor.
COPIED = 8 << 20, 200_000


def attach(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """rows joined with the one row of small that has its key (null meets null); small is a written table.

    small is measured: copied to every executor if it stays under COPIED, else both sides are shuffled, where
    adaptive execution splits a key that holds much of rows."""
    other = small.withColumnRenamed(key, f"{key}_")
    text = F.length(F.col(f"{key}_").cast("string"))
    size, n = other.agg(F.coalesce(F.sum(F.coalesce(text, F.lit(0)) * 4 + 64), F.lit(0)), F.count("*")).first()
    met = F.broadcast(other) if size <= COPIED[0] and n <= COPIED[1] else other.hint("merge")
    return rows.join(met, rows[key].eqNullSafe(other[f"{key}_"])).drop(f"{key}_")
