"""Destination rows that arrive as a stream are judged against a source table, one micro-batch after the other.

A batch says nothing about keys that have not arrived or arrive again, so by itself it reports no MISSING_IN_DEST,
and a key is a duplicate only within it.  Each batch writes a folder of its own and overwrites it when
it is repeated after a failure, so every row is judged exactly once.  settled() puts the batches together:
its results are those of one run over all that has arrived, at any time, without judging a row again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritab.functions.dialect import exact_decimals
from veritab.operators.reconcile import canonical, reconcile, summarise
from veritab.plans.config import RunConfig


def judge_arrivals(config: RunConfig, source: DataFrame, arrivals: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the stream; path gets field_results and record_rollup, partitioned by batch.  once: what is there now, then stop.

    Only source rows whose key is in a batch are shuffled with it."""

    def write(batch: DataFrame, number: int) -> None:
        run = reconcile(config, source, batch)
        arrived = run.dest_keyed.select("record_key").distinct()
        kept = run.source_keyed.join(arrived, "record_key", "left_semi")
        run = run.between(kept, run.dest_keyed).persist()
        try:
            run.field_results.write.mode("overwrite").parquet(f"{path}/field_results/batch={number}")
            run.record_rollup.where(F.col("category") != "MISSING_IN_DEST").write.mode("overwrite").parquet(f"{path}/record_rollup/batch={number}")
        finally:
            run.unpersist()

    writer = arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


@dataclass
class Settled:
    """What all batches say together; both tables are lazy."""

    field_results: DataFrame
    record_rollup: DataFrame

    @property
    def run_summary(self) -> DataFrame:
        return summarise(self.record_rollup)


def settled(spark: SparkSession, config: RunConfig, source: DataFrame, path: str, closed: bool = True) -> Settled:
    """The results of all batches under path as one run.

    A key of several batches is a duplicate, whatever each of them found, and its field results go; a key the
    source lacks stays missing there.  closed: nothing more will come, so source keys that never arrived
    are MISSING_IN_DEST; otherwise they are not mentioned.

    Raises while no batch has been judged.  A batch has one row for each of its keys, so the only shuffles are one of the rollups, which collapse before it, and one that
    takes the repeated keys out of the field results."""
    rollup, results = (spark.read.parquet(f"{path}/{table}").drop("batch") for table in ("record_rollup", "field_results"))
    category = F.when((F.col("batches") == 1) | (F.col("category") == "MISSING_IN_SOURCE"), F.col("category")).otherwise("DUPLICATE")
    keys = rollup.groupBy("record_key").agg(F.count("*").alias("batches"), F.min("category").alias("category"))
    found = keys.select("record_key", category.alias("category"))
    if closed:
        with exact_decimals(spark):
            never = canonical(source, config, "src")[0].select("record_key").distinct().join(rollup, "record_key", "left_anti")
        found = found.unionByName(never.withColumn("category", F.lit("MISSING_IN_DEST")))
    again = keys.where("batches > 1")
    return Settled(results.join(again, "record_key", "left_anti"), found)

