"""Runs that judge only what has changed since the last one.

Record keys are dealt into buckets by hash.  A bucket's digest on each side, its rows' number and two order-free sums of their
hashes, comes from one aggregation of the canonical rows.  Where both digests are those of the last run under the same
configuration, its results are taken over; only the other buckets are judged, and a record naming the folder of every bucket
replaces the last one in one step.  The digest is 128 bits: a change that leaves it the same has odds of about 2**-128 a bucket.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.plans.config import RunConfig
from veritab.sources.store import Versions

from .reconcile import FIELD_RESULTS, Reconciliation, reconcile

BUCKETS = 256
_SCHEMA = ", ".join(f"{c} string" for c in FIELD_RESULTS)


@dataclass(frozen=True)
class Outcome:
    """rows: field rows and, with a null field_key, rollup rows; judged: the buckets that were judged now."""

    rows: DataFrame
    judged: list[int]

    @property
    def field_results(self) -> DataFrame:
        return self.rows.where("field_key is not null")

    @property
    def record_rollup(self) -> DataFrame:
        return self.rows.where("field_key is null").select("record_key", "category")


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("record_key"), F.lit(n)).cast("int")


def _digests(run: Reconciliation, n: int) -> dict[int, list]:
    """For each bucket the digests of both sides; a row for each bucket and side reaches the driver."""

    def side(frame: DataFrame, name: str) -> DataFrame:
        columns = [F.col(c) for c in frame.columns]
        columns.append(F.concat(*[F.isnull(c).cast("int").cast("string") for c in columns]))  # hashes pass over nulls
        hashes = [F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)").alias(f"h{seed}") for seed in (1, 2)]
        return frame.select(_bucket(n).alias("bucket"), F.lit(name).alias("side"), *hashes)

    both = side(run.source_keyed, "s").unionAll(side(run.dest_keyed, "d"))
    out: dict[int, list] = {}
    for r in both.groupBy("bucket", "side").agg(F.count("*").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).orderBy("bucket", "side").collect():
        out.setdefault(r["bucket"], []).append([r["side"], r["n"], str(r["h1"]), str(r["h2"])])
    return out


def _rows(run: Reconciliation) -> DataFrame:
    """Every result and every record's category as one table, judged once."""
    blank = [F.lit(None).cast("string").alias(c) if c != "category" else F.col("category") for c in FIELD_RESULTS[1:]]
    own = F.array(F.struct(*blank))
    return run.judged.select("record_key", F.inline(F.when(F.col("results").isNull(), own).otherwise(F.concat("results", own))))


class Incremental:
    """A folder, reached by all executors, that keeps the results of one reconciliation from run to run."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS) -> None:
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets
        self._records = Versions(spark, self.base)

    def _last(self) -> dict:
        body = self._records.get("runs")
        return json.loads(body) if body else {"configuration": None, "digests": {}, "folders": {}}

    def run(self, config: RunConfig, source: DataFrame, dest: DataFrame) -> Outcome:
        """The results of reconcile(config, source, dest)."""
        run, last = reconcile(config, source, dest), self._last()
        configuration = hashlib.sha256(f"{config!r} {self.buckets} {run.source_keyed.schema} {run.dest_keyed.schema}".encode()).hexdigest()
        old = last["digests"] if last["configuration"] == configuration else {}
        digests = {str(b): d for b, d in _digests(run, self.buckets).items()}
        judged = sorted(int(b) for b, d in digests.items() if old.get(b) != d)
        folders = {b: last["folders"][b] for b in digests if int(b) not in set(judged)}
        if judged:
            version = uuid.uuid4().hex
            some = run.between(*(side.where(_bucket(self.buckets).isin(judged)) for side in (run.source_keyed, run.dest_keyed)))
            _rows(some).withColumn("bucket", _bucket(self.buckets)).write.partitionBy("bucket").parquet(f"{self.base}/results/{version}")
            folders |= {str(b): version for b in judged}
        if judged or digests != last["digests"]:
            self._records.put("runs", json.dumps({"configuration": configuration, "digests": digests, "folders": folders}))
        return Outcome(self._read(folders), judged)

    def _read(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.base}/results/{version}/bucket={b}" for b, version in folders.items()]
        return self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)

    def results(self) -> Outcome:
        """The results of the last run."""
        return Outcome(self._read(self._last()["folders"]), [])

    def vacuum(self) -> None:
        """Deletes results that the last run does not use; not while they are read."""
        used = set(self._last()["folders"].values())
        for version in self._records.children("results"):
            if version not in used:
                self._records.delete(f"results/{version}")
