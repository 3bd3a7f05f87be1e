import golden
from pyspark.sql import functions as F

from veritab.operators.reconcile import reconcile
from veritab.plans.config import resolve
from veritab.sources.tables import read_csv
from veritab.streaming.arrivals import judge_arrivals, settled


def test_arrivals(spark, tmp_path):
    """Two files arrive one after the other; together they are judged as the whole table, keys that never arrive aside."""
    config = resolve(golden.TEMPLATE, golden.MAPPING, golden.CODES, golden.AS_OF)
    source, dest = (read_csv(spark, p) for p in golden.write(tmp_path))
    arrived, out = str(tmp_path / "arrived"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(dest.schema).parquet(arrived)
    for part in ("TICKET <= 'T10'", "TICKET > 'T10'"):
        dest.where(part).coalesce(1).write.mode("append").parquet(arrived)
        query = judge_arrivals(config, source, stream(), out, str(tmp_path / "checkpoint"), once=True)
        assert query.awaitTermination(120)
    whole = reconcile(config, source, dest)
    read = lambda table: spark.read.parquet(f"{out}/{table}")
    assert {r.batch for r in read("record_rollup").collect()} == {0, 1}
    assert sorted(map(tuple, read("record_rollup").drop("batch").collect())) == sorted(map(tuple, whole.record_rollup.where(F.col("category") != "MISSING_IN_DEST").collect()))
    assert sorted(map(tuple, read("field_results").drop("batch").collect())) == sorted(map(tuple, whole.field_results.collect()))


def test_settled_batches_say_what_one_run_says(spark, tmp_path):
    """Keys that come again in a later batch: duplicates of matched, mismatched and unknown keys; and keys that never come."""
    config = resolve(golden.TEMPLATE, golden.MAPPING, golden.CODES, golden.AS_OF)
    source, dest = (read_csv(spark, p) for p in golden.write(tmp_path))
    arrived, out = str(tmp_path / "arrived"), str(tmp_path / "out")
    parts = ["TICKET < 'T09'", "TICKET > 'T07' and TICKET < 'T18'", "TICKET in ('T01', 'T05', 'T14', 'T31') or TICKET > 'T17'", "TICKET = 'T31'"]
    for part in parts:
        dest.where(part).coalesce(1).write.mode("append").parquet(arrived)
        query = judge_arrivals(config, source, spark.readStream.schema(dest.schema).parquet(arrived), out, str(tmp_path / "checkpoint"), once=True)
        assert query.awaitTermination(120)
    all_ = dest.where("false")
    for part in parts:
        all_ = all_.union(dest.where(part))
    whole, found = reconcile(config, source, all_), settled(spark, config, source, out)
    assert all_.count() > dest.count() and {r.category for r in found.record_rollup.collect()} >= {"DUPLICATE", "MISSING_IN_DEST", "MISSING_IN_SOURCE", "MATCH"}
    for table in ("record_rollup", "field_results", "run_summary"):
        assert sorted(map(tuple, getattr(found, table).collect())) == sorted(map(tuple, getattr(whole, table).collect()))
    still_open = settled(spark, config, source, out, closed=False).record_rollup
    assert sorted(map(tuple, still_open.collect())) == sorted(map(tuple, whole.record_rollup.where(F.col("category") != "MISSING_IN_DEST").collect()))
