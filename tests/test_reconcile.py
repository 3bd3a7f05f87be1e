import random

import golden
import pytest
from pyspark.sql import functions as F

from veritab.operators import report
from veritab.operators.reconcile import reconcile
from veritab.plans.config import resolve
from veritab.sources.tables import read_csv


def config(**change):
    return resolve(golden.TEMPLATE | change, golden.MAPPING, golden.CODES, golden.AS_OF)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    return reconcile(config(), *(read_csv(spark, p) for p in golden.write(tmp_path_factory.mktemp("golden"))))


def test_golden_summary_and_rollup(run):
    found = run.collect()
    assert found["summary"] == golden.SUMMARY
    assert dict(found["record_rollup"]) == golden.ROLLUP
    assert [k for k, _ in found["record_rollup"]] == sorted(k for k, _ in found["record_rollup"])


def test_golden_field_rows(run):
    rows = run.collect()["field_results"]
    assert len(rows) == golden.RESULTS
    odd = {(r["record_key"], r["field_key"], r["category"]): r for r in rows if r["category"] != "MATCH"}
    assert {k: r["severity"] for k, r in odd.items()} == golden.ODD
    assert odd["T12", "load", "MISMATCH"]["verdict"] == "diff=1.00" and odd["T05", "cabin", "MISMATCH"]["actual"] == "outer"
    assert next(r for r in rows if (r["record_key"], r["rule_id"]) == ("T07", "load_near"))["verdict"] == "diff=0.20"
    for by, table in (("severity", report.by_severity), ("field_key", report.by_field)):
        assert sorted(map(tuple, run.issues(by).collect())) == sorted(map(tuple, table(run.field_results).collect()))
    assert dict(map(tuple, run.issues("severity").collect())) == {"ERROR": 3, "WARNING": 3}


def test_order_and_partitions_do_not_matter(spark, run):
    rows = run.source.collect()
    random.Random(3).shuffle(rows)
    again = reconcile(config(), spark.createDataFrame(rows, run.source.schema).repartition(3), run.dest.repartition(2)).collect()
    assert again == run.collect()


def test_one_shuffle_and_no_python(run):
    plan = run.record_rollup._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Join" not in plan


def test_missing_wins_over_duplicate_and_null_key_parts_vanish(spark):
    pair = [{"field_key": k, "src_col": c, "dst_col": c} for k, c in (("ticket", "TICKET"), ("fare", "FARE"))]
    two = resolve(golden.TEMPLATE, golden.MAPPING | {"key_pairs": pair}, golden.CODES, golden.AS_OF)
    columns = ", ".join(f"{c} string" for c in golden.COLUMNS)
    rows = lambda *keys: spark.createDataFrame([[a, "x", "x", "x", "x", b, "x"] for a, b in keys], columns)
    found = reconcile(two, rows(("B", "1"), ("B", "1"), ("A", None), (None, None)), rows((None, "A"), (None, None))).collect()["record_rollup"]
    assert dict(found) == {"B|1": "MISSING_IN_DEST", "A": "EXCEPTION", "": "EXCEPTION"}


def test_empty_tables(spark):
    columns = ", ".join(f"{c} string" for c in golden.COLUMNS)
    empty = spark.createDataFrame([], columns)
    found = reconcile(config(), empty, empty).collect()
    assert found["summary"]["total_records"] == 0 and not found["field_results"]


def test_long_code_lists_are_joined(spark, run, monkeypatch):
    from veritab.operators import rules

    monkeypatch.setattr(rules, "INLINE_CODES", 1)
    assert reconcile(config(), run.source, run.dest).collect() == run.collect()


def test_warning_mismatch_does_not_demote(run):
    results = run.judged.where(F.col("record_key") == "T02").first()
    assert results["category"] == "MATCH" and any(r["category"] == "MISMATCH" for r in results["results"])


@pytest.mark.parametrize(
    "change, message",
    [
        ({"rules": [{"rule_id": "r", "type": "NOPE", "target_field_keys": ["cabin"]}]}, "unknown single-field type"),
        ({"rules": [{"rule_id": "r", "type": "REGEX"}]}, "missing target_field_keys"),
        ({"rules": [{"rule_id": "r", "type": "REGEX", "target_field_keys": ["nope"]}]}, "no destination binding"),
        ({"rules": [{"rule_id": "r", "type": "LOOKUP", "target_field_keys": ["cabin"], "params": {"code_list": "?"}}]}, "not provided"),
        ({"rules": [{"rule_id": "r", "type": "CROSS_FIELD", "params": {"lhs": "1"}}]}, "missing param"),
    ],
)
def test_invalid_configurations(change, message):
    with pytest.raises(ValueError, match=message):
        config(**change)


def test_no_keys_and_no_rules(spark, run):
    with pytest.raises(ValueError, match="key_pairs"):
        resolve(golden.TEMPLATE, {}, golden.CODES)
    with pytest.raises(ValueError, match="no rules"):
        reconcile(config(rules=[]), run.source, run.dest)


def test_pages(run):
    rows = report.page(run.field_results, 2, 10).collect()
    assert len(rows) == 10
    with pytest.raises(ValueError):
        report.page(run.field_results, 0)
    with pytest.raises(ValueError):
        report.page(run.field_results, 1, 1001)


def test_missing_needs_no_rules(run):
    assert {tuple(r) for r in run.missing().collect()} == set(golden.MISSING.items())


def test_rollup_reads_no_results(run):
    """Neither expected nor actual values are carried to the rollup."""
    plan = run.record_rollup._jdf.queryExecution().optimizedPlan().toString()
    assert "expected" not in plan and "actual" not in plan


def test_write(run, spark, tmp_path):
    run.write(str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "field_results.parquet")).count() == golden.RESULTS
    assert report.write_csv({"run_id": "x"}, run.field_results, str(tmp_path / "report"))


def test_saved_sides_are_joined_without_a_shuffle(spark, run, tmp_path):
    run.save_sides("tickets", str(tmp_path), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    again = reconcile(config(), run.source, run.dest).from_sides("tickets")
    try:
        for name in ("field_results", "record_rollup", "run_summary"):
            assert sorted(map(repr, getattr(again, name).collect())) == sorted(map(repr, getattr(run, name).collect()))
        assert sorted(map(tuple, again.duplicate_keys().collect())) == sorted(map(tuple, run.duplicate_keys().collect()))
        for table, kind in ((again.field_results, "Inner"), (again.record_rollup, "FullOuter")):
            plan = table._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and kind in plan and "SelectedBucketsCount: 4 out of 4" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("source", "dest"):
            spark.sql(f"DROP TABLE tickets_{name}")
