"""Run stores: replacing, reading while replacing, failing, pages from the index, an embedded database."""

import pytest
from pyspark.sql import functions as F

from veritab.operators import report
from veritab.sources import store

FIELDS = "record_key string, field_key string, rule_id string, severity string, expected string, actual string, category string, verdict string"
CATEGORIES = ["MATCH", "MATCH", "MISMATCH", "EXCEPTION"]


def results(spark, n, tag):
    """(field rows, rollup) of n records with three fields each."""
    one = [(f"k{i:05}", f, f"r_{f}", ("ERROR", "WARNING", None)[(i + j) % 3], tag, "ü,\"'\n", CATEGORIES[(i + j) % 4], "v") for i in range(n) for j, f in enumerate(("a", "b", "c"))]
    return spark.createDataFrame(one, FIELDS).repartition(5), spark.createDataFrame([(f"k{i:05}", CATEGORIES[i % 4]) for i in range(n)], "record_key string, category string")


@pytest.fixture(params=["memory", "parquet", "jdbc"])
def made(request, spark, tmp_path):
    if request.param == "memory":
        return store.MemoryStore()
    if request.param == "parquet":
        return store.ParquetStore(spark, str(tmp_path / "store"))
    return store.JdbcStore(spark, f"jdbc:derby:{tmp_path}/db;create=true", str(tmp_path), {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, text="VARCHAR(4000)", sent="CLOB")


def saved(made, spark, n=40, tag="x", run=None):
    run = run or store.Run("t", "m")
    if made.get_run(run.run_id) is None:
        made.create_run(run)
    made.save_results(run.run_id, *results(spark, n, tag))
    return run.run_id


def test_saving_twice_leaves_one_copy(spark, made):
    run = store.Run("t", "m")
    saved(made, spark, 40, "old", run)
    other = saved(made, spark, 7, "other")
    saved(made, spark, 33, "new", run)
    rows = made.rows(run.run_id)
    assert rows.columns == [c.split()[0] for c in store.RESULT_SCHEMA.split(", ")]
    assert rows.where("field_key is not null").select("expected").distinct().collect() == [("new",)] and rows.count() == 4 * 33
    assert made.rows(other).count() == 4 * 7
    found = made.get_run(run.run_id)
    assert found.summary["total_records"] == 33 and found.summary["match_count"] == sum(i % 4 < 2 for i in range(33))
    fields = [r for r in rows.where("field_key is not null and category in ('MISMATCH', 'EXCEPTION')").collect()]
    assert found.by_field == {f: sum(r.field_key == f for r in fields) for f in "abc"}
    assert found.by_severity == {s: sum(r.severity == s for r in fields) for s in ("ERROR", "WARNING")}
    assert [r.category for r in made.rollup(run.run_id).collect()] == [CATEGORIES[i % 4] for i in range(33)]


def test_a_failed_save_leaves_the_old_results(spark, made):
    run = store.Run("t", "m")
    saved(made, spark, 12, "old", run)
    before = made.get_run(run.run_id)
    fields, rollup = results(spark, 20, "new")
    if isinstance(made, store.MemoryStore):
        pytest.skip("rows in memory are not a copy")
    with pytest.raises(Exception, match="boom"):
        made.save_results(run.run_id, fields.withColumn("verdict", F.when(F.col("record_key") == "k00019", F.raise_error(F.lit("boom"))).otherwise(F.col("verdict"))), rollup)
    assert made.get_run(run.run_id) == before and made.rows(run.run_id).count() == 48
    if isinstance(made, store.JdbcStore):  # nothing is left of the attempt
        with made._transaction() as sql:
            assert not [r for r in sql("SELECT tablename FROM sys.systables") if "STAGE" in r[0]]


def test_pages(spark, made):
    run = saved(made, spark, 100)
    rows = [r.asDict() for r in report.drilldown(made.rows(run)).orderBy(*report.ORDER).collect()]
    for filters in ({}, {"category": "MISMATCH"}, {"field_key": "b"}, {"category": "EXCEPTION", "field_key": "c"}, {"category": "NONE"}):
        wanted = [r for r in rows if all(r[k] == v for k, v in filters.items())]
        for page in (1, 2, 7, 50):
            assert made.results(run, **filters, page=page, size=20) == (len(wanted), wanted[20 * (page - 1) : 20 * page])
    for page, size in ((0, 5), (1, 1001), (1, 0)):
        with pytest.raises(ValueError):
            made.results(run, page=page, size=size)


def test_runs_and_artifacts(spark, made):
    made.put_artifact("template", "a", {"v": 1})
    made.put_artifact("template", "a", {"v": 2})
    made.put_artifact("mapping", "a", {"v": 3})
    assert made.artifacts("template") == {"a": {"v": 2}} and made.get_artifact("mapping", "a") == {"v": 3} and made.get_artifact("mapping", "b") is None
    runs = [store.Run("t", "m", queued_at=f"2026-01-0{k}") for k in (2, 3, 1)]
    for run in runs:
        made.create_run(run)
    made.mark_running(runs[0].run_id)
    made.mark_failed(runs[0].run_id, "why")
    assert [r.queued_at[-1] for r in made.list_runs()] == ["3", "2", "1"]
    assert made.get_run(runs[0].run_id).status == "FAILED" and made.get_run(runs[0].run_id).error_message == "why" and made.get_run("nope") is None
    with pytest.raises(KeyError):
        made.mark_running("nope")


@pytest.fixture
def files(spark, tmp_path):
    return store.ParquetStore(spark, str(tmp_path / "store"))


def test_a_page_reads_one_or_two_files(spark, files, monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 50)
    run = saved(files, spark, 300)
    assert len(files.rows(run).inputFiles()) > 15
    _, page = files.page(run, page=13, size=40)
    assert len(page.inputFiles()) <= 2 and page.count() == 40
    _, filtered = files.page(run, category="MISMATCH", page=3, size=10)
    assert len(filtered.inputFiles()) <= 2 and {r.category for r in filtered.collect()} == {"MISMATCH"}


def test_readers_keep_what_they_opened(spark, files):
    run = store.Run("t", "m")
    saved(files, spark, 10, "old", run)
    opened = files.rows(run.run_id)
    again = store.ParquetStore(spark, files.base)
    saved(again, spark, 20, "new", run)
    assert opened.count() == 40 and files.rows(run.run_id).count() == 80
    # a writer that dies before the record is renamed changes nothing
    files._put_rows(run.run_id, files.rows(run.run_id).limit(3))
    assert files.rows(run.run_id).count() == 80
    files.vacuum(run.run_id)
    assert files.rows(run.run_id).count() == 80 and len(files._files.children(f"results/{run.run_id}")) == 1


def test_a_task_that_ran_twice_leaves_no_copies(spark, tmp_path, monkeypatch):
    made = store.JdbcStore(spark, f"jdbc:derby:{tmp_path}/db;create=true", str(tmp_path), {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, text="VARCHAR(4000)", sent="CLOB")
    from pyspark.sql.readwriter import DataFrameWriter

    plain = DataFrameWriter.jdbc

    def twice(self, *args, **more):
        plain(self, *args, **more)
        plain(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "jdbc", twice)
    assert made.rows(saved(made, spark, 25)).count() == 100
