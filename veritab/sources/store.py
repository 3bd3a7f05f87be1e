"""Run stores: runs, their results and configuration artifacts.

The file store never changes a file.  Results go to a folder of their own, range-sorted, with an index of what each file holds; a run's
record, which names that folder and has the counters, is a small file that one rename makes the newest.  A reader sees
the old results or the new ones with their counters, a killed writer leaves the old ones, and pages are found from the index.

The database store writes results in parallel to a table of their own, and one transaction puts them in the run's place.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators import report
from veritab.operators.reconcile import CATEGORIES, FIELD_RESULTS

LAST_RUNS = 200
#: Rows of a file of the file store at most, so that a page reads little.
FILE_ROWS = 200_000
RESULT_SCHEMA = "record_key string, category string, field_key string, rule_id string, severity string, expected string, actual string, verdict string, detail string"

_COLUMNS = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]


def now() -> str:
    return datetime.now(UTC).isoformat()


@dataclass(frozen=True)
class Run:
    template_version_id: str
    mapping_id: str
    source_dataset_id: str | None = None
    dest_dataset_id: str | None = None
    rule_engine_version: str = ""
    as_of_date: str = ""
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    status: str = "QUEUED"
    tenant_id: str | None = None
    error_message: str | None = None
    queued_at: str = field(default_factory=now)
    started_at: str | None = None
    finished_at: str | None = None
    summary: dict | None = None
    by_severity: dict | None = None
    by_field: dict | None = None
    #: Where a store keeps the results that the counters belong to.
    version: str | None = None

    def as_dict(self) -> dict:
        return asdict(self)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category", "field_key", "severity").agg(F.count("*").alias("n"))


def _counters(counts: DataFrame) -> dict[str, dict]:
    """summary, by_severity and by_field of a run, from (category, field_key, severity, n); one row for each combination reaches the driver."""
    found = counts.groupBy("category", "field_key", "severity").agg(F.sum("n").alias("n")).collect()
    records = {r["category"]: r["n"] for r in found if r["field_key"] is None}
    out = {"summary": {"total_records": sum(records.values()), **{name: records.get(category, 0) for name, category in CATEGORIES.items()}}}
    for name, key in (("by_severity", "severity"), ("by_field", "field_key")):
        out[name] = {}
        for r in found:
            if r["field_key"] is not None and r["category"] in report.ISSUES and r[key]:
                out[name][r[key]] = out[name].get(r[key], 0) + r["n"]
    return out


class Store:
    """Runs go QUEUED -> RUNNING -> COMPLETED or FAILED.  Subclasses keep rows and records."""

    def _put_run(self, run: Run) -> None:
        raise NotImplementedError

    def get_run(self, run_id: str) -> Run | None:
        raise NotImplementedError

    def _all_runs(self) -> list[Run]:
        raise NotImplementedError

    def _put_rows(self, run_id: str, rows: DataFrame) -> tuple[str, DataFrame]:
        """Keeps rows beside those of the run that may be there; returns their version and (category, field_key, severity, n) of them."""
        raise NotImplementedError

    def rows(self, run_id: str) -> DataFrame:
        raise NotImplementedError

    def put_artifact(self, kind: str, key: str, body: dict) -> None:
        raise NotImplementedError

    def artifacts(self, kind: str) -> dict[str, dict]:
        raise NotImplementedError

    def get_artifact(self, kind: str, key: str) -> dict | None:
        return self.artifacts(kind).get(key)

    def create_run(self, run: Run) -> str:
        self._put_run(run)
        return run.run_id

    def _change(self, run_id: str, **what) -> None:
        run = self.get_run(run_id)
        if run is None:
            raise KeyError(run_id)
        self._put_run(replace(run, **what))

    def mark_running(self, run_id: str) -> None:
        self._change(run_id, status="RUNNING", started_at=now())

    def mark_completed(self, run_id: str) -> None:
        self._change(run_id, status="COMPLETED", finished_at=now())

    def mark_failed(self, run_id: str, error: str) -> None:
        self._change(run_id, status="FAILED", finished_at=now(), error_message=error)

    def list_runs(self) -> list[Run]:
        """The last runs, newest first."""
        return sorted(self._all_runs(), key=lambda r: r.queued_at, reverse=True)[:LAST_RUNS]

    def save_results(self, run_id: str, field_results: DataFrame, rollup: DataFrame) -> None:
        """Field rows and, with a null field_key, rollup rows in one table, and the counters in the run; both replace what was there at once."""
        detail = F.col("detail") if "detail" in field_results.columns else F.lit("{}")
        rows = field_results.select(*FIELD_RESULTS, detail.cast("string").alias("detail")).unionByName(rollup.select("record_key", "category"), allowMissingColumns=True)
        version, counts = self._put_rows(run_id, rows.select(*_COLUMNS))
        self._change(run_id, version=version, **_counters(counts))

    def rollup(self, run_id: str) -> DataFrame:
        return self.rows(run_id).where("field_key is null").select("record_key", "category").orderBy("record_key")

    def results(self, run_id: str, category: str | None = None, field_key: str | None = None, page: int = 1, size: int = 50) -> tuple[int, list[dict]]:
        """(number of field rows that pass the filters, one page of them)."""
        rows = self.rows(run_id)
        total = report.drilldown(rows, category, field_key).count()
        return total, [r.asDict() for r in report.page(rows, page, size, category=category, field_key=field_key).collect()]


class MemoryStore(Store):
    """For tests and notebooks: rows stay cached DataFrames."""

    def __init__(self) -> None:
        self._runs: dict[str, Run] = {}
        self._rows: dict[str, DataFrame] = {}
        self._artifacts: dict[tuple[str, str], dict] = {}

    def _put_run(self, run: Run) -> None:
        self._runs[run.run_id] = run

    def get_run(self, run_id: str) -> Run | None:
        return self._runs.get(run_id)

    def _all_runs(self) -> list[Run]:
        return list(self._runs.values())

    def _put_rows(self, run_id: str, rows: DataFrame) -> tuple[str, DataFrame]:
        self._rows[run_id] = rows.cache()
        return "memory", _counted(self._rows[run_id])

    def rows(self, run_id: str) -> DataFrame:
        return self._rows[run_id]

    def put_artifact(self, kind: str, key: str, body: dict) -> None:
        self._artifacts[kind, key] = body

    def artifacts(self, kind: str) -> dict[str, dict]:
        return {key: body for (k, key), body in self._artifacts.items() if k == kind}


class Versions:
    """Small texts in a shared folder, by whatever file system Spark knows for it.

    A key's text is the newest of its versions.  A version is written under a name that readers skip and then renamed, which is one step."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self, key: str, text: str) -> None:
        folder = self._path(f"{self.base}/{key}")
        self._fs.mkdirs(folder)
        number = 1 + max((int(s.getPath().getName()[:9]) for s in self._fs.listStatus(folder) if s.getPath().getName()[:9].isdecimal()), default=0)
        new = uuid.uuid4().hex
        hidden = self._path(f"{self.base}/{key}/_{new}")
        out = self._fs.create(hidden, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self._fs.rename(hidden, self._path(f"{self.base}/{key}/{number:09}-{new}.json")):
            raise OSError(f"{key} could not be replaced")

    def get(self, key: str) -> str | None:
        folder = self._path(f"{self.base}/{key}")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return None
        stream = self._fs.open(self._path(f"{self.base}/{key}/{names[-1]}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def table(self, kind: str) -> DataFrame:
        """(id, body): the newest text of every key under a folder."""
        if not self._fs.exists(self._path(f"{self.base}/{kind}")):
            return self.spark.createDataFrame([], "id string, body string")
        texts = self.spark.read.option("recursiveFileLookup", True).text(f"{self.base}/{kind}", wholetext=True).select("_metadata.file_path", "value")
        names = F.split("file_path", "/")
        return texts.groupBy(F.url_decode(F.element_at(names, -2)).alias("id")).agg(F.max_by("value", F.element_at(names, -1)).alias("body"))

    def delete(self, key: str) -> None:
        self._fs.delete(self._path(f"{self.base}/{key}"), True)

    def children(self, key: str) -> list[str]:
        folder = self._path(f"{self.base}/{key}")
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []


class ParquetStore(Store):
    """Folders under a base path that every executor reaches."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self._files = Versions(spark, self.base)

    def _put_run(self, run: Run) -> None:
        self._files.put(f"runs/{run.run_id}", json.dumps(run.as_dict(), ensure_ascii=False))

    def get_run(self, run_id: str) -> Run | None:
        body = self._files.get(f"runs/{run_id}")
        return Run(**json.loads(body)) if body else None

    def _all_runs(self) -> list[Run]:
        newest = self._files.table("runs").orderBy(F.get_json_object("body", "$.queued_at").desc()).limit(LAST_RUNS)
        return [Run(**json.loads(r["body"])) for r in newest.collect()]

    def put_artifact(self, kind: str, key: str, body: dict) -> None:
        self._files.put(f"artifacts/{kind}/{key}", json.dumps(body, ensure_ascii=False))

    def artifacts(self, kind: str) -> dict[str, dict]:
        return {r["id"]: json.loads(r["body"]) for r in self._files.table(f"artifacts/{kind}").collect()}

    def _put_rows(self, run_id: str, rows: DataFrame) -> tuple[str, DataFrame]:
        """Files in the order of the pages, rollup rows behind; the index has a row for each file, category, field and severity."""
        version = uuid.uuid4().hex
        folder, order = f"{self.base}/results/{run_id}/{version}", [F.col("field_key").isNull(), *(F.col(c) for c in report.ORDER)]
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/rows")
        written = self.spark.read.schema(RESULT_SCHEMA).parquet(f"{folder}/rows").withColumn("file", F.col("_metadata.file_name"))
        first = F.min(F.struct(*order))
        written.groupBy("file", "category", "field_key", "severity").agg(F.count("*").alias("n"), first.alias("first")).write.parquet(f"{folder}/index")
        return version, self.spark.read.parquet(f"{folder}/index")

    def _folder(self, run_id: str) -> str | None:
        run = self.get_run(run_id)
        return f"{self.base}/results/{run_id}/{run.version}" if run and run.version else None

    def rows(self, run_id: str) -> DataFrame:
        """The rows of the version that is the newest now; they stay the same whatever is saved later."""
        folder = self._folder(run_id)
        return self.spark.read.schema(RESULT_SCHEMA).parquet(f"{folder}/rows") if folder else self.spark.createDataFrame([], RESULT_SCHEMA)

    def page(self, run_id: str, category: str | None = None, field_key: str | None = None, page: int = 1, size: int = 50) -> tuple[int, DataFrame]:
        """(number of field rows that pass the filters, one page of them).

        The index says which files hold the page; only those are read.  What reaches the driver is a number for each file that has such rows."""
        report.check_page(page, size)
        folder = self._folder(run_id)
        if not folder:
            return 0, self.spark.createDataFrame([], RESULT_SCHEMA)
        index = report.drilldown(self.spark.read.parquet(f"{folder}/index"), category, field_key)
        files = index.groupBy("file").agg(F.sum("n").alias("n"), F.min("first").alias("first")).orderBy("first").select("file", "n").collect()
        begin, end, at, skip, chosen = (page - 1) * size, page * size, 0, None, []
        for r in files:
            if at < end and at + r["n"] > begin:
                skip = begin - at if skip is None else skip
                chosen.append(f"{folder}/rows/{r['file']}")
            at += r["n"]
        if not chosen:
            return at, self.spark.createDataFrame([], RESULT_SCHEMA)
        found = report.drilldown(self.spark.read.schema(RESULT_SCHEMA).parquet(*chosen), category, field_key)
        return at, found.orderBy(*report.ORDER).offset(skip).limit(size)

    def results(self, run_id: str, category: str | None = None, field_key: str | None = None, page: int = 1, size: int = 50) -> tuple[int, list[dict]]:
        total, rows = self.page(run_id, category, field_key, page, size)
        return total, [r.asDict() for r in rows.collect()]

    def vacuum(self, run_id: str) -> None:
        """Deletes the run's results that no longer count; not while they are read."""
        run = self.get_run(run_id)
        for version in self._files.children(f"results/{run_id}"):
            if run is None or version != run.version:
                self._files.delete(f"results/{run_id}/{version}")


#: Tables of the database store; {text} is the type of unbounded texts, results are read in BUCKETS parallel parts.
BUCKETS = 16
_TABLES = {
    "runs": "run_id VARCHAR(64) PRIMARY KEY, queued_at VARCHAR(40), body {text}",
    "artifacts": "kind VARCHAR(64), id VARCHAR(64), body {text}, PRIMARY KEY (kind, id)",
    "results": "run_id VARCHAR(64), bucket INTEGER, " + ", ".join(f"{c} {{text}}" for c in _COLUMNS),
}


class JdbcStore(Store):
    """A database.  work: a shared folder for rows on their way, so that a task that runs again sends the same ones.

    text: the database's type of texts; sent: the type in which Spark's writer sends them, if it is another (CLOB for Derby).  Results are appended in parallel to a table of their own, each row with its place in the
    work files; one transaction deletes the run's rows, takes each place once (a task that ran twice leaves two copies) and renews the run's record."""

    def __init__(self, spark: SparkSession, url: str, work: str, properties: dict | None = None, text: str = "VARCHAR(32000)", sent: str | None = None, prefix: str = "veritab_") -> None:
        self.spark, self.url, self.work, self.properties, self.prefix = spark, url, work.rstrip("/"), dict(properties or {}), prefix
        self.text, self.sent = text, sent or text
        self._ready()

    def _connection(self):
        jvm = self.spark._jvm
        if "driver" in self.properties:
            jvm.java.lang.Class.forName(self.properties["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        properties = jvm.java.util.Properties()
        for k, v in self.properties.items():
            properties.setProperty(k, v)
        return jvm.java.sql.DriverManager.getConnection(self.url, properties)

    @contextmanager
    def _transaction(self):
        """A function that runs a statement with text parameters and returns its update count or rows; all of it commits or nothing."""
        connection = self._connection()
        connection.setAutoCommit(False)

        def run(sql: str, *values: str | None):
            statement = connection.prepareStatement(sql.replace("@", self.prefix))
            try:
                for k, value in enumerate(values, 1):
                    statement.setString(k, value)
                if not statement.execute():
                    return statement.getUpdateCount()
                found, rows = statement.getResultSet(), []
                width = found.getMetaData().getColumnCount()
                while found.next():
                    rows.append([found.getString(k) for k in range(1, width + 1)])
                return rows
            finally:
                statement.close()

        try:
            yield run
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _ready(self) -> None:
        connection = self._connection()
        try:
            there = connection.getMetaData().getTables(None, None, None, None)
            names = set()
            while there.next():
                names.add(there.getString(3).lower())
        finally:
            connection.close()
        with self._transaction() as run:
            for name, columns in _TABLES.items():
                if f"{self.prefix}{name}".lower() not in names:
                    run(f"CREATE TABLE @{name} ({columns.format(text=self.text)})")
                    if name == "results":
                        run("CREATE INDEX @results_run ON @results (run_id, bucket)")

    def _record(self, run, record: Run) -> None:
        run("DELETE FROM @runs WHERE run_id = ?", record.run_id)
        run("INSERT INTO @runs (run_id, queued_at, body) VALUES (?, ?, ?)", record.run_id, record.queued_at, json.dumps(record.as_dict(), ensure_ascii=False))

    def _put_run(self, record: Run) -> None:
        with self._transaction() as run:
            self._record(run, record)

    def get_run(self, run_id: str) -> Run | None:
        with self._transaction() as run:
            found = run("SELECT body FROM @runs WHERE run_id = ?", run_id)
        return Run(**json.loads(found[0][0])) if found else None

    def _all_runs(self) -> list[Run]:
        with self._transaction() as run:
            found = run(f"SELECT body FROM @runs ORDER BY queued_at DESC FETCH FIRST {LAST_RUNS} ROWS ONLY")
        return [Run(**json.loads(r[0])) for r in found]

    def put_artifact(self, kind: str, key: str, body: dict) -> None:
        with self._transaction() as run:
            run("DELETE FROM @artifacts WHERE kind = ? AND id = ?", kind, key)
            run("INSERT INTO @artifacts (kind, id, body) VALUES (?, ?, ?)", kind, key, json.dumps(body, ensure_ascii=False))

    def artifacts(self, kind: str) -> dict[str, dict]:
        with self._transaction() as run:
            found = run("SELECT id, body FROM @artifacts WHERE kind = ?", kind)
        return {key: json.loads(body) for key, body in found}

    def save_results(self, run_id: str, field_results: DataFrame, rollup: DataFrame) -> None:
        record = self.get_run(run_id)
        if record is None:
            raise KeyError(run_id)
        version = uuid.uuid4().hex
        detail = F.col("detail") if "detail" in field_results.columns else F.lit("{}")
        rows = field_results.select(*FIELD_RESULTS, detail.cast("string").alias("detail")).unionByName(rollup.select("record_key", "category"), allowMissingColumns=True)
        path, stage = f"{self.work}/veritab-stage-{version}", f"{self.prefix}stage_{version[:16]}"
        rows.select(*_COLUMNS).write.parquet(path)
        written = self.spark.read.schema(RESULT_SCHEMA).parquet(path)
        record = replace(record, version=version, **_counters(_counted(written)))
        expected = written.count()
        with self._transaction() as run:
            run(f"CREATE TABLE {stage} (copy_id BIGINT GENERATED ALWAYS AS IDENTITY, place VARCHAR(300), bucket INTEGER, {', '.join(f'{c} {self.sent}' for c in _COLUMNS)})")
        try:
            place = F.concat_ws("/", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string"))
            staged = written.select(place.alias("place"), F.pmod(F.xxhash64("record_key"), F.lit(BUCKETS)).cast("int").alias("bucket"), *_COLUMNS)
            staged.write.mode("append").jdbc(self.url, stage, properties=self.properties)
            with self._transaction() as run:
                run("DELETE FROM @results WHERE run_id = ?", run_id)
                run(f"CREATE INDEX {stage}_place ON {stage} (place, copy_id)")
                first = f"NOT EXISTS (SELECT 1 FROM {stage} t WHERE t.place = s.place AND t.copy_id < s.copy_id)"
                moved = run(f"INSERT INTO @results (run_id, bucket, {', '.join(_COLUMNS)}) SELECT CAST(? AS VARCHAR(64)), s.bucket, {', '.join(f'CAST(s.{c} AS {self.text})' for c in _COLUMNS)} FROM {stage} s WHERE {first}", run_id)
                if moved != expected:
                    raise OSError(f"{moved} of {expected} rows reached the database")
                self._record(run, record)
        finally:
            with self._transaction() as run:
                run(f"DROP TABLE {stage}")
            Versions(self.spark, self.work).delete(f"veritab-stage-{version}")

    def rows(self, run_id: str) -> DataFrame:
        """Read in parallel by bucket."""
        quoted = run_id.replace("'", "''")
        parts = [f"run_id = '{quoted}' AND bucket = {b}" for b in range(BUCKETS)]
        found = self.spark.read.jdbc(self.url, f"{self.prefix}results", predicates=parts, properties=self.properties)
        names = {c.lower(): c for c in found.columns}
        return found.select(*(F.col(names[c]).alias(c) for c in _COLUMNS))
