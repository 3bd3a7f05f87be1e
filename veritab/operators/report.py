"""Report tables over field results and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUES = ("MISMATCH", "EXCEPTION")
ORDER = ["record_key", "field_key", "rule_id"]
#: Column titles of the drill-down sheet.
DRILLDOWN = {"record_key": "Record Key", "field_key": "Field", "category": "Category", "severity": "Severity", "rule_id": "Rule", "expected": "Expected", "actual": "Actual", "verdict": "Verdict"}
MAX_PAGE = 1000


def issues(field_results: DataFrame) -> DataFrame:
    return field_results.where(F.col("category").isin(*ISSUES))


def non_matches(field_results: DataFrame) -> DataFrame:
    return field_results.where(F.col("category") != "MATCH")


def by_field(field_results: DataFrame) -> DataFrame:
    """(field_key, issues)."""
    return issues(field_results).groupBy("field_key").agg(F.count("*").alias("issues"))


def by_severity(field_results: DataFrame) -> DataFrame:
    """(severity, issues) without rows that have none."""
    return issues(field_results).where("severity is not null and severity <> ''").groupBy("severity").agg(F.count("*").alias("issues"))


def by_field_sheet(field_results: DataFrame) -> DataFrame:
    """(field_key, mismatch, exception, total), most issues first, then by name."""
    counts = [F.count_if(F.col("category") == c).alias(c.lower()) for c in ISSUES]
    return issues(field_results).groupBy("field_key").agg(*counts, F.count("*").alias("total")).orderBy(F.desc("total"), "field_key")


def drilldown(field_results: DataFrame, category: str | None = None, field_key: str | None = None) -> DataFrame:
    """Field rows, filtered; an empty filter is none."""
    rows = field_results.where("field_key is not null")
    for name, wanted in (("category", category), ("field_key", field_key)):
        if wanted:
            rows = rows.where(F.col(name) == wanted)
    return rows


def check_page(number: int, size: int) -> None:
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"pages count from 1 and have 1 to {MAX_PAGE} rows")


def page(field_results: DataFrame, number: int = 1, size: int = 50, **filters) -> DataFrame:
    """One page in a total order, of results that are not stored; a store finds its pages from an index."""
    check_page(number, size)
    return drilldown(field_results, **filters).orderBy(*ORDER).offset((number - 1) * size).limit(size)


def citation(detail: Column) -> Column:
    """p.<page>: <text> of a detail JSON's citation, the text alone without a page, else a dash."""
    page_no, text = F.get_json_object(detail, "$.citation.page"), F.coalesce(F.get_json_object(detail, "$.citation.source_text"), F.lit(""))
    with_page = page_no.isNotNull() & ~page_no.isin("0", "", "false")
    return F.when(with_page, F.concat(F.lit("p."), page_no, F.lit(": "), text)).when(text != "", text).otherwise("—")


def drilldown_sheet(field_results: DataFrame) -> DataFrame:
    """The drill-down sheet's columns under their titles; PDF Ref comes from detail where there is one."""
    detail = F.col("detail") if "detail" in field_results.columns else F.lit(None).cast("string")
    return field_results.select(*(F.col(c).alias(t) for c, t in DRILLDOWN.items()), citation(detail).alias("PDF Ref"))


#: Lines of the summary sheet, label -> key of the run record.
RUN_LINES = {
    "Run ID": "run_id", "Status": "status", "Rule engine version": "rule_engine_version", "As-of date": "as_of_date",
    "Template version": "template_version_id", "Mapping": "mapping_id", "Source dataset": "source_dataset_id",
    "Destination dataset": "dest_dataset_id", "Finished at": "finished_at",
}
KPI_LINES = {"Total": "total_records", "Match": "match_count", "Mismatch": "mismatch_count", "Missing (src)": "missing_src", "Missing (dst)": "missing_dst", "Duplicate": "duplicate_count", "Exception": "exception_count"}
SIGN_OFF = ("Reviewed by", "Approved by", "Date")


def summary_sheet(run: dict) -> list[tuple[str, object]]:
    """Lines of the summary sheet: the run, its counters, the sign-off block."""
    counters = run.get("summary") or {}
    return [*((label, run.get(key)) for label, key in RUN_LINES.items()), *((label, counters.get(key, 0)) for label, key in KPI_LINES.items()), *((label, "_" * 24) for label in SIGN_OFF)]


def write_excel(run: dict, field_results: DataFrame, path: str) -> str:
    """A workbook of the three sheets; needs openpyxl.  Rows are streamed, not held."""
    try:
        from openpyxl import Workbook
    except ImportError as missing:
        raise RuntimeError("the Excel report needs openpyxl; write_csv has the same tables") from missing
    book = Workbook(write_only=True)
    sheet = book.create_sheet("Summary")
    for line in summary_sheet(run):
        sheet.append(line)
    for title, table in (("By Field", by_field_sheet(field_results)), ("Drilldown", drilldown_sheet(field_results.orderBy(*ORDER)))):
        sheet = book.create_sheet(title)
        sheet.append(table.columns)
        for row in table.toLocalIterator():
            sheet.append(list(row))
    book.save(path)
    return path


def write_csv(run: dict, field_results: DataFrame, path: str) -> str:
    """The same three tables as CSV folders under path, written in parallel."""
    spark = field_results.sparkSession
    lines = spark.createDataFrame([(k, None if v is None else str(v)) for k, v in summary_sheet(run)], "label string, value string")
    for name, table in (("summary", lines.coalesce(1)), ("by_field", by_field_sheet(field_results)), ("drilldown", drilldown_sheet(field_results))):
        table.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    return path
