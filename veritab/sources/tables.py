"""Text tables: CSV in and out, inline code lists."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records

DELIMITERS = ",;\t|"


def head(spark: SparkSession, path: str, lines: int = 20) -> list[str]:
    """The first lines of a text file or folder, read by Spark."""
    return [r.value.removesuffix("\r") for r in spark.read.option("lineSep", "\n").text(path).limit(lines).collect()]


def sniff(lines: list[str]) -> str:
    """The delimiter of CSV lines: the one with the same, largest number of columns in most lines; else the comma."""
    best, score = ",", (0, 0)
    for d in DELIMITERS:
        widths = [len(row) for row in csv.reader(lines, delimiter=d)]
        if widths and widths[0] > 1:
            now = (sum(w == widths[0] for w in widths), widths[0])
            if now > score:
                best, score = d, now
    return best


def _breaks_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field runs over a line's end: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A CSV with a header, every column as text; empty fields are null.

    The delimiter is found from the first lines.  Repeated header names raise ValueError.
    A pass over the lines looks for odd numbers of quotes; where there is one, lines are put together to records (see records), in
    parallel as well."""
    lines = head(spark, path)
    delimiter = delimiter or sniff(lines)
    names = next(csv.reader((line + "\n" for line in lines), delimiter=delimiter), [])
    if len(set(names)) != len(names):
        raise ValueError(f"repeated column names in {path}: {names}")
    if not names:
        return spark.createDataFrame([], "empty string").drop("empty")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    if _breaks_lines(spark, path):
        return records.read_table(spark, path, schema, delimiter)
    return spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Columns in a fixed order, missing ones and nulls as empty text."""
    have = set(df.columns)
    chosen = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns or df.columns]
    df.select(*chosen).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def code_list(spark: SparkSession, items: list[dict]) -> DataFrame:
    """(item_code, active) of a code list; active is true unless said otherwise.  An empty list gives an empty table."""
    return spark.createDataFrame([(str(i["item_code"]), bool(i.get("active", True))) for i in items], "item_code string, active boolean")


def code_table(df: DataFrame, column: str, inactive: tuple[str, ...] = ()) -> DataFrame:
    """(item_code, active): the codes that a column holds, as a code list; those named inactive are not active."""
    codes = df.select(F.col(f"`{column}`").cast("string").alias("item_code")).where("item_code is not null").distinct()
    return codes.select("item_code", ~F.col("item_code").isin(*inactive) if inactive else F.lit(True).alias("active")).toDF("item_code", "active")
