"""CSV records with line breaks, put together by many tasks, against the reader that takes a file as a whole."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from veritab.sources import records
from veritab.sources.tables import read_csv


@pytest.fixture
def small_splits(spark):
    for k, v in {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}.items():
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def whole(spark, path, schema="a string, b string, c string"):
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("lineSep", "\n")
    return sorted(map(repr, (tuple(r) for r in reader.schema(schema).csv(path).collect())))


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def field(rng):
    return rng.choice(["", "x", "plain text", 'say "hi"', "two\nlines", "\n\n", "a,b", '"', '""', '","', "ü\n漢字", "long " * rng.randint(1, 60) + "\nend", "line\n" * rng.randint(0, 30)])


@pytest.mark.parametrize("seed", range(4))
def test_as_the_whole_file(spark, tmp_path, small_splits, seed):
    rng, expected = random.Random(seed), []
    for name in ("one.csv", "two.csv"):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n", quoting=rng.choice((csv.QUOTE_MINIMAL, csv.QUOTE_ALL)))
        writer.writerow("abc")
        made = [[str(k), field(rng), field(rng)] for k in range(60)]
        writer.writerows(made)
        expected += [tuple(r) for r in made]
        (tmp_path / name).write_text(out.getvalue(), encoding="utf-8", newline="")
    found = read_csv(spark, str(tmp_path), ",")
    assert found.rdd.getNumPartitions() > 8
    assert sorted(tuple(x or "" for x in r) for r in found.collect()) == sorted(expected)
    assert rows(found) == whole(spark, str(tmp_path))


def test_odd_quotes(spark, tmp_path, small_splits):
    """A quote inside an unquoted field is text; text after a closing quote, a last record without its quote, blank lines."""
    body = "a,b,c\n1,5\" pipe,x\n2,\"q\" tail,y\n\n3,\"open\nstill\",z\n4,x\"y\"z,w\n" + "5,\"" + "m\n" * 200 + "\",v\n6,7,\"never closed\n8,9"
    (tmp_path / "x.csv").write_text(body)
    assert rows(read_csv(spark, str(tmp_path), ",")) == whole(spark, str(tmp_path))


def test_carriage_returns_and_heads(spark, tmp_path, small_splits):
    (tmp_path / "x.csv").write_bytes(b'"a\nb",c\r\n1,"x\r\ny"\r\n2,z\r\n')
    found = read_csv(spark, str(tmp_path), ",")
    assert found.columns == ["a\nb", "c"] and sorted(tuple(r) for r in found.collect()) == [("1", "x\r\ny"), ("2", "z")]
    (tmp_path / "x.csv").write_bytes(b'a,b\n"')
    assert rows(read_csv(spark, str(tmp_path), ",")) == whole(spark, str(tmp_path), "a string, b string")


@pytest.mark.parametrize("line, quoted, ends", [("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ('b""c', True, True), ('a"b,c', False, False), ('"a"x"b', False, False), ("", True, True), ('"', False, True), ('","', False, False), ('a,"",""', False, False), ('","', True, True)])
def test_line_ends(line, quoted, ends):
    assert records.ends_in_quotes(line, quoted, ",") == ends


def test_many_tasks_share_a_file(spark, tmp_path):
    table = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("first\n"), F.repeat(F.lit("x"), 40)).alias("text"))
    table.coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = read_csv(spark, str(tmp_path / "t"))
        tasks = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(tasks) > 5 and sum(r["count"] for r in tasks) == 20_000 and max(r["count"] for r in tasks) < 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
