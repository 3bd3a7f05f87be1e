"""Column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.dialect import parse_date, qcol

#: Formats that a column of dates may have, in the order in which one is chosen, and what a text must look like to be tried.
DATE_FORMATS = {"%Y-%m-%d": r"^\d{4}-\d\d?-\d\d?$", "%Y%m%d": r"^\d{8}$", "%d/%m/%Y": r"^\d\d?/\d\d?/\d{4}$", "%d.%m.%Y": r"^\d\d?\.\d\d?\.\d{4}$"}
#: Bits of a column's kinds: what all of its values are.
_WHOLE, _NUMBER, _DATES = 1, 2, 4


def samples(df: DataFrame, rows: int = 5) -> list[dict]:
    """(column_name, ordinal, sample_values) from the first rows."""
    taken = df.limit(rows).collect()
    return [{"column_name": c, "ordinal": k, "sample_values": [r[k] for r in taken]} for k, c in enumerate(df.columns)]


def statistics(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column_name, ordinal, null_count, distinct_count, min_length, max_length), one pass over the table.

    exact: distinct values by a second aggregation; otherwise a sketch in the same pass."""
    text = {c: qcol(c).cast("string") for c in df.columns}
    pairs = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(c).alias("column_name"), v.alias("value")) for k, (c, v) in enumerate(text.items())])
    long = df.select(F.inline(pairs))
    if exact:  # counts of values first: what is shuffled is at most one row for each value and task
        long = long.groupBy("ordinal", "column_name", "value").agg(F.count("*").alias("n"))
        null_count, distinct = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)), F.count("value")
    else:
        null_count, distinct = F.count_if(F.col("value").isNull()), F.approx_count_distinct("value")
    return long.groupBy("ordinal", "column_name").agg(null_count.alias("null_count"), distinct.alias("distinct_count"), F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"))


def kinds(df: DataFrame) -> DataFrame:
    """(column_name, ordinal, filled, flags, sketch) of every column, by one pass over all rows without a shuffle of them.

    filled: values that are not blank.  flags: bits of what every one of them is, a whole number, a number, a date of each format; -1 without values.  sketch:
    a mergeable sketch of the distinct values.  Tables of parts of a dataset are merged by merge_kinds, so a new file needs no second look at the old ones."""
    texts, flags = [], []
    for k, c in enumerate(df.columns):
        text = F.trim(qcol(c).cast("string"))
        texts.append(F.when(text != "", text).alias(f"t{k}"))
        t = F.col(f"t{k}")
        bits = F.when(t.rlike(r"^[+-]?\d+$"), _WHOLE + _NUMBER).when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), _NUMBER).otherwise(0)
        for j, (fmt, form) in enumerate(DATE_FORMATS.items()):
            bits = bits + F.when(F.when(t.rlike(form), parse_date(t, fmt)).isNotNull(), _DATES << j).otherwise(0)
        flags.append(F.when(t.rlike(r"^[-+.\d]"), bits).when(t.isNotNull(), 0).alias(f"f{k}"))
    rows = df.select(*texts).select("*", *flags)
    n = range(len(df.columns))
    counts = [F.count(f"t{k}").alias(f"n{k}") for k in n] + [F.coalesce(F.bit_and(f"f{k}"), F.lit(-1)).alias(f"f{k}") for k in n]
    row = rows.agg(*counts, *[F.hll_sketch_agg(F.coalesce(f"t{k}", F.lit(""))).alias(f"s{k}") for k in n])
    columns = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).cast("long").alias("ordinal"), F.col(f"n{k}").alias("filled"), F.col(f"f{k}").cast("long").alias("flags"), F.col(f"s{k}").alias("sketch")) for k, c in enumerate(df.columns)])
    return row.select(F.inline(columns))


def merge_kinds(*tables: DataFrame) -> DataFrame:
    """kinds of a dataset from those of its parts; a column is known by its name."""
    every = tables[0]
    for other in tables[1:]:
        every = every.unionByName(other)
    return every.groupBy("column_name").agg(F.min("ordinal").alias("ordinal"), F.sum("filled").alias("filled"), F.bit_and("flags").alias("flags"), F.hll_union_agg("sketch").alias("sketch"))


def inferred(table: DataFrame) -> DataFrame:
    """(column_name, ordinal, filled, kind, date_format, distinct_estimate) of a table of kinds.

    kind: INTEGER, DECIMAL, DATE or STRING, the narrowest that all values have; EMPTY without values.  A number that is a date as well is a DATE."""
    date = F.coalesce(*[F.when(F.col("flags").bitwiseAND(_DATES << j) != 0, F.lit(fmt)) for j, fmt in enumerate(DATE_FORMATS)])
    kind = F.when(F.col("filled") == 0, "EMPTY").when(date.isNotNull(), "DATE").when(F.col("flags").bitwiseAND(_WHOLE) != 0, "INTEGER").when(F.col("flags").bitwiseAND(_NUMBER) != 0, "DECIMAL").otherwise("STRING")
    return table.select("column_name", "ordinal", "filled", kind.alias("kind"), F.when(F.col("filled") > 0, date).alias("date_format"), F.hll_sketch_estimate("sketch").alias("distinct_estimate"))
