import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veritab.functions import dialect as d
from veritab.functions import expressions, transforms
from veritab.functions.dialect import Value


def values(spark, texts, make):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string")
    return [r.y for r in rows.select("k", make(F.col("x")).alias("y")).orderBy("k").collect()]


def test_numbers(spark):
    texts = ["12", " 12 ", "1e3", ".5", "5.", "+5", "1_000", "12d", "12f", "0x10", "", "abc", None, "nan", "-inf"]
    got = values(spark, texts, d.to_double)
    assert got[:7] == [12, 12, 1000, 0.5, 5, 5, 1000] and got[7:13] == [None] * 6
    assert math.isnan(got[13]) and got[14] == -math.inf
    assert values(spark, ["1.25", "NaN", "x", "-1.25"], lambda c: d.to_decimal(Value(c), 10, 1)) == [Decimal("1.3"), None, None, Decimal("-1.3")]


def test_double_text_is_the_shortest(spark):
    numbers = [0.0, -0.0, 1.0, 0.5, 12345678.9, 0.0001, 1e-05, 1.5e-7, 1e16, 123456789012345.6, math.inf, -math.inf, 54000.0]
    got = values(spark, [repr(x) for x in numbers], lambda c: d.double_text(c.cast("double")))
    assert got == [repr(x) for x in numbers]
    assert values(spark, ["nan"], lambda c: d.double_text(d.to_double(c))) == ["nan"]


def test_dates(spark):
    parse = lambda fmt: lambda c: d.format_date(d.parse_date(c, fmt), "%Y-%m-%d")
    texts = ["2021-02-03", "2021-2-3", " 2021-02-03 ", "2021-02-30", "2021-02-03x", "12021-01-01", None, "2021-13-40"]
    assert values(spark, texts, parse("%Y-%m-%d")) == ["2021-02-03"] * 3 + [None] * 5
    assert values(spark, ["20210203", "2021023"], parse("%Y%m%d")) == ["2021-02-03", "2021-02-03"]
    assert values(spark, ["03 Feb 21", "3 feb 69", "3 Foo 21"], parse("%d %b %y")) == ["2021-02-03", "1969-02-03", None]
    assert values(spark, ["2021 034", "2021 366"], parse("%Y %j")) == ["2021-02-03", None]
    assert values(spark, ["2021-02-03 11:05 PM"], lambda c: d.format_date(d.parse_date(c, "%Y-%m-%d %I:%M %p"), "%H:%M")) == ["23:05"]
    for fmt in ("%Q", "%"):
        with pytest.raises(ValueError):
            d.parse_date(F.col("x"), fmt)


def test_full_match(spark):
    assert values(spark, ["abc", "abc\n", "xabc"], lambda c: d.full_match(c, "abc$|abc")) == [True, False, False]
    for pattern in ("(?=x)", r"(a)\1", "a++"):
        with pytest.raises(ValueError):
            d.full_match(F.col("x"), pattern)


def transform(spark, texts, op):
    return values(spark, texts, lambda c: transforms.apply(Value(c), op).text())


def test_transforms(spark):
    assert transform(spark, ["  a \t", "　b", None], {"op": "trim"}) == ["a \t", "b", None]
    assert transform(spark, ["aB"], {"op": "upper"}) == ["AB"] and transform(spark, ["aB"], {"op": "lower"}) == ["ab"]
    assert transform(spark, ["1.005", "2.5", "x", "-2.5"], {"op": "round", "args": [2]}) == ["1.0", "2.5", None, "-2.5"]
    assert transform(spark, ["1250"], {"op": "round", "args": [-2]}) == ["1300.0"]
    assert transform(spark, ["5", "0", "-5"], {"op": "scale", "args": [0]}) == ["inf", "nan", "-inf"]
    assert transform(spark, ["abcdef"], {"op": "substr", "args": [2, 3]}) == ["bcd"]
    assert transform(spark, ["abc"], {"op": "substr", "args": [0, 3]}) == ["ab"]
    assert transform(spark, ["7", "12345"], {"op": "pad_left", "args": [3, "0"]}) == ["007", "123"]
    assert transform(spark, ["a.b"], {"op": "replace", "from": ".", "to": "-"}) == ["a-b"]
    assert transform(spark, ["N/A", "x"], {"op": "null_if", "args": ["N/A"]}) == [None, "x"]
    assert transform(spark, ["31/12/2020"], {"op": "date_format", "from": "%d/%m/%Y", "to": "%Y%m%d"}) == ["20201231"]
    assert transform(spark, [" 1.26 "], [{"op": "trim"}, {"op": "round", "args": [1]}]) == ["1.3"]
    for bad in ({"op": "nope"}, {"op": "scale", "args": [True]}, {"op": "pad_left", "args": [3, ""]}):
        with pytest.raises(ValueError):
            transforms.apply(Value(F.col("x")), bad)


def test_expressions(spark):
    rows = spark.createDataFrame([("6", "7", "x")], "a string, b string, c string")
    fields = {k: Value(F.col(k)) for k in "abc"}

    def value(text):
        with d.exact_decimals(spark):
            return rows.select(expressions.compile(text, fields).text().alias("y")).first().y

    assert value("f_a * f_b") == "42.00000000" and value("f_a + 2 * (f_b - 1)") == "18.0000"
    assert value("-f_a + 1") == "-5.0000" and value("f_a / 4") == "1.5" and value("f_a / 0") == "inf"
    assert value("f_c * 2") is None and value("greatest(f_a, f_b)") == "7.0000"
    assert value("trunc(-f_a / 4)") == "-1.0" and float(value("mod(-f_b, 4)")) == -3 and value("mod(f_a, 0)") is None and float(value("sign(-f_a)")) == -1
    for text, want in (("log(f_a)", 0.7781512503836436), ("log(2, f_a + 2)", 3), ("ln(exp(f_b))", 7), ("log2(8)", 3), ("pow(f_a, 2)", 36), ("cbrt(27)", 3), ("pi()", 3.141592653589793), ("sin(radians(90))", 1), ("degrees(atan2(1, 1))", 45), ("nullif(f_a, f_b)", 6), ("ifnull(f_c, f_b)", 7), ("ceiling(f_a / 4)", 2)):
        assert abs(float(value(text)) - want) < 1e-9, text
    assert all(value(t) is None for t in ("ln(0)", "log(f_a - f_b)", "sqrt(-1)", "acos(2)", "nullif(f_a, 6)", "log2(f_c)"))
    for bad in ("mod(f_a)", "pi(1)", "sign()", "ln(f_a, f_b)", "f_z", "exec(1)", "f_a +", "f_a; drop", "f_last_update", "f_a ) ", "'x'"):
        with pytest.raises(ValueError):
            value(bad)


def test_names():
    assert d.safe_name("a.b") == "a_b" and d.safe_name("1x") == "_1x" and d.safe_name("ชื่อ-1")[-2:] == "_1"
    with pytest.raises(ValueError):
        d.number(True)


def test_kinds_of_columns(spark):
    """Every value counts, not the first few; parts merge to what the whole gives."""
    from veritab.operators import profile

    rows = [("1", "1.5", "2024-01-31", "20240131", "31.12.2023", "x", None, "007", "1e3", "20240101")] * 40 + [(" -2 ", ".5", "2024-2-3", "20240229", "01.01.2024", "1", " ", "12", "nan", "20249999"), (None, "7", None, None, "", None, "", "3", "5", "5")]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ("whole", "number", "iso", "digits", "dots", "text", "none", "zeros", "special", "not.dates")))
    wanted = {"whole": "INTEGER", "number": "DECIMAL", "iso": "DATE", "digits": "DATE", "dots": "DATE", "text": "STRING", "none": "EMPTY", "zeros": "INTEGER", "special": "STRING", "not.dates": "INTEGER"}
    found = {r.column_name: r for r in profile.inferred(profile.kinds(df)).collect()}
    assert {c: r.kind for c, r in found.items()} == wanted and found["dots"].date_format == "%d.%m.%Y" and found["text"].date_format is None
    assert found["none"].filled == 0 and found["iso"].filled == 41 and found["zeros"].distinct_estimate == 3
    parts = [profile.kinds(df.limit(0)), *(profile.kinds(spark.createDataFrame(rows[a:b], df.schema)) for a, b in ((0, 10), (10, 41), (41, 42)))]
    merged = {r.column_name: r for r in profile.inferred(profile.merge_kinds(*parts)).collect()}
    assert {c: (r.kind, r.filled, r.date_format) for c, r in merged.items()} == {c: (r.kind, r.filled, r.date_format) for c, r in found.items()}
