"""Column builders with fixed text, number and date semantics.

Data columns are text.  Casts happen inside rules and transforms, never fail the run,
and follow these conventions: numbers are plain decimal notation (no type suffix, digits may be
grouped by _), doubles print in shortest form (0.5, 1e-05, nan), division follows IEEE,
rounding is half away from zero on the scaled double, dates parse leniently.
Everything here is an expression that Catalyst sees; no Python runs on rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPECIAL = r"(?i)^\s*[+-]?(?:nan|inf|infinity)\s*$"
#: Letters of type suffixes, hexadecimal numbers and of the special values.
LETTERS = "[dDfFxXpP]"
#: The Unicode space separators (category Zs).
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def qcol(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + str(name).replace("`", "``") + "`")


def safe_name(name: str) -> str:
    """name as an identifier: non-word characters become _, a leading digit gets one before it."""
    out = re.sub(r"\W", "_", str(name))
    return f"_{out}" if not out or out[0].isdigit() else out


def number(value) -> float | int:
    """value if it is a number (booleans are not); raises ValueError otherwise."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"expected a number, got {value!r}")
    return value


def number_literal(value) -> Column:
    """An exact literal: decimals for ordinary numbers, a double where the notation has an exponent."""
    text = repr(number(value))
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return F.lit(Decimal(text))
    return F.lit(float(value))


@contextmanager
def exact_decimals(spark: SparkSession):
    """Decimal results keep their scale while plans are built in this block."""
    key = "spark.sql.decimalOperations.allowPrecisionLoss"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass(frozen=True)
class Value:
    """A column, its kind (text, double or decimal), and its value if it is a number that was written out."""

    col: Column
    kind: str = "text"
    literal: Decimal | None = None

    def text(self) -> Column:
        return double_text(self.col) if self.kind == "double" else self.col.cast("string")

    def double(self) -> Column:
        return self.col if self.kind == "double" else self.col.cast("double") if self.kind == "decimal" else to_double(self.col)


def strip_blanks(c: Column) -> Column:
    """Without Unicode space separators at either end; tabs and line ends stay."""
    return F.btrim(c, F.lit(BLANKS))


def _ungrouped(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("_")), F.regexp_replace(c, r"(?<=\d)_(?=\d)", "")).otherwise(c)


def to_double(c: Column) -> Column:
    plain = _ungrouped(c)
    return F.when(~plain.rlike(LETTERS) | plain.rlike(SPECIAL), F.trim(plain).try_cast("double"))


def to_decimal(value: Value, precision: int, scale: int) -> Column:
    if value.kind != "text":
        return value.col.try_cast(f"decimal({precision},{scale})")
    return F.trim(_ungrouped(value.col)).try_cast(f"decimal({precision},{scale})")


def double_text(x: Column) -> Column:
    """Shortest form: plain between 1e-4 and 1e16, else with a signed two-digit exponent."""
    java = x.cast("string")
    size = F.abs(x)
    plain = F.regexp_replace(java.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    exponent = F.regexp_extract(java, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_extract(java, r"^(.*)E", 1), r"\.0$", "")
    scientific = F.concat(digits, F.lit("e"), F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")), F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(exponent).cast("string"))
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when(x == 0, java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.when(java.contains("E"), scientific).otherwise(java))
    )


def round_away(x: Column, digits: int) -> Column:
    if digits >= 0:
        return F.round(x * (10.0**digits), 0) / F.lit(10.0**digits)
    return F.round(x / F.lit(10.0**-digits), 0) * (10.0**-digits)


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b on doubles; a zero divisor gives an infinity or NaN instead of an error."""
    over_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Constructs that a linear-time engine does not have.
_FORBIDDEN = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|[*+?}]\+")


def full_match(c: Column, pattern: str) -> Column:
    if _FORBIDDEN.search(pattern):
        raise ValueError(f"pattern needs lookaround, back-references or possessive quantifiers: {pattern!r}")
    return c.rlike(rf"(?d)\A(?:{pattern})\z")


_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_DIGITS = {"Y": r"\d{1,4}", "m": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "I": r"\d{1,2}", "M": r"\d{1,2}", "S": r"\d{1,2}", "y": r"\d{1,2}", "j": r"\d{1,3}", "f": r"\d{1,6}"}


def _pieces(fmt: str) -> list[tuple[bool, str]]:
    """(is a specifier, its letter or the literal text) of a date format."""
    out, k = [], 0
    while k < len(fmt):
        if fmt[k] == "%":
            if k + 1 == len(fmt):
                raise ValueError(f"date format ends in %: {fmt!r}")
            out.append((False, "%") if fmt[k + 1] == "%" else (True, fmt[k + 1]))
            k += 2
        else:
            out.append((False, fmt[k]))
            k += 1
    return out


def parse_date(c: Column, fmt: str) -> Column:
    """The timestamp that text c denotes in a %-format, or null.

    Numbers may lack leading zeros, blanks around the text are ignored, anything after
    the format or an impossible date gives null.  Specifiers: Y y m d H I M S f j b B p."""
    names: list[str] = []
    pattern = r"^\s*"
    for special, x in _pieces(fmt):
        if not special:
            pattern += re.escape(x)
            continue
        if x in _DIGITS:
            pattern += f"({_DIGITS[x]}+)"  # possessive: no backtracking into shorter numbers
        elif x in "bB":
            choices = [m if x == "B" else m[:3] for m in _MONTHS]
            pattern += f"((?i:{'|'.join(choices)}))"
        elif x == "p":
            pattern += "((?i:am|pm))"
        else:
            raise ValueError(f"unknown date specifier %{x} in {fmt!r}")
        names.append(x)
    pattern += r"\s*$"

    # one pass of the pattern: a marked list of the parts, or the text as it was
    mark = "\x01"
    parts = F.split(F.regexp_replace(c, pattern, mark + mark.join(f"${k + 1}" for k in range(len(names)))), mark)
    return let(F.when(~F.startswith(c, F.lit(mark)), parts), lambda found: _dated(found, names))


def _dated(parts: Column, names: list[str]) -> Column:
    """The timestamp of the parts of a date, whose specifiers are names; parts has an empty text before them."""
    fits = (F.size(parts) == max(1, len(names)) + 1) & (F.try_element_at(parts, F.lit(1)) == "")

    def part(x: str) -> Column | None:
        return F.try_element_at(parts, F.lit(len(names) + 1 - names[::-1].index(x))) if x in names else None

    def whole(x: str, default: int) -> Column:
        p = part(x)
        return F.lit(default) if p is None else p.try_cast("int")

    year = whole("Y", 1900)
    if "y" in names and "Y" not in names:
        short = whole("y", 0)
        year = F.when(short >= 69, short + 1900).otherwise(short + 2000)
    month = whole("m", 1)
    for x in "bB":
        if x in names:
            found = F.lower(F.substring(part(x), 1, 3))
            month = F.ceil(F.call_function("position", found, F.lit("".join(m[:3] for m in _MONTHS))) / 3).cast("int")
    hour = whole("H", 0)
    valid = F.lit(True)
    if "I" in names:
        twelve = whole("I", 12)
        late = F.lower(part("p")) == "pm" if "p" in names else F.lit(False)
        hour = (twelve % 12) + F.when(late, 12).otherwise(0)
        valid = (twelve >= 1) & (twelve <= 12)
    second = whole("S", 0).cast("decimal(8,6)")
    if "f" in names:
        second = second + F.rpad(part("f"), 6, "0").try_cast("int").cast("decimal(16,6)") / F.lit(Decimal(1000000)).cast("decimal(7,0)")
        second = second.cast("decimal(8,6)")
    made = F.try_make_timestamp(year, month, whole("d", 1), hour, whole("M", 0), second)
    if "j" in names:
        day = whole("j", 1)
        made = made + F.make_interval(days=day - 1)
        valid = valid & (day >= 1) & (F.year(made) == year)
    return F.when(fits & valid & (whole("S", 0) < 60), made)


def format_date(ts: Column, fmt: str) -> Column:
    """ts in a %-format; the specifiers of parse_date."""
    return let(ts, lambda found: _formatted(found, fmt))


def _formatted(ts: Column, fmt: str) -> Column:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    makers = {
        "Y": lambda: F.lpad(F.year(ts).cast("string"), 4, "0"), "y": lambda: two(F.year(ts) % 100), "m": lambda: two(F.month(ts)), "d": lambda: two(F.dayofmonth(ts)),
        "H": lambda: two(F.hour(ts)), "I": lambda: two((F.hour(ts) + 11) % 12 + 1), "M": lambda: two(F.minute(ts)), "S": lambda: two(F.second(ts)),
        "j": lambda: F.lpad(F.dayofyear(ts).cast("string"), 3, "0"), "b": lambda: F.date_format(ts, "MMM"), "B": lambda: F.date_format(ts, "MMMM"),
        "p": lambda: F.when(F.hour(ts) < 12, "AM").otherwise("PM"), "f": lambda: F.date_format(ts, "SSSSSS"),
    }
    parts = []
    for special, x in _pieces(fmt):
        if special and x not in makers:
            raise ValueError(f"unknown date specifier %{x} in {fmt!r}")
        parts.append(makers[x]() if special else F.lit(x))
    return F.concat(*parts) if parts else F.when(ts.isNotNull(), F.lit(""))
