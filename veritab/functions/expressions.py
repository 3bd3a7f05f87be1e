"""Arithmetic over field names, parsed into columns; no user text ever reaches a SQL parser.

Grammar: numbers, f_<field>, + - * / ( ), unary minus, and the functions in FUNCTIONS.
A field is read as DECIMAL(18,4), null where it is no number; / gives doubles, the rest
stays decimal.  Overflow and unreadable operands give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dialect as d
from .dialect import Value

# The characters that an expression may hold, and the words that it may not.
_ALLOWED = re.compile(r"^[A-Za-z0-9_+\-*/().,\s]+$")
_BLOCKED = ("select", "insert", "update", "delete", "drop", ";", "--", "/*")
_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|([A-Za-z_]\w*)|(.))")


def check(text: str) -> str:
    """text if it holds only allowed characters and none of the blocked words, as substrings."""
    text = str(text)
    if not _ALLOWED.match(text):
        raise ValueError(f"unsafe expression: {text!r}")
    for word in _BLOCKED:
        if word in text.lower():
            raise ValueError(f"unsafe expression contains {word!r}: {text!r}")
    return text


def _binary(op: str, a: Value, b: Value) -> Value:
    if op == "/":
        return Value(d.ieee_divide(a.double(), b.double()), "double")
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
    if "double" in (a.kind, b.kind):
        return Value(f(a.double(), b.double()), "double")
    return Value(f(a.col, b.col), "decimal")


def _same(f) -> Callable:
    def make(*args: Value) -> Value:
        if any(a.kind == "double" for a in args):
            return Value(f(*(a.double() for a in args)), "double")
        return Value(f(*(a.col for a in args)), "decimal")

    return make


def _rounded(a: Value, digits: Value | None) -> Value:
    """a to so many digits, a number written out; half away from zero."""
    if digits is None:
        n = 0
    elif digits.literal is None or digits.literal != int(digits.literal):
        raise ValueError("round needs a whole number of digits, written out")
    else:
        n = int(digits.literal)
    return Value(d.round_away(a.col, n), "double") if a.kind == "double" else Value(F.round(a.col, n), "decimal")


def _real(f, defined: Callable[..., Column] | None = None) -> Callable:
    """A function of doubles; where the operands are not in its domain the value is null."""

    def make(*args: Value) -> Value:
        x = [a.double() for a in args]
        return Value(F.when(defined(*x), f(*x)) if defined else f(*x), "double")

    return make


def _positive(*x: Column) -> Column:
    return reduce(and_, (c > 0 for c in x))


def _remainder(a: Value, b: Value) -> Value:
    """What is left of a, with its sign; null for b = 0."""
    return _same(lambda x, y: F.when(y != 0, x % y))(a, b)


def _truncated(a: Value) -> Value:
    return _same(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))(a)


def _log(a: Value, b: Value | None = None) -> Value:
    """log(x) to base 10, log(base, x)."""
    if b is None:
        return _real(F.log10, _positive)(a)
    return _real(lambda base, x: d.ieee_divide(F.ln(x), F.ln(base)), _positive)(a, b)


FUNCTIONS: dict[str, Callable[..., Value]] = {
    "abs": _same(F.abs),
    "floor": _same(F.floor),
    "ceil": _same(F.ceil),
    "greatest": _same(F.greatest),
    "least": _same(F.least),
    "coalesce": _same(F.coalesce),
    "ceiling": _same(F.ceil),
    "ifnull": _same(lambda a, b: F.coalesce(a, b)),
    "nullif": _same(lambda a, b: F.when(a.eqNullSafe(b), None).otherwise(a)),
    "sign": lambda a: Value(F.when(a.col > 0, 1).when(a.col < 0, -1).when(a.col == 0, 0).cast("decimal(18,0)"), "decimal"),
    "mod": _remainder,
    "fmod": _remainder,
    "trunc": _truncated,
    "sqrt": _real(F.sqrt, lambda x: x >= 0),
    "cbrt": _real(F.cbrt),
    "power": _real(F.pow),
    "pow": _real(F.pow),
    "exp": _real(F.exp),
    "ln": _real(F.ln, _positive),
    "log": _log,
    "log10": _log,
    "log2": _real(F.log2, _positive),
    "pi": lambda: Value(F.pi(), "double"),
    "degrees": _real(F.degrees),
    "radians": _real(F.radians),
    "sin": _real(F.sin),
    "cos": _real(F.cos),
    "tan": _real(F.tan),
    "asin": _real(F.asin, lambda x: x.between(-1, 1)),
    "acos": _real(F.acos, lambda x: x.between(-1, 1)),
    "atan": _real(F.atan),
    "atan2": _real(F.atan2),
    "round": lambda a, n=None: _rounded(a, n),
}


def compile(text: str, fields: dict[str, Value]) -> Value:
    """The column of an expression over fields, which are named without their f_ prefix."""
    tokens = [m.group(1, 2, 3) for m in _TOKEN.finditer(check(text)) if any(m.groups())]
    at = 0

    def peek() -> str | None:
        return next((x for x in tokens[at] if x), None) if at < len(tokens) else None

    def take(expected: str | None = None) -> tuple:
        nonlocal at
        if at >= len(tokens) or expected and peek() != expected:
            raise ValueError(f"expected {expected or 'an operand'} in {text!r}")
        at += 1
        return tokens[at - 1]

    def total() -> Value:
        out = product()
        while peek() in ("+", "-"):
            out = _binary(take()[2], out, product())
        return out

    def product() -> Value:
        out = factor()
        while peek() in ("*", "/"):
            out = _binary(take()[2], out, factor())
        return out

    def factor() -> Value:
        digits, name, sign = take()
        if digits:
            return Value(F.lit(Decimal(digits)), "decimal", Decimal(digits))
        if sign == "-":
            v = factor()
            return Value(-v.col, v.kind, None if v.literal is None else -v.literal)
        if sign == "+":
            return factor()
        if sign == "(":
            out = total()
            take(")")
            return out
        if name and peek() == "(":
            if name.lower() not in FUNCTIONS:
                raise ValueError(f"unknown function {name!r} in {text!r}")
            take("(")
            args = [] if peek() == ")" else [total()]
            while args and peek() == ",":
                take(",")
                args.append(total())
            take(")")
            try:
                return FUNCTIONS[name.lower()](*args)
            except TypeError:
                raise ValueError(f"{name} does not take {len(args)} operands in {text!r}") from None
        if name and name.startswith("f_") and name[2:] in fields:
            return Value(d.to_decimal(fields[name[2:]], 18, 4), "decimal")
        raise ValueError(f"unknown name {name or sign!r} in {text!r}")

    out = total()
    if at < len(tokens):
        raise ValueError(f"unexpected {peek()!r} in {text!r}")
    return out
