"""The transform vocabulary: makes two sides comparable before any rule judges them.

A transform is nothing, one {"op": ...} or a list of them, applied left to right.
round and scale give doubles; all others give text.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from . import dialect as d
from .dialect import Value


def _round(v: Value, op: dict) -> Value:
    return Value(d.round_away(v.double(), int(op["args"][0])), "double")


def _scale(v: Value, op: dict) -> Value:
    return Value(d.ieee_divide(v.double(), F.lit(float(d.number(op["args"][0])))), "double")


def _substr(v: Value, op: dict) -> Value:
    start, length = int(op["args"][0]), int(op["args"][1])
    if start == 0:  # position 0 is before the first character
        start, length = 1, length - 1
    return Value(F.substring(v.text(), start, length) if length >= 0 or start < 0 else F.when(v.text().isNotNull(), F.lit("")))


def _pad_left(v: Value, op: dict) -> Value:
    width, fill = int(op["args"][0]), str(op["args"][1])
    if not fill:
        raise ValueError("pad_left needs a character to pad with")
    return Value(F.lpad(v.text(), width, fill))


def _replace(v: Value, op: dict) -> Value:
    return Value(F.replace(v.text(), F.lit(str(op["from"])), F.lit(str(op["to"]))))


def _date_format(v: Value, op: dict) -> Value:
    return Value(d.format_date(d.parse_date(v.text(), str(op["from"])), str(op["to"])))


OPS: dict[str, Callable[[Value, dict], Value]] = {
    "trim": lambda v, op: Value(d.strip_blanks(v.text())),
    "upper": lambda v, op: Value(F.upper(v.text())),
    "lower": lambda v, op: Value(F.lower(v.text())),
    "round": _round,
    "scale": _scale,
    "substr": _substr,
    "pad_left": _pad_left,
    "replace": _replace,
    "null_if": lambda v, op: Value(F.nullif(v.text(), F.lit(str(op["args"][0])))),
    "date_format": _date_format,
}


def apply(value: Value, transform: Any) -> Value:
    """value after the transform; raises ValueError for an unknown op."""
    for op in transform if isinstance(transform, list) else [transform] if transform else []:
        if op.get("op") not in OPS:
            raise ValueError(f"unknown transform op: {op.get('op')!r}")
        value = OPS[op["op"]](value, op)
    return value
