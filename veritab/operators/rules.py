"""The judges: each rule becomes one struct column over a matched record.

A result has field_key, rule_id, severity, expected, actual, category, verdict, all
text.  s and d are the two sides' canonical values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions import dialect as d
from veritab.functions import expressions
from veritab.functions.dialect import Value
from veritab.plans.config import Rule, RunConfig

RESULT_FIELDS = ["field_key", "rule_id", "severity", "expected", "actual", "category", "verdict"]
#: Code lists up to this size are compared in place; longer ones are joined.
INLINE_CODES = 1_000


class Binder:
    """Names for intermediate values, so that each is computed once in a projection of its own.

    Level 1 reads the canonical values, each other level those before it."""

    def __init__(self) -> None:
        self.levels: tuple[dict[str, Column], ...] = ({}, {}, {})

    def __call__(self, c: Column, level: int = 1) -> Column:
        name = f"v{level}_{len(self.levels[level - 1])}"
        self.levels[level - 1][name] = c
        return F.col(name)


def _result(field_key: str, rule: Rule, expected: Column, actual: Column, cases: list[tuple[Column | None, str, Column | str]], bind: Binder) -> tuple[Column, Column]:
    """(the result, its category).  cases: (condition, category, verdict), the first that holds counts; the last has no condition."""
    out = None
    for when, category, verdict in reversed(cases):
        row = F.struct(F.lit(category).alias("category"), (F.lit(verdict) if isinstance(verdict, str) else verdict).alias("verdict"))
        out = row if when is None else F.when(when, row).otherwise(out)
    found = bind(out, 3)  # one CASE a rule, whose conditions are evaluated once
    columns = [F.lit(field_key), F.lit(rule.rule_id), F.lit(rule.severity), expected, actual, found["category"], found["verdict"]]
    return F.struct(*(c.alias(n) for c, n in zip(columns, RESULT_FIELDS, strict=True))), found["category"]


def _equality(rule: Rule, s: Value, v: Value) -> list:
    if s.kind == v.kind:
        equal = s.col.eqNullSafe(v.col)
    else:  # a number on one side only: text that is no number differs from every number
        text, double = (s, v) if s.kind == "text" else (v, s)
        equal = (text.col.isNull() & double.col.isNull()) | F.coalesce(text.double() == double.col, F.lit(False))
    return [(equal, "MATCH", "equal"), (None, "MISMATCH", "not_equal")]


def _difference(a: Value, b: Value, tolerance, bind: Binder) -> list:
    """Cases for two numbers, bound already, that should agree within a tolerance."""
    missing = a.col.isNull() | b.col.isNull()
    if "double" in (a.kind, b.kind):
        gap = Value(bind(F.abs(a.double() - b.double()), 2), "double")
        near = gap.col <= F.lit(float(tolerance))
    else:
        gap = Value(bind(F.abs(F.try_subtract(a.col, b.col)), 2), "decimal")
        near = gap.col <= d.number_literal(tolerance)
    return [(missing, "EXCEPTION", "uncastable"), (gap.col.isNull(), "EXCEPTION", "uncastable"), (near, "MATCH", F.concat(F.lit("diff="), gap.text())), (None, "MISMATCH", F.concat(F.lit("diff="), gap.text()))]


def _tolerance(rule: Rule, s: Value, v: Value, bind: Binder) -> list:
    scale = int(rule.params.get("scale", 6))
    a, b = (Value(bind(d.to_decimal(x, 38, scale)), "decimal") for x in (s, v))
    return _difference(a, b, d.number(rule.params["tolerance"]), bind)


def _range(rule: Rule, v: Value, bind: Binder) -> list:
    x = bind(v.double())
    low, high = (float(d.number(rule.params[k])) for k in ("min", "max"))
    return [(x.isNull(), "EXCEPTION", "uncastable"), (x.between(low, high), "MATCH", "in_range"), (None, "MISMATCH", "out_of_range")]


def _regex(rule: Rule, v: Value) -> list:
    return [(v.col.isNull(), "MISMATCH", "empty"), (d.full_match(v.text(), rule.params["pattern"]), "MATCH", "format_ok"), (None, "MISMATCH", "format_bad")]


def _not_null(rule: Rule, v: Value) -> list:
    blank = v.col.isNull() | (d.strip_blanks(v.text()) == "")
    return [(blank, "MISMATCH", "missing"), (None, "MATCH", "present")]


def _lookup(rule: Rule, v: Value, found: Column) -> list:
    return [(v.col.isNull(), "MISMATCH", "empty"), (found, "MATCH", "found"), (None, "MISMATCH", "not_in_list")]


def _date_valid(rule: Rule, v: Value, as_of: str, bind: Binder) -> list:
    day = bind(d.parse_date(v.text(), rule.params.get("format", "%Y-%m-%d")).cast("date"))
    cases = [(day.isNull(), "MISMATCH", "unparseable")]
    if rule.params.get("not_future", False):
        cases.append((day > F.lit(as_of).cast("date"), "MISMATCH", "future_date"))
    return [*cases, (None, "MATCH", "valid")]


def field_of(rule: Rule) -> str:
    """The field_key of a rule's results."""
    return f"cross:{rule.rule_key}" if rule.type == "CROSS_FIELD" else rule.target_field_keys[0]


def judge(rule: Rule, config: RunConfig, source: dict[str, Value], dest: dict[str, Value], joined: dict[str, Column], bind: Binder) -> tuple[Column, Column]:
    """The result struct of one rule and its category.  joined: for code lists too long to compare in place, whether the code was found, by rule id."""
    p = rule.params
    if rule.type == "CROSS_FIELD":
        left, right = (expressions.compile(p[k], dest) for k in ("lhs", "rhs"))
        left, right = (Value(bind(x.col), x.kind) for x in (left, right))
        return _result(field_of(rule), rule, right.text(), left.text(), _difference(left, right, d.number(p["tolerance"]), bind), bind)
    key = field_of(rule)
    v = dest[key]
    actual = v.text()
    match rule.type:
        case "EQUALITY":
            return _result(key, rule, source[key].text(), actual, _equality(rule, source[key], v), bind)
        case "TOLERANCE":
            return _result(key, rule, source[key].text(), actual, _tolerance(rule, source[key], v, bind), bind)
        case "RANGE":
            return _result(key, rule, F.lit(f"[{p['min']},{p['max']}]"), actual, _range(rule, v, bind), bind)
        case "REGEX":
            return _result(key, rule, F.lit(p["pattern"]), actual, _regex(rule, v), bind)
        case "NOT_NULL":
            return _result(key, rule, F.lit("NOT_NULL"), actual, _not_null(rule, v), bind)
        case "LOOKUP":
            found = joined.get(rule.rule_id)
            if found is None:
                codes = config.active_codes(p["code_list"])
                found = actual.isin(codes) if codes else F.lit(False)
            return _result(key, rule, F.lit(f"in:{p['code_list']}"), actual, _lookup(rule, v, found), bind)
        case "DATE_VALID":
            return _result(key, rule, F.lit(f"valid_date({p.get('format', '%Y-%m-%d')})"), actual, _date_valid(rule, v, config.as_of_date, bind), bind)
    raise ValueError(f"unsupported rule type {rule.type}")


def joined_lists(config: RunConfig) -> list[Rule]:
    """LOOKUP rules whose list is too long to compare in place."""
    return [r for r in config.rules if r.type == "LOOKUP" and len(config.active_codes(r.params["code_list"])) > INLINE_CODES]
