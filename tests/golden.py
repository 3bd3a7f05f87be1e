"""Two small tables of ferry tickets, made by rule, and the verdicts expected of them."""

COLUMNS = ["TICKET", "CABIN", "LOAD", "SAILED", "SEATS", "FARE", "PAID"]
FIELDS = [("ticket", "STRING", True), ("cabin", "ENUM", False), ("load", "DECIMAL", False), ("sailed", "DATE", False), ("seats", "INTEGER", False), ("fare", "DECIMAL", False), ("paid", "DECIMAL", False)]


def _ticket(k):
    return {"TICKET": f"T{k:02}", "CABIN": ("inner", "outer", "deck")[k % 3], "LOAD": f"{k}.{k % 4}", "SAILED": f"{1 + k % 28:02}.{1 + k % 12:02}.2024", "SEATS": str(1 + k % 7), "FARE": "12.5", "PAID": str(12.5 * (1 + k % 7))}


#: What the destination says otherwise, by ticket.
CHANGES = {5: {"CABIN": "outer"}, 12: {"LOAD": "13"}, 2: {"SEATS": "99", "PAID": "1237.5"}, 9: {"PAID": "1"}, 14: {"LOAD": "n/a"}, 18: {"PAID": "??"}, 6: {"CABIN": " inner "}, 7: {"LOAD": "7.5"}}
SOURCE = [_ticket(k) for k in (*range(1, 21), 17)]
DEST = [_ticket(k) | CHANGES.get(k, {}) for k in (*range(20, 0, -1), 8, 15, 15, 31, 32, 33) if k not in (3, 11)]

TRIM = {"op": "trim"}
CODES = {"CABINS": [{"item_code": "inner"}, {"item_code": "outer", "active": True}, {"item_code": "deck"}, {"item_code": "hold", "active": False}]}
AS_OF = "2025-03-31"


def _rule(rule_id, kind, target, severity="ERROR", **params):
    return {"rule_id": rule_id, "rule_key": rule_id, "type": kind, "severity": severity, "params": params, "target_field_keys": [target] if target else []}


TEMPLATE = {
    "template_id": "tickets",
    "version": "1.0.0",
    "fields": [{"field_key": k, "datatype": t, "is_key": key} for k, t, key in FIELDS],
    "rules": [
        _rule("cabin_listed", "LOOKUP", "cabin", code_list="CABINS"),
        _rule("cabin_same", "EQUALITY", "cabin"),
        _rule("load_near", "TOLERANCE", "load", tolerance=0.5, scale=2),
        _rule("paid_adds_up", "CROSS_FIELD", None, "WARNING", lhs="f_seats * f_fare", rhs="f_paid", tolerance=0),
        _rule("sailed_day", "DATE_VALID", "sailed", format="%d.%m.%Y", not_future=True),
        _rule("seats_range", "RANGE", "seats", "WARNING", min=1, max=60),
        _rule("ticket_form", "REGEX", "ticket", pattern="T[0-9]+"),
    ],
}
_BOUND = [{"field_key": k, "src_col": c, "dst_col": c, "dst_transform": TRIM if k == "cabin" else None} for (k, _, _), c in zip(FIELDS, COLUMNS, strict=True)]
MAPPING = {"expected_side": "SOURCE", "key_pairs": _BOUND[:1], "field_bindings": _BOUND}

MISSING = {"T03": "MISSING_IN_DEST", "T11": "MISSING_IN_DEST", "T31": "MISSING_IN_SOURCE", "T32": "MISSING_IN_SOURCE", "T33": "MISSING_IN_SOURCE"}
#: Findings on matched records: (ticket, field, category) -> severity.
ODD = {
    ("T02", "seats", "MISMATCH"): "WARNING",
    ("T05", "cabin", "MISMATCH"): "ERROR",
    ("T09", "cross:paid_adds_up", "MISMATCH"): "WARNING",
    ("T12", "load", "MISMATCH"): "ERROR",
    ("T14", "load", "EXCEPTION"): "ERROR",
    ("T18", "cross:paid_adds_up", "EXCEPTION"): "WARNING",
}
ROLLUP = dict.fromkeys((f"T{k:02}" for k in range(1, 21)), "MATCH") | MISSING | dict.fromkeys(("T08", "T15", "T17"), "DUPLICATE") | {"T05": "MISMATCH", "T12": "MISMATCH", "T14": "EXCEPTION", "T18": "EXCEPTION"}
SUMMARY = {"total_records": 23, "match_count": 11, "mismatch_count": 2, "missing_src": 3, "missing_dst": 2, "duplicate_count": 3, "exception_count": 2}
RESULTS = 15 * 7

SPEC = """What harbours report of tickets

SECTION: FIELDS
ticket | STRING | key required
cabin | ENUM(CABINS) | required
load | DECIMAL |
sailed | DATE |
seats | INTEGER |
fare | DECIMAL |
paid | DECIMAL | required

SECTION: RULES
ticket :: REGEX pattern=T[0-9]+ :: ERROR
cabin :: LOOKUP code_list=CABINS :: ERROR
cabin :: EQUALITY :: ERROR
load :: TOLERANCE tolerance=0.5 scale=2 :: ERROR
seats :: RANGE min=1 max=60 :: WARNING
sailed :: DATE_VALID format=%d.%m.%Y not_future=true :: ERROR
seats,fare,paid :: CROSS_FIELD lhs=f_seats*f_fare rhs=f_paid tolerance=0 :: WARNING
"""


def write(folder):
    paths = []
    for name, rows in (("source", SOURCE), ("dest", DEST)):
        path = folder / f"{name}.csv"
        path.write_text("\n".join(",".join(r[c] for c in COLUMNS) for r in [dict(zip(COLUMNS, COLUMNS, strict=True)), *rows]) + "\n")
        paths.append(str(path))
    return paths
