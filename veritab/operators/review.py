"""Human review: nothing suggested runs before someone approved it."""

from __future__ import annotations

from datetime import UTC, datetime

SUGGESTED, APPROVED, REJECTED = "SUGGESTED", "APPROVED", "REJECTED"
LOW = 0.7


def _items(template: dict) -> list[tuple[str, str, dict]]:
    """(kind, key, item) of fields and rules."""
    fields = [("field", f["field_key"], f) for f in template.get("fields", [])]
    return fields + [("rule", r.get("rule_key", r.get("rule_id")), r) for r in template.get("rules", [])]


def _waits(item: dict) -> bool:
    return item.get("review_status", APPROVED) == SUGGESTED


def pending(template: dict, low: float = LOW) -> dict:
    """What still waits for review, and what was extracted with little confidence (0 counts as not stated)."""
    waiting = {kind: [key for k, key, item in _items(template) if k == kind and _waits(item)] for kind in ("field", "rule")}
    return {
        "fields_pending": waiting["field"],
        "rules_pending": waiting["rule"],
        "total_pending": len(waiting["field"]) + len(waiting["rule"]),
        "low_confidence": [f"{kind}:{key}" for kind, key, item in _items(template) if (item.get("confidence") or 1.0) < low],
    }


def is_approved(template: dict) -> bool:
    return not any(_waits(item) for _, _, item in _items(template))


def require_approved(template: dict) -> None:
    if not is_approved(template):
        p = pending(template)
        raise ValueError(f"template not fully approved: {p['total_pending']} item(s) still SUGGESTED (fields={p['fields_pending']}, rules={p['rules_pending']})")


def require_unlocked(template: dict) -> None:
    """A published version never changes."""
    if template.get("locked"):
        raise ValueError(f"template version {template.get('version')} is published and can't be changed")


def approve_all(template: dict, approver: str = "system", publish: bool = True) -> dict:
    """Approves everything that waits; publishing locks the version."""
    now = datetime.now(UTC).isoformat()
    for _, _, item in _items(template):
        if _waits(item):
            item.update(review_status=APPROVED, approved_by=approver, approved_at=now)
    if publish:
        template.update(status="PUBLISHED", published_by=approver, published_at=now, locked=True)
    return template


def reject(template: dict, key: str, kind: str = "rule") -> dict:
    for k, own, item in _items(template):
        if k == kind and (own == key or item.get("rule_id") == key):
            item["review_status"] = REJECTED
    return template


def pending_edges(graph, low: float = LOW) -> dict:
    waiting = [e.id for e in graph.edges if e.review_status == SUGGESTED]
    return {"total_edges": len(graph.edges), "pending": len(waiting), "pending_ids": waiting, "low_confidence": [e.id for e in graph.edges if e.confidence < low]}


def approve_edges(graph, reject_ids: list[str] | None = None):
    """Approves every edge but those rejected."""
    for e in graph.edges:
        e.review_status = REJECTED if e.id in set(reject_ids or []) else APPROVED
    return graph
