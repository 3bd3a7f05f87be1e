"""Template, mapping and code lists as checked, immutable configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

#: The rule types.
FIELD_RULES = ("EQUALITY", "TOLERANCE", "RANGE", "REGEX", "NOT_NULL", "LOOKUP", "DATE_VALID")
CROSS_FIELD = "CROSS_FIELD"
NEEDS_SOURCE = ("EQUALITY", "TOLERANCE")
ENGINE_VERSION = "rule-engine/1.0.0"
AS_OF = "2026-06-04"


@dataclass(frozen=True)
class Binding:
    field_key: str
    src_col: str | None = None
    dst_col: str | None = None
    src_transform: Any = None
    dst_transform: Any = None

    @classmethod
    def of(cls, body: dict) -> Binding:
        return cls(body["field_key"], body.get("src_col"), body.get("dst_col"), body.get("src_transform"), body.get("dst_transform"))

    def column(self, side: str) -> str | None:
        return self.src_col if side == "src" else self.dst_col

    def transform(self, side: str) -> Any:
        return self.src_transform if side == "src" else self.dst_transform


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_key: str
    type: str
    severity: str = "ERROR"
    params: dict = field(default_factory=dict)
    target_field_keys: tuple[str, ...] = ()

    @classmethod
    def of(cls, body: dict) -> Rule:
        return cls(body["rule_id"], body.get("rule_key", body["rule_id"]), body["type"], body.get("severity", "ERROR"), dict(body.get("params") or {}), tuple(body.get("target_field_keys", ())))


@dataclass(frozen=True)
class RunConfig:
    key_pairs: tuple[Binding, ...]
    field_bindings: tuple[Binding, ...]
    rules: tuple[Rule, ...]
    cross_rules: tuple[Rule, ...]
    code_lists: dict
    as_of_date: str = AS_OF
    engine_version: str = ENGINE_VERSION
    expected_side: str = "SOURCE"

    def fields(self, side: str) -> dict[str, Binding]:
        """Field key -> binding on a side; a key pair wins over a field binding of the same field."""
        out: dict[str, Binding] = {}
        for b in (*self.key_pairs, *self.field_bindings):
            if b.column(side):
                out.setdefault(b.field_key, b)
        return out

    def active_codes(self, name: str) -> list[str]:
        """The active codes of a list, each once, in order."""
        return list(dict.fromkeys(str(item["item_code"]) for item in self.code_lists[name] if item.get("active", True)))


def resolve(template: dict, mapping: dict, code_lists: dict | None = None, as_of_date: str = AS_OF, engine_version: str = ENGINE_VERSION) -> RunConfig:
    """A checked run configuration; raises ValueError for what can't run.

    The review status of single rules is not looked at: the gate on templates is
    operators.review.require_approved."""
    rules = sorted(map(Rule.of, template.get("rules", [])), key=lambda r: r.rule_id)
    config = RunConfig(
        key_pairs=tuple(map(Binding.of, mapping.get("key_pairs", []))),
        field_bindings=tuple(map(Binding.of, mapping.get("field_bindings", []))),
        rules=tuple(r for r in rules if r.type != CROSS_FIELD),
        cross_rules=tuple(r for r in rules if r.type == CROSS_FIELD),
        code_lists=code_lists or {},
        as_of_date=as_of_date,
        engine_version=engine_version,
        expected_side=mapping.get("expected_side", "SOURCE"),
    )
    validate(config)
    return config


def validate(config: RunConfig) -> None:
    from veritab.functions.dialect import safe_name

    if not config.key_pairs:
        raise ValueError("mapping has no key_pairs: records can't be matched")
    source, dest = config.fields("src"), config.fields("dst")
    for side, fields in (("source", source), ("destination", dest)):
        names: dict[str, str] = {}
        for key in fields:
            if names.setdefault(safe_name(key), key) != key:
                raise ValueError(f"{side} fields {names[safe_name(key)]!r} and {key!r} have the same safe name")
    for rule in config.rules:
        if rule.type not in FIELD_RULES:
            raise ValueError(f"rule {rule.rule_id}: unknown single-field type {rule.type}")
        if not rule.target_field_keys:
            raise ValueError(f"rule {rule.rule_id}: missing target_field_keys")
        key = rule.target_field_keys[0]
        if key not in dest:
            raise ValueError(f"rule {rule.rule_id}: field {key!r} has no destination binding")
        if rule.type in NEEDS_SOURCE and key not in source:
            raise ValueError(f"rule {rule.rule_id}: field {key!r} needs a source binding for {rule.type}")
        if rule.type == "LOOKUP" and rule.params.get("code_list") not in config.code_lists:
            raise ValueError(f"rule {rule.rule_id}: code_list {rule.params.get('code_list')!r} not provided")
    for rule in config.cross_rules:
        for name in ("lhs", "rhs", "tolerance"):
            if name not in rule.params:
                raise ValueError(f"cross rule {rule.rule_id}: missing param {name!r}")


def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
