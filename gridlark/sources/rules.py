"""Readers of rule files: field-selection YAML, parent-chained XML, Modbus network rules.

They run on the driver over files of a few kilobytes and raise on anything outside the subset.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass
from uuid import UUID


@dataclass(frozen=True)
class Selection:
    """All conditions must hold: (path, modifier, accepted values)."""

    name: str
    title: str
    level: str
    techniques: tuple[str, ...]
    conditions: tuple[tuple[str, str, tuple], ...]


@dataclass(frozen=True)
class FieldRule:
    """Regular expressions on fields, below a parent."""

    rule_id: int
    level: int
    parent: int | None
    title: str
    techniques: tuple[str, ...]
    fields: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class NetworkRule:
    sid: int
    title: str
    severity: str
    techniques: tuple[str, ...]
    clauses: tuple[tuple[str, str], ...]


def _scalar(text: str):
    text = text.strip().strip("'\"")
    if text in ("true", "false"):
        return text == "true"
    return int(text) if re.fullmatch(r"-?\d+", text) else text


def read_selections(text: str) -> list[Selection]:
    """Documents apart by ``---``; one selection each, scalars or lists, ``|exists``."""
    out = []
    for doc in re.split(r"^---\s*$", text, flags=re.M):
        top: dict[str, str] = {}
        tags, conditions, section, key = [], [], None, None
        for line in doc.splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            indent, body = len(line) - len(line.lstrip()), line.strip()
            if indent == 0 and not body.startswith("- "):
                name, _, value = body.partition(":")
                section = name
                top[name] = value.strip()
            elif section == "tags":
                tags.append(body.removeprefix("- ").strip())
            elif section == "detection" and body == "selection:":
                section = "selection"
            elif section in ("selection", "detection") and body.startswith("condition:"):
                if body.partition(":")[2].strip() != "selection":
                    raise ValueError("only 'condition: selection' is supported")
            elif section == "selection" and body.startswith("- "):
                path, modifier, values = conditions[-1]
                conditions[-1] = (path, modifier, (*values, _scalar(body[2:])))
            elif section == "selection":
                key, _, value = body.partition(":")
                path, _, modifier = key.partition("|")
                if modifier not in ("", "exists"):
                    raise ValueError(f"unknown modifier {modifier}")
                conditions.append((path, modifier, (_scalar(value),) if value.strip() else ()))
        if missing := {"title", "id", "level", "detection"} - top.keys():
            raise ValueError(f"a rule lacks {sorted(missing)}")
        UUID(top["id"])
        techniques = tuple(t.removeprefix("attack.").upper() for t in tags if re.fullmatch(r"attack\.t\d{4}(\.\d{3})?", t))
        out.append(Selection(top.get("name") or top["id"], top["title"], top["level"], techniques, tuple(conditions)))
    if len({r.name for r in out}) != len(out):
        raise ValueError("rule names repeat")
    return out


def read_field_rules(text: str) -> list[FieldRule]:
    out = []
    for rule in ET.fromstring(f"<all>{text}</all>").iter("rule"):
        number = int(rule.attrib["id"])
        if not 100_000 <= number <= 120_000:
            raise ValueError(f"rule id {number} is out of range")
        fields = [(f.attrib["name"], f.text or "") for f in rule.findall("field")] + [("protocol", p.text or "") for p in rule.findall("protocol")]
        for _, pattern in fields:
            # both regex engines read these alike
            if not re.fullmatch(r"[\w^$.+|()]*", pattern):
                raise ValueError(f"pattern {pattern!r} is outside the shared subset")
        parent = rule.findtext("if_sid")
        out.append(FieldRule(number, int(rule.attrib["level"]), int(parent) if parent else None, rule.findtext("description") or "", tuple(i.text or "" for i in rule.iter("id")), tuple(fields)))
    if len({r.rule_id for r in out}) != len(out):
        raise ValueError("rule ids repeat")
    return out


def read_network_rules(text: str) -> list[NetworkRule]:
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if not line.startswith("alert tcp") or "app-layer-protocol:modbus" not in line:
            raise ValueError("only Modbus alerts over TCP are supported")
        found = {k: re.search(p, line) for k, p in {"sid": r"sid:(\d+);", "modbus": r"[; ]modbus: ([^;]+);", "msg": r'msg:"([^"]+)"', "technique": r"attack_technique (T\d{4}(?:\.\d{3})?)"}.items()}
        if not all(found.values()):
            raise ValueError("a rule lacks sid, modbus, msg or attack_technique")
        clauses = tuple(tuple(c.strip().split(" ", 1)) for c in found["modbus"][1].split(","))
        out.append(NetworkRule(int(found["sid"][1]), found["msg"][1], "high" if "classtype:attempted-admin" in line else "medium", (found["technique"][1],), clauses))
    return out


def read_pack(folder: str) -> tuple[list[Selection], list[FieldRule], list[NetworkRule]]:
    from pathlib import Path

    top = Path(folder)
    return read_selections((top / "pack.yml").read_text()), read_field_rules((top / "pack.xml").read_text()), read_network_rules((top / "pack.rules").read_text())
