"""The mapping as frozen dataclasses, read from YAML and validated; all errors are reported together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import yaml

from concordat.functions.kinds import KINDS

RULES = ("direct", "accent_tolerant", "email", "concat", "situation_label", "situation_reason", "situation_return", "decision_table", "flag", "interval_start", "interval_end")
HYPOTHESES = ("H-SYSTEMIC", "H-BIJECTION", "H-PERMUTATION", "H-ALT-SOURCE", "H-HISTORY-RECORD", "H-ALT-INTERPRETATION", "H-TYPE-ABSENT")
DEFAULT = Path(__file__).parent / "conf" / "hr.yaml"


class ConfigError(ValueError):
    """All problems of a configuration, one a line."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Interpretation:
    choice: str
    alternatives: tuple[str, ...] = ()
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Field:
    target: str
    sources: tuple[str, ...]
    kind: str
    rule: str
    criticality: int
    interpretation: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    id: str = ""
    ref: str = ""


@dataclass(frozen=True)
class Similarity:
    source: str
    target: str
    kind: str


@dataclass(frozen=True)
class Mapping:
    interpretations: dict[str, Interpretation]
    fields: tuple[Field, ...]
    tables: dict[str, Any]
    similarity: tuple[Similarity, ...]
    cross_type_least: float
    missing_in_target: int
    missing_in_source: int
    hypotheses: dict[str, Any]
    scoring: dict[str, Any]

    def field(self, target: str) -> Field:
        return next(f for f in self.fields if f.target == target)

    def with_choices(self, choices: dict[str, str]) -> Mapping:
        """The mapping under other readings; an unknown interpretation or choice raises ValueError."""
        now = dict(self.interpretations)
        for k, v in choices.items():
            i = now.get(k)
            if i is None:
                raise ValueError(f"unknown interpretation {k}")
            if v != i.choice and v not in i.alternatives:
                raise ValueError(f"unknown choice {v} of {k}")
            now[k] = Interpretation(v, tuple(x for x in (i.choice, *i.alternatives) if x != v), i.params)
        return replace(self, interpretations=now)

    def only(self, fields: Sequence[Field]) -> Mapping:
        return replace(self, fields=tuple(fields))

    def active(self) -> Mapping:
        """The mapping with its active readings alone."""
        return replace(self, interpretations={k: replace(i, alternatives=()) for k, i in self.interpretations.items()})


def load(path: str | Path = DEFAULT) -> Mapping:
    return build(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def build(raw: Any) -> Mapping:
    bad: list[str] = []

    def need(cond: bool, what: str) -> None:
        if not cond:
            bad.append(what)

    if not isinstance(raw, dict):
        raise ConfigError(["the mapping isn't a table"])
    unknown = set(raw) - {"version", "interpretations", "tables", "matching", "fields", "hypotheses", "scoring"}
    need(not unknown, f"unknown sections: {sorted(unknown)}")
    inter: dict[str, Interpretation] = {}
    for k, v in (raw.get("interpretations") or {}).items():
        if not isinstance(v, dict) or not v.get("choice"):
            bad.append(f"interpretation {k}: no choice")
            continue
        alternatives = tuple(v.get("alternatives") or ())
        need(v["choice"] not in alternatives, f"interpretation {k}: the choice is among its alternatives")
        need(len(set(alternatives)) == len(alternatives), f"interpretation {k}: repeated alternatives")
        inter[k] = Interpretation(v["choice"], alternatives, dict(v.get("params") or {}))
    tables = raw.get("tables") or {}
    seen: set[int] = set()
    for row in tables.get("situation") or []:
        for c in row.get("codes") or []:
            need(c not in seen, f"situation code {c} stands twice")
            seen.add(c)
        need(row.get("reason") in ("none", "lookup"), f"situation {row.get('label')}: reason must be none or lookup")
        need(row.get("return") in ("none", "source"), f"situation {row.get('label')}: return must be none or source")
    for name, rows in tables.items():
        if name in ("situation", "flags"):
            continue
        for i, a in enumerate(rows):
            need(bool(a.get("when")) and "value" in a, f"decision table {name}, row {i + 1}: needs when and value")
            for j, b in enumerate(rows[:i]):
                wa, wb = a.get("when") or {}, b.get("when") or {}
                need(any(k in wb and wb[k] != x for k, x in wa.items()), f"decision table {name}: rows {j + 1} and {i + 1} overlap")
    fields = []
    for n, f in enumerate(raw.get("fields") or []):
        where = f"field {f.get('target') or n + 1}"
        need(bool(f.get("target")), f"{where}: no target")
        need(bool(f.get("sources")), f"{where}: no sources")
        need(f.get("kind") in KINDS, f"{where}: unknown kind {f.get('kind')}")
        need(f.get("rule") in RULES, f"{where}: unknown rule {f.get('rule')}")
        need(isinstance(f.get("criticality"), int) and 1 <= f["criticality"] <= 5, f"{where}: criticality must be 1 to 5")
        need(f.get("interpretation") is None or f["interpretation"] in inter, f"{where}: unknown interpretation {f.get('interpretation')}")
        count = {"email": 3, "concat": 2, "situation_reason": 2, "situation_return": 2}.get(f.get("rule"), 1)
        need(len(f.get("sources") or []) >= count, f"{where}: {f.get('rule')} needs {count} sources")
        if f.get("rule") == "concat":
            need({"pad", "separator"} <= set(f.get("params") or {}), f"{where}: concat needs pad and separator")
        if f.get("rule") == "decision_table":
            need((f.get("params") or {}).get("table") in tables, f"{where}: unknown decision table")
        if f.get("rule") == "flag":
            need(all(f.get("target") in v for v in (tables.get("flags") or {"": {}}).values()), f"{where}: the flags table lacks it")
        fields.append(Field(f.get("target"), tuple(f.get("sources") or ()), f.get("kind"), f.get("rule"), f.get("criticality"), f.get("interpretation"), dict(f.get("params") or {}), f.get("id") or f"R-{f.get('target')}", str(f.get("ref") or "")))
    targets = [f.target for f in fields]
    need(bool(fields), "no fields")
    need(len(set(targets)) == len(targets), "a target field stands twice")
    m = raw.get("matching") or {}
    sims = []
    for s in m.get("similarity") or []:
        need(s.get("kind") in KINDS, f"similarity {s.get('target')}: unknown kind {s.get('kind')}")
        sims.append(Similarity(s.get("source"), s.get("target"), s.get("kind")))
    need(bool(sims), "no similarity fields")
    least = m.get("cross_type_least", 0.6)
    need(isinstance(least, (int, float)) and 0 < least <= 1, "cross_type_least must be above 0 and at most 1")
    for k in ("missing_in_target", "missing_in_source"):
        need(isinstance(m.get(k, 4), int) and 1 <= m.get(k, 4) <= 5, f"{k} must be a criticality from 1 to 5")
    ids = [f.id for f in fields]
    need(len(set(ids)) == len(ids), "a rule id stands twice")
    h = raw.get("hypotheses") or {}
    need(set(h.get("precedence") or ()) == set(HYPOTHESES) and len(h.get("precedence") or ()) == len(HYPOTHESES), "precedence must name every hypothesis once")
    for k in ("systemic_share", "alt_source_support"):
        need(isinstance(h.get(k), (int, float)) and 0 < h[k] <= 1, f"{k} must be above 0 and at most 1")
    for k in ("systemic_count", "bijection_count", "alt_source_count"):
        need(isinstance(h.get(k), int) and h[k] >= 1, f"{k} must be a count")
    s = raw.get("scoring") or {}
    need(set(s.get("verdict") or ()) == {"ANOMALIE", "INDETERMINE"}, "scoring.verdict must weigh ANOMALIE and INDETERMINE")
    need(set(s.get("confidence") or ()) == {"ELEVEE", "MOYENNE", "FAIBLE"}, "scoring.confidence must weigh ELEVEE, MOYENNE and FAIBLE")
    need(set(s.get("factor") or ()) <= set(HYPOTHESES), "scoring.factor names an unknown hypothesis")
    need(isinstance(s.get("scale"), (int, float)) and s["scale"] > 0, "scoring.scale must be positive")
    for k in ("verdict", "confidence", "factor"):
        need(all(isinstance(v, (int, float)) and v >= 0 for v in (s.get(k) or {}).values()), f"scoring.{k} must hold numbers")
    if bad:
        raise ConfigError(bad)
    return Mapping(inter, tuple(fields), tables, tuple(sims), m.get("cross_type_least", 0.6), m.get("missing_in_target", 5), m.get("missing_in_source", 4), h, s)


def against_data(mapping: Mapping, source_columns: list[str], target_columns: list[str], declared: Sequence[str] = ()) -> list[str]:
    """Columns the mapping names that the data lack, and declared target columns that no field maps."""
    out = [f"{f.target}: no source column {c}" for f in mapping.fields for c in f.sources if c not in source_columns]
    out += [f"no target column {f.target}" for f in mapping.fields if f.target not in target_columns]
    mapped = {f.target for f in mapping.fields}
    return out + [f"{c}: declared but not mapped" for c in sorted(set(declared) - mapped)]


def documentation(mapping: Mapping) -> str:
    """The rules as a Markdown table."""
    lines = ["| Field | Sources | Kind | Rule | Reading | Criticality |", "|---|---|---|---|---|---|"]
    for f in mapping.fields:
        i = mapping.interpretations.get(f.interpretation) if f.interpretation else None
        lines.append(f"| {f.target} | {', '.join(f.sources)} | {f.kind} | {f.rule} | {i.choice if i else ''} | {f.criticality} |")
    return "\n".join(lines) + "\n"
