"""Expert feedback: rules and corrections on findings, previews without effect, suggestions from corrections."""

from __future__ import annotations

import os
import re
import tempfile
from collections import Counter
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.config import HYPOTHESES
from concordat.functions import kinds as K

# Operations of an expert rule and the parameters each needs.
OPERATIONS = {"accept_alternative_source": ["column"], "accept_value_mapping": ["mapping"], "accept_hypothesis": ["hypothesis"], "accept_subcategory": ["subcategory"]}
VERDICTS = ("CONFORME", "JUSTIFIE", "ANOMALIE", "INDETERMINE")
VERSION = 1


@dataclass(frozen=True)
class ExpertRule:
    id: str
    operation: str
    field: str
    params: dict
    reason: str
    active: bool = True
    author: str = ""
    created: str = ""
    provenance: str = "form"
    original_text: str | None = None


@dataclass(frozen=True)
class Correction:
    """expected, target_raw and verdict_machine are the fingerprint of the finding that was judged."""

    finding_id: str
    verdict: str
    reason: str
    expected: str | None
    target_raw: str | None
    verdict_machine: str | None = None
    author: str = ""
    created: str = ""

    @staticmethod
    def of(finding: Any, verdict: str, reason: str, author: str = "") -> Correction:
        """A correction of a finding's row as it is now."""
        return Correction(finding["finding_id"], verdict, reason, finding["expected"], finding["target_raw"], finding["verdict"], author, datetime.now(timezone.utc).isoformat(timespec="seconds"))


def _param_problem(rule: ExpertRule, columns: Sequence[str] | None) -> str | None:
    """What is wrong with the value of the operation's one parameter."""
    name = OPERATIONS[rule.operation][0]
    value = rule.params[name]
    if name == "mapping":
        good = isinstance(value, dict) and len(value) > 0 and all(isinstance(x, (str, int, float)) for kv in value.items() for x in kv)
        return None if good else "mapping must hold at least one pair of plain values"
    if not isinstance(value, str) or not value.strip():
        return f"{name} must be a text"
    if name == "hypothesis" and value not in HYPOTHESES:
        return f"unknown hypothesis {value}"
    if name == "column" and columns is not None and value not in columns:
        return f"unknown column {value}"
    return None


def problems(rule: ExpertRule, fields: Sequence[str], columns: Sequence[str] | None = None) -> list[str]:
    """All that is wrong with a rule. columns: the columns an alternative source may name, any if not given."""
    found = [
        (not rule.id.strip(), "no id"),
        (rule.field not in fields, f"unknown field {rule.field}"),
        (not str(rule.reason).strip(), "no reason"),
        (not isinstance(rule.active, bool), "active must be true or false"),
    ]
    out = [text for bad, text in found if bad]
    if rule.operation not in OPERATIONS:
        out.append(f"unknown operation {rule.operation}")
    elif sorted(rule.params) != OPERATIONS[rule.operation]:
        out.append(f"{rule.operation} takes exactly {', '.join(OPERATIONS[rule.operation])}")
    else:
        wrong = _param_problem(rule, columns)
        out += [wrong] if wrong else []
    return [f"{rule.id or '?'}: {x}" for x in out]


def correction_problems(c: Correction) -> list[str]:
    found = [(not c.finding_id.strip(), "no finding"), (not c.reason.strip(), "a correction needs a reason"), (c.verdict not in VERDICTS, f"unknown verdict {c.verdict}")]
    return [f"correction of {c.finding_id or '?'}: {text}" for bad, text in found if bad]


_SERIAL = re.compile(r"R-EXPERT-(\d+)")


@dataclass(frozen=True)
class Store:
    """Rules in order and corrections, as kept in a YAML file. Every change gives a new store or raises ValueError."""

    rules: tuple[ExpertRule, ...] = ()
    corrections: tuple[Correction, ...] = ()
    exists: bool = field(default=True, compare=False)

    @staticmethod
    def load(path: str | Path, fields: Sequence[str], columns: Sequence[str] | None = None) -> Store:
        """A missing file is an empty store with exists=False; a file with faults raises ValueError with all of them."""
        try:
            raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        except FileNotFoundError:
            return Store(exists=False)
        except yaml.YAMLError as e:
            raise ValueError(f"not YAML: {e}") from e
        if not isinstance(raw, (dict, type(None))):
            raise ValueError("the file isn't a table")
        return Store.parse(raw or {}, fields, columns)

    @staticmethod
    def parse(raw: dict, fields: Sequence[str], columns: Sequence[str] | None = None) -> Store:
        bad: list[str] = []
        if raw.get("version", VERSION) != VERSION:
            bad.append(f"unknown version {raw['version']}")
        bad += [f"unknown section {k}" for k in sorted(set(raw) - {"version", "rules", "corrections"})]
        rules, corrections = [], []
        for n, r in enumerate(raw.get("rules") or [], 1):
            try:
                rules.append(ExpertRule(**{k: v for k, v in {**r, "params": dict(r.get("params") or {}), "reason": r.get("reason") or ""}.items()}))
            except (TypeError, AttributeError, ValueError):
                bad.append(f"rule {n} isn't one: {r}")
        for n, c in enumerate(raw.get("corrections") or [], 1):
            try:
                corrections.append(Correction(**{**{k: v for k, v in c.items() if k != "fingerprint"}, **dict.fromkeys(("expected", "target_raw")), **(c.get("fingerprint") or {}), "reason": c.get("reason") or ""}))
            except (TypeError, AttributeError, ValueError):
                bad.append(f"correction {n} isn't one: {c}")
        bad += [x for r in rules for x in problems(r, fields, columns)] + [x for c in corrections for x in correction_problems(c)]
        bad += [f"{i}: stands twice" for i, n in Counter(r.id for r in rules).items() if n > 1]
        bad += [f"correction of {i}: stands twice" for i, n in Counter(c.finding_id for c in corrections).items() if n > 1]
        if bad:
            raise ValueError("\n".join(bad))
        return Store(tuple(rules), tuple(corrections))

    def document(self) -> dict:
        print_ = ("expected", "target_raw", "verdict_machine")
        corrections = [{**{k: v for k, v in asdict(c).items() if k not in print_}, "fingerprint": {k: getattr(c, k) for k in print_}} for c in self.corrections]
        return {"version": VERSION, "rules": [asdict(r) for r in self.rules], "corrections": corrections}

    def save(self, path: str | Path) -> None:
        """Readers see the old file or the new one: it is written beside the old one, flushed to disk and then put in its
        place; nothing is left behind when writing fails."""
        target = Path(path).absolute()
        target.parent.mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=target.parent, prefix=".feedback-", delete=False) as f:
            try:
                yaml.safe_dump(self.document(), f, allow_unicode=True, sort_keys=False)
                f.flush()
                os.fsync(f.fileno())
            except BaseException:
                os.unlink(f.name)
                raise
        os.replace(f.name, target)

    def next_id(self) -> str:
        """R-EXPERT-001, -002 ...: one above the largest number in use."""
        used = [int(m[1]) for m in map(_SERIAL.fullmatch, (r.id for r in self.rules)) if m]
        return f"R-EXPERT-{1 + max([0, *used]):03d}"

    def add_rule(self, rule: ExpertRule, fields: Sequence[str], columns: Sequence[str] | None = None) -> Store:
        return Store.parse({"rules": [*self.document()["rules"], asdict(rule)], "corrections": self.document()["corrections"]}, fields, columns)

    def remove_rule(self, rule_id: str) -> Store:
        return self._without("rules", "id", rule_id)

    def set_active(self, rule_id: str, active: bool) -> Store:
        if rule_id not in {r.id for r in self.rules}:
            raise ValueError(f"no rule {rule_id}")
        return replace(self, rules=tuple(replace(r, active=active) if r.id == rule_id else r for r in self.rules))

    def correct(self, c: Correction) -> Store:
        """A new correction replaces the old one of its finding."""
        bad = correction_problems(c)
        if bad:
            raise ValueError("\n".join(bad))
        others = [x for x in self.corrections if x.finding_id != c.finding_id]
        return replace(self, corrections=(*others, c))

    def remove_correction(self, finding_id: str) -> Store:
        return self._without("corrections", "finding_id", finding_id)

    def _without(self, part: str, name: str, value: str) -> Store:
        rest = tuple(x for x in getattr(self, part) if getattr(x, name) != value)
        if len(rest) == len(getattr(self, part)):
            raise ValueError(f"nothing to remove: {value}")
        return replace(self, **{part: rest})

    def correction_rows(self, spark) -> DataFrame:
        rows = [(c.finding_id, c.verdict, c.expected, c.target_raw) for c in self.corrections]
        return spark.createDataFrame(rows, "finding_id string, new_verdict string, c_expected string, c_target_raw string")


def parse_mapping(text: str) -> dict[str, str]:
    """Lines `a => b` as a value mapping; blank lines and lines that begin with # don't count. `(vide)` and nothing stand
    for an empty value. Lines without an arrow or with a left side that stands twice raise ValueError."""
    out: dict[str, str] = {}
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        left, arrow, right = (x.strip() for x in line.partition("=>"))
        left, right = ("" if x == "(vide)" else x for x in (left, right))
        if not arrow:
            raise ValueError(f"line {n}: no =>")
        if left in out:
            raise ValueError(f"line {n}: {left} stands twice")
        out[left] = right
    return out


def translate(sentence: str, rule_id: str, fields: Sequence[str], author: str = "") -> ExpertRule:
    """A rule from one sentence of a small fixed language; anything else raises ValueError.

    accept FIELD from column NAME / accept FIELD under hypothesis NAME / accept FIELD with subcategory TEXT /
    accept FIELD where A => B [; C => D ...], each with `because REASON` at the end.
    """
    m = re.fullmatch(r"\s*accept\s+(?P<field>\S+)\s+(?:from\s+column\s+(?P<column>.+?)|under\s+hypothesis\s+(?P<hypothesis>\S+)|with\s+subcategory\s+(?P<subcategory>.+?)|where\s+(?P<mapping>.+?))\s+because\s+(?P<reason>.+?)\s*", sentence, re.I | re.S)
    if not m:
        raise ValueError("not a rule: " + sentence.strip())
    name = next(k for k in ("column", "hypothesis", "subcategory", "mapping") if m[k] is not None)
    value = parse_mapping(m[name].replace(";", "\n")) if name == "mapping" else m[name].strip()
    operation = next(k for k, v in OPERATIONS.items() if v == [name])
    rule = ExpertRule(rule_id, operation, m["field"], {name: value}, m["reason"], author=author, created=datetime.now(timezone.utc).isoformat(timespec="seconds"), provenance="text", original_text=sentence.strip())
    bad = problems(rule, fields)
    if bad:
        raise ValueError("\n".join(bad))
    return rule


def condition(rule: ExpertRule) -> Column:
    """Whether a rule accepts a finding. An alternative source looks into the map `candidates` (column -> normalised)."""
    here = (F.col("target_field") == rule.field) & (F.col("verdict") == "ANOMALIE")
    if rule.operation == "accept_alternative_source":
        test = F.try_element_at("candidates", F.lit(rule.params["column"])) == F.col("target_norm")
    elif rule.operation == "accept_value_mapping":
        m = rule.params["mapping"]
        table = F.create_map(*[F.lit(str(x)) for kv in m.items() for x in kv]) if m else F.expr("cast(map() as map<string,string>)")
        test = F.try_element_at(table, F.coalesce("expected", F.lit(""))) == F.coalesce("target_norm", F.lit(""))
    elif rule.operation == "accept_hypothesis":
        test = F.array_contains("hypotheses", rule.params["hypothesis"])
    else:
        test = F.col("subcategory") == rule.params["subcategory"]
    return here & F.coalesce(test, F.lit(False))


def apply_rules(findings: DataFrame, rules: Sequence[ExpertRule]) -> DataFrame:
    """The first matching active rule justifies an anomaly: verdict JUSTIFIE, high confidence, source EXPERT."""
    hit = F.lit(None).cast("string")
    for r in reversed([r for r in rules if r.active]):
        hit = F.when(condition(r), F.lit(r.id)).otherwise(hit)
    x = findings.withColumn("expert_rule", hit).withColumn("initial_verdict", F.when(hit.isNotNull(), F.col("verdict")))
    changed = F.col("expert_rule").isNotNull()
    return x.withColumns({"verdict": F.when(changed, "JUSTIFIE").otherwise(F.col("verdict")), "confidence": F.when(changed, "ELEVEE").otherwise(F.col("confidence")), "decision_source": F.when(changed, "EXPERT").otherwise("REGLE")})


def apply_corrections(findings: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections (finding_id, new_verdict, c_expected, c_target_raw) hold while expected and target are as they were;
    `correction` says applied or stale. One row a finding id is expected in `corrections`."""
    same = F.col("c_expected").eqNullSafe(F.col("expected")) & F.col("c_target_raw").eqNullSafe(F.col("target_raw"))
    x = findings.join(corrections, "finding_id", "left")
    state = F.when(F.col("new_verdict").isNull(), None).when(same, "applied").otherwise("stale")
    x = x.withColumn("correction", state)
    ok = F.col("correction") == "applied"
    source = {"decision_source": F.when(ok, "EXPERT").otherwise(F.col("decision_source"))} if "decision_source" in findings.columns else {}
    return x.withColumns({"verdict": F.when(ok, F.col("new_verdict")).otherwise(F.col("verdict")), "confidence": F.when(ok, "ELEVEE").otherwise(F.col("confidence")), **source}).drop("new_verdict", "c_expected", "c_target_raw")


def missing_corrections(findings: DataFrame, corrections: DataFrame) -> DataFrame:
    return corrections.join(findings.select("finding_id"), "finding_id", "left_anti").select("finding_id")


def preview(findings: DataFrame, rule: ExpertRule) -> DataFrame:
    """(rule, matched, anomalies, remaining) of a rule, nothing being changed."""
    here = (F.col("target_field") == rule.field) & (F.col("verdict") == "ANOMALIE")
    n, all_ = F.count_if(condition(rule)), F.count_if(here)
    return findings.agg(n.alias("matched"), all_.alias("anomalies"), (all_ - n).alias("remaining")).select(F.lit(rule.id).alias("rule"), "matched", "anomalies", "remaining")


def suggestions(findings: DataFrame, corrections: DataFrame, rules: Sequence[ExpertRule], least: int = 2) -> DataFrame:
    """(target_field, operation, value, n): what at least `least` justifying corrections of a field share."""
    x = findings.join(corrections.where("new_verdict = 'JUSTIFIE'").select("finding_id"), "finding_id", "left_semi")
    hyp = x.select("target_field", F.lit("accept_hypothesis").alias("operation"), F.explode("hypotheses").alias("value"))
    sub = x.where("subcategory is not null").select("target_field", F.lit("accept_subcategory").alias("operation"), F.col("subcategory").alias("value"))
    out = hyp.unionByName(sub).groupBy("target_field", "operation", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    known = [(F.col("target_field") == r.field) & (F.col("operation") == r.operation) & (F.col("value") == next(iter(r.params.values()))) for r in rules if r.operation in ("accept_hypothesis", "accept_subcategory")]
    return out.where(~reduce(lambda p, q: p | q, known, F.lit(False)))


def status(rules: Sequence[ExpertRule], applied: DataFrame, corrections: DataFrame) -> DataFrame:
    """(entry, kind, state, n): how often each rule justified a finding (idle and inactive ones too), and how many
    corrections were applied, are stale or lack their finding. applied: what apply_rules and apply_corrections gave."""
    spark = applied.sparkSession
    listed = spark.createDataFrame([(r.id, "active" if r.active else "inactive") for r in rules], "entry string, state string")
    hits = applied.where("expert_rule is not null").groupBy(F.col("expert_rule").alias("entry")).agg(F.count(F.lit(1)).alias("n"))
    by_rule = listed.join(F.broadcast(hits), "entry", "left").select("entry", F.lit("rule").alias("kind"), "state", F.coalesce("n", F.lit(0)).alias("n"))  # at most a row a rule
    met = applied.where("correction is not null").groupBy(F.col("correction").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    gone = missing_corrections(applied, corrections).agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("state"), "n").where("n > 0")
    return by_rule.unionByName(met.unionByName(gone).select(F.lit("").alias("entry"), F.lit("correction").alias("kind"), "state", "n"))


def usable_columns(rows: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(col, usable): whether a column holds at least one readable value of the kind, so that a rule may name it. One pass,
    one row."""
    hit = rows.agg(*[F.coalesce(F.bool_or(K.KINDS[kind](F.col(c).cast("string")).isNotNull()), F.lit(False)).alias(f"c{i}") for i, c in enumerate(columns)])
    return hit.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"c{i}").alias("usable")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
