"""The whole reconciliation: pairs, verdicts, missing assignments, hypotheses, expert feedback, scores and the tables of a
run. `cli run`, the queries and the tests all go through `run`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat import config
from concordat.config import Mapping
from concordat.operators import feedback, hypotheses, privacy, report, verdicts
from concordat.operators.feedback import Store
from concordat.plans import reconciliation as R
from concordat.session import materialize, table
from concordat.sources import files

#: Files of a bundle: the table each holds, its file, the columns it must have and whether it may be missing.
BUNDLE: dict[str, dict[str, Any]] = {
    "rh_source": {"file": "Employe_Source_Anonymise_VF.xlsx", "columns": ["Matricule", "TypeAffectation", "CodePoste"]},
    "temps_target": {"file": "Employe_Destination_Anonymise_VF.xlsx", "columns": ["personId", "isPrimaryAssignment", "isTemporaryAssignment"]},
    "poste_detail": {"file": "détail_du_poste.xlsx", "columns": ["IdentifiantPoste", "CodeDirectionAffectée", "DateEffetAffectation"]},
    "motifs": {"file": "Motif de la situation d'emploi.xlsx", "columns": ["CodeCatégorieStatut", "CodeStatutSystèmeExterne", "CodeGestionAccès"]},
    "mapping": {"file": "Mapping.xlsx", "optional": True},
}
#: The report's table each holds as evidence: pair's own rows.
SOURCE, TARGET = "source", "target"


@dataclass(frozen=True)
class Run:
    """What a run gives; every table is written once and read from there."""

    mapping: Mapping
    pairs: DataFrame
    readings: DataFrame
    findings: DataFrame
    verified: DataFrame
    alternatives: DataFrame
    feedback: DataFrame | None = None
    integrity: DataFrame | None = None
    params: dict[str, Any] = field(default_factory=dict)

    def counts(self) -> dict[str, int]:
        return {r["verdict"]: r["n"] for r in verdicts.verdict_counts(self.findings).collect()}  # four rows

    def find(self, person_id: str, target_field: str) -> DataFrame:
        return self.findings.where((F.col("person_id") == person_id) & (F.col("target_field") == target_field))

    def candidates(self) -> DataFrame:
        return hypotheses.candidate_rules(self.alternatives, self.mapping)

    def sheets(self) -> dict[str, DataFrame]:
        """The tables of the report by name."""
        f = self.findings
        out = {
            "findings": f,
            "to_investigate": hypotheses.investigated(f),
            **{v.lower(): f.where(F.col("verdict") == v) for v in verdicts.VERDICTS},
            "counts": verdicts.verdict_counts(f),
            "by_field": verdicts.verdict_by_field(f),
            "pairs": self.pairs,
            "readings": verdicts.agreement(self.readings, self.mapping),
            "patterns": hypotheses.described(hypotheses.patterns(self.verified)),
            "pattern_findings": hypotheses.pattern_findings(self.verified),
            "candidate_rules": self.candidates(),
        }
        return out | {k: v for k, v in (("feedback", self.feedback), ("integrity", self.integrity)) if v is not None}


def pair_sheet(spark: SparkSession, d: R.Tables, matched: DataFrame, mapping: Mapping) -> DataFrame:
    """(person_id, assignment_key, method, score, source_type, target_type, l, r, poste, emploi_source, emploi_target) of all
    pairs and of rows without partner; report.pair_order puts them in order."""
    a = R.keyed(spark, d, "A", mapping, ["CodePoste", "CodeEmploi"]).withColumnsRenamed({"id": "l", "person_id": "pa", "assignment_type": "source_type", "assignment_key": "ka"})
    b = R.keyed(spark, d, "B", mapping, ["positionId"]).withColumnsRenamed({"id": "r", "person_id": "pb", "assignment_type": "target_type", "assignment_key": "kb"})
    j = matched.join(a, "l", "left").join(b, "r", "left")
    return j.select(F.coalesce("pa", "pb").alias("person_id"), F.coalesce("ka", "kb").alias("assignment_key"), "method", "score", "source_type", "target_type", "l", "r", F.col("CodePoste").alias("poste"), F.col("CodeEmploi").alias("emploi_source"), F.col("positionId").alias("emploi_target"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def run(spark: SparkSession, d: R.Tables, mapping: Mapping = R.MAPPING, store: Store | None = None, params: dict[str, Any] | None = None) -> Run:
    """The reconciliation of the tables of a folder, or of tables in hand.

    Matching first, each system's assignments without partner included; then a verdict for every field of every pair and
    every reading; hypotheses over all findings; the experts' rules and corrections; priorities last, so that they follow
    the verdicts as they then stand. Causes never change a verdict.
    """
    h, d = mapping.hypotheses, R.prepared(spark, d, mapping)
    matched = R.matched(spark, d, mapping)
    pairs, columns = R.with_origins(spark, d, R.pairs_for(spark, d, mapping.fields, all_columns=True, pairs=matched, mapping=mapping), mapping)
    pairs = materialize(pairs, "pairs")
    alone = materialize(R.unmatched(spark, d, matched, mapping), "alone")
    found = materialize(report.explained(verdicts.judge(pairs, mapping, verdicts.missing_findings(alone, mapping)), mapping), "findings")
    alternatives = materialize(hypotheses.alternative_sources(found, pairs, mapping, columns), "alternatives")
    rules = hypotheses.candidate_rules(alternatives, mapping)
    missing = found.where("rule = 'missing'").join(alone.where("r is null and assignment_type is not null").select("l", "assignment_type"), "l")
    verified = _union([
        hypotheses.systemic(found, h["systemic_share"], h["systemic_count"]),
        hypotheses.bijection(found, h["bijection_count"]),
        hypotheses.permutation(found),
        hypotheses.history_record(found, pairs, R.position_history(spark, d), "poste", "effective", "detail_id"),
        hypotheses.alternative_source(found, pairs, mapping, columns, rules),
        hypotheses.alternative_interpretation(found),
        hypotheses.type_absent(missing, R.side(spark, d, "B", True, mapping)),
    ])
    verified = materialize(verified, "verified")
    caused = hypotheses.attach(found, hypotheses.probable_cause(verified, h["precedence"]))
    status = None
    if store is not None:
        caused, status = judged(caused, pairs, columns, mapping, store)
    scored = report.told(hypotheses.prioritised(caused, mapping.scoring))
    return Run(mapping, pair_sheet(spark, d, matched, mapping), verdicts.readings(found), materialize(scored, "scored"), verified, alternatives, status, None, params or {})


def judged(found: DataFrame, pairs: DataFrame, columns: Sequence[str], mapping: Mapping, store: Store) -> tuple[DataFrame, DataFrame]:
    """found after the experts' rules, then their corrections, and the store's status."""
    spark = found.sparkSession
    named = sorted({r.params["column"] for r in store.rules if r.operation == "accept_alternative_source" and r.params["column"] in columns})
    empty = F.expr("cast(map() as map<string,string>)")
    if named:
        kinds = {f.target: f.kind for f in mapping.fields}
        side = pairs.select("l", "r", *[F.struct(*[F.col("a_" + c).cast("string").alias(f"c{i}") for i, c in enumerate(named)]).alias("_x")])
        found = found.join(side, ["l", "r"], "left")
        cells: Column | None = None
        for kind in sorted({kinds[r.field] for r in store.rules if r.operation == "accept_alternative_source" and r.field in kinds}):
            from concordat.functions import kinds as K

            m = F.map_from_arrays(F.array(*[F.lit(c) for c in named]), F.array(*[K.canonical(kind, F.col(f"_x.c{i}")) for i in range(len(named))]))
            cells = F.when(F.col("kind") == kind, m) if cells is None else cells.when(F.col("kind") == kind, m)
        found = found.withColumn("candidates", empty if cells is None else cells.otherwise(empty)).drop("_x")
    else:
        found = found.withColumn("candidates", empty)
    corrections = store.correction_rows(spark)
    done = feedback.apply_rules(found, store.rules)
    done = materialize(feedback.apply_corrections(done, corrections), "judged")
    return done.drop("candidates"), materialize(feedback.status(store.rules, done, corrections), "status")


def bundle_tables(spark: SparkSession, folder: str | Path, strict_manifest: bool = False) -> dict[str, DataFrame]:
    """The tables of a folder of XLSX or CSV files, rows named by their line."""
    if strict_manifest:
        wrong = files.manifest_status(spark, folder).where("status in ('DIFFERENT', 'ABSENT')").orderBy("name").collect()
        if wrong:
            raise ValueError("\n".join(f"{r['name']}: {r['status']} by the manifest" for r in wrong))
    t = files.load_bundle(spark, folder, BUNDLE)
    named = {"poste_detail": "detail_id"}
    return {k: v.withColumnRenamed("_row", named.get(k, "row_id")).withColumn(named.get(k, "row_id"), F.col(named.get(k, "row_id")).cast("long")) for k, v in t.items()}


def run_bundle(spark: SparkSession, folder: str | Path, mapping: Mapping = R.MAPPING, choices: dict[str, str] | None = None, feedback_path: str | Path | None = None, strict_manifest: bool = False) -> Run:
    """A run over a folder of files: what is missing in files or columns is reported together, and the files are hashed
    before and after to show that they weren't touched."""
    before = materialize(files.digests(spark, folder), "digests")
    tables = {k: materialize(v, k) for k, v in bundle_tables(spark, folder, strict_manifest).items()}
    problems = config.against_data(mapping, tables["rh_source"].columns, tables["temps_target"].columns)
    if problems:
        raise ValueError("\n".join(problems))
    chosen = mapping.with_choices(choices or {})
    store = Store.load(feedback_path, [f.target for f in mapping.fields]) if feedback_path else None
    done = run(spark, tables, chosen, store, {"folder": str(folder), "mapping": mapping, "choices": dict(choices or {}), "feedback_path": feedback_path, "strict_manifest": strict_manifest})
    integrity = materialize(files.unchanged(before, files.digests(spark, folder)), "integrity")
    return Run(done.mapping, done.pairs, done.readings, done.findings, done.verified, done.alternatives, done.feedback, integrity, done.params)


def rerun(spark: SparkSession, before: Run, **changes: Any) -> Run:
    """The run again with other choices or another feedback file."""
    p = before.params | changes
    return run_bundle(spark, p["folder"], p["mapping"], p["choices"], p["feedback_path"], p["strict_manifest"])


def uncovered(spark: SparkSession, d: R.Tables) -> DataFrame:
    """(gap, code, n): reason codes in use that the lookup lacks, with their rows, and lookup codes that stand twice."""
    from concordat.functions import kinds as K

    used = table(spark, d, "rh_source").select(K.code(F.col("CodeRaisonStatut")).alias("code")).where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    look = table(spark, d, "motifs").select(K.code(F.col("CodeCatégorieStatut")).alias("code"))
    gaps = used.join(look, "code", "left_anti").select(F.lit("not in lookup").alias("gap"), "code", "n")
    return gaps.unionByName(look.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("twice in lookup").alias("gap"), "code", "n"))


def dossiers(r: Run, least_priority: float = 30.0) -> DataFrame:
    return privacy.dossiers(r.findings, least_priority)
