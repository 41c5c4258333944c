"""The whole way from tables to findings, on small tables of its own."""

import pandas as pd
import pytest

from concordat import cli
from concordat.plans import reconciliation as R


def write(spark, sf, tmp_path, a, b):
    """Tables like sf's with the given cells, everything else empty. a, b: rows as dicts; row_id is the position."""
    for name, rows in (("rh_source", a), ("temps_target", b)):
        schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
        at = pd.Timestamp("2026-01-01")
        data = [tuple({"row_id": i + 1, "charge_le": at.to_pydatetime()}.get(c, row.get(c)) for c in schema.names) for i, row in enumerate(rows)]
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("poste_detail", "motifs"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture()
def tables(spark, sf, tmp_path):
    same = {"CodeEmploi": "1", "CodeDirection": "2", "CodeImputation": "3"}
    other = {"positionId": "1", "divisionId": "2", "divisionCode": "3"}
    a = [{"Matricule": "11", "TypeAffectation": "P", "CodePoste": "7"}, {"Matricule": "12", "TypeAffectation": "A", "CodePoste": "8", **same}, {"Matricule": "13", "TypeAffectation": "X", "CodePoste": "9"}]
    b = [{"personId": "11", "isPrimaryAssignment": "true", "isTemporaryAssignment": "false"}, {"personId": "12", "isPrimaryAssignment": "true", "isTemporaryAssignment": "false", **other}, {"personId": "14", "isPrimaryAssignment": "true", "isTemporaryAssignment": "false"}, {"personId": None, "isPrimaryAssignment": "true", "isTemporaryAssignment": "false"}]
    return write(spark, sf, tmp_path, a, b)


def test_assignments_of_one_system_and_across_types_are_found(spark, tables):
    found = R.whole_findings(spark, tables).collect()
    assert {(r["l"], r["r"]) for r in found if r["target_field"] == "divisionId"} == {(1, 1), (2, 2)}
    alone = {(r["l"], r["r"], r["finding_id"], r["verdict"], r["criticality"]) for r in found if r["target_field"] == "affectation"}
    assert alone == {(3, None, "13:X:9:affectation", "ANOMALIE", 5), (None, 3, "14:P:target-3:affectation", "ANOMALIE", 4), (None, 4, "P:target-4:affectation", "ANOMALIE", 4)}
    assert sum(r["n"] for r in R.verdict_counts_all(spark, tables).collect()) == 2 * 25 + 3


def test_run_reports_assignments_of_one_system(spark, tables, tmp_path):
    cli.run(spark, R.MAPPING, tables, str(tmp_path / "out"))
    rows = spark.read.parquet(str(next((tmp_path / "out").glob("findings*")))).where("target_field = 'affectation'").collect()
    assert len(rows) == 3 and all(r["priority"] is not None for r in rows)
    assert {r["source_raw"] for r in rows if r["l"]} == {"TypeAffectation=X, CodePoste=9"} and all(r["rule_id"] == "R-MATCH" and r["decision_source"] == "REGLE" for r in rows)
    written = (tmp_path / "out" / "verdicts.csv").read_text(encoding="utf-8-sig").splitlines()
    assert len(written) == 1 + 2 * 25 + 3 and len(written[0].split(";")) == 24
    assert [r["hypotheses"] for r in rows if r["l"] == 3] == [["H-TYPE-ABSENT"]]


def test_other_origins_of_any_column_are_attached(spark, sf, tmp_path):
    # the target's hiring date is the assignment's start, a date that the direct rule doesn't look at
    a = [{"Matricule": str(i), "TypeAffectation": "P", "DateEmbaucheRécente": "2001-01-01", "DateEntréePoste": f"2010-01-0{i}"} for i in range(1, 8)]
    b = [{"personId": str(i), "isPrimaryAssignment": "true", "isTemporaryAssignment": "false", "onboardDate": f"2010-01-0{i}"} for i in range(1, 8)]
    d = write(spark, sf, tmp_path, a, b)
    cli.run(spark, R.MAPPING, d, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out" / "findings")).where("target_field = 'onboardDate'").collect()
    assert len(rows) == 7 and all("H-ALT-SOURCE" in r["hypotheses"] for r in rows)
