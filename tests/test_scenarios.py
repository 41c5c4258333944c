"""Twelve people, each with one case, through the whole pipeline, from XLSX-like and CSV files."""

import csv
import hashlib
import json
from copy import deepcopy

import pytest
import yaml
from pyspark.sql import functions as F

from concordat import cli, config
from concordat.operators import hypotheses, report
from concordat.operators.feedback import Correction, ExpertRule, Store
from concordat.plans import pipeline

DOMAIN = "temps.exemple.invalid"
NAMES = {1: ("Marc", "Tremblay"), 2: ("Julie", "Gagnon"), 3: ("Luc", "Roy"), 4: ("Anne", "Côté"), 5: ("Paul", "Bouchard"), 6: ("Sara", "Gauthier"), 7: ("Hugo", "Morin"), 8: ("Lise", "Lavoie"), 9: ("Éric", "Fortin"), 10: ("Nadia", "Pelletier"), 11: ("Yves", "Bélanger"), 12: ("Élodie", "Bérubé")}
PLAIN = str.maketrans("éèôÉ", "eeoE")


def hired(n, post, kind="P", **changed):
    row = {
        "Matricule": str(1000000 + n), "NomFamille": NAMES[n][1], "PrénomUsuel": NAMES[n][0], "DateEmbaucheRécente": "2000-01-15", "TypeAffectation": kind, "DateEntréePoste": "2010-03-01", "DateSortiePoste": "",
        "CodePoste": post, "IntituléPoste": "Poste" + post, "CodeEmploi": "6203", "IntituléEmploi": "Empl6203", "ÉchelleSalariale": "223", "LibelléÉchelleSalariale": "GrRemun223", "CodeImputation": "2950",
        "LibelléImputation": "Centre2950", "CodeDirection": "348", "LibelléDirection": "UnitAdmin00348", "CodeSite": "48", "LibelléSite": "Emplacement48", "CatégorieEmploi": "V", "EstPermanent": "Oui", "EstTempsPlein": "Oui",
        "CodeStatutEmploi": "1", "CodeRaisonStatut": "703", "LibelléRaisonStatut": "MotifSitua003", "DateEffetRaison": "2015-03-21", "DateRetourAnticipée": "", "CodeSuspensionAccès": "1", "IdentifiantResponsable": "9000001",
        "NomResponsable": "Chef, Gabriel", "CodeQuart": "23", "HeuresNormeHebdo": "40", "HeuresNormeQuotidienne": "8",
    }
    assert set(changed) <= set(row)
    return row | changed


A = [
    hired(1, "11001", CodeDirection="352", LibelléDirection="UnitAdmin00352"),
    hired(2, "11002", CodeSuspensionAccès="2", CodeStatutEmploi="2", CodeRaisonStatut="807", DateRetourAnticipée="2026-12-01"),
    hired(3, "11003"),
    hired(4, "11004", EstTempsPlein="Non"),
    hired(5, "11005"),
    hired(6, "11006", CodeSite="35", LibelléSite="Emplacement35"),
    hired(7, "11007", HeuresNormeHebdo="35", HeuresNormeQuotidienne="7"),
    hired(8, "11008"),
    hired(8, "11018", "A", DateEntréePoste="2025-09-22"),
    hired(9, "11009", CodeEmploi="6725", IntituléEmploi="Empl6725"),
    hired(9, "11019", "S", CodeEmploi="6754", IntituléEmploi="Empl6754", DateEntréePoste="2025-11-17"),
    hired(9, "11029", "S", CodeEmploi="6031", IntituléEmploi="Empl6031", DateEntréePoste="2024-02-12"),
    hired(10, "11010", DateEntréePoste="2008-01-01"),
    hired(11, "11011", CodeSuspensionAccès="4", CodeStatutEmploi="4"),
    hired(12, "11012", EstPermanent="Non"),
]
HISTORY = [("11001", "320", "2000-01-01"), ("11001", "352", "2005-01-01"), ("11010", "348", "2001-01-01"), ("11010", "348", "2015-06-01"), ("11009", "348", "1999-05-05"), ("11019", "348", "2002-12-14"), ("11029", "348", "1990-05-20")]
HISTORY += [(p, "348", "2003-06-18") for p in ("11002", "11003", "11004", "11005", "11006", "11007", "11008", "11018", "11011", "11012")]
REASONS = [("807", "170", "2"), ("811", "165", "3"), ("820", "125", "6"), ("572", "174", "1")]


def faultless(a):
    """What system B would hold if every rule were followed."""
    away = a["CodeSuspensionAccès"] in ("2", "3", "6", "7")
    first, last, n = a["PrénomUsuel"], a["NomFamille"], a["Matricule"]
    contract = {("V", "Oui", "Oui"): "JWN", ("V", "Oui", "Non"): "XFLR"}.get((a["CatégorieEmploi"], a["EstPermanent"], a["EstTempsPlein"]), "JWN")
    return {
        "personId": n, "givenName": first, "surname": last, "contactEmail": f"dev-08-v2_{(first[0] + last).translate(PLAIN).capitalize()}{n[-3:]}@{DOMAIN}", "activityStatus": "ACTIVE",
        "onboardDate": a["DateEmbaucheRécente"] + "T00:00:00.000Z", "statusReasonCode": "170" if away else "", "expectedReturnDate": a["DateRetourAnticipée"] if away else "", "contractTypeCode": contract,
        "detailedStatus": "Absence complète".encode().decode("cp1252") if away else "Actif", "siteId": a["CodeSite"], "siteCode": a["CodeSite"], "siteName": a["LibelléSite"], "divisionId": a["CodeDirection"],
        "divisionCode": a["CodeImputation"], "divisionName": f"{a['CodeDirection']:0>5}-{a['LibelléDirection']}", "positionId": a["CodeEmploi"], "positionCode": a["CodeEmploi"],
        "positionName": f"{a['CodeEmploi']:0>4}-{a['IntituléEmploi']}", "assignmentStartDate": a["DateEntréePoste"], "assignmentEndDate": "", "payGradeId": a["ÉchelleSalariale"],
        "isPrimaryAssignment": str(a["TypeAffectation"] == "P").lower(), "isTemporaryAssignment": str(a["TypeAffectation"] == "A").lower(), "termStartDate": a["DateEntréePoste"], "termEndDate": "",
        "weeklyHoursOverride": "40", "dailyHoursOverride": "8",
    }


def system_b():
    rows = {a["CodePoste"]: faultless(a) for a in A if a["CodePoste"] != "11018"}
    faults = [("11003", "contractTypeCode", "XFLR"), ("11004", "contractTypeCode", "JWN"), ("11005", "siteName", "Emplacement35"), ("11006", "siteName", "Emplacement48"), ("11005", "contactEmail", f"dev-08-v2_PBouchard999@{DOMAIN}"), ("11010", "assignmentStartDate", "2015-06-01"), ("11011", "detailedStatus", "Actif"), ("11012", "givenName", "Elodie")]
    for post, column, value in faults:
        rows[post][column] = value
    order = [p for p in rows if p not in ("11019", "11029")] + ["11029", "11019"]
    return [rows[p] for p in order]


@pytest.fixture(scope="module")
def mapping():
    raw = yaml.safe_load(config.DEFAULT.read_text(encoding="utf-8"))
    full = {"CatégorieEmploi": "V", "EstPermanent": True}
    raw["tables"]["contract"] = [{"when": full | {"EstTempsPlein": True}, "value": "JWN"}, {"when": full | {"EstTempsPlein": False}, "value": "XFLR"}, {"when": {"CatégorieEmploi": "O"}, "value": "WHX"}]
    next(f for f in raw["fields"] if f["target"] == "contractTypeCode")["sources"] = ["CatégorieEmploi", "EstPermanent", "EstTempsPlein"]
    return config.build(raw)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("bundle")

    def write(name, rows, sep, encoding):
        with open(d / name, "w", encoding=encoding, newline="") as f:
            w = csv.writer(f, delimiter=sep)
            w.writerow(list(rows[0]))
            w.writerows([list(r.values()) for r in rows])

    write("Employe_Source_Anonymise_VF.csv", A, ";", "utf-8-sig")
    write("Employe_Destination_Anonymise_VF.csv", system_b(), ",", "utf-8")
    detail = ["IdentifiantPoste", "IdentifiantEmploi", "CodeDirectionAffectée", "DateEffetAffectation", "CodeBudget", "IndicateurGestion", "CodePosteSecondaire", "MatriculeGestionnaire", "HeuresSemaineContrat", "HeuresJourContrat", "JoursTravailléesSemaine"]
    write("détail_du_poste.csv", [dict(zip(detail, [p, "6203", u, d_, "2950", "0", "78871", "", "40", "8", "5"])) for p, u, d_ in HISTORY], ",", "utf-8")
    write("Motif de la situation d'emploi.csv", [dict(zip(["CodeCatégorieStatut", "CodeStatutSystèmeExterne", "CodeGestionAccès"], r)) for r in REASONS], ";", "cp1252")
    entries = [{"path": p.name, "bytes": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in sorted(d.iterdir())]
    (d / "manifest.json").write_text(json.dumps({"files": entries}), encoding="utf-8")
    return d


@pytest.fixture(scope="module")
def done(spark, mapping, folder):
    return pipeline.run_bundle(spark, folder, mapping, strict_manifest=True)


@pytest.fixture(scope="module")
def rows(done):
    return {(r["person_id"], r["assignment_key"], r["target_field"]): r for r in done.findings.collect()}


def cases(rows, want):
    return {(int(p) - 1000000, f) for (p, _, f), r in rows.items() if want(r)}


def test_every_case_has_its_verdict(rows, done):
    assert len(rows) == 14 * 25 + 1
    assert cases(rows, lambda r: r["verdict"] == "ANOMALIE") == {(3, "contractTypeCode"), (4, "contractTypeCode"), (5, "siteName"), (6, "siteName"), (5, "contactEmail"), (7, "weeklyHoursOverride"), (7, "dailyHoursOverride"), (8, "affectation"), (10, "assignmentStartDate")}
    assert cases(rows, lambda r: r["verdict"] == "INDETERMINE") == {(11, "detailedStatus"), (11, "statusReasonCode"), (11, "expectedReturnDate"), (12, "contractTypeCode")}
    assert cases(rows, lambda r: r["verdict"] == "JUSTIFIE") >= {(2, "statusReasonCode"), (2, "detailedStatus"), (12, "givenName"), (1, "divisionName"), (1, "contractTypeCode")}
    assert done.counts()["ANOMALIE"] == 9 and done.counts()["INDETERMINE"] == 4


def test_every_case_has_its_causes(rows, done):
    by = lambda h: cases(rows, lambda r: h in r["hypotheses"])
    assert by("H-PERMUTATION") == {(3, "contractTypeCode"), (4, "contractTypeCode"), (5, "siteName"), (6, "siteName")}
    assert by("H-ALT-SOURCE") == {(7, "weeklyHoursOverride"), (7, "dailyHoursOverride")}
    assert by("H-HISTORY-RECORD") == {(10, "assignmentStartDate")} and by("H-TYPE-ABSENT") == {(8, "affectation")}
    assert cases(rows, lambda r: r["verdict"] in ("ANOMALIE", "INDETERMINE") and not r["hypotheses"]) == {(5, "contactEmail"), (11, "detailedStatus"), (11, "statusReasonCode"), (11, "expectedReturnDate"), (12, "contractTypeCode")}
    assert {(r["target_field"], r["col"].split(":")[-1]) for r in done.candidates().collect()} == {("weeklyHoursOverride", "HeuresSemaineContrat"), ("dailyHoursOverride", "HeuresJourContrat")}


def test_details(rows, done):
    one = rows[("1000001", "P:11001", "assignmentStartDate")]
    assert (one["verdict"], one["confidence"]) == ("CONFORME", "MOYENNE") and one["rule_params"]["alternative[literal]"].startswith("ANOMALIE")
    assert rows[("1000002", "P:11002", "statusReasonCode")]["expected"] == "170"
    assert "encoding repaired" in rows[("1000002", "P:11002", "detailedStatus")]["justification"]
    assert rows[("1000012", "P:11012", "givenName")]["subcategory"] == "accents or case"
    assert rows[("1000005", "P:11005", "contactEmail")]["subcategory"] == "id doesn't match" and rows[("1000003", "P:11003", "contactEmail")]["subcategory"] == "environment prefix"
    assert all(rows[("1000009", k, "positionId")]["verdict"] == "CONFORME" for k in ("P:11009", "S:11019", "S:11029"))
    assert rows[("1000003", "P:11003", "contractTypeCode")]["priority_breakdown"] == "100 x criticality 5/5 x confidence 1.00 x verdict 1.00 x H-PERMUTATION 1.20"
    assert [e["id"] for e in rows[("1000001", "P:11001", "siteCode")]["evidence"]] == ["sou:2", "tar:2"]
    assert report.problems(done.findings).count() == 0 and {r["status"] for r in done.integrity.collect()} == {"INCHANGE"}


def test_report(done, tmp_path):
    sheets = done.sheets()
    assert {"findings", "to_investigate", "pairs", "candidate_rules", "patterns", "integrity", "anomalie"} <= set(sheets) and sheets["pairs"].count() == 15
    first = sheets["pairs"].orderBy(*report.pair_order()).first()
    assert (first["person_id"], first["l"], first["r"], first["method"]) == ("1000001", 2, 2, "UNIQUE")
    lines = open(report.export_csv(done.findings, tmp_path / "v.csv"), encoding="utf-8-sig").read().splitlines()
    assert lines[0].split(";") == report.RECORD and len(lines) == 352
    worst = report.record(done.findings.orderBy(*hypotheses.report_order())).first()
    assert worst["priority"] == "100.0" and done.findings.select(report.label(done.findings)).where("target_field is not null").count() == 351
    assert report.selected(done.findings, ["ANOMALIE"], persons=["1000005"]).count() == 2 and done.find("1000010", "assignmentStartDate").count() == 1


def test_feedback_changes_verdicts_before_priorities(spark, mapping, folder, done, rows, tmp_path):
    fields = [f.target for f in mapping.fields]
    store = Store()
    for r in (
        ExpertRule("R-EXPERT-001", "accept_alternative_source", "weeklyHoursOverride", {"column": "poste_detail:HeuresSemaineContrat"}, "contract hours"),
        ExpertRule("R-EXPERT-002", "accept_hypothesis", "siteName", {"hypothesis": "H-PERMUTATION"}, "known swap"),
        ExpertRule("R-EXPERT-003", "accept_value_mapping", "contractTypeCode", {"mapping": {"A": "B"}}, "never met"),
    ):
        store = store.add_rule(r, fields)
    mail = rows[("1000005", "P:11005", "contactEmail")]
    store = store.correct(Correction.of(mail, "CONFORME", "checked by hand")).correct(Correction("gone", "CONFORME", "r", None, None))
    store.save(tmp_path / "f.yaml")
    again = pipeline.rerun(spark, done, feedback_path=tmp_path / "f.yaml")
    now = {(r["person_id"], r["target_field"]): r for r in again.findings.collect()}
    changed = {k for k, r in now.items() if r["decision_source"] == "EXPERT"}
    assert changed == {("1000007", "weeklyHoursOverride"), ("1000005", "siteName"), ("1000006", "siteName"), ("1000005", "contactEmail")} and all(now[k]["priority"] is None for k in changed)
    assert {(r["entry"], r["state"], r["n"]) for r in again.feedback.collect()} == {("R-EXPERT-001", "active", 1), ("R-EXPERT-002", "active", 2), ("R-EXPERT-003", "active", 0), ("", "applied", 1), ("", "missing", 1)}
    assert again.counts()["ANOMALIE"] == 5 and done.counts()["ANOMALIE"] == 9
    literal = pipeline.rerun(spark, done, choices={"dates": "literal"})
    assert literal.find("1000001", "assignmentStartDate").first()["verdict"] == "ANOMALIE"


def test_faulty_bundles_are_refused(spark, mapping, folder, tmp_path, capsys):
    with pytest.raises(ValueError) as e:
        pipeline.bundle_tables(spark, tmp_path)
    assert len(str(e.value).splitlines()) == 4
    wrong = deepcopy(json.loads((folder / "manifest.json").read_text()))
    for p in folder.iterdir():
        (tmp_path / p.name).write_bytes(p.read_bytes())
    wrong["files"][0]["sha256"] = "0" * 64
    (tmp_path / "manifest.json").write_text(json.dumps(wrong))
    with pytest.raises(ValueError, match="DIFFERENT"):
        pipeline.bundle_tables(spark, tmp_path, strict_manifest=True)
    assert cli._check(spark, mapping, str(tmp_path), True) == 0 and "DIFFERENT" in capsys.readouterr().out
    assert spark.range(1).select(F.lit(1)).count() == 1
