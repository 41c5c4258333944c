import copy
import datetime as dt

import pytest
import yaml
from pyspark.sql import functions as F

from concordat import config
from concordat.operators import feedback, hypotheses, report, verdicts
from concordat.operators.feedback import Correction, ExpertRule, Store

RAW = yaml.safe_load(config.DEFAULT.read_text(encoding="utf-8"))
MAPPING = config.load()

COLUMNS = sorted({c for f in MAPPING.fields for c in f.sources} | {"CodeSuspensionAccès", "CodeStatutEmploi"})


def pair(spark, a=None, b=None, **more):
    """One matched pair; everything not given is as the mapping expects."""
    src = {
        "Matricule": "1000001", "PrénomUsuel": "Marc", "NomFamille": "Tremblay", "DateEmbaucheRécente": "2000-01-15", "LibelléSite": "Lieu 48", "CodeSite": "48", "CodeDirection": "348", "LibelléDirection": "Unité 348",
        "CodeImputation": "2950", "CodeEmploi": "6203", "IntituléEmploi": "Empl 6203", "CodeSuspensionAccès": "1", "CodeStatutEmploi": "1", "CodeRaisonStatut": "703", "DateRetourAnticipée": None, "CatégorieEmploi": "V",
        "TypeAffectation": "P", "DateEntréePoste": "2010-03-01", "ÉchelleSalariale": "223", "HeuresNormeHebdo": "40", "HeuresNormeQuotidienne": "8", "DateSortiePoste": None,
    }
    tgt = {
        "personId": "1000001", "givenName": "Marc", "surname": "Tremblay", "contactEmail": "mtremblay001@temps.exemple.invalid", "onboardDate": "2000-01-15T00:00:00.000Z", "siteName": "Lieu 48", "siteCode": "048", "divisionId": "348.0",
        "divisionName": "00348-Unité 348", "divisionCode": "2950", "positionId": "6203", "positionName": "6203-Empl 6203", "positionCode": "6203", "statusReasonCode": None, "expectedReturnDate": None, "detailedStatus": "Actif",
        "contractTypeCode": "PTP", "isPrimaryAssignment": "true", "isTemporaryAssignment": "0", "assignmentStartDate": "2010-03-01", "payGradeId": "223", "weeklyHoursOverride": "40,0", "dailyHoursOverride": "8", "assignmentEndDate": None, "termEndDate": "",
    }
    extra = {"unit_start": dt.date(2005, 1, 1), "unit_end": None, "history_note": None, "lookup_reason": None, "codes_disagree": "false", "CodeGestionAccès": None, "history_key": "11001"} | more
    row = {"person_id": "1000001", "assignment_key": "P:11001", "l": 1, "r": 2} | {"a_" + k: v for k, v in (src | (a or {})).items()} | {"b_" + k: v for k, v in (tgt | (b or {})).items()} | extra
    kinds = {"l": "long", "r": "long", "unit_start": "date", "unit_end": "date"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` {kinds.get(k, 'string')}" for k in row))


def run(spark, fields, a=None, b=None, choices=None, **more):
    m = MAPPING.with_choices(choices or {})
    m = config.Mapping(m.interpretations, tuple(f for f in m.fields if f.target in fields), m.tables, m.similarity, m.cross_type_least, m.missing_in_target, m.missing_in_source, m.hypotheses, m.scoring)
    return {r["target_field"]: r for r in verdicts.findings(verdicts.evaluate(pair(spark, a, b, **more), m)).collect()}


def test_clean_pair_has_no_anomaly(spark):
    got = run(spark, [f.target for f in MAPPING.fields])
    assert len(got) == 25 and {r["verdict"] for r in got.values()} <= {"CONFORME", "JUSTIFIE"}
    assert got["personId"]["verdict"] == "CONFORME" and got["assignmentEndDate"]["verdict"] == "CONFORME" and got["contactEmail"]["verdict"] == "JUSTIFIE"
    assert got["assignmentStartDate"]["confidence"] == "MOYENNE" and got["assignmentStartDate"]["alternatives"] == {"literal": "ANOMALIE"}


@pytest.mark.parametrize(
    ("field", "a", "b", "more", "verdict", "sub", "confidence"),
    [
        ("onboardDate", {}, {"onboardDate": "2003-02-30"}, {}, "INDETERMINE", None, "ELEVEE"),
        ("onboardDate", {"DateEmbaucheRécente": "n'importe"}, {}, {}, "INDETERMINE", None, "ELEVEE"),
        ("payGradeId", {"ÉchelleSalariale": "-"}, {"payGradeId": None}, {}, "CONFORME", None, "ELEVEE"),
        ("payGradeId", {"ÉchelleSalariale": "-"}, {}, {}, "ANOMALIE", None, "ELEVEE"),
        ("givenName", {"PrénomUsuel": "Élodie"}, {"givenName": "ELODIE"}, {}, "JUSTIFIE", "accents or case", "MOYENNE"),
        ("givenName", {"PrénomUsuel": "Élodie"}, {"givenName": "Ã‰lodie"}, {}, "CONFORME", None, "ELEVEE"),
        ("contactEmail", {}, {"contactEmail": "dev-1_Mtremblay001@temps.exemple.invalid"}, {}, "JUSTIFIE", "environment prefix", "MOYENNE"),
        ("contactEmail", {}, {"contactEmail": "Mtremblay001@temps.exemple.invalid"}, {}, "JUSTIFIE", "case", "MOYENNE"),
        ("contactEmail", {}, {"contactEmail": "mtremblay002@temps.exemple.invalid"}, {}, "ANOMALIE", "id doesn't match", "ELEVEE"),
        ("contactEmail", {}, {"contactEmail": "mtremblay001@ailleurs.invalid"}, {}, "ANOMALIE", "other domain", "ELEVEE"),
        ("contactEmail", {}, {"contactEmail": None}, {}, "ANOMALIE", "no address", "ELEVEE"),
        ("contactEmail", {"NomFamille": None}, {}, {}, "INDETERMINE", None, "ELEVEE"),
        ("divisionName", {}, {"divisionName": "00349-Unité 348"}, {}, "ANOMALIE", "code", "ELEVEE"),
        ("divisionName", {}, {"divisionName": "00348-Unité"}, {}, "ANOMALIE", "label", "ELEVEE"),
        ("detailedStatus", {"CodeSuspensionAccès": "4"}, {}, {}, "INDETERMINE", None, "MOYENNE"),
        ("statusReasonCode", {"CodeSuspensionAccès": "02", "CodeStatutEmploi": "2"}, {"statusReasonCode": "170"}, {"lookup_reason": "170", "CodeGestionAccès": "2"}, "JUSTIFIE", None, "ELEVEE"),
        ("statusReasonCode", {"CodeSuspensionAccès": "2", "CodeStatutEmploi": "2"}, {}, {"CodeGestionAccès": "2"}, "INDETERMINE", None, "ELEVEE"),
        ("expectedReturnDate", {"CodeSuspensionAccès": "2", "CodeStatutEmploi": "3", "DateRetourAnticipée": "2026-12-01"}, {"expectedReturnDate": "01/12/2026"}, {"CodeGestionAccès": "2"}, "JUSTIFIE", None, "ELEVEE"),
        ("contractTypeCode", {"CatégorieEmploi": "Y"}, {}, {}, "INDETERMINE", None, "ELEVEE"),
        ("isPrimaryAssignment", {"TypeAffectation": "s"}, {}, {}, "ANOMALIE", None, "ELEVEE"),
        ("isPrimaryAssignment", {"TypeAffectation": "?"}, {}, {}, "INDETERMINE", None, "ELEVEE"),
        ("assignmentEndDate", {}, {"assignmentEndDate": "2012-05-31"}, {"unit_end": dt.date(2012, 5, 31)}, "JUSTIFIE", None, "ELEVEE"),
        ("assignmentStartDate", {}, {"assignmentStartDate": "2010-03-01"}, {"unit_start": None, "history_note": "no history"}, "CONFORME", None, "MOYENNE"),
    ],
)
def test_rules(spark, field, a, b, more, verdict, sub, confidence):
    r = run(spark, [field], a, b, **more)[field]
    assert (r["verdict"], r["subcategory"]) == (verdict, sub)
    if r["verdict"] != "INDETERMINE":
        assert r["confidence"] in (confidence, "MOYENNE")


def test_choices(spark):
    assert run(spark, ["assignmentStartDate"], {}, {"assignmentStartDate": "2005-01-01"}, {"dates": "literal"})["assignmentStartDate"]["verdict"] == "JUSTIFIE"
    assert run(spark, ["divisionName"], {}, {"divisionName": "348-Unité 348"}, {"padding": "plain"})["divisionName"]["verdict"] == "JUSTIFIE"
    assert run(spark, ["givenName"], {}, {"givenName": "MARC"}, {"names": "strict"})["givenName"]["verdict"] == "ANOMALIE"
    for bad in ({"nowhere": "x"}, {"dates": "x"}):
        with pytest.raises(ValueError):
            MAPPING.with_choices(bad)


MUTATIONS = [
    lambda m: m.pop("fields"),
    lambda m: m["fields"].append(dict(m["fields"][0])),
    lambda m: m["fields"][0].update(kind="integer"),
    lambda m: m["fields"][0].update(rule="guess"),
    lambda m: m["fields"][0].update(criticality=6),
    lambda m: m["fields"][0].update(sources=[]),
    lambda m: m["fields"][1].update(interpretation="nothing"),
    lambda m: m["fields"][3].update(sources=["a"]),
    lambda m: m["fields"][8].update(params={"pad": 5}),
    lambda m: m["fields"][16].update(params={"table": "none"}),
    lambda m: m["tables"]["situation"][1].update(codes=[1]),
    lambda m: m["tables"]["situation"][0].update(reason="maybe"),
    lambda m: m["tables"]["contract"].append({"when": {"CatégorieEmploi": "V"}, "value": "X"}),
    lambda m: m["tables"]["contract"][0].pop("when"),
    lambda m: m["tables"]["flags"]["P"].pop("isPrimaryAssignment"),
    lambda m: m["interpretations"]["dates"].update(alternatives=["intersection"]),
    lambda m: m["interpretations"]["dates"].pop("choice"),
    lambda m: m["matching"].update(similarity=[]),
    lambda m: m["matching"].update(cross_type_least=2),
    lambda m: m["hypotheses"].update(precedence=["H-SYSTEMIC"]),
    lambda m: m["hypotheses"].update(systemic_share=0),
    lambda m: m["hypotheses"].update(bijection_count=0),
    lambda m: m["scoring"]["factor"].update({"H-OTHER": 1}),
    lambda m: m["scoring"]["confidence"].pop("FAIBLE"),
    lambda m: m["scoring"].update(scale=0),
    lambda m: m.update(extra={}),
]


@pytest.mark.parametrize("mutate", MUTATIONS)
def test_bad_mappings_are_refused(mutate):
    m = copy.deepcopy(RAW)
    mutate(m)
    with pytest.raises(config.ConfigError):
        config.build(m)


def test_mapping_against_data_and_documentation():
    assert config.against_data(MAPPING, COLUMNS, [f.target for f in MAPPING.fields]) == []
    assert len(config.against_data(MAPPING, COLUMNS[1:], [])) >= 26
    assert config.documentation(MAPPING).count("\n") == 27


# ---------------------------------------------------------------- hypotheses, scoring, feedback
SCHEMA = "finding_id string, l long, r long, target_field string, person_id string, assignment_key string, criticality int, expected string, target_raw string, target_norm string, verdict string, subcategory string, confidence string"


def frame(spark, rows):
    """rows: (id, field, person, expected, target)."""
    out = [(str(i), i, i, f, p, "k", 5, e, t, t, "CONFORME" if e == t else "ANOMALIE", "s" if e != t else None, "ELEVEE") for i, f, p, e, t in rows]
    return spark.createDataFrame(out, SCHEMA).withColumn("alternatives", F.expr("cast(map() as map<string,string>)"))


def test_swaps(spark):
    f = frame(spark, [(1, "f", "p1", "A", "B"), (2, "f", "p2", "B", "A"), (3, "f", "p3", "A", "B"), (4, "g", "p4", "A", "B"), (5, "g", "p4", "B", "A"), (6, "h", "p5", "A", "B"), (7, "i", "p6", "B", "A")])
    assert [(r["finding_a"], r["finding_b"]) for r in hypotheses.swaps(f).collect()] == [("1", "2")]


def test_swaps_go_on_past_pairs_of_one_person(spark):
    def found(rows):
        out = hypotheses.swaps(frame(spark, [(i, "f", *r) for i, r in enumerate(rows)])).collect()
        person = {str(i): r[0] for i, r in enumerate(rows)}
        assert all(person[x["finding_a"]] != person[x["finding_b"]] for x in out)
        used = [y for x in out for y in (x["finding_a"], x["finding_b"])]
        assert len(set(used)) == len(used)
        return len(out)

    assert found([("X", "A", "B"), ("Y", "A", "B"), ("X", "B", "A"), ("Z", "B", "A")]) == 2
    assert found([("X", "A", "B"), ("X", "B", "A")]) == 0
    assert found([("p", "A", "B")] + [("p", "B", "A")] * 40 + [("q", "B", "A")]) == 1
    assert found([("p", "A", "B")] * 5 + [("q", "A", "B")] * 5 + [("p", "B", "A")] * 5 + [("q", "B", "A")] * 5) == 10
    # nine tenths of all findings hold one value: the ranks come from many tasks
    assert found([(f"a{i}", "A", "B") for i in range(300)] + [(f"b{i}", "B", "A") for i in range(30)]) == 30


def test_ranks_over_all_tasks(spark):
    from concordat.operators.ranks import ranked

    rows = [("hot", i) for i in range(500)] + [(k, i) for k in ("a", "b", None, "z") for i in range(7)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    got = ranked(df, ["g"], ["v"])
    assert got.columns == ["g", "v", "k"] and all(r["k"] == r["v"] + 1 for r in got.collect()) and got.count() == len(rows)
    assert ranked(df.where("false"), ["g"], ["v"]).count() == 0


def test_systemic_and_bijection_thresholds(spark):
    rows = [(i, "f", f"p{i}", f"v{i % 3}", f"w{i % 3}") for i in range(8)] + [(20 + i, "g", f"p{i}", f"v{i}", f"w{i}") for i in range(8)] + [(40 + i, "h", f"p{i}", "v", f"w{i % 2}") for i in range(8)] + [(60 + i, "n", f"p{i}", "v", "w") for i in range(4)]
    f = frame(spark, rows)
    assert {r["target_field"] for r in hypotheses.systemic_fields(f, 0.8, 5).collect()} == {"f", "g", "h"}
    assert [tuple(r) for r in hypotheses.bijection_fields(f, 5).collect()] == [("f", 8)]


def test_score(spark):
    f = frame(spark, [(1, "f", "p", "A", "B"), (2, "f", "q", "A", "A"), (3, "f", "r", "B", "A")])
    v = hypotheses.permutation(f)
    x = {r["finding_id"]: r for r in hypotheses.score(f, hypotheses.probable_cause(v, MAPPING.hypotheses["precedence"]), MAPPING.scoring).collect()}
    assert (x["1"]["priority"], x["1"]["probable_cause"], x["2"]["priority"]) == (100.0, "H-PERMUTATION", None)


def test_feedback(spark, tmp_path):
    f = frame(spark, [(1, "f", "p", "A", "B"), (2, "f", "q", "A", "C"), (3, "f", "r", "A", "A")]).withColumn("hypotheses", F.array(F.lit("H-SYSTEMIC")))
    rule = ExpertRule("R-EXPERT-001", "accept_value_mapping", "f", {"mapping": {"A": "B"}}, "known")
    assert tuple(feedback.preview(f, rule).first()) == ("R-EXPERT-001", 1, 2, 1)
    done = {r["finding_id"]: r["verdict"] for r in feedback.apply_rules(f, [rule]).collect()}
    assert done == {"1": "JUSTIFIE", "2": "ANOMALIE", "3": "CONFORME"}
    c = spark.createDataFrame([("2", "JUSTIFIE", "A", "C"), ("1", "JUSTIFIE", "old", "B"), ("9", "ANOMALIE", None, None)], "finding_id string, new_verdict string, c_expected string, c_target_raw string")
    got = {r["finding_id"]: (r["verdict"], r["correction"]) for r in feedback.apply_corrections(f, c).collect()}
    assert got == {"1": ("ANOMALIE", "stale"), "2": ("JUSTIFIE", "applied"), "3": ("CONFORME", None)}
    assert [r[0] for r in feedback.missing_corrections(f, c).collect()] == ["9"]
    assert {(r["operation"], r["value"], r["n"]) for r in feedback.suggestions(f, c, []).collect()} == {("accept_hypothesis", "H-SYSTEMIC", 2), ("accept_subcategory", "s", 2)}
    store = Store().add_rule(rule, ["f"]).correct(Correction("2", "JUSTIFIE", "seen", "A", "C")).correct(Correction("2", "ANOMALIE", "seen again", "A", "C"))
    store.save(tmp_path / "f.yaml")
    again = Store.load(tmp_path / "f.yaml", ["f"])
    assert again == store and again.next_id() == "R-EXPERT-002" and not Store.load(tmp_path / "none.yaml", []).exists
    assert again.set_active("R-EXPERT-001", False).rules[0].active is False and again.remove_rule("R-EXPERT-001").rules == () and again.remove_correction("2").corrections == ()
    for call in (lambda: again.remove_rule("x"), lambda: again.remove_correction("x"), lambda: again.set_active("x", True), lambda: again.add_rule(rule, ["f"]), lambda: again.correct(Correction("2", "PERHAPS", "r", None, None))):
        with pytest.raises(ValueError):
            call()
    (tmp_path / "bad.yaml").write_text("version: 2\nrules: [{id: a, operation: accept_hypothesis, field: f, params: {hypothesis: H-NONE}, reason: r}, 7]\ncorrections: [{finding_id: x, verdict: CONFORME}]\nmore: 1\n")
    with pytest.raises(ValueError) as e:
        Store.load(tmp_path / "bad.yaml", ["f"])
    assert len(str(e.value).splitlines()) == 5
    applied = feedback.apply_corrections(feedback.apply_rules(f, [rule]), c)
    assert {tuple(r) for r in feedback.status([rule, ExpertRule("R-EXPERT-002", "accept_subcategory", "f", {"subcategory": "q"}, "r", active=False)], applied, c).collect()} == {("R-EXPERT-001", "rule", "active", 1), ("R-EXPERT-002", "rule", "inactive", 0), ("", "correction", "applied", 1), ("", "correction", "stale", 1), ("", "correction", "missing", 1)}
    for bad in (ExpertRule("x", "accept_value_mapping", "f", {"mapping": {}}, "r"), ExpertRule("", "accept_subcategory", "f", {"subcategory": "s"}, "r"), ExpertRule("x", "drop", "f", {}, "r"), ExpertRule("x", "accept_subcategory", "q", {"subcategory": "s"}, "r"), ExpertRule("x", "accept_subcategory", "f", {}, "r"), ExpertRule("x", "accept_subcategory", "f", {"subcategory": "s"}, " ")):
        with pytest.raises(ValueError):
            store.add_rule(bad, ["f"])


def test_mapping_texts_and_rules_from_sentences():
    assert feedback.parse_mapping("A => B\n\n# note\n 7=> 8 \n(vide) => X") == {"A": "B", "7": "8", "": "X"}
    for bad in ("A B", "A => B\nA => C"):
        with pytest.raises(ValueError):
            feedback.parse_mapping(bad)
    r = feedback.translate("accept unit where 3 => 4; 5 => 6 because agreed", "R-1", ["unit"], "me")
    assert (r.operation, r.params, r.reason, r.author) == ("accept_value_mapping", {"mapping": {"3": "4", "5": "6"}}, "agreed", "me")
    assert feedback.translate("accept unit from column Other Unit because it is so", "R-1", ["unit"]).params == {"column": "Other Unit"}
    assert feedback.translate("Accept unit under hypothesis H-SYSTEMIC because known", "R-1", ["unit"]).operation == "accept_hypothesis"
    for bad in ("please accept", "accept other with subcategory x because y", "accept unit under hypothesis H-X because y"):
        with pytest.raises(ValueError):
            feedback.translate(bad, "R-1", ["unit"])


def test_csv_export(spark, tmp_path):
    f = frame(spark, [(1, "f", "p", "A", "é;B"), (2, "f", "q", None, "C")]).withColumn("hypotheses", F.array(F.lit("H-SYSTEMIC"))).withColumn("priority", F.lit(1.0))
    raw = open(report.export_csv(f, tmp_path / "out.csv"), "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf")
    lines = raw.decode("utf-8-sig").splitlines()
    assert len(lines) == 3 and lines[0].startswith("finding_id;") and '"é;B"' in lines[1] and "H-SYSTEMIC*" in lines[1]
