import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from concordat.operators import privacy
from concordat.sources import files

ROWS = [("007", "Élodie, M.", ""), ("8", "l'été", "x;y")]
NAMES = ["Code", "Libellé Long", "Autre"]


def xlsx(path, rows):
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v else ""
    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="F1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def write_csv(path, sep, encoding):
    q = lambda v: f'"{v}"' if sep in v or "," in v else v
    path.write_bytes("\n".join(sep.join(map(q, r)) for r in [NAMES, *ROWS]).encode(encoding))


WANT = [(2, "007", "Élodie, M.", None), (3, "8", "l'été", "x;y")]


@pytest.mark.parametrize(("sep", "encoding"), [(";", "utf-8-sig"), (",", "utf-8"), ("\t", "cp1252"), (";", "cp1252")])
def test_csv_variants(spark, tmp_path, sep, encoding):
    write_csv(tmp_path / "t.csv", sep, encoding)
    df = files.read_table(spark, tmp_path / "t.csv")
    assert df.columns == ["_row", *NAMES] and [tuple(r) for r in df.orderBy("_row").collect()] == WANT


def test_xlsx_and_packed(spark, tmp_path):
    xlsx(tmp_path / "t.xlsx", [NAMES, *ROWS])
    assert [tuple(r) for r in files.read_table(spark, tmp_path / "t.xlsx").orderBy("_row").collect()] == WANT
    xlsx(tmp_path / "p.xlsx", [["a,b ,c"], ["1,,x"], ['"y, z",2,']])
    p = files.read_table(spark, tmp_path / "p.xlsx")
    assert p.columns == ["_row", "a", "b", "c"] and [tuple(r) for r in p.orderBy("_row").collect()] == [(2, "1", None, "x"), (3, "y, z", "2", None)]


def test_bundle(spark, tmp_path):
    write_csv(tmp_path / "detail du poste.csv", ";", "utf-8")
    got = files.load_bundle(spark, tmp_path, {"t": {"file": "Détail_du_Poste.xlsx", "columns": ["Code"]}, "m": {"file": "rien.csv", "optional": True}})
    assert list(got) == ["t"] and got["t"].count() == 2
    with pytest.raises(ValueError) as e:
        files.load_bundle(spark, tmp_path, {"t": {"file": "Détail_du_Poste.xlsx", "columns": ["Nope"]}, "m": {"file": "rien.csv"}})
    assert "Nope" in str(e.value) and "rien.csv" in str(e.value)


def test_manifest_and_unchanged(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.csv").write_text(n)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    (tmp_path / "manifest.json").write_text(json.dumps({"files": [{"path": "a.csv", "sha256": sha("a")}, {"path": "b.csv", "sha256": sha("x")}, {"path": "d.csv", "sha256": sha("d")}]}))
    assert {tuple(r) for r in files.manifest_status(spark, tmp_path).collect()} == {("a.csv", "CONFORME"), ("b.csv", "DIFFERENT"), ("c.csv", "SANS"), ("d.csv", "ABSENT")}
    before = spark.createDataFrame(files.digests(spark, tmp_path).collect())
    (tmp_path / "a.csv").write_text("changed")
    (tmp_path / "b.csv").unlink()
    (tmp_path / "manifest.json").write_text("{")
    got = {tuple(r) for r in files.unchanged(before, files.digests(spark, tmp_path)).collect()}
    assert {("a.csv", "MODIFIE"), ("b.csv", "ABSENT"), ("c.csv", "INCHANGE")} <= got
    assert {r["status"] for r in files.manifest_status(spark, tmp_path).collect()} == {"SANS"}


def test_upload(tmp_path):
    assert files.stage_upload(tmp_path, "x.csv", b"1") == hashlib.sha256(b"1").hexdigest()
    for bad in ("../x.csv", ".x.csv", "x.exe"):
        with pytest.raises(ValueError):
            files.stage_upload(tmp_path, bad, b"")


def test_privacy(spark):
    docs = spark.createDataFrame([(1, "Écrire à a.b@c.org pour 40000001, X40000001 et 40000002; 岗位3045276"), (2, ""), (3, "rien")], "id int, text string")
    ids = spark.createDataFrame([("40000001",), ("40000002",), ("40000001",), (None,)], "k string")
    d = privacy.tokens(ids, "k")
    assert {tuple(r) for r in d.collect()} == {("40000001", "EMP-01"), ("40000002", "EMP-02")}
    p = privacy.pseudonymize(docs, "id", "text", d, "k")
    got = {r["id"]: r["text"] for r in p.collect()}
    assert got[1] == "Écrire à [COURRIEL] pour EMP-01, X40000001 et EMP-02; 岗位3045276" and got[2] == "" and got[3] == "rien"
    assert {r["id"]: r["text"] for r in privacy.restore(p, "id", "text", d, "k").collect()}[1] == "Écrire à [COURRIEL] pour 40000001, X40000001 et 40000002; 岗位3045276"
    x = spark.createDataFrame([("EMP-01 le 2020-01-02 : « oui » 45", "EMP-01 2020-01-02 oui"), ("EMP-02 2021-01-01 «\xa0non\xa0» 7", "EMP-01")], "a string, s string")
    assert [r[0] for r in x.select(privacy.ungrounded(F.col("a"), F.col("s"))).collect()] == [["45"], ["02", "2021-01-01", "EMP-02", "non"]]
    keys = spark.createDataFrame([(["a"], 0), (["b"], 0), (["z"], 0), (["a"], 2)], "k array<string>, n int")
    assert [r[0] for r in keys.select(privacy.flow_decision(F.col("k"), {"a": "public", "b": "secret"}, ["public"], F.col("n"), True)).collect()] == ["allow", "block: class", "block: unclassified", "block: leak"]


def test_encoding_follows_from_the_whole_file(spark, tmp_path):
    # the only accent lies far behind; lines are counted the same by one task and by many
    body = "Code;Autre\n" + "".join(f"{i};x\n" for i in range(20_000)) + "99;fin d'été €\n\n7;\n"
    for encoding in ("cp1252", "utf-8-sig"):
        (tmp_path / "late.csv").write_bytes(body.encode(encoding))
        whole, split = (files.read_csv(spark, tmp_path / "late.csv", lines) for lines in (False, True))
        got = sorted(map(tuple, whole.collect()))
        assert got == sorted(map(tuple, split.collect())) and got[-2:] == [(20_002, "99", "fin d'été €"), (20_003, "7", None)] and len(got) == 20_002


def test_all_sheets(spark, tmp_path):
    xlsx(tmp_path / "m.xlsx", [NAMES, *ROWS])
    got = files.read_sheets(spark, tmp_path / "m.xlsx")
    assert list(got) == ["F1"] and got["F1"].count() == 2
    with pytest.raises(ValueError, match="no sheet"):
        files.read_sheets(spark, tmp_path / "m.xlsx", ["F2"])


def test_secrets_of_several_words_are_replaced_and_restored(spark):
    people = spark.createDataFrame([("71",), ("70-A",), (None,), ("70-A",)], "person string")
    names = spark.createDataFrame([("70-A", "St-Onge"), ("70-A", "Marie-Ève"), ("71", "O'Neil"), ("71", "Li")], "person string, value string")
    d = privacy.secrets(people, {"NOM": names}, [spark.createDataFrame([("Chef, Gabriel",), ("St-Onge",), (None,), ("",)], "v string")])
    assert {tuple(r) for r in d.collect()} == {("70 A", "EMP-01"), ("71", "EMP-02"), ("St Onge", "NOM-EMP-01"), ("Marie Ève", "NOM-EMP-01"), ("O Neil", "NOM-EMP-02"), ("Chef Gabriel", "[MASQUE]")}
    texts = spark.createDataFrame([(1, "Marie-Ève St-Onge (70-A) a vu M. O'Neil et Chef  Gabriel; 171, 71."), (2, None), (3, ""), (4, "Étoile St-Ongeais, a.b@c.ca, 12345678")], "id int, t string")
    out = {r["id"]: r["t"] for r in privacy.pseudonymize(texts, "id", "t", d, "key").collect()}
    assert out == {1: "NOM-EMP-01 NOM-EMP-01 (EMP-01) a vu M. NOM-EMP-02 et [MASQUE]; 171, EMP-02.", 2: None, 3: "", 4: "Étoile St-Ongeais, [COURRIEL], [NUMERO]"}
    assert {tuple(r) for r in privacy.known_leaks(texts, "id", "t", d, "key").collect()} == {(1, 6)}
    back = spark.createDataFrame([(r"$1\x", "EMP-01"), ("Li", "NOM-EMP-01")], "key string, token string")
    told = spark.createDataFrame([(1, "EMP-01, NOM-EMP-01 et EMP-011")], "id int, t string")
    assert privacy.restore(told, "id", "t", back, "key").first()["t"] == r"$1\x, Li et EMP-011"
    assert privacy.pseudonymize(texts, "id", "t", d.where("false"), "key").where("id = 1").first()["t"].startswith("Marie-Ève")
    assert [privacy.provider_class(x) for x in (None, "http://localhost:8080/v1", "https://models.example.org")] == ["LOCAL", "LOCAL", "EXTERNE"]


def test_answers_are_checked(spark):
    good = '{"synthese": "La valeur 40 diffère du 2020-01-02.", "preuves": ["src:1"]}'
    rows = [(1, good), (2, "no"), (3, '{"synthese": "La valeur 40 diffère du reste.", "preuves": ["src:9"]}'), (4, good.replace("40", "41")), (5, '{"synthese": "court", "preuves": []}'), (6, good[:-1] + ', "autre": 1}'), (7, None), (8, good.replace('["src:1"]', '["src:1", "src:1"]')), (9, good.replace('["src:1"]', "7"))]
    context = spark.createDataFrame([(i, "expected 40 on 2020-01-02", ["src:1", "tgt:2"]) for i in range(1, 10)], "id int, payload string, evidence array<string>")
    got = {r["id"]: r["status"] for r in privacy.checked_answers(spark.createDataFrame(rows, "id int, answer string"), context, "id").collect()}
    assert got == {1: "OK", 2: "NOT_JSON", 3: "CITATION", 4: "UNGROUNDED", 5: "SCHEMA", 6: "SCHEMA", 7: "NOT_JSON", 8: "CITATION", 9: "SCHEMA"}
