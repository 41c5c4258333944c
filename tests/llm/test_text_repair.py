import pytest
from pyspark.sql import functions as F

from concordat.llm import confusables as C
from concordat.llm import mojibake as M

NAMES = ["Délérçon", "Çelavegård", "Nuñônais", "FRÉÉRNEUF", "Lucía", "Zoë", "Søren", "João", "Ольга", "Νίκος", "Þórunn", "de la Brûuidal", "O'Kéranthière"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850")])
def test_round_trip(name, written, read):
    try:
        bad = name.encode(written).decode(read)
    except UnicodeError:
        return
    assert M.repair(bad) == (True, name)


def test_layers_and_single_bytes():
    deep = "Çelérçon"
    for _ in range(7):
        deep = deep.encode().decode("cp1252")
        assert M.repair(deep) == (True, "Çelérçon")
    assert M.repair("Hélène".encode("latin-1").decode("cp850"))[1] == "Hélène"
    assert M.repair("Gröénais".encode("latin-1").decode("cp437"))[1] == "Gröénais"
    assert M.repair("Stéphane".encode("mac_roman").decode("cp1252"))[1] == "Stéphane"


@pytest.mark.parametrize("name", [*NAMES, "ISTELÇÃO", "Ångêtier", "Jean-Luc", "明美", "지훈", "ליאור", "Светлана", "Sergе", "Ｒｏｓｅ", "", " ", "Élodie"])
def test_correct_names_are_no_cases(name):
    assert M.repair(name)[0] is False


def test_lost_characters_are_found_but_kept():
    assert M.repair("D�vilopré") == (True, "D�vilopré") and M.repair("M?rorrac") == (True, "M?rorrac") and M.repair("?")[0] is False


@pytest.mark.parametrize(
    ("text", "plain"),
    [("Ｒｏｓｅ\xad", "Rose"), ("Jérôme", "Jérôme"), (" François", "François"), ("Gеnеviève", "Geneviève"), ("Zоë–Αnaë", "Zoë-Anaë"), ("Нugo", "Hugo"), ("In⁠grid", "Ingrid"), ("ujolonnez839@temps.еxemple.invаlid", "ujolonnez839@temps.exemple.invalid"), ("Anne\xa0Marie", "Anne Marie"), ("Jean-Мах", "Jean-Max")],
)
def test_plain_form(text, plain):
    assert C.plain(text) == plain and C.plain(plain) == plain


@pytest.mark.parametrize("text", ["Ольга", "Νίκος", "明美", "지훈", "ליאור", "Élodie", "MARC", "O'Neil", "a.b@c.org", "漢字とカナ", ""])
def test_plain_names_stay(text):
    assert C.plain(text) == text


def test_columns(spark):
    rows = [(1, "DÃ©vel", None, "x"), (2, None, "Ｒｏｓｅ", "y"), (3, "", " ", None), (4, "Marc", "Marc", "z"), (5, "a" * 100_000 + "Ã©", "é" * 50_000, ""), (1, "DÃ©vel", None, "x")]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, value string")
    g = sorted((r["row_id"], r["fld"], r["restored"][-5:]) for r in M.find_garbled(df, "row_id", ["a", "b"]).collect())
    assert g == [(1, "a", "Dével"), (1, "a", "Dével"), (5, "a", "aaaaé")]
    v = sorted((r["row_id"], r["fld"], r["plain"]) for r in C.find_variants(df, "row_id", ["a", "b"]).where(F.length("value") < 99).collect())
    assert v == [(2, "b", "Rose")]
    empty = df.where("false")
    assert M.find_garbled(empty, "row_id", ["a"]).count() == 0 and C.find_variants(empty, "row_id", ["a"]).count() == 0
