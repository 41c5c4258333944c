import re

import numpy as np
import pytest

from concordat.llm import sentences as S
from concordat.session import table


@pytest.fixture(scope="module")
def weights(spark):
    return S.fit(table(spark, "/root/testdata/sf0.01", "documents"), "doc_id", "text")


CASES = [
    ["Bonjour,", "\n\n", "D'après M. K. E. Dorannais, le no 28.9 est clos, p. ex. au site 37 du guide.", " ", "Quel écart !", " ", "eTemps ne lit pas ce champ."],
    ["«\xa0Il est trop tard. Personne n'a répondu.\xa0», écrit Dr Ouvonmar.", "  ", "35 fiches restent ouvertes."],
    ["The board (Ms. Dorérel, Mr. Ångorcourt, etc.) meets on Feb. 10, 2021.", "\n", "The night shift\nends at 7 a.m.", " ", "iShift ignores this field."],
    ["Laut Auszug vom 24. Aug. 2021 bleibt der Eintrag Nr. 40 bis zum 13. Mai gesperrt, z. B. wegen der Vertretung.", " ", "Warum erscheint die Einheit 764 noch?"],
    ["8.9 Rapprochement du mois", "\n\n", "- Vérifier le poste 3", "\n", "- Comparer les unités 1 et 2.", "\n\n", "a) Un point", "\n", "b) Un autre ;"],
    ["负责人说：“档案已经关闭。”", "经核对，部门1217显示为37.73小时。", "谁修改了这条记录？"],
    ["担当者は「もう閉じました。」と答えました。", "差異は40件あり、たとえば39.82時間です。"],
    ["Ποιος άλλαξε την καρτέλα;", " ", "Βρέθηκαν 5 διαφορές, π.χ. 26,34 ώρες."],
    ["यह प्रविष्टि किसने बदली?", " ", "इकाई 463 दोनों प्रणालियों में सुधारी गई।"],
    ["من غيّر هذا السجل؟", " ", "وجدنا 48 فروق في الوحدة 1372."],
    ["ขณะนี้หน่วยงาน 911 แสดง 41.99 ชั่วโมงแทนค่าที่คาดไว้", " ", "ขณะนี้หน่วยงาน 1437 แก้ไขแล้วในทั้งสองระบบ"],
    ["«Кто изменил запись?» — спросил А. П. Зареллин.", " ", "Единица 184 показывает 44,07\nч. вместо 18,48 ч."],
]


@pytest.mark.parametrize("parts", CASES)
def test_units(weights, parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in S.segment(text, weights)] == [p for p in parts if p.strip()]


def test_edges(weights):
    for t in (None, "", "  \n 　 "):
        assert S.segment(t, weights) == []
    assert S.segment(" a ", weights) == [(1, 2)]
    long = "Le site 3 est clos. " * 20_000
    assert len(S.segment(long, weights)) == 20_000
    assert S.segment("((((« “ „ [", weights) == [(0, 11)]


def test_units_tile_the_text(spark, weights):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    for _, t in docs:
        units = S.segment(t, weights)
        assert all(b <= c for (_, b), (c, _) in zip(units, units[1:]))
        assert "".join(re.sub(r"\s", "", t[a:b]) for a, b in units) == re.sub(r"\s", "", t or "")
    df = spark.createDataFrame([*docs, (-1, None), (-2, "")], "doc_id long, text string").selectExpr("doc_id", "text", "'x' as sent_start")
    got = {(r[0], r[1], r[2]) for r in S.sentence_units(df, "doc_id", "text", weights).collect()}
    assert got == {(i, a, b) for i, t in docs for a, b in S.segment(t, weights)}


def test_held_out_reliable_boundaries(spark):
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").where("text is not null").orderBy("doc_id").select("text").collect()]
    w = S.train(texts[:700])
    rows, labels = S._labelled(texts[700:])
    right = np.mean([(w[r].sum() > 0) == bool(y) for r, y in zip(rows, labels)])
    assert right > 0.99
    assert S.train([]).sum() > 0
