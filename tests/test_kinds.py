from decimal import Decimal, InvalidOperation, localcontext

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concordat.functions import kinds as K


def values(spark, f, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_empty(spark):
    assert values(spark, K.is_empty, [None, "", "   ", "nan", "None", "NULL", "<NA>", "-", " ", "0", "False"]) == [True] * 9 + [False] * 2


def test_code(spark):
    got = values(spark, K.code, ["00397", "703.0", " 48 ", " JWN ", "jwn", "7.2", "000", "1E+2", "-007", None, "nan"])
    assert got == ["397", "703", "48", "JWN", "jwn", "7.2", "0", "100", "-7", None, None]


def test_number(spark):
    assert values(spark, K.number, ["40", "40.0", "7.2", "7,2", "abc", "True", "inf", "007,50", ".5", "1_000"]) == ["40", "40", "7.2", "7.2", None, None, None, "7.5", "0.5", "1000"]


def test_bool(spark):
    assert values(spark, K.boolean, ["Oui", "true", "TRUE", "1", "Vrai", "Non", "false", "0", "Faux", "peut-être", None]) == [True] * 5 + [False] * 4 + [None, None]


def test_date(spark):
    same = ["2003-12-12", "2003-12-12 10:11:12", "2003-12-12T00:00:00", "2003-12-12T00:00:00.000Z", "2003-12-12T00:00:00+02:00", "2003/12/12", "12/12/2003", "2003-12-12Z"]
    assert values(spark, lambda c: K.canonical("date", c), same) == ["2003-12-12"] * len(same)
    assert values(spark, lambda c: K.canonical("date", c), ["23604", "2003-02-30", "00/00/0000", "9999-99-99", None]) == [None] * 5
    assert values(spark, lambda c: K.unreadable("date", c), ["23604", "2003-02-30", "", None, "2003-01-01"]) == [True, True, False, False, False]


def test_serial(spark):
    f = lambda c: K.effective_date(c).cast("string")
    assert values(spark, f, ["23604", "44839", "44839.0", "0", "99999999", "abc", "2022-10-05"]) == ["1964-08-15", "2022-10-05", "2022-10-05", None, None, None, "2022-10-05"]
    assert values(spark, lambda c: K.serial_date(c).cast("string"), ["23604", "-5"]) == ["1964-08-15", None]


def test_text(spark):
    assert values(spark, K.text, ["complÃ¨te", "é", "é", "  a   b ", "Ã", None]) == ["complète", "é", "é", "a b", "Ã", None]
    assert values(spark, K.text_loose, ["ÉLODIE", "Straße", "élodie"]) == ["elodie", "strasse", "elodie"]


def test_zfill(spark):
    assert values(spark, lambda c: K.zfill(c, 4), ["7", "12345", None]) == ["0007", "12345", None]


@settings(max_examples=5, deadline=None)
@example([*["1"] * 14, "10000E14", ".0", "-.0", "+,50", ".", "0.", "-.5"])
@given(st.lists(st.text(alphabet="0123456789.,+- eE", max_size=8), min_size=20, max_size=60))
def test_number_against_decimal(spark, xs):
    def oracle(x):
        s = x.strip()
        if s.lower() in K.EMPTY_TOKENS:
            return None
        try:
            d = Decimal(s.replace(",", "."))
        except InvalidOperation:
            return None
        return d if d.is_finite() and -10 <= d.adjusted() <= 20 else "skip"

    def ten_places(d):
        with localcontext(prec=60):  # 21 digits and 10 places are more than the default context holds
            return round(d, 10)

    for x, got in zip(xs, values(spark, K.number, xs)):
        want = oracle(x)
        if want == "skip" or ("e" in x.lower() and want is not None and want != ten_places(want)):
            continue
        assert (got is None) == (want is None) and (got is None or Decimal(got) == want), x
