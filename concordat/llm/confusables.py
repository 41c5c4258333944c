"""Text that looks alike but differs in its characters, brought to one consistent form.

For every token the resolved script sets of its letters are intersected. An empty intersection means mixed scripts: the
script in which every letter has a spelling is selected and look-alike letters are respelled in it. A token of one
script whose letters all have look-alikes in the script of the rest of the value is a whole-script confusable and is
respelled too. What remains is normalised: width, composed accents, spaces, hyphens, invisible characters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter (composed forms follow from their base letters).
CYRILLIC = dict(zip("асеоруіѕјһԁԛԝӏкАВСЕНІЈКМОРЅТУХҺԌԚԜӀх", "aceopyisjhdqwlkABCEHIJKMOPSTYXhGQWIx"))
GREEK = dict(zip("αινορυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aivopuABEZHIKMNOPTYX"))
ARMENIAN = dict(zip("օսհոցյՕՍԼ", "ouhngjOUL"))
SCRIPTS = ["Latin", "Cyrillic", "Greek", "Armenian", "Hebrew", "Arabic", "Han", "Hiragana", "Katakana", "Hangul", "Thai", "Devanagari"]
# Scripts that are written together.
TOGETHER = [{"Han", "Hiragana", "Katakana"}, {"Han", "Hangul"}]
# Dashes used in place of a hyphen.
HYPHENS = "‐‑‒–—―−﹘﹣－"
_TO_LATIN = CYRILLIC | GREEK | ARMENIAN
_FROM_LATIN: dict[str, dict[str, str]] = {}
for _script, _table in (("Cyrillic", CYRILLIC), ("Greek", GREEK), ("Armenian", ARMENIAN)):
    _FROM_LATIN[_script] = {v: k for k, v in _table.items()}

_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}᠎]")
_SPACES = regex.compile(r"[\p{Zs}\t\n\r\x0b\x0c\x85  ]")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")


@lru_cache(maxsize=8192)
def script_set(ch: str) -> frozenset[str] | None:
    """Scripts a letter belongs to, with those written together; None when any script may use it."""
    if regex.match(r"[\p{scx=Common}\p{scx=Inherited}]", ch):
        return None
    found = {s for s in SCRIPTS if regex.match(rf"\p{{scx={s}}}", ch)} or {unicodedata.name(ch, "?").split(" ")[0]}
    for group in TOGETHER:
        if found & group:
            found = found | group
    return frozenset(found)


def resolved(token: str) -> frozenset[str] | None:
    """Intersection of the script sets; empty for mixed tokens, None when nothing restricts it."""
    out: frozenset[str] | None = None
    for ch in token:
        s = script_set(ch)
        if s is not None:
            out = s if out is None else out & s
    return out


def _letter(ch: str, script: str) -> str | None:
    """The letter, or its look-alike, in a script; None without one."""
    s = script_set(ch)
    if s is None or script in s:
        return ch
    return _TO_LATIN.get(ch) if script == "Latin" else _FROM_LATIN.get(script, {}).get(_TO_LATIN.get(ch, ch))


def respell(token: str, script: str) -> str | None:
    parts = [_letter(ch, script) for ch in unicodedata.normalize("NFD", token)]
    return None if None in parts else unicodedata.normalize("NFC", "".join(parts))


@lru_cache(maxsize=65536)
def plain(text: str) -> str:
    """The one consistent form of a text. Applying it twice changes nothing more."""
    t = _INVISIBLE.sub("", text)
    t = _SPACES.sub(" ", t)
    t = unicodedata.normalize("NFKC", t)
    t = re.sub(f"[{HYPHENS}]", "-", t)
    t = re.sub(" +", " ", t).strip(" ")
    tokens = _TOKEN.findall(t)
    votes: dict[str, int] = {}
    for token in tokens:
        for ch in token:
            for s in script_set(ch) or ():
                votes[s] = votes.get(s, 0) + 1 + 9 * (ch not in _TO_LATIN)
    if len(votes) < 2:
        return t
    by_votes = sorted(votes, key=lambda s: (-votes[s], s))
    main = by_votes[0]

    def one(m: regex.Match) -> str:
        token = m[0]
        own = resolved(token)
        if own is None or main in own:
            return token
        if not own:  # mixed
            for script in by_votes:
                again = respell(token, script)
                if again is not None:
                    return again
            return token
        again = respell(token, main)  # one script, but not that of the rest
        return token if again is None else again

    return _TOKEN.sub(one, t)


def plain_form(c: Column) -> Column:
    """Plain form of a text column; NULL stays NULL."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or (t.isascii() and t == t.strip()) else plain(t))

    return run(c)


def find_variants(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(row_id, fld, value, plain) of the values that differ from their plain form; blank values don't count.

    Only values with a character outside ASCII, or with outer or repeated spaces, reach Python.
    """
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("fld"), F.col(c).alias("value")) for c in columns]))
    rows = df.select(F.col(id_column).alias("row_id"), values.alias("v")).select("row_id", "v.fld", "v.value")
    rows = rows.where(F.col("value").rlike(r"[^\x00-\x7F]|^\s|\s$|\s\s") & (F.trim("value") != ""))
    return rows.withColumn("plain", plain_form(F.col("value"))).where("plain <> value and plain <> ''")
