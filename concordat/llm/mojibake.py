"""Text that was decoded with the wrong character encoding: found by round trips, restored where it can be.

A text is encoded again under the legacy encoding it may have been read with and strictly decoded as the encoding it may
have been written in; this is repeated for nested layers and accepted only when a garbling cost drops. The cost counts
what names don't hold: symbols inside words, control characters, several scripts or stray capitals in one word.
Text in which characters were replaced (by U+FFFD, or by `?` inside a word) is found but can't be restored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.confusables import _TO_LATIN

# Encodings a text may have been read with, and written in.
READ_WITH = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"]
WRITTEN_IN = ["utf-8", "cp1252", "cp850", "cp437", "mac_roman"]
#: A repair must lower the cost by this much; so layers are taken off until nothing does, however many there are.
LEAST_DROP = 1.5

_ORDINARY = set(" -'.,()/&")
# Accented letters of European names, the frequent ones first; each costs a little more than the one before.
FREQUENT = "éèçêôïñëüöåøãûîâíàùóáúäÉÈÇÊÔÏÑËÜÖÅØÃÛÎÂÍÀÙÓÁÚÄßŒœŠšŽž"
_WORD = re.compile(r"[^\s\-'’.,()/&]+")


@lru_cache(maxsize=8192)
def _kind(ch: str) -> tuple[float, str]:
    """Cost of a character and the script of a letter ('' for none)."""
    n = ord(ch)
    if ch in _ORDINARY:
        return 0.0, ""
    if n < 128:
        return (0.0, "LATIN") if ch.isalpha() else (0.2, "") if ch.isdigit() else (3.0 if n < 32 or n == 127 else 1.5, "")
    cat = unicodedata.category(ch)
    if ch == "’":
        return 0.9, ""
    if ch in FREQUENT:
        return 0.3 + 0.01 * FREQUENT.index(ch), "LATIN"
    if ch in _TO_LATIN:
        return 0.36, ""  # a look-alike letter is another fault than a wrong encoding
    if ch == "�":
        return 8.0, ""
    if cat == "Cc":
        return 4.0, ""
    if cat in ("Cf", "Zs", "Mn", "Mc"):
        return 1.0, ""
    if cat in ("Lu", "Ll", "Lo", "Lt"):
        if ch in "ªºﬁﬂƒⁿ":
            return 3.0, "LATIN"
        script = unicodedata.name(ch, "?").split(" ")[0]
        if script == "LATIN":
            return (1.0 if n < 0x180 else 1.2), script
        return (1.0 if n == 0xB5 else 0.35), script
    return 3.0, ""


@lru_cache(maxsize=65536)
def garbling_cost(text: str) -> float:
    cost = 0.0
    for word in _WORD.findall(text):
        kinds = [_kind(ch) for ch in word]
        cost += sum(k[0] for k in kinds)
        scripts = [k[1] for k in kinds if k[1]]
        cost += 2.0 * sum(a != b for a, b in zip(scripts, scripts[1:]))
        tail = [ch for ch in word if ch.isalpha()][1:]
        upper = sum(ch.isupper() for ch in tail)
        lower = sum(ch.islower() for ch in tail)
        cost += 2.0 * min(upper, lower) + 1.5 * sum(ch in "þÞðÐ" for ch in word[1:]) - 0.6 * (word[0] in "Þ")
        cost += 0.4 * (ord(word[0]) > 127 and word[0].islower())
        if len(tail) > 1 and not lower and word[0].islower():
            cost += 2.0
    return cost + sum(_kind(ch)[0] for ch in text if _WORD.match(ch) is None and ch not in _ORDINARY)


def _encode(text: str, encoding: str) -> bytes | None:
    """Bytes under the encoding; code points that Windows-1252 leaves undefined pass as themselves, as browsers do."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding != "cp1252":
            return None
    try:
        return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) < 0xA0 else c.encode("cp1252") for c in text)
    except UnicodeEncodeError:
        return None


def _one_layer(text: str) -> tuple[float, str]:
    best = (garbling_cost(text), text)
    for read in READ_WITH:
        raw = _encode(text, read)
        if raw is None:
            continue
        for written in WRITTEN_IN:
            if written == read or (written == "cp1252" and read == "latin-1"):
                continue
            try:
                again = raw.decode(written)
            except UnicodeDecodeError:
                continue
            if again != text and not any(unicodedata.category(c) == "Cc" for c in again if c not in text):
                best = min(best, (garbling_cost(again) - (written == "utf-8"), again))
            elif again != text and written == "utf-8":
                best = min(best, (garbling_cost(again) - 1, again))
    return best


_RUN = re.compile(r"[^\x00-\x7f]{2,}")


@lru_cache(maxsize=65536)
def repair(text: str) -> tuple[bool, str]:
    """(garbled, restored text). The text itself comes back where nothing can be restored."""
    now, cost = text, garbling_cost(text)
    while True:
        c, again = _one_layer(now)
        if c > cost - LEAST_DROP:
            # whole text can't be turned back: single runs may
            parts = _RUN.sub(lambda m: (lambda x: x[1] if x[0] <= garbling_cost(m[0]) - LEAST_DROP else m[0])(_one_layer(m[0])), now)
            c, again = garbling_cost(parts), parts
            if c > cost - LEAST_DROP:
                break
        now, cost = again, garbling_cost(again)
    lost = "�" in text or (re.search(r"\w\?|\?\w", text) is not None)
    return now != text or lost or re.search("[\x80-\x9f]", text) is not None, now


def _clean(text: str) -> bool:
    return text.isascii() and "?" not in text


def garbled(c: Column) -> Column:
    """struct(garbled, restored) of a text column; NULL and empty texts are not garbled."""

    @F.pandas_udf("struct<garbled:boolean,restored:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple[bool, str]] = {}
        out = [(False, t) if t is None or _clean(t) else known.get(t) or known.setdefault(t, repair(t)) for t in s]
        return pd.DataFrame(out, columns=["garbled", "restored"])

    return run(c)


def find_garbled(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(id, fld, value, restored) of each garbled value of the columns; all other columns are ignored.

    Only values that hold a character outside ASCII or a question mark reach Python, by whole Arrow batches.
    """
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("fld"), F.col(c).alias("value")) for c in columns]))
    rows = df.select(F.col(id_column).alias("row_id"), values.alias("v")).select("row_id", "v.fld", "v.value")
    rows = rows.where(F.col("value").rlike(r"[^\x00-\x7F]|\?"))
    return rows.withColumn("r", garbled(F.col("value"))).where("r.garbled").select("row_id", "fld", "value", "r.restored")
