"""Normalisers of the six scalar kinds, as Catalyst expressions.

Every normaliser keeps three states apart: a value, empty (NULL) and unreadable. ``<kind>(c)`` gives the canonical
value or NULL; ``unreadable(kind, c)`` is true for text that is neither empty nor readable. Canonical values are
strings, dates or booleans, so that different notations of one value are equal and hash alike.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "empty", "true" and "false" (compared in lower case, without outer blanks).
EMPTY_TOKENS = ["", "nan", "nat", "none", "null", "<na>", "n/a", "-"]
TRUE_TOKENS = ["oui", "o", "true", "vrai", "1", "y", "yes", "t"]
FALSE_TOKENS = ["non", "n", "false", "faux", "0", "no", "f"]
# Fixed value: day 0 of spreadsheet day numbers, and the first number that is no longer a date.
SERIAL_EPOCH = "1899-12-30"
SERIAL_END = 2958466

_CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]?\d:(?:[0-5]?\d|6[01])"
_ISO = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?: {_CLOCK}|T{_CLOCK}(?:\.\d{{1,6}})?(?:[+-]\d{{2}}:?\d{{2}})?)?Z?$"
_EXPONENT = r"^\s*[+-]?(\d+[.,]?\d*|[.,]\d+)[eE][+-]?\d{1,2}\s*$"
# Each normaliser below names its input once or twice, so that nested calls stay small and within one generated method.


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _found(c: Column, pattern: str) -> Column:
    """What group 1 of the pattern holds, NULL without a match."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(0))


def strip(c: Column) -> Column:
    """Without outer white space of any script (NBSP included)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def present(c: Column) -> Column:
    """Stripped text, NULL where empty."""
    tokens = "|".join(t for t in EMPTY_TOKENS if t)
    return _found(c, rf"(?Uis)^\s*(?!(?:{tokens})?\s*$)(\S(?:.*\S)?)")


def is_empty(c: Column) -> Column:
    return present(c).isNull()


def _integer(s: Column) -> Column:
    """Integers without plus sign, leading zeros and zero fraction; other text unchanged."""
    return F.regexp_replace(F.regexp_replace(s, r"^\+?(-?)0*(\d+?)(?:\.0*)?$", "$1$2"), "^-0$", "0")


def _plain_number(s: Column) -> Column:
    x = _integer(F.regexp_replace(F.regexp_replace(s, ",", "."), r"^\+?(-?)\.(?=\d)", "$10."))
    x = F.regexp_replace(x, r"^\+?(-?)0*(\d*\.\d*?)0*$", "$1$2")
    x = F.regexp_replace(x, r"^(-?)\.(?=\d)", "$10.")
    return _found(x, r"^(-?\d+(?:\.\d+)?)$")


def _exponent(c: Column) -> Column:
    return _plain_number(F.regexp_replace(present(c), ",", ".").try_cast("decimal(38,10)").cast("string"))


def number(c: Column) -> Column:
    """Canonical decimal text: 40, 40.0, 040 and 40,00 are all ``40``. No digit is lost, however long the number.

    Exponents are read through DECIMAL(38,10). Infinite values, booleans and other text are unreadable (NULL here).
    """
    return F.when(c.rlike("^[1-9][0-9]*$"), c).when(c.rlike(_EXPONENT), _exponent(c)).otherwise(_plain_number(F.regexp_replace(present(c), r"(?<=\d)_(?=\d)", "")))


def code(c: Column) -> Column:
    """Identifier: integers lose leading zeros and a zero fraction, anything else is cleaned text in its own case."""
    rare = F.when(c.rlike(_EXPONENT), F.coalesce(_found(_exponent(c), r"^(-?\d+)$"), present(c))).otherwise(_integer(clean_text(present(c))))
    padded = F.regexp_replace(c, r"^ *0*(\d+?)(?:\.0*)? *$", "$1")
    return F.when(c.rlike("^[1-9][0-9]*$"), c).when(c.rlike(r"^ *\d+(?:\.0*)? *$"), padded).otherwise(rare)


def boolean(c: Column) -> Column:
    t = F.lower(present(c))
    return F.when(t.isin(TRUE_TOKENS), F.lit(True)).when(t.isin(FALSE_TOKENS), F.lit(False))


def date(c: Column) -> Column:
    """Date of six notations; a time of day, a final Z and an offset are dropped. Impossible days are unreadable.

    Notations: Y-m-d, Y-m-d H:M:S, Y-m-dTH:M:S, Y-m-dTH:M:S.f, Y/m/d, d/m/Y.
    """
    s = F.regexp_replace(present(c), _ISO, "$1-$2-$3")
    s = F.regexp_replace(s, r"^(\d{4})/(\d{1,2})/(\d{1,2})Z?$", "$1-$2-$3")
    s = F.regexp_replace(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})Z?$", "$3-$2-$1")
    rare = _found(s, r"^(\d{4}-\d{1,2}-\d{1,2})$").try_cast("date")  # a cast, since failed parses would cost an exception each
    return _quick_date(c).otherwise(rare)


def _quick_date(c: Column, first: Column | None = None) -> Column:
    """The frequent notations, each by one pattern; `first` holds cases that go before."""
    part = lambda a, n: F.substring(c, a, n)
    iso = c.rlike(r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:00:00(?:\.0{1,6})?Z?)?$") & ~c.rlike("[T ](?:2[4-9]|[3-9])")
    x = F.when(iso, part(1, 10).try_cast("date")) if first is None else first.when(iso, part(1, 10).try_cast("date"))
    x = x.when(c.rlike(r"^\d\d/\d\d/\d{4}$"), F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)).try_cast("date"))
    return x.when(c.rlike(r"^\d{4}/\d\d/\d\d$"), F.replace(c, F.lit("/"), F.lit("-")).try_cast("date"))


def _serial(c: Column, pattern: str) -> Column:
    n = _found(present(c), pattern).try_cast("int")
    return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.when((n >= 1) & (n < SERIAL_END), n))


def serial_date(c: Column) -> Column:
    """Date of a spreadsheet day number in 1 .. SERIAL_END - 1; a fraction is a time of day and is dropped."""
    return _serial(c, r"^\+?(\d{1,9})(?:\.\d*)?$")


def effective_date(c: Column) -> Column:
    """Digits only (or with a zero fraction): a day number; anything else: a date."""
    day = lambda n: F.date_add(F.lit(SERIAL_EPOCH).cast("date"), n.try_cast("int"))
    number_first = F.when(c.rlike("^[1-9][0-9]{0,5}$"), day(c)).when(c.rlike(r"^[1-9][0-9]{0,5}\.0$"), day(F.substring_index(c, ".", 1)))
    return _quick_date(c, number_first).otherwise(F.coalesce(_serial(c, r"^(\d{1,9})(?:\.0+)?$"), date(c)))


# The 27 characters that Windows-1252 holds in 0x80-0x9F, with their bytes.
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = [0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E, 0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F]
# Marks of UTF-8 that was read as a Western single-byte encoding.
MARKERS = "Ã|Â|â€"


def repair_encoding(c: Column) -> Column:
    """UTF-8 read as Windows-1252 or Latin-1 is read again; kept only if fewer marks of the fault remain."""
    as_bytes = F.translate(c, CP1252_CHARS, "".join(map(chr, CP1252_BYTES)))

    def again(x: Column) -> Column:
        return F.try_validate_utf8(F.encode(x, "ISO-8859-1").cast("string"))

    latin = c.rlike("^[\\x00-\\x{FF}]*$")
    windows = as_bytes.rlike("^[\\x00-\\x{FF}]*$") & ~c.rlike("[\\x{80}-\\x{9F}]")
    first = F.when(windows, again(as_bytes))
    second = F.when(latin, again(c))
    marks = lambda x: F.regexp_count(x, F.lit(MARKERS))
    best = F.when(first.isNotNull() & (marks(first) < marks(c)), first).when(second.isNotNull() & (marks(second) < marks(c)), second)
    return F.when(c.rlike(MARKERS), F.coalesce(best, c)).otherwise(c)


# Latin letters with marks and their plain and composed forms, built from Python's Unicode tables.
def _pairs() -> tuple[dict[str, str], dict[str, str]]:
    import unicodedata

    plain, composed = {}, {}
    for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(n)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if base and base != ch:
            plain[ch] = base
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and unicodedata.normalize("NFC", d) == ch:
            composed[unicodedata.normalize("NFC", d[:-1]) + d[-1]] = ch
    return plain, composed


_PLAIN, _COMPOSED = _pairs()
_MARK = "[\\x{300}-\\x{36F}]"


def compose(c: Column) -> Column:
    """NFC of Latin text, inside the JVM: marks are folded onto the letter before them by a literal map.

    Rows without a combining mark cost one pattern test. Marks that have no composed form stay as they are.
    """
    table = F.from_json(F.lit(json.dumps(_COMPOSED)), "map<string,string>")  # folded to one literal

    def step(acc: Column, ch: Column) -> Column:
        joined = F.try_element_at(table, F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), ch))
        return F.when(joined.isNotNull(), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(ch)))

    folded = F.array_join(F.aggregate(F.split(c, ""), F.expr("cast(array() as array<string>)"), step), "")
    return F.when(c.rlike(_MARK), folded).otherwise(c)


def strip_accents(c: Column) -> Column:
    """Latin letters without accents; loose combining marks are dropped. ASCII rows cost one pattern test."""
    single = {k: v for k, v in _PLAIN.items() if len(v) == 1}
    out = F.translate(c, "".join(single), "".join(single.values()))
    for k, v in _PLAIN.items():
        if len(v) > 1 and ord(k) < 0x250:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.regexp_replace(out, _MARK, "")).otherwise(c)


def clean_text(c: Column) -> Column:
    """White space collapsed, outer white space removed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def text(c: Column) -> Column:
    """Repaired, composed and collapsed text; NULL where empty."""
    return let(let(c, repair_encoding), lambda x: present(clean_text(compose(x))))


def text_loose(c: Column) -> Column:
    """Text without accents and case."""
    return let(text(c), lambda x: F.replace(F.lower(strip_accents(x)), F.lit("ß"), F.lit("ss")))


KINDS: dict[str, Callable[[Column], Column]] = {"text": text, "text_loose": text_loose, "code": code, "number": number, "bool": boolean, "date": date}


def canonical(kind: str, c: Column) -> Column:
    """The canonical value of a kind as text (dates ISO, booleans true/false); NULL where empty or unreadable."""
    return KINDS[kind](c).cast("string")


def unreadable(kind: str, c: Column) -> Column:
    """Neither empty nor readable. Text and codes always read."""
    return F.lit(False) if kind in ("text", "text_loose", "code") else (~is_empty(c) & KINDS[kind](c).isNull())


def comparable(kind: str, c: Column) -> Column:
    """Canonical text; where unreadable, the cleaned text behind a mark, so that it equals only itself."""
    if kind in ("text", "text_loose", "code"):
        return canonical(kind, c)
    return F.coalesce(canonical(kind, c), F.concat(F.lit("?"), clean_text(present(c))))


def zfill(c: Column, n: int) -> Column:
    """Zeros on the left up to n characters; never cuts."""
    return F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, "0"))
