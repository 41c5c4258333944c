"""Sentence units of documents in any script: candidate boundaries, classified by maximum entropy.

Layout is settled first: a blank line ends a unit, list items are units, other line breaks are white space. Within a
block every terminator outside brackets and quotation marks is a candidate, as is the end of a quotation that ends in
one, and in Thai every space between letters. A maximum-entropy classifier (logistic regression over hashed features:
neighbouring tokens, their case, length, digits and script, the terminator, the gap) decides on each candidate.

It is trained without annotation on boundaries that are reliable: block ends, terminators before a lower-case word,
tokens that occur often before a terminator but never end a block (abbreviations, initials, ordinals), and
terminators between a token that does end blocks and one that does begin them.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents, and characters of them, the classifier is fitted on at most, taken by hash of their id; every document is
#: segmented.
TRAIN_DOCS, TRAIN_CHARS = 4000, 16_000_000
#: Weights of the classifier; features are hashed into them.
DIMENSIONS = 1 << 16
#: A token seen so often before a terminator, and never at a block's end, doesn't end sentences: short tokens, others.
OFTEN, OFTEN_LONG = 6, 40

_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+|\r\n[^\S\n]*\r\n\s*| ")
_MARKER = re.compile(r"[^\S\n]*(?:(?P<bullet>[-•*–—‣▪·])|\(?(?P<num>\d{1,3})[.)]|\(?(?P<let>[a-zа-яα-ω])[.)])[^\S\n]+(?=\S)", re.I)
# Sentence terminators (the semicolon ends questions in Greek only), and paired marks.
TERMINATORS = ".!?…。！？؟।॥｡．"
_TERM = re.compile(rf"[{re.escape(TERMINATORS)};;]+(?:[   ]?[!?…]+)*")
_TERM_END = re.compile(rf"[{re.escape(TERMINATORS)}][\s]*$")
PAIRS = {"«": "»", "“": "”", "„": "“”", "(": ")", "[": "]", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "【": "】", "‹": "›", '"': '"'}
_MARKS = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values())) + "]")
_OPENERS = "—–«“„\"'([「『《〈（【‹¿¡   "
_THAI_GAP = re.compile(r"(?<=[ก-๛”\"»])\s+(?=[ก-๛“\"«])")
_THAI = re.compile("[ก-๛]")
_SPLIT = re.compile(r"[\s฀-๿⺀-⿿぀-\ufaff\U00020000-\U0003ffff]")
_WORD = re.compile(r"[\w][\w'’\-]*")
_LINKED = re.compile(r"@|://|www\.")
_GLUED = regex.compile(r"\p{Ll}{3,}[.!?…](?=\p{Lu})")
_CLOSE_AFTER = "»”\"'’)]」』》〉）】›"


@lru_cache(maxsize=4096)
def _script(ch: str) -> str:
    n = ord(ch)
    if n < 0x250:
        return "L" if ch.isalpha() else "N" if ch.isdigit() else "P"
    for hi, name in ((0x370, "P"), (0x400, "G"), (0x530, "C"), (0x590, "A"), (0x600, "H"), (0x780, "R"), (0x900, "O"), (0x980, "D"), (0xE00, "I"), (0xE80, "T"), (0x2E80, "P")):
        if n < hi:
            return name
    return "K" if n < 0x3000 or 0x3040 <= n < 0xFB00 or n >= 0x20000 else "P"


@lru_cache(maxsize=1 << 16)
def _shape(token: str) -> str:
    """Lower case but for single letters; digits become their pattern."""
    if len(token) == 1 and token.isalpha():
        return token
    return re.sub(r"\d{5,}", "00000", re.sub(r"\d", "0", token.lower()))[:SHAPE]


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is a list item) of the parts no unit crosses."""
    out, at = [], 0
    spans = []
    for m in _BLANK.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    for lo, hi in spans:
        if not text[lo:hi].strip():
            continue
        starts, before, in_list, prev_end = [lo], None, False, ""
        pos = lo
        first = True
        items: set[int] = set()
        while pos < hi:
            end = text.find("\n", pos, hi)
            end = hi if end < 0 else end
            line = text[pos:end]
            m = _MARKER.match(line)
            if m:
                kind = "bullet" if m["bullet"] else "num" if m["num"] else "let"
                value = m[kind] if kind == "bullet" else int(m["num"]) if kind == "num" else ord(m["let"].lower())
                follows = in_list and before is not None and before[0] == kind and (kind == "bullet" or value == before[1] + 1)
                begins = (first or prev_end.endswith(":")) and (kind == "bullet" or value in (1, ord("a"), ord("α"), ord("а")))
                if follows or begins:
                    if pos != lo:
                        starts.append(pos)
                    items.add(pos)
                    in_list, before = True, (kind, value)
            if line.strip():
                first, prev_end = False, line.rstrip()
            pos = end + 1
        for s, e in zip(starts, [*starts[1:], hi]):
            out.append((s, e, s in items))
    return out


def _pairs(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Outermost matched pairs of marks in text[lo:hi]; marks without partner don't count."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text, lo, hi):
        ch, i = m[0], m.start()
        k = next((k for k in range(len(stack) - 1, -1, -1) if ch in PAIRS[stack[k][0]]), None)
        if k is not None and not (ch == "“" and stack[k][0] != "„"):
            found.append((stack[k][1], i))
            del stack[k:]
        elif ch in PAIRS:
            stack.append((ch, i))
    found.sort()
    outer: list[tuple[int, int]] = []
    for o, c in found:
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    return outer


@dataclass(slots=True)
class Candidate:
    at: int  # the unit would end here
    prev: str
    term: str
    gap: str
    next: str
    next_case: str
    quote: str
    prev_script: str
    next_script: str


#: Characters of a token beside a candidate that its features see, at most; boundaries themselves are found in whole texts.
SEEN, SHAPE = 40, 24


def _next(text: str, at: int, hi: int) -> tuple[str, str, str]:
    """(token, case, script) after a position."""
    i = at
    while i < hi and (text[i].isspace() or text[i] in _OPENERS):
        i += 1
    if i >= hi:
        return "", "-", "-"
    ch = text[i]
    s = _script(ch)
    if s in "KT":
        return text[i : i + (2 if s == "K" else 4)], "c", s
    m = _WORD.match(text, i, min(hi, i + SEEN))
    if not m:
        return ch, "s", "P"
    w = m[0]
    case = "d" if ch.isdigit() else "U" if ch.isupper() else ("x" if any(c.isupper() for c in w[1:]) else "l") if ch.islower() else "c"
    return w, case, s


def _prev(text: str, end: int, lo: int) -> tuple[str, str]:
    i = end
    while i > lo and text[i - 1].isspace():
        i -= 1
    if i <= lo:
        return "", "-"
    ch = text[i - 1]
    s = _script(ch)
    if s in "KT":
        return text[max(lo, i - (2 if s == "K" else 4)) : i], s
    token = _SPLIT.split(text[max(lo, i - SEEN) : i])[-1].lstrip("«“„\"'([¿¡（「")
    glued = _GLUED.search(token)  # a sentence that began without a space
    return (token[glued.end() :] if glued else token), s


def candidates(text: str, lo: int, hi: int) -> list[Candidate]:
    """Candidate boundaries strictly inside text[lo:hi], and the block's end as the last one."""
    outer = _pairs(text, lo, hi)
    openers = {o for o, _ in outer}
    out: list[Candidate] = []
    seen: set[int] = set()

    def inside(i: int) -> bool:
        return bool(outer) and _inside(outer, i)

    def add(at: int, term_start: int, term: str, quote: str) -> None:
        if at in seen or at > hi:
            return
        seen.add(at)
        word = at
        while word < hi and text[word].isspace():
            word += 1
        gap = "end" if word >= hi else "none" if word == at else "line" if text.find("\n", at, word) >= 0 else "space"
        nxt, case, ns = _next(text, word, hi)
        prev, ps = _prev(text, term_start, lo)
        if gap == "none":
            if term[0] in ".;" and (case not in "Uc" or _LINKED.search(prev) or "/" in prev):
                return
            if case == "s" or text[at] in ",;:،؛、，；：)":
                return
        out.append(Candidate(at, prev, term, gap, nxt, case, quote, ps, ns))

    for m in _TERM.finditer(text, lo, hi):
        i, term = m.start(), m[0]
        if inside(i):
            continue
        if term[0] in ";;":
            if term[0] == ";" and _prev(text, i, lo)[1] != "G":
                continue
        if term == "." and i + 1 < hi and text[i + 1].isdigit():
            continue
        at = m.end()
        while at < hi and text[at] in _CLOSE_AFTER and at not in openers:
            at += 1
        add(at, i, term[:3], "")
    for o, c in outer:
        inner = _TERM_END.search(text, o + 1, c)
        if inner and text[o] not in "([（【":
            before = text[lo:o].rstrip()
            kind = "begin" if not before or any(x.at >= len(before) + lo - 1 for x in out) or before[-1] in TERMINATORS else "colon" if before[-1] in ":：" else "mid"
            at = c + 1
            if _TERM.match(text, at, hi):
                continue
            add(at, inner.start(), "q" + text[inner.start()], kind)
    if _THAI.search(text, lo, hi):
        for m in _THAI_GAP.finditer(text, lo, hi):
            i = m.start()
            if not inside(i) and text[i - 1] not in TERMINATORS:
                add(i, i, "th", "quoted" if text[i - 1] in "”\"»" else "")
    out.sort(key=lambda x: x.at)
    return out


def _inside(outer: Sequence[tuple[int, int]], i: int) -> bool:
    k = bisect_left(outer, (i, 0)) - 1
    return k >= 0 and outer[k][0] < i < outer[k][1]


def _features(c: Candidate) -> list[int]:
    prev, nxt = _shape(c.prev), _shape(c.next)
    cased = "1" if c.prev[:1].isupper() else "0"
    digits = "d" if c.prev[-1:].isdigit() else "m" if any(ch.isdigit() for ch in c.prev) else "w"
    size = str(min(len(c.prev), 6))
    dot = "." if "." in c.prev else ""
    names = (
        f"p={prev}",
        f"n={nxt}",
        f"n4={nxt[:4]}",
        f"p3={prev[-3:]}",
        f"pn={prev}|{c.next_case}",
        f"t={c.term}|{c.next_case}|{c.next_script}",
        f"g={c.gap}|{c.term}",
        f"l={size}{cased}{digits}{dot}|{c.next_case}",
        f"l2={size}{cased}{digits}{dot}|{c.prev_script}",
        f"s={c.prev_script}{c.next_script}",
        f"q={c.quote}|{c.next_case}|{c.term}",
        f"q2={c.quote}|{nxt[:2] if c.next_script == 'K' else nxt}" if c.quote else "q2=",
        f"dn={digits}|{nxt}",
        f"lt={size}{dot}|{c.term}",
        "bias",
    )
    return [zlib.crc32(x.encode()) % DIMENSIONS for x in names]


def _labelled(texts: Sequence[str]) -> tuple[list[list[int]], list[int]]:
    """Features and labels of the reliable boundaries and non-boundaries of the texts."""
    ends: Counter[str] = Counter()
    begins: Counter[str] = Counter()
    before: Counter[str] = Counter()
    after: Counter[str] = Counter()
    inner: list[Candidate] = []
    final: list[tuple[Candidate, str, str, str]] = []
    for text in texts:
        parts = [b for b in blocks(text)]
        for k, (lo, hi, item) in enumerate(parts):
            if item:
                continue
            body = text[lo:hi]
            first = _next(text, lo, hi)
            cands = candidates(text, lo, hi)
            if cands or len(body) > 60:
                begins[_shape(first[0])] += 1
            thai = 0x0E00 <= ord(body.rstrip()[-1]) < 0x0E80
            if thai and len(body) > 30:
                ends[_shape(_prev(text, hi, lo)[0])] += 1
            for c in cands:
                if c.gap == "end":
                    ends[_shape(c.prev)] += 1
                    if k + 1 < len(parts) and not parts[k + 1][2]:
                        final.append((c, *_next(text, parts[k + 1][0], parts[k + 1][1])))
                else:
                    before[_shape(c.prev)] += 1
                    after[_shape(c.next)] += 1
                    inner.append(c)
    rows, labels = [], []
    for c, nxt, case, script in final:
        rows.append(_features(Candidate(c.at, c.prev, c.term, "space", nxt, case, c.quote, c.prev_script, script)))
        labels.append(1)
    for c in inner:
        p, n = _shape(c.prev), _shape(c.next)
        label = None
        if c.next_case == "l" or c.next_case == "s":
            label = 0
        elif c.term[0] in "。！？؟।॥｡!?" and not c.quote:
            label = 1
        elif before[p] >= (OFTEN if len(p) <= 4 else OFTEN_LONG) and not ends[p] and c.prev_script not in "K":
            label = 0
        elif after[n] >= OFTEN and not begins[n]:
            label = 0 if c.quote or c.term == "th" or c.prev[-1:].isdigit() else None
        elif ends[p] and begins[n]:
            label = 1
        if label is not None:
            rows.append(_features(c))
            labels.append(label)
    return rows, labels


def train(texts: Sequence[str], epochs: int = 6, rate: float = 0.3, decay: float = 1e-6) -> np.ndarray:
    """Weights of the classifier (fixed length). Texts without candidates give zero weights plus a prior for boundaries."""
    rows, labels = _labelled(texts)
    w = np.zeros(DIMENSIONS, np.float64)
    if not rows:
        w[zlib.crc32(b"bias") % DIMENSIONS] = 1.0
        return w.astype(np.float32)
    x, y = np.asarray(rows, np.int64), np.asarray(labels, np.float64)
    order = np.random.default_rng(7)
    power = np.full(DIMENSIONS, 1e-2)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(y)), max(1, len(y) // 256)):
            xs = x[part]
            g = 1 / (1 + np.exp(-np.clip(w[xs].sum(1), -30, 30))) - y[part]
            grad = np.zeros(DIMENSIONS)
            np.add.at(grad, xs.ravel(), np.repeat(g, xs.shape[1]))
            grad += decay * w * len(part)
            power += grad * grad
            w -= rate * grad / np.sqrt(power)
    return w.astype(np.float32)


#: Decisions remembered at once: a candidate's features repeat from document to document.
REMEMBERED = 1 << 17


def _ends(c: Candidate, weights: np.ndarray, known: dict) -> bool:
    key = (c.prev, c.term, c.gap, c.next, c.next_case, c.quote, c.prev_script, c.next_script)
    found = known.get(key)
    if found is None:
        if len(known) >= REMEMBERED:
            known.clear()
        found = known[key] = bool(weights[_features(c)].sum() > 0)
    return found


def segment(text: str | None, weights: np.ndarray, known: dict | None = None) -> list[tuple[int, int]]:
    """Units as (start, end) code point offsets; none for NULL, empty and blank texts."""
    if not text or not text.strip():
        return []
    known = {} if known is None else known
    out = []

    def keep(lo: int, hi: int) -> None:
        while lo < hi and (text[lo].isspace() or text[lo] in "﻿​"):
            lo += 1
        while hi > lo and (text[hi - 1].isspace() or text[hi - 1] in "﻿​"):
            hi -= 1
        if lo < hi:
            out.append((lo, hi))

    for lo, hi, item in blocks(text):
        at = lo
        if not item:
            for c in candidates(text, lo, hi):
                if c.gap != "end" and _ends(c, weights, known):
                    keep(at, c.at)
                    at = c.at
        keep(at, hi)
    return out


def fit(docs: DataFrame, id_column: str, text_column: str, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> np.ndarray:
    """Classifier of a corpus, from at most `train_docs` whole documents of together at most `train_chars` characters (or
    one), picked by hash of their id. No task sends more than about its share of them to the driver."""
    texts = docs.where(F.col(text_column).isNotNull()).select(F.xxhash64(F.col(id_column)).alias("h"), F.col(text_column).alias("t"))
    n = texts.count()
    share = int(min(1.0, (1.3 * train_docs + 200) / max(n, 1)) * (1 << 30))
    sample = texts.where((F.pmod(F.shiftrightunsigned("h", 20), F.lit(1 << 30)) < share) & (F.trim("t") != "")).orderBy("h", "t").limit(train_docs)
    taken, chars = [], 0
    for r in sample.toLocalIterator():
        if taken and chars + len(r["t"]) > train_chars:
            break
        taken.append(r["t"])
        chars += len(r["t"])
    return train(taken)


def sentence_units(docs: DataFrame, id_column: str, text_column: str, weights: np.ndarray | None = None) -> DataFrame:
    """(id, sent_start, sent_end) of every unit of every document."""
    w = fit(docs, id_column, text_column) if weights is None else weights

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for b in it:
            ids, starts, ends = [], [], []
            for i, t in zip(b["i"], b["t"]):
                for s, e in segment(t, w, known):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({"i": pd.Series(ids, dtype="int64"), "sent_start": pd.Series(starts, dtype="int64"), "sent_end": pd.Series(ends, dtype="int64")})

    rows = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t"))
    return rows.mapInPandas(run, "i long, sent_start long, sent_end long").withColumnRenamed("i", id_column)
