"""Sentence units in any script.

Sentence breaks follow the Sentence_Break property of Unicode's text segmentation (UAX 29), whose whole table comes from the
``regex`` package: terminators of all scripts (ATerm for full stops, STerm for the rest), closing marks (Close) that belong
to the sentence they follow, and the case of what comes next.
Full stops of abbreviations, initials, ordinals and decimals are suppressed by language-specific lists. Lines that are
units by themselves (headings, captions, list items, bibliography entries, lines of tables) are taken first.
"""

from __future__ import annotations

import re
import unicodedata

import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches

# Abbreviations that never end a sentence, and those that may where a capital follows (fixed values).
NEVER = frozenset(
    # English
    "dr mr mrs ms prof st vs cf e.g eg i.e ie viz fig figs tab sec secs eq eqs ch chap no nos vol vols p pp par para ca approx est ed eds rev gen hon gov sen rep dept univ "
    # German
    "abb bzw z.b zb d.h dh u.a ua s.o s.u vgl nr bd hrsg evtl ggf inkl sog z.t zt kap str jh "
    # French
    "m mm mme mmes mlle c.-à-d c-à-d p.ex env chap art éd t "
    # Spanish
    "sr sra srta dra d.ª ej p.ej pág págs núm aprox fig vid "
    # Russian
    "т.е те рис табл см стр гл г-н проф напр с "
    # Hindi, Arabic
    "डॉ श्री د".split()
)
MAYBE = frozenset("etc al usw a.m am p.m pm u.s us u.k ff f др т.д т.п тд тп пр jr inc ltd co corp u.s.a".split())
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember", "Jahrhundert")

INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿￹-￻"
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_ALNUM = re.compile(r"[^\W_]")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_OWN = re.compile(rf"[\s{INVISIBLE}]*(?:[#＃]{{1,6}}|[-*•‣◦▪]\s|[|｜])")
_FENCE = re.compile(r"\s*(?:```+|~~~+)\s*\w*\s*$")
_CAPTION = re.compile(r"(?:figures?|fig\.|tables?|abbildung|abb\.|tabelle|figura|tabla|cuadro|tableau|рис\.|рисунок|таблица|图|表|図|चित्र|शکل|جدول|ตาราง|ภาพ)\s*\d+(?:[.\-]\d+)*\s?[:：.]", re.I)
_ENTRY = re.compile(rf"(?:\[\d+\]\s*)?[^\W\d_][\w'’\-{INVISIBLE}]*,\s*[^\W\d_][{INVISIBLE}]?\.[^\n]*?[(（]\s?[12１２]\d\d\d[a-z]?\s?[)）]", re.S)
_EVERY = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x20000))))  # no mark of either kind lies beyond


def sentence_break(value: str) -> str:
    """All characters of a value of Unicode's Sentence_Break property."""
    return "".join(regex.findall(rf"\p{{Sentence_Break={value}}}", _EVERY))


STERM, ATERM, _CLOSE = sentence_break("STerm"), sentence_break("ATerm"), sentence_break("Close")
_TERMS = ATERM + STERM + "…"  # the ellipsis may end a sentence, though the property leaves it out
_ENDS = frozenset(_TERMS)
# closing marks; straight and high quotes stand on both sides
_CLOSING = "\"'”’“»" + "".join(c for c in _CLOSE if unicodedata.category(c) in ("Pe", "Pf"))
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _end_pattern(terms: str, closing: str) -> re.Pattern:
    return re.compile(rf"[{re.escape(terms)}]+(?:[{INVISIBLE}]*(?:[{re.escape(closing)}]|[ \xa0\u2009\u202f]»))*(?:[{INVISIBLE}]+(?=\s|$))?")


# marks beyond the basic plane are tried one by one at each character, so texts without such characters have a pattern without them
_END, _END_BASIC = _end_pattern(_TERMS, _CLOSING), _end_pattern(_ASTRAL.sub("", _TERMS), _ASTRAL.sub("", _CLOSING))
_STRONG = frozenset(STERM) - frozenset("!?﹗﹖")
_OPEN = frozenset("\"'“„‚‘«‹¿¡").union(c for c in _CLOSE if unicodedata.category(c) in ("Ps", "Pi"))
del _EVERY
_TOKEN = re.compile(rf"[\w.\-ª̀-ͯؐ-ًؚ-ٟऀ-ॣ{INVISIBLE}]")
_THAI = re.compile(r"[฀-๿]")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]")
_COMPOUND = re.compile(r"(?:^|[\s(])([^\W\d_])[.．]\s?$")
_WORD = re.compile(r"\S+")
_START_WORD = re.compile(rf"[^\W\d_{INVISIBLE}][\w{INVISIBLE}]*")
# Wide and look-alike letters as they occur inside abbreviations.
_PLAIN = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)}
_LATIN = str.maketrans("аеорсухісԁɡһјѕνοрαιѡԛոս", "aeopcyxicdghjsvopaiwqnu")


def _abbreviation(token: str) -> str:
    token = token.lower().strip("-.")
    if token.isascii():
        return token
    token = _INVISIBLE.sub("", token).translate(_PLAIN).strip("-.")
    if token in NEVER or token in MAYBE:
        return token
    return token.translate(_LATIN)


def _breaks(text: str, m: re.Match, start: int, stop: int, lower_case: bool) -> bool:
    """Whether the sentence that runs from ``start`` ends at the terminators ``m``, with running text up to ``stop``."""
    marks = m.group()
    if not marks.isascii():
        marks = _INVISIBLE.sub("", marks)
    i = m.end()
    j = i
    while j < stop and ((c := text[j]).isspace() or (not c.isascii() and _INVISIBLE.match(c))):
        j += 1
    if j >= stop:
        return True
    nxt = text[j]
    gap = j > i and any(map(str.isspace, text[i:j]))
    first = marks[0]
    closed = marks[-1] not in _ENDS
    if not gap:
        prev = text[m.start() - 1] if m.start() > start else ""
        if closed:
            if marks[-1] == '"' and text.count('"', start, i) % 2:  # an opening quote behind a lost space
                return nxt.isupper() and (prev.isalnum() or prev in ")]%»”") and _follows(text, m.start(), start)
            if _UNSPACED.match(nxt):
                return False
            if nxt in _OPEN:
                return first in _STRONG or nxt not in "([\"'" or (nxt == "(" and j + 1 < stop and text[j + 1].isupper())
            return _capital(text, j, stop) and marks[-1] not in "”“" and _follows(text, m.start(), start)
        if first in _STRONG:
            return not nxt.isdigit() or first not in "．"
        if first in "!?" and (_UNSPACED.match(nxt) or (prev and _UNSPACED.match(prev))):
            return True
        if first in "!?":
            return (nxt.isupper() and prev.isalnum()) or nxt in "¿¡«„“" or (nxt == "(" and j + 1 < stop and text[j + 1].isupper())
        # a full stop with the space behind it lost
        if marks not in (".", "．"):
            return False
        if nxt.isupper() or nxt in "(“„«¿¡":
            if nxt == "(" and not (j + 1 < stop and text[j + 1].isupper()):
                return False
            if nxt.isupper() and not _capital(text, j, stop):
                return False
            return (prev in ")]»”%" or prev.isdigit() or prev.isalpha()) and _follows(text, m.start(), start, lost=True)
        return False
    # what comes next
    if nxt.isalpha():
        if nxt.islower() and not lower_case:
            w = _START_WORD.match(text, j)
            word = w.group() if w else nxt
            if not any(c.isupper() for c in word[1:]):
                return False
            case = "upper"
        else:
            case = "upper"
    elif nxt.isdigit():
        case = "digit"
    elif nxt in _OPEN:
        case = "open"
    elif nxt in "#-–—*•":
        return first not in ".…" or marks in (".", "．")
    else:
        return False
    if first in _STRONG or first in "!?":
        return True
    if first == "…" or len(marks.rstrip("\"'”’“»」』）)]} \xa0\u2009\u202f")) > 1:
        return case != "digit" and not lower_case and not (case == "open" and nxt in "([")
    if closed:
        inner = text[m.start() + 1 : i].strip()
        if case == "open" and nxt == "(" and j + 1 < stop and text[j + 1].isdigit():
            return False
        # an abbreviation before a closing bracket within the sentence: "(..., etc.) Went"
        return True if inner[0] in "\"'”’“»" or case != "digit" or _follows(text, m.start(), start) else False
    return _full_stop(text, m.start(), start, j, stop, case, lower_case)


def _capital(text: str, j: int, stop: int) -> bool:
    """Whether a capitalised word, a one-letter word or an initial begins at j."""
    return text[j].isupper() and (j + 1 >= stop or text[j + 1].islower() or text[j + 1].isspace() or text[j + 1] in ".．" or bool(_INVISIBLE.match(text[j + 1])))


class _InToken(dict):
    def __missing__(self, c: str) -> bool:
        inside = self[c] = _TOKEN.match(c) is not None
        return inside


_IN_TOKEN = _InToken()


def _before(text: str, dot: int, start: int) -> int:
    """Where the run of letters and signs before a full stop begins, as far as an abbreviation may reach; longer runs are none."""
    at, low = dot, max(start, dot - 64)
    while at > low and _IN_TOKEN[text[at - 1]]:
        at -= 1
    return at


def _follows(text: str, dot: int, start: int, lost: bool = False) -> bool:
    """Whether what stands before a full stop may end a sentence at all."""
    raw = text[_before(text, dot, start) : dot]
    if not raw:
        return True
    token = _abbreviation(raw)
    if token in NEVER:
        return False
    if lost and (len(token) < 2 or (token in MAYBE and token not in ("etc", "al", "usw", "a.m", "p.m")) or "_" in token):
        return token.isdigit() or not raw.isalpha()
    return len(token) > 1 or not token.isalpha()


def _full_stop(text: str, dot: int, start: int, j: int, stop: int, case: str, lower_case: bool) -> bool:
    at = _before(text, dot, start)
    nxt = text[j]
    year = case == "digit" or (case == "open" and nxt in "(（[" and j + 1 < stop and text[j + 1].isdigit())
    if at == dot:  # a bracket, a quote or a sign stands before
        return not (case == "open" and year and nxt in "(（")
    raw = text[at:dot]
    token = _abbreviation(raw)
    if len(token) == 1 and token.isalpha():
        before = text[max(start, at - 2) : at]
        if before.endswith("°") or (before[:1].isdigit() and before[1:].isspace()) or before[-1:].isdigit():
            return True  # a unit
        head = text[max(start, at - 5) : at]
        c = _COMPOUND.search(head)
        if c and raw.islower() and c.group(1).islower():
            return False  # "d. h.", "u. a.", "т. е."
        if c and c.group(1) in "zZ" and token == "b":
            return False
        if _INVISIBLE.sub("", raw).isupper() or lower_case:
            return False  # an initial
        if token in NEVER or token in "psdzuтi":
            return False
        return True
    if token in NEVER:
        return False
    if token in MAYBE:
        if lower_case and case == "upper":
            return token in ("p.m", "pm")
        if year:
            return case == "digit" and token in ("etc", "al", "p.m", "pm", "a.m", "am", "usw") and not (token == "al" and _year(text, j))
        return True
    if token.isdigit() and len(token) <= 2 and case == "upper" and text.startswith(MONTHS, j):
        return False
    if case == "open" and year and nxt in "(（":
        return False
    return True


def _year(text: str, j: int) -> bool:
    return bool(re.match(r"(?:19|20)\d\d\b", text[j : j + 5]))


def _running(text: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
    """Sentences of the running text a..b."""
    if not _ALNUM.search(text, a, b):
        return
    body = text[a:b]
    if _THAI.search(body) and len(_THAI.findall(body)) * 3 > len(body):
        for m in _WORD.finditer(text, a, b):
            if _ALNUM.search(m.group()):
                out.append((m.start(), m.end()))
        return
    low = body.lower() == body and body.upper() != body
    start = a
    for m in (_END if _ASTRAL.search(body) else _END_BASIC).finditer(text, a, b):
        if m.end() <= start:
            continue
        if _breaks(text, m, start, b, low):
            end = m.end()
            if m.group()[-1] in "\"'" and end - m.start() > 1 and text.count('"', start, end) % 2 and end < b and not text[end].isspace() and m.group()[-1] == '"':
                end -= 1
            _unit(text, start, end, out)
            start = end
    _unit(text, start, b, out)


def _unit(text: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
    while a < b and text[a].isspace():
        a += 1
    while a < b and text[b - 1].isspace():
        b -= 1
    if a < b and _ALNUM.search(text, a, b):
        out.append((a, b))


def sentence_units(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each unit, in order; none for null texts and texts without letters and digits."""
    out: list[tuple[int, int]] = []
    if not text or not _ALNUM.search(text):
        return out
    a = b = -1  # the running text gathered so far
    for m in _LINE.finditer(text):
        s, e = m.start(), m.end()
        line = m.group()
        blank = line.isspace()
        # lines parted by more than one line break leave a blank line between
        gap = a >= 0 and text.count("\n", b, s) > 1
        own = not blank and (_OWN.match(line) or _FENCE.match(line))
        if a >= 0 and (blank or gap or own):
            _block(text, a, b, out)
            a = -1
        if blank:
            continue
        if own:
            i, j = s, e
            while text[i].isspace():
                i += 1
            while text[j - 1].isspace():
                j -= 1
            if not _FENCE.match(line):
                out.append((i, j))
        else:
            if a < 0:
                a = s
            b = e
    if a >= 0:
        _block(text, a, b, out)
    return out


def last_unit(text: str) -> list[tuple[int, int]]:
    """The last of ``sentence_units`` alone: a blank line ends whatever stands before it, so only what follows one is read."""
    at, step = len(text.rstrip()), 1
    while at > 0:
        at, step = max(0, text.rfind("\n\n", 0, max(0, at - step))), 2 * step
        units = sentence_units(text[at:])
        if units:
            a, b = units[-1]
            return [(a + at, b + at)]
    return []


def _block(text: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
    i = a
    while i < b and text[i].isspace():
        i += 1
    head = _INVISIBLE.sub("", text[i : i + 40])
    if not head.isascii():
        head = head.translate(_PLAIN)
        if not _CAPTION.match(head):
            head = head.translate(_LATIN)
    if _CAPTION.match(head):
        _unit(text, i, b, out)
        return
    if _ENTRY.match(text, i, b):
        at = i
        for m in _LINE.finditer(text, i, b):
            if m.start() > at and _ENTRY.match(text, m.start(), b):
                _unit(text, at, m.start(), out)
                at = m.start()
        _unit(text, at, b, out)
        return
    _running(text, i, b, out)


def sentences(df: DataFrame, field: str, id_col: str, order: Column | None = None, text: bool = True) -> DataFrame:
    """One row per sentence unit: ``field``, ``row_id``, ``start_pos``, ``end_pos`` and, if asked, the unit's ``text``.

    ``field`` names the text column. Positions count code points in the text as stored. Null texts and texts without
    letters and digits have no units. Of rows repeated under one id, the one last by ``order`` counts (any, without).
    Other columns are ignored.
    """
    kept = df.select(F.col(id_col).cast("bigint").alias("row_id"), (F.lit(0) if order is None else order).alias("o"), F.col(field).alias("t")).where("t is not null")
    kind = kept.schema["o"].dataType.simpleString()

    def make():
        def units(ids, orders, texts):
            found = [sentence_units(t) for t in texts]
            return [ids, orders, [[s for s, _ in f] for f in found], [[e for _, e in f] for f in found], [[t[s:e] for s, e in f] for t, f in zip(texts, found)] if text else [None] * len(ids)]

        return units

    rows = map_batches(kept, make, f"row_id bigint, o {kind}, starts array<int>, ends array<int>, texts array<string>")
    if not text:
        rows = rows.drop("texts")
    one = rows.groupBy("row_id").agg(F.max_by(F.struct("starts", "ends", *(["texts"] if text else [])), F.coalesce(F.col("o").cast("string"), F.lit(""))).alias("u"))
    parts = F.arrays_zip("u.starts", "u.ends", *(["u.texts"] if text else []))
    flat = one.select("row_id", F.explode(parts).alias("p"))
    return flat.select(F.lit(field).alias("field"), "row_id", F.col("p.starts").alias("start_pos"), F.col("p.ends").alias("end_pos"), *([F.col("p.texts").alias("text")] if text else []))
