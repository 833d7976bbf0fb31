"""Bringing texts that look the same into one form.

First compatibility normalization where it does not change the look (widths, joined letters and signs, presentation
forms; raised, circled and styled characters stay), with spaces of all widths made one and ignorable characters deleted.
Then each token of letters becomes a lattice: at each place all letters of the same shape, from any alphabet. Viterbi
search finds its best path under character bigrams counted in the corpus, with a cost for a change of script.
A token's lattice depends on its look alone, so tokens that look the same come out equal, and others do not.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scale import salted_join
from ..session import checkpointed
from .common import map_batches
from .sentences import INVISIBLE

# Letters of one shape, by place in the strings: Latin, Cyrillic, Greek; a space where an alphabet has none (fixed values).
LATIN_ = "ABCEHIJKMNOPSTXYZacdehijlopqsvwxyg"
CYRIL_ = "АВСЕНІЈКМ ОРЅТХҮ асԁеһіјӏорԛѕѵԝху "
GREEK_ = "ΑΒϹΕΗΙͿΚΜΝΟΡ ΤΧΥΖ ϲ    ϳ ο   ν    "
CLASSES: dict[str, tuple[str, ...]] = {}
for _group in zip(LATIN_, CYRIL_, GREEK_):
    _members = tuple(c for c in _group if c != " ")
    CLASSES |= {c: _members for c in _members}
for _pair in ("gɡ", "ІӀ"):
    _members = tuple(dict.fromkeys([*CLASSES.get(_pair[0], _pair[0]), *CLASSES.get(_pair[1], _pair[1])]))
    CLASSES |= {c: _members for c in _members}

#: Ranges of the alphabets with shared shapes; the bigram table has a row and a column for each letter in them.
RANGES = ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0x250, 0x2B0), (0x370, 0x400), (0x400, 0x530))
_INDEX = np.zeros(0x10000, dtype=np.int64)
_N = 1
for _a, _b in RANGES:
    _INDEX[_a:_b] = np.arange(_N, _N + _b - _a)
    _N += _b - _a
SWITCH = -12.0
_KEPT = ("<super>", "<sub>", "<fraction>", "<circle>", "<font>")
_IGNORED = re.compile(f"[{INVISIBLE}\\U000e0000-\\U000e0fff\\ufff0-\\ufff8]")
_ALNUM = re.compile(r"[^\W_]")
_MARKED = re.compile(r"([^\W\d_](?:[^\W\d_]|[̀-ͯ])*)")
_SKIP = {0x17F, 0xAA, 0xBA, 0x3F2, 0x3F9}  # letters whose compatible form looks different


class _Forms(dict):
    """What each character becomes before letters are compared: its decomposition, where that looks the same."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = self._of(c)
        self[code] = out
        return out

    def _of(self, c: str) -> str:
        if _IGNORED.match(c):
            return ""
        if unicodedata.category(c) == "Zs":
            return " "
        if c in "‐‑":
            return "-"
        parts = unicodedata.decomposition(c).split()
        if not parts or ord(c) in _SKIP:
            return unicodedata.normalize("NFD", c)
        if parts[0] in _KEPT or (parts[0].startswith("<") and parts[1] == "0020" and len(parts) > 2):
            return c
        if parts[0].startswith("<"):
            parts = parts[1:]
        return "".join(self._of(chr(int(p, 16))) for p in parts)


_FORMS = _Forms()


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_CHANGED: list[re.Pattern] = []


def _changed() -> re.Pattern:
    """Characters of the basic plane that ``_FORMS`` changes otherwise than by canonical decomposition."""
    if not _CHANGED:
        nfd = unicodedata.normalize
        _CHANGED.append(re.compile(f"[{re.escape(''.join(c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))) if nfd('NFD', _FORMS[ord(c)]) != nfd('NFD', c)))}]"))
    return _CHANGED[0]


def plain(text: str) -> str:
    """The text decomposed, in one width, without what cannot be seen."""
    if text.isascii():
        return text
    if _ASTRAL.search(text):
        return unicodedata.normalize("NFD", text.translate(_FORMS))
    return unicodedata.normalize("NFD", _changed().sub(lambda m: _FORMS[ord(m.group())], text))


def bigram_counts(df: DataFrame) -> DataFrame:
    """Counts of pairs of neighbouring letters over all texts of column ``t``: ``pair``, ``n``. At most ``_N`` squared rows."""

    def make():
        def count(texts):
            joined = np.frombuffer("\n".join(plain(t) for t in texts).encode("utf-32-le"), dtype=np.uint32)
            total = np.zeros(_N * _N, dtype=np.int64)
            for at in range(0, len(joined), 1 << 20):
                codes = joined[max(0, at - 1) : at + (1 << 20)]
                ids = np.where(codes < 0x10000, _INDEX[codes & 0xFFFF], 0)
                total += np.bincount(ids[:-1] * _N + ids[1:], minlength=_N * _N)
            pairs = np.nonzero(total)[0]
            return [pairs.tolist(), total[pairs].tolist()]

        return count

    return map_batches(df.select("t").where("t is not null"), make, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _script(c: str) -> int:
    o = ord(c)
    return 2 if 0x400 <= o < 0x530 else 1 if 0x370 <= o < 0x400 else 0


class Reader(dict):
    """The best reading of each token of letters, kept once found."""

    LIMIT = 200_000

    def __init__(self, counts: dict[int, int]):
        super().__init__()
        self.counts = counts
        self.rows: dict[int, int] = {}
        for pair, n in counts.items():
            self.rows[pair // _N] = self.rows.get(pair // _N, 0) + n

    def _cost(self, a: int, b: int) -> float:
        return math.log((self.counts.get(a * _N + b, 0) + 0.5) / (self.rows.get(a, 0) + 0.5 * _N))

    def __missing__(self, token: str) -> str:
        out = self._best(token)
        if len(token) > 64:  # kept are those that come again
            return out
        if len(self) >= self.LIMIT:
            self.clear()
        self[token] = out
        return out

    def _best(self, token: str) -> str:
        if not any(c in CLASSES for c in token):
            return token
        # of each letter that a place may hold: the best score so far, and which letter it came from
        now: list[tuple[float, str, int, int]] = [(0.0, "", 0, -1)]
        steps: list[tuple[list[str], list[int]]] = []
        for c in token:
            if "\u0300" <= c <= "\u036f":  # a mark goes with its letter
                steps.append(([c] * len(now), list(range(len(now)))))
                continue
            new, back = [], []
            for x in CLASSES.get(c, (c,)):
                i, k = int(_INDEX[ord(x)]) if ord(x) < 0x10000 else 0, _script(x)
                scores = [s + self._cost(j, i) + (SWITCH if m not in (-1, k) else 0.0) for s, _, j, m in now]
                best = max(range(len(now)), key=scores.__getitem__)  # ties go to the first in the classes' order
                new.append((scores[best], x, i, k))
                back.append(best)
            now = new
            steps.append(([x for _, x, _, _ in new], back))
        at = max(range(len(now)), key=lambda j: now[j][0] + self._cost(now[j][2], 0))
        out = []
        for letters, back in reversed(steps):
            out.append(letters[at])
            at = back[at]
        return "".join(reversed(out))


def one_form(text: str, reader: Reader) -> str:
    """The form that all texts of the same look share."""
    parts = _MARKED.split(plain(text))
    parts[1::2] = map(reader.__getitem__, parts[1::2])
    out = "".join(parts)
    return out if out.isascii() else unicodedata.normalize("NFC", out)


def learn(df: DataFrame) -> dict[int, int]:
    """The bigram table of all texts in column ``t``, brought to the driver: its size is bounded by the alphabets."""
    found = {r.pair: r.n for r in bigram_counts(df).toLocalIterator()}
    assert len(found) <= _N * _N
    return found


def forms(df: DataFrame, field: str, id_col: str, counts: dict[int, int], order: Column | None = None, text: bool = True) -> DataFrame:
    """Each text in its one form: ``field, row_id, o, form_key, raw_key, has_letters``, and ``text`` if asked.

    The keys are digests of the form and of the text as stored. Null texts give no rows; empty ones and those without
    letters and digits have ``has_letters`` false. Other columns are ignored.
    """
    kept = df.select(F.col(id_col).cast("bigint").alias("row_id"), (F.lit(0) if order is None else order).alias("o"), F.col(field).alias("t")).where("t is not null")
    kind = kept.schema["o"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(counts)  # bounded by the alphabets' letters squared

    def make():
        reader = Reader(shared.value)
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()

        def read(ids, orders, texts):
            found = [one_form(t, reader) for t in texts]
            return [ids, orders, [digest(f) for f in found], [digest(t) for t in texts], [_ALNUM.search(f) is not None for f in found], found if text else [None] * len(ids)]

        return read

    rows = map_batches(kept, make, f"row_id bigint, o {kind}, form_key binary, raw_key binary, has_letters boolean, text string")
    return (rows if text else rows.drop("text")).select(F.lit(field).alias("field"), "*")


def _records(rows: DataFrame) -> DataFrame:
    """One row a record with letters, ``field, row_id, form_key, raw_key``, written once: of repeated rows the last by ``o``."""
    last = F.max_by(F.struct("form_key", "raw_key"), F.coalesce(F.col("o").cast("string"), F.lit("")))
    return checkpointed(rows.where("has_letters").groupBy("field", "row_id").agg(last.alias("k")).select("field", "row_id", "k.*"))


def look_classes(rows: DataFrame) -> DataFrame:
    """The class of each record: ``field, row_id, class_id, records, forms, links``.

    ``rows`` come from ``forms``. A class holds all records of one look; ``class_id`` is its least ``row_id``, ``records``
    their number, ``forms`` the number of ways in which they are stored, ``links`` the number of records of the class
    that are stored otherwise than this one. Texts without letters and digits are in no class. Counts are taken over
    stored ways first, so no task holds a look's records; the pairs of ``same_look`` follow from the classes.
    """
    one = _records(rows)
    ways = one.groupBy("field", "form_key", "raw_key").agg(F.count("*").alias("same"), F.min("row_id").alias("least"))
    looks = ways.groupBy("field", "form_key").agg(F.sum("same").alias("records"), F.count("*").alias("forms"), F.min("least").alias("class_id"))
    counted = ways.drop("least").join(looks, ["field", "form_key"])
    return salted_join(one, counted, ["field", "form_key", "raw_key"], F.col("row_id"), "inner").select("field", "row_id", "class_id", "records", "forms", (F.col("records") - F.col("same")).alias("links"))


def same_look(rows: DataFrame, part: int = 5000) -> DataFrame:
    """Pairs of records whose texts look the same but differ: ``field, a_id, b_id`` with ``a_id < b_id``.

    ``rows`` come from ``forms``. Groups of exact copies alone never meet: only forms that were stored in more than one
    way are joined with themselves, and a look of many records is joined in parts of ``part`` records.
    """
    one = _records(rows)
    ways = one.groupBy("field", "form_key", "raw_key").agg(F.count("*").alias("n"))
    mixed = ways.groupBy("field", "form_key").agg(F.sum("n").alias("n"), F.count("*").alias("ways")).where("ways > 1")
    of = salted_join(one, mixed.select("field", "form_key", F.ceil(F.col("n") / part).cast("int").alias("parts")), ["field", "form_key"], F.col("row_id"), "inner")
    a = of.withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int")).alias("a")
    b = of.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    on = (F.col("a.field") == F.col("b.field")) & (F.col("a.form_key") == F.col("b.form_key")) & (F.col("a.part") == F.col("b.part"))
    return a.join(b, on & (F.col("a.raw_key") != F.col("b.raw_key")) & (F.col("a.row_id") < F.col("b.row_id"))).select(F.col("a.field").alias("field"), F.col("a.row_id").alias("a_id"), F.col("b.row_id").alias("b_id"))
