"""Pieces of SQL for the checks in DuckDB: the same definitions, written for its functions and its regex engine."""

from __future__ import annotations

import re

from ..functions import patterns as P

NB = r"[^\p{L}\p{N}_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def text(t: str) -> str:
    return f"coalesce({t}, '')"


def count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text(t)}, {lit(pattern)}))::INT"


def find(t: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text(t)}, {lit(pattern)}, {group})"


def sub(t: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({t}, {lit(pattern)}, {lit(to)}, 'g')"


def strip(t: str) -> str:
    return sub(t, f"^{P.S}+|{P.S}+$")


def words(t: str) -> str:
    return count(t, f"{P.NS}+")


def sentences(t: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text(t)}, '[.!?]+'), lambda s: {strip('s')}), lambda s: s <> '')"


def occurrences(t: str, part: str) -> str:
    return f"((length({text(t)}) - length(replace({text(t)}, {lit(part)}, ''))) // {len(part)})::INT"


def doubled(t: str) -> str:
    """The text with each sign that ends a word twice, so that matches which take their borders don't share them."""
    return sub(text(t), f"({NB})", r"\1\1")


def double(word: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else re.escape(c) * 2 for c in word).replace("\\ ", " ").replace("\\'", "'").replace("\\-", "-")


def bounded(words_) -> str:
    """A pattern of whole words for ``doubled`` text."""
    return f"(?i)(?:^|{NB})(?:" + "|".join(double(w) for w in words_) + f")(?:$|{NB})"


def present(t: str, words_, whole: bool = True) -> str:
    """The words of a list that a text has, in the list's order."""
    tests = ", ".join((f"CASE WHEN regexp_matches(lower({text(t)}), {lit(f'(?:^|{NB})(?:{re.escape(w)})(?:$|{NB})')})" if whole else f"CASE WHEN contains(lower({text(t)}), {lit(w)})") + f" THEN {lit(w)} END" for w in words_)
    return f"list_filter([{tests}], lambda w: w IS NOT NULL)"


def one_decimal(a: str, b: str) -> str:
    return f"(((20 * ({a})::BIGINT + ({b})::BIGINT) // (2 * ({b})::BIGINT)) / 10.0)::DOUBLE"


def percent(a: str, b: str) -> str:
    return one_decimal(f"100 * ({a})::BIGINT", b)
