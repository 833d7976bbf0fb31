"""Column expressions on text: words, sentences, counts, cleaning."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

from . import patterns as P


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, pattern: str) -> Column:
    """How often a pattern matches; null texts count as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def matches_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def occurrences(text: Column, part: str) -> Column:
    """Places, not overlapping, at which a literal stands."""
    t = F.coalesce(text, F.lit(""))
    return ((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)).cast("int")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(P.BLANKS))


def word_count(text: Column) -> Column:
    return count_of(text, f"{P.NS}+")


def sentences(text: Column) -> Column:
    """The stretches between runs of ``.!?``, stripped, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), strip), lambda s: s != "")


def sentence_count(text: Column) -> Column:
    """How many sentences there are, without making them."""
    return count_of(text, f"[^.!?]*[^.!?{P.WS}][^.!?]*")


def words_in(part: Column) -> Column:
    """Words of an element inside a higher-order function."""
    return F.regexp_count(part, F.lit(f"{P.NS}+"))


def one_decimal(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator to one place, half up, in whole numbers throughout."""
    a, b = numerator.cast("long"), denominator.cast("long")
    return F.floor((20 * a + b) / (2 * b)).cast("double") / 10


def percent(part: Column, whole: Column) -> Column:
    return one_decimal(100 * part.cast("long"), whole)


@functools.cache
def _nfc():
    """Made on first use, since workers import this module without a session."""

    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return pandas_udf(compose, "string")


def nfc(text: Column) -> Column:
    """Composed form; plain ASCII never leaves the JVM."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfc()(text))


def plain_spaces(text: Column) -> Column:
    return F.regexp_replace(text, P.SPACE_CLASS, " ")


def plain_quotes(text: Column) -> Column:
    single = {k: v for k, v in P.QUOTES.items() if len(v) == 1}
    out = F.translate(text, "".join(single), "".join(single.values()))
    return F.replace(out, F.lit("…"), F.lit("..."))


def without_invisibles(text: Column) -> Column:
    return F.regexp_replace(text, P.STRIP_CLASS, "")


def sanitize(text: Column, quotes: bool = False) -> Column:
    """Invisible characters out, spaces plain, quotes plain if asked, then composed."""
    t = plain_spaces(without_invisibles(F.coalesce(text, F.lit(""))))
    return nfc(plain_quotes(t) if quotes else t)


def sanitize_stats(text: Column, quotes: bool = False) -> Column:
    return F.struct(
        count_of(text, P.STRIP_CLASS).alias("removed_invisibles"),
        count_of(text, P.SPACE_CLASS).alias("normalized_spaces"),
        (count_of(text, "[" + "".join(P.QUOTES) + "]") if quotes else F.lit(0)).alias("normalized_quotes"),
    )


MARKER_STEPS = (
    (rf"{P.S}*—{P.S}*", ", "),
    (rf"{P.S}*--{P.S}*", ", "),
    (r"[\x{200b}-\x{200f}\x{feff}\x{202a}-\x{202e}]", ""),
    (rf",{P.S}*,+", ","),
    (rf",{P.S}*\.", "."),
    (rf",{P.S}*;", ";"),
    (r"[ \t]{2,}", " "),
)


def clean_markers(text: Column) -> Column:
    """Dashes become commas, directional marks go, doubled commas and spaces are joined, in this order."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in MARKER_STEPS:
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


#: Openings and endings that tools wrap around an answer, in order (fixed values).
OPENINGS = (
    rf"(?iu)^Here(?:'s| is)(?: the)? (?:the )?(?:re-?written|humanized|revised|cleaned|edited|updated)(?: version)?(?: of)?(?: the)?(?: text)?[:{P.WS}]*",
    rf"(?iu)^Sure(?:,| -)? (?:here(?:'s| is))?[^\n]*?[:{P.WS}]*",
    rf"(?iu)^Certainly[!,.]?{P.S}*(?:Here(?:'s| is))?[^\n]*?[:{P.WS}]*",
    rf"(?iu)^Of course[!,.]?{P.S}*(?:Here(?:'s| is))?[^\n]*?[:{P.WS}]*",
    rf"(?iu)^Below is (?:the )?(?:re-?written|humanized|revised)[^\n]*?[:{P.WS}]*",
)
ENDINGS = (
    rf"(?ius)\n+---+{P.S}*\n+(?:Note|Explanation|Changes made|Key changes|Summary of changes|I (?:have )?made).*$",
    r"(?ius)\n+\*\*(?:Note|Changes|Summary)\*\*.*$",
    r"(?ius)\n+Let me know if .*$",
    r"(?ius)\n+(?:I hope this|Feel free to|Please let me know).*$",
)


def clean_output(text: Column) -> Column:
    """A tool's answer without its wrapping: fence, quotes, openings, endings, left-behind tokens, spare space."""
    fence = rf"(?s)^```(?:text|markdown|plain)?{P.S}*\n(.*?)```{P.S}*$"
    t = let(strip(F.coalesce(text, F.lit(""))), lambda t: F.when(t.rlike(fence), strip(F.regexp_extract(t, fence, 1))).otherwise(t))

    def unquoted(t: Column) -> Column:
        wrapped = (F.length(t) >= 2) & ((t.startswith('"') & t.endswith('"')) | (t.startswith("'") & t.endswith("'")))
        inner = strip(F.regexp_replace(t, r"(?s)^.|.\z", ""))
        return F.when(wrapped & (F.length(t) > 52), F.when(F.length(inner) > 50, inner).otherwise(t)).otherwise(t)

    t = let(t, unquoted)
    for pattern in OPENINGS:
        t = strip(F.regexp_replace(t, pattern, ""))
    for pattern in ENDINGS:
        t = strip(F.regexp_replace(t, pattern, ""))
    for leak in P.LEAKS:
        t = F.regexp_replace(t, "(?iu)" + leak, "")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return clean_markers(t)


def strip_headings(text: Column) -> Column:
    """Lines without their heading marks."""
    return F.regexp_replace(text, rf"(?m)^#{{1,6}}{P.S}+", "")


def normalize_blocks(text: Column) -> Column:
    """Headings and captions parted from what surrounds them by blank lines."""
    t = F.regexp_replace(text, rf"(?md)^(#{{1,6}}{P.S}+[^\n]*)$", "\n\n$1\n\n")
    t = F.regexp_replace(t, rf"(?imdu)^((?:Figure|Fig\.|Table){P.S}+{P.D}+[^\n]*)$", "\n\n$1\n\n")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def tail_sentence(text: Column) -> Column:
    """The last sentence outside headings and rows of tables, without its mark."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("|"))
    return F.coalesce(F.get(F.reverse(sentences(F.array_join(lines, " "))), F.lit(0)), F.lit(""))


def last_long_sentence(text: Column, least: int = 4) -> Column:
    """The last sentence, its mark kept, of at least ``least`` words; else the last one."""
    parts = F.filter(F.transform(F.split(strip(F.coalesce(text, F.lit(""))), rf"(?<=[.!?]){P.S}+"), strip), lambda s: s != "")
    return let(parts, lambda p: F.coalesce(F.get(F.reverse(F.filter(p, lambda s: words_in(s) >= least)), F.lit(0)), F.get(F.reverse(p), F.lit(0)), F.lit("")))
