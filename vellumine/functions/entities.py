"""Numbers, units, callouts and codes found in scientific text. Sorted, without repeats, unless order carries meaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P, text as T

# What counts as a number, a unit, a callout and so on (fixed values).
NUMBER = rf"{P.D}+(?:\.{P.D}+)?"
P_VALUE = rf"{P.B}[pP](?:[-{P.WS}]?value)?{P.S}*(?:[<=>≥≤]|(?:{P.B}(?:less|greater){P.S}+than{P.B})){P.S}*{NUMBER}{P.B}"
PERCENTAGE = rf"{P.B}{NUMBER}{P.S}*%{P.B}"
UNITS = r"kJ/mol|kcal/mol|Å|angstroms?|µM|uM|nM|mM|mg/kg|mg/dL|kDa|Da|mol/L|h|hr|hrs|min|sec|%"
UNIT_METRIC = rf"(?iu)([−\-+]?{NUMBER}){P.S}*({UNITS}){P.B}"
SIGNED = rf"(?<![a-zA-Z0-9_])[−\-+]?{NUMBER}(?:[eE][\-+]?{P.D}+)?(?![a-zA-Z0-9_])"
FIGURE = rf"(?iu){P.B}(?:Figure|Fig\.){P.S}*{NUMBER}[a-zA-Z]?(?:{P.S}*\([A-D]\))?{P.B}"
TABLE = rf"(?iu){P.B}Table{P.S}*{NUMBER}{P.B}"
RESIDUE = rf"{P.B}(?:[A-Z][a-z]{{2}}{P.D}{{1,4}}|PDB{P.S}*[:{P.WS}]{P.S}*[0-9][A-Za-z0-9]{{3}}){P.B}"
YEAR = rf"{P.B}(?:19{P.D}{{2}}|20{P.D}{{2}}){P.B}"
CITATION = rf"\[{P.D}+(?:{P.S}*[-–,]{P.S}*{P.D}+)*\]"
# The same with the gaps that strict matching leaves closed: two-sign operators, a percent sign before a blank.
P_VALUE_WIDE = rf"{P.B}[pP](?:[-{P.WS}]?value)?{P.S}*(?:[<>]=|[<=>≥≤]|(?:{P.B}(?:less|greater){P.S}+than{P.B})){P.S}*(?:{NUMBER}|\.{P.D}+){P.B}"
PERCENTAGE_WIDE = rf"{P.B}{NUMBER}{P.S}*%"


def plain_dashes(text: Column) -> Column:
    """Minus and en dash as hyphen."""
    return F.translate(F.coalesce(text, F.lit("")), "−–", "--")


def _set(found: Column) -> Column:
    return F.array_sort(F.array_distinct(found))


def p_values(text: Column, wide: bool = False) -> Column:
    return _set(F.transform(T.matches_of(plain_dashes(text), P_VALUE_WIDE if wide else P_VALUE), T.strip))


def percentages(text: Column, wide: bool = False) -> Column:
    return _set(T.matches_of(plain_dashes(text), PERCENTAGE_WIDE if wide else PERCENTAGE))


def unit_metrics(text: Column) -> Column:
    t = plain_dashes(text)
    return _set(F.transform(T.matches_of(t, UNIT_METRIC), lambda m: F.lower(F.concat(F.regexp_extract(m, UNIT_METRIC.replace(P.B, ""), 1), F.lit(" "), F.regexp_extract(m, UNIT_METRIC.replace(P.B, "$"), 2)))))


def raw_numbers(text: Column) -> Column:
    """Signed or decimal numbers, and whole ones from 10 on."""
    keep = lambda n: n.contains(".") | n.rlike(r"^[-+]") | (n.rlike(rf"^{P.D}+$") & ~n.rlike(rf"^0*{P.D}$"))
    return _set(F.filter(T.matches_of(plain_dashes(text), SIGNED), keep))


def _title(text: Column) -> Column:
    """Capital behind anything that is no letter, small letters elsewhere; callouts are ASCII but for their spaces."""
    low = F.lower(F.regexp_replace(text, f"{P.S}+", " "))
    letters = F.split(low, "")
    return F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~F.get(letters, i - 1).rlike(r"^\p{L}$"), F.upper(c)).otherwise(c)), "")


def figures(text: Column) -> Column:
    return _set(F.transform(T.matches_of(text, FIGURE), lambda m: _title(T.strip(m))))


def tables(text: Column) -> Column:
    return _set(F.transform(T.matches_of(text, TABLE), lambda m: _title(T.strip(m))))


def residues(text: Column) -> Column:
    return _set(T.matches_of(text, RESIDUE))


def years(text: Column) -> Column:
    return _set(T.matches_of(plain_dashes(text), YEAR))


def citations(text: Column) -> Column:
    """Bracketed citations in order, with their first number."""
    return F.transform(T.matches_of(plain_dashes(text), CITATION), lambda m: F.struct(F.translate(F.regexp_extract(m, rf"({P.D}+)", 1), *P.DIGITS).try_cast("int").alias("num"), m.alias("raw")))


KINDS = {"p_values": p_values, "percentages": percentages, "unit_metrics": unit_metrics, "raw_numbers": raw_numbers, "figures": figures, "tables": tables, "residues": residues, "years": years, "citations": citations}


def entities(text: Column, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """A struct with a field for each kind asked for."""
    return F.struct(*(KINDS[k](text).alias(k) for k in kinds))
