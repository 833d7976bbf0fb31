"""Does a rewritten text keep the original's numbers, callouts and citations?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import entities as E, patterns as P

# Checks in order: type, entity of the original, severity (fixed values).
RULES = (("Figure Callout", "figures", "HIGH"), ("Table Callout", "tables", "HIGH"), ("Statistical P-Value", "p_values", "CRITICAL"), ("Scientific Metric", "unit_metrics", "HIGH"), ("Residue / Structure Code", "residues", "MEDIUM"), ("Numerical Data", "raw_numbers", "MEDIUM"), ("Citation Year", "years", "CRITICAL"))


def _number(x: Column) -> Column:
    return F.regexp_extract(x, f"({E.NUMBER})", 1)


def _found(kind: str, item: Column, exact: bool) -> Column:
    """Whether the rewritten text, its entities in ``after``, keeps an item."""
    text = F.replace(F.col("after_text"), F.lit("−"), F.lit("-"))
    targets = F.col(f"after.{kind}") if kind in ("figures", "tables", "p_values", "unit_metrics") else None
    if exact and targets is not None:
        return F.array_contains(targets, item)
    if kind in ("figures", "tables", "p_values"):
        return (_number(item) != "") & F.exists(targets, lambda t: t.contains(_number(item)))
    if kind == "unit_metrics":
        head = F.split(item, " ")[0]
        return F.exists(targets, lambda t: t.contains(head)) | text.contains(head)
    if kind == "residues":
        return F.lower("after_text").contains(F.lower(item))
    if kind == "raw_numbers":
        return text.contains(item)
    return F.array_contains(F.col("after.years"), item) | F.col("after_text").contains(item)


def inversions(before: Column, after: Column) -> Column:
    """Neighbouring first appearances of numbered citations that newly run backwards."""
    first = lambda c: F.array_distinct(F.transform(c, lambda x: x["num"]))
    o, t = first(before), first(after)
    steps = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: i + 1 <= F.size(t))
    pairs = F.transform(steps, lambda i: F.struct(F.get(t, i - 1).alias("a"), F.get(t, i).alias("b")))
    kept = lambda p: (F.array_position(o, p["a"]) > 0) & (F.array_position(o, p["b"]) > 0) & (F.array_position(o, p["a"]) < F.array_position(o, p["b"]))
    return F.filter(pairs, lambda p: (p["a"] > p["b"]) & ~kept(p))


def _check(name: str, kind: str, severity: str, exact: bool):
    return lambda x: F.struct(F.lit(name).alias("type"), x.alias("original"), F.lit(severity).alias("severity"), _found(kind, x, exact).alias("found"))


INVERSION = "Citation Sequence Inversion"


def _check_arrays(df: DataFrame, id_col: str, before: str, after: str, exact: bool, only: tuple[str, ...] | None) -> DataFrame:
    """A row's checks as an array ``checks``; of the entities only those are looked for that the asked rules need."""
    rules = [r for r in RULES if only is None or r[0] in only]
    turned = only is None or INVERSION in only
    kinds = tuple(k for _, k, _ in rules) + (("citations",) if turned else ())
    base = df.select(id_col, F.coalesce(before, F.lit("")).alias("before_text"), F.coalesce(after, F.lit("")).alias("after_text"))
    base = base.withColumn("before", E.entities(F.col("before_text"), kinds)).withColumn("after", E.entities(F.col("after_text"), kinds))
    parts = [F.transform(F.col(f"before.{kind}"), _check(name, kind, severity, exact)) for name, kind, severity in rules]
    if turned:
        pairs = inversions(F.col("before.citations"), F.col("after.citations"))
        said = lambda p: F.format_string("[%d] before [%d]", p["a"], p["b"])
        parts.append(F.transform(pairs, lambda p: F.struct(F.lit(INVERSION).alias("type"), said(p).alias("original"), F.lit("HIGH").alias("severity"), F.lit(False).alias("found"))))
    return base.select(id_col, F.concat(*parts).alias("checks"))


def checks(df: DataFrame, id_col: str, before: str, after: str, exact: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """A row per check: id, ``type``, ``original``, ``severity``, ``found``; of the types in ``only`` where given. Null texts count as empty."""
    return _check_arrays(df, id_col, before, after, exact, only).select(id_col, F.explode("checks").alias("c")).select(id_col, "c.*")


def report(df: DataFrame, id_col: str, before: str, after: str, exact: bool = False) -> DataFrame:
    """For each row: its id, checks, passed, failed, score in percent, and whether it is safe.

    The checks of a row are folded where they are, so nothing is shuffled; rows repeated under one id give one each.
    """
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("p"), F.lit(False).alias("critical"))
    add = lambda acc, c: F.struct((acc["n"] + 1).alias("n"), (acc["p"] + F.when(c["found"], 1).otherwise(0)).alias("p"), (acc["critical"] | ((c["severity"] == "CRITICAL") & ~c["found"])).alias("critical"))
    folded = _check_arrays(df, id_col, before, after, exact, None).select(id_col, F.aggregate("checks", start, add).alias("x")).select(id_col, F.col("x.n").alias("total_checks"), F.col("x.p").alias("passed_checks"), "x.critical")
    score = F.when(F.col("total_checks") == 0, 100.0).otherwise(F.floor((2000 * F.col("passed_checks") + F.col("total_checks")) / (2 * F.greatest("total_checks", F.lit(1)))).cast("double") / 10)
    out = folded.withColumn("fidelity_score", score)
    return out.select(id_col, "total_checks", "passed_checks", (F.col("total_checks") - F.col("passed_checks")).alias("failed_checks"), "fidelity_score", ((F.col("fidelity_score") >= 95) & ~F.col("critical")).alias("is_safe"))
