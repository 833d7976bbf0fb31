"""Building blocks that keep hot groups out of single tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds, by name, the sum of a column over the rows ahead of each row in its group.

    ``bucket`` is a rising function of the order. Rows are summed within buckets, sums of buckets are carried over by a
    second, small window; so no task sorts a whole group, however large.
    """
    base = df.withColumns({f"__{n}": c for n, c in sums.items()})
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = base.groupBy(*group, bucket).agg(*(F.sum(f"__{n}").alias(f"__all_{n}") for n in sums))
    ahead = whole.select(*group, bucket, *(F.coalesce(F.sum(f"__all_{n}").over(outer), F.lit(0)).alias(f"__ahead_{n}") for n in sums))
    within = base.withColumns({f"__in_{n}": F.coalesce(F.sum(f"__{n}").over(inner), F.lit(0)) for n in sums})
    out = within.join(ahead, [*group, bucket]).withColumns({n: F.col(f"__ahead_{n}") + F.col(f"__in_{n}") for n in sums})
    return out.drop(*(f"{p}{n}" for n in sums for p in ("__", "__in_", "__ahead_")))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """A join whose left side may have hot keys: its rows are dealt over ``salts`` copies of the right side's.

    The right side has one row a key, so copies cost little; ``spread`` tells the left side's rows apart.
    """
    a = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "__salt"], how).drop("__salt")
