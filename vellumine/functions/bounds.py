"""Length bounds for rewriting, as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Named ranges of words (fixed values).
PRESETS = (("journal abstract", 250, 300), ("short abstract", 150, 250), ("micro summary", 100, 150), ("journal conclusion", 200, 350), ("thesis conclusion", 450, 700), ("executive takeaway", 120, 200), ("short section", 300, 500), ("standard section", 600, 1000), ("comprehensive section", 1200, 1800))


def bounds(words: Column, mode: str = "preserve", least: int | None = None, most: int | None = None) -> Column:
    """``low`` and ``high`` in words: kept, a quarter less, a quarter more, or a range of one's own."""
    w = words.cast("long")
    if mode == "target_range" and least is not None and most is not None:
        low, high = F.lit(least), F.lit(most)
    elif mode == "concise":
        low = high = F.greatest(F.lit(30), F.floor(w * 3 / 4))
    elif mode == "elaborate":
        low = high = F.floor(w * 5 / 4)
    else:
        low, high = F.greatest(F.lit(20), w - 15), w + 25
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))


def abstract_bounds(words: Column) -> Column:
    """Abstracts of 100 words or more are aimed at 200 to 300; shorter ones keep their length."""
    w = words.cast("long")
    own = F.struct(F.greatest(F.lit(200), F.least(w - 20, F.lit(250))).cast("int").alias("low"), F.greatest(F.lit(250), F.least(w + 30, F.lit(300))).cast("int").alias("high"))
    return F.when(w >= 100, own).otherwise(bounds(words))


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), "name string, low int, high int")
