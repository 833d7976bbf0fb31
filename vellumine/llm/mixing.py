"""Mixing sources to target shares, with a curriculum over the run.

Each source has a weight schedule over the run's time 0..1, a piecewise linear rate. Its integral is the source's
cumulative demand for tokens. A document's place within its source (by a hash of its id, for each repeat anew) is a
token offset; inverting the cumulative demand at that offset gives its time, and a range sort of all sources by time gives
the training order. The total is the largest at which every source can meet its share with the repeats allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from ..operators.scale import prefix_sums
from ..session import checkpointed
from .tokens import TOKENIZER, token_counts

BUCKETS = 4096


def default_schedules(mix: DataFrame, ramp: float = 0.5) -> DataFrame:
    """Sources that repeat come more often late, the others early; at each time the rates sum to the shares' sum."""
    late = F.col("max_repeats") > 1
    every = Window.partitionBy(F.lit(0))  # one row a source
    shared = mix.select("source", late.alias("is_late"), F.sum(F.when(late, F.col("target_share")).otherwise(0.0)).over(every).alias("late"), F.sum(F.when(late, 0.0).otherwise(F.col("target_share"))).over(every).alias("early"))
    less = F.least("late", "early") * ramp
    slope = F.when((F.col("late") <= 0) | (F.col("early") <= 0), 0.0).when(F.col("is_late"), less / F.col("late")).otherwise(-less / F.col("early"))
    return shared.select("source", F.array(F.lit(0.0), F.lit(1.0)).alias("times"), F.array(1 - slope, 1 + slope).alias("rates"))


def mix_sources(docs: DataFrame, mix: DataFrame, schedules: DataFrame | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """The selected documents in training order.

    ``docs`` has ``doc_id, text, source``; ``mix`` has ``source, target_share, max_repeats``, one row a source;
    ``schedules`` has ``source, times ARRAY<DOUBLE>, rates ARRAY<DOUBLE>`` (times from 0 to 1). Columns: ``seq``
    (0-based place in training), ``at`` (time, 0..1), ``source``, ``doc_id``, ``repeat``, ``n_tokens``.
    Documents without a source, of a source that ``mix`` lacks, or without tokens are not selected; a source without
    documents gets none, and the others keep their proportions. Null or non-positive shares and repeats count as none.
    """
    mix = checkpointed(mix.where("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats"))  # read once
    schedules = default_schedules(mix) if schedules is None else schedules.select("source", "times", "rates")
    sizes = checkpointed(token_counts(docs.where("source is not null"), extra=("source",), tokenizer=tokenizer).where("n_tokens > 0"))
    there = sizes.groupBy("source").agg(F.sum("n_tokens").alias("there"))
    plan = mix.join(there, "source").withColumn("total", F.min(F.col("there") * F.col("max_repeats") / F.col("target_share")).over(Window.partitionBy(F.lit(0))))
    plan = plan.withColumn("demand", F.col("total") * F.col("target_share")).join(schedules, "source")
    # cumulative demand at the knots, as a share of the source's whole demand
    steps = F.expr("transform(sequence(1, size(times) - 1), i -> (times[i] - times[i - 1]) * (rates[i] + rates[i - 1]) / 2)")
    plan = plan.withColumn("steps", steps).withColumn("area", F.expr("aggregate(steps, 0d, (a, x) -> a + x)"))
    plan = plan.withColumn("sums", F.expr("transform(sequence(0, size(steps)), i -> aggregate(slice(steps, 1, i), 0d, (a, x) -> a + x))")).drop("steps")
    plan = checkpointed(plan.select("source", "there", "demand", "times", "rates", "area", "sums", F.ceil(F.col("demand") / F.col("there") - 1e-9).cast("int").alias("rounds")))

    drawn = sizes.join(plan.select("source", "there", "demand", "rounds"), "source").select("source", "doc_id", "n_tokens", "there", "demand", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("rounds") - 1))).alias("repeat"))
    drawn = drawn.withColumn("h", F.xxhash64("doc_id", "repeat")).withColumn("b", F.pmod("h", F.lit(BUCKETS)))
    offset = prefix_sums(drawn, ["source", "repeat"], "b", ["h", "doc_id"], {"before": F.col("n_tokens")}).withColumn("mid", F.col("before") + F.col("repeat") * F.col("there") + F.col("n_tokens") / 2)
    taken = offset.where("mid <= demand").select("source", "doc_id", "n_tokens", "repeat", "h", F.least(F.lit(1.0), F.col("mid") / F.col("demand")).alias("q"))

    timed = taken.join(plan.select("source", "times", "rates", "area", "sums"), "source").withColumn("y", F.col("q") * F.col("area")).withColumn("k", F.expr("greatest(1, least(size(sums) - 1, size(filter(sums, x -> x <= y))))"))
    timed = timed.select("source", "doc_id", "n_tokens", "repeat", "h", *(F.expr(e).alias(a) for a, e in (("t0", "times[k-1]"), ("w0", "rates[k-1]"), ("slope", "(rates[k] - rates[k-1]) / (times[k] - times[k-1])"), ("d", "y - sums[k-1]"))))
    # w0 * u + slope * u^2 / 2 = d, solved without cancellation
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("w0") * F.col("w0") + 2 * F.col("slope") * F.col("d")))
    timed = timed.withColumn("at", F.least(F.lit(1.0), F.col("t0") + F.when(F.col("d") <= 0, 0.0).otherwise(2 * F.col("d") / (F.col("w0") + root))))
    return range_sorted(timed.select("at", "h", "doc_id", "source", "repeat", "n_tokens"), ["at", "h", "doc_id", "source", "repeat"]).select("seq", "at", "source", "doc_id", "repeat", "n_tokens")


def range_sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows in partitions of rising ranges, each sorted, with their place ``seq`` in the whole order.

    The place is the row's within its partition and the rows of the partitions before; these are one row a partition.
    """
    rows = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("m", F.monotonically_increasing_id())
    rows = rows.withColumn("part", F.shiftright("m", 33)).withColumn("m", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("seq", F.col("before") + F.col("m")).drop("part", "m", "before")  # one row a partition


def share_report(mixed: DataFrame, mix: DataFrame) -> DataFrame:
    """For each source of ``mix``: tokens, documents, share reached, target, and the most repeats of a document."""
    by = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), (F.max("repeat") + 1).alias("repeats"))
    whole = Window.partitionBy(F.lit(0))
    return mix.select("source", "target_share", "max_repeats").join(by, "source", "left").fillna(0, ["tokens", "documents", "repeats"]).select("source", "target_share", "max_repeats", "tokens", "documents", "repeats", (F.col("tokens") / F.sum("tokens").over(whole)).alias("share"))
