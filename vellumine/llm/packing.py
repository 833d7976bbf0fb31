"""Filling containers of a fixed capacity: bounded-space online best fit.

Items come in a fixed order; a fixed number of containers is open, kept in a bitset keyed by free space. An item goes
into the open container with the least free space that still holds it; where none does, a new one is opened, and when
too many are open the fullest closes first. Items above the capacity are cut into full containers and a rest.

At scale the items are dealt by hash into shards of bounded size, each packed by one task; the bound is a parameter of the
result, as another one deals the items otherwise. What is open when a shard ends is packed again as whole items in one
further round of the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from .tokens import TOKENIZER, token_counts


def best_fit(sizes: list[int], capacity: int, open_bins: int) -> tuple[list[int], set[int]]:
    """The container of each item, and the containers still open at the end. Sizes must not exceed the capacity."""
    bits, by_free, place, count, n_open = 0, {}, [], 0, 0
    for size in sizes:
        fitting = bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            stack = by_free[free]
            bin_ = stack.pop()
            if not stack:
                del by_free[free]
                bits ^= 1 << free
        else:
            if n_open == open_bins:
                least = (bits & -bits).bit_length() - 1
                stack = by_free[least]
                stack.pop(0)
                n_open -= 1
                if not stack:
                    del by_free[least]
                    bits ^= 1 << least
            bin_, free = count, capacity
            count += 1
            n_open += 1
        place.append(bin_)
        free -= size
        if free:
            by_free.setdefault(free, []).append(bin_)
            bits |= 1 << free
        else:
            n_open -= 1
    return place, {b for stack in by_free.values() for b in stack}


def _packed(df: DataFrame, key: list[str], capacity: int, open_bins: int) -> DataFrame:
    """Adds ``bin`` and ``is_open`` within each ``shard``; the order in a shard is that of the key's hash."""
    kept = df.select("shard", *key, "n_tokens")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable", ignore_index=True)
        order = pd.util.hash_pandas_object(pdf[key], index=False).argsort(kind="stable")
        pdf = pdf.iloc[order]
        place, still = best_fit(pdf["n_tokens"].tolist(), capacity, open_bins)
        return pdf.assign(bin=place, is_open=[b in still for b in place])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.groupBy("shard").applyInPandas(pack, f"{schema}, bin bigint, is_open boolean")


def pack_documents(docs: DataFrame, capacity: int = 2048, open_bins: int = 64, shard_items: int = 100_000, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every document to containers of ``capacity`` tokens.

    Columns: the id, ``piece`` (0, and further numbers only where a document exceeds the capacity), ``start_token``,
    ``n_tokens``, ``container``. A null or empty text has 0 tokens and still gets a place. Repeated and null ids are
    items of their own, told apart by a number given to each row, so each is placed and none shares a full container.
    ``shard_items`` bounds the items of a task and is part of the result's definition. An empty table gives an empty
    result. Other columns are ignored.
    """
    sizes = token_counts(docs, id_col, text_col, tokenizer=tokenizer).select(F.col(id_col).alias("id"), "n_tokens")
    sizes = checkpointed(sizes.withColumn("row", F.monotonically_increasing_id()))  # fixed once written
    pieces = sizes.select("id", "row", F.col("n_tokens").alias("all"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"int((n_tokens - 1) div {capacity})")))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.select("id", "row", "piece", start.alias("start_token"), F.least(F.lit(capacity).cast("long"), F.col("all") - start).alias("n_tokens"))
    full, rest = pieces.where(F.col("n_tokens") == capacity), pieces.where(F.col("n_tokens") < capacity)
    shards = max(1, -(-sizes.count() // shard_items))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("id", "row"), F.lit(shards)).cast("long"))
    first = checkpointed(_packed(dealt, ["id", "row", "piece", "start_token"], capacity, open_bins))

    left = first.where("is_open").groupBy("shard", "bin").agg(F.sum("n_tokens").alias("n_tokens"))
    shards2 = max(1, -(-shards * open_bins // shard_items))
    again = left.select(F.col("shard").alias("of"), "bin", "n_tokens", F.pmod(F.xxhash64("shard", "bin"), F.lit(shards2)).cast("long").alias("shard")).withColumnRenamed("bin", "was")
    second = _packed(again, ["of", "was"], capacity, open_bins).select(F.col("of").alias("shard"), F.col("was").alias("bin"), F.concat(F.lit("m"), F.col("shard"), F.lit("-"), F.col("bin")).alias("merged"))
    name = F.concat(F.lit("s"), F.col("shard"), F.lit("-"), F.col("bin"))
    columns = [F.col("id").alias(id_col), "piece", "start_token", "n_tokens", "container"]
    closed = first.where("not is_open").withColumn("container", name)
    merged = first.where("is_open").join(second, ["shard", "bin"], "left").withColumn("container", F.coalesce("merged", name))
    alone = full.withColumn("container", F.concat(F.lit("f"), F.col("row"), F.lit("-"), F.col("piece")))
    return closed.select(columns).unionByName(merged.select(columns)).unionByName(alone.select(columns))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, share of the capacity in use, and the fullest and emptiest container."""
    by = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return by.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * capacity), 4).alias("fill"), F.max("used").alias("most"), F.min("used").alias("least"), F.sum("items").alias("items"))
