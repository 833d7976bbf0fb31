"""Differences between two texts, word by word."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

OPCODE = StructType([StructField("tag", StringType()), *(StructField(n, IntegerType()) for n in ("i1", "i2", "j1", "j2")), StructField("before", StringType()), StructField("after", StringType())])


def word_diff(df: DataFrame, id_col: str, before: str, after: str) -> DataFrame:
    """``opcodes`` that turn the words of one text into the other's, and ``has_differences``.

    Frequent words of long texts don't anchor matches, as the standard matcher has it. Null texts count as empty.
    """
    kept = df.select(id_col, F.coalesce(before, F.lit("")).alias("a"), F.coalesce(after, F.lit("")).alias("b"))
    schema = StructType([kept.schema[id_col], StructField("has_differences", BooleanType()), StructField("opcodes", ArrayType(OPCODE))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lefts, rights = (c.to_pylist() for c in batch.columns)
            steps = []
            for left, right in zip(lefts, rights):
                x, y = left.split(), right.split()
                steps.append([{"tag": t, "i1": i1, "i2": i2, "j1": j1, "j2": j2, "before": " ".join(x[i1:i2]), "after": " ".join(y[j1:j2])} for t, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y).get_opcodes()])
            columns = (ids, [any(o["tag"] != "equal" for o in s) for s in steps], steps)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return kept.mapInArrow(run, schema)


def diff_html(diff: DataFrame, id_col: str) -> DataFrame:
    """The difference as HTML with ``del`` and ``ins``; text is escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = lambda o: F.when(o["tag"] == "equal", safe(o["before"])).otherwise(F.concat_ws(" ", F.when(o["before"] != "", F.concat(F.lit("<del>"), safe(o["before"]), F.lit("</del>"))), F.when(o["after"] != "", F.concat(F.lit("<ins>"), safe(o["after"]), F.lit("</ins>")))))
    return diff.select(id_col, "has_differences", F.array_join(F.transform("opcodes", part), " ").alias("html"))
