"""Greedy packing of a document's blocks into chunks bounded by words.

A block opens a new chunk where protection changes, where the section changes within protected text, where the words
would exceed the bound, or where a main heading finds 200 words gathered. This depends on the chunk so far, so it is a
fold in document order: rows are sorted by document and read as a stream, with a state of a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..session import checkpointed


def chunk_numbers(blocks: DataFrame, doc: str, order: list[str], max_words: int = 400, heading_words: int = 200) -> DataFrame:
    """Doc, order columns and ``new_chunk`` for blocks with ``kind, level, word_count, section, is_protected``."""
    kept = blocks.select(doc, *order, "kind", "level", "word_count", "section", "is_protected")
    sorted_ = kept.repartition(doc).sortWithinPartitions(doc, *order)
    schema = StructType([f for f in kept.schema.fields if f.name in (doc, *order)] + [StructField("new_chunk", LongType())])
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, words, protected, section = object(), -1, 0, False, None
        for batch in batches:
            cols = batch.to_pydict()
            out = []
            for d, kind, level, w, s, p in zip(cols[doc], cols["kind"], cols["level"], cols["word_count"], cols["section"], cols["is_protected"]):
                table = kind == "table"
                if d != now:
                    now, number, split = d, 0, True
                else:
                    split = protected != p or words + w > max_words or (not table and (protected and section != s or kind == "heading" and level <= 2 and words >= heading_words))
                    number += split
                if split:
                    words, protected, section = 0, p, s
                words += w
                out.append(number)
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in (doc, *order)] + [pa.array(out, type=pa.int64())]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return sorted_.mapInArrow(pack, schema)


def pack_chunks(blocks: DataFrame, doc: str, order: list[str], max_words: int = 400) -> DataFrame:
    """Chunks: ``new_chunk``, words, blocks, section, protection, whether they hold tables, and the tail before them."""
    blocks = checkpointed(blocks.select(doc, *order, "kind", "level", "text", "word_count", "section", "is_protected"))  # read twice below
    numbered = blocks.join(chunk_numbers(blocks, doc, order, max_words), [doc, *order])
    mark = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.col("level"))), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    by = numbered.withColumn("m", mark).groupBy(doc, "new_chunk").agg(F.sum("word_count").alias("word_count"), F.count("*").alias("blocks"), F.min_by("section", F.struct(*order)).alias("section"), F.min_by("is_protected", F.struct(*order)).alias("is_protected"), F.bool_or(F.col("kind") == "table").alias("has_table"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "m"))), lambda x: x["m"]), "\n\n").alias("text"))
    # the chunk before has the number before: an equi-join, where a window would sort a document's texts in one task
    tails = by.select(doc, (F.col("new_chunk") + 1).alias("new_chunk"), T.tail_sentence(F.col("text")).alias("prev_context_tail"))
    return by.join(tails, [doc, "new_chunk"], "left").fillna("", ["prev_context_tail"])
