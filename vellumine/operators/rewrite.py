"""The place where a rewriter plugs in: text to text, per chunk, with retries and fallback.

``rewrite_chunks`` rewrites chunks each for itself; ``drive_documents`` goes through a document's chunks in their order and
hands each call the end of what the call before it gave.

The rewriter is any function of a pandas series; the default is the identity. Protected chunks never reach it: they are
filtered before the Python map and joined on again by union, since Catalyst moves no filter through such a map.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as P, text as T
from ..session import checkpointed


def identity(texts: pd.Series) -> pd.Series:
    return texts


def with_retries(call: Callable[[str], str], attempts: int = 3, pause: Callable[[float], None] = time.sleep, seed: int = 0) -> Callable[[str], str]:
    """Call again on failure, waiting 1.5 to the attempt's power, up to half more, at most 5 seconds."""
    chance = random.Random(seed)

    def run(text: str) -> str:
        for k in range(attempts):
            try:
                return call(text)
            except Exception:
                if k == attempts - 1:
                    raise
                pause(min(5.0, 1.5**k * (1 + chance.uniform(0, 0.5))))
        raise AssertionError

    return run


def _protected() -> Column:
    return F.coalesce(F.col("is_protected"), F.lit(False)) | F.coalesce(F.col("section_type").isin(*P.PROTECTED), F.lit(False))


def last_long(text: str, least: int = 4) -> str:
    """The last sentence of at least ``least`` words, else the last one: ``text.last_long_sentence`` in Python."""
    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]
    return next((s for s in reversed(parts) if len(s.split()) >= least), parts[-1] if parts else "")


def drive_documents(chunks: DataFrame, call: Callable[[str, str], str], attempts: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Each document's chunks in order: ``chunk_uid, doc_id, chunk_id, original_text, humanized_text, section_type, context,
    status, attempts, skipped, is_protected, word_count``.

    ``call`` gets a chunk's cleaned text and a context: the last long sentence that came out of the chunk before, or the
    chunk's own ``prev_context_tail`` where nothing came out yet. A failing call is made again, ``attempts`` times in all,
    then the original stays and ``status`` says why; so one chunk's failure holds up no other. Protected chunks are passed
    through and leave the context as it is. The order makes a document serial, as its calls are; its rows are sorted and
    streamed with a state of two values, so its size does not matter to memory. Null texts count as empty.
    """
    base = chunks.select("chunk_uid", "doc_id", "chunk_id", F.coalesce("text", F.lit("")).alias("original_text"), "section_type", _protected().alias("is_protected"), F.coalesce("prev_context_tail", F.lit("")).alias("context"))
    base = base.withColumn("clean", T.sanitize(F.col("original_text")))
    kept = [c for c in base.columns if c not in ("context", "clean")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields if f.name in kept) + ", context string, humanized_text string, status string, attempts int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tail = object(), ""
        for pdf in batches:
            out = []
            for doc, original, protected, context, clean in zip(pdf["doc_id"].tolist(), pdf["original_text"], pdf["is_protected"], pdf["context"], pdf["clean"]):
                if doc != now:
                    now, tail = doc, ""
                context = tail or context
                if protected:
                    out.append((context, original, "success", 0))
                    continue
                tries = [0]

                def once(text: str) -> str:
                    tries[0] += 1
                    return call(text, context)

                try:
                    made, status = with_retries(once, attempts, pause)(clean), "success"
                except Exception as e:
                    made, status = original, f"error: {e}"
                tail = last_long(made)
                out.append((context, made, status, tries[0]))
            yield pdf[kept].assign(**{n: [row[i] for row in out] for i, n in enumerate(("context", "humanized_text", "status", "attempts"))})

    done = base.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_id", "chunk_uid").mapInPandas(run, schema)
    tidy = F.when(~F.col("is_protected") & (F.col("status") == "success"), T.sanitize(T.clean_output(F.col("humanized_text")))).otherwise(F.col("humanized_text"))
    return done.withColumn("humanized_text", tidy).withColumn("skipped", F.col("is_protected")).withColumn("word_count", T.word_count(F.col("humanized_text")))


def rewrite_text(call: Callable[[str, str], str], df: DataFrame, text: str = "text", attempts: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Single texts, without chunks: the columns of ``df`` and ``rewritten``, ``status``."""
    one = checkpointed(df.withColumn("chunk_uid", F.monotonically_increasing_id()))  # ids fixed once written
    asked = one.select("chunk_uid", F.col("chunk_uid").alias("doc_id"), F.lit(0).alias("chunk_id"), F.col(text).alias("text"), F.lit("general").alias("section_type"), F.lit(False).alias("is_protected"), F.lit("").alias("prev_context_tail"))
    return one.join(drive_documents(asked, call, attempts, pause).select("chunk_uid", F.col("humanized_text").alias("rewritten"), "status"), "chunk_uid").drop("chunk_uid")


def rewrite_chunks(chunks: DataFrame, rewriter: Callable[[pd.Series], pd.Series] = identity, attempts: int = 1, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """``chunk_uid, doc_id, chunk_id, original_text, humanized_text, section_type, word_count, status, skipped, is_protected``.

    The rewriter gets texts cleaned of what is not seen, and each is called again ``attempts`` times in all. A failed call
    leaves the original and says so in ``status``. Null texts count as empty.
    """
    base = chunks.select("chunk_uid", "doc_id", "chunk_id", F.coalesce("text", F.lit("")).alias("original_text"), "section_type", _protected().alias("is_protected"))
    columns = [*base.columns, "humanized_text", "status"]
    asked = base.where("not is_protected").withColumn("clean", T.sanitize(F.col("original_text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                pdf["humanized_text"], pdf["status"] = rewriter(pdf["clean"]), "success"
            except Exception:  # one by one, so that a failure stays with its chunk
                texts, states = [], []
                single = with_retries(lambda t: rewriter(pd.Series([t])).iloc[0], attempts, pause)
                for t, clean in zip(pdf["original_text"], pdf["clean"]):
                    try:
                        texts.append(single(clean))
                        states.append("success")
                    except Exception as e:
                        texts.append(t)
                        states.append(f"error: {e}")
                pdf["humanized_text"], pdf["status"] = texts, states
            yield pdf[columns]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields) + ", humanized_text string, status string"
    done = asked.mapInPandas(run, schema)
    done = done.withColumn("humanized_text", F.when(F.col("status") == "success", T.sanitize(T.clean_output(F.col("humanized_text")))).otherwise(F.col("original_text"))).withColumn("skipped", F.lit(False))
    kept = base.where("is_protected").withColumn("humanized_text", F.col("original_text")).withColumn("status", F.lit("success")).withColumn("skipped", F.lit(True))
    return done.unionByName(kept).withColumn("word_count", T.word_count(F.col("humanized_text")))
