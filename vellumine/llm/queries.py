"""Queries of the training-data operators, p1 to p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from . import lookalikes, mixing, packing, pairs, quality, sentences, spans, splitting, truncation


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chunks(table(spark, sf_dir, "chunk")).where("pieces > 1").select("chunk_uid").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chunks(table(spark, sf_dir, "chunk"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "chunk_result"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pairs(spark, sf_dir).where("defect is not null").select("result_id", "defect")


def p2_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.calibration(table(spark, sf_dir, "chunk_result"))


def p3_units(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    chunk, result = table(spark, sf_dir, "chunk"), table(spark, sf_dir, "chunk_result")
    return sentences.sentences(chunk, "text", "chunk_uid", text=text).unionByName(sentences.sentences(result, "humanized_text", "result_id", F.col("ingested_at"), text=text))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_units(spark, sf_dir, text=False).select("field", "row_id", "start_pos")


def p4_forms(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    chunk, result = table(spark, sf_dir, "chunk"), table(spark, sf_dir, "chunk_result")
    counts = lookalikes.learn(chunk.select(F.col("text").alias("t")).unionByName(result.select(F.col("humanized_text").alias("t"))))
    a = lookalikes.forms(chunk, "text", "chunk_uid", counts, F.lit(None).cast("timestamp"), text)
    b = lookalikes.forms(result, "humanized_text", "result_id", counts, F.col("ingested_at").cast("timestamp"), text)
    return a.unionByName(b)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.same_look(p4_forms(spark, sf_dir, text=False))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_classes(p4_forms(spark, sf_dir, text=False))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "chunk_result"), order=F.col("ingested_at"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_records(spark, sf_dir).where("cut").select(F.col("row_id").alias("result_id"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(p5_records(spark, sf_dir))


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "chunk_result"), ["original_text", "humanized_text"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_spans(spark, sf_dir).select("field", F.col("row_id").alias("result_id")).distinct()


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_report(table(spark, sf_dir, "chunk_result"), p6_spans(spark, sf_dir), ["original_text", "humanized_text"])


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(table(spark, sf_dir, "documents")))


def p8_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(p8_order(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_statistics(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


# ---- what must hold of the results whatever the texts are; SQL can say these
def p1_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each chunk that is split: characters in its pieces, pieces missing, pieces over a limit."""
    over = (F.length("text") > splitting.MAX_CHARS) | (F.col("word_count") > splitting.MAX_WORDS)
    by = p1_pieces(spark, sf_dir).where("pieces > 1").groupBy("chunk_uid")
    return by.agg(F.sum(F.length("text")).alias("chars"), (F.max("pieces") - F.count_distinct("piece")).alias("missing"), F.count_if(over).alias("over"))


def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records judged, and those with a defect that is none of the five."""
    return p2_pairs(spark, sf_dir).agg(F.count("*").alias("records"), F.count_if(~F.col("defect").isin(*pairs.LABELS)).alias("strange"))


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each field: records with units."""
    return p3_found(spark, sf_dir).select("field", "row_id").distinct().groupBy("field").agg(F.count("*").alias("records"))


def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: records, and whether its cut ones are some of them."""
    return p5_rates(spark, sf_dir).select("source", "records", (F.col("cut").between(0, F.col("records")) & (F.abs(F.col("share") - F.col("cut") / F.col("records")) < 1e-4)).alias("sound"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each field: records with a text, their characters, and those with more shared than they have."""
    return p6_shares(spark, sf_dir).groupBy("field").agg(F.count("*").alias("records"), F.sum("n_chars").alias("chars"), F.count_if(F.col("shared_chars") > F.col("n_chars")).alias("over"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed, containers over the capacity, and documents cut though they fit."""
    packed = p7_containers(spark, sf_dir)
    used = packed.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > 2048).alias("over"))
    cut = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("all")).agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("all") <= 2048)).alias("cut"))
    return cut.crossJoin(F.broadcast(used))  # one row each


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that contribute, documents taken too often, and places in the order that are missing or taken twice."""
    mixed = p8_order(spark, sf_dir)
    often = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n")).join(table(spark, sf_dir, "mix_target"), "source")
    by = often.agg(F.count_distinct("source").alias("sources"), F.count_if(F.col("n") > F.col("max_repeats")).alias("too_often"))
    places = mixed.agg((F.count("*") - F.count_distinct("seq") + F.max("seq") + 1 - F.count("*")).alias("gaps"))
    return by.crossJoin(F.broadcast(places))  # one row each


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: its length, and whether its verdict is one of the four and has its reasons."""
    sound = F.col("kind").isin("prose", "list", "table") | ((F.col("kind") == "junk") & (F.size("reasons") > 0))
    return p9_statistics(spark, sf_dir).select("doc_id", "chars", sound.alias("sound"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p1_checks, p2_found, p2_pairs, p2_calibration, p2_checks, p3_found, p3_units, p3_checks, p4_found, p4_forms, p4_classes,
        p5_found, p5_records, p5_rates, p5_checks, p6_found, p6_spans, p6_shares, p6_checks, p7_containers, p7_fill, p7_checks, p8_order, p8_shares, p8_checks,
        p9_found, p9_statistics, p9_checks,
    )
}

_OVER = r"""length(text) > 3200
           OR len(list_filter(regexp_split_to_array(text, '[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '')) > 400"""
_ELIGIBLE = "NOT coalesce(skipped, false) AND NOT coalesce(is_protected, false) AND NOT coalesce(starts_with(lower(ltrim(status)), 'error'), false)"
_LETTERS = r"'[\p{L}\p{N}]'"
_CHARS = "SELECT '{0}' AS field, count(*) AS records, sum(n)::BIGINT AS chars, 0 AS over FROM (SELECT result_id, max(length({0})) AS n FROM chunk_result WHERE {0} IS NOT NULL GROUP BY 1)"

SQL: dict[str, str] = {
    "p1_found": f"SELECT DISTINCT chunk_uid FROM chunk WHERE {_OVER}",
    "p1_checks": f"SELECT chunk_uid, any_value(length(text)) AS chars, 0 AS missing, 0 AS over FROM chunk WHERE {_OVER} GROUP BY 1",
    "p2_checks": f"SELECT count(DISTINCT result_id) AS records, 0 AS strange FROM chunk_result WHERE {_ELIGIBLE}",
    "p3_checks": f"""SELECT 'text' AS field, count(DISTINCT chunk_uid) AS records FROM chunk WHERE regexp_matches(text, {_LETTERS})
        UNION ALL SELECT 'humanized_text', count(DISTINCT result_id) FROM chunk_result WHERE regexp_matches(humanized_text, {_LETTERS})""",
    "p5_checks": """SELECT source, count(*) AS records, true AS sound FROM (SELECT result_id, arg_max({'s': source}, coalesce(ingested_at, TIMESTAMP '1970-01-01')).s AS source
        FROM chunk_result GROUP BY 1) GROUP BY 1""",
    "p6_checks": " UNION ALL ".join(_CHARS.format(f) for f in ("original_text", "humanized_text")),
    "p7_checks": "SELECT count(*) AS documents, 0 AS cut, 0 AS over FROM documents",
    "p8_checks": """SELECT count(DISTINCT source) AS sources, 0 AS too_often, 0 AS gaps FROM documents JOIN mix_target USING (source)
        WHERE target_share > 0 AND max_repeats > 0 AND coalesce(text, '') <> ''""",
    "p9_checks": "SELECT doc_id, length(coalesce(text, '')) AS chars, true AS sound FROM documents",
}
