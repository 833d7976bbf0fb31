"""Queries of file sources, by files written from the manuscripts' data and read again, and of cases that the tables lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import audit as A, entities as E, patterns as P, text as T
from ..operators import fidelity as Y, structure as S
from ..session import table
from ..sources import office as O
from ..sources.sinks import to_documents
from . import overlap, sql as Q

QUERIES, SQL = {}, {}


def add(name: str, build, sql: str) -> None:
    build.__name__ = name
    QUERIES[name] = build
    SQL[name] = sql


# ---- files: each manuscript's data becomes a file in memory, which the readers read
_title = lambda: F.coalesce("title", F.lit("untitled"))
_team = lambda: F.coalesce("team", F.lit("nobody"))
_file = lambda: F.coalesce("file_name", F.lit("none"))
_markdown = lambda: F.concat(F.lit("# "), _title(), F.lit("\n\n"), _team(), F.lit("\n\n| file | team |\n| --- | --- |\n| "), _file(), F.lit(" | "), _team(), F.lit(" |"))
_t, _w, _f = "coalesce(title, 'untitled')", "coalesce(team, 'nobody')", "coalesce(file_name, 'none')"
_nl = "chr(10) || chr(10)"


def _files(spark: SparkSession, d: str, kind: str, text: Column) -> DataFrame:
    made = to_documents(table(spark, d, "manuscript").select("doc_id", text.alias("text")), kind, "doc_id")
    return made.select(F.concat("name", F.lit(f".{kind}")).alias("path"), "content")


def _texts(files: DataFrame, tables: bool = True) -> DataFrame:
    return O.parse_documents(files, tables).select(F.split("path", r"\.")[0].cast("long").alias("doc_id"), "file_type", "text", "error")


def _text_sql(kind: str, text: str) -> str:
    return f"SELECT doc_id, '{kind}' AS file_type, {text} AS text, NULL::VARCHAR AS error FROM manuscript"


_ascii = lambda: F.regexp_replace(_title(), r"[^\x20-\x7e]", "?")
add("struct_s01_pdf", lambda spark, d: _texts(_files(spark, d, "pdf", _ascii())), _text_sql("pdf", f"regexp_replace({_t}, '[^\\x20-\\x7e]', '?', 'g')"))
add("struct_s02_word", lambda spark, d: _texts(_files(spark, d, "docx", _markdown())), _text_sql("docx", f"{_t} || {_nl} || {_w} || {_nl} || '| file | team |' || {_nl} || '| ' || {_f} || ' | ' || {_w} || ' |'"))
add("struct_s03_slides", lambda spark, d: _texts(_files(spark, d, "pptx", _title())), _text_sql("pptx", f"'# Slide 1: Slide 1' || {_nl} || {_t}"))
add("struct_s05_paragraphs", lambda spark, d: _texts(_files(spark, d, "docx", _markdown()), tables=False), _text_sql("docx", f"{_t} || {_nl} || {_w}"))


def struct_s04_plain(spark: SparkSession, d: str) -> DataFrame:
    """Plain text whose bytes are not all UTF-8: those that are not go."""
    broken = F.concat(F.encode(_title(), "utf-8"), F.unhex(F.lit("FFC3")), F.encode(F.lit(" end"), "utf-8"))
    return _texts(table(spark, d, "manuscript").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), broken.alias("content")))


add("struct_s04_plain", struct_s04_plain, _text_sql("txt", f"{_t} || ' end'"))


def struct_s07_word_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of Word files in document order."""
    return O.parse_docx_blocks(_files(spark, d, "docx", _markdown())).select(F.split("path", r"\.")[0].cast("long").alias("doc_id"), "block_idx", "type", "text", "level", "para_idx", "error")


_rows = f"| file | team |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {_f} || ' | ' || {_w} || ' |"
add(
    "struct_s07_word_blocks",
    struct_s07_word_blocks,
    f"""SELECT doc_id, 0::INT AS block_idx, 'heading' AS type, {_t} AS text, 1::INT AS level, 0::INT AS para_idx, NULL::VARCHAR AS error FROM manuscript
        UNION ALL SELECT doc_id, 1, 'paragraph', {_w}, 0, 1, NULL FROM manuscript
        UNION ALL SELECT doc_id, 2, 'table', '{_rows}', 0, NULL, NULL FROM manuscript""",
)


def struct_s07_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Files that are no Word files: a row each, which says so."""
    files = table(spark, d, "manuscript").select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), F.encode(_title(), "utf-8").alias("content"))
    return O.parse_docx_blocks(files).groupBy("error").agg(F.count("*").alias("files"))


add("struct_s07_unreadable", struct_s07_unreadable, "SELECT 'BadZipFile: File is not a zip file' AS error, count(*) AS files FROM manuscript")

# ---- cases that the tables have few or none of, as rows that both engines read
_PAIRS = """(VALUES
    (1, 'Ala123 and Gly7 bind PDB: 1abc. See Fig. 2A and Table 3; p < 0.05 at 12.5 mg/kg in 1998 [2].', 'Ala123 binds pdb: 1ABC near Fig. 2 and Table 4; p < 0.05 at 12.5 mg/kg in 1998 [2].'),
    (2, 'First [1], then [2], then [3] and [10].', 'Then [3] and [10], first [1], then [2].'),
    (3, 'First [2], then [1].', 'First [2], then [1].'),
    (4, 'Tyr45 was lost, as was PDB 2xyz.', 'Nothing was kept.'),
    (5, '', 'An answer to nothing [1].'), (6, CAST(NULL AS STRING), CAST(NULL AS STRING)), (7, 'None at all.', ''),
    (8, '[4] [3] [2] [1]', '[1] [2] [3] [4]'), (9, 'Trp1, Trp22, Trp333', 'trp1, TRP22 and Trp333')
    ) AS t(result_id, original_text, humanized_text)"""
_inline = f"(SELECT result_id, original_text, humanized_text FROM {_PAIRS})"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_PAIRS}")


def _inlined(sql: str) -> str:
    return sql.replace(overlap._once, _inline)


add("fid_y05_residues_cases", lambda spark, d: Y.checks(_pairs(spark, d), "result_id", overlap.O, overlap.H, only=("Residue / Structure Code",)).select("result_id", "original", "severity", "found"), _inlined(f"SELECT result_id, original, severity, found FROM ({overlap._parts['Residue / Structure Code']})"))
add("fid_y08_inversions_cases", lambda spark, d: _pairs(spark, d).select("result_id", F.explode(Y.inversions(E.citations(F.col(overlap.O)), E.citations(F.col(overlap.H)))).alias("p")).select("result_id", "p.a", "p.b"), _inlined(overlap._turned))
add("win_w06_inversions_cases", lambda spark, d: _pairs(spark, d).select("result_id", F.size(Y.inversions(E.citations(F.col(overlap.O)), E.citations(F.col(overlap.H)))).alias("inversions")).where("inversions > 0"), _inlined(f"SELECT result_id, count(*)::INT AS inversions FROM ({overlap._turned}) GROUP BY 1"))
add("fid_y_checks_cases", lambda spark, d: Y.checks(_pairs(spark, d), "result_id", overlap.O, overlap.H), _inlined(overlap._checks))
add("fid_y09_report_cases", lambda spark, d: Y.report(_pairs(spark, d), "result_id", overlap.O, overlap.H), _inlined(overlap.SQL["fid_y09_report"]))

_WORDS = "(VALUES (1, 'The World Health Organization (WHO), (NASA) and (abc).'), (2, '(TOOLONGX) (A) (AB) (A1)'), (3, ''), (4, CAST(NULL AS STRING)), (5, 'Again (WHO) and (WHO).')) AS t(doc_id, text)"
add("agg_a12_acronyms_cases", lambda spark, d: spark.sql(f"SELECT * FROM {_WORDS}").select("doc_id", F.explode(T.matches_of(F.col("text"), r"\(([A-Z]{2,6})\)", 1)).alias("acronym")).distinct(), f"SELECT DISTINCT doc_id, unnest(regexp_extract_all({Q.text('text')}, '\\(([A-Z]{{2,6}})\\)', 1)) AS acronym FROM {_WORDS}")

_LISTS = {"transitions": P.TRANSITIONS, "buzzwords": P.BUZZWORDS, "qualifiers": P.QUALIFIERS}
_listed = ", ".join(f"({Q.lit(w)}, {Q.lit('So: ' + w.upper() + ', they said; ' + w)})" for ws in _LISTS.values() for w in ws)
_LEXICON = f"(VALUES {_listed}) AS t(word, text)"
_spark_lexicon = "(VALUES " + ", ".join("('{}', '{}')".format(*(x.replace("\\", "\\\\").replace("'", "\\'") for x in (w, "So: " + w.upper() + ", they said; " + w))) for ws in _LISTS.values() for w in ws) + ") AS t(word, text)"
add("join_j09_lexicon_cases", lambda spark, d: spark.sql(f"SELECT * FROM {_spark_lexicon}").select("word", *(A.present(F.col("text"), ws, n != "qualifiers").alias(n) for n, ws in _LISTS.items())), "SELECT word, " + ", ".join(f"{Q.present('text', ws, whole=n != 'qualifiers')} AS {n}" for n, ws in _LISTS.items()) + f" FROM {_LEXICON}")

_MEDIA = "(VALUES (0, '', 0, false, false), (1, '  ', 0, true, false), (2, '', 0, false, true), (3, 'Figure 1: A view', 0, true, false), (4, 'Figure 2: A view', 0, false, false), (5, 'x = y', 0, false, true), (6, 'Plain text of a body that goes on for many more words than a cover line has.', 0, false, CAST(NULL AS BOOLEAN)), (7, 'Methods', 2, CAST(NULL AS BOOLEAN), false), (8, CAST(NULL AS STRING), 0, false, false)) AS t(block_idx, text, level, has_drawing, has_math)"
_media = lambda spark: spark.sql(f"SELECT * FROM {_MEDIA}")
_no_media = "NOT coalesce(has_drawing, false) AND NOT coalesce(has_math, false)"
add("filter_f01_media", lambda spark, d: _media(spark).where(~S.is_blank(F.col("text"), F.col("has_drawing"), F.col("has_math"))).select("block_idx", "text"), f"SELECT block_idx, text FROM {_MEDIA} WHERE NOT ({Q.strip(Q.text('text'))} = '' AND {_no_media})")
add("filter_f04_media", lambda spark, d: _media(spark).where(S.is_eligible(F.col("has_drawing"), F.col("has_math"))).select("block_idx"), f"SELECT block_idx FROM {_MEDIA} WHERE {_no_media}")
add("struct_s15_media", lambda spark, d: _media(spark).where("text is not null").select("block_idx", S.media_kind(F.col("text"), F.col("level"), F.col("has_drawing"), F.col("has_math")).alias("kind")), "SELECT * FROM (VALUES (0, 'body'), (1, 'drawing'), (2, 'math'), (3, 'drawing'), (4, 'figure_caption'), (5, 'math'), (6, 'body'), (7, 'heading')) AS t(block_idx, kind)")
