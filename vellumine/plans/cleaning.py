"""Queries of cleaning (T) and of the style audit (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import audit as A, patterns as P, text as T
from ..operators import structure as S
from ..session import table
from . import sql as Q

QUERIES, SQL = {}, {}
H = "humanized_text"


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_result")


def add(name: str, build, sql: str | None = None) -> None:
    build.__name__ = name
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


def column(name: str, outputs, sqls: dict, source: str = "chunk_result", key: str = "result_id", where: str = "true") -> None:
    """A query of expressions over one table's rows; ``outputs`` makes them, as they need a session."""

    def build(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, source)
        return (rows if where == "true" else rows.where(where)).select(key, *(c.alias(n) for n, c in outputs().items()))

    add(name, build, f"SELECT {key}, " + ", ".join(f"{s} AS {n}" for n, s in sqls.items()) + f" FROM {source} WHERE {where}")


column("clean_t01_invisibles", lambda: {"removed": T.count_of(F.col(H), P.STRIP_CLASS), "cleaned": T.without_invisibles(F.col(H))}, {"removed": Q.count(H, P.STRIP_CLASS), "cleaned": Q.sub(H, P.STRIP_CLASS)})
column("clean_t02_spaces", lambda: {"normalized": T.count_of(F.col(H), P.SPACE_CLASS), "cleaned": T.plain_spaces(F.col(H))}, {"normalized": Q.count(H, P.SPACE_CLASS), "cleaned": Q.sub(H, P.SPACE_CLASS, " ")})
column("clean_t03_quotes", lambda: {"normalized": T.count_of(F.col(H), "[“”‘’«»…]"), "cleaned": T.plain_quotes(F.col(H))}, {"normalized": Q.count(H, "[“”‘’«»…]"), "cleaned": f"replace(translate({H}, '“”‘’«»', '\"\"''''\"\"'), '…', '...')"})
column("clean_t04_nfc", lambda: {"cleaned": T.sanitize(F.col(H))}, {"cleaned": f"nfc_normalize({Q.sub(Q.sub(Q.text(H), P.STRIP_CLASS), P.SPACE_CLASS, ' ')})"})
column("clean_t05_predicates", lambda: {"has_tag": F.coalesce(F.col(H), F.lit("")).rlike(P.TAG_CLASS), "has_private": F.coalesce(F.col(H), F.lit("")).rlike(P.PRIVATE_CLASS)}, {"has_tag": f"regexp_matches({Q.text(H)}, {Q.lit(P.TAG_CLASS)})", "has_private": f"regexp_matches({Q.text(H)}, {Q.lit(P.PRIVATE_CLASS)})"})
_marked = Q.text(H)
for _p, _to in T.MARKER_STEPS:
    _marked = Q.sub(_marked, _p, _to)
column("clean_t06_markers", lambda: {"cleaned": T.clean_markers(F.col(H))}, {"cleaned": Q.strip(_marked)})


def _output_sql(t: str, source: str = "chunk_result", key: str = "result_id") -> str:
    """The steps of ``clean_output`` as nested queries, each naming its result x."""
    fence = rf"(?s)^```(?:text|markdown|plain)?{P.S}*\n(.*?)```{P.S}*$"
    q = f"SELECT {key}, {Q.strip(Q.text(t))} AS x FROM {source}"
    q = f"SELECT {key}, CASE WHEN regexp_matches(x, {Q.lit(fence)}) THEN {Q.strip(f'regexp_extract(x, {Q.lit(fence)}, 1)')} ELSE x END AS x FROM ({q})"
    q = f"SELECT {key}, x, {Q.strip('substring(x, 2, greatest(0, length(x) - 2))')} AS y FROM ({q})"
    q = f"SELECT {key}, CASE WHEN length(x) >= 2 AND ((starts_with(x, '\"') AND ends_with(x, '\"')) OR (starts_with(x, '''') AND ends_with(x, ''''))) AND length(y) > 50 THEN y ELSE x END AS x FROM ({q})"
    for p in (*T.OPENINGS, *T.ENDINGS):
        q = f"SELECT {key}, {Q.strip(Q.sub('x', p.replace('(?iu)', '(?i)').replace('(?ius)', '(?is)')))} AS x FROM ({q})"
    for p in P.LEAKS:
        q = f"SELECT {key}, {Q.sub('x', '(?i)' + p)} AS x FROM ({q})"
    q = f"SELECT {key}, {Q.sub(Q.sub('x', chr(92) + 'n{3,}', chr(10) * 2), '[ ' + chr(92) + 't]{2,}', ' ')} AS x FROM ({q})"
    for p, to in T.MARKER_STEPS:
        q = f"SELECT {key}, {Q.sub('x', p, to)} AS x FROM ({q})"
    return f"SELECT {key}, {Q.strip('x')} AS cleaned FROM ({q})"


add("clean_t07_output", lambda spark, d: _results(spark, d).select("result_id", T.clean_output(F.col(H)).alias("cleaned")), _output_sql(H))
column("clean_t08_headings", lambda: {"cleaned": T.strip_headings(F.col("text"))}, {"cleaned": Q.sub("text", rf"(?m)^#{{1,6}}{P.S}+")}, "chunk", "chunk_uid")
_norm = Q.sub(Q.sub(Q.sub("text", rf"(?m)^(#{{1,6}}{P.S}+[^\n]*)$", "\n\n\\1\n\n"), rf"(?im)^((?:Figure|Fig\.|Table){P.S}+{P.D}+[^\n]*)$", "\n\n\\1\n\n"), r"\n{3,}", "\n\n")
column("clean_t09_blocks", lambda: {"normalized": T.normalize_blocks(F.col("text"))}, {"normalized": _norm}, "chunk", "chunk_uid")
_element = lambda kind, text, level: F.struct(F.lit(kind).alias("type"), text.alias("text"), level.alias("level"))
column(
    "clean_t10_assemble",
    lambda: {"text": S.assemble(F.array(_element("heading", F.coalesce("title", F.lit("untitled")), F.coalesce(F.pmod("page_count", F.lit(8)), F.lit(1))), _element("list_item", F.concat(F.lit("- • "), F.coalesce("file_name", F.lit(""))), F.lit(0)), _element("paragraph", F.coalesce("team", F.lit("")), F.lit(0))))},
    {"text": "repeat('#', greatest(1, least(6, coalesce(((page_count % 8) + 8) % 8, 1)))::INT) || ' ' || coalesce(title, 'untitled') || chr(10) || chr(10) || '- ' || regexp_replace('- • ' || coalesce(file_name, ''), '^[-*• ]+', '') || chr(10) || chr(10) || coalesce(team, '')"},
    "manuscript",
    "doc_id",
)

# the style audit
column("audit_p01_transitions", lambda: {"found": A.present(F.col(H), P.TRANSITIONS)}, {"found": Q.present(H, P.TRANSITIONS)})
column("audit_p02_buzzwords", lambda: {"found": A.present(F.col(H), P.BUZZWORDS)}, {"found": Q.present(H, P.BUZZWORDS)})
column("audit_p03_qualifiers", lambda: {"found": A.present(F.col(H), P.QUALIFIERS, bounded=False)}, {"found": Q.present(H, P.QUALIFIERS, whole=False)})
_leaks = "flatten([" + ", ".join(Q.find(H, "(?i)" + p) for p in P.LEAKS) + "])"
column("audit_p04_leaks", lambda: {"found": A.leaks(F.col(H))}, {"found": _leaks})
_gap = rf"(?:$|{Q.NB})"
_first = rf"(?i)(?:^|{Q.NB})"
_parallel = rf"{_first}(?:not  only{Q.NB}[^\n]*?{Q.NB}but  also|not  just{Q.NB}[^\n]*?{Q.NB}but  also|it  is  not{Q.NB}[^\n]*?{Q.NB}but{_gap}|rather  than{_gap})"
_sqls = {
    "negative_parallelisms": Q.count(Q.doubled(H), _parallel),
    "trailing_participles": Q.count(Q.doubled(H), rf"(?i),,{P.S}+(?:" + "|".join(Q.double(w) for w in P.PARTICIPLES) + f"){_gap}"),
    "em_dashes": f"({Q.occurrences(H, '—')} + {Q.occurrences(H, '--')})",
    "contractions": Q.count(Q.doubled(H), Q.bounded(P.CONTRACTIONS)),
    "first_second_person": Q.count(Q.doubled(H), Q.bounded(P.PERSONS)),
    "exclamations": Q.occurrences(H, "!"),
    "questions": Q.occurrences(H, "?"),
    "opinions": Q.count(Q.doubled(H), Q.bounded(P.OPINIONS)),
}
for _id, _n in (("p05", "negative_parallelisms"), ("p06", "trailing_participles"), ("p07", "em_dashes"), ("p08", "contractions"), ("p09", "first_second_person"), ("p11", "opinions")):
    column(f"audit_{_id}_{_n}", lambda n=_n: {n: A.counts(F.col(H))[n]}, {_n: _sqls[_n]})
column("audit_p10_marks", lambda: {n: A.counts(F.col(H))[n] for n in ("exclamations", "questions")}, {n: _sqls[n] for n in ("exclamations", "questions")})
_words = f"greatest({Q.words(H)}, 1)"
_sents = f"len({Q.sentences(H)})::INT"
column("audit_p12_sentences", lambda: {"words": F.greatest(T.word_count(F.col(H)), F.lit(1)), "sentences": T.sentence_count(F.col(H)), "mean_length": F.when(T.sentence_count(F.col(H)) > 0, T.one_decimal(F.greatest(T.word_count(F.col(H)), F.lit(1)), T.sentence_count(F.col(H)))).otherwise(0.0)}, {"words": _words, "sentences": _sents, "mean_length": f"CASE WHEN {_sents} > 0 THEN {Q.one_decimal(_words, _sents)} ELSE 0 END"})


def _audited(spark: SparkSession, d: str, field: str = H, source: str = "chunk_result", key: str = "result_id") -> DataFrame:
    base = table(spark, d, source).select(key, *(c.alias(n) for n, c in A.audit(F.col(field)).items()))
    return base.withColumn("triggers", A.triggers()).withColumn("score", A.score()).withColumn("level", A.level())


def audit_sql(field: str, source: str = "chunk_result", key: str = "result_id", extra: str = "") -> str:
    rename = lambda s: s.replace(H, field)
    inner = f"SELECT {key}{extra}, len({Q.present(field, P.TRANSITIONS)}) AS a, len({Q.present(field, P.BUZZWORDS)}) AS b, len({Q.present(field, P.QUALIFIERS, whole=False)}) AS c, len({rename(_leaks)}) AS e, " + ", ".join(f"{rename(s)} AS {n}" for n, s in _sqls.items()) + f", {rename(_words)} AS words FROM {source}"
    t = f"SELECT *, (a * 3 + b * 2 + c * 3 + e * 10 + negative_parallelisms * 2 + trailing_participles * 2 + CASE WHEN em_dashes > 3 THEN 1 ELSE 0 END + contractions * 2 + opinions * 4)::INT AS triggers FROM ({inner})"
    s = f"SELECT *, least(100.0, CASE WHEN words >= 50 THEN {Q.one_decimal('triggers * 1200', 'words')} ELSE triggers * 24.0 END)::DOUBLE AS score FROM ({t})"
    return f"SELECT *, CASE WHEN score >= 60 OR e > 0 THEN 'High AI Probability' WHEN score >= 25 THEN 'Moderate AI Signals' WHEN score > 0 THEN 'Low AI Markers' ELSE 'Clean / Human-like' END AS level FROM ({s})"


add("audit_p13_score", lambda spark, d: _audited(spark, d).select("result_id", "triggers", "words", "score"), f"SELECT result_id, triggers, words, score FROM ({audit_sql(H)})")
add("audit_p14_level", lambda spark, d: _audited(spark, d).select("result_id", "score", "level"), f"SELECT result_id, score, level FROM ({audit_sql(H)})")


def audit_p15_delta(spark: SparkSession, d: str) -> DataFrame:
    """Score before and after; both audits in one pass over the row, so the pair needs no join."""
    rows = _results(spark, d)
    one = lambda f: [c.alias(n) for n, c in A.audit(F.col(f)).items()]
    before = rows.select("result_id", H, *one("original_text")).withColumn("triggers", A.triggers()).withColumn("score", A.score()).select("result_id", H, F.col("score").alias("before"))
    after = before.select("result_id", "before", *one(H)).withColumn("triggers", A.triggers()).withColumn("score", A.score())
    return after.select("result_id", "before", F.col("score").alias("after"), (F.round((F.col("before") - F.col("score")) * 10) / 10).alias("delta"))


add("audit_p15_delta", audit_p15_delta, f"SELECT result_id, before, score AS after, round((before - score) * 10) / 10 AS delta FROM ({audit_sql(H, '(SELECT result_id, humanized_text, score AS before FROM (' + audit_sql('original_text', extra=', humanized_text') + '))', extra=', before')})")
add("audit_p16_band", lambda spark, d: _audited(spark, d).select("result_id", A.band(F.col("score")).alias("band")), f"SELECT result_id, CASE WHEN score >= 60 THEN 'red' WHEN score >= 25 THEN 'yellow' ELSE 'green' END AS band FROM ({audit_sql(H)})")
column("audit_p17_dashes", lambda: {"em": T.occurrences(F.col(H), "—"), "en": T.occurrences(F.col(H), "–"), "double": T.occurrences(F.col(H), "--")}, {"em": Q.occurrences(H, "—"), "en": Q.occurrences(H, "–"), '"double"': Q.occurrences(H, "--")})
_lengths = f"list_transform({Q.sentences('text')}, lambda s: {Q.words('s')}::BIGINT)"
_rhythm = f"SELECT doc_id, len(l)::INT AS sentences, CASE WHEN len(l) >= 2 THEN {Q.one_decimal('list_sum(l)', 'len(l)')} END AS mean_length, CASE WHEN len(l) >= 2 THEN floor(sqrt((len(l) * list_sum(list_transform(l, lambda x: x * x)) - list_sum(l) * list_sum(l))::DOUBLE / (len(l) * (len(l) - 1))::DOUBLE) * 10 + 0.5) / 10 END AS deviation FROM (SELECT doc_id, {_lengths} AS l FROM documents)"
add("audit_p18_rhythm", lambda spark, d: table(spark, d, "documents").select("doc_id", A.rhythm(F.col("text")).alias("r")).select("doc_id", "r.*"), f"SELECT *, CASE WHEN deviation >= 7 THEN 'high' WHEN deviation >= 4 THEN 'moderate' WHEN deviation IS NOT NULL THEN 'low' END AS label FROM ({_rhythm})")
