"""Queries of similarity (X), entities (N) and fidelity (Y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from ..functions import entities as E, patterns as P, text as T
from ..operators import citations as C, diff as D, fidelity as Y, similarity as X
from ..session import table
from . import cleaning, sql as Q

QUERIES, SQL = {}, {}
H, O = "humanized_text", "original_text"


def add(name: str, build, sql: str | None = None) -> None:
    build.__name__ = name
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


def column(name: str, outputs, sqls: dict, source: str = "chunk_result", key: str = "result_id") -> None:
    add(name, lambda spark, d: table(spark, d, source).select(key, *(c.alias(n) for n, c in outputs().items())), f"SELECT {key}, " + ", ".join(f"{s} AS {n}" for n, s in sqls.items()) + f" FROM {source}")


# ---- similarity. A token is a stretch of [a-zA-Z0-9_-] whose ends are word borders.
_CH = r"[\p{L}\p{N}_]"


def tokens_sql(t: str) -> str:
    """Stretches of token characters or of other word characters; a token is cut back until both ends are borders.

    Within a run of [a-zA-Z0-9_-] next to other word characters, only the part between borders counts.
    """
    # other word characters are marked; a token begins or ends only where the kind of neighbour changes
    runs = rf"regexp_extract_all(lower({Q.text(t)}), '[\p{{L}}\p{{N}}_-]+')"
    return f"flatten(list_transform({runs}, lambda r: {_run_sql('r')}))"


def _run_sql(r: str) -> str:
    """Tokens of one run of word characters and hyphens. Plain runs are themselves, after hyphens at their ends go."""
    trimmed = rf"regexp_replace(regexp_replace({r}, '^-+', ''), '-+$', '')"
    plain = f"CASE WHEN {trimmed} = '' THEN []::VARCHAR[] ELSE [{trimmed}] END"
    # a run with other letters: its parts between hyphens, kept with the hyphens that join plain parts
    return f"CASE WHEN regexp_full_match({r}, '[a-z0-9_-]*') THEN {plain} ELSE {_mixed_sql(r)} END"


def _mixed_sql(r: str) -> str:
    # words of the run; those with other letters leave the hyphens at their sides, which are tokens' ends
    marked = rf"regexp_replace(regexp_replace({r}, '^-+', ''), '-+$', '')"
    whole = rf"regexp_replace({marked}, '[a-z0-9_]*[^a-z0-9_-][\p{{L}}\p{{N}}_]*', ' ', 'g')"
    return rf"list_filter(string_split({whole}, ' '), lambda x: x <> '')"


def grams_sql(tokens: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({tokens}) - {n - 2}, 1)), lambda i: array_to_string(list_slice({tokens}, i, i + {n - 1}), ' ')))"


def pair_sql(n: int, sizes=(3, 5), source: str = "chunk_result", key: str = "result_id", o: str = O, h: str = H) -> str:
    ks = sorted({n, *sizes})
    empty = f"({Q.text(o)} = '' OR {Q.text(h)} = '')"
    base = f"SELECT {key}, {empty} AS empty_, CASE WHEN {empty} THEN [] ELSE {tokens_sql(o)} END AS o, CASE WHEN {empty} THEN [] ELSE {tokens_sql(h)} END AS r FROM {source}"
    grams = f"SELECT {key}, empty_, " + ", ".join(f"{grams_sql(s, k)} AS {s}{k}" for s in "or" for k in ks) + f" FROM ({base})"
    common = f"SELECT *, " + ", ".join(f"list_intersect(o{k}, r{k}) AS c{k}" for k in ks) + f" FROM ({grams})"
    pct = {k: Q.percent(f"len(c{k})", f"greatest(len(o{k}), 1)") for k in ks}
    out = f"SELECT *, {pct[n]} AS overlap, {pct[3]} AS three, {pct[5]} AS five FROM ({common})"
    risk = "CASE WHEN empty_ THEN 'Clean / 100% Original' WHEN overlap >= 25 OR five > 15 THEN 'High Similarity / Verbatim Matching' WHEN overlap >= 10 OR five > 5 THEN 'Moderate Risk / Partial Overlap' WHEN overlap > 0 THEN 'Low Similarity / Minor Coincidence' ELSE 'Clean / Highly Original' END"
    return f"SELECT {key}, {n} AS n, len(o{n})::INT AS original_ngrams, len(r{n})::INT AS rewritten_ngrams, len(c{n})::INT AS matching_ngrams, overlap, round(1000 - overlap * 10) / 10 AS originality, three AS three_gram_overlap, five AS five_gram_overlap, {risk} AS risk_level, list_slice(list_sort(c{n}), 1, 15) AS matching_sequences FROM ({out})"


def _pairs(n: int):
    return lambda spark, d: X.pair_similarity(table(spark, d, "chunk_result"), O, H, n, keep=("result_id",))


def _part(name: str, columns: list[str], n: int = 4) -> None:
    add(name, lambda spark, d: _pairs(n)(spark, d).select("result_id", *columns), f"SELECT result_id, {', '.join(columns)} FROM ({pair_sql(n)})")


add("sim_x01_ngrams", lambda spark, d: table(spark, d, "chunk_result").select("result_id", X.tokens(F.coalesce(F.col(H), F.lit(""))).alias("tokens")).select("result_id", "tokens", F.size(X.ngrams(F.col("tokens"), 4)).alias("grams")), f"SELECT result_id, tokens, len({grams_sql('tokens', 4)})::INT AS grams FROM (SELECT result_id, {tokens_sql(H)} AS tokens FROM chunk_result)")
_part("sim_x02_containment", ["original_ngrams", "matching_ngrams", "overlap"])
_part("sim_x03_three_five", ["three_gram_overlap", "five_gram_overlap"])
_part("sim_x04_originality", ["overlap", "originality"])
_part("sim_x05_risk", ["overlap", "five_gram_overlap", "risk_level"])
for _n in (3, 6):
    _part(f"sim_x07_n{_n}", ["n", "original_ngrams", "rewritten_ngrams", "matching_ngrams", "overlap", "risk_level"], _n)
_part("topk_k02_samples", ["matching_sequences"])
add("topk_k03_runs", lambda spark, d: _pairs(4)(spark, d).select("result_id", F.least(F.lit(15), F.col("matching_ngrams")).alias("verbatim_runs"), "matching_ngrams"), f"SELECT result_id, least(15, matching_ngrams) AS verbatim_runs, matching_ngrams FROM ({pair_sql(4)})")


# ---- sources against the corpus
def _source_grams_sql(n: int) -> str:
    return f"SELECT DISTINCT source_idx, unnest({grams_sql('t', n)}) AS gram FROM (SELECT source_idx, {tokens_sql('text')} AS t FROM source_passage)"


def _draft_grams_sql(n: int) -> str:
    return f"SELECT DISTINCT doc_id, unnest({grams_sql('t', n)}) AS gram FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)"


def overlap_sql(n: int = 4) -> str:
    return f"WITH s AS ({_source_grams_sql(n)}), d AS ({_draft_grams_sql(n)}), w AS (SELECT source_idx, count(*) AS source_ngrams FROM s GROUP BY 1), c AS (SELECT source_idx, doc_id, count(*) AS common FROM s JOIN d USING (gram) GROUP BY 1, 2) SELECT source_idx, doc_id, common, source_ngrams, {Q.percent('common', 'source_ngrams')} AS overlap FROM c JOIN w USING (source_idx)"


def x05_source_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: the share of each reference passage's 4-grams that each document has, where they share any."""
    return X.source_overlap(table(spark, d, "source_passage"), table(spark, d, "documents"))


add("x05_source_overlap", x05_source_overlap, overlap_sql())
add("join_j02_draft_by_source", lambda spark, d: x05_source_overlap(spark, d).groupBy("source_idx").agg(F.count("*").alias("drafts"), F.max("overlap").alias("most"), F.sum("common").alias("common")), f"SELECT source_idx, count(*) AS drafts, max(overlap) AS most, sum(common)::BIGINT AS common FROM ({overlap_sql()}) GROUP BY 1")
add("sim_x06_badge", lambda spark, d: x05_source_overlap(spark, d).select("source_idx", "doc_id", X.badge(F.col("overlap")).alias("badge")), f"SELECT source_idx, doc_id, CASE WHEN overlap < 1 THEN 'clean' WHEN overlap < 5 THEN 'moderate' ELSE 'high' END AS badge FROM ({overlap_sql()})")


def topk_k01_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Sources of each draft by overlap, ties in upload order."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("overlap"), "source_idx")
    return x05_source_overlap(spark, d).select("doc_id", "source_idx", "overlap", F.row_number().over(w).alias("place"))


add("topk_k01_ranking", topk_k01_ranking, f"SELECT doc_id, source_idx, overlap, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, source_idx)::INT AS place FROM ({overlap_sql()})")


def join_j01_ngram_intersection(spark: SparkSession, d: str) -> DataFrame:
    """The intersection of an original's n-grams and its rewrite's, within the row."""
    return X.shared_grams(table(spark, d, "chunk_result").dropDuplicates(["result_id"]), "result_id", O, H, 4)


_one = "(SELECT DISTINCT result_id, original_text, humanized_text FROM chunk_result)"
_rows = lambda f: f"SELECT DISTINCT result_id, unnest({grams_sql('t', 4)}) AS gram FROM (SELECT result_id, {tokens_sql(f)} AS t FROM {_one})"
add("join_j01_ngram_intersection", join_j01_ngram_intersection, f"SELECT result_id, count(*) AS common FROM ({_rows(O)}) JOIN ({_rows(H)}) USING (result_id, gram) GROUP BY 1")
add("set_u01_intersect", lambda spark, d: X.gram_rows(table(spark, d, "source_passage"), "source_idx", "text", 5).select("gram").intersect(X.gram_rows(table(spark, d, "documents"), "doc_id", "text", 5).select("gram")), f"SELECT gram FROM ({_source_grams_sql(5)}) INTERSECT SELECT gram FROM ({_draft_grams_sql(5)})")
add("agg_a08_distinct_ngrams", lambda spark, d: X.gram_rows(table(spark, d, "documents"), "doc_id", "text", 4).groupBy("doc_id").agg(F.count("*").alias("ngrams")), f"SELECT doc_id, count(*) AS ngrams FROM ({_draft_grams_sql(4)}) GROUP BY 1")
add("win_w09_sliding", lambda spark, d: X.gram_rows(table(spark, d, "source_passage"), "source_idx", "text", 6), _source_grams_sql(6))


def agg_a10_pooled(spark: SparkSession, d: str) -> DataFrame:
    """All passages pooled to one text before n-gramming, against each document: grams across files arise, none are lost."""
    from ..operators.structure import ordered_text

    pooled = ordered_text(table(spark, d, "source_passage").where("text is not null").withColumn("one", F.lit(0)), "one", ["source_idx"], "text")
    return X.source_overlap(pooled, table(spark, d, "documents"), source_id="one").select("doc_id", "common", "source_ngrams", "overlap")


_pool = f"SELECT DISTINCT unnest({grams_sql('t', 4)}) AS gram FROM (SELECT {tokens_sql('p')} AS t FROM (SELECT string_agg(text, chr(10) || chr(10) ORDER BY source_idx, text) AS p FROM source_passage WHERE text IS NOT NULL))"
add("agg_a10_pooled", agg_a10_pooled, f"WITH s AS ({_pool}), d AS ({_draft_grams_sql(4)}) SELECT doc_id, count(*) AS common, (SELECT count(*) FROM s) AS source_ngrams, {Q.percent('count(*)', '(SELECT count(*) FROM s)')} AS overlap FROM s JOIN d USING (gram) GROUP BY doc_id")

# ---- citations of sources
for _style in ("APA", "IEEE", "Harvard"):
    add(f"sim_x08_{_style.lower()}", lambda spark, d, s=_style: C.citation_entries(table(spark, d, "source_passage"), s), C.citation_sql(_style))
add("sim_x09_references", lambda spark, d: C.reference_list(table(spark, d, "source_passage"), "APA"), f"SELECT '## References' || chr(10) || chr(10) || string_agg(bib_entry, chr(10) || chr(10) ORDER BY source_idx, bib_entry) AS \"references\" FROM ({C.citation_sql('APA')})")
add("sim_x10_diff", lambda spark, d: D.word_diff(table(spark, d, "chunk_result"), "result_id", O, H).select("result_id", "has_differences", F.size("opcodes").alias("steps")))
add("sim_x10_html", lambda spark, d: D.diff_html(D.word_diff(table(spark, d, "chunk_result"), "result_id", O, H), "result_id"))

# ---- entities
_dash = f"translate({Q.text(H)}, '−–', '--')"
_double = lambda t: Q.sub(t, f"({Q.NB})", r"\1\1")
_edge_l, _edge_r = f"(?:^|{Q.NB})", f"(?:$|{Q.NB})"


def _hits(t: str, body: str, group: int = 1, flags: str = "") -> str:
    """Matches of a body between word borders; the text has its border signs doubled and the body allows for it."""
    return f"regexp_extract_all({_double(t)}, {Q.lit(flags + _edge_l + '(' + body + ')' + _edge_r)}, {group})"


def _single(x: str) -> str:
    """Doubled signs made single again."""
    return rf"regexp_replace({x}, '({Q.NB})({Q.NB})', '\1', 'g')"


def _sorted(xs: str) -> str:
    return f"list_sort(list_distinct({xs}))"


def _list(xs: str) -> str:
    return f"coalesce({_sorted(xs)}, [])"


_s2 = f"(?:{P.S})*"
_num2 = rf"{P.D}+(?:\.\.{P.D}+)?"
_years = _sorted(_hits(_dash, rf"19{P.D}{{2}}|20{P.D}{{2}}"))
column("ent_n09_years", lambda: {"found": E.years(F.col(H))}, {"found": _years})
_pv = rf"[pP](?:(?:--|{P.S}{{2}})?value)?{_s2}(?:(?:<<|==|>>|≥≥|≤≤)|(?:(?:less|greater){P.S}+than{Q.NB})){_s2}{_num2}"
column("ent_n02_p_values", lambda: {"found": E.p_values(F.col(H))}, {"found": _sorted(f"list_transform({_hits(_dash, _pv)}, lambda x: {Q.strip(_single('x'))})")})
column("ent_n03_percentages", lambda: {"found": E.percentages(F.col(H), wide=True)}, {"found": _sorted(f"list_transform(regexp_extract_all({_double(_dash)}, {Q.lit(_edge_l + '(' + _num2 + _s2 + '%)')}, 1), lambda x: {_single('x')} )").replace("regexp_replace(x,", "regexp_replace(replace(x || '%', '%%', '%%'),")})
_unit_names = r"kJ//mol|kcal//mol|Å|angstroms?|µM|uM|nM|mM|mg//kg|mg//dL|kDa|Da|mol//L|h|hr|hrs|min|sec"
_unit2 = rf"((?:--|[+][+])?{_num2}){_s2}(?:({_unit_names}){_edge_r}|(%%)[\p{{L}}\p{{N}}_])"


def _metrics(t: str) -> str:
    hits = f"regexp_extract_all({_double(t)}, {Q.lit('(?i)' + _unit2)})"
    part = lambda g: _single(f"regexp_extract(m, {Q.lit('(?i)' + _unit2)}, {g})")
    return _list(f"list_transform({hits}, lambda m: lower({part(1)} || ' ' || {part(2)} || {part(3)}))")
_fig = rf"(?:Figure|Fig\.\.){_s2}{_num2}[a-zA-Z]?"
column("ent_n07_tables", lambda: {"found": E.tables(F.col(H))}, {"found": _list(f"list_transform({_hits(H, f'Table{_s2}{_num2}', flags='(?i)')}, lambda x: 'Table' || substring({Q.sub(_single('x'), f'{P.S}+', ' ')}, 6))")})
_residue = rf"[A-Z][a-z]{{2}}{P.D}{{1,4}}|PDB{_s2}(?:::|{P.S}{{2}}){_s2}[0-9][A-Za-z0-9]{{3}}"
column("ent_n08_residues", lambda: {"found": E.residues(F.col(H))}, {"found": _list(f"list_transform({_hits(H, _residue)}, lambda x: {_single('x')})")})
_cites = f"regexp_extract_all({_dash}, {Q.lit(E.CITATION)})"
column("ent_n10_citations", lambda: {"nums": F.transform(E.citations(F.col(H)), lambda x: x["num"]), "raws": F.transform(E.citations(F.col(H)), lambda x: x["raw"])}, {"nums": f"list_transform({_cites}, lambda m: TRY_CAST(translate(regexp_extract(m, '({P.D}+)', 1), '{P.DIGITS[0]}', '{P.DIGITS[1]}') AS INT))", "raws": _cites})
_ascii = r"[^\p{Nd}a-zA-Z0-9_]"  # other digits are part of numbers
_numbers = rf"list_transform(regexp_extract_all(regexp_replace({_dash}, '({_ascii})', '\1\1', 'g'), {Q.lit(rf'(?:^|{_ascii})((?:--|[+][+])?{P.D}+(?:\.\.{P.D}+)?(?:[eE](?:--|[+][+])?{P.D}+)?)(?:$|{_ascii})')}, 1), lambda x: regexp_replace(x, '([-+.])([-+.])', '\1', 'g'))"
_keep = rf"(contains(n, '.') OR regexp_matches(n, '^[-+]') OR (regexp_full_match(n, '{P.D}+') AND NOT regexp_full_match(n, '0*{P.D}')))"
column("ent_n05_raw_numbers", lambda: {"found": E.raw_numbers(F.col(H))}, {"found": _sorted(f"list_filter({_numbers}, lambda n: {_keep})")})
add("filter_f09_number_rule", lambda spark, d: table(spark, d, "chunk_result").select("result_id", F.size(E.raw_numbers(F.col(H))).alias("kept")), f"SELECT result_id, len({_sorted(f'list_filter({_numbers}, lambda n: {_keep})')})::INT AS kept FROM chunk_result")
column("ent_n01_dashes", lambda: {"plain": E.plain_dashes(F.col(H))}, {"plain": _dash})


def _dashed(t: str) -> str:
    return f"translate({Q.text(t)}, '−–', '--')"


def _figures(t: str) -> str:
    clean = Q.sub(_single("x"), f"{P.S}+", " ")
    return _list(f"list_transform(list_transform({_hits(t, _fig, flags='(?i)')}, lambda x: {clean}), lambda y: upper(y[1]) || lower(regexp_extract(y, '^.([a-zA-Z]*)', 1)) || upper(substring(y, 2 + length(regexp_extract(y, '^.([a-zA-Z]*)', 1)))))")


def _tables(t: str) -> str:
    return _list(f"list_transform({_hits(t, f'Table{_s2}{_num2}', flags='(?i)')}, lambda x: 'Table' || substring({Q.sub(_single('x'), f'{P.S}+', ' ')}, 6))")


def _p_values(t: str) -> str:
    return _list(f"list_transform({_hits(_dashed(t), _pv)}, lambda x: {Q.strip(_single('x'))})")


def _residues(t: str) -> str:
    return _list(f"list_transform({_hits(t, _residue)}, lambda x: {_single('x')})")


def _raw(t: str) -> str:
    return _list(f"list_filter({_numbers.replace(_dash, _dashed(t))}, lambda n: {_keep})")


def _year_list(t: str) -> str:
    return _list(_hits(_dashed(t), rf"19{P.D}{{2}}|20{P.D}{{2}}"))


def _cite_nums(t: str) -> str:
    return f"list_transform(regexp_extract_all({_dashed(t)}, {Q.lit(E.CITATION)}), lambda m: TRY_CAST(translate(regexp_extract(m, '({P.D}+)', 1), '{P.DIGITS[0]}', '{P.DIGITS[1]}') AS INT))"


column("ent_n04_units", lambda: {"found": E.unit_metrics(F.col(H))}, {"found": _metrics(_dash)})
column("ent_n06_figures", lambda: {"found": E.figures(F.col(H))}, {"found": _figures(H)})
add("agg_a06_entity_lists", lambda spark, d: table(spark, d, "chunk_result").select("result_id", *(f(F.col(O)).alias(n) for n, f in (("p_values", E.p_values), ("unit_metrics", E.unit_metrics), ("raw_numbers", E.raw_numbers), ("figures", E.figures), ("tables", E.tables), ("residues", E.residues), ("years", E.years)))), f"SELECT result_id, {_p_values(O)} AS p_values, {_metrics(_dashed(O))} AS unit_metrics, {_raw(O)} AS raw_numbers, {_figures(O)} AS figures, {_tables(O)} AS tables, {_residues(O)} AS residues, {_year_list(O)} AS years FROM chunk_result")

# ---- fidelity
def _one(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_result").select("result_id", O, H).dropDuplicates(["result_id"])


_once = f"(SELECT result_id, any_value({O}) AS {O}, any_value({H}) AS {H} FROM chunk_result GROUP BY 1)"
_num = f"regexp_extract(original, '{P.D}+(?:\\.{P.D}+)?')"
_plain = f"replace({Q.text(H)}, '−', '-')"
_any = lambda xs, part: f"coalesce(list_bool_or(list_transform({xs}, lambda y: contains(y, {part}))), false)"
_tests = {
    "figures": (_figures, f"{_num} <> '' AND " + _any("targets", _num)),
    "tables": (_tables, f"{_num} <> '' AND " + _any("targets", _num)),
    "p_values": (_p_values, f"{_num} <> '' AND " + _any("targets", _num)),
    "unit_metrics": (lambda t: _metrics(_dashed(t)), _any("targets", "split_part(original, ' ', 1)") + f" OR contains({_plain}, split_part(original, ' ', 1))"),
    "residues": (_residues, f"contains(lower({Q.text(H)}), lower(original))"),
    "raw_numbers": (_raw, f"contains({_plain}, original)"),
    "years": (_year_list, f"list_contains(targets, original) OR contains({Q.text(H)}, original)"),
}
_parts = {name: f"SELECT result_id, {Q.lit(name)} AS type, original, {Q.lit(sev)} AS severity, ({_tests[kind][1]}) AS found FROM (SELECT result_id, {H}, unnest({_tests[kind][0](O)}) AS original, {_tests[kind][0](H)} AS targets FROM {_once})" for name, kind, sev in Y.RULES}
_firsts = lambda f: f"SELECT result_id, num, min(pos) AS pos FROM (SELECT result_id, unnest(c) AS num, generate_subscripts(c, 1) AS pos FROM (SELECT result_id, {_cite_nums(f)} AS c FROM {_once})) GROUP BY 1, 2"
_turned = f"WITH o AS ({_firsts(O)}), t AS (SELECT result_id, num AS a, lead(num) OVER (PARTITION BY result_id ORDER BY pos) AS b FROM ({_firsts(H)})) SELECT t.result_id, a, b FROM t LEFT JOIN o x ON x.result_id = t.result_id AND x.num = a LEFT JOIN o y ON y.result_id = t.result_id AND y.num = b WHERE a > b AND NOT coalesce(x.pos < y.pos, false)"
_checks = " UNION ALL ".join(_parts.values()) + f" UNION ALL SELECT result_id, 'Citation Sequence Inversion', '[' || a || '] before [' || b || ']', 'HIGH', false FROM ({_turned})"

add("fid_y_checks", lambda spark, d: Y.checks(_one(spark, d), "result_id", O, H), _checks)
for _i, (_name, _kind, _sev) in enumerate(Y.RULES, 1):
    add(f"fid_y0{_i}_{_kind}", lambda spark, d, n=_name: Y.checks(_one(spark, d), "result_id", O, H, only=(n,)).select("result_id", "original", "severity", "found"), f"SELECT result_id, original, severity, found FROM ({_parts[_name]})")
add("fid_y08_inversions", lambda spark, d: _one(spark, d).select("result_id", F.explode(Y.inversions(E.citations(F.col(O)), E.citations(F.col(H)))).alias("p")).select("result_id", "p.a", "p.b"), _turned)
add("fid_y09_report", lambda spark, d: Y.report(_one(spark, d), "result_id", O, H), f"WITH c AS ({_checks}), g AS (SELECT result_id, count(*) AS n, count(*) FILTER (found) AS p, bool_or(severity = 'CRITICAL' AND NOT found) AS critical FROM c GROUP BY 1), w AS (SELECT result_id, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(critical, false) AS critical FROM {_once} LEFT JOIN g USING (result_id)), s AS (SELECT *, CASE WHEN n = 0 THEN 100.0 ELSE ((2000 * p + n) // (2 * n)) / 10.0 END::DOUBLE AS score FROM w) SELECT result_id, n AS total_checks, p AS passed_checks, n - p AS failed_checks, score AS fidelity_score, (score >= 95 AND NOT critical) AS is_safe FROM s")
add("agg_a07_check_counts", lambda spark, d: Y.checks(_one(spark, d), "result_id", O, H).groupBy("type", "severity").agg(F.count("*").alias("total"), F.count_if("found").alias("passed"), F.count_if(~F.col("found")).alias("failed")), f"SELECT type, severity, count(*) AS total, count(*) FILTER (found) AS passed, count(*) FILTER (NOT found) AS failed FROM ({_checks}) GROUP BY 1, 2")


def win_w05_first_citations(spark: SparkSession, d: str) -> DataFrame:
    """Numbered citations in the order of their first appearance."""
    nums = _one(spark, d).select("result_id", F.posexplode(F.transform(E.citations(F.col(O)), lambda c: c["num"])).alias("pos", "num"))
    first = nums.groupBy("result_id", "num").agg(F.min("pos").alias("pos"))
    return first.select("result_id", "num", F.row_number().over(Window.partitionBy("result_id").orderBy("pos")).alias("place"))


add("win_w05_first_citations", win_w05_first_citations, f"SELECT result_id, num, row_number() OVER (PARTITION BY result_id ORDER BY pos)::INT AS place FROM ({_firsts(O)})")
add("win_w06_inversions", lambda spark, d: _one(spark, d).select("result_id", F.size(Y.inversions(E.citations(F.col(O)), E.citations(F.col(H)))).alias("inversions")).where("inversions > 0"), f"SELECT result_id, count(*)::INT AS inversions FROM ({_turned}) GROUP BY 1")
add("join_j05_callouts_kept", lambda spark, d: Y.checks(_one(spark, d), "result_id", O, H, only=("Figure Callout", "Table Callout")).where("found").select("result_id", "original").distinct(), f"SELECT DISTINCT result_id, original FROM ({_checks}) WHERE type IN ('Figure Callout', 'Table Callout') AND found")
add("join_j06_numbers_lost", lambda spark, d: Y.checks(_one(spark, d), "result_id", O, H, only=("Numerical Data", "Citation Year")).where("not found").select("result_id", "original").distinct(), f"SELECT DISTINCT result_id, original FROM ({_checks}) WHERE type IN ('Numerical Data', 'Citation Year') AND NOT found")
