"""Queries of structure (S, C), filters (F), joins (J), aggregates (A), windows (W), top-k (K), sets (U) and rewriting (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from ..functions import audit as A, bounds as L, patterns as P, text as T
from ..operators import chunking as G, rewrite as R, structure as S
from ..operators.scale import prefix_sums
from ..session import table
from ..streaming.audit import audited
from . import cleaning, sql as Q

QUERIES, SQL = {}, {}
NL = "chr(10)"


def add(name: str, build, sql: str | None = None) -> None:
    build.__name__ = name
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").select("chunk_uid", "doc_id", "chunk_id", "text").dropDuplicates(["chunk_uid"])


_once = "(SELECT chunk_uid, any_value(doc_id) AS doc_id, any_value(chunk_id) AS chunk_id, any_value(text) AS text FROM chunk GROUP BY 1)"
_keys = ["chunk_uid", "doc_id", "chunk_id"]


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of all chunks, in document order by (chunk_id, block_idx); tables have their own kind."""
    rows = S.blocks(_chunks(spark, d), _keys)
    kind = F.when(F.col("text").startswith("|"), "table").when(S.is_list_item(F.col("text")), "list_item").otherwise(F.col("kind"))
    return rows.withColumn("kind", kind).withColumn("word_count", T.word_count(F.col("text"))).withColumn("bucket", F.expr("chunk_id div 64"))


_split = f"SELECT chunk_uid, doc_id, chunk_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS block_idx FROM (SELECT *, string_split({Q.text('text')}, {NL} || {NL}) AS p FROM {_once})"
_raw = f"SELECT chunk_uid, doc_id, chunk_id, block_idx::INT AS block_idx, raw, CASE WHEN starts_with(raw, '# ') THEN 1 WHEN starts_with(raw, '## ') THEN 2 WHEN starts_with(raw, '### ') THEN 3 ELSE 0 END AS level FROM (SELECT * REPLACE ({Q.strip('raw')} AS raw) FROM ({_split})) WHERE raw <> ''"
_plain = f"SELECT chunk_uid, doc_id, chunk_id, block_idx, level, CASE WHEN level > 0 THEN {Q.strip('substring(raw, level + 2)')} ELSE raw END AS text, CASE WHEN level > 0 THEN 'heading' ELSE 'paragraph' END AS kind FROM ({_raw})"
_blocks_sql = f"SELECT * REPLACE (CASE WHEN starts_with(text, '|') THEN 'table' WHEN starts_with(text, '- ') OR starts_with(text, '* ') OR starts_with(text, '• ') THEN 'list_item' ELSE kind END AS kind), {Q.words('text')} AS word_count FROM ({_plain})"
add("struct_s06_blocks", lambda spark, d: S.blocks(_chunks(spark, d), _keys), _plain)

# ---- tables
_lines = f"list_filter(list_transform(string_split({Q.text('text')}, {NL}), lambda x: {Q.strip('x')}), lambda x: starts_with(x, '|') AND NOT regexp_matches(x, {Q.lit(S.DIVIDER)}))"
_cells_sql = f"SELECT chunk_uid, row_idx, (generate_subscripts(c, 1) - 1)::INT AS col_idx, {Q.strip('unnest(c)')} AS cell FROM (SELECT chunk_uid, row_idx, string_split(regexp_replace(line, '^[|]+|[|]+$', '', 'g'), '|') AS c FROM (SELECT chunk_uid, (generate_subscripts(l, 1) - 1)::INT AS row_idx, unnest(l) AS line FROM (SELECT chunk_uid, {_lines} AS l FROM {_once})))"
add("struct_s09_cells", lambda spark, d: S.table_cells(_chunks(spark, d), ["chunk_uid"]), _cells_sql)
_line = lambda c: f"'| ' || array_to_string({c}, ' | ') || ' |'"
_md = f"WITH r AS (SELECT chunk_uid, row_idx, list(cell ORDER BY col_idx) AS c FROM ({_cells_sql}) GROUP BY 1, 2), w AS (SELECT chunk_uid, max(len(c)) AS w FROM r GROUP BY 1), p AS (SELECT chunk_uid, row_idx, w, {_line('list_concat(c, list_transform(range(w - len(c)), lambda i: ' + chr(39) * 2 + '))')} AS line FROM r JOIN w USING (chunk_uid)), g AS (SELECT chunk_uid, max(w) AS w, list(line ORDER BY row_idx) AS lines FROM p GROUP BY 1) SELECT chunk_uid, lines[1] || {NL} || {_line('list_transform(range(w), lambda i: ' + chr(39) + '---' + chr(39) + ')')} || CASE WHEN len(lines) > 1 THEN {NL} || array_to_string(lines[2:], {NL}) ELSE '' END AS markdown FROM g"
add("struct_s08_to_markdown", lambda spark, d: S.cells_to_markdown(S.table_cells(_chunks(spark, d), ["chunk_uid"]), ["chunk_uid"]), _md)
_is_table = lambda t: f"(len(list_filter(list_transform(string_split({t}, {NL}), lambda x: {Q.strip('x')}), lambda x: x <> '')) >= 2 AND list_bool_and(list_transform(list_filter(list_transform(string_split({t}, {NL}), lambda x: {Q.strip('x')}), lambda x: x <> ''), lambda x: starts_with(x, '|') AND ends_with(x, '|'))))"
add("struct_s10_is_table", lambda spark, d: S.blocks(_chunks(spark, d), _keys).select("chunk_uid", "block_idx", S.is_markdown_table(F.col("text")).alias("is_table")), f"SELECT chunk_uid, block_idx, {_is_table('text')} AS is_table FROM ({_plain})")
add("agg_a11_table_sizes", lambda spark, d: S.table_cells(_chunks(spark, d), ["chunk_uid"]).groupBy("chunk_uid").agg((F.max("row_idx") + 1).alias("rows"), (F.max("col_idx") + 1).alias("columns")), f"SELECT chunk_uid, max(row_idx) + 1 AS \"rows\", max(col_idx) + 1 AS \"columns\" FROM ({_cells_sql}) GROUP BY 1")


# ---- merging, slides, contents
def struct_s11_merge(spark: SparkSession, d: str) -> DataFrame:
    """Files of a team as one text, each under a heading with its name."""
    m = table(spark, d, "manuscript").dropDuplicates(["doc_id"]).withColumn("text", F.concat(F.lit("# Section: "), F.coalesce("file_name", F.lit("")), F.lit("\n\n"), F.coalesce("title", F.lit(""))))
    return S.ordered_text(m.where("team is not null"), "team", ["doc_id"], "text")


_m = "(SELECT doc_id, any_value(file_name) AS file_name, any_value(title) AS title, any_value(team) AS team FROM manuscript GROUP BY 1)"
add("struct_s11_merge", struct_s11_merge, f"SELECT team, string_agg('# Section: ' || coalesce(file_name, '') || {NL} || {NL} || coalesce(title, ''), {NL} || {NL} ORDER BY doc_id) AS text FROM {_m} WHERE team IS NOT NULL GROUP BY 1")
add("struct_s16_metadata", lambda spark, d: table(spark, d, "manuscript").drop("title", "team", "file_name"), "SELECT doc_id, file_type, lang, page_count, uploaded_at FROM manuscript")
_by_rule = f"regexp_split_to_array({Q.text('text')}, '(?m)^---[ \\t]*$')"
_by_head = f"list_filter(string_split(regexp_replace({Q.text('text')}, '(?m)^(#[ \\t\\n\\f\\r])', chr(1) || '\\1', 'g'), chr(1)), lambda s: {Q.strip('s')} <> '')"
_parts = f"SELECT doc_id, CASE WHEN len({_by_rule}) > 1 THEN {_by_rule} WHEN len({_by_head}) > 0 THEN {_by_head} ELSE [{Q.text('text')}] END AS p FROM documents"
_slides = f"SELECT doc_id, slide_idx, list_filter(list_transform(string_split(s, {NL}), lambda x: {Q.strip('x')}), lambda x: x <> '') AS l FROM (SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS slide_idx, unnest(p) AS s FROM ({_parts}))"
add("struct_s19_slides", lambda spark, d: S.slides(table(spark, d, "documents"), "doc_id"), f"SELECT doc_id, slide_idx, CASE WHEN len(list_filter(l, lambda x: starts_with(x, '#'))) > 0 THEN {Q.strip('regexp_replace(list_filter(l, lambda x: starts_with(x, ' + chr(39) + '#' + chr(39) + '))[-1], ' + chr(39) + '^#+' + chr(39) + ', ' + chr(39) * 2 + ')')} ELSE 'Slide ' || (slide_idx + 1) END AS title, list_filter(l, lambda x: NOT starts_with(x, '#')) AS body FROM ({_slides}) WHERE len(l) > 0")
add("struct_s22_plain_text", lambda spark, d: table(spark, d, "documents").select("doc_id", T.strip_headings(F.col("text")).alias("text")), f"SELECT doc_id, {Q.sub('text', f'(?m)^#{{1,6}}{P.S}+')} AS text FROM documents")


def _parts_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as the parts of their manuscripts."""
    return _chunks(spark, d).where("text is not null").withColumn("bucket", F.expr("chunk_id div 64"))


_whole = f"(SELECT doc_id, string_agg(text, {NL} || {NL} ORDER BY chunk_id, chunk_uid) AS text FROM {_once} WHERE text IS NOT NULL GROUP BY 1)"
_norm_pieces = f"SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS idx FROM (SELECT doc_id, string_split({cleaning._norm}, {NL} || {NL}) AS p FROM {_whole})"
_mark = rf"^(#{{1,4}}){P.S}+([^\n]*)$"
_heads = f"SELECT doc_id, idx, length(regexp_extract(raw, {Q.lit(_mark)}, 1)) AS level, {Q.strip(f'regexp_extract(raw, {Q.lit(_mark)}, 2)')} AS heading FROM (SELECT doc_id, idx, {Q.strip('raw')} AS raw FROM ({_norm_pieces})) WHERE regexp_matches(raw, {Q.lit(_mark)})"
_contents = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS place, level::INT AS level, heading, (2 + coalesce(sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS page, greatest(6, 62 - 8 * (level - 1) - length(heading))::INT AS dots, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_heads})"
add("struct_s23_contents", lambda spark, d: S.contents(_parts_in_order(spark, d), "doc_id", ["chunk_id", "chunk_uid"], "bucket"), f"SELECT * EXCLUDE (n) FROM ({_contents}) WHERE n >= 2")
add("win_w08_pages", lambda spark, d: S.contents(_parts_in_order(spark, d), "doc_id", ["chunk_id", "chunk_uid"], "bucket").groupBy("doc_id").agg(F.max("page").alias("last_page"), F.count("*").alias("entries")), f"SELECT doc_id, max(page) AS last_page, count(*) AS entries FROM ({_contents}) WHERE n >= 2 GROUP BY 1")

# ---- sections
_clean = Q.strip(Q.sub(Q.strip("lower(text)"), S.NUMBERING.replace("(?iu)", "(?i)")))
_section = "CASE " + " ".join(f"WHEN regexp_matches({_clean}, {Q.lit(f'(?:^|{Q.NB})(?:{P.alternatives(ws)})(?:$|{Q.NB})')}) THEN {Q.lit(n)}" for n, ws in P.SECTIONS.items()) + " ELSE 'general' END"
add("struct_c01_section_of", lambda spark, d: S.blocks(_chunks(spark, d), _keys).select("chunk_uid", "block_idx", S.section_of(F.col("text")).alias("section")), f"SELECT chunk_uid, block_idx, {_section} AS section FROM ({_plain})")
_edge = f"(?:$|{Q.NB})"
_found = f"SELECT *, {_section} AS f FROM ({_blocks_sql})"
_starts = f"SELECT *, (f IN ('abstract', 'introduction', 'methodology', 'literature_review') OR regexp_matches(text, {Q.lit(rf'(?i)^(?:chapter{P.S}+1{_edge}|1\.?{P.S}+[a-zA-Z]|introduction{_edge}|abstract{_edge})')})) AS st, chunk_id * 100000 + block_idx AS pos FROM ({_found})"
_firsts = f"SELECT *, min(CASE WHEN st THEN pos END) OVER (PARTITION BY doc_id) AS first FROM ({_starts})"
_changes = f"SELECT *, CASE WHEN first IS NULL OR pos < first THEN NULL WHEN pos = first THEN CASE WHEN f IN ('general', 'front_matter') THEN 'introduction' ELSE f END WHEN f = 'references' OR regexp_matches(text, {Q.lit(rf'(?i)^(?:references|bibliography|works cited|literature cited){_edge}')}) THEN 'references' WHEN level BETWEEN 1 AND 2 AND f NOT IN ('general', 'front_matter') THEN f END AS change FROM ({_firsts})"
_sections = f"SELECT *, section IN ('front_matter', 'references') AS is_protected FROM (SELECT *, coalesce(last_value(change IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'front_matter') AS section FROM ({_changes}))"
add("win_w01_body_start", lambda spark, d: S.sections(_blocks(spark, d)).groupBy("doc_id").agg(F.count_if(F.col("section") == "front_matter").alias("front_blocks"), F.count("*").alias("blocks")), f"SELECT doc_id, count(*) FILTER (section = 'front_matter') AS front_blocks, count(*) AS blocks FROM ({_sections}) GROUP BY 1")
add("win_w02_sections", lambda spark, d: S.sections(_blocks(spark, d)).select("chunk_uid", "block_idx", "section", "is_protected"), f"SELECT chunk_uid, block_idx, section, is_protected FROM ({_sections})")

# ---- packing
_order = ["chunk_id", "block_idx"]
_ranked = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM ({_sections})"
_fold = f"""WITH RECURSIVE b AS MATERIALIZED ({_ranked}), f AS (
  SELECT doc_id, rn, chunk_id, block_idx, 0::BIGINT AS new_chunk, word_count::BIGINT AS words, is_protected AS p, section AS s FROM b WHERE rn = 1
  UNION ALL
  SELECT doc_id, rn, chunk_id, block_idx, CASE WHEN cut THEN n + 1 ELSE n END, CASE WHEN cut THEN word_count ELSE words + word_count END, CASE WHEN cut THEN is_protected ELSE p END, CASE WHEN cut THEN section ELSE s END FROM (
    SELECT b.*, f.new_chunk AS n, f.words, f.p, f.s, (f.p <> b.is_protected OR f.words + b.word_count > 400 OR (b.kind <> 'table' AND ((f.p AND f.s <> b.section) OR (b.kind = 'heading' AND b.level <= 2 AND f.words >= 200)))) AS cut
    FROM f JOIN b ON b.doc_id = f.doc_id AND b.rn = f.rn + 1))"""
add("win_w03_packing", lambda spark, d: G.chunk_numbers(S.sections(_blocks(spark, d)), "doc_id", _order), f"{_fold} SELECT doc_id, chunk_id, block_idx, new_chunk FROM f")
_tail_lines = lambda t: f"list_filter(list_transform(string_split({Q.text(t)}, {NL}), lambda x: {Q.strip('x')}), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '|'))"
_tail = lambda t: f"coalesce({Q.sentences(f'array_to_string({_tail_lines(t)}, {chr(39)} {chr(39)})')}[-1], '')"
_packed = f"{_fold}, g AS (SELECT f.doc_id, new_chunk, sum(b.word_count)::BIGINT AS word_count, count(*) AS blocks, arg_min(b.section, b.pos) AS section, arg_min(b.is_protected, b.pos) AS is_protected, bool_or(b.kind = 'table') AS has_table, string_agg(CASE WHEN b.kind = 'heading' THEN repeat('#', greatest(1, level)::INT) || ' ' || text ELSE text END, {NL} || {NL} ORDER BY b.pos) AS text FROM f JOIN b ON b.doc_id = f.doc_id AND b.rn = f.rn GROUP BY 1, 2)"
_tailed = f"{_packed}, t AS (SELECT *, {_tail('text')} AS tail FROM g) SELECT * EXCLUDE (tail), lag(tail, 1, '') OVER (PARTITION BY doc_id ORDER BY new_chunk) AS prev_context_tail FROM t"
add("struct_c02_chunker", lambda spark, d: G.pack_chunks(S.sections(_blocks(spark, d)), "doc_id", _order), _tailed)
add("win_w04_tails", lambda spark, d: G.pack_chunks(S.sections(_blocks(spark, d)), "doc_id", _order).select("doc_id", "new_chunk", "prev_context_tail"), f"SELECT doc_id, new_chunk, prev_context_tail FROM ({_tailed})")

# ---- captions, profile, context
_paras = f"SELECT chunk_uid, {Q.strip('unnest(string_split(' + Q.text('text') + f', {NL} || {NL}))')} AS p FROM {_once}"
_fig, _tbl = (x.replace("(?iu)", "(?i)") for x in (P.FIGURE_CAPTION, P.TABLE_CAPTION))
_mention = lambda stem: rf"(?i)(?:^|{Q.NB})(?:{stem})(?:{P.S})*({P.D}+[a-zA-Z]?(?:(?:--|\.\.){P.D}+)?){_edge}"
_own = f"SELECT chunk_uid, 'figure' AS kind, lower(regexp_extract(p, {Q.lit(_fig)}, 1)) AS ref, true AS c FROM q WHERE f UNION ALL SELECT chunk_uid, 'table', lower(regexp_extract(p, {Q.lit(_tbl)}, 1)), true FROM q WHERE t AND NOT f"
_ref = lambda kind, stem: rf"SELECT chunk_uid, '{kind}', lower(regexp_replace(unnest(regexp_extract_all({Q.doubled('p')}, {Q.lit(_mention(stem))}, 1)), '([-.])[-.]', '\1', 'g')), false FROM q WHERE NOT f AND NOT t"
_captions = f"WITH q AS (SELECT chunk_uid, p, regexp_matches(p, {Q.lit(_fig)}) AS f, regexp_matches(p, {Q.lit(_tbl)}) AS t FROM ({_paras}) WHERE p <> ''), x AS ({_own} UNION ALL {_ref('figure', r'figure|fig(?:\.\.)?')} UNION ALL {_ref('table', r'table|tbl(?:\.\.)?')}) SELECT chunk_uid, kind, ref, bool_or(c) AS captioned, bool_or(NOT c) AS referenced FROM x WHERE ref <> '' GROUP BY 1, 2, 3"
add("struct_c05_captions", lambda spark, d: S.captions_and_references(_chunks(spark, d), "chunk_uid"), _captions)
_refs = lambda spark, d: S.captions_and_references(_chunks(spark, d), "chunk_uid")
add("join_j03_uncited_captions", lambda spark, d: _refs(spark, d).where("captioned and not referenced").select("chunk_uid", "kind", "ref"), f"SELECT chunk_uid, kind, ref FROM ({_captions}) WHERE captioned AND NOT referenced")
add("join_j04_uncaptioned_references", lambda spark, d: _refs(spark, d).where("referenced and not captioned").select("chunk_uid", "kind", "ref"), f"SELECT chunk_uid, kind, ref FROM ({_captions}) WHERE referenced AND NOT captioned")
add("struct_c09_references", lambda spark, d: _refs(spark, d).where("referenced").groupBy("chunk_uid", "kind").agg(F.array_sort(F.collect_list("ref")).alias("refs")), f"SELECT chunk_uid, kind, list(ref ORDER BY ref) AS refs FROM ({_captions}) WHERE referenced GROUP BY 1, 2")


def set_u02_except(spark: SparkSession, d: str) -> DataFrame:
    """Caption ids less reference ids over the corpus."""
    r = _refs(spark, d)
    return r.where("captioned").select("kind", "ref").subtract(r.where("referenced").select("kind", "ref"))


add("set_u02_except", set_u02_except, f"WITH r AS ({_captions}) SELECT kind, ref FROM r WHERE captioned EXCEPT SELECT kind, ref FROM r WHERE referenced")
_kinds = f"list_transform(b, lambda b: CASE WHEN regexp_matches(b, '^#{{1,4}}{P.S}+[^\\n]*$') THEN 'heading' WHEN regexp_matches(b, {Q.lit(_fig)}) THEN 'figure' WHEN regexp_matches(b, {Q.lit(_tbl)}) THEN 'table_caption' WHEN starts_with(b, '|') AND contains(b, {NL} || '|') THEN 'table' ELSE 'other' END)"
_n = lambda k: f"len(list_filter(k, lambda k: k = '{k}'))::INT"
_profile = f"WITH a AS (SELECT doc_id, {cleaning._norm} AS norm FROM documents), b AS (SELECT doc_id, {Q.words('norm')} AS w, list_filter(list_transform(string_split(norm, {NL} || {NL}), lambda x: {Q.strip('x')}), lambda x: x <> '') AS b FROM a), c AS (SELECT *, {_kinds} AS k FROM b) SELECT doc_id, w AS total_words, len(b)::INT AS total_blocks, {_n('heading')} AS heading_count, {_n('figure')} AS figure_count, {_n('table_caption')} AS table_caption_count, {_n('table')} AS markdown_tables_count, greatest(1.0, {Q.one_decimal('w', '450')})::DOUBLE AS estimated_pages, greatest(1, round_even(w / 220, 0))::INT AS reading_time_min FROM c"
add("struct_c04_profile", lambda spark, d: S.profile(table(spark, d, "documents"), "doc_id"), _profile)
add("agg_a09_structure_counts", lambda spark, d: S.profile(table(spark, d, "documents"), "doc_id").agg(*(F.sum(c).alias(c) for c in ("heading_count", "figure_count", "table_caption_count", "markdown_tables_count"))), f"SELECT sum(heading_count)::BIGINT AS heading_count, sum(figure_count)::BIGINT AS figure_count, sum(table_caption_count)::BIGINT AS table_caption_count, sum(markdown_tables_count)::BIGINT AS markdown_tables_count FROM ({_profile})")


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with their place in the document."""
    return prefix_sums(_blocks(spark, d), ["doc_id"], "bucket", ["chunk_id", "chunk_uid", "block_idx"], {"place": F.lit(1)})


_places = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, chunk_uid, block_idx) - 1 AS place FROM ({_blocks_sql})"
_first40 = f"SELECT *, {Q.words('text')} AS w FROM ({_places}) WHERE place < 40"
_context = f"WITH b AS ({_first40}), t AS (SELECT doc_id, arg_min(text, place) AS title, min(place) AS first_at FROM b WHERE w BETWEEN 4 AND 24 AND NOT ends_with(text, '.') GROUP BY 1), h AS (SELECT doc_id, array_to_string(list(text ORDER BY place)[1:5], ', ') AS headings FROM b LEFT JOIN t USING (doc_id) WHERE level > 0 AND (first_at IS NULL OR place <> first_at) GROUP BY 1), a AS (SELECT doc_id, array_to_string(list(a ORDER BY a)[1:10], ', ') AS acronyms FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\(([A-Z]{{2,6}})\\)', 1)) AS a FROM b) GROUP BY 1) SELECT doc_id, concat_ws({NL}, 'Manuscript Title: ' || title, 'Major Sections / Headings: ' || headings, 'Established Acronyms: ' || acronyms) AS context FROM (SELECT DISTINCT doc_id FROM b) LEFT JOIN t USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN a USING (doc_id)"
add("struct_c03_context", lambda spark, d: S.context(_numbered(spark, d), "doc_id", "place"), _context)
add("agg_a12_acronyms", lambda spark, d: _numbered(spark, d).where("place < 40").select("doc_id", F.explode(T.matches_of(F.col("text"), r"\(([A-Z]{2,6})\)", 1)).alias("acronym")).distinct(), f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\(([A-Z]{{2,6}})\\)', 1)) AS acronym FROM ({_first40})")
add("topk_k05_first_blocks", lambda spark, d: _numbered(spark, d).where("place < 40").groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum("word_count").alias("words")), f"SELECT doc_id, count(*) AS blocks, sum(w)::BIGINT AS words FROM ({_first40}) GROUP BY 1")

# ---- filters
_texts = f"({_plain})"
_leader = rf"\.{{4,}}{P.S}*(?:Page{P.S}*)?{P.D}+$"
_cover = "|".join(("department", "university", "faculty", "submitted by", "advisor", "supervisor", "dated", "session", "campus", "karachi", "certificate"))
_list_item = "(starts_with(text, '- ') OR starts_with(text, '* ') OR starts_with(text, '• '))"
_is_cover = f"(contains(text, '____') OR contains(text, '----') OR ({Q.words('text')} < 12 AND regexp_matches(lower(text), '{_cover}')))"
_is_fig, _is_tbl = f"regexp_matches(text, {Q.lit(_fig)})", f"regexp_matches(text, {Q.lit(_tbl)})"
_para_kind = f"CASE WHEN {_is_fig} THEN 'figure_caption' WHEN {_is_tbl} THEN 'table_caption' WHEN lower(text) = 'table of contents' THEN 'contents' WHEN regexp_matches(text, {Q.lit(_leader)}) THEN 'leader_line' WHEN level > 0 THEN 'heading' WHEN {_is_table('text')} THEN 'table' WHEN {_list_item} THEN 'list_item' WHEN {_is_cover} THEN 'cover' ELSE 'body' END"
_plain_blocks = lambda spark, d: S.blocks(_chunks(spark, d), _keys)
add("struct_s15_kinds", lambda spark, d: _plain_blocks(spark, d).select("chunk_uid", "block_idx", S.paragraph_kind(F.col("text"), F.col("level")).alias("kind")), f"SELECT chunk_uid, block_idx, {_para_kind} AS kind FROM {_texts}")
add("filter_f01_blank_blocks", lambda spark, d: _plain_blocks(spark, d).groupBy("chunk_uid").agg(F.count("*").alias("kept"), F.max("block_idx").alias("last_idx")), f"SELECT chunk_uid, count(*) AS kept, max(block_idx) AS last_idx FROM {_texts} GROUP BY 1")
add("filter_f02_empty_tables", lambda spark, d: S.cells_to_markdown(S.table_cells(_chunks(spark, d), ["chunk_uid"]), ["chunk_uid"]).where(F.regexp_replace("markdown", r"[|\s-]", "") != "").select("chunk_uid"), f"SELECT chunk_uid FROM ({_md}) WHERE regexp_replace(markdown, '[|\\s-]', '', 'g') <> ''")
add("filter_f03_protected", lambda spark, d: table(spark, d, "chunk").where(F.col("section_type").isin(*P.PROTECTED)).select("chunk_uid", "section_type"), "SELECT chunk_uid, section_type FROM chunk WHERE section_type IN ('front_matter', 'references')")
_elements = lambda spark, d: table(spark, d, "chunk").select("chunk_uid", F.explode("elements").alias("e")).select("chunk_uid", "e.*")
_elements_sql = "(SELECT chunk_uid, e.* FROM (SELECT chunk_uid, unnest(elements) AS e FROM chunk))"
add("filter_f04_eligible", lambda spark, d: _elements(spark, d).where("para_idx is not null and type <> 'table' and not coalesce(is_caption, false)").groupBy("chunk_uid").agg(F.count("*").alias("eligible")), f"SELECT chunk_uid, count(*) AS eligible FROM {_elements_sql} WHERE para_idx IS NOT NULL AND type <> 'table' AND NOT coalesce(is_caption, false) GROUP BY 1")
add("filter_f05_list_items", lambda spark, d: _plain_blocks(spark, d).where(S.is_list_item(F.col("text"))).select("chunk_uid", "block_idx", "text"), f"SELECT chunk_uid, block_idx, text FROM {_texts} WHERE {_list_item}")
_cap = lambda p: f"CASE WHEN regexp_matches(text, {Q.lit(p)}) THEN nullif(regexp_extract(text, {Q.lit(p)}, 1), '') END"
add("filter_f06_captions", lambda spark, d: _plain_blocks(spark, d).where(S.is_caption(F.col("text"))).select("chunk_uid", "block_idx", S.caption(F.col("text"), P.FIGURE_CAPTION)["id"].alias("figure_id"), S.caption(F.col("text"), P.TABLE_CAPTION)["id"].alias("table_id"), "text"), f"SELECT chunk_uid, block_idx, {_cap(_fig)} AS figure_id, {_cap(_tbl)} AS table_id, text FROM {_texts} WHERE {_is_fig} OR {_is_tbl}")
_style_level = lambda: F.when(F.lower("style") == "title", 1).otherwise(F.regexp_extract(F.lower("style"), r"heading\s*(\d+)", 1).cast("int"))
add("filter_f07_heading_level", lambda spark, d: _elements(spark, d).where(F.lower("style").startswith("heading") | (F.lower("style") == "title")).select("chunk_uid", "para_idx", _style_level().alias("level")), f"SELECT chunk_uid, para_idx, CASE WHEN lower(style) = 'title' THEN 1 ELSE regexp_extract(lower(style), 'heading\\s*(\\d+)', 1)::INT END AS level FROM {_elements_sql} WHERE starts_with(lower(style), 'heading') OR lower(style) = 'title'")
add("filter_f08_cover_lines", lambda spark, d: _plain_blocks(spark, d).where(S.is_cover_line(F.col("text"))).select("chunk_uid", "block_idx"), f"SELECT chunk_uid, block_idx FROM {_texts} WHERE {_is_cover}")
_ok = lambda: F.lower(F.trim("status"))
add("filter_f10_status", lambda spark, d: table(spark, d, "chunk_result").agg(F.count_if(_ok() == "success").alias("success"), F.count_if(_ok().startswith("error")).alias("errors"), F.count("*").alias("records")), "SELECT count(*) FILTER (lower(trim(status)) = 'success') AS success, count(*) FILTER (starts_with(lower(trim(status)), 'error')) AS errors, count(*) AS records FROM chunk_result")
_w = lambda c: T.word_count(F.col(c))
add("filter_f11_window", lambda spark, d: table(spark, d, "chunk_result").select("result_id", _w("humanized_text").alias("words"), L.bounds(_w("original_text")).alias("b")).where("words between b.low and b.high").select("result_id", "words"), f"SELECT result_id, {Q.words('humanized_text')} AS words FROM chunk_result WHERE {Q.words('humanized_text')} BETWEEN greatest(20, {Q.words('original_text')} - 15) AND {Q.words('original_text')} + 25")
add("filter_f12_tail_lines", lambda spark, d: _chunks(spark, d).select("chunk_uid", F.size(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), T.strip), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("|"))).alias("lines")), f"SELECT chunk_uid, len({_tail_lines('text')})::INT AS lines FROM {_once}")

# ---- joins
add("join_j07_chunks_and_results", lambda spark, d: _chunks(spark, d).select("doc_id", "chunk_id", "text").join(table(spark, d, "chunk_result").select("result_id", "doc_id", "chunk_id", "original_text").distinct(), ["doc_id", "chunk_id"]).select("result_id", "doc_id", "chunk_id", F.col("text").eqNullSafe(F.col("original_text")).alias("same")), f"SELECT result_id, doc_id, chunk_id, text IS NOT DISTINCT FROM original_text AS same FROM {_once} JOIN (SELECT DISTINCT result_id, doc_id, chunk_id, original_text FROM chunk_result) USING (doc_id, chunk_id)")


def _paragraphs(df: DataFrame, field: str, name: str) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), "\n\n"), T.strip), lambda p: p != "")
    return df.select("result_id", F.posexplode(parts).alias("ord", name))


def join_j08_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of original and rewrite by ordinal: rewritten, blanked (no partner left) or inserted (left over)."""
    r = table(spark, d, "chunk_result").dropDuplicates(["result_id"])
    both = _paragraphs(r, "original_text", "old").join(_paragraphs(r, "humanized_text", "new"), ["result_id", "ord"], "full_outer")
    return both.select("result_id", "ord", F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "blanked").otherwise("rewritten").alias("action"), T.strip(F.regexp_replace(F.coalesce("new", F.lit("")), rf"^#{{1,6}}{P.S}*", "")).alias("text"))


_r1 = "(SELECT result_id, any_value(original_text) AS original_text, any_value(humanized_text) AS humanized_text FROM chunk_result GROUP BY 1)"
_par = lambda f, n: f"SELECT result_id, unnest(p) AS {n}, (generate_subscripts(p, 1) - 1)::INT AS ord FROM (SELECT result_id, list_filter(list_transform(string_split({Q.text(f)}, {NL} || {NL}), lambda x: {Q.strip('x')}), lambda x: x <> '') AS p FROM {_r1})"
_zip = f"SELECT result_id, ord, CASE WHEN old IS NULL THEN 'inserted' WHEN new_ IS NULL THEN 'blanked' ELSE 'rewritten' END AS action, {Q.strip('regexp_replace(coalesce(new_, ' + chr(39) * 2 + '), ' + Q.lit(f'^#{{1,6}}{P.S}*') + ', ' + chr(39) * 2 + ')')} AS text FROM ({_par('original_text', 'old')}) FULL JOIN ({_par('humanized_text', 'new_')}) USING (result_id, ord)"
add("join_j08_paragraphs", join_j08_paragraphs, _zip)


def struct_s13_in_place(spark: SparkSession, d: str) -> DataFrame:
    """The rewrite put into the places of its paragraphs: each place rewritten, or blanked where the rewrite has ended, what
    is left over inserted behind the last; protected chunks are kept as they are. Pairs by ordinal, within the row."""
    r = table(spark, d, "chunk_result").dropDuplicates(["result_id"])
    kept = F.coalesce(F.col("is_protected"), F.lit(False))
    new = F.filter(F.transform(F.split(F.coalesce("humanized_text", F.lit("")), "\n\n"), T.strip), lambda x: x != "")
    pairs = F.posexplode(F.arrays_zip(F.coalesce("para_indices", F.array().cast("array<int>")).alias("place"), new.alias("new")))
    rows = r.select("result_id", kept.alias("kept"), pairs.alias("ord", "p")).select("result_id", "ord", "kept", F.col("p.place").alias("para_idx"), F.col("p.new").alias("new"))
    action = F.when(F.col("kept"), "kept").when(F.col("para_idx").isNull(), "inserted").when(F.col("new").isNull(), "blanked").otherwise("rewritten")
    text = F.when(F.col("kept"), None).otherwise(F.regexp_replace(F.coalesce("new", F.lit("")), rf"^#{{1,6}}{P.S}*", ""))
    return rows.select("result_id", "ord", "para_idx", action.alias("action"), text.alias("text"))


_places = "(SELECT result_id, any_value(humanized_text) AS h, any_value(coalesce(is_protected, false)) AS kept, any_value(para_indices) AS places FROM chunk_result GROUP BY 1)"
_new = f"list_filter(list_transform(string_split({Q.text('h')}, {NL} || {NL}), lambda x: {Q.strip('x')}), lambda x: x <> '')"
_zipped = f"SELECT result_id, kept, places, n, unnest(range(0, greatest(len(coalesce(places, [])), len(n)))) AS i FROM (SELECT *, {_new} AS n FROM {_places})"
add(
    "struct_s13_in_place",
    struct_s13_in_place,
    f"""SELECT result_id, i::INT AS ord, places[i + 1] AS para_idx,
        CASE WHEN kept THEN 'kept' WHEN places[i + 1] IS NULL THEN 'inserted' WHEN n[i + 1] IS NULL THEN 'blanked' ELSE 'rewritten' END AS action,
        CASE WHEN NOT kept THEN regexp_replace(coalesce(n[i + 1], ''), {Q.lit(f'^#{{1,6}}{P.S}*')}, '') END AS text FROM ({_zipped})""",
)


def join_j09_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Records by buzzword; the list unrolls into one row's expression, so the join needs no second table."""
    return table(spark, d, "chunk_result").select("result_id", F.explode(A.present(F.col("humanized_text"), P.BUZZWORDS)).alias("word")).groupBy("word").agg(F.count("*").alias("records"))


add("join_j09_lexicon", join_j09_lexicon, f"SELECT word, count(*) AS records FROM (SELECT unnest({Q.present('humanized_text', P.BUZZWORDS)}) AS word FROM chunk_result) GROUP BY 1")
add("join_j10_section_lookup", lambda spark, d: _plain_blocks(spark, d).where("level > 0").groupBy(S.section_of(F.col("text")).alias("section")).agg(F.count("*").alias("headings")), f"SELECT {_section} AS section, count(*) AS headings FROM {_texts} WHERE level > 0 GROUP BY 1")

# ---- aggregates
add("agg_a01_total_words", lambda spark, d: _chunks(spark, d).groupBy("doc_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"), F.count("*").alias("chunks")), f"SELECT doc_id, sum({Q.words('text')})::BIGINT AS words, count(*) AS chunks FROM {_once} GROUP BY 1")
add("agg_a02_section_types", lambda spark, d: table(spark, d, "chunk").groupBy("doc_id").agg(F.array_sort(F.collect_set("section_type")).alias("sections")), "SELECT doc_id, coalesce(list(DISTINCT section_type ORDER BY section_type) FILTER (section_type IS NOT NULL), []) AS sections FROM chunk GROUP BY 1")
add("agg_a03_pattern_counts", lambda spark, d: table(spark, d, "documents").groupBy("lang").agg(*(F.sum(c).alias(n) for n, c in A.counts(F.col("text")).items())), "SELECT lang, " + ", ".join(f"sum({s.replace('humanized_text', 'text')})::BIGINT AS {n}" for n, s in cleaning._sqls.items()) + " FROM documents GROUP BY 1")
add("agg_a04_triggers", lambda spark, d: cleaning._audited(spark, d, "text", "documents", "doc_id").select("doc_id", "triggers", "score", "level"), f"SELECT doc_id, triggers, score, level FROM ({cleaning.audit_sql('text', 'documents', 'doc_id')})")
add("agg_a05_sentence_lengths", lambda spark, d: table(spark, d, "documents").select("collection_id", A.rhythm(F.col("text")).alias("r")).groupBy("collection_id").agg(F.sum("r.sentences").alias("sentences"), F.max("r.mean_length").alias("longest_mean")), f"SELECT collection_id, sum(sentences)::BIGINT AS sentences, max(mean_length) AS longest_mean FROM ({cleaning._rhythm.replace('SELECT doc_id, len(l)', 'SELECT collection_id, len(l)').replace('SELECT doc_id, ', 'SELECT collection_id, ')}) GROUP BY 1")
add("agg_rollup_scores", lambda spark, d: audited(table(spark, d, "documents"), "text", ("lang", "source")).rollup("lang", "source").agg(F.count("*").alias("documents"), F.max("score").alias("most")), f"SELECT lang, source, count(*) AS documents, max(score) AS most FROM ({cleaning.audit_sql('text', 'documents', 'doc_id')}) JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id) GROUP BY ROLLUP (lang, source)")

# ---- top-k, sets
add("topk_k04_findings", lambda spark, d: table(spark, d, "documents").select("doc_id", F.slice(A.present(F.col("text"), P.BUZZWORDS), 1, 10).alias("first_ten")), f"SELECT doc_id, list_slice({Q.present('text', P.BUZZWORDS)}, 1, 10) AS first_ten FROM documents")
_first_line = lambda: F.get(F.filter(F.transform(F.split(F.substring(F.coalesce("text", F.lit("")), 1, 400), "\n"), T.strip), lambda x: x != ""), F.lit(0))
add("topk_k06_first_line", lambda spark, d: table(spark, d, "documents").select("doc_id", _first_line().alias("line"), F.substring("text", 1, 350).alias("head")), f"SELECT doc_id, list_filter(list_transform(string_split(substring({Q.text('text')}, 1, 400), {NL}), lambda x: {Q.strip('x')}), lambda x: x <> '')[1] AS line, substring(text, 1, 350) AS head FROM documents")
add("topk_k07_tail_sentence", lambda spark, d: _chunks(spark, d).select("chunk_uid", T.tail_sentence(F.col("text")).alias("tail")), f"SELECT chunk_uid, {_tail('text')} AS tail FROM {_once}")
_sentence_ends = lambda t: rf"list_filter(list_transform(string_split(regexp_replace({Q.strip(Q.text(t))}, '([.!?])({P.S}+)', '\1' || chr(1), 'g'), chr(1)), lambda s: {Q.strip('s')}), lambda s: s <> '')"
_marked_ends = _sentence_ends("text")
add("topk_k07_long_sentence", lambda spark, d: _chunks(spark, d).select("chunk_uid", T.last_long_sentence(F.col("text")).alias("tail")), f"SELECT chunk_uid, coalesce(list_filter(l, lambda s: {Q.words('s')} >= 4)[-1], l[-1], '') AS tail FROM (SELECT chunk_uid, {_marked_ends} AS l FROM {_once})")
add("set_u03_distinct", lambda spark, d: table(spark, d, "documents").select("text").distinct().agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars")), "SELECT count(*) AS texts, sum(length(text))::BIGINT AS chars FROM (SELECT DISTINCT text FROM documents)")
add("set_u04_union", lambda spark, d: table(spark, d, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text").unionByName(table(spark, d, "source_passage").select(F.lit("source").alias("origin"), F.col("source_idx").cast("long").alias("id"), "text")).groupBy("origin").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars")), "SELECT origin, count(*) AS texts, sum(length(text))::BIGINT AS chars FROM (SELECT 'document' AS origin, text FROM documents UNION ALL SELECT 'source', text FROM source_passage) GROUP BY 1")

# ---- bounds and rewriting
_ow = Q.words("original_text")
_b = {"preserve": (f"greatest(20, {_ow} - 15)", f"{_ow} + 25"), "concise": (f"greatest(30, {_ow} * 3 // 4)",) * 2, "elaborate": (f"({_ow} * 5 // 4)",) * 2}
add("struct_c06_bounds", lambda spark, d: table(spark, d, "chunk_result").select("result_id", *(L.bounds(_w("original_text"), m)[k].alias(f"{m}_{k}") for m in _b for k in ("low", "high"))), "SELECT result_id, " + ", ".join(f"({s})::INT AS {m}_{k}" for m, pair in _b.items() for k, s in zip(("low", "high"), pair)) + " FROM chunk_result")
add("struct_c07_abstract_bounds", lambda spark, d: table(spark, d, "chunk_result").where("section_type = 'abstract'").select("result_id", L.abstract_bounds(_w("original_text")).alias("b")).select("result_id", "b.*"), f"SELECT result_id, CASE WHEN {_ow} >= 100 THEN greatest(200, least({_ow} - 20, 250)) ELSE greatest(20, {_ow} - 15) END::INT AS low, CASE WHEN {_ow} >= 100 THEN greatest(250, least({_ow} + 30, 300)) ELSE {_ow} + 25 END::INT AS high FROM chunk_result WHERE section_type = 'abstract'")
add("struct_c08_presets", lambda spark, d: L.presets(spark), "SELECT * FROM (VALUES " + ", ".join(f"({Q.lit(n)}, {a}, {b})" for n, a, b in L.PRESETS) + ") AS t(name, low, high)")
_plain = lambda t: f"nfc_normalize({Q.sub(Q.sub(Q.text(t), P.STRIP_CLASS), P.SPACE_CLASS, ' ')})"
_work = f"""(SELECT chunk_uid, any_value(doc_id) AS doc_id, any_value(chunk_id) AS chunk_id, any_value(text) AS original, {_plain('any_value(text)')} AS text,
    any_value(coalesce(prev_context_tail, '')) AS own, any_value(coalesce(is_protected, false) OR coalesce(section_type IN ('front_matter', 'references'), false)) AS kept FROM chunk GROUP BY 1)"""
_written = cleaning._output_sql("text", _work, "chunk_uid")
add(
    "ext_e01_rewrite",
    lambda spark, d: R.rewrite_chunks(table(spark, d, "chunk").dropDuplicates(["chunk_uid"])).select("chunk_uid", "status", "skipped", "word_count"),
    f"SELECT chunk_uid, 'success' AS status, kept AS skipped, CASE WHEN kept THEN {Q.words('original')} ELSE {Q.words(_plain('cleaned'))} END AS word_count FROM {_work} JOIN ({_written}) USING (chunk_uid)",
)


def _answers():
    """A rewriter for tests of the driver: marks each a, never answers texts with "cf.", and those with "e.g." the second time."""
    asked: set[str] = set()

    def call(text: str, context: str) -> str:
        if "cf." in text:
            raise ValueError("no answer")
        if "e.g." in text and text not in asked:
            asked.add(text)
            raise TimeoutError("later")
        asked.discard(text)
        return text.replace("a", "A")

    return call


def _driven(spark: SparkSession, d: str) -> DataFrame:
    answers = _answers()
    return R.drive_documents(table(spark, d, "chunk").dropDuplicates(["chunk_uid"]), answers, pause=lambda _: None)


_fails = "NOT kept AND contains(text, 'cf.')"
_made = "CASE WHEN contains(text, 'cf.') THEN original ELSE replace(text, 'a', 'A') END"
_tails = f"""SELECT *, CASE WHEN NOT kept THEN coalesce(list_filter(l, lambda s: {Q.words('s')} >= 4)[-1], l[-1], '') END AS tail
    FROM (SELECT *, {_sentence_ends(_made)} AS l FROM {_work})"""
_context = "coalesce(nullif(last_value(tail IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_id, chunk_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), own)"
add("win_w07_stitching", lambda spark, d: _driven(spark, d).select("chunk_uid", "context"), f"SELECT chunk_uid, {_context} AS context FROM ({_tails})")
add(
    "ext_e03_retries",
    lambda spark, d: _driven(spark, d).select("chunk_uid", "status", "attempts", "skipped"),
    f"SELECT chunk_uid, CASE WHEN {_fails} THEN 'error: no answer' ELSE 'success' END AS status, CASE WHEN kept THEN 0 WHEN {_fails} THEN 3 WHEN contains(text, 'e.g.') THEN 2 ELSE 1 END::INT AS attempts, kept AS skipped FROM {_work}",
)
add(
    "ext_e06_one_shot",
    lambda spark, d: R.rewrite_text(_answers(), table(spark, d, "source_passage"), pause=lambda _: None).select("source_idx", "status"),
    f"SELECT source_idx, CASE WHEN contains({_plain('text')}, 'cf.') THEN 'error: no answer' ELSE 'success' END AS status FROM source_passage",
)
add("ext_e02_driver", lambda spark, d: R.rewrite_chunks(table(spark, d, "chunk").dropDuplicates(["chunk_uid"])).groupBy("skipped", "status").agg(F.count("*").alias("chunks")), f"SELECT p AS skipped, 'success' AS status, count(*) AS chunks FROM (SELECT chunk_uid, bool_or(coalesce(is_protected, false) OR coalesce(section_type IN ('front_matter', 'references'), false)) AS p FROM chunk GROUP BY 1) GROUP BY 1")
_OLD = {"md": "markdown", "txt": "text", "docx": "word", "pptx": "slides", "pdf": "pages"}
add("ext_e08_map_lookup", lambda spark, d: table(spark, d, "manuscript").select("doc_id", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _OLD.items() for x in kv)), F.lower("file_type")), F.lower("file_type")).alias("kind")), "SELECT doc_id, CASE lower(file_type) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _OLD.items()) + " ELSE lower(file_type) END AS kind FROM manuscript")

# ---- streams
def stream_audit_windows(spark: SparkSession, d: str) -> DataFrame:
    """Audit totals by day of delivery, by a stream run to its end."""
    from ..streaming.audit import replay

    return replay(spark, f"{d}/chunk_result.parquet", "humanized_text", "ingested_at")


add("stream_audit_windows", stream_audit_windows, f"SELECT date_trunc('day', ingested_at)::TIMESTAMP AS start, count(*) AS records, max(score) AS most, sum(triggers)::BIGINT AS triggers FROM ({cleaning.audit_sql('humanized_text', extra=', ingested_at')}) WHERE ingested_at IS NOT NULL GROUP BY 1")


def struct_s20_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Word files and back: their blocks by kind."""
    from ..sources.office import docx_blocks
    from ..sources.sinks import to_documents

    def read(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(int(n), b["type"]) for n, c in zip(pdf["name"], pdf["content"]) for b in docx_blocks(bytes(c))]
            yield pd.DataFrame(rows, columns=["doc_id", "type"])

    files = to_documents(table(spark, d, "documents"), "docx", "doc_id")
    return files.mapInPandas(read, "doc_id bigint, type string").groupBy("doc_id", "type").agg(F.count("*").alias("blocks"))


add("struct_s20_documents", struct_s20_documents)
