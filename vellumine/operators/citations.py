"""Citation entries for source files, from their names and first lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as P, text as T


def _title(text: Column) -> Column:
    """Each word's first letter large, the rest small (letters only follow letters)."""
    letters = F.split(F.lower(text), "")
    return F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~F.get(letters, i - 1).rlike(r"^\p{L}$"), F.upper(c)).otherwise(c)), "")


def citation_entries(sources: DataFrame, style: str = "APA", name: str = "source_name", text: str = "text", index: str = "source_idx") -> DataFrame:
    """``in_text``, ``bib_entry``, ``title``, ``year``, ``author`` of each source. Null names and texts count as empty."""
    n, t = F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    year = r"(?:^|[^0-9])(19\d\d|20\d\d)(?:[^0-9]|$)"
    found = F.coalesce(F.nullif(F.regexp_extract(n, year, 1), F.lit("")), F.nullif(F.regexp_extract(F.substring(t, 1, 350), year, 1), F.lit("")), F.lit("2024"))
    raw = T.strip(F.translate(F.regexp_replace(n, r"\.[^.]*$", ""), "_-", "  "))
    lines = F.filter(F.transform(F.split(F.substring(t, 1, 400), "\n"), lambda x: T.strip(F.regexp_replace(T.strip(x), "^#+", ""))), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    title = F.when(first.isNotNull() & (F.length(first) < 120), first).otherwise(_title(raw))
    token = F.regexp_extract(raw, f"^({P.NS}+)", 1)
    author = F.when(token == "", "Author").otherwise(_title(token))
    rows = sources.select(F.col(index), n.alias("filename"), found.alias("year"), title.alias("title"), author.alias("author"))
    i = F.col(index).cast("string")
    # the styles' forms (fixed values)
    if style == "IEEE":
        in_text, entry = F.concat(F.lit("["), i, F.lit("]")), F.concat(F.lit("["), i, F.lit("] "), "author", F.lit(' et al., "'), "title", F.lit('," '), "year", F.lit("."))
    elif style == "Harvard":
        in_text, entry = F.concat(F.lit("("), "author", F.lit(", "), "year", F.lit(")")), F.concat("author", F.lit(" ("), "year", F.lit(") '"), "title", F.lit("'. Available at: "), "filename", F.lit("."))
    else:
        in_text, entry = F.concat(F.lit("("), "author", F.lit(" et al., "), "year", F.lit(")")), F.concat("author", F.lit(", A. et al. ("), "year", F.lit("). "), "title", F.lit(". Reference source: "), "filename", F.lit("."))
    return rows.select(index, in_text.alias("in_text"), entry.alias("bib_entry"), "title", "year", "author")


def reference_list(sources: DataFrame, style: str = "APA", index: str = "source_idx") -> DataFrame:
    """All entries in upload order as one section."""
    rows = citation_entries(sources, style)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(index, "bib_entry"))), lambda x: x["bib_entry"])
    return rows.agg(F.concat(F.lit("## References\n\n"), F.array_join(ordered, "\n\n")).alias("references"))


def citation_sql(style: str) -> str:
    """The same for DuckDB."""
    title = lambda x: f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_full_match(substring({x}, i - 1, 1), '\\p{{L}}') THEN upper(substring({x}, i, 1)) ELSE lower(substring({x}, i, 1)) END), '')"
    year = r"(?:^|[^0-9])(19[0-9][0-9]|20[0-9][0-9])(?:[^0-9]|$)"
    strip = lambda x: f"regexp_replace({x}, '^{P.S}+|{P.S}+$', '', 'g')"
    base = f"SELECT source_idx, coalesce(source_name, '') AS n, coalesce(text, '') AS t FROM source_passage"
    more = f"SELECT source_idx, n, coalesce(nullif(regexp_extract(n, '{year}', 1), ''), nullif(regexp_extract(substring(t, 1, 350), '{year}', 1), ''), '2024') AS year, " + strip(r"translate(regexp_replace(n, '\.[^.]*$', ''), '_-', '  ')") + f" AS raw, list_filter(list_transform(string_split(substring(t, 1, 400), chr(10)), lambda x: {strip('regexp_replace(' + strip('x') + ', ' + chr(39) + '^#+' + chr(39) + ', ' + chr(39) * 2 + ')')}), lambda x: x <> '')[1] AS first FROM ({base})"
    token = f"regexp_extract(raw, '^({P.NS}+)', 1)"
    done = f"SELECT source_idx, n, year, CASE WHEN first IS NOT NULL AND length(first) < 120 THEN first ELSE {title('raw')} END AS title, CASE WHEN {token} = '' THEN 'Author' ELSE {title(token)} END AS author FROM ({more})"
    if style == "IEEE":
        in_text, entry = "'[' || source_idx || ']'", "'[' || source_idx || '] ' || author || ' et al., \"' || title || ',\" ' || year || '.'"
    elif style == "Harvard":
        in_text, entry = "'(' || author || ', ' || year || ')'", "author || ' (' || year || ') ''' || title || '''. Available at: ' || n || '.'"
    else:
        in_text, entry = "'(' || author || ' et al., ' || year || ')'", "author || ', A. et al. (' || year || '). ' || title || '. Reference source: ' || n || '.'"
    return f"SELECT source_idx, {in_text} AS in_text, {entry} AS bib_entry, title, year, author FROM ({done})"
