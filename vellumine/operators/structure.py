"""Blocks, sections, tables, captions, contents and profile of manuscripts in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions import patterns as P, text as T
from .scale import prefix_sums

# Numbers before headings, and divider rows of tables (fixed values).
NUMBERING = rf"(?iu)^(?:(?:section|chapter|chap\.?){P.S}+)?(?:(?:{P.D}+(?:\.{P.D}+)*)|(?:[ivxlcdm]+))[.{P.WS}\-–—:]+{P.S}*"
DIVIDER = rf"^\|[{P.WS}\-:|]+\|$"


def ordered_text(parts: DataFrame, group: str, order: list[str], text: str, glue: str = "\n\n") -> DataFrame:
    """Texts of a group joined in order."""
    return parts.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), glue).alias(text))


def blocks(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Blocks parted by blank lines, with ``block_idx``, heading ``level`` (0: none) and ``kind``; blank ones are left out."""
    rows = df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n\n")).alias("block_idx", "raw"))
    rows = rows.withColumn("raw", T.strip(F.col("raw"))).where("raw <> ''")
    level = F.when(F.col("raw").startswith("# "), 1).when(F.col("raw").startswith("## "), 2).when(F.col("raw").startswith("### "), 3).otherwise(0)
    rows = rows.withColumn("level", level)
    body = F.when(F.col("level") > 0, T.strip(F.expr("substring(raw, level + 2)"))).otherwise(F.col("raw"))
    return rows.select(*keys, "block_idx", "level", body.alias("text"), F.when(F.col("level") > 0, "heading").otherwise(F.lit("paragraph")).alias("kind"))


def is_markdown_table(block: Column) -> Column:
    """At least two lines, each begun and ended by a bar."""
    lines = F.filter(F.transform(F.split(F.coalesce(block, F.lit("")), "\n"), T.strip), lambda x: x != "")
    return (F.size(lines) >= 2) & F.forall(lines, lambda x: x.startswith("|") & x.endswith("|"))


def table_cells(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Cells of Markdown tables: keys, ``row_idx``, ``col_idx``, ``cell``; divider rows are left out and not counted."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), T.strip), lambda x: x.startswith("|") & ~x.rlike(DIVIDER))
    rows = df.select(*keys, F.posexplode(lines).alias("row_idx", "line"))
    cells = F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|")
    return rows.select(*keys, "row_idx", F.posexplode(cells).alias("col_idx", "cell")).select(*keys, "row_idx", "col_idx", T.strip(F.col("cell")).alias("cell"))


def cells_to_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """A table's cells as Markdown: first row the header, short rows padded, line breaks become blanks."""
    flat = cells.withColumn("cell", T.strip(F.replace(F.coalesce("cell", F.lit("")), F.lit("\n"), F.lit(" "))))
    rows = flat.groupBy(*keys, "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "cell"))).alias("c")).withColumn("c", F.transform("c", lambda x: x["cell"]))
    width = rows.groupBy(*keys).agg(F.max(F.size("c")).alias("w"))
    line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    padded = rows.join(width, keys).withColumn("line", line(F.concat("c", F.array_repeat(F.lit(""), F.col("w") - F.size("c")))))
    whole = padded.groupBy(*keys).agg(F.max("w").alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]).alias("lines"))
    return whole.select(*keys, F.array_join(F.concat(F.slice("lines", 1, 1), F.array(line(F.array_repeat(F.lit("---"), F.col("w")))), F.slice("lines", 2, 1 << 30)), "\n").alias("markdown"))


def section_of(heading: Column) -> Column:
    """The first section class one of whose key words a heading, without its number, has."""
    words = [w for ws in P.SECTIONS.values() for w in ws]

    def lookup(clean: Column) -> Column:
        out = F.when(~clean.rlike(P.whole(words)), "general")  # most blocks have none of the words, and one look tells
        for name, own in P.SECTIONS.items():
            out = out.when(clean.rlike(P.whole(own)), name)
        return out.otherwise("general")

    return T.let(T.strip(F.regexp_replace(T.strip(F.lower(F.coalesce(heading, F.lit("")))), NUMBERING, "")), lookup)


def caption(text: Column, pattern: str) -> Column:
    """``id`` (null without a number) and ``text`` of a caption line; null where it is none."""
    number = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.when(text.rlike(pattern), F.struct(number.alias("id"), T.strip(F.regexp_extract(text, pattern, 2)).alias("text")))


def is_caption(text: Column) -> Column:
    return text.rlike(P.FIGURE_CAPTION) | text.rlike(P.TABLE_CAPTION)


def is_list_item(text: Column) -> Column:
    return text.startswith("- ") | text.startswith("* ") | text.startswith("• ")


def is_cover_line(text: Column) -> Column:
    """Lines of signatures and title pages: rules of underscores or hyphens, or a short line with a cover word."""
    # fixed values
    words = ("department", "university", "faculty", "submitted by", "advisor", "supervisor", "dated", "session", "campus", "karachi", "certificate")
    return text.contains("____") | text.contains("----") | ((T.word_count(text) < 12) & F.lower(text).rlike(P.alternatives(words)))


def is_blank(text: Column, has_drawing: Column, has_math: Column) -> Column:
    """A paragraph without text; one with a drawing or a formula is kept."""
    return (T.strip(F.coalesce(text, F.lit(""))) == "") & ~F.coalesce(has_drawing, F.lit(False)) & ~F.coalesce(has_math, F.lit(False))


def is_eligible(has_drawing: Column, has_math: Column) -> Column:
    """Whether a paragraph's text may be replaced: it holds neither a drawing nor a formula."""
    return ~F.coalesce(has_drawing, F.lit(False)) & ~F.coalesce(has_math, F.lit(False))


def media_kind(text: Column, level: Column, has_drawing: Column, has_math: Column) -> Column:
    """``paragraph_kind``, after drawings and formulas."""
    return F.when(has_drawing, "drawing").when(has_math, "math").otherwise(paragraph_kind(text, level))


def paragraph_kind(text: Column, level: Column) -> Column:
    leader = rf"\.{{4,}}{P.S}*(?:Page{P.S}*)?{P.D}+$"
    return F.when(text.rlike(P.FIGURE_CAPTION), "figure_caption").when(text.rlike(P.TABLE_CAPTION), "table_caption").when(F.lower(text) == "table of contents", "contents").when(text.rlike(leader), "leader_line").when(level > 0, "heading").when(is_markdown_table(text), "table").when(is_list_item(text), "list_item").when(is_cover_line(text), "cover").otherwise("body")


def sections(df: DataFrame, doc: str = "doc_id", bucket: str = "bucket", order: tuple[str, ...] = ("chunk_id", "block_idx")) -> DataFrame:
    """Adds ``section`` and ``is_protected`` to blocks (``text``, ``level``) of documents in order.

    Front matter lasts up to the first block of the body; from there the last change of section holds. ``bucket`` is a
    rising function of the order (such as its quotient): changes are carried within buckets, then over buckets, so that
    no task needs a whole document.
    """
    text = F.col("text")
    base = df.withColumn("__f", section_of(text))
    start = F.col("__f").isin("abstract", "introduction", "methodology", "literature_review") | text.rlike(rf"(?iu)^(?:chapter{P.S}+1{P.B}|1\.?{P.S}+[a-zA-Z]|introduction{P.B}|abstract{P.B})")
    references = (F.col("__f") == "references") | text.rlike(rf"(?iu)^(?:references|bibliography|works cited|literature cited){P.B}")
    plain = F.col("__f").isin("general", "front_matter")
    # what a block says as the body's first, if it may be that, and what as a later one
    base = base.withColumn("__begin", F.when(start, F.when(plain, "introduction").otherwise(F.col("__f")))).withColumn("__change", F.when(references, "references").when(F.col("level").between(1, 2) & ~plain, F.col("__f"))).drop("__f")
    here = F.struct(*order)
    per = base.groupBy(doc, bucket).agg(F.min(F.when(F.col("__begin").isNotNull(), F.struct(here.alias("at"), F.col("__begin").alias("what")))).alias("__first"), F.max(F.when(F.col("__change").isNotNull(), F.struct(here.alias("at"), F.col("__change").alias("what")))).alias("__last"))
    before = Window.partitionBy(doc).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    ahead = per.select(doc, bucket, F.min("__first").over(Window.partitionBy(doc)).alias("__first"), F.max("__last").over(before).alias("__ahead"))
    inner = Window.partitionBy(doc, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("__change").isNotNull(), F.struct(here.alias("at"), F.col("__change").alias("what")))
    out = base.withColumn("__within", F.last(own, ignorenulls=True).over(inner)).join(ahead, [doc, bucket])
    last = F.coalesce("__within", "__ahead")
    later = F.when(last["at"] > F.col("__first.at"), last["what"]).otherwise(F.col("__first.what"))
    out = out.withColumn("section", F.when(F.col("__first").isNull() | (here < F.col("__first.at")), "front_matter").otherwise(later))
    return out.drop("__begin", "__change", "__within", "__first", "__ahead").withColumn("is_protected", F.col("section").isin(*P.PROTECTED))


def contents(df: DataFrame, doc: str, order: list[str], bucket: str, text: str = "text", title_page: bool = False) -> DataFrame:
    """Table of contents of documents that come in parts: headings of level 1 to 4 in order (``place``, from 0) with
    estimated pages and leader dots, for documents with two headings or more.

    ``order`` sorts a document's parts, ``bucket`` rises with it; pages are running sums by ``prefix_sums``.
    """
    parts = F.transform(F.split(T.normalize_blocks(F.coalesce(text, F.lit(""))), "\n\n"), T.strip)
    mark = rf"^(#{{1,4}}){P.S}+([^\n]*)$"
    rows = df.select(doc, *order, bucket, F.posexplode(parts).alias("idx", "raw")).where(F.col("raw").rlike(mark))
    heads = rows.select(doc, *order, bucket, "idx", F.length(F.regexp_extract("raw", mark, 1)).alias("level"), T.strip(F.regexp_extract("raw", mark, 2)).alias("heading"))
    placed = prefix_sums(heads, [doc], bucket, [*order, "idx"], {"place": F.lit(1), "chapters": (F.col("level") == 1).cast("int")})
    many = heads.groupBy(doc).agg(F.count("*").alias("n")).where("n >= 2").select(doc)
    out = placed.join(many, doc, "left_semi")
    return out.select(doc, "place", "level", "heading", (F.col("chapters") + (3 if title_page else 2)).cast("int").alias("page"), F.greatest(F.lit(6), 62 - 8 * (F.col("level") - 1) - F.length("heading")).alias("dots"))


def profile(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Words, blocks, headings, captions, tables, pages and minutes of each text."""
    norm = T.normalize_blocks(F.coalesce(text, F.lit("")))
    base = df.select(id_col, T.word_count(norm).alias("total_words"), F.filter(F.transform(F.split(norm, "\n\n"), T.strip), lambda b: b != "").alias("b"))
    head = rf"^#{{1,4}}{P.S}+[^\n]*$"
    kind = F.transform("b", lambda b: F.when(b.rlike(head), "heading").when(b.rlike(P.FIGURE_CAPTION), "figure").when(b.rlike(P.TABLE_CAPTION), "table_caption").when(b.startswith("|") & b.contains("\n|"), "table").otherwise("other"))
    base = base.withColumn("k", kind)
    n = lambda name: F.size(F.filter("k", lambda k: k == name))
    pages = F.greatest(F.lit(1.0), T.one_decimal(F.col("total_words"), F.lit(450)))
    return base.select(id_col, "total_words", F.size("b").alias("total_blocks"), n("heading").alias("heading_count"), n("figure").alias("figure_count"), n("table_caption").alias("table_caption_count"), n("table").alias("markdown_tables_count"), pages.alias("estimated_pages"), F.greatest(F.lit(1), F.bround(F.col("total_words") / 220).cast("int")).alias("reading_time_min"))


def captions_and_references(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Caption and reference ids: id, ``kind`` (figure, table), ``ref``, ``captioned``, ``referenced``.

    Paragraphs that are captions are not searched for references.
    """
    paras = df.select(id_col, F.explode(F.split(F.coalesce(text, F.lit("")), "\n\n")).alias("p")).withColumn("p", T.strip(F.col("p"))).where("p <> ''")
    own = F.array(*(F.when(F.col("p").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lower(F.regexp_extract("p", pattern, 1)).alias("ref"), F.lit(True).alias("c"))) for kind, pattern in (("figure", P.FIGURE_CAPTION), ("table", P.TABLE_CAPTION))))
    mention = lambda stem: rf"(?iu){P.B}(?:{stem}){P.S}*({P.D}+[a-zA-Z]?(?:[-.]{P.D}+)?){P.B}"
    named = lambda kind: lambda r: F.struct(F.lit(kind).alias("kind"), F.lower(r).alias("ref"), F.lit(False).alias("c"))
    refs = F.concat(*(F.transform(T.matches_of(F.col("p"), mention(stem), 1), named(kind)) for kind, stem in (("figure", r"figure|fig\.?"), ("table", r"table|tbl\.?"))))
    one = F.array_compact(F.slice(F.array_compact(own), 1, 1))
    rows = paras.select(id_col, F.explode(F.when(F.size(one) > 0, one).otherwise(refs)).alias("x")).select(id_col, "x.*").where("ref <> ''")
    return rows.groupBy(id_col, "kind", "ref").agg(F.bool_or("c").alias("captioned"), F.bool_or(~F.col("c")).alias("referenced"))


def context(blocks_: DataFrame, doc: str, order: str, first: int = 40) -> DataFrame:
    """Title, first headings and acronyms of a document's first blocks, as lines of text."""
    base = blocks_.where(F.col(order) < first)
    words = T.word_count(F.col("text"))
    may = base.withColumn("__t", (words >= 4) & (words <= 24) & ~F.col("text").endswith("."))
    title = may.where("__t").groupBy(doc).agg(F.min_by("text", order).alias("title"), F.min(order).alias("__at"))
    heads = base.where("level > 0").join(title.select(doc, "__at"), doc, "left").where(F.col("__at").isNull() | (F.col(order) != F.col("__at")))
    heads = heads.groupBy(doc).agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order, "text"))), 1, 5), lambda x: x["text"]), ", ").alias("headings"))
    names = base.select(doc, F.explode(T.matches_of(F.col("text"), r"\(([A-Z]{2,6})\)", 1)).alias("a")).distinct().groupBy(doc).agg(F.array_join(F.slice(F.array_sort(F.collect_list("a")), 1, 10), ", ").alias("acronyms"))
    out = base.select(doc).distinct().join(title.drop("__at"), doc, "left").join(heads, doc, "left").join(names, doc, "left")
    return out.select(doc, F.concat_ws("\n", F.concat(F.lit("Manuscript Title: "), "title"), F.concat(F.lit("Major Sections / Headings: "), "headings"), F.concat(F.lit("Established Acronyms: "), "acronyms")).alias("context"))


def slides(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Slides of a Markdown deck: parted by rules, else before headings of level 1; title and body lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    by_rule = F.split(t, r"(?m)^---[ \t]*$")
    by_head = F.filter(F.split(t, r"(?m)^(?=#\s+)"), lambda s: T.strip(s) != "")
    parts = F.when(F.size(by_rule) > 1, by_rule).when(F.size(by_head) > 0, by_head).otherwise(F.array(t))
    rows = df.select(id_col, F.posexplode(parts).alias("slide_idx", "s"))
    lines = F.filter(F.transform(F.split("s", "\n"), T.strip), lambda x: x != "")
    rows = rows.withColumn("l", lines).where(F.size("l") > 0)
    heads = F.filter("l", lambda x: x.startswith("#"))
    title = F.when(F.size(heads) > 0, T.strip(F.regexp_replace(F.element_at(heads, -1), "^#+", ""))).otherwise(F.concat(F.lit("Slide "), F.col("slide_idx") + 1))
    return rows.select(id_col, "slide_idx", title.alias("title"), F.filter("l", lambda x: ~x.startswith("#")).alias("body"))


def assemble(elements: Column) -> Column:
    """Elements (``type, text, level``) as one text: headings marked, list items with a dash."""
    one = lambda e: F.when(e["type"] == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(e["level"], F.lit(1))))), F.lit(" "), e["text"])).when(e["type"] == "list_item", F.concat(F.lit("- "), F.regexp_replace(e["text"], r"^[-*• ]+", ""))).otherwise(e["text"])
    return F.array_join(F.transform(elements, one), "\n\n")
