"""Operators over small tables, and against plain Python."""

import io
import os
import random
import re
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from vellumine.operators import chunking as G, citations as C, diff as D, fidelity as Y, rewrite as R, similarity as X, structure as S
from vellumine.sources import office as O


def brute_tokens(t):
    return re.findall(r"\b[a-zA-Z0-9_-]+\b", t.lower())


def test_tokens_match_plain_python(spark):
    texts = ["café élan foo-bar naïve état-é x-é -z -- q-", "", "Polar ice sheets melt", "a_b-c 3.5 x", "ünder_score é_a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.v for r in df.select("i", X.tokens(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [brute_tokens(t) for t in texts]


def test_similarity(spark):
    rows = [(1, "a b c d e f g", "a b c d e x y"), (2, "", "x"), (3, "one two", "one two"), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, o string, r string")
    out = {r.id: r for r in X.pair_similarity(df, "o", "r", keep=("id",)).collect()}
    assert (out[1].original_ngrams, out[1].matching_ngrams, out[1].overlap, out[1].originality) == (4, 2, 50.0, 50.0)
    assert (out[1].three_gram_overlap, out[1].five_gram_overlap) == (60.0, 33.3)
    assert out[2].risk_level == out[4].risk_level == "Clean / 100% Original"
    assert (out[3].original_ngrams, out[3].overlap, out[3].risk_level) == (0, 0.0, "Clean / Highly Original")


def test_source_overlap_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(20)]
    s = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:8])], "source_idx int, text string")
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts[8:])], "doc_id int, text string")
    grams = lambda t: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)}
    want = {(i, j): len(grams(a) & grams(b)) for i, a in enumerate(texts[:8]) for j, b in enumerate(texts[8:]) if grams(a) & grams(b)}
    got = {(r.source_idx, r.doc_id): r.common for r in X.source_overlap(s, d).collect()}
    assert got == want


def test_fidelity(spark):
    text = "Figure 3.1 shows p < 0.05 at -8.6 kJ/mol in 2014 [1]. Table 2 lists Cys166 [2]."
    rows = [(1, text, text), (2, text, text.replace("2014", "1914")), (3, text, text.replace("[1]", "[9]")), (4, "", ""), (5, None, "x")]
    out = {r.id: r for r in Y.report(spark.createDataFrame(rows, "id int, a string, b string"), "id", "a", "b").collect()}
    assert out[1].fidelity_score == 100.0 and out[1].is_safe
    assert not out[2].is_safe and out[2].failed_checks == 2  # the year, and the same number
    assert out[3].failed_checks == 1
    assert out[4].total_checks == out[5].total_checks == 0 and out[4].fidelity_score == 100.0


# Patterns of numbers before headings and of the body's and the references' first words (fixed values).
NUMBERED = r"^(?:(?:section|chapter|chap\.?)\s+)?(?:\d+(?:\.\d+)*|[ivxlcdm]+)[.\s\-–—:]+\s*"
BODY = r"(?:chapter\s+1\b|1\.?\s+[a-z]|introduction\b|abstract\b)"
BACK = r"(?:references|bibliography|works cited|literature cited)\b"


def brute_sections(blocks):
    """(text, level) of a document in order: its sections, by the rule read as a whole."""
    from vellumine.functions.patterns import SECTIONS

    def kind(text):
        bare = re.sub(NUMBERED, "", text.lower().strip()).strip()
        hits = [name for name, words in SECTIONS.items() for w in words if re.search(rf"\b{re.escape(w)}\b", bare)]
        return hits[0] if hits else "general"

    kinds = [kind(t) for t, _ in blocks]
    opening = [k in ("abstract", "introduction", "methodology", "literature_review") or bool(re.match(BODY, t, re.I)) for k, (t, _) in zip(kinds, blocks)]
    if True not in opening:
        return ["front_matter"] * len(blocks)
    first = opening.index(True)
    told = {first: "introduction" if kinds[first] in ("general", "front_matter") else kinds[first]}
    for i in range(first + 1, len(blocks)):
        text, level = blocks[i]
        if kinds[i] == "references" or re.match(BACK, text, re.I):
            told[i] = "references"
        elif level in (1, 2) and kinds[i] not in ("general", "front_matter"):
            told[i] = kinds[i]
    return ["front_matter" if i < first else told[max(j for j in told if j <= i)] for i in range(len(blocks))]


def brute_packing(rows, most):
    out, number, words, p, s = [], -1, 0, None, None
    for kind, level, w, section, protected in rows:
        split = number < 0 or p != protected or words + w > most or (kind != "table" and ((p and s != section) or (kind == "heading" and level <= 2 and words >= 200)))
        if split:
            number, words, p, s = number + 1, 0, protected, section
        words += w
        out.append(number)
    return out


def test_sections_and_packing_against_brute_force(spark):
    rng = random.Random(3)
    pool = [("Certificate of approval", 0), ("Chapter 1 Introduction", 1), ("Methods", 2), ("Results", 2), ("some words " * 30, 0), ("References", 1), ("we cite the bibliography", 0), ("Discussion", 3), ("| a | b |", 0), ("2.1 Findings", 2), ("Conclusion", 1), ("more text " * 60, 0)]
    docs = {d: [rng.choice(pool) for _ in range(rng.randint(1, 60))] for d in range(12)}
    rows = [(d, i // 5, i % 5, (i // 5) // 2, t, lv, "table" if t.startswith("|") else "heading" if lv else "paragraph", len(t.split())) for d, bs in docs.items() for i, (t, lv) in enumerate(bs)]
    df = spark.createDataFrame(rows, "doc_id int, chunk_id int, block_idx int, bucket int, text string, level int, kind string, word_count int")
    sectioned = S.sections(df)
    got = {}
    for r in sectioned.collect():
        got[r.doc_id, r.chunk_id, r.block_idx] = r.section
    numbers = {(r.doc_id, r.chunk_id, r.block_idx): r.new_chunk for r in G.chunk_numbers(sectioned, "doc_id", ["chunk_id", "block_idx"], 120).collect()}
    for d, bs in docs.items():
        want = brute_sections([(t.strip(), lv) for t, lv in bs])
        assert [got[d, i // 5, i % 5] for i in range(len(bs))] == want
        packed = brute_packing([("table" if t.startswith("|") else "heading" if lv else "paragraph", lv, len(t.split()), s, s in ("front_matter", "references")) for (t, lv), s in zip(bs, want)], 120)
        assert [numbers[d, i // 5, i % 5] for i in range(len(bs))] == packed


def test_tables_round_trip(spark):
    md = "| a | b | c |\n| --- | --- | --- |\n| 1 | 2 |  |"
    df = spark.createDataFrame([(1, "x\n" + "| a | b | c |\n| --- | --- | --- |\n| 1 | 2 |"), (2, None), (3, "none")], "id int, text string")
    out = S.cells_to_markdown(S.table_cells(df, ["id"]), ["id"]).collect()
    assert [(r.id, r.markdown) for r in out] == [(1, md)]


def test_contents_and_profile(spark):
    text = "# A\n\nBody.\n\n## B\nMore.\n\n# C\n\nFigure 2: Yield\n\n| a |\n| - |"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    toc = S.contents(df.withColumn("part", F.lit(0)), "id", ["part"], "part").orderBy("place").collect()
    assert [(r.heading, r.level, r.page, r.dots) for r in toc] == [("A", 1, 2, 61), ("B", 2, 3, 53), ("C", 1, 3, 61)]
    p = {r.id: r for r in S.profile(df, "id").collect()}
    assert (p[1].heading_count, p[1].figure_count, p[1].markdown_tables_count, p[1].estimated_pages, p[1].reading_time_min) == (3, 1, 1, 1.0, 1)
    assert p[2].total_blocks == p[3].total_blocks == 0


def test_prefix_sums_and_salted_join(spark):
    from vellumine.operators.scale import prefix_sums, salted_join

    rng = random.Random(9)
    rows = [(g, i, i // 7, rng.randint(0, 5)) for g in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, i int, b int, v int")
    got = {(r.g, r.i): r.ahead for r in prefix_sums(df, ["g"], "b", ["i"], {"ahead": F.col("v")}).collect()}
    assert got == {(g, i): sum(v for h, j, _, v in rows if h == g and j < i) for g, i, _, _ in rows}
    right = spark.createDataFrame([(0, "a"), (2, "c")], "g int, name string")
    out = sorted((r.g, r.i, r.name or "") for r in salted_join(df, right, ["g"], F.col("i")).collect())
    assert out == sorted((g, i, {0: "a", 2: "c"}.get(g, "")) for g, i, _, _ in rows)


def test_captions_and_slides(spark):
    df = spark.createDataFrame([(1, "Figure 1: A\n\nAs fig 2a and Table 1 show.\n\nTable 2: B")], "id int, text string")
    got = {(r.kind, r.ref, r.captioned, r.referenced) for r in S.captions_and_references(df, "id").collect()}
    assert got == {("figure", "1", True, False), ("figure", "2a", False, True), ("table", "1", False, True), ("table", "2", True, False)}
    deck = spark.createDataFrame([(1, "# One\na\n---\n# Two\nb\nc"), (2, "# X\nq\n# Y"), (3, "plain")], "id int, text string")
    slides = sorted((r.id, r.slide_idx, r.title, tuple(r.body)) for r in S.slides(deck, "id").collect())
    assert slides == [(1, 0, "One", ("a",)), (1, 1, "Two", ("b", "c")), (2, 0, "X", ("q",)), (2, 1, "Y", ()), (3, 0, "Slide 1", ("plain",))]


def test_assemble(spark):
    df = spark.sql("SELECT array(named_struct('type', 'heading', 'text', 'T', 'level', 9), named_struct('type', 'list_item', 'text', '- • x', 'level', 0), named_struct('type', 'paragraph', 'text', 'p', 'level', 0)) AS e")
    assert df.select(S.assemble(F.col("e")).alias("t")).first().t == "###### T\n\n- x\n\np"


def test_citations(spark):
    df = spark.createDataFrame([(1, "smith_reefs_2011.pdf", "# On Reefs\nText"), (2, None, None)], "source_idx int, source_name string, text string")
    apa, ieee = (C.citation_entries(df, s).orderBy("source_idx").collect() for s in ("APA", "IEEE"))
    assert apa[0].bib_entry == "Smith, A. et al. (2011). On Reefs. Reference source: smith_reefs_2011.pdf."
    assert ieee[0].in_text == "[1]" and apa[1].author == "Author" and apa[1].year == "2024"


def test_diff(spark):
    df = spark.createDataFrame([(1, "a b c", "a x c"), (2, None, None), (3, "<b>", "<b>")], "id int, o string, r string")
    d = D.word_diff(df, "id", "o", "r")
    rows = {r.id: r for r in d.collect()}
    assert [(o.tag, o.i1, o.i2, o.j1, o.j2) for o in rows[1].opcodes] == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 2), ("equal", 2, 3, 2, 3)]
    html = {r.id: r.html for r in D.diff_html(d, "id").collect()}
    assert html[1] == "a <del>b</del> <ins>x</ins> c" and html[2] == "" and html[3] == "&lt;b&gt;"


def test_rewrite(spark):
    rows = [(1, 1, 0, "Fine text here", "results", False), (2, 1, 1, "Bad", "results", None), (3, 1, 2, "Refs", "references", None), (4, 1, 3, None, None, None)]
    df = spark.createDataFrame(rows, "chunk_uid int, doc_id int, chunk_id int, text string, section_type string, is_protected boolean")

    def shout(s: pd.Series) -> pd.Series:
        if (s == "Bad").any():
            raise ValueError("no")
        return s.str.upper()

    out = {r.chunk_uid: r for r in R.rewrite_chunks(df, shout).collect()}
    assert out[1].humanized_text == "FINE TEXT HERE" and out[1].status == "success"
    assert out[2].humanized_text == "Bad" and out[2].status == "error: no"
    assert out[3].skipped and out[3].humanized_text == "Refs" and out[4].humanized_text == ""


CHUNKS = "chunk_uid int, doc_id int, chunk_id int, text string, section_type string, is_protected boolean, prev_context_tail string, status string"


def test_documents_are_driven_in_order(spark):
    rows = [(1, 1, 0, "One two three four. Five.", "results", False, "own", "x"), (2, 1, 1, "Refs here", "references", None, "own", "x"), (3, 1, 2, "fail now", "results", None, "own", "x"), (4, 1, 3, "six\u200b seven", None, None, None, "x"), (5, 2, 0, None, None, None, None, "x"), (6, 2, 1, "later on", None, None, "its own", "x"), (7, None, None, "alone", None, None, None, "x")]
    seen = spark.sparkContext.accumulator(0)

    def call(text, context):
        seen.add(1)
        if text.startswith("fail"):
            raise ValueError("no")
        return f"```\n{text.upper()}\n```"

    out = {r.chunk_uid: r for r in R.drive_documents(spark.createDataFrame(rows, CHUNKS), call, pause=lambda _: None).collect()}
    assert out[1].humanized_text == "ONE TWO THREE FOUR. FIVE." and out[1].context == "own"
    assert out[2].skipped and out[2].humanized_text == "Refs here" and out[2].attempts == 0
    assert (out[3].status, out[3].humanized_text, out[3].attempts) == ("error: no", "fail now", 3) and "FOUR" in out[3].context
    assert out[4].context == "fail now" and out[4].humanized_text == "SIX SEVEN" and out[4].word_count == 2
    assert out[5].humanized_text == "" and out[7].humanized_text == "ALONE" and seen.value == 8
    assert R.drive_documents(spark.createDataFrame([], CHUNKS), call).count() == 0
    one = R.rewrite_text(call, spark.createDataFrame([("a b", 1), ("fail", 2), (None, 3)], "text string, status0 int"), pause=lambda _: None).collect()
    assert sorted((r.status0, r.rewritten, r.status) for r in one) == [(1, "A B", "success"), (2, "fail", "error: no"), (3, "", "success")]


def test_last_long_sentence_in_python():
    assert [R.last_long(t) for t in ("", "One. Two three four five! Six.", "a b", "A b. C d.")] == ["", "Two three four five!", "a b", "C d."]


def test_retries():
    waits, calls = [], []

    def flaky(t):
        calls.append(t)
        if len(calls) < 3:
            raise OSError
        return t

    assert R.with_retries(flaky, pause=waits.append)("x") == "x"
    assert len(waits) == 2 and all(1 <= w <= 5 for w in waits)


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')
    return data.getvalue()


def test_office_sources(spark, tmp_path):
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc></w:tr></w:tbl>"
    (tmp_path / "x.docx").write_bytes(docx(p("Head", '<w:pPr><w:pStyle w:val="H2"/></w:pPr>') + table + p("") + p("Tail")))
    (tmp_path / "y.txt").write_bytes(b"ok \xff bytes")
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    (tmp_path / "z.pdf").write_bytes(b"%PDF-1.4\n4 0 obj\n<< /Length 44 >>\nstream\nBT /F1 12 Tf (Hello \\(all\\)) Tj T* (two) Tj ET\nendstream\nendobj")
    rows = {r.path.rpartition("/")[2]: r for r in O.read_documents(spark, str(tmp_path)).collect()}
    assert rows["x.docx"].text == "Head\n\nTail\n\n| a | b |\n\n| 1 |"
    assert rows["y.txt"].text == "ok  bytes" and rows["z.pdf"].text == "Hello (all)\ntwo"
    assert rows["bad.docx"].text is None and rows["bad.docx"].error
    unread, *blocks = O.read_docx_blocks(spark, str(tmp_path)).orderBy("block_idx").collect()
    assert unread.path.endswith("bad.docx") and unread.error and unread.type is None and not any(b.error for b in blocks)
    assert [(b.type, b.text, b.level, b.para_idx) for b in blocks] == [("heading", "Head", 2, 0), ("table", "| a | b |\n| --- | --- |\n| 1 |  |", 0, None), ("paragraph", "Tail", 0, 2)]
    O.write_text(spark.createDataFrame([("# T\n\nx",)], "text string"), str(tmp_path / "out"))


def test_pptx():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shape = lambda kind, *ts: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>' + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in ts) + "</p:txBody></p:sp>"
    rel = lambda *rs: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="x/{t}" Target="{to}"/>' for i, t, to in rs) + "</Relationships>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {a}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rel(("r1", "slide", "slides/slide1.xml")))
        z.writestr("ppt/slides/slide1.xml", f"<p:sld {a}><p:cSld><p:spTree>{shape('title', 'Hi')}{shape('body', 'one', 'two')}</p:spTree></p:cSld></p:sld>")
        z.writestr("ppt/slides/_rels/slide1.xml.rels", rel(("r2", "notesSlide", "../notesSlides/n1.xml")))
        z.writestr("ppt/notesSlides/n1.xml", f"<p:notes {a}><p:cSld><p:spTree>{shape('body', 'say it')}</p:spTree></p:cSld></p:notes>")
    assert O.pptx_text(data.getvalue()) == "# Slide 1: Hi\n\none\n\ntwo\n\n> **Speaker Notes (Slide 1):** say it"


def test_query_tables_need_no_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.returncode == 0 and int(out.stdout) > 100


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).columns == ["source_idx", "doc_id", "common", "source_ngrams", "overlap"] and E.entry(spark).count() > 0


def test_sinks_round_trip(spark, tmp_path):
    from vellumine.sources import sinks as K

    text = "# One & two\n\nA body <b>.\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n- x\n- y\n\n## Sub\n\nEnd."
    blocks = O.docx_blocks(K.docx_bytes(text))
    assert [(b["type"], b["text"], b["level"]) for b in blocks] == [("heading", "One & two", 1), ("paragraph", "A body <b>.", 0), ("table", "| a | b |\n| --- | --- |\n| 1 | 2 |", 0), ("list_item", "x", 0), ("list_item", "y", 0), ("heading", "Sub", 2), ("paragraph", "End.", 0)]
    assert "Table of Contents" in O.docx_text(K.docx_bytes(text, contents=True))
    assert O.pptx_text(K.pptx_bytes("# A\nx\n---\n# B\n- y\nz")) == "# Slide 1: A\n\nx\n\n---\n\n# Slide 2: B\n\ny\n\nz"
    assert O.pdf_text(K.pdf_bytes("# T (1)\n\nline \\ two")) == "T (1)\nline \\ two"
    assert K.docx_bytes(text) == K.docx_bytes(text)
    df = spark.createDataFrame([("a/b", text), ("c", None)], "name string, text string")
    for kind in K.WRITERS:
        K.write_files(df, str(tmp_path / kind), kind, "name")
        assert sorted(os.listdir(tmp_path / kind)) == [f"a_b.{kind}", f"c.{kind}"]
    back = {r.path.rpartition("/")[2]: r for r in O.read_documents(spark, str(tmp_path)).collect()}
    assert len(back) == 8 and all(r.error is None for r in back.values())  # the two empty text files give no rows
