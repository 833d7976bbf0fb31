"""Markdown texts as office documents, made with the standard library.

``to_documents`` gives a frame with a binary column, which any of Spark's writers stores; ``write_files`` puts one file a
row into a folder that all executors mount, each under a name of its own first and then renamed, so that a task run twice
leaves whole files.
"""

from __future__ import annotations

import io
import os
import re
import textwrap
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_HEADING = re.compile(r"(#{1,6})\s+(.*)", re.S)
_DIVIDER = re.compile(r"\|[\s\-:|]+\|$")
_BAD = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _safe(text: str) -> str:
    return escape(_BAD.sub("", text))


def _blocks(text: str) -> list[str]:
    return [b.strip() for b in re.split(r"\n\s*\n", text) if b.strip()]


def _rows(block: str) -> list[list[str]] | None:
    """Cells of a Markdown table; None where a block is none."""
    lines = [x.strip() for x in block.split("\n") if x.strip()]
    if len(lines) < 2 or not all(x.startswith("|") and x.endswith("|") for x in lines):
        return None
    rows = [[c.strip() for c in x.strip("|").split("|")] for x in lines if not _DIVIDER.match(x)]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def _relations(*items: tuple[str, str, str]) -> str:
    return f'{_XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{_RELS}/{t}" Target="{to}"/>' for i, t, to in items) + "</Relationships>"


def _types(*items: tuple[str, str]) -> str:
    kind = "application/vnd.openxmlformats-officedocument."
    return f'{_XML}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/{p}" ContentType="{kind}{t}+xml"/>' for p, t in items) + "</Types>"


def _package(parts: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(zipfile.ZipInfo(name), xml)  # a fixed date: equal texts give equal files
    return data.getvalue()


def docx_bytes(text: str, contents: bool = False) -> bytes:
    """Headings, paragraphs, list items and tables of a Markdown text as a Word document, with a list of headings if asked."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t: "<w:br/>".join(f'<w:t xml:space="preserve">{_safe(x)}</w:t>' for x in t.split("\n"))
    para = lambda t, style="": "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + f"<w:r>{run(t)}</w:r></w:p>"
    blocks = _blocks(text)
    body = []
    heads = [m for m in map(_HEADING.fullmatch, blocks) if m]
    if contents and len(heads) >= 2:
        body += [para("Table of Contents"), *(para("    " * (len(m.group(1)) - 1) + m.group(2)) for m in heads)]
    for block in blocks:
        m, rows = _HEADING.fullmatch(block), _rows(block)
        if m:
            body.append(para(m.group(2), f"Heading{len(m.group(1))}"))
        elif rows:
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>")
        elif all(re.match(r"[-*•]\s", x) for x in block.split("\n")):
            body += [para(re.sub(r"^[-*•]\s+", "", x), "ListBullet") for x in block.split("\n")]
        else:
            body.append(para(block))
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/></w:style>' for i in range(1, 7)) + '<w:style w:type="paragraph" w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style>'
    return _package({
        "[Content_Types].xml": _types(("word/document.xml", "wordprocessingml.document.main"), ("word/styles.xml", "wordprocessingml.styles")),
        "_rels/.rels": _relations(("r1", "officeDocument", "word/document.xml")),
        "word/_rels/document.xml.rels": _relations(("r1", "styles", "styles.xml")),
        "word/styles.xml": f"{_XML}<w:styles {ns}>{styles}</w:styles>",
        "word/document.xml": f"{_XML}<w:document {ns}><w:body>{''.join(body)}</w:body></w:document>",
    })


def slides_of(text: str) -> list[tuple[str, list[str]]]:
    """Title and lines of each slide: parted by rules, else before headings of level 1."""
    parts = re.split(r"(?m)^---[ \t]*$", text)
    if len(parts) < 2:
        parts = [p for p in re.split(r"(?m)^(?=#\s)", text) if p.strip()] or [text]
    out = []
    for k, part in enumerate(parts, 1):
        lines = [x.strip() for x in part.split("\n") if x.strip()]
        heads = [x for x in lines if x.startswith("#")]
        if lines:
            out.append((heads[-1].lstrip("#").strip() if heads else f"Slide {k}", [x.lstrip("*-• ") for x in lines if not x.startswith("#")]))
    return out


def pptx_bytes(text: str) -> bytes:
    """Slides of a Markdown text as a PowerPoint file with one plain layout."""
    ns = f'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="{_RELS}"'
    group = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'

    def shape(k: int, kind: str, lines: list[str]) -> str:
        top, height = (300000, 1000000) if kind == "title" else (1500000, 4800000)
        frame = f'<p:spPr><a:xfrm><a:off x="450000" y="{top}"/><a:ext cx="8200000" cy="{height}"/></a:xfrm></p:spPr>'
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{k}" name="{kind}"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr>{frame}<p:txBody><a:bodyPr/>' + "".join(f"<a:p><a:r><a:t>{_safe(x)}</a:t></a:r></a:p>" for x in lines or [""]) + "</p:txBody></p:sp>"

    tree = lambda shapes: f"<p:cSld><p:spTree>{group}{shapes}</p:spTree></p:cSld>"
    slides = slides_of(text)
    colours = "".join(f'<a:{n}><a:srgbClr val="{c}"/></a:{n}>' for n, c in (("dk1", "000000"), ("lt1", "FFFFFF"), ("dk2", "333333"), ("lt2", "EEEEEE"), *((f"accent{i}", "4472C4") for i in range(1, 7)), ("hlink", "0563C1"), ("folHlink", "954F72")))
    font = '<a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/>'
    fill, line, effect = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>', '<a:ln><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>', "<a:effectStyle><a:effectLst/></a:effectStyle>"
    theme = f'<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" name="plain"><a:themeElements><a:clrScheme name="plain">{colours}</a:clrScheme><a:fontScheme name="plain"><a:majorFont>{font}</a:majorFont><a:minorFont>{font}</a:minorFont></a:fontScheme><a:fmtScheme name="plain"><a:fillStyleLst>{fill * 3}</a:fillStyleLst><a:lnStyleLst>{line * 3}</a:lnStyleLst><a:effectStyleLst>{effect * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>'
    colour_map = '<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" ' + " ".join(f'accent{i}="accent{i}"' for i in range(1, 7)) + ' hlink="hlink" folHlink="folHlink"/>'
    names = [f"ppt/slides/slide{i}.xml" for i in range(1, len(slides) + 1)]
    parts = {
        "[Content_Types].xml": _types(("ppt/presentation.xml", "presentationml.presentation.main"), ("ppt/slideMasters/slideMaster1.xml", "presentationml.slideMaster"), ("ppt/slideLayouts/slideLayout1.xml", "presentationml.slideLayout"), ("ppt/theme/theme1.xml", "theme"), *((n, "presentationml.slide") for n in names)),
        "_rels/.rels": _relations(("r1", "officeDocument", "ppt/presentation.xml")),
        "ppt/_rels/presentation.xml.rels": _relations(("m1", "slideMaster", "slideMasters/slideMaster1.xml"), *((f"s{i}", "slide", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1))),
        "ppt/presentation.xml": f'{_XML}<p:presentation {ns}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="m1"/></p:sldMasterIdLst><p:sldIdLst>' + "".join(f'<p:sldId id="{255 + i}" r:id="s{i}"/>' for i in range(1, len(slides) + 1)) + '</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
        "ppt/slideMasters/slideMaster1.xml": f'{_XML}<p:sldMaster {ns}>{tree("")}{colour_map}<p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="l1"/></p:sldLayoutIdLst></p:sldMaster>',
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _relations(("l1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("t1", "theme", "../theme/theme1.xml")),
        "ppt/slideLayouts/slideLayout1.xml": f"{_XML}<p:sldLayout {ns}>{tree('')}</p:sldLayout>",
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": _relations(("m1", "slideMaster", "../slideMasters/slideMaster1.xml")),
        "ppt/theme/theme1.xml": _XML + theme,
    }
    for name, (title, lines) in zip(names, slides):
        parts[name] = f"{_XML}<p:sld {ns}>{tree(shape(2, 'title', [title]) + shape(3, 'body', lines))}</p:sld>"
        folder, _, file = name.rpartition("/")
        parts[f"{folder}/_rels/{file}.rels"] = _relations(("l1", "slideLayout", "../slideLayouts/slideLayout1.xml"))
    return _package(parts)


def pdf_bytes(text: str, width: int = 90, lines: int = 54) -> bytes:
    """A text as pages of plain lines. Letters outside the Latin code page become question marks."""
    out: list[str] = []
    for block in _blocks(text):
        m = _HEADING.fullmatch(block)
        for x in (m.group(2) if m else block).split("\n"):
            out += textwrap.wrap(x, width) or [""]
        out.append("")
    pages = [out[i : i + lines] for i in range(0, len(out), lines)] or [[""]]
    raw = lambda x: b"(" + re.sub(rb"([()\\])", rb"\\\1", x.encode("cp1252", "replace")) + b") Tj T*"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for i, page in enumerate(pages):
        stream = b"BT /F1 10 Tf 13 TL 60 780 Td\n" + b"\n".join(map(raw, page)) + b"\nET"
        objects += [b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i), b"<< /Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream"]
    data, places = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(data))
        data += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return data + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(data))


WRITERS = {"docx": docx_bytes, "pptx": pptx_bytes, "pdf": pdf_bytes, "txt": lambda t: re.sub(r"(?m)^#{1,6}\s+", "", t).encode(), "md": str.encode}


def to_documents(df: DataFrame, kind: str, name: str, text: str = "text") -> DataFrame:
    """``name`` and ``content``, the file's bytes. Null texts count as empty."""
    kept = df.select(F.col(name).cast("string").alias("name"), F.coalesce(text, F.lit("")).alias("text"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "content": [WRITERS[kind](t) for t in pdf["text"]]})

    return kept.mapInPandas(make, "name string, content binary")


def write_files(df: DataFrame, folder: str, kind: str, name: str, text: str = "text") -> None:
    """One file a row in a folder that all executors mount; signs that a file name can't have become underscores."""

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            path = os.path.join(folder, re.sub(r"[^\w.\-]", "_", r["name"] or "unnamed") + f".{kind}")
            part = f"{path}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, path)

    to_documents(df, kind, name, text).foreachPartition(write)
