"""Text files and office documents as data frames, read with the standard library alone.

Files come from Spark's ``binaryFile`` source, one row a file, and are parsed where they lie. A file that cannot be
parsed gives a row with a null text and the reason in ``error``; none stops the job.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as X

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
PML = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _paragraph(p: X.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag == f"{W}tab":
            out.append("\t")
        elif e.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def _cells(row: X.Element) -> list[str]:
    return ["\n".join(_paragraph(p) for p in c.iter(f"{W}p")).strip() for c in row.findall(f"{W}tc")]


def markdown_rows(rows: list[list[str]]) -> str:
    """Rows of cells as a Markdown table, short rows padded."""
    if not rows:
        return ""
    width = max(map(len, rows))
    flat = [[c.replace("\n", " ").strip() for c in r] + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(flat[0]), line(["---"] * width), *map(line, flat[1:])])


def _body(data: bytes) -> tuple[X.Element, dict[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in X.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                styles[s.get(f"{W}styleId", "")] = name.get(f"{W}val", "") if name is not None else ""
        return X.fromstring(z.read("word/document.xml")).find(f"{W}body"), styles


def docx_text(data: bytes, tables: bool = True) -> str:
    """Paragraphs first, then, if asked, all rows of tables with their cells that aren't empty."""
    body, _ = _body(data)
    out = [t for t in (_paragraph(p).strip() for p in body.findall(f"{W}p")) if t]
    if tables:
        for table in body.findall(f"{W}tbl"):
            for row in table.findall(f"{W}tr"):
                cells = [c for c in _cells(row) if c]
                if cells:
                    out.append("| " + " | ".join(cells) + " |")
    return "\n\n".join(out)


def docx_blocks(data: bytes) -> list[dict]:
    """Paragraphs and tables in document order, with style, level, and what they hold; blank paragraphs keep their number."""
    body, styles = _body(data)
    out, para = [], 0
    for e in body:
        if e.tag == f"{W}p":
            text = _paragraph(e).strip()
            drawing = e.find(f".//{W}drawing") is not None or e.find(f".//{W}pict") is not None
            math = e.find(f".//{M}oMath") is not None or e.find(f".//{M}oMathPara") is not None
            ref = e.find(f"{W}pPr/{W}pStyle")
            style = styles.get(ref.get(f"{W}val", ""), ref.get(f"{W}val", "")) if ref is not None else "Normal"
            if text or drawing or math:
                m = re.search(r"heading\s*(\d+)", style, re.I)
                heading = style.lower().startswith("heading") or style.lower() == "title"
                kind = "heading" if heading else "list_item" if style.lower().startswith("list") or text.startswith(("- ", "* ", "• ")) else "paragraph"
                out.append({"block_idx": len(out), "type": kind, "text": text, "style": style, "level": (int(m.group(1)) if m else 1) if heading else 0, "has_drawing": drawing, "has_math": math, "para_idx": para})
            para += 1
        elif e.tag == f"{W}tbl":
            text = markdown_rows([_cells(r) for r in e.findall(f"{W}tr")])
            if text.strip():
                out.append({"block_idx": len(out), "type": "table", "text": text, "style": "Table", "level": 0, "has_drawing": False, "has_math": False, "para_idx": None})
    return out


def _related(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    join = lambda t: t.lstrip("/") if t.startswith("/") else re.sub(r"[^/]+/\.\./", "", f"{folder}/{t}")
    return {e.get("Id"): (e.get("Type", "").rpartition("/")[2], join(e.get("Target", ""))) for e in X.fromstring(z.read(path))}


def _frame(body: X.Element) -> list[str]:
    return [t for t in ("".join(r.text or "" for r in p.iter(f"{A}t")).strip() for p in body.findall(f"{A}p")) if t]


def pptx_text(data: bytes) -> str:
    """Slides in order: title, text frames, tables as Markdown, speaker notes; parted by rules."""
    slides = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        deck = X.fromstring(z.read("ppt/presentation.xml"))
        rels = _related(z, "ppt/presentation.xml")
        parts = [rels[s.get(f"{R}id")][1] for s in deck.iter(f"{PML}sldId")]
        for number, part in enumerate(parts, 1):
            tree = X.fromstring(z.read(part)).find(f"{PML}cSld/{PML}spTree")
            title, lines = "", []
            for shape in tree:
                holder = shape.find(f"{PML}nvSpPr/{PML}nvPr/{PML}ph")
                body = shape.find(f"{PML}txBody")
                table = shape.find(f".//{A}tbl")
                if holder is not None and holder.get("type") in ("title", "ctrTitle") and body is not None and not title:
                    title = " ".join(_frame(body))
                elif body is not None:
                    lines += _frame(body)
                elif table is not None:
                    lines.append(markdown_rows([["\n".join(_frame(c.find(f"{A}txBody"))) for c in r.findall(f"{A}tc")] for r in table.findall(f"{A}tr")]))
            for kind, target in _related(z, part).values():
                if kind == "notesSlide":
                    notes = []
                    for shape in X.fromstring(z.read(target)).iter(f"{PML}sp"):
                        holder = shape.find(f"{PML}nvSpPr/{PML}nvPr/{PML}ph")
                        if holder is not None and holder.get("type") == "body" and shape.find(f"{PML}txBody") is not None:
                            notes += _frame(shape.find(f"{PML}txBody"))
                    if notes:
                        lines.append(f"> **Speaker Notes (Slide {number}):** " + "\n".join(notes))
            slides.append("\n\n".join([f"# Slide {number}: {title}" if title else f"# Slide {number}", *lines]))
    return "\n\n---\n\n".join(slides)


_STRING = re.compile(rb"\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]+>")
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1).isdigit() else _ESCAPE.get(m.group(1), m.group(1)), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "ignore") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "ignore")


def pdf_text(data: bytes) -> str:
    """Text of the content streams of a plain PDF (flate or no compression, simple fonts); one block a stream.

    No fonts' own encodings and no encryption: such files give what can be read, or nothing.
    """
    pages = []
    for m in re.finditer(rb"<<(?:(?!endobj).)*?>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m.group(1)
        if b"FlateDecode" in m.group(0)[: m.start(1) - m.start()]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        lines: list[str] = [""]
        for op in re.finditer(rb"\[((?:\\.|[^\]\\])*)\]\s*TJ|(\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]+>)\s*(?:Tj|'|\")|\bT\*|\bT[dDm]\b|\bET\b", body, re.S):
            if op.group(1) is not None:
                lines[-1] += "".join(map(_pdf_string, _STRING.findall(op.group(1))))
            elif op.group(2) is not None:
                lines[-1] += _pdf_string(op.group(2))
            elif lines[-1]:
                lines.append("")
        text = "\n".join(x for x in lines if x.strip()).strip()
        if text:
            pages.append(text)
    return "\n\n".join(pages)


def plain_text(data: bytes) -> str:
    """UTF-8 without the bytes that are none."""
    return data.decode("utf-8", errors="ignore")


READERS = {"docx": docx_text, "pptx": pptx_text, "pdf": pdf_text, "txt": plain_text, "md": plain_text}


_KINDS = "*.{docx,pptx,pdf,txt,md,DOCX,PPTX,PDF,TXT,MD}"


def _files(spark: SparkSession, path: str, names: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path).select("path", "content")


def parse_documents(files: DataFrame, tables: bool = True) -> DataFrame:
    """``path, file_type, text, error`` of files given as ``path, content``; the type is the path's ending.

    Of Word files ``tables`` says whether rows of tables follow the paragraphs. A file that cannot be read has a null text
    and says why.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"]):
                kind = name.rpartition(".")[2].lower()
                try:
                    rows.append((name, kind, docx_text(data, tables) if kind == "docx" else READERS[kind](data), None))
                except Exception as e:
                    rows.append((name, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "file_type", "text", "error"])

    return files.mapInPandas(read, "path string, file_type string, text string, error string")


def read_documents(spark: SparkSession, path: str, tables: bool = True) -> DataFrame:
    """``parse_documents`` of all docx, pptx, pdf, txt and md files under a path."""
    return parse_documents(_files(spark, path, _KINDS), tables)


def parse_docx_blocks(files: DataFrame) -> DataFrame:
    """Blocks of Word files given as ``path, content``, in document order; a file that cannot be read gives one row with ``error``."""
    columns = ["path", "block_idx", "type", "text", "style", "level", "has_drawing", "has_math", "para_idx", "error"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [{"path": name, **b} for b in docx_blocks(data)]
                except Exception as e:
                    rows.append({"path": name, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})

    return files.mapInPandas(read, "path string, block_idx int, type string, text string, style string, level int, has_drawing boolean, has_math boolean, para_idx int, error string")


def read_docx_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all docx files under a path, in document order."""
    return parse_docx_blocks(_files(spark, path, "*.{docx,DOCX}"))


def write_text(df: DataFrame, path: str, text: str = "text") -> None:
    """Each row's text, without heading marks, as lines of text files."""
    from ..functions.text import strip_headings
    from pyspark.sql import functions as F

    df.select(strip_headings(F.col(text)).alias("value")).write.mode("overwrite").text(path)
