"""Blocks to files: delimited text, Markdown, HTML, JSON, DOCX and XLSX, one file to a document."""

from __future__ import annotations

import io
import json
import zipfile
from html import escape
from xml.sax.saxutils import escape as xml_escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.batches import mapped

_CONTROL = dict.fromkeys([*range(9), 11, 12, *range(14, 32)])


def _x(text: str | None) -> str:
    return xml_escape((text or "").translate(_CONTROL), {'"': "&quot;", "'": "&apos;"})


def delimited(matrix: list[list[str]], sep: str = ",", bom: bool = True) -> str:
    """Delimited rows with CRLF ends; only fields that must be are quoted."""
    quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ('"', "\r", "\n", sep)) else v
    return ("\ufeff" if bom else "") + "\r\n".join(sep.join(quote(str(v or "")) for v in row) for row in matrix)


def matrix(block: dict, repeat: bool = False) -> list[list[str]]:
    """Texts of a table by row and column; spanned places are empty, or repeat the text."""
    out = [[""] * (block.get("columns") or 1) for _ in range(block.get("rows") or 1)]
    for c in block.get("cells") or []:
        if c["hidden"]:
            continue
        for r in range(c["row"], c["row"] + (c["row_span"] if repeat else 1)):
            for k in range(c["column"], c["column"] + (c["column_span"] if repeat else 1)):
                if r < len(out) and k < len(out[0]):
                    out[r][k] = c["text"] or ""
    return out


def plain(pages: list[list[dict]]) -> str:
    """Blocks from top to bottom, tables as tabs with spanned texts repeated, pages apart."""

    def one(b: dict) -> str:
        return "\n".join("\t".join(row) for row in matrix(b, True)) if b["type"] == "table" else b["text"] or ""

    return "\n\n---\n\n".join("\n\n".join(t for t in (one(b) for b in sorted(p, key=lambda b: (b["y"] or 0, b["x"] or 0))) if t) for p in pages)


def markdown(pages: list[list[dict]], title: str = "") -> str:
    def table(b: dict) -> str:
        rows = [["".join(v.replace("|", "\\|").replace("\n", "<br>")) for v in row] for row in matrix(b)]
        lines = ["| " + " | ".join(row) + " |" for row in rows]
        return "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]])

    def one(b: dict) -> str:
        return table(b) if b["type"] == "table" else ("## " if b["role"] == "heading" else "") + (b["text"] or "")

    return (f"# {title}\n\n" if title else "") + "\n\n---\n\n".join("\n\n".join(one(b) for b in p if b["type"] == "table" or b["text"]) for p in pages)


def html(pages: list[list[dict]], title: str = "") -> str:
    """Absolutely placed blocks, a section to a page."""

    def one(b: dict) -> str:
        box = f'style="position:absolute;left:{b["x"] or 0:g}px;top:{b["y"] or 0:g}px;width:{b["width"] or 0:g}px;min-height:{b["height"] or 0:g}px"'
        if b["type"] == "table":
            rows = "".join("<tr>" + "".join(f"<td>{escape(v)}</td>" for v in row) + "</tr>" for row in matrix(b))
            return f"<table {box}>{rows}</table>"
        return f"<div {box}>{escape(b['text'] or '')}</div>"

    return f"<!doctype html><html><head><meta charset=utf-8><title>{escape(title)}</title></head><body>" + "".join('<section style="position:relative">' + "".join(map(one, p)) + "</section>" for p in pages) + "</body></html>"


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)  # a fixed date: equal content is equal bytes
    return out.getvalue()


_HEAD = "<?xml" + ' version="1.0"' + ' encoding="UTF-8"?>'
_SCHEMAS = "http://schemas.openxmlformats" + ".org"
_TYPES, _RELS = (f"{_SCHEMAS}/package/2006/{x}" for x in ("content-types", "relationships"))
_OFFICE = f"{_SCHEMAS}/officeDocument/2006/relationships"
_WORD, _SHEET = (f"{_SCHEMAS}/{x}/2006/main" for x in ("wordprocessingml", "spreadsheetml"))
_PACKAGE = "application/vnd.openxmlformats" + "-package"
_MIME = "application/vnd.openxmlformats" + "-officedocument"


def _default(ending: str, mime: str) -> str:
    return f'<Default Extension="{ending}" ContentType="{mime}"/>'


def _package(main: str, mime: str, more: dict[str, str] | None = None) -> dict[str, str]:
    over = "".join(f'<Override PartName="/{k}" ContentType="{v}"/>' for k, v in ({main: mime} | (more or {})).items())
    return {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_TYPES}">{_default("xml", "application/xml")}{_default("rels", _PACKAGE + ".relationships+xml")}{over}</Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="{main}"/></Relationships>',
    }


def _paragraph(run: str, props: str = "") -> str:
    inner = props + "<w:r>" + run + "</w:r>"
    return "<w:p>" + inner + "</w:p>"


def docx(pages: list[list[dict]]) -> bytes:
    """Paragraphs and tables in reading order, with spans, a page break between pages."""

    def lines(text: str | None, style: str = "") -> str:
        props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return "".join(_paragraph(f'<w:t xml:space="preserve">{_x(s)}</w:t>', props) for s in (text or "").split("\n"))

    def table(b: dict) -> str:
        anchors = {(c["row"], c["column"]): c for c in b["cells"] or [] if not c["hidden"]}
        cover = {(r, k): c for c in anchors.values() for r in range(c["row"], c["row"] + c["row_span"]) for k in range(c["column"], c["column"] + c["column_span"])}
        out = []
        for r in range(b["rows"] or 1):
            row, k = [], 0
            while k < (b["columns"] or 1):
                c = cover.get((r, k))
                span, props = 1, ""
                if c:
                    span = c["column_span"]
                    props += f'<w:gridSpan w:val="{span}"/>' if span > 1 else ""
                    props += ('<w:vMerge w:val="restart"/>' if c["row"] == r else "<w:vMerge/>") if c["row_span"] > 1 else ""
                row.append(f"<w:tc><w:tcPr>{props}</w:tcPr>{lines(c['text'] if c and c['row'] == r else '')}</w:tc>")
                k += max(1, span)
            out.append("<w:tr>" + "".join(row) + "</w:tr>")
        return "<w:tbl>" + "".join(out) + "</w:tbl>"

    order = lambda p: sorted(p, key=lambda b: (b["y"] or 0, b["x"] or 0))
    body = _paragraph('<w:br w:type="page"/>').join("".join(table(b) if b["type"] == "table" else lines(b["text"], "Heading1" if b["role"] == "heading" else "") for b in order(p) if b["type"] == "table" or b["text"]) for p in pages)
    xml = f'{_HEAD}<w:document xmlns:w="{_WORD}"><w:body>{body}<w:sectPr><w:pgSz w:w="11910" w:h="16845"/></w:sectPr></w:body></w:document>'
    return _zip(_package("word/document.xml", f"{_MIME}.wordprocessingml.document.main+xml") | {"word/document.xml": xml})


def _points(px: float | None) -> str:
    return f"{max(0.0, px or 0.0) * 0.75:g}"


def _placed(b: dict) -> str:
    """Style of a shape that stands where the block stands on its page."""
    size = lambda v: f"{max(0.75, (v or 0.0) * 0.75):g}"
    return ";".join([
        "position:absolute", f"margin-left:{_points(b['x'])}pt", f"margin-top:{_points(b['y'])}pt", f"width:{size(b['width'])}pt", f"height:{size(b['height'])}pt", "mso-position-horizontal-relative:page", "mso-position-vertical-relative:page",
    ])


def _run_props(style: dict | None) -> str:
    """Run properties for a style: marks, colour, half points; nothing for no style."""
    if not style:
        return ""
    bare = (style.get("color") or "").removeprefix("#")
    colour = bare.upper() if len(bare) == 6 and all(c in "0123456789abcdefABCDEF" for c in bare) else "111827"
    marks = ("<w:b/>" if float(style.get("fontWeight") or 400) >= 600 else "") + ("<w:i/>" if style.get("fontStyle") == "italic" else "") + ('<w:u w:val="single"/>' if style.get("textDecoration") == "underline" else "")
    half = int(max(8.0, float(style.get("fontSize") or 16)) * 1.5 + 0.5)
    return f'<w:rPr>{marks}<w:color w:val="{colour}"/><w:sz w:val="{half}"/><w:szCs w:val="{half}"/></w:rPr>'


def docx_placed(pages: list[list[dict]]) -> bytes:
    """Every block in a frame of its own at its place on the page; texts keep their style, pictures their bytes, a section to a page."""
    body, images = [], {}

    def frame(b: dict) -> str:
        if b["type"] == "image" and b.get("content"):
            n = len(images) + 1
            images[f"word/media/image{n}.{(b['src'] or 'x.png').rsplit('.', 1)[-1]}"] = bytes(b["content"])
            inner = f'<v:imagedata r:id="rIdImage{n}"/>'
        elif b["type"] in ("shape", "line"):
            inner = ""
        else:
            texts = ["\t".join(row) for row in matrix(b)] if b["type"] == "table" else (b["text"] or " ").split("\n")
            inner = "<v:textbox><w:txbxContent>" + "".join(_paragraph(f'{_run_props(b.get("style"))}<w:t xml:space="preserve">{_x(t)}</w:t>') for t in texts) + "</w:txbxContent></v:textbox>"
        return _paragraph(f'<w:pict><v:rect style="{_placed(b)}" filled="f" stroked="{"t" if b["type"] in ("shape", "line") else "f"}">{inner}</v:rect></w:pict>')

    for i, p in enumerate(pages):
        width, height = (max([d, *(b[at] + b[side] for b in p if b[at] is not None and b[side] is not None)]) for at, side, d in (("x", "width", 794.0), ("y", "height", 1123.0)))
        size = f'<w:sectPr><w:pgSz w:w="{round(width * 15)}" w:h="{round(height * 15)}" w:orient="{"landscape" if width > height else "portrait"}"/><w:pgMar w:top="0" w:right="0" w:bottom="0" w:left="0"/></w:sectPr>'
        body.append("".join(map(frame, p)) + (size if i == len(pages) - 1 else f"<w:p><w:pPr>{size}</w:pPr></w:p>"))
    links = "".join(f'<Relationship Id="rIdImage{n}" Type="{_OFFICE}/image" Target="{path.removeprefix("word/")}"/>' for n, path in enumerate(images, 1))
    xml = f'{_HEAD}<w:document xmlns:w="{_WORD}" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:r="{_OFFICE}"><w:body>{"".join(body)}</w:body></w:document>'
    parts = _package("word/document.xml", f"{_MIME}.wordprocessingml.document.main+xml") | {"word/document.xml": xml, "word/_rels/document.xml.rels": f'{_HEAD}<Relationships xmlns="{_RELS}">{links}</Relationships>'}
    return _zip(parts | images)


def _inline(ref: str, text: str) -> str:
    inner = f'<t xml:space="preserve">{_x(text)}</t>'
    return f'<c t="inlineStr" r="{ref}"><is>' + inner + "</is></c>"


def _letters(c: int) -> str:
    out = ""
    while c >= 0:
        out, c = chr(65 + c % 26) + out, c // 26 - 1
    return out


def xlsx(pages: list[list[dict]]) -> bytes:
    """A sheet for each table, with merges; the texts of a page without tables are a sheet of their own."""
    sheets = []
    for i, p in enumerate(pages, 1):
        tables = [b for b in p if b["type"] == "table"]
        if not tables and any(b["text"] for b in p):
            texts = [b["text"] for b in p if b["text"]]
            tables = [{"rows": len(texts), "columns": 1, "cells": [{"row": r, "column": 0, "row_span": 1, "column_span": 1, "text": t, "hidden": False} for r, t in enumerate(texts)]}]
        sheets += [(f"Page {i} Table {k}", b) for k, b in enumerate(tables, 1)]
    sheets = sheets or [("Page 1", {"rows": 1, "columns": 1, "cells": []})]
    ns = _SHEET
    parts, rels, names, types = {}, [], [], {}
    for k, (name, b) in enumerate(sheets, 1):
        by_row: dict[int, list] = {}
        for c in sorted((c for c in b["cells"] or [] if not c["hidden"]), key=lambda c: (c["row"], c["column"])):
            by_row.setdefault(c["row"], []).append(c)
        rows = "".join(f'<row r="{r + 1}">' + "".join(_inline(f'{_letters(c["column"])}{r + 1}', c["text"]) for c in cs) + "</row>" for r, cs in by_row.items())
        spans = [f'<mergeCell ref="{_letters(c["column"])}{c["row"] + 1}:{_letters(c["column"] + c["column_span"] - 1)}{c["row"] + c["row_span"]}"/>' for cs in by_row.values() for c in cs if c["row_span"] > 1 or c["column_span"] > 1]
        merges = f'<mergeCells count="{len(spans)}">{"".join(spans)}</mergeCells>' if spans else ""
        parts[f"xl/worksheets/sheet{k}.xml"] = f'{_HEAD}<worksheet xmlns="{ns}"><sheetData>{rows}</sheetData>{merges}</worksheet>'
        types[f"xl/worksheets/sheet{k}.xml"] = f"{_MIME}.spreadsheetml.worksheet+xml"
        rels.append(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>')
        names.append(f'<sheet name="{_x(name)[:31]}" sheetId="{k}" r:id="rId{k}"/>')
    parts["xl/workbook.xml"] = f'{_HEAD}<workbook xmlns="{ns}" xmlns:r="{_OFFICE}"><sheets>{"".join(names)}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'{_HEAD}<Relationships xmlns="{_RELS}">{"".join(rels)}</Relationships>'
    return _zip(_package("xl/workbook.xml", f"{_MIME}.spreadsheetml.sheet.main+xml", types) | parts)


def to_json(pages: list[list[dict]], title: str = "") -> str:
    return json.dumps({"version": "3", "name": title, "pages": [{"number": i, "blocks": p} for i, p in enumerate(pages, 1)]}, ensure_ascii=False, indent=2, default=str)


WRITERS = {
    "txt": lambda p, t: plain(p).encode(), "md": lambda p, t: markdown(p, t).encode(), "html": lambda p, t: html(p, t).encode(), "json": lambda p, t: to_json(p, t).encode(), "docx": lambda p, t: docx(p), "docx-original": lambda p, t: docx_placed(p), "xlsx": lambda p, t: xlsx(p),
    "csv": lambda p, t: delimited([row for page in p for b in page if b["type"] == "table" for row in matrix(b)]).encode(),
}


def export(blocks: DataFrame, kind: str, pages: list[int] | None = None) -> DataFrame:
    """(path, content) of each document of a DataFrame of blocks, in one of the formats of ``WRITERS``; of some pages, if they are named."""
    if kind not in WRITERS:
        raise ValueError(f"no writer for {kind!r}")
    if pages is not None:
        blocks = blocks.where(F.col("page_no").isin(pages))

    def run(f):
        for path, rows in zip(f["path"], f["rows"], strict=True):
            pages: dict = {}
            for r in sorted(rows, key=lambda r: (r["page_no"], r["block_no"])):
                b = dict(r) | {"cells": None if r["cells"] is None else [dict(c) for c in r["cells"]]}
                pages.setdefault(r["page_no"], []).append(b)
            yield path, WRITERS[kind](list(pages.values()), path.rsplit("/", 1)[-1])

    names = [c for c in blocks.columns if c not in ("path", "error")]
    return mapped(blocks.groupBy("path").agg(F.collect_list(F.struct(*names)).alias("rows")), run, "path string, content binary")


def zip_images(pages: DataFrame) -> DataFrame:
    """(path, content) of (path, page_no, image): the images of a document's pages in one archive, named by their order.

    Pages without an image are left out of the archive, but keep their number.
    """

    def run(f):
        for path, rows in zip(f["path"], f["rows"], strict=True):
            made = io.BytesIO()
            with zipfile.ZipFile(made, "w", zipfile.ZIP_STORED) as z:
                for i, r in enumerate(sorted(rows, key=lambda r: r["page_no"]), 1):
                    if r["image"] is not None:
                        z.writestr(zipfile.ZipInfo(f"page-{i:03d}.jpg"), bytes(r["image"]))
            yield path, made.getvalue()

    return mapped(pages.groupBy("path").agg(F.collect_list(F.struct("page_no", "image")).alias("rows")), run, "path string, content binary")
