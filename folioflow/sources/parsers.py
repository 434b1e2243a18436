"""File contents to positioned blocks: delimited text, plain text, HTML, RTF, JSON, OOXML and OpenDocument.

A parser takes bytes and a name and returns pages; a page is a dict with name, width, height and blocks; a block has a type, role,
text, box and, for tables, rows, columns and cells. Only the standard library is used.
"""

from __future__ import annotations

import io
import json
import math
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

PAGE = (794.0, 1123.0)
MARGINS = {"left": 60.0, "right": 60.0, "bottom": 56.0, "top": 56.0}


class ParseError(ValueError):
    """The content is not what its ending says."""


def decode(raw: bytes) -> str:
    return raw.decode("utf-8-sig", errors="replace")


def text_height(text: str, size: float, width: float, line: float = 1.45) -> float:
    per = max(1, int(width // max(6.0, size * 0.56)))
    lines = sum(max(1, math.ceil(len(s) / per)) for s in text.split("\n"))
    return max(1, lines) * size * line + 8


class Flow:
    """Blocks laid out one under the other; what doesn't fit goes on a new page.

    A block taller than a page is kept and marked as overflowing; ``strict`` leaves it out.
    """

    def __init__(self, width: float = PAGE[0], height: float = PAGE[1], margins: dict | None = None, strict: bool = False):
        self.size, self.margins, self.strict = (width, height), MARGINS | (margins or {}), strict
        self.pages: list[dict] = []
        self.new_page()

    @property
    def width(self) -> float:
        return max(120.0, self.size[0] - self.margins["left"] - self.margins["right"])

    def new_page(self) -> None:
        self.pages.append({"name": "", "width": self.size[0], "height": self.size[1], "blocks": []})
        self.y = self.margins["top"]

    def put(self, height: float, gap: float, **block) -> None:
        limit = self.size[1] - self.margins["bottom"]
        if self.y + height > limit:
            self.new_page()
        over = self.y + height > limit
        if over and self.strict:
            return
        self.pages[-1]["blocks"].append({"x": self.margins["left"], "y": self.y, "width": block.pop("width", self.width), "height": height, "overflow": over, **block})
        self.y += height + gap

    def text(self, text: str, role: str = "paragraph", size: float | None = None, **more) -> None:
        text = text.rstrip()
        if text:
            size = size or (28.0 if role == "heading" else 16.0)
            self.put(text_height(text, size, self.width), 16 if role == "heading" else 8, type=role if role in ("header", "footer") else "text", role=role, text=text, **more)

    def table(self, rows: int, columns: int, cells: list[dict], line: float = 40.0) -> None:
        self.put(max(80.0, rows * line), 14, type="table", role="table", text="", rows=rows, columns=columns, cells=cells)


def cell(row: int, column: int, text: str = "", row_span: int = 1, column_span: int = 1, hidden: bool = False) -> dict:
    return {"row": row, "column": column, "row_span": row_span, "column_span": column_span, "text": text, "hidden": hidden}


def grid(matrix: list[list[str]]) -> tuple[int, int, list[dict]]:
    columns = max([1, *map(len, matrix)])
    return max(1, len(matrix)), columns, [cell(r, c, row[c] if c < len(row) else "") for r, row in enumerate(matrix) for c in range(columns)]


def parse_delimited(text: str, delimiter: str = "") -> list[list[str]]:
    """Rows of delimited text; the delimiter is the commonest of four in the first line, quotes may stand anywhere."""
    text = text.removeprefix("\ufeff")
    if not delimiter:
        first = re.split(r"\r?\n", text, maxsplit=1)[0]
        delimiter = max(",\t;|", key=first.count)
    rows: list[list[str]] = [[]]
    field: list[str] = []
    at, quoted = 0, False

    def end_field(last: bool) -> None:
        value = "".join(field)
        rows[-1].append(value.removesuffix("\r") if last else value)
        field.clear()

    while at < len(text):
        c = text[at]
        if quoted and text.startswith('""', at):
            field.append('"')
            at += 1
        elif c == '"':
            quoted = not quoted
        elif quoted:
            field.append(c)
        elif c == delimiter:
            end_field(False)
        elif c == "\n":
            end_field(True)
            rows.append([])
        else:
            field.append(c)
        at += 1
    end_field(True)
    if len(rows) > 1 and not any(rows[-1]):
        rows.pop()
    width = max([1, *map(len, rows)])
    return [r + [""] * (width - len(r)) for r in rows]


def delimited_pages(raw: bytes, name: str) -> list[dict]:
    matrix = parse_delimited(decode(raw), "\t" if name.lower().endswith(".tsv") else "")
    rows, columns, cells = grid(matrix)
    width, height = max(PAGE[0], columns * 140 + 80), max(600, rows * 40 + 130)
    return [{"name": name, "width": width, "height": height, "blocks": [
        {"type": "text", "role": "heading", "text": name, "x": 40, "y": 26, "width": width - 80, "height": 42},
        {"type": "table", "role": "table", "text": "", "x": 40, "y": 82, "width": width - 80, "height": max(100, rows * 38), "rows": rows, "columns": columns, "cells": cells},
    ]}]


def text_pages(raw: bytes, name: str, strict: bool = False) -> list[dict]:
    flow = Flow(strict=strict)
    for part in re.split(r"\n{2,}", decode(raw).replace("\r\n", "\n")):
        flow.text(part.strip())
    return flow.pages


_RTF = re.compile(r"\\pard?\b|\\tab\b|\\u(?P<u>-?\d+)\??|\\'(?P<hex>[0-9a-fA-F]{2})")


def rtf_text(source: str) -> str:
    """Plain text of RTF: paragraphs, tabs, Unicode and code-page signs; other controls and starred groups go."""

    def change(m: re.Match) -> str:
        if m["u"]:
            return chr(int(m["u"]) % 65536)
        if m["hex"]:
            return bytes.fromhex(m["hex"]).decode("cp1252", errors="replace")
        return "\t" if m[0].startswith("\\tab") else "\n"

    text = _RTF.sub(change, source)
    text = re.sub(r"\{\\\*(?:[^{}]|\{[^{}]*\})*\}", "{}", text)  # the braces still end the control word before
    text = re.sub(r"[{}]", "", re.sub(r"\\[A-Za-z]+-?\d* ?", "", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


class _Body(HTMLParser):
    """Children of the body with their text; tables as anchored cells, images with their box."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    BLOCKS = {"p", "div", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "section", "article", "nav", "pre", "form", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.items: list[dict] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("html", "body", "head"):
            return
        if tag in ("script", "style", "title"):
            self.skip += tag not in self.VOID
            return
        if "p" in self.stack and tag in self.BLOCKS:  # an open paragraph ends where a block begins
            self.end("p")
        if tag in ("tr", "td", "th", "li"):
            for t in {"tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "li": ("li",)}[tag]:
                if t in self.stack and "table" not in self.stack[self.stack.index(t) + 1 :] and "ul" not in self.stack[self.stack.index(t) + 1 :]:
                    self.end(t)
        if not self.stack:
            self.items.append({"tag": tag, "text": [], "attrs": a, "rows": [], "busy": set()})
        top = self.items[-1]
        if top["tag"] == "table":
            if tag == "tr":
                top["rows"].append([])
            elif tag in ("td", "th"):
                if not top["rows"]:
                    top["rows"].append([])
                r = len(top["rows"]) - 1
                c = 0
                while (r, c) in top["busy"]:
                    c += 1
                rs, cs = (max(1, int(a.get(k) or 1)) if (a.get(k) or "1").isdigit() else 1 for k in ("rowspan", "colspan"))
                top["busy"] |= {(r + i, c + j) for i in range(rs) for j in range(cs)}
                top["rows"][-1].append({"row": r, "column": c, "row_span": rs, "column_span": cs, "text": [], "hidden": False})
        if tag not in self.VOID:
            self.stack.append(tag)

    def end(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip = max(0, self.skip - 1)
        elif tag not in ("html", "body", "head"):
            self.end(tag)

    def handle_data(self, data):
        if self.skip or not self.stack or not self.items:
            return
        top = self.items[-1]
        if top["tag"] == "table":
            if top["rows"] and top["rows"][-1]:
                top["rows"][-1][-1]["text"].append(data)
        else:
            top["text"].append(data)


def html_pages(raw: bytes, name: str, strict: bool = False) -> list[dict]:
    """Blocks of the body's own children: tables, images, headings, header and footer, anything else a paragraph."""
    body = _Body()
    body.feed(decode(raw))
    body.close()
    flow = Flow(strict=strict)
    for item in body.items:
        tag = item["tag"]
        if tag == "table":
            cells = [c | {"text": "".join(c["text"])} for row in item["rows"] for c in row]
            flow.table(max([1, *(r + 1 for r, _ in item["busy"])]), max([1, *(c + 1 for _, c in item["busy"])]), cells)
        elif tag == "img":
            number = lambda k, d: float(item["attrs"][k]) if item["attrs"].get(k, "").replace(".", "", 1).isdigit() else d  # noqa: E731, B023
            width = min(flow.width, number("width", 420.0))
            flow.put(number("height", max(120.0, width * 0.6)), 12, type="image", role="image", text=item["attrs"].get("alt", ""), width=width, src=item["attrs"].get("src", ""))
        else:
            heading = re.fullmatch(r"h([1-6])", tag)
            role = "heading" if heading else tag if tag in ("header", "footer") else "paragraph"
            flow.text("".join(item["text"]), role, max(20.0, 34.0 - 2 * int(heading[1])) if heading else 16.0)
    return flow.pages


def json_pages(raw: bytes, name: str) -> list[dict]:
    """A saved document model, or any other JSON as indented text."""
    data = json.loads(decode(raw))
    if isinstance(data, dict) and isinstance(data.get("pages"), list):
        return [{"name": p.get("name", ""), "width": p.get("width", PAGE[0]), "height": p.get("height", PAGE[1]), "blocks": p.get("blocks", [])} for p in data["pages"]]
    return text_pages(json.dumps(data, indent=2, ensure_ascii=False).encode(), name)


def tag(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def kids(node: ElementTree.Element | None, *names: str) -> list[ElementTree.Element]:
    return [] if node is None else [x for x in node if not names or tag(x) in names]


def below(node: ElementTree.Element | None, *names: str) -> list[ElementTree.Element]:
    return [] if node is None else [x for x in node.iter() if x is not node and tag(x) in names]


def first(node: ElementTree.Element | None, *names: str) -> ElementTree.Element | None:
    return next(iter(below(node, *names)), None)


def attr(node: ElementTree.Element | None, name: str, default: str = "") -> str:
    if node is not None:
        for k, v in node.attrib.items():
            if k.rsplit("}", 1)[-1] == name:
                return v
    return default


def number(x: str, default: float = 0.0) -> float:
    try:
        return float(x)
    except (TypeError, ValueError):
        return default


def xml_part(z: zipfile.ZipFile, path: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(z.read(path))
    except KeyError:
        return None
    except ElementTree.ParseError as e:
        raise ParseError(f"{path}: {e}") from e


def resolve(base: str, target: str) -> str:
    """Path of a part named relative to another part."""
    if target.startswith("/"):
        return target[1:]
    parts = base.split("/")[:-1]
    for s in target.split("/"):
        if s == "..":
            parts = parts[:-1]
        elif s not in ("", "."):
            parts.append(s)
    return "/".join(parts)


def relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    head, _, tail = part.rpartition("/")
    return {attr(r, "Id"): resolve(part, attr(r, "Target")) for r in below(xml_part(z, f"{head}/_rels/{tail}.rels"), "Relationship")}


def _open(raw: bytes, part: str) -> tuple[zipfile.ZipFile, ElementTree.Element]:
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise ParseError(str(e)) from e
    root = xml_part(z, part)
    if root is None:
        raise ParseError(f"{part} is missing")
    return z, root


def _run_text(r: ElementTree.Element) -> str:
    return "".join((x.text or "") if tag(x) == "t" else {"tab": "\t", "br": "\n"}.get(tag(x), "") for x in r)


def _runs(p: ElementTree.Element) -> str:
    return "".join(map(_run_text, kids(p, "r")))


DARK = "#111827"


def hex_colour(x: str, default: str = DARK) -> str:
    bare = x.removeprefix("#").strip()
    return f"#{bare}" if re.fullmatch("[0-9A-Fa-f]{6}", bare) else default


def docx_run_style(run: ElementTree.Element) -> dict:
    """Emphasis, size in pixels and colour of a run."""
    props = first(run, "rPr")
    size, colour = number(attr(first(props, "sz"), "val")), attr(first(props, "color"), "val")
    return {
        "fontWeight": 400 if first(props, "b") is None else 700, "fontStyle": "normal" if first(props, "i") is None else "italic", "textDecoration": "none" if first(props, "u") is None else "underline",
        "fontSize": size / 2 * 96 / 72 if size else 16.0, "color": hex_colour(colour) if colour != "auto" else DARK,
    }


def docx_paragraph(node: ElementTree.Element) -> dict:
    """Text, role, style and spans of a paragraph; its style is that of its first run, larger and bold in a heading."""
    spans = [{"text": t, "style": docx_run_style(r)} for r in kids(node, "r") if (t := _run_text(r))]
    props = next(iter(kids(node, "pPr")), None)
    heading = re.match(r"(?i)heading|หัวข้อ", attr(first(props, "pStyle"), "val")) is not None
    style = dict(spans[0]["style"]) if spans else {}
    if heading:
        style |= {"fontSize": max(22.0, style.get("fontSize", 24.0)), "fontWeight": 700}
    style["textAlign"] = {"center": "center", "right": "right", "both": "justify"}.get(attr(first(props, "jc"), "val"), "left")
    return {"text": "".join(x["text"] for x in spans), "spans": spans, "role": "heading" if heading else "paragraph", "style": style}


def docx_table(node: ElementTree.Element) -> tuple[int, int, list[dict]]:
    """Cells with their spans; a vertical merge goes on the anchor's row span."""
    cells, open_, columns, rows = [], {}, 0, kids(node, "tr")
    for r, row in enumerate(rows):
        c = 0
        for tc in kids(row, "tc"):
            props = next(iter(kids(tc, "tcPr")), None)
            span = max(1, int(number(attr(first(props, "gridSpan"), "val"), 1)))
            merge = first(props, "vMerge")
            if merge is not None and attr(merge, "val") != "restart":
                if c in open_:
                    open_[c]["row_span"] += 1
            else:
                cells.append(cell(r, c, "\n".join(_runs(p) for p in kids(tc, "p")), 1, span))
                open_.pop(c, None)
                if merge is not None:
                    open_[c] = cells[-1]
            c += span
        columns = max(columns, c)
    return max(1, len(rows)), max(1, columns), cells


def docx_pages(raw: bytes, name: str, strict: bool = False) -> list[dict]:
    z, root = _open(raw, "word/document.xml")
    links = relations(z, "word/document.xml")
    section = first(root, "sectPr")
    twips = lambda n, k, d: max(0.0, number(attr(first(section, n), k)) / 15) or d
    flow = Flow(twips("pgSz", "w", PAGE[0]), twips("pgSz", "h", PAGE[1]), {k: twips("pgMar", k, MARGINS[k]) for k in ("left", "right", "bottom")}, strict)
    for node in kids(first(root, "body"), "p", "tbl"):
        if tag(node) == "tbl":
            flow.table(*docx_table(node), line=42.0)
            continue
        for blip in below(node, "blip"):
            if path := links.get(attr(blip, "embed")):
                box = first(node, "extent")
                width, height = (max(least, number(attr(box, k)) / 9525 or d) for k, least, d in (("cx", 80, 240), ("cy", 60, 160)))
                flow.put(height, 10, type="image", role="image", text=path.rsplit("/", 1)[-1], width=min(width, flow.width), src=path, content=_part(z, path))
        p = docx_paragraph(node)
        flow.text(p["text"], p["role"], p["style"].get("fontSize", 16.0), style=p["style"], spans=p["spans"])
    return flow.pages


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_pages(raw: bytes, name: str) -> list[dict]:
    z, book = _open(raw, "xl/workbook.xml")
    links = relations(z, "xl/workbook.xml")
    strings = ["".join(t.text or "" for t in below(si, "t")) for si in below(xml_part(z, "xl/sharedStrings.xml"), "si")]
    pages = []
    for sheet in below(book, "sheet"):
        root = xml_part(z, links.get(attr(sheet, "id"), ""))
        found: dict[tuple[int, int], str] = {}
        for c in below(root, "c"):
            ref = attr(c, "r")
            value, kind = first(c, "v"), attr(c, "t")
            text = "".join(t.text or "" for t in below(c, "t")) if kind == "inlineStr" else (value.text or "") if value is not None else ""
            if kind == "s" and text:
                text = strings[int(text)]
            elif kind == "b" and text:
                text = "TRUE" if text == "1" else "FALSE"
            if text or value is not None:
                found[int(re.search(r"\d+", ref)[0]) - 1, _column(ref)] = text
        r0, c0 = (min((k[i] for k in found), default=0) for i in (0, 1))
        rows, columns = (max((k[i] for k in found), default=0) - o + 1 for i, o in ((0, r0), (1, c0)))
        table = {(r, c): cell(r, c, found.get((r + r0, c + c0), "")) for r in range(rows) for c in range(columns)}
        for m in below(root, "mergeCell"):
            a, b = (attr(m, "ref").split(":") * 2)[:2]
            top, left, bottom, right = int(re.search(r"\d+", a)[0]) - 1 - r0, _column(a) - c0, int(re.search(r"\d+", b)[0]) - 1 - r0, _column(b) - c0
            if (top, left) in table:
                for r in range(top, bottom + 1):
                    for c in range(left, right + 1):
                        if (r, c) in table:
                            table[r, c]["hidden"] = (r, c) != (top, left)
                table[top, left] |= {"row_span": bottom - top + 1, "column_span": right - left + 1}
        width, height = columns * 96.0, rows * 28.0
        pages.append({"name": attr(sheet, "name"), "width": max(900, width + 80), "height": max(600, height + 130), "blocks": [
            {"type": "text", "role": "heading", "text": attr(sheet, "name"), "x": 40, "y": 22, "width": max(900, width + 80) - 80, "height": 46},
            {"type": "table", "role": "table", "text": "", "x": 40, "y": 82, "width": width, "height": height, "rows": rows, "columns": columns, "cells": list(table.values())},
        ]})
    return pages


def _part(z: zipfile.ZipFile, path: str) -> bytes | None:
    """The bytes of a part, if the archive has it."""
    try:
        return z.read(path)
    except KeyError:
        return None


def xlsx_cell_styles(raw: bytes, header: int | None = 0) -> list[dict]:
    """(sheet, row, column, style) of the cells of a workbook; the row ``header`` is bold, centred and shaded unless it says otherwise."""
    z, book = _open(raw, "xl/workbook.xml")
    links, sheet_styles = relations(z, "xl/workbook.xml"), xml_part(z, "xl/styles.xml")
    part = lambda *names: kids(next(iter(below(sheet_styles, names[0])), None), *names[1:])
    fonts, fills, borders, formats = part("fonts", "font"), part("fills", "fill"), part("borders", "border"), part("cellXfs", "xf")
    nth = lambda items, x: items[int(x)] if x.isdigit() and int(x) < len(items) else None
    out = []
    for sheet in below(book, "sheet"):
        for c in below(xml_part(z, links.get(attr(sheet, "id"), "")), "c"):
            row = int(re.search(r"\d+", attr(c, "r"))[0]) - 1
            top, f = row == header, nth(formats, attr(c, "s", "0"))
            font, fill, border, place = nth(fonts, attr(f, "fontId")), nth(fills, attr(f, "fillId")), nth(borders, attr(f, "borderId")), first(f, "alignment")
            size, colour = number(attr(first(font, "sz"), "val")), attr(first(font, "color"), "rgb")
            ground = attr(first(fill, "fgColor"), "rgb") or attr(first(fill, "bgColor"), "rgb")
            line = lambda side: "1px solid " + ("#64748b" if attr(first(border, side), "style") else "#cbd5e1")  # noqa: E731, B023
            out.append({"sheet": attr(sheet, "name"), "row": row, "column": _column(attr(c, "r")), "style": {
                "fontWeight": 700 if top or first(font, "b") is not None else 400, "fontStyle": "normal" if first(font, "i") is None else "italic", "textDecoration": "none" if first(font, "u") is None else "underline", "fontSize": size * 96 / 72 if size else 14.0,
                "color": hex_colour(colour[-6:]) if colour else DARK, "backgroundColor": hex_colour(ground[-6:], "#ffffff") if ground else "#e2e8f0" if top else "#ffffff", "textAlign": attr(place, "horizontal") or ("center" if top else "left"), "verticalAlign": attr(place, "vertical") or "middle",
                **{f"border{side.capitalize()}": line(side) for side in ("top", "right", "bottom", "left")},
            }})
    return out


def pptx_text_style(shape: ElementTree.Element) -> dict:
    """Size in pixels, emphasis, colour and alignment of a shape's text."""
    run = first(shape, "rPr")
    run = first(shape, "defRPr") if run is None else run
    size, colour = number(attr(run, "sz")), attr(first(first(run, "solidFill"), "srgbClr", "schemeClr"), "val")
    return {
        "fontSize": size / 100 * 96 / 72 if size else 22.0, "fontWeight": 700 if attr(run, "b") == "1" else 400, "fontStyle": "italic" if attr(run, "i") == "1" else "normal", "color": hex_colour(colour),
        "textAlign": {"ctr": "center", "r": "right", "just": "justify"}.get(attr(first(shape, "pPr"), "algn"), "left"),
    }


def pptx_pages(raw: bytes, name: str) -> list[dict]:
    z, root = _open(raw, "ppt/presentation.xml")
    size = first(root, "sldSz")
    width, height = (number(attr(size, k)) / 9525 or d for k, d in (("cx", 1280.0), ("cy", 720.0)))
    slides = sorted((p for p in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", p)), key=lambda p: int(re.search(r"\d+", p)[0]))

    def box(shape):
        off, ext = first(shape, "off"), first(shape, "ext")
        px = lambda n, k: max(0.0, number(attr(n, k)) / 9525)
        return {"x": px(off, "x"), "y": px(off, "y"), "width": max(8.0, px(ext, "cx") or 160.0), "height": max(8.0, px(ext, "cy") or 60.0)}

    pages = []
    for i, path in enumerate(slides, 1):
        slide, links = xml_part(z, path), relations(z, path)
        blocks = []
        for shape in below(slide, "sp"):
            text = re.sub(r"\n{3,}", "\n\n", "\n".join(t.text or "" for t in below(shape, "t"))).strip()
            if text:
                blocks.append({"type": "text", "role": "heading" if first(shape, "title") is not None else "paragraph", "text": text, "style": pptx_text_style(shape), **box(shape)})
        for pic in below(slide, "pic"):
            if src := links.get(attr(first(pic, "blip"), "embed")):
                blocks.append({"type": "image", "role": "image", "text": src.rsplit("/", 1)[-1], "src": src, "content": _part(z, src), **box(pic)})
        blocks += [{"type": "line", "role": "shape", "text": "", **box(line)} for line in below(slide, "cxnSp")]
        pages.append({"name": f"{i}", "width": width, "height": height, "blocks": blocks})
    return pages


def _all_text(node: ElementTree.Element) -> str:
    return "".join(node.itertext())


def odf_pages(raw: bytes, name: str, strict: bool = False) -> list[dict]:
    _, root = _open(raw, "content.xml")
    kind = name.lower().rsplit(".", 1)[-1]
    if kind == "ods":
        pages = []
        for table in [t for s in below(root, "spreadsheet") for t in kids(s, "table")]:
            matrix = []
            for row in kids(table, "table-row"):
                matrix.append([])
                for c in kids(row, "table-cell", "covered-table-cell"):
                    matrix[-1] += ["\n".join(map(_all_text, below(c, "p")))] * max(1, int(number(attr(c, "number-columns-repeated"), 1)))
            rows, columns, cells = grid(matrix)
            pages.append({"name": attr(table, "name"), "width": max(900, columns * 140 + 80), "height": max(600, rows * 40 + 130), "blocks": [
                {"type": "text", "role": "heading", "text": attr(table, "name"), "x": 40, "y": 24, "width": 820, "height": 46},
                {"type": "table", "role": "table", "text": "", "x": 40, "y": 82, "width": columns * 140, "height": max(90, rows * 38), "rows": rows, "columns": columns, "cells": cells},
            ]})
        return pages
    if kind == "odp":
        pages = []
        for i, page in enumerate(below(root, "page"), 1):
            texts = [t for t in (_all_text(p).strip() for p in below(page, "p")) if t]
            pages.append({"name": attr(page, "name") or str(i), "width": 1280.0, "height": 720.0, "blocks": [{"type": "text", "role": "paragraph", "text": t, "x": 70, "y": 50 + 54 * k, "width": 1140, "height": text_height(t, 22, 1140)} for k, t in enumerate(texts)]})
        return pages
    flow = Flow(strict=strict)  # headings first, then paragraphs: their order among each other is not kept
    for part in [*below(root, "h"), *below(root, "p")]:
        flow.text(_all_text(part).strip())
    return flow.pages


PARSERS = {
    "csv": delimited_pages, "tsv": delimited_pages, "txt": text_pages, "md": text_pages, "html": html_pages, "htm": html_pages, "json": json_pages, "docx": docx_pages, "xlsx": xlsx_pages, "xlsm": xlsx_pages,
    "pptx": pptx_pages, "odt": odf_pages, "ods": odf_pages, "odp": odf_pages, "rtf": lambda raw, name: text_pages(rtf_text(decode(raw)).encode(), name),
}


def extension(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def parse(raw: bytes, name: str) -> list[dict]:
    """Pages of a file by its ending."""
    f = PARSERS.get(extension(name))
    if f is None:
        raise ParseError(f"no reader for {name!r}")
    try:
        return f(raw, name)
    except (json.JSONDecodeError, KeyError, IndexError) as e:
        raise ParseError(f"{type(e).__name__}: {e}") from e
