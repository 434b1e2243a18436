"""Files written and read again, each against the tables that they were made from.

Office files that the library only reads are made here, as small as the formats allow.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import model
from folioflow.plans.models import _CELLS_SQL, _SIZES_SQL, cells
from folioflow.plans.registry import query
from folioflow.session import table
from folioflow.sources import files, sinks
from folioflow.sources.batches import mapped

_SLOTS = f"""(SELECT g.tbl, g.r, g.c, coalesce(x.text, '') AS text FROM (SELECT tbl, r, unnest(range(n_cols)) AS c FROM (SELECT tbl, n_cols, unnest(range(n_rows)) AS r FROM {_SIZES_SQL} AS s) AS s2) AS g LEFT JOIN {_CELLS_SQL} AS x ON x.tbl = g.tbl AND x."row" = g.r AND x.col = g.c AND NOT x.hidden)"""


def _table_blocks(spark, sf_dir, ending: str) -> DataFrame:
    """A file to each table of parts, with one table block."""
    t = cells(spark, sf_dir)
    made = t.groupBy("tbl").agg(F.collect_list(F.struct("row", F.col("col").alias("column"), "row_span", F.col("col_span").alias("column_span"), "text", "hidden")).alias("cells"))
    return made.join(model.sizes(t), "tbl").selectExpr(
        f"concat(tbl, '.{ending}') AS path", "1 AS page_no", "0 AS block_no", "'table' AS type", "'table' AS role", "'' AS text", "0d AS x", "0d AS y", "100d AS width", "20d AS height", "CAST(NULL AS STRING) AS src", "CAST(n_rows AS INT) AS rows", "CAST(n_cols AS INT) AS columns", f"CAST(cells AS ARRAY<{files.CELL}>) AS cells",
    )


def _read_back(spark, sf_dir, ending: str) -> DataFrame:
    found = files.parse_contents(sinks.export(_table_blocks(spark, sf_dir, ending), ending)).where("type = 'table'")
    c = found.select("path", "rows", "columns", F.explode("cells").alias("c")).where("NOT c.hidden AND c.text <> ''")
    return c.groupBy("path").agg(F.first("rows").alias("n_rows"), F.first("columns").alias("n_columns"), F.count("*").alias("n_cells"), F.count_if(F.col("c.column_span") > 1).alias("n_spans"), F.sum(F.length("c.text")).alias("n_chars"))


def _read_back_sql(ending: str, used: bool = False) -> str:
    """``used``: only the range from the first to the last cell with a text comes back."""
    rows, columns = ('max("row") - min("row") + 1', "max(col) - min(col) + 1") if used else ("max(s.n_rows)", "max(s.n_cols)")
    return f"SELECT x.tbl || '.{ending}' AS path, ({rows})::INT AS n_rows, ({columns})::INT AS n_columns, count(*) AS n_cells, count(*) FILTER (WHERE col_span > 1) AS n_spans, sum(length(text))::BIGINT AS n_chars FROM {_CELLS_SQL} AS x JOIN {_SIZES_SQL} AS s ON s.tbl = x.tbl WHERE NOT hidden AND text <> '' GROUP BY x.tbl"


@query("xlsx_tables", _read_back_sql("xlsx", True))
def xlsx_tables(spark, sf_dir):
    """Tables written as workbooks and read again, merged cells too."""
    return _read_back(spark, sf_dir, "xlsx")


@query("docx_tables", _read_back_sql("docx"))
def docx_tables(spark, sf_dir):
    """Tables written into word files and read again, spans too."""
    return _read_back(spark, sf_dir, "docx")


@query("json_models", _read_back_sql("json"))
def json_models(spark, sf_dir):
    """Document models saved as JSON and read again."""
    return _read_back(spark, sf_dir, "json")


@query(
    "markdown_export",
    f"""WITH r AS (SELECT tbl, r, '| ' || string_agg(replace(replace(text, '|', '\\|'), chr(10), '<br>'), ' | ' ORDER BY c) || ' |' AS line, '| ' || string_agg('---', ' | ') || ' |' AS rule FROM {_SLOTS} AS s GROUP BY tbl, r)
    SELECT tbl || '.md' AS path, '# ' || tbl || '.md' || chr(10) || chr(10) || string_agg(CASE WHEN r = 0 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY r) AS text FROM r GROUP BY tbl""",
)
def markdown_export(spark, sf_dir):
    return sinks.export(_table_blocks(spark, sf_dir, "md"), "md").select("path", F.decode("content", "utf-8").alias("text"))


@query(
    "csv_export",
    f"""WITH r AS (SELECT tbl, r, string_agg(CASE WHEN contains(text, ',') OR contains(text, '"') THEN '"' || replace(text, '"', '""') || '"' ELSE text END, ',' ORDER BY c) AS line FROM {_SLOTS} AS s GROUP BY tbl, r)
    SELECT tbl || '.csv' AS path, chr(65279) || string_agg(line, chr(13) || chr(10) ORDER BY r) AS text FROM r GROUP BY tbl""",
)
def csv_export(spark, sf_dir):
    return sinks.export(_table_blocks(spark, sf_dir, "csv"), "csv").select("path", F.decode("content", "utf-8").alias("text"))


def _escaped_sql(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"replace({x}, chr(39), '&#x27;')"


_PAGE = "<!doctype html><html><head><meta charset=utf-8><title>' || path || '</title></head><body><section style=\"position:relative\">"


@query(
    "html_export",
    f"""SELECT path, '{_PAGE}' || string_agg('<div style="position:absolute;left:0px;top:' || turn || 'px;width:100px;min-height:20px">' || {_escaped_sql("coalesce(text, '')")} || '</div>', '' ORDER BY turn) || '</section></body></html>' AS text
    FROM (SELECT conv_id || '.html' AS path, turn, text FROM conversations) AS c GROUP BY path""",
)
def html_export(spark, sf_dir):
    """Conversations as pages of placed blocks."""
    t = table(spark, sf_dir, "conversations").selectExpr(
        "concat(conv_id, '.html') AS path", "1 AS page_no", "CAST(turn AS INT) AS block_no", "'text' AS type", "'paragraph' AS role", "text", "0d AS x", "double(turn) AS y", "100d AS width", "20d AS height", "CAST(NULL AS STRING) AS src", "CAST(NULL AS INT) AS rows", "CAST(NULL AS INT) AS columns", f"CAST(NULL AS ARRAY<{files.CELL}>) AS cells",
    )
    return sinks.export(t, "html").select("path", F.decode("content", "utf-8").alias("text"))


def _made(rows: DataFrame, write) -> DataFrame:
    """(path, content) of (path, pages array<struct<no, head, body>>) by a function of the pages."""

    def run(f):
        for path, found in zip(f["path"], f["pages"], strict=True):
            yield path, write(sorted(((r["no"], r["head"] or "", r["body"] or "") for r in found), key=lambda r: r[0]))

    return mapped(rows, run, "path string, content binary")


def _conversations(spark, sf_dir, ending: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.groupBy(F.concat(F.col("conv_id").cast("string"), F.lit("." + ending)).alias("path")).agg(F.collect_list(F.struct(F.col("turn").alias("no"), F.col("role").alias("head"), F.col("text").alias("body"))).alias("pages"))


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _rtf(pages) -> bytes:
    def sign(c: str) -> str:
        return "\\par " if c == "\n" else "\\tab " if c == "\t" else "" if c in "\\{}\r" else c if c < "\x80" else "".join(f"\\u{int.from_bytes(u, 'little')}?" for u in [c.encode("utf-16-le")[i : i + 2] for i in range(0, len(c.encode("utf-16-le")), 2)])

    return ("{\\rtf1\\ansi{\\*\\generator none}" + "".join("".join(map(sign, body)) + "\\par " for _, _, body in pages) + "}").encode("ascii")


_BARE = "regexp_replace(coalesce(text, ''), '[\\s\\x{00A0}]+', '', 'g')"


@query("rtf_texts", "SELECT conv_id || '.rtf' AS path, sum(length(regexp_replace(coalesce(text, ''), '[\\s\\x{00A0}\\\\{}]+', '', 'g')))::BIGINT AS n_signs FROM conversations GROUP BY conv_id")
def rtf_texts(spark, sf_dir):
    """Conversations as rich text and read again: every sign but blanks."""
    blocks = files.parse_contents(_made(_conversations(spark, sf_dir, "rtf"), _rtf))
    return blocks.groupBy("path").agg(F.sum(F.length(F.regexp_replace("text", r"[\s\x{00A0}]+", ""))).alias("n_signs"))


_A = 'xmlns:a="urn:a" xmlns:p="urn:p"'


def _shape(text: str, title: bool, y: int) -> str:
    kind = '<p:nvPr><p:ph type="title"/></p:nvPr><p:title/>' if title else ""
    runs = "".join(f"<a:p><a:r><a:t>{escape(s)}</a:t></a:r></a:p>" for s in text.split("\n"))
    return f'<p:sp>{kind}<p:spPr><a:xfrm><a:off x="9525" y="{y * 9525}"/><a:ext cx="952500" cy="190500"/></a:xfrm></p:spPr><p:txBody>{runs}</p:txBody></p:sp>'


def _pptx(pages) -> bytes:
    slides = {f"ppt/slides/slide{i}.xml": f"<p:sld {_A}>{_shape(head, True, 10)}{_shape(body, False, 60)}</p:sld>" for i, (_, head, body) in enumerate(pages, 1)}
    return _archive({"ppt/presentation.xml": f'<p:presentation {_A}><p:sldSz cx="9525000" cy="4762500"/></p:presentation>'} | slides)


@query(
    "pptx_slides",
    f"""SELECT conv_id || '.pptx' AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS page_no, role AS title, 1000.0::DOUBLE AS width, CASE WHEN {_BARE} = '' THEN 1 ELSE 2 END::BIGINT AS n_blocks, (10 + CASE WHEN {_BARE} = '' THEN 0 ELSE 60 END)::DOUBLE AS tops, (length(role) + length({_BARE}))::BIGINT AS n_signs FROM conversations""",
)
def pptx_slides(spark, sf_dir):
    """Conversations as slides, a title and a text to each, read again."""
    blocks = files.parse_contents(_made(_conversations(spark, sf_dir, "pptx"), _pptx))
    return blocks.groupBy("path", "page_no").agg(F.max(F.when(F.col("role") == "heading", F.col("text"))).alias("title"), F.max("page_width").alias("width"), F.count("*").alias("n_blocks"), F.sum("y").alias("tops"), F.sum(F.length(F.regexp_replace("text", r"[\s\x{00A0}]+", ""))).alias("n_signs"))


_O = 'xmlns:office="urn:o" xmlns:text="urn:t" xmlns:table="urn:b" xmlns:draw="urn:d"'


def _content(inner: str) -> bytes:
    return _archive({"content.xml": f"<office:document-content {_O}><office:body>{inner}</office:body></office:document-content>"})


def _paragraphs(text: str) -> str:
    return "".join(f"<text:p>{escape(s)}</text:p>" for s in text.split("\n"))


@query("odt_texts", f"SELECT conv_id || '.odt' AS path, sum(length({_BARE}) + length(role))::BIGINT AS n_signs FROM conversations GROUP BY conv_id")
def odt_texts(spark, sf_dir):
    made = _made(_conversations(spark, sf_dir, "odt"), lambda pages: _content("<office:text>" + "".join(f"<text:h>{escape(h)}</text:h>{_paragraphs(b)}" for _, h, b in pages) + "</office:text>"))
    return files.parse_contents(made).groupBy("path").agg(F.sum(F.length(F.regexp_replace("text", r"[\s\x{00A0}]+", ""))).alias("n_signs"))


@query("odp_slides", f"SELECT conv_id || '.odp' AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS page_no, role || turn AS name, (length({_BARE}) + length(role))::BIGINT AS n_signs FROM conversations")
def odp_slides(spark, sf_dir):
    made = _made(_conversations(spark, sf_dir, "odp"), lambda pages: _content("<office:presentation>" + "".join(f'<draw:page draw:name="{escape(h)}{no}"><text:p>{escape(h)}</text:p>{_paragraphs(b)}</draw:page>' for no, h, b in pages) + "</office:presentation>"))
    return files.parse_contents(made).groupBy("path", "page_no").agg(F.max("page_name").alias("name"), F.sum(F.length(F.regexp_replace("text", r"[\s\x{00A0}]+", ""))).alias("n_signs"))


@query("ods_tables", f"SELECT conv_id || '.ods' AS path, count(*)::INT AS n_rows, 3 AS n_columns, sum(2 * length(role) + length({_BARE}))::BIGINT AS n_signs FROM conversations GROUP BY conv_id")
def ods_tables(spark, sf_dir):
    """Conversations as sheets, a turn to a row; the role stands in a cell that is repeated."""
    row = lambda h, b: f'<table:table-row><table:table-cell table:number-columns-repeated="2"><text:p>{escape(h)}</text:p></table:table-cell><table:table-cell>{_paragraphs(b)}</table:table-cell></table:table-row>'
    made = _made(_conversations(spark, sf_dir, "ods"), lambda pages: _content('<office:spreadsheet><table:table table:name="turns">' + "".join(row(h, b) for _, h, b in pages) + "</table:table></office:spreadsheet>"))
    found = files.parse_contents(made).where("type = 'table'")
    chars = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.length(F.regexp_replace(c["text"], r"[\s\x{00A0}]+", "")))
    return found.select("path", F.col("rows").alias("n_rows"), F.col("columns").alias("n_columns"), chars.alias("n_signs"))


@query("image_archives", "SELECT conv_id || '.zip' AS path, 'page-' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 3, '0') || '.jpg' AS name, octet_length(encode(text))::BIGINT AS n_bytes FROM conversations")
def image_archives(spark, sf_dir):
    """Page images of each document in one archive, read again."""
    pages = table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit(".zip")).alias("path"), F.col("turn").alias("page_no"), F.encode("text", "utf-8").alias("image"))

    def names(f):
        return ((p, i.filename, i.file_size) for p, c in zip(f["path"], f["content"], strict=True) for i in zipfile.ZipFile(io.BytesIO(c)).infolist())

    return mapped(sinks.zip_images(pages), names, "path string, name string, n_bytes long")


_W = 'xmlns:w="urn:w" xmlns:a="urn:a" xmlns:r="urn:r" xmlns:wp="urn:wp"'


def _styled_docx(pages) -> bytes:
    """A paragraph to a turn: the role in bold, coloured and larger, then the text's first line in italics; a picture follows."""
    body, parts, links = "", {}, ""
    for no, head, text in pages:
        props = ('<w:pStyle w:val="Heading1"/>' if head == "user" else "") + ('<w:jc w:val="center"/>' if no % 2 else "")
        body += f'<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr><w:b/><w:color w:val="{"auto" if no % 3 == 0 else "A1B2C3"}"/><w:sz w:val="{24 + no % 4 * 12}"/></w:rPr><w:t>{escape(head)}</w:t></w:r><w:r><w:rPr><w:i/><w:u/></w:rPr><w:tab/><w:t>{escape(text.split(chr(10))[0])}</w:t></w:r></w:p>'
        body += f'<w:p><w:r><w:drawing><wp:extent cx="{952500 * (1 + no % 2)}" cy="9525"/><a:blip r:embed="rId{no}"/></w:drawing></w:r></w:p>'
        parts[f"word/media/image{no}.png"] = text
        links += f'<Relationship Id="rId{no}" Target="media/image{no}.png"/>'
    return _archive({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": f"<Relationships>{links}</Relationships>"} | parts)


@query(
    "docx_styles",
    """SELECT conv_id || '.docx' AS path, count(*)::BIGINT AS n_blocks, count(*) FILTER (WHERE role = 'user')::BIGINT AS n_headings, count(*) FILTER (WHERE turn % 2 = 1)::BIGINT AS n_centred, count(*)::BIGINT AS n_bold, count(*) FILTER (WHERE turn % 3 <> 0)::BIGINT AS n_coloured,
    round(sum(CASE WHEN role = 'user' THEN greatest(22.0, (24 + turn % 4 * 12) / 2.0 * 96 / 72) ELSE (24 + turn % 4 * 12) / 2.0 * 96 / 72 END)::DOUBLE, 4) AS sizes, 2 * count(*)::BIGINT AS n_spans, count(*)::BIGINT AS n_italic FROM conversations GROUP BY conv_id""",
)
def docx_styles(spark, sf_dir):
    """Emphasis, sizes, colours and alignment of paragraphs and their runs, as a word file has them."""
    b = files.parse_contents(_made(_conversations(spark, sf_dir, "docx"), _styled_docx)).where("type = 'text'")
    s = F.col("style")
    return b.groupBy("path").agg(
        F.count("*").alias("n_blocks"), F.count_if(F.col("role") == "heading").alias("n_headings"), F.count_if(s["textAlign"] == "center").alias("n_centred"), F.count_if(s["fontWeight"] == "700").alias("n_bold"), F.count_if(s["color"] == "#A1B2C3").alias("n_coloured"), F.round(F.sum(s["fontSize"].cast("double")), 4).alias("sizes"),
        F.sum(F.size("spans")).alias("n_spans"), F.sum(F.size(F.filter("spans", lambda x: x["style"]["fontStyle"] == "italic"))).alias("n_italic"),
    )


@query("docx_images", "SELECT conv_id || '.docx' AS path, 'image' || turn || '.png' AS name, (100 * (1 + turn % 2))::DOUBLE AS width, 60.0::DOUBLE AS height, octet_length(encode(text))::BIGINT AS n_bytes FROM conversations")
def docx_images(spark, sf_dir):
    """Pictures of word files with their boxes and bytes."""
    b = files.parse_contents(_made(_conversations(spark, sf_dir, "docx"), _styled_docx)).where("type = 'image'")
    return b.select("path", F.col("text").alias("name"), "width", "height", F.octet_length("content").cast("long").alias("n_bytes"))


def _styled_pptx(pages) -> bytes:
    def shape(no, head):
        run = f'<a:rPr sz="{1200 + no % 5 * 300}" b="{no % 2}" i="{no % 3 % 2}"><a:solidFill><a:srgbClr val="{"0a0B0c" if no % 4 else "red"}"/></a:solidFill></a:rPr>'
        return f'<p:sp><p:txBody><a:p><a:pPr algn="{("l", "ctr", "r", "just")[no % 4]}"/><a:r>{run}<a:t>{escape(head)}</a:t></a:r></a:p></p:txBody></p:sp>'

    return _archive({"ppt/presentation.xml": f"<p:presentation {_A}/>"} | {f"ppt/slides/slide{i}.xml": f"<p:sld {_A}>{shape(no, head)}</p:sld>" for i, (no, head, _) in enumerate(pages, 1)})


@query(
    "pptx_styles",
    """SELECT conv_id || '.pptx' AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS page_no, round(((1200 + turn % 5 * 300) / 100.0 * 96 / 72)::DOUBLE, 4) AS font_size, turn % 2 = 1 AS bold, turn % 3 = 1 AS italic, CASE WHEN turn % 4 = 0 THEN '#111827' ELSE '#0a0B0c' END AS colour,
    ['left', 'center', 'right', 'justify'][turn % 4 + 1] AS align FROM conversations""",
)
def pptx_styles(spark, sf_dir):
    """Size, emphasis, colour and alignment of the texts of slides."""
    b, s = files.parse_contents(_made(_conversations(spark, sf_dir, "pptx"), _styled_pptx)), F.col("style")
    return b.select("path", "page_no", F.round(s["fontSize"].cast("double"), 4).alias("font_size"), (s["fontWeight"] == "700").alias("bold"), (s["fontStyle"] == "italic").alias("italic"), s["color"].alias("colour"), s["textAlign"].alias("align"))


def _styled_xlsx(pages) -> bytes:
    """A row to a turn with a cell in each of four formats."""
    fonts = '<font/><font><b/><sz val="12"/><color rgb="FFA1B2C3"/></font><font><i/><u/></font>'
    formats = '<xf/><xf fontId="1" fillId="1"/><xf fontId="2" borderId="1"/><xf><alignment horizontal="right" vertical="top"/></xf>'
    styles = f'<styleSheet><fonts>{fonts}</fonts><fills><fill/><fill><patternFill><fgColor rgb="FF00FF7F"/></patternFill></fill></fills><borders><border/><border><top style="thin"/><left/></border></borders><cellXfs>{formats}</cellXfs></styleSheet>'
    cell = lambda r, c, text: f'<c r="{"ABCD"[c]}{r}" s="{c}" t="inlineStr"><is><t>{escape(text)}</t></is></c>'
    rows = "".join(f"<row r=\"{i}\">{''.join(cell(i, c, head) for c in range(4))}</row>" for i, (_, head, _) in enumerate(pages, 1))
    return _archive({
        "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="turns" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>", "xl/styles.xml": styles,
    })


@query(
    "xlsx_styles",
    """WITH t AS (SELECT conv_id || '.xlsx' AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT - 1 AS "row" FROM conversations)
    SELECT path, "row", c::INT AS "column", c = 1 OR "row" = 0 AS bold, c = 2 AS italic, CASE WHEN c = 1 THEN 16.0 ELSE 14.0 END::DOUBLE AS font_size, CASE WHEN c = 1 THEN '#A1B2C3' ELSE '#111827' END AS colour, CASE WHEN c = 1 THEN '#00FF7F' WHEN "row" = 0 THEN '#e2e8f0' ELSE '#ffffff' END AS ground,
    CASE WHEN c = 3 THEN 'right' WHEN "row" = 0 THEN 'center' ELSE 'left' END AS align, CASE WHEN c = 3 THEN 'top' ELSE 'middle' END AS valign, c = 2 AS top_line FROM (SELECT path, "row", unnest([0, 1, 2, 3]) AS c FROM t) AS u""",
)
def xlsx_styles(spark, sf_dir):
    """Formats of the cells of workbooks; the first row is a header."""
    b, s = files.cell_styles(_made(_conversations(spark, sf_dir, "xlsx"), _styled_xlsx)), F.col("style")
    return b.select("path", "row", "column", (s["fontWeight"] == "700").alias("bold"), (s["fontStyle"] == "italic").alias("italic"), s["fontSize"].cast("double").alias("font_size"), s["color"].alias("colour"), s["backgroundColor"].alias("ground"), s["textAlign"].alias("align"), s["verticalAlign"].alias("valign"), (s["borderTop"] == "1px solid #64748b").alias("top_line"))


@query(
    "docx_placed",
    """SELECT conv_id || '.docx' AS path, count(*)::BIGINT AS n_frames, sum(floor((turn + 1) / 2) * 10 * 0.75)::DOUBLE AS lefts, sum(turn * 4 * 0.75)::DOUBLE AS tops, coalesce(sum(len(string_split(text, chr(10)))) FILTER (WHERE turn % 4 = 1), 0)::BIGINT AS n_bold, coalesce(sum(len(string_split(text, chr(10))) * floor((12 + turn % 5) * 1.5 + 0.5)) FILTER (WHERE turn % 4 <> 3), 0)::BIGINT AS half_points, count(*) FILTER (WHERE turn % 4 = 3)::BIGINT AS n_images, sum(CASE WHEN turn % 4 = 3 THEN octet_length(encode(text)) ELSE 0 END)::BIGINT AS n_bytes FROM conversations GROUP BY conv_id""",
)
def docx_placed(spark, sf_dir):
    """Conversations as word files of placed frames, told by their markup: places, marks, sizes, pictures."""
    t = table(spark, sf_dir, "conversations").selectExpr(
        "concat(conv_id, '.docx') AS path", "1 AS page_no", "CAST(turn AS INT) AS block_no", "IF(turn % 4 = 3, 'image', 'text') AS type", "role", "text", "double((turn + 1) div 2 * 10) AS x", "double(turn * 4) AS y", "100d AS width", "20d AS height", "'a.png' AS src", "CAST(NULL AS INT) AS rows", "CAST(NULL AS INT) AS columns",
        f"CAST(NULL AS ARRAY<{files.CELL}>) AS cells", "map('fontWeight', IF(turn % 2 = 1, '700', '400'), 'fontSize', CAST(12 + turn % 5 AS STRING), 'color', '#a1b2c3') AS style", "IF(turn % 4 = 3, encode(text, 'utf-8'), NULL) AS content",
    )

    def look(f):
        import re

        for path, content in zip(f["path"], f["content"], strict=True):
            z = zipfile.ZipFile(io.BytesIO(content))
            xml = z.read("word/document.xml").decode()
            number = lambda name: sum(map(float, re.findall(name + r":([\d.]+)pt", xml)))  # noqa: E731, B023
            images = [i.file_size for i in z.infolist() if i.filename.startswith("word/media/")]
            halves = [int(run.group(1)) for run in re.finditer(r'<w:sz w:val="(\d+)"', xml)]
            yield path, xml.count("<v:rect"), number("margin-left"), number("margin-top"), xml.count("<w:b/>"), sum(halves), len(images), sum(images)

    return mapped(sinks.export(t, "docx-original"), look, "path string, n_frames long, lefts double, tops double, n_bold long, half_points long, n_images long, n_bytes long")
