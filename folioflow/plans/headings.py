"""Headings: lines told apart, sections, texts with headings set off, Markdown."""

from __future__ import annotations

from folioflow.plans.dialect import both, values

FIXTURES = [
    (1, "Chapter 1: Start\n\nThis is the first body line of the chapter, long enough.\nSecond line.\n1. Scope of work\nBody here.\nIMPORTANT NOTICE\n- item one\n- item two\nDeadline:\ntomorrow"),
    (2, "บทที่ 1 บทนำ\nเนื้อหาของบทแรกมีความยาวพอสมควรสำหรับการทดสอบ\n\nสรุป\nจบแล้ว.\n2024-01-31\nABC-123\na | b | c\nx   y   z"),
    (3, "Short line\nThis next line is certainly much longer than the short line before it\n\n\nSummary\nIntroduction to things\n12,500.00\nhttps://example.test/x\nVII. Results\n1.2.3 Deep heading\nIs it? Yes!"),
    (4, "\n\nonly body text that ends with a full stop and is not at all short, so it stays.\n\n"),
    (5, "Notes\nNotes\nbody\nPART TWO\nก. รายการ\n• bullet\n(02) 123-4567\nCivil war story\nหมายเหตุ: ดูภาคผนวก"),
]

_THAI = ["บทที่", "บทคัดย่อ", "บทนำ", "บทสรุป", "บท", "หมวดที่", "หมวด", "ส่วนที่", "ส่วน", "หัวข้อ", "เรื่อง", "คำนำ", "สารบัญ", "สรุป", "ขอบเขต", "วัตถุประสงค์", "รายละเอียด", "ผลลัพธ์", "ผลการตรวจสอบ", "หมายเหตุ", "ข้อเสนอแนะ", "ภาคผนวก", "เอกสารแนบ", "การวิเคราะห์", "วิธีดำเนินการ"]
_ENGLISH = ["analysis", "abstract", "appendix", "chapter", "conclusion", "details?", "introduction", "methodology", "notes?", "objective", "part", "recommendations?", "results?", "scope", "section", "summary"]
_STOP = r"(?:[:\x{FF1A}]|\s|$)"
EXPLICIT = rf"(?i)^(?:{'|'.join(_ENGLISH + _THAI)}){_STOP}"
MAJOR = rf"(?i)^(?:part|chapter|หมวดที่|หมวด|บทที่|บท){_STOP}"
NUMBERED = r"(?i)^([IVXLC]+|[\x{0E01}-\x{0E2E}]|\d+(?:[.]\d+){0,3})[).]?\s+(.+)$"
VALUE = r"^(?:\+?[-()\s\d]{7,}|\d\d?(?::\d\d){1,2}|\d{1,2}[-.:/]\d{1,2}[-.:/]\d{2,4}|[£€$\x{0E3F}]?\s*[-+]?[\d\x{0E50}-\x{0E59}][,\d\x{0E50}-\x{0E59}]*(?:\.\d+)?%?)$"
CODE = r"(?i)^(?:\d{2,}[-/_][-A-Z0-9]+|[0-9A-Z]{5,}|[A-Z]{1,8}[-/_]\d[-./\w]*)$"
CONTACT = r"(?i)(?:www\.|https?://|[-+.\w]+@[-.\w]+\.[a-z]{2,})"
ENDED = r"[!.?\x{3002}\x{FF01}\x{FF1F}]$"
CAPITALS = r"^[A-Z][-/&'() A-Z\d]{2,79}$"
ITEM = r"^(?:[\x{0E01}-\x{0E2E}][).]|\d+[).]|[-*\x{2013}\x{2014}\x{2022}\x{25AA}\x{25E6}])\s+"
TABLE = r"[|\t]|\S\s{2,}\S(?:.*\S)?\s{2,}\S"


def heading_lines(d, source: str, key: str) -> str:
    """Lines with text, heading, level, confidence and reason; key and line tell them apart."""
    w = f"OVER (PARTITION BY {key} ORDER BY line"
    body = d.trim(d.group("t", NUMBERED, 2))
    words = d.count("t", r"\S+")
    item = d.has("t", ITEM)
    depth = "(length(" + d.group("t", NUMBERED, 1) + ") - length(replace(" + d.group("t", NUMBERED, 1) + ", '.', '')) + 1)"
    numbered = f"{d.has('t', NUMBERED)} AND NOT {d.has('t', ENDED)} AND (NOT {item} OR {d.has(body, EXPLICIT)}) AND length({body}) <= 72 AND NOT {d.has(body, TABLE)}"
    capitals = f"{d.has('t', CAPITALS)} AND {words} <= 10 AND NOT {item}"
    label = f"{d.has('t', '[:' + chr(92) + 'x{FF1A}]$')} AND length(t) <= 72 AND NOT {item}"
    alone = f"blank_before AND NOT {d.has('t', ENDED)} AND NOT {item} AND length(t) <= 60 AND length(coalesce(following, '')) >= greatest(24, length(t) + 10)"
    reason = f"""CASE WHEN length(t) < 2 OR length(t) > 100 THEN 'length' WHEN NOT {d.has('t', chr(92) + 'p{L}')} THEN 'no_letters'
        WHEN {d.has('t', VALUE)} OR {d.has('t', CODE)} OR {d.has('t', CONTACT)} THEN 'strict_value' WHEN {d.has('t', TABLE)} THEN 'table_like'
        WHEN {d.has('t', EXPLICIT)} THEN 'explicit_heading' WHEN {numbered} THEN 'numbered_heading' WHEN {capitals} THEN 'all_caps_heading'
        WHEN {label} THEN 'label_heading' WHEN {alone} THEN 'standalone_short_line' ELSE 'body_text' END"""
    return f"""(SELECT {key}, line, t, reason, reason IN ('explicit_heading', 'numbered_heading', 'all_caps_heading', 'label_heading', 'standalone_short_line') AS heading,
        CASE reason WHEN 'explicit_heading' THEN CASE WHEN {d.has('t', MAJOR)} THEN 1 ELSE 2 END WHEN 'numbered_heading' THEN least(4, {depth} + 1) WHEN 'all_caps_heading' THEN 2 WHEN 'label_heading' THEN 3 WHEN 'standalone_short_line' THEN 3 ELSE 0 END AS level,
        CASE reason WHEN 'explicit_heading' THEN 0.98 WHEN 'numbered_heading' THEN 0.9 WHEN 'all_caps_heading' THEN 0.9 WHEN 'label_heading' THEN 0.84 WHEN 'standalone_short_line' THEN 0.72 ELSE 0.0 END AS confidence
      FROM (SELECT *, {reason} AS reason FROM
        (SELECT {key}, line, t, coalesce(lag(t) {w}), '') = '' AS blank_before, {d.ignore_nulls('first_value', "nullif(t, '')")} {w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following
          FROM (SELECT {key}, line, {d.trim('s')} AS t FROM {d.lines(source, key)} AS a) AS b) AS c) AS e)"""


@both("heading_lines")
def lines_(d):
    return f"SELECT id, line, t AS text, reason, heading, CAST(level AS INT) AS level, CAST(confidence AS DOUBLE) AS confidence FROM {heading_lines(d, values(d, FIXTURES, 'id, text'), 'id')} AS x"


@both("heading_reasons")
def reasons(d):
    """Lines of all documents and page titles by what the heading rules make of them."""
    title = d.group("html", r"<h1>([^<]*)</h1>", 1)
    docs = heading_lines(d, "documents", "doc_id")
    pages = heading_lines(d, f"(SELECT page_id, {title} || chr(10) || chr(10) || 'A line that is longer than most titles are, so that short ones stand alone' AS text FROM pages) AS p", "page_id")
    return f"SELECT source, reason, CAST(level AS INT) AS level, count(*) AS n FROM (SELECT 'documents' AS source, reason, level FROM {docs} AS x UNION ALL SELECT 'pages', reason, level FROM {pages} AS y) AS z GROUP BY source, reason, level"


def _numbered(d) -> str:
    return f"(SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line) AS section FROM {heading_lines(d, values(d, FIXTURES, 'id, text'), 'id')} AS x WHERE t <> '')"


@both("heading_sections")
def sections(d):
    return f"SELECT id, CAST(section AS INT) AS section, max(CASE WHEN heading THEN t END) AS heading, CAST(max(level) AS INT) AS level, {d.agg('CASE WHEN NOT heading THEN t END', chr(10), 'line')} AS body, {d.if_('NOT heading')} AS n_body FROM {_numbered(d)} AS n GROUP BY id, section"


def _set_off(d) -> str:
    """Texts with an empty line before and after each heading and no more than one between lines."""
    lines = heading_lines(d, values(d, FIXTURES, "id, text"), "id")
    text = d.agg("CASE WHEN heading THEN chr(10) || t || chr(10) ELSE t END", "\n", "line")
    return f"(SELECT id, {d.trim(d.sub(text, chr(92) + 'n{3,}', chr(10) * 2))} AS text FROM {lines} AS x GROUP BY id)"


@both("structured_text")
def structured(d):
    return f"SELECT id, text FROM {_set_off(d)} AS y"


@both("markdown_headings")
def markdown(d):
    """Headings marked by level. A body line that reads like a heading of its text is marked as well; the last level wins."""
    lines = heading_lines(d, values(d, FIXTURES, "id, text"), "id")
    levels = f"(SELECT id, t, max_by(level, line) AS level FROM {lines} AS a WHERE heading GROUP BY id, t)"
    marked = "CASE WHEN h.level IS NULL THEN l.s ELSE repeat('#', CAST(least(greatest(h.level, 1), 6) AS INT)) || ' ' || l.s END"
    return f"SELECT l.id, {d.agg(marked, chr(10), 'l.line')} AS markdown FROM {d.lines(_set_off(d) + ' AS y', 'id')} AS l LEFT JOIN {levels} AS h ON h.id = l.id AND h.t = l.s GROUP BY l.id"
