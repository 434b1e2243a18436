"""Regions and blocks of recognised pages: evidence, gates, zones, review, output and audit.

Feature vectors are made from part keys, a page for every twenty parts, so the rules run over whole tables.
"""

from __future__ import annotations

from folioflow.functions import patterns as P
from folioflow.plans.dialect import both, values

FEATURES = (
    "baseline glyph_alignment components height_consistency spacing text_line contrast thai_script texture color_variance object_score photo ornament frame barcode qr "
    "curved symmetry area compactness straight region_confidence ocr_confidence"
).split()
ZONES = [("top_illustration", 0.24), ("main_title", 0.42), ("subtitle", 0.52), ("class_level", 0.61), ("author_name", 0.71), ("school_name", 0.80), ("organization_name", 0.92), ("footer_text", 9.0)]
EXPECTED = [("top_illustration", 0.00, 0.24, 0.04), ("main_title", 0.22, 0.43, 0.08), ("subtitle", 0.40, 0.53, 0.10), ("class_level", 0.50, 0.62, 0.10), ("author_name", 0.59, 0.72, 0.10), ("school_name", 0.69, 0.81, 0.08), ("organization_name", 0.78, 0.93, 0.06), ("footer_text", 0.90, 1.00, 0.04)]
NON_TEXT = ["badge", "emblem", "icon", "logo", "ship_art", "animal_art", "character_art", "background_shape", "ornament", "decorative_frame", "cartoon", "photograph", "illustration"]
COVERS = ["poster", "book_cover", "cover_page", "poster_cover", "worksheet_cover", "certificate_cover", "illustrated_cover", "illustrated_document"]
TYPES = ["text", "illustration", "logo", "text", "photograph", "text", "ornament"]
WORDS = ["Annual report", "| [ @ #", "CAR A", "สำนักงานเขต", "x1y2z3", "", "School of Law", "000 111", "Plain body text that is fairly long, and ends.", "TR +++ =="]


def features(d) -> str:
    made = ", ".join(f"(p_partkey * {37 + 14 * i} + {11 * i}) % 101 / 100.0 AS {n}" for i, n in enumerate(FEATURES))
    text = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {d.s(w)}" for i, w in enumerate(WORDS)) + " END"
    kind = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN {d.s(w)}" for i, w in enumerate(TYPES)) + " END"
    return f"""(SELECT p_partkey AS id, CAST(floor(p_partkey / 20) AS BIGINT) AS page, {made}, (p_partkey * 3) % 9 AS glyphs, p_partkey % 3 AS candidates, (p_partkey * 53) % 1000 * 1.0 AS top, (p_partkey * 29) % 600 * 1.0 AS lft, 40.0 + p_partkey % 300 AS width, 10.0 + p_partkey % 60 AS height,
      1000.0 AS page_height, {text} AS text, {kind} AS region_type, p_partkey % 5 = 0 AS decorative, p_partkey % 8 = 0 AS small, p_partkey % 41 = 0 AS confirmed_non_text, CASE WHEN floor(p_partkey / 20) % 3 = 0 THEN 'normal_document' ELSE 'book_cover' END AS document_type FROM part)"""


def zone(top: str = "top", height: str = "height", page: str = "page_height") -> str:
    return "CASE " + " ".join(f"WHEN ({top} + greatest({height}, 1) / 2) / {page} < {b} THEN '{z}'" for z, b in ZONES[:-1]) + " ELSE 'footer_text' END"


def total(flags: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {f} THEN 1 ELSE 0 END" for f in flags) + ")"


@both("cover_zones")
def cover_zones(d):
    return f"SELECT id, {zone()} AS zone FROM {features(d)} AS f"


@both("expected_zones")
def expected_zones(d):
    """Rectangles where a cover is expected to hold its texts, for each page size."""
    pages = values(d, [(1, 794.0, 1123.0), (2, 600.0, 900.0)], "page, width, height", "p")
    zones = values(d, EXPECTED, "zone, lo, hi, inset", "z")
    return f"SELECT page, zone, round(width * inset) AS lft, round(height * lo) AS top, round(width * (1 - inset * 2)) AS width, greatest(1.0, round(round(height * (hi - lo), 9))) AS height FROM {pages} AS a CROSS JOIN {zones} AS b"


@both("missing_zones")
def missing_zones(d):
    """Expected zones of each page in which no region emits text."""
    have = f"(SELECT DISTINCT page, {zone()} AS zone FROM {features(d)} AS f WHERE region_type = 'text' AND text <> '')"
    return f"SELECT e.page, e.zone FROM (SELECT page, zone FROM (SELECT DISTINCT page FROM {features(d)} AS g) AS p CROSS JOIN {values(d, [(z,) for z, _ in ZONES], 'zone')} AS z) AS e WHERE NOT EXISTS (SELECT 1 FROM {have} AS h WHERE h.page = e.page AND h.zone = e.zone)"


def line_score() -> str:
    glyph = "CASE WHEN glyphs >= 4 THEN 1.0 WHEN glyphs >= 2 THEN 0.58 WHEN glyphs > 0 THEN 0.24 ELSE 0.0 END"
    return f"round(baseline * 0.24 + components * 0.2 + glyph_alignment * 0.16 + height_consistency * 0.14 + spacing * 0.1 + text_line * 0.1 + {glyph} * 0.06, 9)"


@both("text_line_evidence")
def text_line(d):
    has_base, has_chars = "(baseline >= 0.52 OR (text_line >= 0.66 AND glyph_alignment >= 0.54))", "(components >= 0.42 AND glyphs >= 2)"
    return f"SELECT id, round(CAST(score AS DOUBLE), 6) AS score, {has_base} AS has_baseline, {has_chars} AS has_characters, score >= 0.72 AND {has_base} AND {has_chars} AS accepted FROM (SELECT *, {line_score()} AS score FROM {features(d)} AS f) AS g"


@both("cover_regions")
def cover_regions(d):
    """Region type by the earlier, strict rules."""
    accepted = "e >= 0.72 AND (baseline >= 0.52 OR (text_line >= 0.66 AND glyph_alignment >= 0.54)) AND components >= 0.42 AND glyphs >= 2"
    kind = f"""CASE WHEN barcode >= 0.72 THEN 'barcode' WHEN qr >= 0.72 THEN 'qr_code' WHEN {accepted} THEN 'text' WHEN straight >= 0.74 AND e < 0.42 AND area <= 0.16 THEN 'separator'
      WHEN frame >= 0.64 OR (curved >= 0.62 AND area >= 0.18 AND e < 0.44) THEN 'decorative_frame' WHEN ornament >= 0.6 OR (curved >= 0.7 AND symmetry >= 0.45 AND e < 0.4) THEN 'ornament'
      WHEN compactness >= 0.72 AND symmetry >= 0.62 AND area <= 0.12 AND e < 0.52 THEN 'icon' WHEN object_score >= 0.66 AND e < 0.5 THEN 'illustration' WHEN texture >= 0.58 AND color_variance >= 0.42 AND e < 0.48 THEN 'illustration'
      WHEN color_variance < 0.12 AND texture < 0.12 AND e < 0.3 THEN 'background_shape' ELSE 'unknown' END"""
    return f"SELECT id, kind AS region_type, CASE WHEN kind IN ('barcode', 'qr_code') THEN 'barcode_reader' WHEN kind = 'text' THEN 'text_ocr' WHEN kind = 'unknown' THEN 'manual_review' ELSE 'skip_text_ocr' END AS action FROM (SELECT id, {kind} AS kind FROM (SELECT *, {line_score()} AS e FROM {features(d)} AS f) AS g) AS h"


@both("cover_documents")
def cover_documents(d):
    """Document type of a page from shares and counts of what is on it."""
    share = lambda t: f"avg(CASE WHEN region_type = '{t}' THEN 1.0 ELSE 0.0 END)"
    page = f"(SELECT page, {share('illustration')} * 3 AS ill, {share('photograph')} * 3 AS pho, {share('ornament')} * 3 AS deco, avg(area) * 0.7 AS txt, max(baseline) * avg(frame) * 1.6 AS title, count(DISTINCT text) AS blocks, min(glyphs) AS repeated, avg(barcode) * 1.3 AS cert, avg(qr) * 1.3 AS info FROM {features(d)} AS f GROUP BY page)"
    kind = "CASE WHEN cert >= 0.72 THEN 'certificate_cover' WHEN info >= 0.72 THEN 'infographic' WHEN ill + pho >= 0.56 AND txt <= 0.34 THEN CASE WHEN title >= 0.62 THEN 'book_cover' ELSE 'illustrated_document' END WHEN deco >= 0.42 AND title >= 0.54 AND blocks <= 12 THEN 'poster' WHEN title >= 0.58 AND repeated <= 2 AND blocks <= 9 THEN 'worksheet_cover' ELSE 'normal_document' END"
    return f"SELECT page, {kind} AS document_type FROM (SELECT page, round(ill, 9) AS ill, round(pho, 9) AS pho, round(deco, 9) AS deco, round(txt, 9) AS txt, round(title, 9) AS title, blocks, repeated, round(cert, 9) AS cert, round(info, 9) AS info FROM {page} AS p) AS q"


FLAGS = ["baseline >= 0.35", "glyph_alignment >= 0.35", "components >= 0.35", "spacing >= 0.35", "thai_script >= 0.5", "candidates > 0", "width >= greatest(20.0, height * 1.35)", "contrast >= 0.28"]


@both("ocr_gate")
def ocr_gate(d):
    """Which regions go to recognition: eight flags of evidence, types and zones that never do."""
    blocked = f"region_type IN ({', '.join(map(repr, NON_TEXT + ['separator', 'animal', 'ship']))})"
    reason = f"CASE WHEN document_type <> 'normal_document' AND zone = 'top_illustration' THEN 'cover_top_illustration' WHEN {blocked} THEN 'non_text_' || region_type WHEN region_type = 'text' AND n >= 1 THEN 'explicit_text' WHEN n >= 2 THEN 'multi_signal_text_evidence' ELSE 'insufficient_text_evidence' END"
    return f"SELECT id, n AS n_flags, {reason} AS reason FROM (SELECT *, {total(FLAGS)} AS n, {zone()} AS zone FROM {features(d)} AS f) AS g"


EVIDENCE = ["baseline >= 0.34", "(glyph_alignment >= 0.30 OR glyphs >= 2)", "components >= 0.24", "candidates > 0", "thai_script >= 0.10", "height_consistency >= 0.30", "spacing >= 0.26", "zone <> 'top_illustration'", "contrast >= 0.16", "width / greatest(height, 1.0) >= 1.8"]
AGAINST = ["object_score >= 0.78", "(photo >= 0.74 AND color_variance >= 0.55)", "ornament >= 0.78", "frame >= 0.78", "baseline <= 0.12", "(glyphs <= 1 AND components <= 0.15)", "candidates = 0"]


def review_first(d, source: str) -> str:
    """Five-way status of a region: text is doubted, put off and reviewed before it is ever dropped."""
    scored = f"(SELECT *, {total(EVIDENCE)} AS n, {total(AGAINST)} AS against, CASE WHEN decorative THEN 0.30 WHEN small THEN 0.25 ELSE 0.45 END AS bar FROM (SELECT *, {zone()} AS zone FROM {source} AS a0) AS a1)"
    score = "round(region_confidence * 0.42 + ocr_confidence * 0.20 + least(1.0, n / 6.0) * 0.28 + contrast * 0.10, 9)"
    status = """CASE WHEN barcode >= 0.72 OR qr >= 0.72 OR confirmed_non_text THEN 'confirmed_non_text' WHEN score >= 0.88 AND n >= 3 THEN 'verified' WHEN (decorative OR small) AND score >= bar AND score < 0.88 THEN 'possible_text'
      WHEN score >= 0.45 AND n >= 2 THEN 'review_required' WHEN score >= bar OR n >= 2 OR candidates > 0 OR thai_script >= 0.10 THEN 'possible_text'
      WHEN score < 0.15 AND n = 0 AND against >= 3 AND candidates = 0 AND glyphs <= 1 AND components <= 0.15 THEN 'confirmed_non_text' ELSE 'likely_non_text' END"""
    return f"(SELECT *, {status} AS status FROM (SELECT *, {score} AS score FROM {scored} AS a2) AS a3)"


@both("text_evidence")
def text_evidence(d):
    return f"SELECT id, zone, {total(EVIDENCE)} AS n_for, {total(AGAINST)} AS n_against FROM (SELECT *, {zone()} AS zone FROM {features(d)} AS f) AS g"


@both("review_first")
def review_first_(d):
    return f"SELECT id, zone, status, round(CAST(score AS DOUBLE), 6) AS score FROM {review_first(d, features(d))} AS r"


SYMBOLS = r"[#+<=>@\[\]_|]"
_JUNK = "[#0-9@A-Za-z|]"
_NOISES = [r"[#+@\[\]|]{2,}", rf"{_JUNK}(?:\s*{_JUNK}){{3}}\s*{_JUNK}+", r"000+\d*", r"<=\s*\d+", r"\|\s*-?\s*TR", r"CH\s*[\x{201D}\x22'=]*", r"CAR\s*A"]
NOISE = rf"(?i)(?:\s|^)(?:{'|'.join(_NOISES)})(?:\s|$)"


def leak(d, x: str) -> str:
    """Whether a text looks like what an illustration is misread as."""
    meaningful = d.count(x, r"[\p{L}\p{N}]")
    short = d.count(f"(chr(10) || {x} || chr(10))", r"\n[^\n]{1,18}")
    noisy = f"({short} >= 2 AND {d.count(x, chr(92) + 'n' + '[-#0-9<=>@A-Z_| ]{1,18}')} + CASE WHEN {d.has(x, '^[-#0-9<=>@A-Z_| ]{1,18}(?:' + chr(92) + 'n|$)')} THEN 1 ELSE 0 END >= 2)"
    return f"({x} <> '' AND ({d.has(x, NOISE)} OR ({d.count(x, SYMBOLS)} >= 3 AND {d.count(x, SYMBOLS)} > {meaningful} * 0.35) OR {noisy}))"


LEAKS = [(1, "CAR A"), (2, "[[ @@ ]]"), (3, "สวัสดีครับ"), (4, "A plain sentence."), (5, "000123"), (6, "| TR"), (7, "AB\nCD\n##"), (8, ""), (9, "<= 12"), (10, "x [ ] + y")]


@both("illustration_leaks")
def leaks(d):
    lines = f"(SELECT {d.trim('s')} AS t FROM {d.lines('documents', 'doc_id')} AS l)"
    return f"SELECT 'samples' AS source, id, {leak(d, 'text')} AS leak, CAST(1 AS BIGINT) AS n FROM {values(d, LEAKS, 'id, text')} AS v UNION ALL SELECT 'documents', NULL, {leak(d, 't')} AS leak, count(*) FROM {lines} AS m GROUP BY {leak(d, 't')}"


def hard_block(d) -> str:
    """Blocks with emit, suppressed text and reason: on covers what is no text never gets out."""
    cover = "document_type IN (" + ", ".join(map(repr, COVERS)) + ")"
    kind = "region_type IN (" + ", ".join(map(repr, NON_TEXT)) + ")"
    reason = f"CASE WHEN {cover} AND zone = 'top_illustration' THEN 'cover_top_illustration_hard_block' WHEN {cover} AND {kind} THEN 'cover_' || region_type || '_hard_block' WHEN status = 'confirmed_non_text' OR ({cover} AND {leak(d, 'text')} AND region_type <> 'text') THEN 'cover_non_text_no_output_leak' END"
    return f"(SELECT *, reason IS NULL AS emit, CASE WHEN reason IS NULL THEN text ELSE '' END AS kept, CASE WHEN reason IS NULL THEN '' ELSE {d.trim('text')} END AS suppressed FROM (SELECT *, {cover} AS cover, {reason} AS reason FROM {review_first(d, features(d))} AS b0) AS b1)"


@both("hard_block")
def hard_block_(d):
    return f"SELECT id, zone, reason, kept, suppressed FROM {hard_block(d)} AS b"


@both("output_audit")
def output_audit(d):
    tokens = d.count("suppressed", r"\S+")
    return f"SELECT page, {d.if_('NOT emit')} AS n_blocked, CAST(sum(CASE WHEN emit THEN 0 ELSE {tokens} END) AS BIGINT) AS n_tokens, {d.if_('NOT emit AND kept <> ' + d.s(''))} AS n_leaks, {d.if_('NOT emit AND kept <> ' + d.s(''))} = 0 AS passed FROM {hard_block(d)} AS b GROUP BY page"


@both("cover_sanity")
def cover_sanity(d):
    """Reasons to look at a cover again after blocking."""
    out = "(emit AND kept <> '')"
    has = lambda z: f"max(CASE WHEN {out} AND zone = '{z}' THEN 1 ELSE 0 END) = 1"
    return f"""SELECT page, n_text < 3 AS few_blocks, NOT title AS no_title, NOT author AS no_author, NOT (school OR organization) AS no_identity, n_top > 0 AS top_tokens, n_gibberish > 0 AS gibberish, n_text, n_blocked
      FROM (SELECT page, {d.if_(out)} AS n_text, {d.if_('NOT emit')} AS n_blocked, {has('main_title')} AS title, {has('author_name')} AS author, {has('school_name')} AS school, {has('organization_name')} AS organization,
        {d.if_("zone = 'top_illustration' AND text <> ''")} AS n_top, {d.if_(out + ' AND ' + leak(d, 'text'))} AS n_gibberish FROM {hard_block(d)} AS b WHERE cover GROUP BY page) AS c"""


def recovery(d) -> str:
    text = "(status <> 'confirmed_non_text' AND region_type = 'text')"
    has = lambda z: f"max(CASE WHEN {text} AND zone = '{z}' THEN 1 ELSE 0 END) = 1 AS has_{z}"
    return f"(SELECT page, {d.if_(text)} AS n_text, {', '.join(has(z) for z, _ in ZONES)} FROM {review_first(d, features(d))} AS b WHERE document_type <> 'normal_document' GROUP BY page)"


@both("cover_recovery")
def cover_recovery(d):
    return f"SELECT page, n_text, n_text < 3 AS few_blocks, NOT has_main_title AS no_title, NOT (has_school_name OR has_organization_name) AS no_identity, n_text < 3 OR NOT has_main_title OR NOT (has_school_name OR has_organization_name) AS required FROM {recovery(d)} AS r"


@both("recovery_plan")
def recovery_plan(d):
    """Zones to scan again and how, for covers that need it."""
    keyed = [z for z, _ in ZONES if z in ("main_title", "class_level", "author_name", "school_name", "organization_name")]
    few = [z for z, _ in ZONES if z != "top_illustration"]
    missing = " OR ".join(f"(z.zone = '{z}' AND NOT has_{z})" for z in keyed)
    more = ", ".join(map(repr, few))
    mode = "CASE WHEN z.zone IN ('main_title', 'subtitle') THEN 'decorative_line' WHEN z.zone IN ('organization_name', 'footer_text') THEN 'small_text_lines' ELSE 'single_line' END"
    return f"SELECT r.page, z.zone, {mode} AS mode FROM {recovery(d)} AS r JOIN {values(d, [(z,) for z, _ in ZONES], 'zone')} AS z ON {missing} OR (n_text < 3 AND z.zone IN ({more})) WHERE n_text < 3 OR NOT has_main_title OR NOT (has_school_name OR has_organization_name)"


@both("status_counts")
def status_counts(d):
    return f"SELECT page, status, count(*) AS n FROM {review_first(d, features(d))} AS r GROUP BY page, status"


@both("review_output")
def review_output(d):
    """Text of each page in reading order; what is not verified carries a mark, confirmed non-text is left out."""
    mark = f"CASE WHEN t = '' THEN NULL WHEN status = 'confirmed_non_text' THEN NULL ELSE CASE status WHEN 'verified' THEN t WHEN 'review_required' THEN {d.s('[โปรดตรวจสอบ: ')} || t || ']' WHEN 'possible_text' THEN {d.s('[อาจเป็นข้อความ: ')} || t || ']' ELSE {d.s('[อาจพลาดข้อความ: ')} || t || ']' END END"
    return f"SELECT page, {d.agg('m', chr(10) * 2, 'top, lft, id')} AS output FROM (SELECT page, top, lft, id, {mark} AS m FROM (SELECT *, {d.trim('text')} AS t FROM {review_first(d, features(d))} AS r) AS s) AS u GROUP BY page"


@both("strict_output")
def strict_output(d):
    return f"SELECT page, {d.agg("CASE WHEN emit AND text <> '' AND NOT " + leak(d, 'text') + " THEN text END", chr(10) * 2, 'top, lft, id')} AS output FROM {hard_block(d)} AS b GROUP BY page"


@both("emitted_confidence")
def emitted_confidence(d):
    return f"SELECT page, round(CAST(avg(CASE WHEN emit AND text <> '' THEN ocr_confidence END) AS DOUBLE), 6) AS confidence FROM {hard_block(d)} AS b GROUP BY page"


@both("variant_plan")
def variant_plan(d):
    """Preprocessing variants of each region, fast and on retry, a row for each."""
    blocked = "region_type IN (" + ", ".join(map(repr, NON_TEXT)) + ")"
    retry = "CASE WHEN id % 6 = 0 THEN 'upscale4,small_mark' WHEN decorative OR zone IN ('main_title', 'subtitle') THEN 'upscale4,clahe,color_isolation' WHEN small THEN 'upscale4,small_mark' ELSE 'upscale4,clahe' END"
    most = f"CASE WHEN {blocked} THEN 0 WHEN decorative OR zone IN ('main_title', 'subtitle') THEN 5 WHEN id % 6 = 0 THEN 4 ELSE 2 END"
    return f"SELECT id, CASE WHEN {blocked} THEN '' ELSE 'original,upscale2' END AS fast, CASE WHEN {blocked} THEN '' ELSE {retry} END AS retry, {most} AS most FROM (SELECT *, {zone()} AS zone FROM {features(d)} AS f) AS g"


BLOCKS = [
    (1, "ISBN 978-974-123-456-7", 0.9, 0.02), (2, "โทร. 02-123-4567", 0.9, 0.02), (3, "ราคา 250 บาท", 0.9, 0.02), (4, "1. รายการแรก", 0.5, 0.02), (5, "เลขที่ 99 ถนนพระราม 1 เขตปทุมวัน", 0.9, 0.02), (6, "สำนักพิมพ์แห่งหนึ่ง", 0.8, 0.02), (7, "นาย สมชาย ใจดี", 0.6, 0.02),
    (8, "โรงเรียนตัวอย่าง", 0.7, 0.02), (9, "มหาวิทยาลัยตัวอย่าง", 0.7, 0.02), (10, "ชั้นมัธยมศึกษาปีที่ 1", 0.55, 0.02), (11, "ใบงานวรรณคดี", 0.1, 0.05), (12, "A short line", 0.1, 0.05), (13, "Ends here.", 0.5, 0.02), (14, "low", 0.9, 0.01), (15, "", 0.1, 0.1), (16, "081 234 5678", 0.4, 0.02), (17, "ดร. ก", 0.2, 0.2),
]
NAME = r"^(?:ดร\.|ผศ\.|รศ\.|ศ\.|เด็กหญิง|เด็กชาย|นางสาว|นาง|นาย)\s*"
SCHOOL = "สำนักพิมพ์|ศูนย์การศึกษา|สถานศึกษา|เขตพื้นที่|สำนักงาน|วิทยาลัย|โรงเรียน"
TITLE = "รายงาน|หนังสือ|เกียรติบัตร|ประกาศ|บทเรียน|ใบงาน|แบบฝึกหัด|ชั้นมัธยมศึกษา|วรรณคดี|ใบกิจกรรม"
ENDED = r"[!.?\x{3002}\x{FF01}\x{FF1F}]$"


def protected(d, t: str) -> str:
    return f"""CASE WHEN {t} = '' THEN 'unknown' WHEN {d.has(t, NAME)} THEN 'person_name' WHEN {d.has(t, SCHOOL)} THEN CASE WHEN {d.has(t, 'สถานศึกษา|โรงเรียน')} THEN 'school_name' ELSE 'organization_name' END WHEN {d.has(t, r'^(?:ระดับชั้น|ชั้น)' + chr(92) + 's*(?:อนุบาล|ประถม|มัธยม)')} THEN 'class_level'
      WHEN {d.has(t, TITLE)} OR (y < 0.36 AND h >= 0.034 AND length({t}) <= 90) THEN 'title' WHEN length({t}) >= 55 OR {d.has(t, ENDED)} THEN 'paragraph' ELSE 'unknown' END"""


def block_type(d, t: str) -> str:
    isbn = r"(?i)(?:97[89](?:[-\s]?\d){10}|" + r"ISBN(?:-10|-13)?\s*:?\s*" + r"(?:97[89][-\s]?)?[0-9X](?:[-\s]?[0-9X]){8,12})"
    phone = r"^0\d(?:[-\s]?\d){8}$|" + r"\(?\d\d\d?\)?" + r"[-\s]?\d{3,4}[-\s]\d{3,4}"
    price = rf"(?:ราคา|บาท|\x{{0E3F}})\s*[,.{P.DIGIT}]+|[,.{P.DIGIT}]+\s*(?:\x{{0E3F}}|บาท)"
    return f"""CASE WHEN {t} = '' THEN 'unknown' WHEN {d.has(t, isbn)} THEN 'isbn' WHEN {d.has(t, phone)} THEN 'phone' WHEN {d.has(t, price)} THEN 'price' WHEN {d.has(t, r'^(?:[' + P.CONSONANT + r']|' + chr(92) + 'd+)[).]' + chr(92) + 's+')} THEN 'numbered_list'
      WHEN {d.has(t, 'ซอย|เลขที่|จังหวัด|อำเภอ|ตำบล|เขต|แขวง|ถนน')} AND length({t}) > 15 THEN 'address' WHEN {d.has(t, 'เผยแพร่|จัดพิมพ์|ศูนย์หนังสือ|สำนักพิมพ์')} THEN 'publisher_info' WHEN p IN ('person_name', 'school_name', 'organization_name', 'class_level') THEN p
      WHEN length({t}) >= 70 OR {d.has(t, ENDED)} THEN 'paragraph' WHEN p = 'title' OR (y < 0.32 AND (h > 0.035 OR length({t}) < 80)) THEN 'title' ELSE 'unknown' END"""


def language(d, kind: str, text: str) -> str:
    """The language to read a block in: names are Thai, codes are numbers, else by the letters there are, Thai if in doubt."""
    thai, latin = d.has(text, f"[{P.THAI}]"), d.has(text, "[A-Za-z]")
    return f"""CASE WHEN {kind} IN ('person_name', 'school_name', 'organization_name', 'class_level') THEN 'tha' WHEN {kind} = 'barcode' THEN 'barcode' WHEN {kind} IN ('isbn', 'phone', 'price') THEN 'number'
      WHEN {latin} AND ({thai} OR {kind} IN ('address', 'publisher_info')) THEN 'tha+eng' WHEN {thai} OR NOT {latin} OR {kind} IN ('title', 'paragraph', 'numbered_list', 'address', 'publisher_info') THEN 'tha' ELSE 'eng' END"""


@both("block_types")
def block_types(d):
    """Type of each block and the language to read it in."""
    return f"SELECT id, p AS protected, type, {language(d, 'type', 't')} AS language FROM (SELECT *, {block_type(d, 't')} AS type FROM (SELECT *, {protected(d, 't')} AS p FROM (SELECT id, y, h, {d.trim('text')} AS t FROM {values(d, BLOCKS, 'id, text, y, h')} AS a) AS b) AS c) AS e"


DASHES = [(1, "-", "A-1"), (2, "–", "10–20"), (3, "—", "word — word"), (4, "−", "5 − 3"), (5, "_", "a_b"), (6, "/", "1/2"), (7, "|", "x|y"), (8, "----", "----"), (9, "====", "===="), (10, "-", "2563-2564"), (11, "-", "AB12-34")]


@both("dash_symbols")
def dash_symbols(d):
    line = r"^(?:={4,}|_{4,}|-{4,}|\x{2550}{4,}|\x{2501}{4,}|\x{2500}{4,})$"
    code = f"(({d.has('context', '[A-Za-z0-9]+[-/_][A-Za-z0-9]+')} AND {d.has('context', '[A-Za-z]')}) OR {d.has(d.trim('context'), '(?i)^(?:[0-9A-Z]{2,}[-/_])+[-/0-9A-Z_]+$')})"
    role = f"CASE WHEN {d.has('symbol', line)} THEN 'section_separator' WHEN {code} THEN 'document_code' WHEN {d.has('context', chr(92) + 'd' + chr(92) + 's*[-' + chr(92) + 'x{2013}]' + chr(92) + 's*' + chr(92) + 'd')} THEN 'range' WHEN symbol = '—' THEN 'sentence_separator' WHEN symbol = '−' THEN 'mathematical_minus' ELSE 'text_symbol' END"
    kind = f"CASE WHEN {d.has('symbol', line)} THEN 'separator_line' ELSE CASE symbol WHEN '-' THEN 'hyphen' WHEN '–' THEN 'en_dash' WHEN '—' THEN 'em_dash' WHEN '−' THEN 'minus_sign' WHEN '_' THEN 'underscore' WHEN '/' THEN 'slash' WHEN '|' THEN 'vertical_bar' ELSE 'unknown' END END"
    return f"SELECT id, {kind} AS type, {role} AS role FROM {values(d, DASHES, 'id, symbol, context')} AS v"


@both("thai_gaps")
def thai_gaps(d):
    return "SELECT p_partkey AS id, CASE WHEN g < 0.35 THEN 'internal_grapheme_gap' WHEN g < 0.75 THEN 'internal_word_gap' ELSE 'word_space' END AS gap, greatest(6.0, round(h * 0.30)) AS pad_top, greatest(4.0, round(h * 0.15)) AS pad_bottom, greatest(4.0, round(w * 0.15)) AS pad_side FROM (SELECT p_partkey, p_partkey % 40 / 32.0 AS g, CAST(p_size AS DOUBLE) AS h, p_size * 3.0 AS w FROM part) AS a"
