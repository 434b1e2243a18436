"""Gates over whole blocks, signals of failure, difficult words, dashes with their places, lookups, measures of recovery, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import patterns as P
from folioflow.functions import sequences
from folioflow.functions.sara_am import WORDS as SARA_WORDS
from folioflow.plans.dialect import Duck, both, values
from folioflow.plans.ranking import NOISY, gibberish
from folioflow.plans.regions import BLOCKS, features, protected, review_first
from folioflow.plans.registry import query
from folioflow.session import table

DASH = r"[-/_|\x{2013}\x{2014}\x{2212}]+"
DASHED = [(1, "a-b — c\n----\nx_y/z | w"), (2, "10–20"), (3, "no dashes"), (4, "-\n  ====  \n5 − 3"), (5, "ก-ข / ค")]


@both("dash_elements")
def dash_elements(d):
    """Every run of dashes with its line and column, and separator lines as one element each."""
    line = r"^(?:={4,}|_{4,}|-{4,}|\x{2550}{4,}|\x{2501}{4,}|\x{2500}{4,})$"
    every = rf"{DASH}|[^-/_|\x{{2013}}\x{{2014}}\x{{2212}}]+"
    parts = f"regexp_extract_all(s, {d.s(every)}, 0)" if d.spark else f"regexp_extract_all(s, {d.s(every)})"
    lines = f"(SELECT id, line, s FROM {d.lines(values(d, DASHED, 'id, text'), 'id')} AS l)"
    exploded = f"(SELECT id, line, posexplode({parts}) AS (no, part) FROM {lines} AS l1 WHERE NOT {d.has(d.trim('s'), line)})" if d.spark else f"(SELECT id, line, generate_subscripts({parts}, 1) - 1 AS no, unnest({parts}) AS part FROM {lines} AS l1 WHERE NOT {d.has(d.trim('s'), line)})"
    placed = f"(SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY id, line ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS col FROM {exploded} AS e)"
    return f"SELECT id, line + 1 AS line, CAST(col AS INT) AS col, part AS symbol FROM {placed} AS p WHERE {d.has('part', '^' + DASH + '$')} UNION ALL SELECT id, line + 1, NULL, {d.trim('s')} FROM {lines} AS l2 WHERE {d.has(d.trim('s'), line)}"


_TH, _LA = "[ก-๙]", "[A-Za-z]"
SIGNALS = {
    "latin_inside_thai_word": lambda d: d.has("t", f"{_TH}{_LA}+{_TH}|{_LA}+{_TH}+{_LA}+"),
    "english_noise_in_thai": lambda d: f"({d.has('t', r'(?i)(?:^|[^0-9A-Z_a-z])(?:dos|wi|io|Tn' + chr(92) + '.)(?:[^0-9A-Z_a-z]|$)')} AND {d.has('t', '[ก-๙]')})",
    "repeated_barcode_symbols": lambda d: d.has("t", "|".join(rf"(?:{sign}\s*){{3,}}" for sign in (r"\+", r"\[", r"\|"))),
    "unstructured_alphanumeric": lambda d: f"({d.has('t', '[A-Za-z][0-9][A-Za-z][0-9]|[0-9][A-Za-z][0-9][A-Za-z]')} AND NOT {d.has('t', '[0-9A-Za-z]+[-/_][0-9A-Za-z]+')})",
    "low_confidence": lambda d: "confidence < 0.6",
    "no_baseline": lambda d: "NOT baseline",
}


@both("failure_signals")
def failure_signals(d):
    """Signals that a reading failed, a row for each."""
    rows = f"(SELECT id, confidence, baseline, {d.trim('text')} AS t FROM {values(d, [*NOISY, (20, 'คำabcไทย', 0.9, True, True), (21, 'ไทย dos x', 0.9, True, True)], 'id, text, confidence, baseline, fit')} AS v)"
    return " UNION ALL ".join(f"SELECT id, {d.s(name)} AS signal FROM {rows} AS r{i} WHERE {f(d)}" for i, (name, f) in enumerate(SIGNALS.items()))


def gate(d) -> str:
    """Final status of a block: its region's status, held back by what fails; text is never lost for being noisy."""
    noise = gibberish(d, f"(SELECT id, text, ocr_confidence AS confidence, baseline >= 0.34 AS baseline, true AS fit FROM {features(d)} AS n0)")
    thai = d.has("t", f"[{P.THAI}]")
    joined = f"(SELECT r.*, g.status AS noise, {d.trim('r.text')} AS t, top / page_height AS y, height / page_height AS h FROM {review_first(d, features(d))} AS r JOIN (SELECT id, status FROM {noise} AS g0) AS g ON g.id = r.id)"
    typed = f"(SELECT *, {protected(d, 't')} AS kind FROM {joined} AS j)"
    guarded = "kind IN ('person_name', 'school_name', 'organization_name', 'class_level')"
    fails = ["region_confidence < 0.88", f"ocr_confidence < CASE WHEN {guarded} THEN 0.97 ELSE 0.88 END", f"thai_script < CASE WHEN {thai} THEN 0.82 ELSE 0.68 END", "baseline < 0.34", "noise <> 'accepted'"]
    n = " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in fails)
    rejected = "noise = 'rejected_as_non_text'"
    final = f"""CASE WHEN t = '' AND status <> 'confirmed_non_text' THEN 'likely_non_text' WHEN status = 'verified' AND failures > 0 THEN CASE WHEN {guarded} OR {rejected} THEN 'review_required' ELSE 'possible_text' END
      WHEN status = 'confirmed_non_text' AND length(t) >= 3 THEN 'possible_text' WHEN {rejected} AND length(t) >= 3 AND status <> 'confirmed_non_text' THEN 'possible_text' ELSE status END"""
    return f"(SELECT *, {final} AS gated FROM (SELECT *, {n} AS failures FROM {typed} AS k) AS m)"


@both("confidence_gate")
def confidence_gate(d):
    return f"SELECT id, kind, status, gated, failures FROM {gate(d)} AS g"


@both("block_summary")
def block_summary(d):
    """Final confidence of a block, held under 0.88 unless it passed the gate; whether it needs another look."""
    final = "round(ocr_confidence * 0.40 + 0.22 + least(ocr_confidence, 0.95) * 0.18 + region_confidence * 0.20, 9)"
    return f"SELECT id, CAST(CASE WHEN gated = 'verified' THEN {final} ELSE least({final}, 0.87) END AS DOUBLE) AS final_confidence, gated <> 'verified' OR ocr_confidence < 0.96 AS review FROM {gate(d)} AS g"


@both("retry_blocks")
def retry_blocks(d):
    """Blocks to read again: low confidence, a failed gate, or a long Thai word."""
    return f"SELECT id, ocr_confidence < 0.96 OR gated <> 'verified' OR {d.has('t', '[ก-๙]{12,}')} AS retry FROM {gate(d)} AS g"


@both("status_split")
def status_split(d):
    """What is accepted, reviewed and dropped on each page."""
    return f"SELECT page, {d.if_(chr(103) + 'ated = ' + d.s('verified'))} AS n_accepted, {d.if_('gated IN (' + ', '.join(map(d.s, ('review_required', 'possible_text', 'likely_non_text'))) + ')')} AS n_review, {d.if_('gated = ' + d.s('confirmed_non_text'))} AS n_dropped FROM {gate(d)} AS g GROUP BY page"


HARD = ["เทคโนโลยี", "อิเล็กทรอนิกส์", "พระราชบัญญัติ", "ทรัพย์สิน", "วิเคราะห์", "อนุมัติ"]


@both("difficult_thai")
def difficult_thai(d):
    """Thai words that want a look: marks, ten signs or more, a list of hard ones; those of a user's dictionary don't."""
    text = f"(SELECT id, text FROM {values(d, [(i, b[1]) for i, b in enumerate(BLOCKS)] + [(90, 'เทคโนโลยี และ การอนุมัติ'), (91, 'มา')], 'id, text')} AS v0)"
    word = f"explode(regexp_extract_all(text, {d.s(f'[{P.THAI}]+')}, 0))" if d.spark else f"unnest(regexp_extract_all(text, {d.s(f'[{P.THAI}]+')}))"
    hard = f"({d.has('w', f'[{P.MARKS}]')} OR length(w) >= 10 OR w IN ({', '.join(map(d.s, HARD))}))"
    known = values(d, [(w,) for w in SARA_WORDS], "w", "k")
    return f"SELECT a.id, a.w AS word, {d.has('a.w', rf'(?:^|[^{P.CONSONANT}{P.MARKS}])[{P.MARKS}]')} AS bad_mark FROM (SELECT DISTINCT id, w FROM (SELECT id, {word} AS w FROM {text} AS t) AS u WHERE {hard}) AS a WHERE NOT EXISTS (SELECT 1 FROM {known} AS k WHERE k.w = a.w)"


@both("dictionary_words")
def dictionary_words(d):
    """Words of all documents against a dictionary of the thousand commonest: known and unknown by language."""
    word = f"explode(split(lower(text), {d.s(chr(92) + 's+')}))" if d.spark else f"unnest(string_split_regex(lower(text), {d.s(chr(92) + 's+')}))"
    words = f"(SELECT lang, {word} AS w FROM documents)"
    counted = f"(SELECT lang, w, count(*) AS n FROM {words} AS a GROUP BY lang, w)"
    top = f"(SELECT w FROM {counted} AS b GROUP BY w ORDER BY sum(n) DESC, w LIMIT 1000)"
    return f"SELECT lang, CAST(sum(CASE WHEN t.w IS NULL THEN 0 ELSE n END) AS BIGINT) AS n_known, CAST(sum(CASE WHEN t.w IS NULL THEN n ELSE 0 END) AS BIGINT) AS n_unknown FROM {counted} AS x LEFT JOIN {top} AS t ON t.w = x.w GROUP BY lang"


_SPANS = [(1, 0, 0, 1, 2, "head"), (1, 0, 2, 1, 1, "x"), (1, 1, 0, 2, 1, "down"), (1, 1, 1, 1, 1, "a"), (1, 1, 2, 1, 1, "b"), (1, 2, 1, 1, 2, "wide")]


@both("cell_lookup")
def cell_lookup(d):
    """The cell at each slot of a table, spans looked through."""
    grid = values(d, [(r, c) for r in range(3) for c in range(3)], "r, c", "s")
    return f"SELECT s.r, s.c, k.text FROM {grid} AS s JOIN {values(d, _SPANS, 'tbl, rw, cl, rs, cs, text', 'v')} AS k ON s.r >= k.rw AND s.r < k.rw + k.rs AND s.c >= k.cl AND s.c < k.cl + k.cs"


_BEFORE, _AFTER, _WANT = [(1, "ใบงาน", "verified")], [(1, "ใบงาน", "verified"), (2, "ชั้น มัธยม", "possible_text"), (3, "นาย ก", "review_required"), (4, "noise", "confirmed_non_text"), (5, "โรงเรียน ข", "verified")], [(1, "ใบงาน"), (2, "ชั้นมัธยม"), (3, "นาย ก"), (4, "โรงเรียน"), (5, "ไม่พบ")]


@both("recovery_metrics")
def recovery_metrics(d):
    """Expected texts found before and after recovery: one holds the other once blanks are gone."""
    bare = lambda x: d.sub(x, r"\s+", "")
    found = lambda rows, name: f"(SELECT DISTINCT e.id FROM {values(d, _WANT, 'id, text', 'w')} AS e JOIN {values(d, rows, 'id, text, status', 'r')} AS b ON b.status <> 'confirmed_non_text' AND (contains({bare('b.text')}, {bare('e.text')}) OR contains({bare('e.text')}, {bare('b.text')}))) AS {name}"
    return f"SELECT count(*) AS n, count(b.id) AS n_before, count(a.id) AS n_after, {d.if_('b.id IS NULL AND a.id IS NOT NULL')} AS n_recovered, {d.if_('a.id IS NULL')} AS n_missing FROM {values(d, _WANT, 'id, text', 'w0')} AS e LEFT JOIN {found(_BEFORE, 'b')} ON b.id = e.id LEFT JOIN {found(_AFTER, 'a')} ON a.id = e.id"


@both("cover_metrics")
def cover_metrics(d):
    """Of regions taken for text and regions that are: precision, recall, how much non-text was turned away, pages with a right title."""
    truth = "(region_type = 'text')"
    said = "(gated IN ('verified', 'review_required', 'possible_text'))"
    share = lambda a, b: f"round(coalesce({d.div(d.if_(a) + ' * 1e0', d.if_(b))}, 1e0), 6)"
    return f"SELECT {share(f'{truth} AND {said}', said)} AS precision_share, {share(f'{truth} AND {said}', truth)} AS recall_share, {share(f'NOT {truth} AND NOT {said}', f'NOT {truth}')} AS rejection_share, {d.if_(f'NOT {truth} AND {said} AND length(t) > 0')} AS n_false_text FROM {gate(d)} AS g"


@query("reading_metrics")
def reading_metrics(spark, sf_dir):
    """Error rates of benchmark items against readings that lose every seventh sign."""
    read = F.regexp_replace("text", "(.{6}).", "$1")
    return table(spark, sf_dir, "benchmark").select("item_id", sequences.text_metrics(F.col("text"), read).alias("m")).select("item_id", "m.*")


SIZES = {"a4": (794, 1123), "a5": (559, 794), "letter": (816, 1056), "legal": (816, 1344)}
_EXPORTS = [(1, "a4", None, None, 1.0, 96, True), (2, "source", None, None, 2.0, 300, True), (3, "custom", 500.0, 500.0, 1.0, 144, True), (4, "custom", 500.0, 500.0, 1.0, 9999, False), (5, "letter", None, None, 9.0, 10, False)]


@both("export_sizes")
def export_sizes(d):
    """Pixels of exported pages of 1000 by 1500: page sizes, scale and density within bounds, aspect kept where asked."""
    side = lambda i, given, source: "CASE size " + " ".join(f"WHEN {d.s(k)} THEN {v[i]}e0" for k, v in SIZES.items()) + f" ELSE coalesce({given}, {source} * least(8e0, greatest(0.1e0, scale))) END"
    fit = "least(w / 1000e0, h / 1500e0)"
    px = lambda x: f"CAST(greatest(1e0, round({x} * least(600, greatest(72, dpi)) / 96e0)) AS INT)"
    return f"SELECT id, {px(f'CASE WHEN keep THEN 1000e0 * {fit} ELSE w END')} AS width, {px(f'CASE WHEN keep THEN 1500e0 * {fit} ELSE h END')} AS height FROM (SELECT *, {side(0, 'gw', '1000e0')} AS w, {side(1, 'gh', '1500e0')} AS h FROM {values(d, _EXPORTS, 'id, size, gw, gh, scale, dpi, keep')} AS v) AS z"


@both("unit_conversions")
def unit_conversions(d):
    """Office lengths in pixels: 9525 EMU, 15 twips and 0.75 points to one; negative ones are none."""
    return "SELECT p_partkey AS id, greatest(0e0, (p_partkey - 100) * 9525 / 9525e0) AS emu, greatest(0e0, (p_partkey - 100) / 15e0) AS twip, greatest(1e0, p_size * 96 / 72e0) AS points FROM part"


_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff"}
_PATHS = [(1, "a/b.PNG", "#A1B2C3"), (2, "x.jpeg", "a1b2c3"), (3, "noext", "red"), (4, "y.tar.tif", "#12345"), (5, "z.bin", "")]


@both("mime_and_colours")
def mime_and_colours(d):
    ending = "lower(substring(path, length(path) - length(" + d.group("path", r"[^.]*$", 0) + ") + 1))"
    mime = f"CASE {ending} " + " ".join(f"WHEN {d.s(k)} THEN {d.s(v)}" for k, v in _MIME.items()) + " ELSE 'application/octet-stream' END"
    bare = d.sub("colour", "^#", "")
    return f"SELECT id, {mime} AS mime, CASE WHEN {d.has(bare, '^[0-9A-Fa-f]{6}$')} THEN '#' || {bare} ELSE '#111827' END AS colour FROM {values(d, _PATHS, 'id, path, colour')} AS v"


__all__ = ["Duck", "gate"]
