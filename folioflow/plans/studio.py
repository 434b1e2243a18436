"""The document studio: page sets, blocks and their edits, results made into models, styles as CSS and as word properties.

A conversation stands for a document and its turns for pages; parts stand for boxes on pages of twenty-four.
"""

from __future__ import annotations

from folioflow.plans.dialect import both, values
from folioflow.plans.regions import features, language
from folioflow.plans.tables import cells, clean

PAGES = "(SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
BLOCKS = "(SELECT p_partkey AS id, CAST(floor(p_partkey / 24) AS BIGINT) AS page, p_name AS text, (p_partkey * 53) % 700 * 1e0 AS x, (p_partkey * 29) % 1000 * 1e0 AS y, 20e0 + p_partkey % 50 AS w, 8e0 + p_partkey % 29 AS h, p_partkey % 20 / 20e0 AS confidence FROM part)"

TYPES = ["person_name", "school_name", "organization_name", "class_level", "barcode", "isbn", "phone", "price", "address", "publisher_info", "title", "paragraph", "numbered_list", "unknown"]
TEXTS = ["สวัสดี", "Hello there", "ห้อง A12", "0 2123 4567", "", "ถนน Main"]


@both("block_languages")
def block_languages(d):
    """Languages of all types of block, and of the regions of all pages."""
    kinds, texts = values(d, [(k,) for k in TYPES], "kind", "a"), values(d, [(i, t) for i, t in enumerate(TEXTS)], "no, text", "b")
    return f"SELECT kind, no, {language(d, 'kind', 'text')} AS language, count(*) AS n FROM (SELECT kind, no, text FROM {kinds} AS k CROSS JOIN {texts} AS t) AS f GROUP BY kind, no, text UNION ALL SELECT region_type AS kind, -1, {language(d, 'region_type', 'text')}, count(*) FROM {features(d)} AS g GROUP BY region_type, {language(d, 'region_type', 'text')}"


_DEVICES = [(1, 8.0, 8, 1440, False, "turbo", 5), (2, 4.0, 8, 1440, False, "turbo", 5), (3, None, None, None, None, "auto", 3), (4, 8.0, 6, 800, False, "auto", 9), (5, 16.0, 12, 1920, True, "eco", 2), (6, 16.0, 12, 0, False, "auto", 1), (7, None, 4, 820, False, "auto", 4), (8, 2.0, 2, 400, True, "turbo", 0)]


@both("worker_counts")
def worker_counts(d):
    """Small devices get one worker; else by mode, by cores, and no more than there is to do."""
    mobile = "(coalesce(coarse, false) OR (width > 0 AND width < 820) OR (memory > 0 AND memory <= 4) OR cores <= 2)"
    asked = "CASE WHEN mode = 'eco' THEN 1 WHEN mode = 'turbo' OR cores >= 6 THEN 2 ELSE 1 END"
    return f"SELECT id, {mobile} AS mobile, CASE WHEN {mobile} THEN 1 ELSE 2 END AS workers, CAST(greatest(1, least(2, {asked}, jobs)) AS INT) AS selected FROM (SELECT id, coalesce(memory, 0e0) AS memory, coalesce(cores, 2) AS cores, coalesce(width, 0) AS width, coarse, mode, jobs FROM {values(d, _DEVICES, 'id, memory, cores, width, coarse, mode, jobs')} AS v) AS w"


_ACTIONS = {"visible": ["copy-page", "download-page"], "background": ["download-image", "rerun", "rotate", "crop", "analyze", "mixed", "cover-review"], "unchanged": ["delete", ""]}


@both("page_actions")
def page_actions(d):
    """What an action on a page asks of the page: to be seen, to be worked on, or nothing."""
    rows = values(d, [(a,) for acts in _ACTIONS.values() for a in acts], "action")
    known = " ".join(f"WHEN action IN ({', '.join(map(d.s, acts))}) THEN {d.s(k)}" for k, acts in _ACTIONS.items() if k != "unchanged")
    return f"SELECT action, CASE {known} ELSE 'unchanged' END AS policy FROM {rows} AS a"


STATUSES = ["verified", "review_required", "possible_text", "likely_non_text", "confirmed_non_text"]


@both("overlay_blocks")
def overlay_blocks(d):
    """Blocks that an overlay draws on each page, by filter."""
    status = "CASE id % 5 " + " ".join(f"WHEN {i} THEN {d.s(s)}" for i, s in enumerate(STATUSES)) + " END"
    rows = f"(SELECT page, {status} AS status, f AS filter FROM {BLOCKS} AS b CROSS JOIN {values(d, [(x,) for x in ('all', 'verified', 'possible', 'non_text')], 'f', 'v')} AS w)"
    drawn = "status <> 'confirmed_non_text' AND CASE filter WHEN 'verified' THEN status = 'verified' WHEN 'possible' THEN status IN ('review_required', 'possible_text') WHEN 'non_text' THEN status = 'likely_non_text' ELSE true END"
    return f"SELECT page, filter, count(*) AS n FROM {rows} AS r WHERE {drawn} GROUP BY page, filter"


@both("find_block")
def find_block(d):
    """The first page that holds a block, for every part that was ordered; none if no page has it."""
    wanted = "(SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY l_partkey)"
    return f"SELECT w.id, w.n, min(b.page) AS page FROM {wanted} AS w LEFT JOIN {BLOCKS} AS b ON b.id = w.id GROUP BY w.id, w.n"


@both("ocr_line_blocks")
def ocr_line_blocks(d):
    """Recognised lines as blocks: font by height, headings well over the upper median, review under 0.85."""
    middle = f"(SELECT page, {d.sorted_at('h', 'floor(count(*) / 2)')} AS median FROM {BLOCKS} AS a GROUP BY page)"
    font = "least(greatest(h * 0.76e0, 8e0), 64e0)"
    return f"SELECT b.id, b.page, CASE WHEN h >= median * 1.42e0 THEN 'heading' ELSE 'paragraph' END AS role, round({font}, 6) AS font_size, round(greatest(h, {font} * 1.18e0), 6) AS height, CASE WHEN confidence >= 0.85 THEN 'verified' ELSE 'review_required' END AS review_status FROM {BLOCKS} AS b JOIN {middle} AS m ON m.page = b.page"


@both("ocr_text_blocks")
def ocr_text_blocks(d):
    """Pages without lines: a block to each line of text that isn't blank, spread over the page."""
    height = "greatest(18e0, least(30e0, 1123e0 / greatest(12, n_lines + 2)))"
    lines = d.lines(f"(SELECT conv_id, turn, {d.count('text', chr(10))} + 1 AS n_lines, text FROM conversations)" + " AS c", "conv_id, turn, n_lines")
    return f"SELECT conv_id, turn, line, s AS text, round(794e0 * 0.05e0 + line * {height}, 6) AS y, round({height} * 0.72e0, 6) AS font_size FROM {lines} AS l WHERE {d.trim('s')} <> ''"


@both("result_card_blocks")
def result_card_blocks(d):
    """Blocks of a result placed on a page scaled to 1200 at most; boxes are shares of the page on odd pages."""
    page = "(SELECT DISTINCT page, 700e0 + page % 9 * 200 AS width, 900e0 + page % 7 * 300 AS height FROM (SELECT CAST(floor(p_partkey / 24) AS BIGINT) AS page FROM part) AS q)"
    scaled = f"(SELECT page, greatest(320e0, width * least(1e0, 1200e0 / greatest(width, height))) AS pw, greatest(420e0, height * least(1e0, 1200e0 / greatest(width, height))) AS ph FROM {page} AS p)"
    box = f"(SELECT id, page, text, confidence, CASE WHEN page % 2 = 1 THEN x / 1000 ELSE x END AS x, CASE WHEN page % 2 = 1 THEN y / 1000 ELSE y END AS y, CASE WHEN page % 2 = 1 THEN w / 1000 ELSE w END AS w, CASE WHEN page % 2 = 1 THEN h / 1000 ELSE h END AS h FROM {BLOCKS} AS a)"
    share = "(x <= 1 AND y <= 1 AND w <= 1 AND h <= 1)"
    place = lambda v, side, default: f"round(CASE WHEN {share} THEN {v} * {side} WHEN {v} = 0 THEN {default} ELSE {v} END, 6) AS {v}"
    return f"SELECT id, b.page, round(pw, 6) AS page_width, round(ph, 6) AS page_height, {place('x', 'pw', 'pw * 0.08e0')}, {place('y', 'ph', 'ph * 0.08e0')}, {place('w', 'pw', 'pw * 0.84e0')}, {place('h', 'ph', '52e0')}, round(greatest(12e0, h), 6) AS font_size FROM {box} AS b JOIN {scaled} AS s ON s.page = b.page WHERE text <> ''"


@both("merged_models")
def merged_models(d):
    """Ten documents as one: pages in order, numbered anew, named after where they came from; issues together."""
    merged = "CAST(floor(conv_id / 10) AS BIGINT)"
    return f"SELECT {merged} AS merged, conv_id, turn, row_number() OVER (PARTITION BY {merged} ORDER BY conv_id, turn) AS number, {d.str('conv_id')} || ' · ' || {d.str('turn')} AS name, sum(CASE WHEN text = '' OR text IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {merged}) AS n_issues FROM conversations"


@both("form_regions")
def form_regions(d):
    """Words of the top and bottom eighth of each page, more or less, as header and footer."""
    part = lambda cond: f"coalesce({d.agg(f'CASE WHEN {cond} THEN text END', ' ', 'id')}, '')"
    middle = "(y + y + h) / 2"
    return f"SELECT page, {part(f'{middle} < 1000 * 0.13e0')} AS header, {part(f'{middle} > 1000 * 0.87e0')} AS footer FROM {BLOCKS} AS b GROUP BY page"


@both("idle_slots")
def idle_slots(d):
    """For each user the type of event with the fewest, the first by name if several have: who gets the next job."""
    return "SELECT user_id, event_type, pending FROM (SELECT user_id, event_type, count(*) AS pending, row_number() OVER (PARTITION BY user_id ORDER BY count(*), event_type) AS no FROM events GROUP BY user_id, event_type) AS a WHERE no = 1"


@both("confidence_scale")
def confidence_scale(d):
    """Confidence of attempts, given as a share or in percent, as a share."""
    raw = "CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 2.5e0 ELSE l_discount * 9e0 END"
    return f"SELECT l_linenumber, l_returnflag, round(sum(CASE WHEN raw > 1 THEN greatest(0e0, least(1e0, raw / 100)) ELSE greatest(0e0, raw) END), 4) AS total, count(*) AS n FROM (SELECT l_linenumber, l_returnflag, CAST({raw} AS DOUBLE) AS raw FROM lineitem) AS a GROUP BY l_linenumber, l_returnflag"


@both("moved_pages")
def moved_pages(d):
    """Pages after the second one of each document is moved back by one, on by one or on by nine: held within the document."""
    target = "least(n - 1, greatest(0, 1 + delta))"
    new = f"CASE WHEN n < 2 THEN idx WHEN idx = 1 THEN {target} WHEN idx > 1 AND idx <= {target} THEN idx - 1 WHEN idx < 1 AND idx >= {target} THEN idx + 1 ELSE idx END"
    return f"SELECT conv_id, delta, turn, {new} + 1 AS number FROM {PAGES} AS p CROSS JOIN {values(d, [(-1,), (1,), (9,)], 'delta', 'v')} AS w"


@both("deleted_pages")
def deleted_pages(d):
    """Pages left once those of assistants are deleted, if any page is left at all; else all stay."""
    gone = "(role = 'assistant')"
    left = f"(SELECT *, count(*) OVER (PARTITION BY conv_id) - sum(CASE WHEN {gone} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS rest FROM {PAGES} AS p)"
    return f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS number FROM {left} AS a WHERE rest < 1 OR NOT {gone}"


@both("selected_pages")
def selected_pages(d):
    """Pages to export: all of them, or only those that are selected (here those of users)."""
    return f"SELECT only_selected, conv_id, count(*) AS n_pages, sum(length(text)) AS n_chars FROM {PAGES} AS p CROSS JOIN {values(d, [(True,), (False,)], 'only_selected', 'v')} AS w WHERE NOT only_selected OR role = 'user' GROUP BY only_selected, conv_id"


@both("added_pages")
def added_pages(d):
    """Documents with a page more, as large as the one before; the first is A4."""
    size = "(SELECT conv_id, turn, idx, n, 500 + turn % 5 * 100 AS width, 700 + turn % 3 * 100 AS height FROM " + PAGES + " AS p)"
    return f"SELECT conv_id, idx + 1 AS number, width, height FROM {size} AS a UNION ALL SELECT conv_id, n + 1, width, height FROM {size} AS b WHERE idx = n - 1 UNION ALL SELECT c_custkey + 1000000000, 1, 794, 1123 FROM customer"


@both("duplicated_blocks")
def duplicated_blocks(d):
    """Blocks of each page once the first is copied a little below and the last is deleted."""
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS no, row_number() OVER (PARTITION BY page ORDER BY id DESC) AS back FROM {BLOCKS} AS a)"
    return f"SELECT {d.str('id')} AS id, page, x, y, text FROM {ranked} AS b WHERE back > 1 UNION ALL SELECT {d.str('id')} || '-copy', page, x + 18, y + 18, text FROM {ranked} AS c WHERE no = 1"


@both("block_text_edits")
def block_text_edits(d):
    """Page texts after a block's text is corrected: its first place is replaced, else the correction goes to the end."""
    found = "instr(text, old)"
    edited = f"CASE WHEN old <> '' AND {found} > 0 THEN substr(text, 1, {found} - 1) || new || substr(text, {found} + length(old)) ELSE {d.trim(f'{d.trim(chr(116) + chr(101) + chr(120) + chr(116))} || chr(10) || chr(10) || new')} END"
    return f"SELECT conv_id, turn, {edited} AS text FROM (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN substr(text, 3, 5) WHEN 1 THEN 'no such words' ELSE '' END AS old, 'corrected' AS new FROM conversations) AS a"


@both("appended_texts")
def appended_texts(d):
    """Page texts with what was recognised on the page after them, two lines below; what is blank adds nothing."""
    said = d.trim("text")
    return f"SELECT conv_id, turn, CASE WHEN extra = '' THEN text WHEN {said} = '' THEN extra ELSE {said} || chr(10) || chr(10) || extra END AS text FROM (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN '' ELSE 'region ' || {d.str('turn')} END AS extra FROM conversations) AS a"


_NOTES = [(1, "อ่านข้อความจาก PDF แล้ว"), (2, "PDF Text Layer"), (3, "OCR"), (4, ""), (5, "pdf text layer")]


@both("text_layer_pages")
def text_layer_pages(d):
    """Pages whose text came with the file, which aren't recognised again."""
    return f"SELECT id, {d.has('note', 'PDF Text Layer|อ่านข้อความจาก PDF')} AS text_layer FROM {values(d, _NOTES, 'id, note')} AS v"


@both("structured_tables")
def structured_tables(d):
    """Tables of two rows and columns or more take the place of the page's text, unless a user has edited it."""
    size = f"(SELECT tbl, max(r) + 1 AS n_rows, max(c) + 1 AS n_columns, sum(length({clean(d, 'text')})) AS n_chars FROM {cells(d)} AS x GROUP BY tbl)"
    return f"SELECT c_custkey AS page, coalesce(n_rows, 0) AS n_rows, coalesce(n_columns, 0) AS n_columns, coalesce(n_rows >= 2 AND n_columns >= 2 AND c_nationkey % 4 <> 0, false) AS replaced FROM customer LEFT JOIN {size} AS s ON s.tbl = c_custkey"


@both("kept_snapshots")
def kept_snapshots(d):
    """Of each user's edits the last fifty, and what undoing each of them brings back."""
    order = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    return f"SELECT user_id, event_id, back, restored FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, lag(event_type) {order} AS restored FROM events) AS a WHERE back <= 50"


@both("nested_writes")
def nested_writes(d):
    """Values under dotted paths after all writes: the last one to each path holds."""
    return f"SELECT user_id, path, event_id FROM (SELECT user_id, 'style.' || event_type || '.' || {d.str('event_id % 2')} AS path, event_id, row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY ts DESC, event_id DESC) AS no FROM events) AS a WHERE no = 1"


@both("current_runs")
def current_runs(d):
    """Results of each user's current run; what earlier runs still deliver is dropped. A run ends with an error."""
    runs = "(SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)"
    return f"SELECT user_id, count(*) AS n_results, max(run) AS run FROM (SELECT *, max(run) OVER (PARTITION BY user_id) AS current FROM {runs} AS a) AS b WHERE run = current GROUP BY user_id"


_STYLES = [(1, "fontSize", "18", True), (1, "fontWeight", "700", True), (1, "backgroundColor", "#ffffff", False), (2, "lineHeight", "1.45", True), (2, "color", "", False), (2, "zIndex", "3", True), (2, "borderTopWidth", "2", True), (3, "opacity", "0.5", True), (3, "color", None, False), (4, "fontFamily", "system-ui", False)]


def hyphenated(d, x: str) -> str:
    """A camel-case name as CSS spells it."""
    return f"lower({d.sub(x, '([A-Z])', chr(36) + '1' if d.spark else chr(92) + '1').replace(chr(36) + '1', '-' + chr(36) + '1').replace(chr(92) + '1', '-' + chr(92) + '1')})"


@both("css_styles")
def css_styles(d):
    """Styles as CSS: no empty values, pixels for numbers but for four properties that have none."""
    unit = "CASE WHEN number AND name NOT IN ('fontWeight', 'lineHeight', 'opacity', 'zIndex') THEN 'px' ELSE '' END"
    return f"SELECT block, {d.agg(f'{hyphenated(d, chr(110) + chr(97) + chr(109) + chr(101))} || {d.s(chr(58))} || value || {unit}', ';', 'name')} AS css FROM {values(d, _STYLES, 'block, name, value, number')} AS v WHERE value <> '' GROUP BY block"


COLOURS = ["#a1b2c3", "ABCDEF", "red", "", "#12345", "00ff7f"]


def word_colour(d, x: str, default: str = "111827") -> str:
    bare = d.sub(x, "^#", "")
    return f"CASE WHEN {d.has(bare, '^[0-9A-Fa-f]{6}$')} THEN upper({bare}) ELSE {d.s(default)} END"


@both("word_properties")
def word_properties(d):
    """Run properties of blocks for word processors: marks, colour, size in half points."""
    colour = "CASE id % 6 " + " ".join(f"WHEN {i} THEN {d.s(c)}" for i, c in enumerate(COLOURS)) + " END"
    return f"SELECT id, {word_colour(d, 'colour')} AS colour, CAST(round(greatest(8e0, h) * 1.5e0) AS INT) AS half_points, id % 900 >= 600 AS bold, id % 7 = 0 AS italic FROM (SELECT id, h, {colour} AS colour FROM {BLOCKS} AS b) AS a"


@both("word_positions")
def word_positions(d):
    """Places of floating blocks in points, of pages in twentieths, and how pages lie."""
    return f"SELECT id, greatest(0e0, x) * 0.75e0 AS lft, greatest(0e0, y) * 0.75e0 AS top, greatest(0.75e0, w * 0.75e0) AS width, greatest(0.75e0, h * 0.75e0) AS height, CAST(greatest(1, round(x * 15)) AS INT) AS page_width, CASE WHEN x > y THEN 'landscape' ELSE 'portrait' END AS orient FROM {BLOCKS} AS b"


_MADE = [(1, "image", None, None, 2.0, None), (2, "image", "a.png", "cover", -1.0, None), (3, "image", "b.png", None, None, None), (4, "shape", None, None, None, "line"), (5, "shape", None, None, None, None), (6, "shape", None, None, None, "circle"), (7, "field", "Name", None, None, None), (8, "text", None, None, None, None)]


@both("block_defaults")
def block_defaults(d):
    """Images, shapes and fields with what isn't said filled in."""
    return f"""SELECT id, CASE WHEN kind = 'shape' AND shape = 'line' THEN 'line' ELSE kind END AS type, CASE WHEN kind IN ('image', 'field') THEN coalesce(label, '') END AS label, CASE WHEN kind = 'image' THEN coalesce(fit, 'contain') END AS fit, CASE WHEN kind = 'image' THEN least(1e0, greatest(0e0, coalesce(opacity, 1e0))) END AS opacity,
      CASE WHEN kind = 'shape' THEN coalesce(shape, 'rectangle') END AS shape, CASE kind WHEN 'image' THEN '#d1d5db' WHEN 'shape' THEN '#111827' ELSE 'transparent' END AS stroke, CASE WHEN kind IN ('field', 'text') THEN 16 END AS font_size FROM {values(d, _MADE, 'id, kind, label, fit, opacity, shape')} AS v"""


@both("reading_jobs")
def reading_jobs(d):
    """Pages taken on for reading: sides of 2200 at most, and regions scaled back to the source's pixels."""
    job = "(SELECT DISTINCT page, 1500e0 + page % 11 * 300 AS width, 1800e0 + page % 7 * 400 AS height FROM (SELECT CAST(floor(p_partkey / 24) AS BIGINT) AS page FROM part) AS q)"
    scaled = f"(SELECT page, width, height, least(1e0, 2200e0 / greatest(width, height)) AS scale FROM {job} AS j)"
    back = lambda v: f"CAST(floor({v} / scale + 0.5e0) AS INT) AS {v}"
    return f"SELECT id, b.page, CAST(floor(width * scale + 0.5e0) AS INT) AS job_width, CAST(floor(height * scale + 0.5e0) AS INT) AS job_height, {back('x')}, {back('y')}, {back('w')}, {back('h')} FROM {BLOCKS} AS b JOIN {scaled} AS s ON s.page = b.page"
