"""Queries over text: tokens, segments, normalising, scripts, forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import patterns as P
from folioflow.functions import text as T
from folioflow.plans.registry import query
from folioflow.session import table

#: Sample strings that the driver's tables lack: Thai, zero-width signs, codes, addresses.
SAMPLES = [
    "สำนักงาน ABC-123/45 โทร 02-123-4567", "mail a.b@example.co.th หรือ https://x.test/a?b=1", "www.site.test/หน้า", "ราคา ๑,๒๕๐.๕๐ บาท", "Version 1.2.3 build v2", "C:\\dir\\file.txt", "/usr/local/bin",
    "1.2.3", "+66 81 234 5678", "ไทยEnglishไทย", "O0I1", "don't stop-gap", "2024-01-31", "...", "—", "", "  two   spaces ", "a\tb\u00a0c", "12%", "฿1,250.00", "(1,250.00)", "31/12/2567", "23:59", "x_y.z", "A1B2-C3",
]


def duck(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], names: str, alias: str = "fx") -> str:
    """A relation of literals, read alike by Spark and DuckDB."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
        return duck(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS {alias}({names})"


def samples(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SAMPLES)), "id int, text string")


SAMPLE_SQL = values(list(enumerate(SAMPLES)), "id, text")
TRIM = lambda x: f"regexp_replace({x}, {duck(P.TRIM)}, '', 'g')"
HAS = lambda x, p: f"regexp_matches({x}, {duck(p)})"
ALL = lambda x, p: f"regexp_extract_all({x}, {duck(p)})"
SUB = lambda x, p, r: f"regexp_replace({x}, {duck(p)}, {duck(r)}, 'g')"


def type_sql(t: str) -> str:
    thai, latin = HAS(t, f"[{P.THAI}]"), HAS(t, "[A-Za-z]")
    return (
        f"CASE WHEN {t} = '' THEN 'space' WHEN {HAS(t, P.EMAIL)} THEN 'email' WHEN {HAS(t, P.URL)} THEN 'url' WHEN {HAS(t, P.PHONE)} THEN 'phone' "
        f"WHEN {HAS(t, P.CODE)} AND {HAS(t, P.CODE_SIGN)} THEN 'document_code' WHEN {thai} AND {latin} THEN 'mixed_th_en' WHEN {thai} THEN 'thai' "
        f"WHEN {latin} THEN 'english' WHEN {HAS(t, f'[{P.DIGIT}]')} THEN 'number' WHEN {HAS(t, P.PUNCTUATION)} THEN 'punctuation' ELSE 'unknown' END"
    )


TOKENS_SQL = f"SELECT lang, unnest({ALL('text', P.TOKEN)}) AS token FROM documents"


@query("flagship", f"WITH t AS ({TOKENS_SQL}) SELECT lang, {type_sql(TRIM('token'))} AS token_type, count(*) AS n_tokens, sum(length(token)) AS n_chars FROM t GROUP BY ALL")
def token_types(spark, sf_dir):
    """Tokens of all documents by language and type; each distinct token is classified once."""
    t = table(spark, sf_dir, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("token"))
    t = t.groupBy("lang", "token").agg(F.count("*").alias("n"))
    return t.groupBy("lang", T.token_type(F.col("token")).alias("token_type")).agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.length("token")).cast("long").alias("n_chars"))


@query("token_samples", f"SELECT id, i AS no, token, {type_sql(TRIM('token'))} AS token_type FROM (SELECT id, unnest({ALL('text', P.TOKEN)}) AS token, generate_subscripts({ALL('text', P.TOKEN)}, 1) - 1 AS i FROM {SAMPLE_SQL})")
def token_samples(spark, sf_dir):
    t = samples(spark).select("id", F.posexplode(T.tokens(F.col("text"))).alias("no", "token"))
    return t.select("id", F.col("no").cast("long").alias("no"), "token", T.token_type(F.col("token")).alias("token_type"))


def segments(t: DataFrame, key: str) -> DataFrame:
    """Neighbouring tokens of one type as one segment, but for spaces, addresses and codes; text is the order of no."""
    kind = T.token_type(F.col("token"))
    w = Window.partitionBy(key).orderBy("no")
    t = t.withColumn("type", kind)
    new = F.col("type").isin("space", "email", "url", "document_code") | ~F.col("type").eqNullSafe(F.lag("type").over(w))
    t = t.withColumn("segment", F.sum(new.cast("int")).over(w) - 1)
    out = t.groupBy(key, "segment").agg(F.first("type").alias("type"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "token"))), lambda x: x["token"]), "").alias("text"))
    language = F.when(F.col("type") == "thai", "th").when(F.col("type") == "english", "en").otherwise(F.col("type"))
    return out.select(key, F.col("segment").cast("long").alias("segment"), "type", language.alias("language"), "text")


def _segments_sql(source: str, key: str) -> str:
    return f"""WITH t AS (SELECT {key}, unnest({ALL('text', P.TOKEN)}) AS token, generate_subscripts({ALL('text', P.TOKEN)}, 1) - 1 AS no FROM {source}),
    k AS (SELECT *, {type_sql(TRIM('token'))} AS type FROM t),
    n AS (SELECT *, CASE WHEN type IN ('space', 'email', 'url', 'document_code') OR type IS DISTINCT FROM lag(type) OVER (PARTITION BY {key} ORDER BY no) THEN 1 ELSE 0 END AS new FROM k),
    s AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY no) - 1 AS segment FROM n)
    SELECT {key}, segment::BIGINT AS segment, first(type) AS type, CASE first(type) WHEN 'thai' THEN 'th' WHEN 'english' THEN 'en' ELSE first(type) END AS language, string_agg(token, '' ORDER BY no) AS text FROM s GROUP BY {key}, segment"""


@query("mixed_segments", _segments_sql(SAMPLE_SQL, "id"))
def mixed_segments(spark, sf_dir):
    return segments(samples(spark).select("id", F.posexplode(T.tokens(F.col("text"))).alias("no", "token")), "id")


@query("segments_rejoin", "SELECT count(*) AS n_documents, count(*) AS n_restored FROM documents")
def segments_rejoin(spark, sf_dir):
    """Documents whose tokens joined give the text back; all do."""
    d = table(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("n_documents"), F.count_if(F.array_join(T.tokens(F.col("text")), "") == F.col("text")).alias("n_restored"))


_STRICT_SQL = f"CASE WHEN {HAS('t', P.EMAIL)} THEN 'email' WHEN {HAS('t', P.URL)} THEN 'url' WHEN {HAS('t', P.PHONE)} THEN 'phone' WHEN {HAS('t', P.CODE)} AND {HAS('t', P.CODE_SIGN)} THEN 'document_code' WHEN {HAS('t', P.PATH)} THEN 'file_path' WHEN {HAS('t', P.VERSION)} THEN 'version' END"


@query("strict_kinds", f"SELECT id, {_STRICT_SQL} AS kind FROM (SELECT id, {TRIM('text')} AS t FROM {SAMPLE_SQL})")
def strict_kinds(spark, sf_dir):
    return samples(spark).select("id", T.strict_kind(F.col("text")).alias("kind"))


_NUMBER_ROWS = [(i, s, k) for i, s in enumerate(SAMPLES) for k in P.STRICT]
_VALID_SQL = "CASE kind " + " ".join(f"WHEN {duck(k)} THEN {HAS('digits', p)}" for k, p in P.STRICT.items()) + " END"


@query(
    "strict_numbers",
    f"""WITH a AS (SELECT id, kind, {TRIM('value')} AS raw FROM {values(_NUMBER_ROWS, 'id, value, kind')}), b AS (SELECT *, translate(raw, '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS digits FROM a),
    c AS (SELECT *, {_VALID_SQL} AS valid, {HAS('raw', P.AMBIGUOUS)} AS ambiguous FROM b)
    SELECT id, kind, raw, digits, valid, ambiguous, CASE WHEN ambiguous THEN 'manual_review_required' WHEN valid THEN 'verified' ELSE 'review_recommended' END AS status FROM c""",
)
def strict_numbers(spark, sf_dir):
    """Every sample as every kind of number."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), T.strict_number(F.col("text"), k).alias("n")) for k in P.STRICT])).alias("x")
    return samples(spark).select("id", kinds).select("id", "x.kind", "x.n.*")


def _switches_sql(x: str) -> str:
    t = SUB(SUB(SUB(x, f"[{P.DIGIT}]+", "\x01"), f"[{P.THAI}]+", "\x02"), "[A-Za-z]+", "\x03")
    t = SUB(t, r"[^\x01-\x03]+", "")
    for c in "\x01\x02\x03":
        t = SUB(t, c + "+", c)
    return f"greatest(length({t}) - 1, 0)"


@query("script_switches", f"SELECT {_switches_sql('text')} AS switches, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT text FROM {SAMPLE_SQL}) GROUP BY 1")
def script_switches(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("text").unionByName(samples(spark).select("text"))
    return t.groupBy(T.script_switches(F.col("text")).cast("long").alias("switches")).agg(F.count("*").alias("n"))


_THAI_N, _ALNUM_N = (f"len(regexp_extract_all(text, {duck(p)}))" for p in (f"[{P.THAI}]", f"[{P.THAI}A-Za-z0-9]"))


@query("thai_share", f"SELECT id, coalesce({_THAI_N}::DOUBLE / nullif({_ALNUM_N}, 0), 0.0) AS share, len({ALL('text', f'[{P.DIGIT}]+|[{P.THAI}]+|[A-Za-z]+|[^{P.THAI}0-9A-Za-z' + chr(92) + 's]+')}) AS runs FROM {SAMPLE_SQL}")
def thai_share(spark, sf_dir):
    return samples(spark).select("id", T.thai_share(F.col("text")).alias("share"), F.size(T.script_runs(F.col("text"))).cast("long").alias("runs"))


def _cell_sql(x: str) -> str:
    return TRIM(SUB(SUB(SUB(x, r"\r\n?", "\n"), r"[ \t\f\x0B\x{00A0}]+", " "), r"\n{3,}", "\n\n"))


@query("cell_text_norm", f"SELECT md5({_cell_sql('text')}) AS digest, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM {SAMPLE_SQL}) GROUP BY 1")
def cell_text_norm(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "conversations").select("text")).unionByName(samples(spark).select("text"))
    return t.groupBy(F.md5(T.cell_text(F.col("text"))).alias("digest")).agg(F.count("*").alias("n"))


_LINES = "string_split(" + SUB("text", r"\r\n?", "\n") + ", chr(10))"


@query("ocr_layout_norm", f"SELECT doc_id, {TRIM(SUB('array_to_string(list_transform(' + _LINES + ', lambda s: ' + TRIM(SUB('s', '[ ' + chr(92) + 't]+', ' ')) + '), chr(10))', chr(92) + 'n{3,}', chr(10) + chr(10)))} AS text FROM documents")
def ocr_layout_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.layout_text(F.col("text")).alias("text"))


_SEPARATOR = r"^\s*[-\x{2010}-\x{2015}_=*.]{3,}\s*$"


@query("preserve_symbols", f"SELECT doc_id, {TRIM(SUB('array_to_string(list_transform(' + _LINES + ', lambda s: CASE WHEN ' + HAS('s', _SEPARATOR) + ' THEN ' + TRIM('s') + ' ELSE ' + SUB('s', '[ ' + chr(92) + 't]+$', '') + ' END), chr(10))', chr(92) + 'n{4,}', chr(10) * 3))} AS text FROM documents")
def preserve_symbols(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preserve_symbols(F.col("text")).alias("text"))


_THAI_ROWS = [(1, "กํ่่า"), (2, "เเก"), (3, "ก\u200bข\ufeff"), (4, "café"), (5, "cafe\u0301"), (6, "น้้ำ"), (7, "นํ้า"), (8, "นํา"), (9, None)]


@query(
    "thai_unicode_norm",
    "SELECT id, " + "".join(f"regexp_replace(" for _ in "่้๊๋์ํ") + SUB("nfc_normalize(coalesce(text, ''))", r"[\x{200B}-\x{200D}\x{FEFF}]", "") + "".join(f", '{m}+', '{m}', 'g')" for m in "่้๊๋์ํ") + f" AS text FROM {values(_THAI_ROWS, 'id, text')}",
)
def thai_unicode_norm(spark, sf_dir):
    return spark.createDataFrame(_THAI_ROWS, "id int, text string").select("id", T.thai_unicode(F.col("text")).alias("text"))


@query("grapheme_counts", f"SELECT id, length_grapheme(text) AS n FROM {values([r for r in _THAI_ROWS if r[1]], 'id, text')}")
def grapheme_counts(spark, sf_dir):
    t = spark.createDataFrame(_THAI_ROWS, "id int, text string").where("text IS NOT NULL")
    return t.select("id", F.size(T.graphemes(F.col("text"))).cast("long").alias("n"))


@query("page_stats", f"SELECT conv_id, turn, length(text) AS n_chars, CASE WHEN {TRIM('text')} = '' THEN 0 ELSE len(regexp_split_to_array({TRIM('text')}, '\\s+')) END AS n_words FROM conversations")
def page_stats(spark, sf_dir):
    """Code points and words of every page; a conversation's turns stand for pages."""
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"), T.word_count(F.col("text")).cast("long").alias("n_words"))


@query("find_matches", "SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'the ', '')))::BIGINT // 4 AS n FROM documents WHERE contains(lower(text), 'the ')")
def find_matches(spark, sf_dir):
    n = T.matches_of(F.col("text"), "the ")
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n")).where("n > 0")


_FORMS = [(1, "Name: Ada Lovelace\nDate....: 1843\nno field here\nคำนำหน้า : นาง\nTotal ______ 12"), (2, "x: 1\nA label that is very long indeed and goes on well past the sixty signs allowed: v\nKey:"), (3, "a.b.. c\nPhone.... 02 123")]
_FIELD = r"^(.{2,60}?)\s*(?::|\.{2,}|_{2,})\s*(.+)$"


@query("form_fields", f"SELECT id, i AS line, {TRIM(f'regexp_extract(s, {duck(_FIELD)}, 1)')} AS key, {TRIM(f'regexp_extract(s, {duck(_FIELD)}, 2)')} AS value FROM (SELECT id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {values(_FORMS, 'id, text')}) WHERE {HAS('s', _FIELD)} QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) <= 80")
def form_fields(spark, sf_dir):
    """Lines of the form key, colon or leaders, value: the first 80 of a text."""
    t = spark.createDataFrame(_FORMS, "id int, text string").select("id", F.posexplode(F.split("text", "\n")).alias("line", "s")).where(F.col("s").rlike(_FIELD))
    t = t.withColumn("no", F.row_number().over(Window.partitionBy("id").orderBy("line"))).where("no <= 80")
    part = lambda i: T.trim(F.regexp_extract("s", _FIELD, i))
    return t.select("id", F.col("line").cast("long").alias("line"), part(1).alias("key"), part(2).alias("value"))


def _escaped(x: str, quote: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", quote)):
        x = f"replace({x}, {duck(a)}, {duck(b)})"
    return x


@query("escapes", f"SELECT page_id, md5({_escaped('html', '&#39;')}) AS html, md5({_escaped('html', '&apos;')}) AS xml FROM pages")
def escapes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_escape(F.col("html"))).alias("html"), F.md5(T.xml_escape(F.col("html"))).alias("xml"))


_NAMES = [(1, "My report: final?.PDF"), (2, "---"), (3, "a/b\\c.tar.gz"), (4, "plain"), (5, "  x  y .Csv"), (6, "รายงาน 1.docx")]


@query("file_names", f"SELECT id, CASE WHEN t = '' THEN 'document' ELSE t END AS safe, CASE WHEN contains(name, '.') THEN lower(list_last(string_split(name, '.'))) ELSE '' END AS extension FROM (SELECT id, name, {SUB(SUB(SUB('name', '[' + chr(92) * 2 + '/:*?' + chr(34) + '<>|' + chr(92) + 'x00-' + chr(92) + 'x1F' + chr(92) + 's]+', '-'), '-+', '-'), '^-+|-+$', '')} AS t FROM {values(_NAMES, 'id, name')})")
def file_names(spark, sf_dir):
    return spark.createDataFrame(_NAMES, "id int, name string").select("id", T.safe_filename(F.col("name")).alias("safe"), T.extension(F.col("name")).alias("extension"))


@query("text_height", "SELECT doc_id, list_sum(list_transform(string_split(text, chr(10)), lambda s: greatest(1, ceil(length(s) / 84.0))))::BIGINT AS n_lines FROM documents")
def text_height(spark, sf_dir):
    """Lines that each text would take at 16 px on a page 760 px wide."""
    return table(spark, sf_dir, "documents").select("doc_id", (T.text_height(F.col("text"), 16.0, 760.0, 1.0) / 16).cast("long").alias("n_lines"))
