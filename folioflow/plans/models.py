"""Queries that edit tables, fold pages, read and write files, and roll documents up."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import folds, model
from folioflow.plans.dialect import both
from folioflow.plans.registry import query
from folioflow.session import table
from folioflow.sources import files, parsers, sinks

#: Every six parts are a table of three columns; each fifth cell spans two columns and hides its neighbour.
_CELLS_SQL = """(SELECT tbl, CAST(n // 3 AS INT) AS "row", CAST(n % 3 AS INT) AS col, 1 AS row_span, CASE WHEN tbl % 5 = 0 AND n = 0 THEN 2 ELSE 1 END AS col_span, text, tbl % 5 = 0 AND n = 1 AS hidden FROM (SELECT p_partkey // 6 AS tbl, p_partkey % 6 AS n, p_name AS text FROM part WHERE p_partkey % 11 <> 0))"""
_SIZES_SQL = f"""(SELECT tbl, max("row" + row_span) AS n_rows, max(col + col_span) AS n_cols FROM {_CELLS_SQL} AS z GROUP BY tbl)"""


def cells(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey % 11 <> 0").selectExpr("p_partkey div 6 AS tbl", "p_partkey % 6 AS n", "p_name AS text")
    return p.selectExpr("tbl", "CAST(n div 3 AS INT) AS row", "CAST(n % 3 AS INT) AS col", "1 AS row_span", "IF(tbl % 5 = 0 AND n = 0, 2, 1) AS col_span", "text", "tbl % 5 = 0 AND n = 1 AS hidden")


def _fill(cells_sql: str, sizes_sql: str) -> str:
    grid = f"(SELECT tbl, r, unnest(range(n_cols)) AS c FROM (SELECT tbl, n_cols, unnest(range(n_rows)) AS r FROM {sizes_sql} AS s) AS s2)"
    covered = f"""(SELECT tbl, r, unnest(range(col, col + col_span)) AS c FROM (SELECT tbl, col, col_span, unnest(range("row", "row" + row_span)) AS r FROM {cells_sql} AS a) AS b)"""
    return f"""SELECT tbl, "row", col, row_span, col_span, text, hidden FROM {cells_sql} AS u UNION ALL SELECT tbl, CAST(r AS INT), CAST(c AS INT), 1, 1, '', false FROM {grid} AS g WHERE NOT EXISTS (SELECT 1 FROM {covered} AS k WHERE k.tbl = g.tbl AND k.r = g.r AND k.c = g.c)"""


@query("table_normalise", _fill(_CELLS_SQL, _SIZES_SQL))
def table_normalise(spark, sf_dir):
    return model.normalise(cells(spark, sf_dir))


def _moved(pos: str, span: str, at: int) -> str:
    rest = [c for c in ("tbl", '"row"', "col", "row_span", "col_span", "text", "hidden") if c not in (pos, span)]
    return f"(SELECT {', '.join(rest)}, CASE WHEN {pos} >= {at} THEN {pos} + 1 ELSE {pos} END AS {pos}, CASE WHEN {pos} < {at} AND {pos} + {span} > {at} THEN {span} + 1 ELSE {span} END AS {span} FROM {_CELLS_SQL} AS m)"


@query("table_insert_row", _fill(_moved('"row"', "row_span", 1), f"(SELECT tbl, n_rows + 1 AS n_rows, n_cols FROM {_SIZES_SQL} AS q)"))
def table_insert_row(spark, sf_dir):
    return model.insert_row(cells(spark, sf_dir), 1)


@query("table_insert_column", _fill(_moved("col", "col_span", 1), f"(SELECT tbl, n_rows, n_cols + 1 AS n_cols FROM {_SIZES_SQL} AS q)"))
def table_insert_column(spark, sf_dir):
    return model.insert_column(cells(spark, sf_dir), 1)


def _cut(pos: str, span: str, n: str, at: int) -> tuple[str, str]:
    rest = [c for c in ("tbl", '"row"', "col", "row_span", "col_span", "text", "hidden") if c not in (pos, span)]
    joined = f"(SELECT m.*, least({at}, {n} - 1) AS k, {n} <= 1 AS one FROM {_CELLS_SQL} AS m JOIN {_SIZES_SQL} AS z ON z.tbl = m.tbl)"
    kept = f"(SELECT {', '.join(rest)}, CASE WHEN NOT one AND {pos} > k THEN {pos} - 1 ELSE {pos} END AS {pos}, CASE WHEN NOT one AND {pos} <= k AND {pos} + {span} > k THEN greatest(1, {span} - 1) ELSE {span} END AS {span} FROM {joined} AS j WHERE one OR NOT ({pos} = k AND {span} = 1))"
    other = "n_cols" if n == "n_rows" else "n_rows"
    return kept, f"(SELECT tbl, greatest(1, {n} - 1) AS {n}, {other} FROM {_SIZES_SQL} AS q)"


@query("table_delete_row", _fill(*_cut('"row"', "row_span", "n_rows", 1)))
def table_delete_row(spark, sf_dir):
    return model.delete_row(cells(spark, sf_dir), 1)


@query("table_delete_column", _fill(*_cut("col", "col_span", "n_cols", 0)))
def table_delete_column(spark, sf_dir):
    return model.delete_column(cells(spark, sf_dir), 0)


_MERGED = f"""(SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, "row", col) AS no, string_agg(CASE WHEN inside AND text <> '' THEN text END, chr(10)) OVER (PARTITION BY tbl ORDER BY "row", col ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS joined
  FROM (SELECT *, NOT hidden AND "row" <= 1 AND "row" + row_span > 0 AND col <= 1 AND col + col_span > 0 AS inside FROM {_CELLS_SQL} AS a) AS b)"""


@query(
    "table_merge",
    f"""SELECT tbl, CASE WHEN inside AND no = 1 THEN 0 ELSE "row" END AS "row", CASE WHEN inside AND no = 1 THEN 0 ELSE col END AS col, CASE WHEN inside AND no = 1 THEN 2 ELSE row_span END AS row_span, CASE WHEN inside AND no = 1 THEN 2 ELSE col_span END AS col_span,
    CASE WHEN inside AND no = 1 THEN coalesce(joined, '') WHEN inside THEN '' ELSE text END AS text, hidden OR (inside AND no > 1) AS hidden FROM {_MERGED} AS c""",
)
def table_merge(spark, sf_dir):
    return model.merge(cells(spark, sf_dir), 0, 0, 1, 1)


@query(
    "table_split",
    f"""WITH x AS (SELECT * FROM {_CELLS_SQL} AS a), freed AS (SELECT tbl, "row", col + 1 AS col FROM x WHERE col_span = 2 AND NOT hidden)
    SELECT x.tbl, x."row", x.col, 1 AS row_span, 1 AS col_span, x.text, x.hidden AND f.tbl IS NULL AS hidden FROM x LEFT JOIN freed AS f ON f.tbl = x.tbl AND f."row" = x."row" AND f.col = x.col
    UNION ALL SELECT f.tbl, f."row", f.col, 1, 1, '', false FROM freed AS f WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.tbl = f.tbl AND x."row" = f."row" AND x.col = f.col)""",
)
def table_split(spark, sf_dir):
    return model.split(cells(spark, sf_dir))


@query(
    "model_validate",
    f"""WITH x AS (SELECT tbl, "row", col, row_span, CASE WHEN tbl % 7 = 0 THEN col_span - 1 ELSE col_span + CAST(tbl % 2 AS INT) END AS col_span, hidden FROM {_CELLS_SQL} AS a), s AS (SELECT * FROM {_SIZES_SQL} AS q)
    SELECT x.tbl, x."row", x.col, 'outside_table' AS code FROM x JOIN s ON s.tbl = x.tbl WHERE x."row" + x.row_span > n_rows OR x.col + x.col_span > n_cols UNION ALL SELECT tbl, "row", col, 'span_below_one' FROM x WHERE col_span < 1
    UNION ALL SELECT tbl, "row", CAST(c AS INT), 'slot_covered_twice' FROM (SELECT tbl, "row", unnest(range(col, col + col_span)) AS c FROM x WHERE NOT hidden AND col_span >= 1) AS k GROUP BY tbl, "row", c HAVING count(*) > 1""",
)
def model_validate(spark, sf_dir):
    """Violations in tables whose spans have been made wrong."""
    c = cells(spark, sf_dir)
    bad = c.withColumn("col_span", F.expr("IF(tbl % 7 = 0, col_span - 1, col_span + CAST(tbl % 2 AS INT))"))
    return model.validate(bad, model.sizes(c))


def _boxes(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey div 24 AS page", "p_partkey AS id", "p_name AS text", "double(p_partkey * 53 % 200) AS x", "double(p_partkey * 29 % 90) AS y", "double(20 + p_partkey % 50) AS w", "double(8 + p_partkey % 9) AS h")


@query("reading_order")
def reading_order(spark, sf_dir):
    kinds = F.array(*map(F.lit, folds.PRIORITY))
    return folds.reading_order(_boxes(spark, sf_dir).select("page", "id", kinds[(F.col("id") % 10).cast("int")].alias("type"), F.col("y").alias("top"), F.col("x").alias("lft"), F.col("h").alias("height")))


@query("word_lines")
def word_lines(spark, sf_dir):
    return folds.word_lines(_boxes(spark, sf_dir))


@query("merged_boxes")
def merged_boxes(spark, sf_dir):
    return folds.merged_boxes(_boxes(spark, sf_dir).drop("text"))


@query("pdf_lines")
def pdf_lines(spark, sf_dir):
    return folds.pdf_lines(_boxes(spark, sf_dir))


@query("cover_groups")
def cover_groups(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["title", "person_name", "paragraph"]))
    return folds.cover_groups(_boxes(spark, sf_dir).select("page", "id", kinds[(F.col("id") % 3).cast("int")].alias("type"), "text", F.expr("id % 10 / 10e0").alias("confidence"), F.col("y").alias("top"), F.col("x").alias("lft"), F.col("h").alias("height")))


@query("html_blocks")
def html_blocks(spark, sf_dir):
    """Blocks of every web page."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "utf-8").alias("content"))
    return files.parse_contents(pages).select("path", "page_no", "block_no", "type", "role", "text", "rows", "columns")


@query("flow_pages")
def flow_pages(spark, sf_dir):
    """Every document as a text file, laid out on pages."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content"))
    return files.parse_contents(docs).groupBy("path").agg(F.max("page_no").alias("n_pages"), F.count("*").alias("n_blocks"), F.count_if("overflow").alias("n_overflow"), F.sum(F.length("text")).alias("n_chars"))


@query("csv_auto", "SELECT CAST(o_custkey AS VARCHAR) || '.csv' AS path, count(*)::INT + 1 AS \"rows\", 3 AS columns, sum(length(o_orderpriority))::BIGINT AS n_chars FROM orders GROUP BY o_custkey")
def csv_auto(spark, sf_dir):
    """Each customer's orders written as delimited text, semicolons in one half, and read again."""
    sep = F.when(F.col("o_custkey") % 2 == 0, ",").otherwise(";")
    line = F.concat(F.col("o_orderkey").cast("string"), sep, F.lit('"a, ""b""; c"'), sep, F.col("o_orderpriority"))
    head = F.when(F.col("o_custkey") % 2 == 0, "key,note,priority\r\n").otherwise("key;note;priority\r\n")
    text = F.concat(head, F.array_join(F.collect_list("line"), "\r\n"), F.lit("\r\n"))
    made = table(spark, sf_dir, "orders").select("o_custkey", line.alias("line")).groupBy("o_custkey").agg(F.encode(text, "utf-8").alias("content"))
    blocks = files.parse_contents(made.select(F.concat(F.col("o_custkey").cast("string"), F.lit(".csv")).alias("path"), "content")).where("type = 'table'")
    chars = F.aggregate(F.filter("cells", lambda c: (c["row"] > 0) & (c["column"] == 2)), F.lit(0), lambda a, c: a + F.length(c["text"]))
    return blocks.select("path", "rows", "columns", chars.cast("long").alias("n_chars"))


def _conversation_blocks(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.selectExpr(
        "concat(conv_id, '.docx') AS path", "1 AS page_no", "CAST(turn AS INT) AS block_no", "'text' AS type", "IF(role = 'user', 'heading', 'paragraph') AS role", "text", "0d AS x", "double(turn) AS y", "100d AS width", "20d AS height", "CAST(NULL AS STRING) AS src",
        "CAST(NULL AS INT) AS rows", "CAST(NULL AS INT) AS columns", f"CAST(NULL AS ARRAY<{files.CELL}>) AS cells",
    )


@query("docx_roundtrip", "SELECT conv_id || '.docx' AS path, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines, sum(length(replace(text, chr(10), '')))::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def docx_roundtrip(spark, sf_dir):
    """Conversations written as DOCX and read again: a paragraph to a line."""
    made = sinks.export(_conversation_blocks(spark, sf_dir), "docx")
    return files.parse_contents(made).groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query("plain_text_export", "SELECT conv_id || '.docx' AS path, string_agg(CASE WHEN text <> '' THEN text END, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def plain_text_export(spark, sf_dir):
    return sinks.export(_conversation_blocks(spark, sf_dir), "txt").select("path", F.decode("content", "utf-8").alias("text"))


@both("document_rollup")
def document_rollup(d):
    """Each conversation's text and confidence: the mean over its pages with text, else nothing."""
    conf = "(turn * 7 + conv_id) % 10 / 10e0"
    return f"SELECT conv_id, count(*) AS n_pages, round(coalesce(avg(CASE WHEN {d.trim('text')} <> '' THEN {conf} END), 0e0), 6) AS confidence, {d.agg('text', chr(10) * 2, 'turn')} AS full_text FROM conversations GROUP BY conv_id"


@both("page_sections")
def page_sections(d):
    """Pages under numbered rules, renumbered from 1 in the order kept."""
    rows = "(SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations WHERE role <> 'system')"
    return f"SELECT conv_id, {d.agg(chr(39) + '===== page ' + chr(39) + ' || ' + d.str('no') + ' || ' + chr(39) + ' =====' + chr(39) + ' || chr(10) || text', chr(10) * 2, 'no')} AS text FROM {rows} AS r GROUP BY conv_id"


@both("confidence_by_source")
def confidence_by_source(d):
    return f"SELECT source, {d.if_('toxic = 1')} AS n_flagged, round(avg(quality * 1e0), 6) AS quality, count(*) AS n FROM documents AS a JOIN labels AS b ON b.doc_id = a.doc_id GROUP BY source"


@both("text_metrics")
def text_metrics(d):
    """Character error rate of items against copies with each e made x."""
    made = "replace(text, 'e', 'x')"
    return f"SELECT item_id, round(levenshtein({made}, text) * 1e0 / greatest(1, length(text)), 6) AS cer, {d.count('text', chr(92) + 'S+')} AS n_words FROM benchmark"
