"""Files of many formats to a DataFrame of blocks; what can't be read goes to a DataFrame of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.batches import mapped
from folioflow.sources.parsers import PARSERS, ParseError, parse, xlsx_cell_styles

CELL = "struct<row int, column int, row_span int, column_span int, text string, hidden boolean>"
BLOCKS = f"path string, page_no int, page_name string, page_width double, page_height double, block_no int, type string, role string, text string, x double, y double, width double, height double, overflow boolean, src string, rows int, columns int, cells array<{CELL}>, style map<string,string>, spans array<struct<text string, style map<string,string>>>, content binary, error string"
#: Files larger than this are refused.
LIMIT = 50 << 20


def supported(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*PARSERS)


def _style(x: dict | None) -> list | None:
    return None if x is None else [(k, str(v)) for k, v in x.items()]


def _row(path: str, page_no: int | None, page: dict, block_no: int | None, b: dict, error: str | None) -> tuple:
    num = lambda k: None if b.get(k) is None else float(b[k])
    whole = lambda k: int(b[k]) if isinstance(b.get(k), float) and b[k].is_integer() else b.get(k)
    spans = None if b.get("spans") is None else [{"text": x.get("text"), "style": _style(x.get("style"))} for x in b["spans"]]
    return (
        path, page_no, page.get("name"), page.get("width"), page.get("height"), block_no, b.get("type"), b.get("role"), b.get("text"), num("x"), num("y"), num("width"), num("height"), bool(b.get("overflow", False)),
        b.get("src"), whole("rows"), whole("columns"), b.get("cells"), _style(b.get("style")), spans, b.get("content"), error,
    )


def _parse(f):
    for path, content in zip(f["path"], f["content"], strict=True):
        try:
            pages = parse(bytes(content), path)
        except ParseError as e:
            yield _row(path, None, {}, None, {}, str(e))
            continue
        for i, page in enumerate(pages, 1):
            for k, b in enumerate(page["blocks"]):
                yield _row(path, i, page, k, b, None)


def parse_contents(files: DataFrame) -> DataFrame:
    """(path, content) to blocks; a file that can't be read is one row with its error."""
    return mapped(files.select("path", "content"), _parse, BLOCKS)


def read(spark: SparkSession, path: str, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Blocks of all supported files under a path, and (path, reason) of those refused or unreadable.

    Size and ending are looked at before the content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fine = supported(F.col("path")) & (F.col("length") <= limit)
    parsed = parse_contents(files.where(fine))
    refused = files.where(~fine).select("path", F.when(F.col("length") > limit, "too_large").otherwise("unsupported").alias("reason"))
    return parsed.where("error IS NULL").drop("error"), refused.unionByName(parsed.where("error IS NOT NULL").select("path", F.col("error").alias("reason")))


def cell_styles(files: DataFrame) -> DataFrame:
    """(path, content) of workbooks to (path, sheet, row, column, style) of their cells."""

    def run(f):
        for path, content in zip(f["path"], f["content"], strict=True):
            for x in xlsx_cell_styles(bytes(content)):
                yield path, x["sheet"], x["row"], x["column"], _style(x["style"])

    return mapped(files.select("path", "content"), run, "path string, sheet string, row int, column int, style map<string,string>")
