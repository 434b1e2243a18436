"""Queries stated once in SQL, spelled for Spark and for DuckDB.

Only what the two engines spell differently goes through a dialect: regular expressions, splitting, ordered string
aggregation, literals. Spark runs the text through Catalyst like any DataFrame; no Python runs for a row.
"""

from __future__ import annotations

from collections.abc import Callable

from folioflow.functions import patterns as P
from folioflow.plans.registry import query
from folioflow.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Duck:
    spark = False

    def s(self, text: str) -> str:
        """A string literal."""
        return "'" + text.replace("'", "''") + "'"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.s(pattern)})"

    def sub(self, x: str, pattern: str, new: str) -> str:
        return f"regexp_replace({x}, {self.s(pattern)}, {self.s(new)}, 'g')"

    def count(self, x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, {self.s(pattern)}))"

    def group(self, x: str, pattern: str, i: int) -> str:
        return f"regexp_extract({x}, {self.s(pattern)}, {i})"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.s(sep)})"

    def lines(self, source: str, cols: str, x: str = "text") -> str:
        """Rows of a text's lines: line (from 0) and s."""
        part = self.split(x, "\n")
        return f"(SELECT {cols}, CAST(generate_subscripts({part}, 1) - 1 AS INT) AS line, unnest({part}) AS s FROM {source})"

    def agg(self, x: str, sep: str, order: str) -> str:
        return f"string_agg({x}, {self.s(sep)} ORDER BY {order})"

    def numbers(self, n: str) -> str:
        return f"range({n})"

    def each(self, items: str) -> str:
        """One row for each of some literals."""
        return f"unnest([{items}])"

    def date(self, x: str) -> str:
        return f"strftime({x}, '%d/%m/%Y')"

    def str(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def sorted_at(self, x: str, i: str, filter_: str = "") -> str:
        """Element number i (from 0) of a group's values in order."""
        return f"list_sort(list({x}))[CAST({i} AS BIGINT) + 1]"

    def if_(self, cond: str) -> str:
        return f"count(*) FILTER (WHERE {cond})"

    def div(self, a: str, b: str) -> str:
        return f"({a}) / nullif({b}, 0)"

    def levenshtein(self, a: str, b: str) -> str:
        return f"levenshtein({a}, {b})"

    def trim(self, x: str) -> str:
        return self.sub(x, P.TRIM, "")

    def ignore_nulls(self, f: str, x: str) -> str:
        return f"{f}({x} IGNORE NULLS)"


class Spark(Duck):
    spark = True

    def s(self, text: str) -> str:
        if "'" in text and '"' in text:
            return "concat(" + ", ".join("r'" + p + "'" if p != "'" else '"\'"' for p in _pieces(text)) + ")"
        return f'r"{text}"' if "'" in text else f"r'{text}'"

    def has(self, x: str, pattern: str) -> str:
        return f"({x}) RLIKE {self.s(pattern)}"

    def sub(self, x: str, pattern: str, new: str) -> str:
        return f"regexp_replace({x}, {self.s(pattern)}, {self.s(new)})"

    def trim(self, x: str) -> str:
        return f"btrim({x}, {self.s(P.BLANKS)})"

    def count(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, {self.s(pattern)})"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.s(chr(92) + 'Q' + sep + chr(92) + 'E')})"

    def lines(self, source: str, cols: str, x: str = "text") -> str:
        return f"(SELECT {cols}, posexplode({self.split(x, chr(10))}) AS (line, s) FROM {source})"

    def agg(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, {self.s(sep)}) WITHIN GROUP (ORDER BY {order})"

    def each(self, items: str) -> str:
        return f"explode(array({items}))"

    def date(self, x: str) -> str:
        return f"date_format({x}, 'dd/MM/yyyy')"

    def str(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def sorted_at(self, x: str, i: str, filter_: str = "") -> str:
        return f"sort_array(collect_list({x}))[CAST({i} AS INT)]"

    def if_(self, cond: str) -> str:
        return f"count_if({cond})"

    def div(self, a: str, b: str) -> str:
        return f"try_divide({a}, {b})"

    def ignore_nulls(self, f: str, x: str) -> str:
        return f"{f}({x}) IGNORE NULLS"


def _pieces(text: str) -> list[str]:
    out: list[str] = []
    for i, p in enumerate(text.split("'")):
        if i:
            out.append("'")
        if p:
            out.append(p)
    return out


def both(name: str, checked: bool = True) -> Callable:
    """Register ``f(dialect) -> SQL`` as a query, with the same statement for DuckDB as its check."""

    def add(f):
        def run(spark, sf_dir):
            text = f(Spark())
            for t in TABLES:
                if t in text:
                    table(spark, sf_dir, t).createOrReplaceTempView(t)
            return spark.sql(text)

        run.__name__, run.__doc__ = name, f.__doc__
        query(name, f(Duck()) if checked else None)(run)
        return f

    return add


def values(d: Duck, rows: list[tuple], names: str, alias: str = "fx") -> str:
    """A relation of literals."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, int):
            return str(v)
        return _text(d, v)

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS {alias}({names}))"


def _text(d: Duck, v: str) -> str:
    """A literal with line ends and tabs, which raw strings hold too."""
    return d.s(v)
