"""Text rules as column expressions: normalising, tokenising, classifying. Nothing here leaves the JVM but NFC."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.functions import patterns as P


def trim(x: Column) -> Column:
    """Without white space, no-break spaces and byte-order marks at both ends."""
    return F.btrim(x, F.lit(P.BLANKS))


def like(x: Column, pattern: str) -> Column:
    return x.rlike(pattern)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within the bounds; null and NaN are 0."""
    return F.least(F.greatest(F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(low)), F.lit(high))


def tokens(x: Column) -> Column:
    """Tokens that joined give the text back: white space, addresses, codes, Thai runs, words, numbers, single signs."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(P.TOKEN), F.lit(0))


def is_code(x: Column) -> Column:
    return like(x, P.CODE) & like(x, P.CODE_SIGN)


def token_type(x: Column) -> Column:
    t = trim(F.coalesce(x, F.lit("")))
    thai, latin = like(t, f"[{P.THAI}]"), like(t, "[A-Za-z]")
    return (
        F.when(t == "", "space")
        .when(like(t, P.EMAIL), "email")
        .when(like(t, P.URL), "url")
        .when(like(t, P.PHONE), "phone")
        .when(is_code(t), "document_code")
        .when(thai & latin, "mixed_th_en")
        .when(thai, "thai")
        .when(latin, "english")
        .when(like(t, f"[{P.DIGIT}]"), "number")
        .when(like(t, P.PUNCTUATION), "punctuation")
        .otherwise("unknown")
    )


def strict_kind(x: Column) -> Column:
    """Kind of a value that must be kept character by character; null if it is none."""
    t = trim(F.coalesce(x, F.lit("")))
    return (
        F.when(like(t, P.EMAIL), "email").when(like(t, P.URL), "url").when(like(t, P.PHONE), "phone").when(is_code(t), "document_code").when(like(t, P.PATH), "file_path").when(like(t, P.VERSION), "version")
    )


def ascii_digits(x: Column) -> Column:
    return F.translate(x, "๐๑๒๓๔๕๖๗๘๙", "0123456789")


def strict_valid(x: Column, kind: str) -> Column:
    return like(ascii_digits(trim(F.coalesce(x, F.lit("")))), P.STRICT.get(kind, P.STRICT["number"]))


def strict_number(x: Column, kind: str) -> Column:
    """STRUCT raw, digits, valid, ambiguous, status of a value as a number of some kind."""
    raw = trim(F.coalesce(x, F.lit("")))
    valid, ambiguous = strict_valid(x, kind), like(raw, P.AMBIGUOUS)
    status = F.when(ambiguous, "manual_review_required").when(valid, "verified").otherwise("review_recommended")
    return F.struct(raw.alias("raw"), ascii_digits(raw).alias("digits"), valid.alias("valid"), ambiguous.alias("ambiguous"), status.alias("status"))


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Unicode normalisation form C, which Spark has no function for."""
    return x.str.normalize("NFC")


def drop_zero_width(x: Column) -> Column:
    return F.regexp_replace(x, r"[\x{200B}-\x{200D}\x{FEFF}]", "")


def dedupe_marks(x: Column) -> Column:
    return F.regexp_replace(x, r"([\x{0E48}-\x{0E4D}&&[^\x{0E47}]])\1+", "$1")


def thai_unicode(x: Column) -> Column:
    """NFC, without zero-width characters and repeated tone marks."""
    return dedupe_marks(drop_zero_width(nfc(F.coalesce(x, F.lit("")))))


def compose_sara_am(x: Column) -> Column:
    return F.replace(x, F.lit("ํา"), F.lit("ำ"))


def cell_text(x: Column) -> Column:
    """One kind of line end, single blanks, at most one empty line, trimmed."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\f\x0B\x{00A0}]+", " "), r"\n{3,}", "\n\n")
    return trim(t)


def _lines(x: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n?", "\n"), "\n")


def layout_text(x: Column) -> Column:
    """Lines with single blanks and no blanks at their ends, at most one empty line between, trimmed."""
    lines = F.transform(_lines(x), lambda s: trim(F.regexp_replace(s, r"[ \t]+", " ")))
    return trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def preserve_symbols(x: Column) -> Column:
    """Lines without blanks at their ends; separator lines without any around them; at most two empty lines; trimmed."""
    separator = r"^\s*[-\x{2010}-\x{2015}_=*.]{3,}\s*$"
    lines = F.transform(_lines(x), lambda s: F.when(s.rlike(separator), trim(s)).otherwise(F.regexp_replace(s, r"[ \t]+$", "")))
    return trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{4,}", "\n\n\n"))


def clean_text(x: Column) -> Column:
    return trim(F.regexp_replace(drop_zero_width(nfc(F.coalesce(x, F.lit("")))), r"[ \t]+", " "))


def graphemes(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\X"), F.lit(0))


def script_switches(x: Column) -> Column:
    """How often the script changes between Thai, Latin and digits, other signs left out."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), f"[{P.DIGIT}]+", "\x01")
    t = F.regexp_replace(F.regexp_replace(t, f"[{P.THAI}]+", "\x02"), "[A-Za-z]+", "\x03")
    t = F.regexp_replace(t, r"[^\x01-\x03]+", "")
    for c in "\x01\x02\x03":
        t = F.regexp_replace(t, c + "+", c)
    return F.greatest(F.length(t) - 1, F.lit(0))


def script_runs(x: Column) -> Column:
    """Runs of Thai, Latin, digits and other signs."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(f"[{P.DIGIT}]+|[{P.THAI}]+|[A-Za-z]+|[^{P.THAI}0-9A-Za-z\\s]+"), F.lit(0))


def thai_share(x: Column) -> Column:
    """Share of Thai among letters and digits; 0 if there are none."""
    n = F.regexp_count(x, F.lit(f"[{P.THAI}]"))
    return F.coalesce(F.try_divide(n, F.regexp_count(x, F.lit(f"[{P.THAI}A-Za-z0-9]"))), F.lit(0.0))


def word_count(x: Column) -> Column:
    t = trim(F.coalesce(x, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def text_height(x: Column, size: float, width: float, line: float = 1.35) -> Column:
    """Height that a text is estimated to take: its lines, wrapped at the width, times the line height."""
    per = max(1, int(width // max(6.0, size * 0.56)))
    lines = F.aggregate(F.split(F.coalesce(x, F.lit("")), "\n"), F.lit(0), lambda a, s: a + F.greatest(F.lit(1), F.ceil(F.length(s) / per)).cast("int"))
    return lines * size * line


def matches_of(x: Column, query: str) -> Column:
    """How often a string occurs, without regard to case and without overlap."""
    return F.regexp_count(F.lower(x), F.lit(r"\Q" + query.lower() + r"\E"))


def xml_escape(x: Column) -> Column:
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def html_escape(x: Column) -> Column:
    t = F.coalesce(x, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def safe_filename(x: Column, fallback: str = "document") -> Column:
    t = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r'[\\/:*?"<>|\x00-\x1F\s]+', "-"), "-+", "-")
    t = F.regexp_replace(t, "^-+|-+$", "")
    return F.when(t == "", fallback).otherwise(t)


def extension(x: Column) -> Column:
    """Lower-case ending of a file name; empty without a dot."""
    return F.when(x.contains("."), F.lower(F.element_at(F.split(x, r"\."), -1))).otherwise("")
