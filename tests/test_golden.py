"""Values that were fixed beforehand, not computed here: each rule on cases whose outcome is known, in both engines."""

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.functions import patterns as P
from folioflow.functions import sequences
from folioflow.functions import text as T
from folioflow.operators import folds
from folioflow.plans import regions, tables
from folioflow.plans.dialect import Duck, Spark, values
from folioflow.sources import sinks


@pytest.fixture(params=["spark", "duckdb"])
def run(request, spark):
    """Rows of ``f(dialect) -> SQL`` as tuples, in one of the engines."""
    if request.param == "spark":
        return lambda f: [tuple(r) for r in spark.sql(f(Spark())).collect()]
    return lambda f: duckdb.connect().execute(f(Duck())).fetchall()


def test_languages(run):
    cases = [("paragraph", "วรรณคดีโบราณ", "tha"), ("isbn", "ISBN 978-616-407-087-5", "number"), ("barcode", "", "barcode"), ("publisher_info", "จุฬาลงกรณ์ University", "tha+eng"), ("person_name", "John", "tha"), ("unknown", "John", "eng"), ("unknown", "12", "tha")]
    got = run(lambda d: f"SELECT kind, text, {regions.language(d, 'kind', 'text')} FROM {values(d, [c[:2] for c in cases], 'kind, text')} AS v")
    assert set(got) == set(cases)


def test_block_types(run):
    cases = [
        ("วรรณคดีโบราณ", 30 / 1200, 70 / 1200, "title"), ("1. วัตถุประสงค์", 300 / 1200, 30 / 1200, "numbered_list"),
        ("ข้อความยาวที่เป็นย่อหน้าและมีรายละเอียดจำนวนมากเพื่อให้ระบบจำแนกเป็นย่อหน้าหลักของเอกสาร.", 400 / 1200, 45 / 1200, "paragraph"), ("ศูนย์หนังสือแห่งจุฬาลงกรณ์มหาวิทยาลัย", 1.0, 0.0, "publisher_info"),
        ("เลขที่ 254 ถนนพญาไท แขวงวังใหม่ เขตปทุมวัน กรุงเทพมหานคร", 1.0, 0.0, "address"), ("โทร. 02-218-9893", 1.0, 0.0, "phone"), ("ISBN 978-616-407-087-5", 1.0, 0.0, "isbn"), ("ราคา 200 บาท", 1.0, 0.0, "price"), ("02-939-7755", 1.0, 0.0, "phone"),
    ]
    got = run(lambda d: f"SELECT t, {regions.block_type(d, 't')} FROM (SELECT *, {regions.protected(d, 't')} AS p FROM {values(d, [c[:3] for c in cases], 't, y, h')} AS v) AS w")
    assert dict(got) == {c[0]: c[3] for c in cases}


def test_column_types(run):
    rows = [(1, 0, 0, "จำนวนเงิน"), (1, 0, 1, "1,250.00"), (1, 0, 2, "500.00"), (1, 1, 0, ""), (1, 1, 1, "a@example.com"), (1, 1, 2, "b@example.com"), (1, 1, 3, "c@example.com")]
    got = run(lambda d: f"SELECT c, column_type FROM {tables.column_types_of(d, values(d, rows, 'id, c, r, text'), 'id')} AS t")
    assert dict(got) == {0: "currency", 1: "email"}


def test_strict_numbers(run):
    cases = [("1,250.00", "currency"), ("(1,200.00)", "currency"), ("7.5%", "percentage"), ("11/07/2569", "date")]
    for text, kind in cases:
        assert run(lambda d: f"SELECT {d.has(d.s(text), P.STRICT[kind])}") == [(True,)]  # noqa: B023
    assert run(lambda d: f"SELECT {d.has(d.s('O8.30'), P.AMBIGUOUS)}") == [(True,)]


#: What a region is like, in the order of the features, and what the review makes of it.
REGIONS = [
    ("verified", "main_title", dict(region_confidence=0.94, ocr_confidence=0.95, baseline=0.88, components=0.82, glyph_alignment=0.8, height_consistency=0.76, spacing=0.72, glyphs=14, candidates=1, thai_script=0.96, contrast=0.7, width=420, height=44)),
    ("possible_text", "main_title", dict(region_confidence=0.31, ocr_confidence=0.28, baseline=0.34, components=0.28, glyph_alignment=0.32, glyphs=4, candidates=1, decorative=True, contrast=0.34, width=360, height=55)),
    ("possible_text", "organization_name", dict(region_confidence=0.27, ocr_confidence=0.24, baseline=0.30, components=0.26, glyphs=3, candidates=1, small=True, contrast=0.24, width=300, height=18)),
    ("likely_non_text", "school_name", dict(region_confidence=0.08, baseline=0.08, components=0.08, object_score=0.65, texture=0.6, color_variance=0.5)),
    ("confirmed_non_text", "top_illustration", dict(region_confidence=0.02, baseline=0.02, components=0.02, object_score=0.92, texture=0.88, color_variance=0.75, photo=0.9)),
]


def test_review_first(run):
    middle = {"top_illustration": 0.1, "main_title": 0.3, "organization_name": 0.85, "school_name": 0.75}
    names = [*regions.FEATURES, "glyphs", "candidates", "width", "height", "top", "page_height", "decorative", "small", "confirmed_non_text"]
    rows = []
    for i, (_, zone, said) in enumerate(REGIONS):
        full = {n: 0.0 for n in regions.FEATURES} | {"glyphs": 0, "candidates": 0, "width": 0, "height": 0, "page_height": 1000.0, "decorative": False, "small": False, "confirmed_non_text": False} | said
        full["top"] = middle[zone] * 1000 - full["height"] / 2
        rows.append((i, *(float(full[n]) if n in regions.FEATURES or n in ("width", "height") else full[n] for n in names)))
    got = run(lambda d: f"SELECT id, zone, status FROM {regions.review_first(d, values(d, rows, ', '.join(['id', *names])))} AS r")
    assert sorted(got) == [(i, zone, status) for i, (status, zone, _) in enumerate(REGIONS)]


def test_tokens(spark):
    cases = [("support@example.com", "email"), ("https://example.com/a?id=1", "url"), ("INC-2569-001", "document_code"), ("Windows", "english")]
    rows = spark.createDataFrame(cases, "token string, kind string").select("kind", T.token_type(F.col("token")).alias("got")).collect()
    assert all(r.kind == r.got for r in rows)


def test_delimited_text():
    text = sinks.delimited([["ชื่อ", "", "หมายเหตุ"], ["นายทดสอบ", "00125", "บรรทัด 1\nบรรทัด 2"]])
    assert ord(text[0]) == 0xFEFF and "ชื่อ,,หมายเหตุ" in text and '"บรรทัด 1\nบรรทัด 2"' in text


def test_error_rates(spark):
    m = spark.createDataFrame([("สำนักงาน", "สำนักงาบ")], "a string, b string").select(sequences.text_metrics(F.col("a"), F.col("b")).alias("m")).first().m
    assert m.cer > 0 and m.wer > 0 and m.grapheme_error > 0
    assert sequences.distance(list("kitten"), list("sitting")) == 3 and sequences.distance([], list("ab")) == 2 and sequences.distance(list("ab"), []) == 2


def test_order_of_reading(spark):
    rows = [(1, "b", "paragraph", 200.0, 30.0, 30.0), (1, "a2", "title", 20.0, 300.0, 40.0), (1, "a1", "title", 20.0, 20.0, 40.0)]
    number = {"b": 1, "a2": 2, "a1": 3}
    got = folds.reading_order(spark.createDataFrame([(p, number[i], *r) for p, i, *r in rows], "page long, id long, type string, top double, lft double, height double")).orderBy("no").collect()
    assert [r.id for r in got] == [number[i] for i in ("a1", "a2", "b")]
