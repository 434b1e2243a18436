"""Golden cases of rules, parsers, edits, kernels and streams."""

import io
import zipfile

import numpy as np
import pandas as pd
import pytest

from folioflow.operators import folds, model
from folioflow.providers import images
from folioflow.providers.recognise import fake_provider, recognise
from folioflow.sources import files, parsers, sinks
from folioflow.streaming import progress


def test_delimited():
    assert parsers.parse_delimited('a;b\n1;"x;y"\n') == [["a", "b"], ["1", "x;y"]]
    assert parsers.parse_delimited('﻿a,b,c\r\n1,"say ""hi""\nthere"\r\n') == [["a", "b", "c"], ["1", 'say "hi"\nthere', ""]]
    assert parsers.parse_delimited("") == [[""]]
    assert parsers.parse_delimited("a\tb,c") == [["a", "b,c"]] or parsers.parse_delimited("a\tb,c") == [["a\tb", "c"]]
    rows = [["x", 'q"', "a,b", "l\nm", ""], ["1", "2", "3", "4", "5"]]
    assert parsers.parse_delimited(sinks.delimited(rows)) == rows


def test_rtf():
    u = chr(92) + "u"
    source = r"{\rtf1\ansi{\*\generator x;}Hello\tab w\'f6rld\par " + u + "3585?" + u + "3634? end}"
    assert parsers.rtf_text(source) == "Hello\t w\u00f6rld\n \u0e01\u0e32 end"


def test_html():
    page = "<body><h2>Title</h2><p>One<p>Two<table><tr><td rowspan=2>a<td>b</tr><tr><td>c</td></tr></table><img src=x.png alt=pic width=100><footer>end</footer></body>"
    blocks = parsers.html_pages(page.encode(), "x.html")[0]["blocks"]
    assert [(b["type"], b["role"], b["text"]) for b in blocks] == [("text", "heading", "Title"), ("text", "paragraph", "One"), ("text", "paragraph", "Two"), ("table", "table", ""), ("image", "image", "pic"), ("footer", "footer", "end")]
    table = blocks[3]
    assert (table["rows"], table["columns"]) == (2, 2) and [(c["row"], c["column"], c["row_span"], c["text"]) for c in table["cells"]] == [(0, 0, 2, "a"), (0, 1, 1, "b"), (1, 1, 1, "c")]


def test_long_paragraphs_are_kept():
    pages = parsers.text_pages(("line\n" * 100).encode() + b"\nlast", "a.txt")
    assert sum(b["overflow"] for p in pages for b in p["blocks"]) == 1 and pages[-1]["blocks"][-1]["text"] == "last"
    assert not any(b["overflow"] for p in parsers.text_pages(("line\n" * 100).encode(), "a.txt", strict=True) for b in p["blocks"])


TABLE = {"type": "table", "role": "table", "text": "", "x": 0, "y": 50, "width": 300, "height": 90, "rows": 3, "columns": 3, "cells": [
    parsers.cell(0, 0, "head", 1, 2), parsers.cell(0, 2, "x|y"), parsers.cell(1, 0, "down", 2, 1), parsers.cell(1, 1, "b<&>"), parsers.cell(1, 2, ""), parsers.cell(2, 1, "c"), parsers.cell(2, 2, "d"),
]}
TEXT = {"type": "text", "role": "heading", "text": "สวัสดี & hi", "x": 0, "y": 0, "width": 300, "height": 40}


def test_docx_and_xlsx_are_read_back():
    page = parsers.parse(sinks.docx([[TEXT, TABLE]]), "a.docx")[0]
    assert page["blocks"][0]["text"] == TEXT["text"] and page["blocks"][0]["role"] == "heading"
    got = {(c["row"], c["column"]): (c["row_span"], c["column_span"], c["text"]) for c in page["blocks"][1]["cells"]}
    assert got == {(c["row"], c["column"]): (c["row_span"], c["column_span"], c["text"]) for c in TABLE["cells"]}
    sheet = parsers.parse(sinks.xlsx([[TABLE]]), "a.xlsx")[0]["blocks"][1]
    shown = {(c["row"], c["column"]): (c["row_span"], c["column_span"], c["text"]) for c in sheet["cells"] if not c["hidden"]}
    assert {k: v for k, v in shown.items() if v[2]} == {k: v for k, v in got.items() if v[2]}
    assert sinks.docx([[TEXT]]) == sinks.docx([[TEXT]])


def test_plain_repeats_spans_and_markdown_does_not():
    assert sinks.plain([[TEXT, TABLE]]).split("\n\n")[1].split("\n")[:2] == ["head\thead\tx|y", "down\tb<&>\t"]
    assert sinks.markdown([[TABLE]]).split("\n")[:3] == ["| head |  | x\\|y |", "| --- | --- | --- |", "| down | b<&> |  |"]


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_slides_and_open_documents():
    a = 'xmlns:a="a" xmlns:p="p" xmlns:r="r"'
    slide = f'<p:sld {a}><p:sp><p:spPr><a:xfrm><a:off x="95250" y="190500"/><a:ext cx="952500" cy="476250"/></a:xfrm></p:spPr><a:p><a:r><a:t>Hi</a:t></a:r></a:p></p:sp><p:cxnSp/></p:sld>'
    pages = parsers.parse(_zip({"ppt/presentation.xml": f'<p:presentation {a}><p:sldSz cx="9525000" cy="4762500"/></p:presentation>', "ppt/slides/slide10.xml": slide, "ppt/slides/slide2.xml": slide}), "x.pptx")
    assert len(pages) == 2 and (pages[0]["width"], pages[0]["height"]) == (1000, 500)
    assert [(b["type"], b["x"], b["y"], b["width"], b["height"]) for b in pages[0]["blocks"]] == [("text", 10, 20, 100, 50), ("line", 0, 0, 160, 60)]
    ns = 'xmlns:o="o" xmlns:t="t" xmlns:x="x"'
    sheet = f'<o:doc {ns}><o:spreadsheet><t:table t:name="S"><t:table-row><t:table-cell t:number-columns-repeated="2"><x:p>v</x:p></t:table-cell><t:table-cell/></t:table-row></t:table></o:spreadsheet></o:doc>'
    assert sinks.matrix(parsers.parse(_zip({"content.xml": sheet}), "a.ods")[0]["blocks"][1]) == [["v", "v", ""]]
    text = f"<o:doc {ns}><x:p>one</x:p><x:h>head</x:h></o:doc>"
    assert [b["text"] for b in parsers.parse(_zip({"content.xml": text}), "a.odt")[0]["blocks"]] == ["head", "one"]


def test_unreadable_files_are_errors(spark, tmp_path):
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "fine.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "other.bin").write_bytes(b"x")
    (tmp_path / "big.txt").write_bytes(b"x" * 500)
    blocks, errors = files.read(spark, str(tmp_path), limit=400)
    assert {r.path.rsplit("/", 1)[-1] for r in blocks.collect()} == {"fine.csv"}
    assert {r.path.rsplit("/", 1)[-1]: r.reason.split(":")[0] for r in errors.collect()} == {"bad.docx": "File is not a zip file", "other.bin": "unsupported", "big.txt": "too_large"}


def cells(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "tbl long, row int, col int, row_span int, col_span int, text string, hidden boolean")


def grid(df):
    return sorted((r.row, r.col, r.row_span, r.col_span, r.text, r.hidden) for r in df.collect())


def test_merge_and_split(spark):
    t = cells(spark, [(r, c, 1, 1, f"{r}{c}", False) for r in range(2) for c in range(3)])
    merged = model.merge(t, 0, 0, 1, 0)
    assert grid(merged)[0] == (0, 0, 2, 1, "00\n10", False) and (1, 0, 1, 1, "", True) in grid(merged)
    assert grid(model.split(merged)) == [(0, 0, 1, 1, "00\n10", False), (0, 1, 1, 1, "01", False), (0, 2, 1, 1, "02", False), (1, 0, 1, 1, "", False), (1, 1, 1, 1, "11", False), (1, 2, 1, 1, "12", False)]
    longer = model.insert_row(merged, 1)
    assert (0, 0, 3, 1, "00\n10", False) in grid(longer)
    assert model.validate(merged, model.sizes(merged)).count() == 0
    assert grid(model.delete_row(cells(spark, [(0, 0, 1, 1, "only", False)]), 0)) == [(0, 0, 1, 1, "only", False)]


def test_reading_order(spark):
    rows = [(1, 1, "paragraph", 100.0, 300.0, 40.0), (1, 2, "title", 105.0, 10.0, 40.0), (1, 3, "paragraph", 300.0, 0.0, 40.0)]
    got = folds.reading_order(spark.createDataFrame(rows, "page long, id long, type string, top double, lft double, height double")).orderBy("no").collect()
    assert [r.id for r in got] == [2, 1, 3]


def test_pdf_text(spark):
    rows = [(1, 1, 0.0, 700.0, 30.0, 10.0, "Hello"), (1, 2, 34.0, 700.5, 30.0, 10.0, "world"), (1, 3, 64.2, 700.0, 3.0, 10.0, "!"), (1, 4, 0.0, 660.0, 30.0, 10.0, "Next")]
    got = folds.pdf_lines(spark.createDataFrame(rows, "page long, id long, x double, y double, w double, h double, text string")).first()
    assert got.text == "Hello world!\n\nNext"


def test_kernels():
    g = np.full((60, 90), 250, np.uint8)
    for y in (5, 30, 55):
        g[y, 5:86] = 10
    for x in (5, 45, 85):
        g[5:56, x] = 10
    dark = images.binary(g)
    rows, cols = images.grid_lines(dark)
    assert (rows, cols) == ([5, 30, 55], [5, 45, 85]) and images.table_score(rows, cols, 60, 90) > 0.58
    assert images.merged_cells(dark, rows, cols) == [(r, c, 1, 1) for r in range(2) for c in range(2)]
    g[7:29, 45] = 250
    assert images.merged_cells(images.binary(g), rows, cols)[0] == (0, 0, 1, 2)
    assert 10 <= images.otsu(g) < 250 and images.otsu(np.full((4, 4), 9, np.uint8)) == 160
    assert images.cluster(np.array([1, 2, 3, 20, 21]), 3) == [2, 21]
    assert images.longest_run(np.array([1, 1, 0, 1, 1, 1], bool)) == 3 and images.longest_run(np.array([1, 1, 0, 1], bool), 1) == 4
    box = np.zeros((40, 40), bool)
    box[5:25, 5:25] = True
    box[6:24, 6:24] = False
    assert images.checkboxes(box) == [(5, 5, 20, 20, False)]
    box[10:20, 10:20] = True
    assert len(images.components(box)) == 2
    lines = np.full((100, 100), 255, np.uint8)
    lines[10::12] = 0
    assert images.deskew_angle(images.rotate(lines, 3)) == -3 and images.deskew_angle(lines) == 0
    brute = np.array([[lines[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].mean() for x in range(20)] for y in range(20)])
    assert np.allclose(images.box_mean(lines[:22, :22], 2)[:18, :18], brute[:18, :18])
    assert images.region_hash(["a", 1]) == images.region_hash(["a", 1]) != images.region_hash(["a", 2])


def test_recognition_gates_and_retries(spark):
    g = np.full((40, 30), 255, np.uint8)
    g[5:10, 5:10] = 0
    rows = [(1, "text", "eng", 40, 30, g.tobytes()), (2, "text", "eng", 40, 30, g.tobytes()), (3, "logo", "eng", 40, 30, g.tobytes())]
    got = {r.region_id: r for r in recognise(spark.createDataFrame(rows, "region_id long, region_type string, language string, height int, width int, image binary"), fake_provider).collect()}
    assert got[1].text == got[2].text == "1 marks" and got[1].n_attempts == 4 and got[3].status == "confirmed_non_text"


def test_breaker():
    state, seen = ("closed", 0, 0.0), []
    for now, failed in ((0, True), (1, True), (2, True), (3, False), (40_000, True), (40_001, False), (80_000, False)):
        name, n, opened, allowed = progress.step(*state, failed, now)
        state = (name, n, opened)
        seen.append((name, allowed))
    assert seen == [("closed", True), ("closed", True), ("open", True), ("open", False), ("open", True), ("open", False), ("closed", True)]


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 20")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = progress.breaker(stream).writeStream.format("memory").queryName("breaker").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    key = lambda r: (r.event_id, r.state, r.failures, r.allowed)
    assert sorted(map(key, spark.table("breaker").collect())) == sorted(map(key, progress.breaker(events).collect()))
    q = progress.deduped(stream, ("user_id",), "365 days").writeStream.format("memory").queryName("deduped").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    assert spark.table("deduped").count() == progress.deduped(events, ("user_id",)).count()
    for f in (progress.sessions, progress.windowed):
        q = f(stream, late="1 second").writeStream.format("memory").queryName(f.__name__).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
        assert sorted(r.n_events for r in spark.table(f.__name__).collect()) == sorted(r.n_events for r in f(events).collect())


def test_segments_join_back(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=3, deadline=None)
    @given(st.lists(st.text(max_size=40), min_size=1, max_size=30))
    def check(texts):
        from pyspark.sql import functions as F

        from folioflow.functions import text as T

        texts = [t.encode("utf-8", "ignore").decode() for t in texts]
        got = spark.createDataFrame(pd.DataFrame({"i": range(len(texts)), "t": texts})).select("i", F.array_join(T.tokens(F.col("t")), "").alias("x"), T.cell_text(T.cell_text(F.col("t"))).alias("a"), T.cell_text(F.col("t")).alias("b"))
        for r in got.collect():
            assert r.x == texts[r.i] and r.a == r.b

    check()
