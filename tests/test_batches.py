"""Python works on a few rows at a time, whatever the size of the batches."""

import pyarrow as pa

from folioflow.sources import batches, files, sinks


def test_pieces_are_small():
    b = pa.RecordBatch.from_pydict({"k": list(range(1000)), "x": [b"a" * (5000 if i == 700 else 10) for i in range(1000)]})
    found = list(batches.pieces(b, 64, 4000))
    assert [k for p in found for k in p["k"].to_pylist()] == list(range(1000))
    assert all(p.num_rows <= 64 and (p.nbytes <= 4000 or p.num_rows == 1) for p in found)


def test_results_leave_while_rows_come():
    """No more rows are asked for than fill a batch."""
    asked = []

    def rows():
        for i in range(1000):
            asked.append(i)
            yield i, "x" * 100

    out = batches.filled(rows(), pa.schema([("k", pa.int64()), ("x", pa.string())]), 300, 5000)
    first = next(out)
    assert len(asked) == first.num_rows < 50
    assert [k for b in [first, *out] for k in b["k"].to_pylist()] == list(range(1000))




def test_readers_and_writers_use_small_batches(spark, monkeypatch):
    """Frames that reach the parser and the writer hold no more rows than the bound, though a batch has thousands."""
    seen = spark.sparkContext.accumulator(0)

    def look(f):
        seen.add(1)
        assert len(f) <= batches.ROWS
        return zip(f["path"], f["text"])

    t = spark.range(3000).coalesce(1).selectExpr("concat(id, '.txt') AS path", "encode('a\n\nb', 'utf-8') AS content")
    assert batches.mapped(t.selectExpr("path", "decode(content, 'utf-8') AS text"), look, "path string, text string").count() == 3000
    assert seen.value >= 3000 // batches.ROWS
    blocks = files.parse_contents(t)
    assert blocks.count() == 6000
    back = sinks.export(blocks.drop("error"), "txt")
    assert {bytes(r["content"]) for r in back.select("content").distinct().collect()} == {b"a\n\nb"}


def _whole_batches(spark, name):
    """Whether a Python stage of a query takes its batches whole."""
    from folioflow.plans import registry

    return "MapInPandas" in registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_docx_styles_takes_pieces(spark):
    assert not _whole_batches(spark, "docx_styles")


def test_docx_placed_takes_pieces(spark):
    assert not _whole_batches(spark, "docx_placed")


def test_docx_images_takes_pieces(spark):
    assert not _whole_batches(spark, "docx_images")


def test_docx_tables_takes_pieces(spark):
    assert not _whole_batches(spark, "docx_tables")


def test_html_blocks_takes_pieces(spark):
    assert not _whole_batches(spark, "html_blocks")


def test_image_archives_takes_pieces(spark):
    assert not _whole_batches(spark, "image_archives")
