"""Substring dedup over words by De Bruijn compaction.

Edges are windows of W words, kept as super-windows (stretches that share a minimiser), so an edge row stands for a
path inside one minimiser partition. Repeated edges are linked where they follow each other in a source text; links
whose two ends have no other neighbour compact, through a join with the degrees, into nonbranching paths. Where an
anchor has several contents, the source coordinates lead back to the words, and each window is verified by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.rlbwt import merge, representatives
from folioflow.llm.windows import buffers, mix, powers, prefix, repeated, text_key, word_symbols
from folioflow.session import cut, drop

__all__ = ["compact", "remove_repeats", "repeat_spans"]

WINDOW, GRAM = 35, 16


def compact(edges: DataFrame, length: int) -> DataFrame:
    """Occurrences of repeated edges ``(key, s, m, c)`` to traversals of nonbranching paths.

    Returns (key, b, e, path, n_edges): words ``[b, e)`` of the text that walk along ``path``, named by its first edge.
    """
    order = Window.partitionBy("key").orderBy("s")
    here = edges.dropDuplicates(["key", "s", "m", "c"])
    near = F.when(F.lead("s").over(order) == F.col("s") + F.col("m"), F.lead("c").over(order))
    back = F.when(F.lag("s").over(order) + F.lag("m").over(order) == F.col("s"), F.lag("c").over(order))
    here = here.select("key", "s", "m", "c", near.alias("after"), back.alias("before"))
    degree = here.groupBy("c").agg(
        F.coalesce(F.min("after") == F.max("after"), F.lit(False)).alias("one_out"),
        F.coalesce(F.min("before") == F.max("before"), F.lit(False)).alias("one_in"),
    )
    here = here.join(degree, "c")
    joined = F.col("before").isNotNull() & F.col("one_in") & F.lag("one_out").over(order)
    here = here.withColumn("path_no", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(order))
    return here.groupBy("key", "path_no").agg(
        F.min("s").alias("b"), (F.max(F.col("s") + F.col("m")) + (length - 1)).alias("e"), F.min_by("c", "s").alias("path"), F.count(F.lit(1)).alias("n_edges")
    ).drop("path_no")


def _window_hashes(length: int):
    """(text, key, reps) to a hash of every window of the representatives, once for each text."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            out, size = [], 0
            for i, (key, reps) in enumerate(zip(batch.column("key").to_pylist(), batch.column("reps").to_pylist(), strict=True)):
                if key in seen:
                    continue
                seen.add(key)
                symbols = word_symbols(data[offsets[i] : offsets[i + 1]], offsets[i : i + 2])[3]
                for r in reps:
                    s, m = r["s"], r["m"]
                    p = prefix(symbols[s : s + m - 1 + length])
                    out.append((np.full(m, key), s + np.arange(m), np.full(m, r["n"]), mix((p[length : length + m] - p[:m]) * powers()[1][:m])))
                    size += m
                if size > 1 << 17:
                    yield _hashes(out)
                    out, size = [], 0
            if out:
                yield _hashes(out)

    return run


def _hashes(out) -> pa.RecordBatch:
    key, s, n, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int64()), pa.array(h.view(np.int64))], ["key", "s", "n", "h"])


def repeat_spans(keyed: DataFrame, length: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Spans ``(key, spans array<struct<b, e>>)`` of words covered by windows of ``length`` words that repeat."""
    found = cut(repeated(keyed, True, length, gram, 2 * length - 1), "graph-edges")
    mixed = found.where("lo != hi")
    whole, reps = representatives(mixed)
    wanted = cut(reps.groupBy("key").agg(F.collect_list(F.struct("s", "m", "n")).alias("reps")), "graph-reps")
    whole = mixed.join(whole, ["a", "c"]).select("key", "s", "m", "c").unionByName(found.where("lo = hi").select("key", "s", "m", "c"))
    windows = cut(keyed.join(wanted, "key").mapInArrow(_window_hashes(length), "key long, s int, n long, h long").dropDuplicates(["key", "s"]), "graph-windows")
    drop(wanted)
    often = windows.groupBy("h").agg(F.sum("n").alias("t")).where("t > 1").select("h")
    verified = windows.join(often, "h").select("key", F.col("s").alias("b"), (F.col("s") + length).alias("e"))
    marks = compact(whole, length).select("key", "b", F.col("e").cast("int").alias("e")).unionByName(verified)
    return marks.groupBy("key").agg(F.collect_set(F.struct("b", "e")).alias("spans"))


def _remove(carry: list[str]):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            rows = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                gone = merge(spans)
                kept, at = [], 0
                for b, e in gone:
                    kept += words[at:b]
                    at = e
                left = b" ".join(kept + words[at:])
                rows.append((len(words), sum(e - b for b, e in gone), [{"b": b, "e": e} for b, e in gone], left.decode("utf-8"), hashlib.sha256(left).hexdigest()))
            n, removed, spans, left, sha = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            kind = pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))
            arrays = [batch.column(c) for c in carry] + [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(left, pa.string()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*carry, "n_words", "n_removed", "removed", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, length: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Remove each word covered by a window of ``length`` words that also starts anywhere else, in any document.

    Words are maximal runs without ASCII white space, unchanged. Returns for each row of ``docs`` its ``carry``
    columns, n_words, n_removed, removed (maximal runs ``[b, e)`` of removed words), kept (the remaining words joined
    by one space) and kept_sha256. Windows are judged on the input. Null and blank texts have no words; a text shorter
    than a window loses nothing. Repeated rows are documents of their own, so each makes the other a copy; windows
    that overlap in one text count as elsewhere too. Texts and windows are told apart by 64-bit hashes. An empty table
    gives no rows. Columns besides text and ``carry`` are ignored, whatever their names.
    """
    carry = list(carry)
    keyed = docs.select(*[F.col(c) for c in carry], F.coalesce("text", F.lit("")).alias("text"), text_key().alias("key"))
    spans = repeat_spans(keyed, length, gram)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return keyed.join(spans, "key", "left").mapInArrow(_remove(carry), f"{kinds}, n_words long, n_removed long, removed array<struct<b int, e int>>, kept string, kept_sha256 string")
