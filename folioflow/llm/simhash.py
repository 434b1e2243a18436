"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within distance 2 share a variant within distance 1 of both. Every distinct fingerprint emits its 65
variants; those with a variant in common are verified. At most 65 fingerprints can meet on one variant, whatever
the data, since only the 65 around it emit it: no group is unbounded.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from folioflow.llm.components import components
from folioflow.llm.windows import buffers
from folioflow.session import cut, parts

RADIUS = 2
SHINGLE = 3
SEED = 42

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the shingles of one text; a bit is set if it is in over half the shingle hashes."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    h = np.fromiter((xxh64_intdigest(x, seed) for x in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(((counts * 2 > len(h)).astype(np.uint64) << _SHIFTS).sum())


def _fingerprints(carry: list[str]):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            fp = np.fromiter((fingerprint(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(batch.num_rows)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(fp.view(np.int64))], [*carry, "fp"])

    return run


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and fp (the fingerprint as a signed long) of each row; null texts have fingerprint 0."""
    carry = list(carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return docs.select(*carry, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_fingerprints(carry), f"{kinds}, fp long")


def _meet(batches):
    """(variant, fp) sorted by variant to the pairs of fingerprints on one variant that are near, each once."""
    variant, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in chain(batches, [None]):
        if batch is not None:
            variant = np.concatenate([variant, batch.column("variant").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy()])
            last = int(np.searchsorted(variant, variant[-1], "left")) if len(variant) else 0
        else:
            last = len(variant)
        v, f = variant[:last], fp[:last]
        variant, fp = variant[last:], fp[last:]
        for d in range(1, len(v)):
            at = np.flatnonzero(v[d:] == v[:-d])
            if not len(at):
                break
            a, b = f[at], f[at + d]
            x = a ^ b
            near = np.bitwise_count(x.view(np.uint64)) <= RADIUS
            a, b, x, here = a[near], b[near], x[near], v[at][near]
            low = x & -x
            # Two fingerprints meet on two variants; the lesser one has the pair.
            once = here == np.minimum(a ^ low, b ^ low)
            a, b = a[once], b[once]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])


def near_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs ``(u, v)``, u < v, of distinct fingerprints (column fp) that differ in 1 or 2 bits.

    Fingerprints are dealt out before they multiply; variants are shuffled once, as two numbers each.
    """
    n = parts(distinct.sparkSession)
    flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {i})") for i in range(64)])
    balls = distinct.select("fp").repartition(n, "fp").select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    return balls.repartition(n, "variant").sortWithinPartitions("variant").mapInArrow(_meet, "u long, v long")


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of ``docs`` linked where their fingerprints differ in 2 or fewer bits.

    Returns the ``carry`` columns, which must hold an integer ``doc_id``, with fp, n_near (rows linked directly, not counting
    the row itself), component_id (least doc_id reachable through links, the row's own included) and root (least
    fingerprint reachable, one for each group, whatever its numbers). Equal
    fingerprints are one class: links between classes are found once and weighted by their sizes, so copies cost no
    pairs. Null, empty and blank texts have fingerprint 0 and are linked like any others. Repeated rows count as
    documents of their own; a null doc_id is no component's least one unless it has no other. An empty table gives no
    rows. Columns besides text and ``carry`` are ignored, whatever their names.
    """
    rows = cut(fingerprints(docs, carry), "simhash")
    classes = cut(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least")), "simhash-classes")
    pairs = cut(near_pairs(classes.select("fp")), "simhash-pairs")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(classes.select(F.col("fp").alias("v"), "size"), "v").groupBy(F.col("u").alias("fp")).agg(F.sum("size").alias("others"))
    roots = components(pairs).withColumnRenamed("vertex", "fp")
    classes = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    info = classes.join(near, "fp", "left").join(least, "root").select("fp", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "component_id", "root")
    return rows.join(info, "fp").select(*[F.col(c) for c in carry], "fp", "n_near", "component_id", "root")
