"""Embedding near-duplicates by lattice hashing.

Random projections of a unit vector, eight dimensions at a time, are decoded to points of the E8 lattice. A table's
cell is a pair of such points. Every vector stands in its home cell and in neighbouring cells, where one of the two
points is the next nearest; two vectors meet where one's home is any of the other's cells. Meetings are verified by
cosine in double precision. Several tables make a miss unlikely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.components import components
from folioflow.llm.windows import mix
from folioflow.session import cut, parts

COSINE, TABLES, SCALE, NEIGHBOURS, BLOCK = 0.98, 5, 4.0, 3, 2048


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8: integers with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    d = (x - r)[odd]
    k = np.abs(d).argmax(axis=1)
    r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def e8_near(x: np.ndarray, n: int) -> np.ndarray:
    """For each row the n nearest of its likely E8 lattice points, nearest first, doubled to integers.

    E8 is D8 and D8 moved by a half in every coordinate. Of both the nearest point is tried, and the points one gets by
    moving two of its three worst coordinates to the other side. The first is the exact nearest point of E8.
    """
    found = []
    at = np.arange(len(x))
    for half in (0.0, 0.5):
        y = x - half
        r = _d8(y)
        d = y - r
        worst = np.argsort(-np.abs(d), axis=1, kind="stable")
        step = np.where(d >= 0, 1, -1)
        found.append(r + half)
        for i, j in ((0, 1), (0, 2), (1, 2)):
            z = r.copy()
            for k in (worst[:, i], worst[:, j]):
                z[at, k] += step[at, k]
            found.append(z + half)
    found = np.stack(found, axis=1)
    order = np.argsort(((found - x[:, None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :n]
    return np.rint(2 * np.take_along_axis(found, order[:, :, None], axis=1)).astype(np.int64)


def _projections(dim: int, tables: int, seed: int):
    rng = np.random.default_rng([seed, dim])
    for _ in range(tables):
        for _ in range(2):
            q = np.linalg.qr(rng.normal(size=(dim, 8)))[0] if dim >= 8 else rng.normal(size=(dim, 8)) / max(dim, 1) ** 0.5
            yield q, rng.uniform(0, 1, 8)


_WEIGHTS = np.random.default_rng(99).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cells(unit: np.ndarray, tables: int = TABLES, scale: float = SCALE, near: int = NEIGHBOURS, seed: int = 0) -> np.ndarray:
    """Cells of unit vectors: for each table the home cell, then its neighbours; shape (vectors, tables * (2 * near - 1))."""
    n, dim = unit.shape
    out = []
    points = iter(_projections(dim, tables, seed))
    for t in range(tables):
        both = []
        for side in range(2):
            q, shift = next(points)
            p = e8_near(unit @ q * (scale * (dim / 64) ** 0.5) + shift, near)
            both.append(mix((p.astype(np.uint64) * _WEIGHTS).sum(axis=2) + np.uint64(2 * t + side)))
        a, b = both
        one = [a[:, 0] * np.uint64(3) + b[:, 0]]
        one += [a[:, k] * np.uint64(3) + b[:, 0] for k in range(1, near)] + [a[:, 0] * np.uint64(3) + b[:, k] for k in range(1, near)]
        out += [mix(x + np.uint64(dim)) for x in one]
    return np.stack(out, axis=1).view(np.int64).reshape(n, -1)


def _cells(tables: int, scale: float, near: int):
    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            dims = np.array([len(v) for v in vectors])
            out: list = [None] * len(vectors)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                v = np.array([vectors[i] for i in at], np.float64).reshape(len(at), dim)
                c = cells(v / np.linalg.norm(v, axis=1)[:, None], tables, scale, near)
                for i, row in zip(at, c, strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("cid", "label", "size", "least", "embedding")), pa.array(out, pa.list_(pa.int64()))], ["cid", "label", "size", "least", "embedding", "cells"])

    return run


def verify(vectors: np.ndarray, size: np.ndarray, codes: np.ndarray, here: int, slot: np.ndarray, block: np.ndarray, cross: bool, tables: int, cosine: float):
    """Links among the vectors of one work unit that no other unit finds: (weights linked to each, ends of a spanning forest).

    ``here`` is the unit's cell, ``slot`` where it stands among each vector's cells.
    """
    per = codes.shape[1] // tables
    table = int(slot[0]) // per
    home = slot % per == 0
    m = len(vectors)
    weight = np.zeros(m, np.int64)
    parent = list(range(m))
    tree: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    grid = codes.reshape(m, tables, per)
    for lo in range(0, m, 256):
        close = vectors[lo : lo + 256] @ vectors.T >= cosine
        i, j = np.nonzero(close)
        i += lo
        ok = (i < j) & (home[i] | home[j])
        if cross:
            ok &= block[i] != block[j]
        i, j = i[ok], j[ok]
        met = np.zeros(len(i), bool)
        for t in range(table + 1):
            a, b = grid[i, t], grid[j, t]
            to_b, to_a = (a[:, :1] == b).any(axis=1), (b[:, :1] == a).any(axis=1)
            if t < table:
                met |= to_b | to_a
            else:  # both homes are meetings: the lesser cell has the pair
                met |= to_b & to_a & (np.minimum(a[:, 0], b[:, 0]) != here)
        i, j = i[~met], j[~met]
        weight += np.bincount(i, weights=size[j], minlength=m).astype(np.int64) + np.bincount(j, weights=size[i], minlength=m).astype(np.int64)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[p] = q
                tree.append((x, y))
    return weight, tree


def _units(tables: int, cosine: float):
    def solve(rows):
        vectors = np.array([r[4] for r in rows], np.float64)
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
        cid, size = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        codes, slot, block = np.array([r[5] for r in rows], np.int64), np.array([r[6] for r in rows]), np.array([r[7] for r in rows])
        weight, tree = verify(vectors, size, codes, rows[0][8], slot, block, rows[0][9], tables, cosine)
        at = np.flatnonzero(weight)
        u = np.concatenate([cid[at], cid[[x for x, _ in tree]]]) if tree else cid[at]
        v = [None] * len(at) + cid[[y for _, y in tree]].tolist() if tree else [None] * len(at)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(weight[at].tolist() + [None] * len(tree), pa.int64())], ["u", "v", "add"])

    def run(batches):
        rows, now = [], None
        names = ("unit", "label", "cid", "size", "embedding", "cells", "slot", "block", "cell", "cross")
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                key = (r[0], r[1], len(r[4]), r[8])
                if key != now and rows:
                    if len(rows) > 1:
                        yield solve(rows)
                    rows = []
                now = key
                rows.append(r)
        if len(rows) > 1:
            yield solve(rows)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, scale: float = SCALE, near: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, embedding, label) linked where labels are equal and the cosine is at least ``cosine``.

    Returns vec_id, n_links (other rows linked directly), component_id (least vec_id reachable) and kept (vec_id is
    component_id). Equal vectors of a label are one class: they are linked, and compared once. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows without a label, link with nothing; vectors of
    different lengths neither. A null vec_id is the least of a component only if it has no other. Cells of any size
    are compared whole, in pairs of blocks of about ``block`` rows; only sums and a spanning forest leave a
    block. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    fine = F.expr("label IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("cid", F.when(F.col("fine"), F.xxhash64("label", "embedding")))
    classes = rows.where("fine").groupBy("cid").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    classes = classes.select("cid", "label", "size", "least", "embedding").mapInArrow(_cells(tables, scale, near), f"cid long, label {vectors.schema['label'].dataType.simpleString()}, size long, least long, embedding array<double>, cells array<long>")
    classes = cut(classes, "lattice-classes")
    stands = classes.select("cid", "label", F.posexplode("cells").alias("slot", "cell"))
    # A table may hold the same cell twice by chance of hashing; the first slot stands.
    stands = stands.groupBy("cid", "label", "cell").agg(F.min("slot").alias("slot"))
    per = 2 * near - 1
    busy = stands.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("slot") % per).alias("nearest")).where("n > 1 AND nearest = 0")
    busy = busy.select("label", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    stands = stands.join(busy, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("cid", "cell"), F.col("blocks")).cast("int"))
    stands = stands.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    stands = stands.select("cid", "cell", "slot", "block", (F.col("block") != F.col("other")).alias("off"), F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"))
    stands = stands.select("cid", "cell", "slot", "block", (F.col("b0") != F.col("b1")).alias("cross"), F.xxhash64("cell", "b0", "b1").alias("unit"))
    work = stands.join(classes.select("cid", "label", "size", "embedding", "cells"), "cid").repartition(parts(spark), "unit").sortWithinPartitions("unit", "label", F.size("embedding"), "cell")
    found = cut(work.select("unit", "label", "cid", "size", "embedding", "cells", "slot", "block", "cell", "cross").mapInArrow(_units(tables, cosine), "u long, v long, add long"), "lattice-links")
    more = found.where("v IS NULL").groupBy(F.col("u").alias("cid")).agg(F.sum("add").alias("more"))
    roots = components(found.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("vertex", "cid")
    info = classes.select("cid", "size", "least").join(more, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = info.groupBy("root").agg(F.min("least").alias("component_id"))
    info = info.join(least, "root").select("cid", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(info, "cid", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("cid").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
