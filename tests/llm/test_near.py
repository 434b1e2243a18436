"""Operators 7 and 9 and the components they use, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from folioflow.llm import lattice, simhash
from folioflow.llm.components import components


class Sets(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        self[self.root(a)] = self.root(b)


def bits(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, texts):
    fps = [bits(t) for _, t in texts]
    near = [[j for j in range(len(fps)) if j != i and (fps[i] ^ fps[j]).bit_count() <= 2] for i in range(len(fps))]
    sets = Sets()
    for i, js in enumerate(near):
        sets.root(i)
        for j in js:
            sets.join(i, j)
    least: dict = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[sets.root(i)] = min(least.get(sets.root(i), d), d)
    want = Counter((d, fps[i], len(near[i]), least.get(sets.root(i))) for i, (d, _) in enumerate(texts))
    rows = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.n_near, r.component_id) for r in rows) == want


def test_every_link_within_two_bits(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(6):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {(r.u, r.v) for r in simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 180)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)] + [(7, 900 + i) for i in range(30)] + [(5, 5)]
    sets = Sets()
    for a, b in links:
        if a != b:
            sets.join(a, b)
    groups: dict = {}
    for x in list(sets):
        groups.setdefault(sets.root(x), []).append(x)
    want = {x: min(g) for g in groups.values() for x in g}
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.vertex: r.root for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [512, 4])
def test_embeddings(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        v = rng.normal(size=16)
        rows.append((i, v.tolist(), i % 3))
    for i in range(60, 110):  # clusters of near copies
        v = np.array(rows[i % 4][1]) + rng.normal(size=16) * 0.08
        rows.append((i, v.tolist(), int(rows[i % 4][2])))
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [nan] + [1.0] * 15, 1), (203, [inf] + [1.0] * 15, 1), (204, [], 1), (205, [None] + [1.0] * 15, 1), (206, rows[0][1], None), (207, [1.0, 2.0], 1), (208, [2.0, 4.0], 1)]
    rows += [(5, rows[5][1], rows[5][2]), (None, rows[6][1], rows[6][2])]

    def fine(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    linked = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (_, a, p), (_, b, q) = rows[i], rows[j]
            if fine(a, p) and fine(b, q) and p == q and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                linked[i].append(j)
                linked[j].append(i)
    sets = Sets()
    for i, js in enumerate(linked):
        sets.root(i)
        for j in js:
            sets.join(i, j)
    least: dict = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[sets.root(i)] = min(least.get(sets.root(i), d), d)
    want = Counter((d, len(linked[i]), least.get(sets.root(i)), d == least.get(sets.root(i))) for i, (d, *_) in enumerate(rows))
    table = spark.createDataFrame([(a, b, c, 1, "x") for a, b, c in rows], "vec_id long, embedding array<float>, label int, cid int, cells string")
    # Single precision moves nothing across the threshold here.
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(table, block=block).collect())
    assert got == want
    assert lattice.near_duplicates(table.limit(0)).count() == 0


def test_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    first = lattice.e8_near(x, 3)[:, 0] / 2
    whole = np.all(first == np.rint(first), axis=1) | np.all(first - 0.5 == np.rint(first - 0.5), axis=1)
    assert whole.all() and np.all(np.isclose(first.sum(axis=1) % 2, 0) | np.isclose(first.sum(axis=1) % 2, 2))
    assert ((x - first) ** 2).sum(axis=1).max() <= 1 + 1e-9  # covering radius of E8
