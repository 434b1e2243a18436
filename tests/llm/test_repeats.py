"""Operators 1 and 5 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import debruijn, rlbwt
from folioflow.llm.windows import sliding_min, word_symbols

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(sequences, width):
    """For each sequence which elements a repeated window covers."""
    counts = Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        hit = [False] * len(s)
        for i in range(len(s) - width + 1):
            if counts[tuple(s[i : i + width])] > 1:
                hit[i : i + width] = [True] * width
        out.append(hit)
    return out


@pytest.mark.parametrize("width, gram", [(35, 16), (9, 4)])
def test_words(docs, texts, width, gram):
    sequences = [WORD.findall(t or "") for _, t in texts]
    want = sorted(
        (str(i), len(s), sum(h), hashlib.sha256(" ".join(w for w, x in zip(s, h) if not x).encode()).hexdigest())
        for (i, _), s, h in zip(texts, sequences, covered(sequences, width))
    )
    rows = debruijn.remove_repeats(docs, width, gram).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows) == want
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in rows)
    assert sum(x[2] for x in want) > 1000


@pytest.mark.parametrize("hot", [1500, 2])
def test_bytes(docs, texts, hot):
    width = 60
    sequences = [(t or "").encode() for _, t in texts]
    want = []
    for (i, _), s, h in zip(texts, sequences, covered(sequences, width)):
        spans = sum(1 for k in range(len(s)) if h[k] and not (k and h[k - 1]))
        want.append((str(i), len(s), sum(h), spans, hashlib.sha256(bytes(b for b, x in zip(s, h) if not x)).hexdigest()))
    rows = rlbwt.remove_repeats(docs, width, 20, 1 << 14, hot).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in rows) == sorted(want)


def test_empty(no_docs):
    assert debruijn.remove_repeats(no_docs).count() == 0
    assert rlbwt.remove_repeats(no_docs).count() == 0


def test_index_statistics():
    rng = random.Random(1)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        x = rlbwt.RunLengthIndex(strings)
        got = x.matching_statistics()
        suffixes = {int(s) + k: t[k:] for s, t in zip(x.starts, strings) for k in range(len(t))}
        for p, a in suffixes.items():
            best = 0
            for q, b in suffixes.items():
                if p != q:
                    n = 0
                    while n < min(len(a), len(b)) and a[n] == b[n]:
                        n += 1
                    best = max(best, n)
            assert got[p] == best


def test_paths_compact(spark):
    rows = [(1, 0, 5, 10), (1, 5, 5, 11), (1, 10, 5, 12), (2, 3, 5, 10), (2, 8, 5, 11), (2, 13, 5, 13)]
    got = debruijn.compact(spark.createDataFrame(rows, "key long, s int, m int, c long"), 35).collect()
    assert sorted((r.key, r.b, r.e, r.path, r.n_edges) for r in got) == [(1, 0, 44, 10, 2), (1, 10, 49, 12, 1), (2, 3, 47, 10, 2), (2, 13, 52, 13, 1)]


def test_words_never_cross_texts():
    data = np.frombuffer(b"ab cdef gh", np.uint8)
    begin, end, before, _ = word_symbols(data, np.array([0, 5, 5, 10]))
    assert [data[b:e].tobytes() for b, e in zip(begin, end)] == [b"ab", b"cd", b"ef", b"gh"] and before.tolist() == [0, 2, 2, 4]


def test_sliding_min():
    v = np.array([5, 3, 8, 1, 9, 2, 7])
    for w in range(1, 8):
        assert sliding_min(v, w).tolist() == [min(v[i : i + w]) for i in range(len(v) - w + 1)]
