"""Repeated fixed-length windows of symbol sequences, found by minimiser-partitioned super-windows.

A *window* is W consecutive symbols (bytes or words) of one text. Each window picks an *anchor*: of the
k-symbol grams inside it, the one with the least hash. Equal windows pick equal anchors at equal places, so
windows that repeat share an anchor. Consecutive windows with the same anchor form one *super-window*
``(key, s, m, a, c)``: text key, first window start, number of windows, anchor hash, hash of all the symbols
covered and of where the anchor lies in them.

The anchors thin the corpus to about 2/(W-k+2) rows a symbol. Super-windows whose anchor occurs once hold no
repeat; those with an equal ``c`` repeat as a whole; only the mixed rest needs a look at its symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
TOP = 1 << BITS
#: Symbols handled at a time; a longer text is cut into overlapping pieces, so no window is lost.
PIECE = 1 << 18

_B = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240601)
BYTE_SYMBOL = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_tables: dict = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _tables:
        n = TOP + 1
        for name, b in (("pow", _B), ("inv", pow(_B, -1, 1 << 64))):
            x = np.full(n, np.uint64(b))
            x[0] = 1
            _tables[name] = np.multiply.accumulate(x)
    return _tables["pow"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


def prefix(symbols: np.ndarray) -> np.ndarray:
    """P with hash(i, j) = (P[j] - P[i]) * inv[i]."""
    p = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers()[0][: len(symbols)], out=p[1:])
    return p


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    width = 1
    while width * 2 <= w:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (w - width)], v[w - width :]) if width < w else v


def super_windows(symbols: np.ndarray, ends: np.ndarray, w: int, k: int):
    """Super-windows of texts that lie one after the other in ``symbols``; text i ends before ``ends[i]``.

    Returns (text, first start within the text, windows, anchor hash, content hash), each an array.
    """
    n = len(symbols)
    starts = np.concatenate(([0], ends[:-1]))
    lengths = ends - starts
    if n < w or not (lengths >= w).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    inv = powers()[1]
    p = prefix(symbols)
    g = (p[k:] - p[:-k]) * inv[: n - k + 1]
    v = mix(g)
    v = (v & ~np.uint64(TOP - 1)) | np.arange(len(v), dtype=np.uint64)
    at = (sliding_min(v, w - k + 1) & np.uint64(TOP - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.maximum(lengths - w + 1, 0))
    ok = np.arange(len(text)) + np.repeat(starts - np.concatenate(([0], np.cumsum(np.maximum(lengths - w + 1, 0))[:-1])), np.maximum(lengths - w + 1, 0))
    a = at[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    m = np.diff(np.append(first, len(ok)))
    s, anchor = ok[first], a[first]
    c = mix(((p[s + m - 1 + w] - p[s]) * inv[s]) ^ mix((m.astype(np.uint64) << np.uint64(32)) + (anchor - s).astype(np.uint64)))
    return text[first], s - starts[text[first]], m, g[anchor].view(np.int64), c.view(np.int64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each text begins; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def groups(offsets: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``piece`` bytes together; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + piece, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True


#: Bytes that are no ASCII letter or digit and no part of a longer character.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the accented capitals of Latin-1 in lower case."""
    x = _lower[data]
    accent = np.flatnonzero(x[:-1] == 0xC3) + 1
    accent = accent[(x[accent] >= 0x80) & (x[accent] <= 0x9E) & (x[accent] != 0x97)]
    x[accent] += 32
    return x


def word_symbols(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _space):
    """Words of texts that lie one after the other: (word begins, word ends, words before each text, hash of each word)."""
    begin, end, symbol = [], [], []
    inner = offsets[1:-1] - offsets[0]
    at = 0
    n = len(data)
    while at < n:
        to = min(n, at + PIECE)
        if to < n:  # cut after white space, else where the word ends
            gap = np.flatnonzero(space[data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:
                gap = np.flatnonzero(space[data[to:]])
                to = to + int(gap[0]) + 1 if len(gap) else n
        x = data[at:to]
        word = np.zeros(len(x) + 2, np.int8)
        word[1:-1] = ~space[x]
        d = np.diff(word)
        b, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        cuts = inner[(inner > at) & (inner < to)] - at
        if len(cuts):  # a word never crosses from one text to the next
            cuts = np.unique(cuts)
            i = np.searchsorted(b, cuts, "left") - 1
            inside = (i >= 0) & (cuts < e[i]) & (cuts > b[i])
            b, e = np.sort(np.append(b, cuts[inside])), np.sort(np.append(e, cuts[inside]))
        symbol.append(word_hashes(x, b, e))
        begin.append(b + at)
        end.append(e + at)
        at = to
    if not begin:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64), z.astype(np.uint64)
    begin, end, symbol = np.concatenate(begin), np.concatenate(end), np.concatenate(symbol)
    return begin, end, np.searchsorted(begin, offsets - offsets[0], "left"), symbol


def word_hashes(x: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
    out = []
    if len(x) <= TOP:
        p = prefix(BYTE_SYMBOL[x])
        return mix(((p[e] - p[b]) * powers()[1][b]) + (e - b).astype(np.uint64))
    for i, j in zip(b.tolist(), e.tolist(), strict=True):  # a word of over a million bytes
        h = np.uint64(j - i)
        for at in range(i, j, TOP):
            h = mix(np.array([h + prefix(BYTE_SYMBOL[x[at : min(j, at + TOP)]])[-1]]))[0]
        out.append(h)
    return np.array(out, np.uint64)


def _pieces(symbols: np.ndarray, ends: np.ndarray, w: int):
    """Ranges of texts small enough for one call, and overlapping pieces of longer texts."""
    starts = np.concatenate(([0], ends[:-1]))
    for i, j in groups(np.concatenate(([0], ends))):
        if j == i + 1 and ends[i] - starts[i] > 2 * PIECE:
            for s in range(0, int(ends[i] - starts[i]) - w + 1, PIECE):
                x = symbols[starts[i] + s : min(int(ends[i]), int(starts[i]) + s + PIECE + w - 1)]
                yield i, s, x, np.array([len(x)])
        else:
            yield i, 0, symbols[starts[i] : ends[j - 1]], ends[i:j] - starts[i]


def kernel(words: bool, w: int, k: int):
    """For mapInArrow: (key, text) to super-windows."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for i, j in groups(offsets):
                x = data[offsets[i] : offsets[j]]
                if words:
                    _, _, before, sym = word_symbols(x, offsets[i : j + 1])
                    ends = before[1:]
                else:
                    sym, ends = BYTE_SYMBOL[x], offsets[i + 1 : j + 1] - offsets[i]
                for t, off, piece, e in _pieces(sym, ends, w):
                    text, s, m, a, c = super_windows(piece, e, w, k)
                    if len(s):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[i + t + text]), pa.array(s + off, pa.int32()), pa.array(m, pa.int32()), pa.array(a), pa.array(c)], ["key", "s", "m", "a", "c"])

    return run


SUPER = "key long, s int, m int, a long, c long"


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def repeated(docs: DataFrame, words: bool, w: int, k: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Super-windows ``(key, s, m, a, c, lo, hi)`` whose anchor occurs more than once.

    ``docs`` has (key, text). ``least``: bytes that a text needs to hold a window at all. Texts are read twice and
    never moved; of the anchors, counted with a partial sum on the reading side, only those that repeat come back.
    """
    long = docs.where(F.octet_length("text") >= least).select("key", "text")
    supers = long.mapInArrow(kernel(words, w, k), SUPER)
    per_a = supers.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    return supers.join(per_a.select("a", "lo", "hi"), "a").select("key", "s", "m", "a", "c", "lo", "hi")
