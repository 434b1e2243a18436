"""Run-length index: repeated byte strings by a run-compressed Burrows-Wheeler transform.

The index of one shard is the run-length encoded Burrows-Wheeler transform of its strings, with the suffix
positions sampled at both ends of every run. Inside a run the longest common prefix with the suffix before
(after) falls by one a step in text order, so the samples alone give, streamed along the text, the matching
statistics: for each position the length of the longest match that starts anywhere else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.windows import SUPER, buffers, kernel, mix, powers, prefix, repeated, text_key
from folioflow.llm.windows import BYTE_SYMBOL
from folioflow.session import cut, drop, parts

__all__ = ["RunLengthIndex", "remove_repeats", "repeat_spans", "SUPER", "kernel"]

#: Length of a match, bytes of an anchor, bytes that one index holds, distinct super-windows of one anchor in an index.
MATCH, GRAM, SHARD, HOT = 400, 200, 1 << 19, 1500


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes still tied are sorted again."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length() + 1) if n else 1
    per = max(1, 63 // bits)
    x = np.zeros(n + per, np.uint64)
    x[:n] = symbols.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for i in range(per):
        key = (key << np.uint64(bits)) | x[i : i + n]
    sa = np.argsort(key)
    key = key[sa]
    slots = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    group = np.maximum.accumulate(np.where(new, slots, 0))
    rank[sa] = group
    single = new & np.append(new[1:], True)
    active, h = slots[~single], per
    while len(active):
        p = sa[active]
        second = rank[np.minimum(p + h, n)] + 1
        k = (rank[p].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        order = np.argsort(k)
        p, k = p[order], k[order]
        sa[active] = p
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        rank[p] = active[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        active = active[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class RunLengthIndex:
    """Run-compressed transform of some byte strings with the suffix positions sampled at run ends."""

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(b"\xff".join(strings) + b"\xff" + b"\0" * 8, np.uint8)
        n = self.n = len(self.text) - 8
        self.lengths = np.array([len(x) for x in strings])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths[:-1] + 1)))
        stops = self.starts + self.lengths
        self.left = np.repeat(stops, self.lengths + 1) - np.arange(n)  # bytes before the separator
        symbols = self.text[:n].astype(np.int64)
        symbols[stops] = 256 + np.arange(len(stops))  # each separator is a symbol of its own
        sa = suffix_order(symbols)
        before = symbols[sa - 1]
        change = before[1:] != before[:-1]
        self.heads = np.flatnonzero(np.append(True, change))
        tails = np.flatnonzero(np.append(change, True))
        self.run_symbols = before[self.heads]
        #: Samples: the suffix at each run's head with the one before it, at each run's tail with the one after it.
        self.head_at, self.tail_at = sa[self.heads], sa[tails]
        self.head_with = np.where(self.heads > 0, sa[self.heads - 1], -1)
        self.tail_with = np.where(tails < n - 1, sa[np.minimum(tails + 1, n - 1)], -1)

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at p and q, up to a separator; 0 where q is -1."""
        view = np.lib.stride_tricks.as_strided(self.text, (self.n, 8), (1, 1))
        words = np.ascontiguousarray(view).view(np.uint64).ravel()
        out = np.zeros(len(p), np.int64)
        most = np.minimum(self.left[p], self.left[np.maximum(q, 0)])
        active = np.flatnonzero((q >= 0) & (most > 0))
        length = 0
        while len(active):
            d = words[p[active] + length] ^ words[q[active] + length]
            same = d == 0
            stop = active[~same]
            low = d[~same] & (~d[~same] + np.uint64(1))
            out[stop] = length + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
            active = active[same]
            length += 8
            over = most[active] <= length
            out[active[over]] = length
            active = active[~over]
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match that starts at any other position."""
        best = np.zeros(self.n, np.int64)
        for at, other in ((self.head_at, self.head_with), (self.tail_at, self.tail_with)):
            ends = np.full(self.n, -1, np.int64)
            ends[at] = at + self.common(at, other)
            seen = np.zeros(self.n, np.int64)
            seen[at] = at
            ends = ends[np.maximum.accumulate(seen)]
            best = np.maximum(best, ends - np.arange(self.n))
        return best


def repeat_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string where substrings of ``length`` bytes begin that also begin anywhere else."""
    x = RunLengthIndex(strings)
    hit = x.matching_statistics() >= length
    return [np.flatnonzero(hit[s : s + n]) for s, n in zip(x.starts, x.lengths, strict=True)]


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers."""
    if not len(at):
        return at, at
    gap = np.diff(at) > 1
    return at[np.append(True, gap)], at[np.append(gap, True)]


def _fetch(length: int):
    """(text, key, reps) to the bytes of each representative super-window, once for each text."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            rows = []
            size = 0
            for i, (key, reps) in enumerate(zip(batch.column("key").to_pylist(), batch.column("reps").to_pylist(), strict=True)):
                if key in seen:
                    continue
                seen.add(key)
                for r in reps:
                    lo = int(offsets[i]) + r["s"]
                    rows.append((r["a"], key, r["s"], r["m"], r["k"], r["n"], data[lo : lo + r["m"] - 1 + length].tobytes()))
                    size += r["m"] + length
                    if size > 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
            if rows:
                yield _rows(rows)

    return run


_FETCHED = "a long, key long, s int, m int, k long, n long, content binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, key, s, m, k, n, content = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(key, pa.int64()), pa.array(s, pa.int32()), pa.array(m, pa.int32()), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(content, pa.binary())], ["a", "key", "s", "m", "k", "n", "content"])


def _indexed(length: int, shard: int):
    """Super-windows sorted by anchor to repeated spans; whole anchors fill one index after another."""

    def solve(strings, where):
        out = []
        for (key, s, m), at in zip(where, repeat_starts(strings, length), strict=True):
            lo, hi = runs(at[at < m])
            out.append((np.full(len(lo), key), s + lo, s + hi + length))
        key, b, e = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(b, pa.int32()), pa.array(e, pa.int32())], ["key", "b", "e"])

    def run(batches):
        strings, where, size, last, seen = [], [], 0, None, None
        for batch in batches:
            for a, key, s, m, content in zip(*(batch.column(c).to_pylist() for c in ("a", "key", "s", "m", "content")), strict=True):
                if (a, key, s) == seen:
                    continue
                if a != last and size >= shard:
                    yield solve(strings, where)
                    strings, where, size = [], [], 0
                seen, last = (a, key, s), a
                strings.append(content)
                where.append((key, s, m))
                size += len(content)
        if strings:
            yield solve(strings, where)

    return run


_SPANS = "key long, b int, e int"


def _window_hashes(length: int):
    """Every window of the super-windows of hot anchors with a hash of its bytes."""

    def run(batches):
        for batch in batches:
            for key, s, m, n, content in zip(*(batch.column(c).to_pylist() for c in ("key", "s", "m", "n", "content")), strict=True):
                p = prefix(BYTE_SYMBOL[np.frombuffer(content, np.uint8)])
                h = mix((p[length : length + m] - p[:m]) * powers()[1][:m])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, key), pa.int64()), pa.array(s + np.arange(m), pa.int32()), pa.array(np.full(m, n), pa.int64()), pa.array(h.view(np.int64))], ["key", "s", "n", "h"])

    return run


def representatives(mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of super-windows under anchors with several contents: (a, c) that repeat as a whole; one of each content to compare.

    A representative has n, how often its content occurs, and k, how many contents its anchor has. Anchors all of
    whose contents repeat need no comparison.
    """
    per_c = mixed.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "s", "m")).alias("r"))
    per_a = per_c.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("least = 1").select("a", "k")
    reps = per_c.join(per_a, "a").select("a", "c", "n", "k", "r.key", "r.s", "r.m")
    return per_c.where("n > 1").select("a", "c"), reps


def repeat_spans(keyed: DataFrame, length: int = MATCH, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """Spans ``(key, spans array<struct<b, e>>)`` of bytes covered by repeated strings of ``length`` bytes.

    ``keyed`` has (key, text) and whatever else. Contents that repeat as a whole are marked by counting; the rest of
    each repeated anchor goes into run-length indexes, whole anchors at a time. An anchor with over ``hot`` contents
    is spread by window hash instead, so that no task holds an unbounded group.
    """
    spark = keyed.sparkSession
    found = cut(repeated(keyed, False, length, gram, length), "bwt-anchors")
    mixed = found.where("lo != hi")
    whole, reps = representatives(mixed)
    reps = cut(reps, "bwt-reps")
    whole = mixed.join(whole, ["a", "c"]).select("key", "s", "m").unionByName(found.where("lo = hi").select("key", "s", "m"))
    wanted = reps.groupBy("key").agg(F.collect_list(F.struct("a", "s", "m", "k", "n")).alias("reps"))
    content = cut(keyed.join(wanted, "key").mapInArrow(_fetch(length), _FETCHED), "bwt-contents")
    drop(reps)
    cold = content.where(F.col("k") <= hot).repartition(parts(spark), "a").sortWithinPartitions("a", "key", "s")
    indexed = cold.mapInArrow(_indexed(length, shard), _SPANS)
    windows = content.where(F.col("k") > hot).dropDuplicates(["a", "key", "s"]).mapInArrow(_window_hashes(length), "key long, s int, n long, h long")
    often = windows.groupBy("h").agg(F.sum("n").alias("t")).where("t > 1").select("h")
    spread = windows.join(often, "h").select("key", F.col("s").alias("b"), (F.col("s") + length).alias("e"))
    marks = whole.select("key", F.col("s").alias("b"), (F.col("s") + F.col("m") + (length - 1)).alias("e")).unionByName(indexed).unionByName(spread)
    return marks.groupBy("key").agg(F.collect_set(F.struct("b", "e")).alias("spans"))


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by spans, in order."""
    out: list[tuple[int, int]] = []
    for b, e in sorted((x["b"], x["e"]) for x in spans or ()):
        if out and b <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((b, e))
    return out


def _remove(carry: list[str]):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            rows = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                x = data[offsets[i] : offsets[i + 1]].tobytes()
                gone = merge(spans)
                kept, at = [], 0
                for b, e in gone:
                    kept.append(x[at:b])
                    at = e
                kept.append(x[at:])
                left = b"".join(kept)
                rows.append((len(x), sum(e - b for b, e in gone), [{"b": b, "e": e} for b, e in gone], left, hashlib.sha256(left).hexdigest()))
            n, removed, spans, left, sha = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            kind = pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))
            arrays = [batch.column(c) for c in carry] + [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(left, pa.binary()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*carry, "n_bytes", "n_removed", "removed", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, length: int = MATCH, gram: int = GRAM, shard: int = SHARD, hot: int = HOT, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts anywhere else, in any document.

    Returns for each row of ``docs`` its ``carry`` columns, n_bytes, n_removed, removed (maximal runs ``[b, e)`` of
    removed bytes), kept (the remaining bytes) and kept_sha256. Strings are judged on the input. Null texts are empty
    and lose nothing; texts shorter than ``length`` hold no match. Repeated rows are documents of their own, so each
    makes the other a copy. Texts are told apart by a 64-bit hash. An empty table gives no rows. Columns of ``docs``
    besides text and ``carry`` are ignored, whatever their names.
    """
    carry = list(carry)
    keyed = docs.select(*[F.col(c) for c in carry], F.coalesce("text", F.lit("")).alias("text"), text_key().alias("key"))
    spans = repeat_spans(keyed, length, gram, shard, hot)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return keyed.join(spans, "key", "left").mapInArrow(_remove(carry), f"{kinds}, n_bytes long, n_removed long, removed array<struct<b int, e int>>, kept binary, kept_sha256 string")
