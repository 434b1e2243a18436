"""Packing of token pieces into sequences by exact-complement hashing, then best fit.

Lengths are at most the capacity, so the histogram of lengths, at most ``capacity`` numbers whatever the size of the
corpus, says all that a plan needs. The plan takes combinations in bulk; every step uses up some length, so it has
a few thousand entries at most. Pieces find their place by the rank among those of equal length.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import cut, parts

CAPACITY, END_ID = 1024, 2
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Strings that are one token wherever they stand in a text, as in the same vocabulary's byte_bpe_50k.json.
SPECIAL = {"<|endoftext|>": 50256}

_encoders: dict = {}


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The byte-level tokenizer of a file of ranks; one for each process.

    It gives the ids that the tokenizers library gives with byte_bpe_50k.json and its defaults, in a quarter of the time.
    """
    if (vocabulary, pattern) not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        made = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
        _encoders[vocabulary, pattern] = partial(made.encode, allowed_special="all")
    return _encoders[vocabulary, pattern]


def _pieces(vocabulary: str, pattern: str, capacity: int, end_id: int, carry: list[str]):
    def run(batches):
        encode = encoder(vocabulary, pattern)
        for batch in batches:
            row, piece, start, length, crc = array("q"), array("i"), array("q"), array("q"), array("q")
            for i, text in enumerate(batch.column("text")):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                raw = memoryview(np.array(ids, "<u4").tobytes())
                n = len(ids)
                at, to, k = 0, (n - 1) % capacity + 1, 0
                while at < n:
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(raw[4 * at : 4 * to]))
                    at, to, k = to, to + capacity, k + 1
            row = pa.array(np.array(row, np.int64))
            arrays = [batch.column(c).take(row) for c in carry] + [pa.array(np.array(x)) for x in (piece, start, length, crc)]
            yield pa.RecordBatch.from_arrays(arrays, [*carry, "piece", "start", "length", "ids_crc32"])

    return run


class SumIndex:
    """Lengths by number, pair and triple under their sums, each with its availability.

    A bucket is filled when its sum is first asked for and loses for good the combinations that have run out, since
    lengths only ever get fewer.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pairs: dict[int, list[tuple[int, ...]]] = {}
        self.triples: dict[int, list[tuple[int, int]]] = {}

    def times(self, pattern: list[int]) -> int:
        """How often the lengths of ``pattern`` are there together."""
        return min(int(self.left[x]) // pattern.count(x) for x in set(pattern))

    def pair(self, total: int, longest: int) -> list[int] | None:
        """The pair with this sum whose larger length is largest, next to a piece of ``longest``."""
        bucket = self.pairs.get(total)
        if bucket is None:
            low = np.arange(1, total // 2 + 1)
            low = low[(self.left[low] > 0) & (self.left[total - low] > 0)]
            bucket = self.pairs[total] = [(total - x, x) for x in low[::-1].tolist()]
        while bucket and not self.times(list(bucket[-1])):
            bucket.pop()
        return next((list(x) for x in reversed(bucket) if self.times([longest, *x])), None)

    def triple(self, total: int, longest: int) -> list[int] | None:
        """A triple with this sum, its largest length as large as can be."""
        bucket = self.triples.get(total)
        if bucket is None:
            high = np.flatnonzero(self.left[: max(total - 1, 0)]).tolist()
            bucket = self.triples[total] = [(a, total - a) for a in high if a * 3 >= total]
        while bucket and not self.left[bucket[-1][0]]:
            bucket.pop()
        for a, rest in reversed(bucket):
            if self.left[a] and (found := self.pair(rest, longest)) and self.times([longest, a, *found]):
                return [a, *found]
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns ``(how often, lengths)`` that use up a histogram of lengths below ``capacity``.

    The longest length left comes first, with the single, pair or triple of lengths that is its exact complement, from
    the index of sums, as often as all of them are there. What has no complement left is a residual and is filled by
    best fit: the longest piece that still fits, again and again.
    """
    left = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        left[k] += n
    index = SumIndex(left)
    out: list[tuple[int, list[int]]] = []

    def take(pattern: list[int]) -> bool:
        q = index.times(pattern)
        if q:
            for x in pattern:
                left[x] -= q
            out.append((q, pattern))
        return q > 0

    def best_fit(longest: int) -> None:
        pattern, room = [longest], capacity - longest
        left[longest] -= 1
        while room and len(fits := np.flatnonzero(left[1 : room + 1])):
            x = int(fits[-1]) + 1
            pattern.append(x)
            left[x] -= 1
            room -= x
        for x in pattern:
            left[x] += 1
        take(pattern)

    for longest in range(capacity, 0, -1):
        gap = capacity - longest
        while left[longest]:
            if take([longest, gap] if gap else [longest]):
                continue
            found = index.pair(gap, longest) or index.triple(gap, longest)
            if not found or not take([longest, *found]):
                best_fit(longest)
    return out


def _slots(patterns: list[tuple[int, list[int]]], capacity: int) -> tuple[dict[int, tuple], int]:
    """For each length (first ranks, first sequences, offsets) of its slots in order of rank; how many sequences."""
    slots: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for q, lengths in patterns:
        offset = 0
        for x in lengths:
            slots.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + q
            offset += x
        sequence += q
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in slots.items()}, sequence


def _place(slots: dict[int, tuple], keep: list[str]):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = length == x
                first, base, off = slots[x]
                i = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = base[i] + rank[at] - first[i], off[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, pattern: str = PATTERN, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Cut the texts of ``docs`` into pieces of at most ``capacity`` tokens and pack them into as few sequences as it can.

    A document is its token ids and ``end_id``. A longer one is cut into pieces of ``capacity``, the first piece taking
    what is left over. Returns for each piece the ``carry`` columns, piece, start, length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers), sequence_id (below 0 for a piece that fills one alone) and offset. Null and empty texts are a piece of
    ``end_id`` alone. Repeated rows are packed as often as they occur. An empty table gives no rows. Columns besides
    text and ``carry`` are ignored, whatever their names. Token ids stay where they are made; only lengths travel.
    """
    carry = list(carry)
    spark = docs.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    made = docs.select(*carry, "text").mapInArrow(_pieces(vocabulary, pattern, capacity, end_id, carry), f"{kinds}, piece int, start long, length long, ids_crc32 long")
    keep = [*carry, "piece", "start", "length", "ids_crc32"]
    every = cut(made, "pieces")
    full = every.where(F.col("length") == capacity).select(*keep, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pieces = every.where(F.col("length") < capacity)
    # Ranks among equal lengths in two steps, so that no task holds all pieces of a frequent length.
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keep), F.lit(parts(spark))))
    sizes = cut(pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")), "piece-sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # fewer than ``capacity`` rows
    slots, _ = _slots(plan(histogram, capacity), capacity)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    among = Window.partitionBy("length", "_salt").orderBy(*keep)
    ranked = pieces.withColumn("_no", F.row_number().over(among)).join(bases, ["length", "_salt"]).select(*keep, (F.col("_base") + F.col("_no") - 1).alias("rank"))
    placed = ranked.mapInArrow(_place(slots, keep), f"{kinds}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.unionByName(full)
