"""Language-model scoring with probabilistic suffix trees.

A token is a word or the end of a text. Contexts are the tokens before it, one or two, and the root, no token. A context
is kept as a state if a divergence test says so: following tokens whose share after it differs enough from what the
shorter context gives must be worth more bits than the state costs the rest. The longest suffix of the text that is a
state scores the next token; its distribution is smoothed with that of the shorter state, down to the root.

The root spells tokens, so that it has a probability for every one. It mixes the share of the token in training with a
suffix tree over the bytes of words, with contexts back to the word's beginning. There is a root for each language of
the training texts; the tokens already read choose it, so the scores stay probabilities of a text.

Counts of tokens and contexts are gathered from all training texts by aggregations and joins. Of tokens, contexts and
transitions the commonest are broadcast, up to bounds that are parameters; all others stay in a table, and each text
meets those that it needs in a join before it is scored, a slice of the texts at a time. The trees that spell are
broadcast whole.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from folioflow.llm.windows import C1, buffers, groups, mix, text_key, word_symbols
from folioflow.session import cut, drop, parts

#: Longest context of bytes; bits that a state must gain; discount; weight of the spelling next to the counts; how many trees.
DEPTH, DIVERGENCE, DISCOUNT, SPELLED, TREES = 5, 20.0, 0.7, 0.4, 8
#: Bounds on what is broadcast: tokens with their counts; states and transitions of each length of context. The rest is joined.
HEAD, TRANSITIONS = 300_000, 200_000
#: Bits that a transition must gain by itself; times it must occur; bits of a hash that a bitmap of keys knows.
GAIN, SUPPORT, BITS = 8.0, 3, 27
PIECE, FLUSH, SPELL = 1 << 19, 600_000, 60_000
#: Bits of a pair's key that name its bucket where pairs are counted; 32 more are kept. Pairs held before they are sorted.
BUCKET, PAIRS = 12, 2_000_000
#: Parts that the texts are scored in, one after the other; tasks that copies of a text are dealt to; bytes of rows scored at once.
SLICES, COPIES, ROWS = 2, 16, 3 << 20
#: Texts and rows, and packed pairs, that a Python worker gets at once: a few MB.
BATCH, PACKED = 2000, 500

#: What stands for the end of a text among word hashes.
END = -7046029254386353131
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of a context followed by a token; it names the longer context too."""
    return mix(a.view(np.uint64) * C1 + b.view(np.uint64))


def token_stream(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts with their ends, from the words: (hash of each, hash of the one before, text of each, where each text ends).

    Before the first token of a text stands the end of another.
    """
    length = np.diff(before) + 1
    ends = np.cumsum(length)
    inner = np.ones(ends[-1], bool)
    inner[ends - 1] = False
    token = np.full(ends[-1], np.uint64(END & (2**64 - 1)))
    token[inner] = h
    last = np.roll(token, 1)
    last[ends - length] = token[-1]
    return token, last, np.repeat(np.arange(len(length)), length), ends


def _merge(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums and where one of each stands."""
    order = np.argsort(h)
    s = h[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.add.reduceat(n[order], first) if len(s) else n, order[first] if len(s) else order


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of words, one after the other."""
    total = np.cumsum(size)
    return data[np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - size), size)]


@contextmanager
def _batches(spark, rows: int):
    """Python workers get no more than ``rows`` rows at once: what waits for them lies outside the heap and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), rows) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Words:
    """Distinct words with their counts and bytes."""

    def __init__(self):
        self.parts: list = []
        self.pending = 0

    def add(self, h: np.ndarray, n: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        h, n, at = _merge(h, n)
        self.parts.append((h, n, size[at], _gather(data, begin[at], size[at])))
        self.pending += len(h)
        if len(self.parts) > 12:
            self.fold()

    def fold(self) -> None:
        h, n, size = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        data = np.concatenate([p[3] for p in self.parts])
        begin = np.cumsum(size) - size
        h, n, at = _merge(h, n)
        self.parts = [(h, n, size[at], _gather(data, begin[at], size[at]))]
        self.pending = len(h)


def ngrams(size: np.ndarray, n: np.ndarray, data: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Weighted n-grams of words spelled with a space before and after: (key, count).

    A key has the n-gram's bytes, the last lowest, under its length; n is ``depth`` + 1 at most.
    """
    spelled = size + 2
    stop = np.cumsum(spelled)
    x = np.full(stop[-1], 32, np.uint64)
    inner = np.ones(len(x), bool)
    inner[stop - 1] = inner[stop - spelled] = False
    x[inner] = data
    place = np.arange(len(x)) - np.repeat(stop - spelled, spelled)
    weight = np.repeat(n, spelled)
    key = np.zeros(len(x), np.uint64)
    keys, counts = [], []
    for k in range(depth + 1):
        if k:
            key[k:] |= x[:-k] << np.uint64(8 * k)
        else:
            key |= x
        at = np.flatnonzero(place >= max(k, 1))
        h, c, _ = _merge(key[at] | np.uint64((k + 1) << 56), weight[at])
        keys.append(h)
        counts.append(c)
    return np.concatenate(keys), np.concatenate(counts)


class Sums:
    """Rows of three keys with a count, summed by the first of them."""

    def __init__(self):
        self.parts: list = []
        self.pending = 0

    def add(self, key: np.ndarray, *columns: np.ndarray) -> None:
        key, n, at = _merge(key, np.ones(len(key), np.int64))
        self.parts.append((key, n, *(c[at] for c in columns)))
        self.pending += len(key)

    def take(self) -> list[np.ndarray]:
        kept, self.parts, self.pending = list(zip(*self.parts, strict=True)), [], 0
        # Each column's parts go as soon as they are joined.
        key, n, *columns = [np.concatenate(kept.pop(0)) for _ in range(len(kept))]
        key, n, at = _merge(key, n)
        return [key, n, *(c[at] for c in columns)]


def _emit(columns: dict[str, np.ndarray], size: int = 1 << 16):
    n = len(next(iter(columns.values())))
    for i in range(0, n, size):
        yield pa.RecordBatch.from_arrays([x[i : i + size] if isinstance(x, pa.Array) else pa.array(x[i : i + size]) for x in columns.values()], list(columns))


class Pairs:
    """Pairs of tokens by the highest bits of their keys, packed by bucket: four bytes for each, ``support`` times at most.

    Bits that are left out can only let a pair pass for a frequent one; those that pass are counted by whole keys later.
    """

    def __init__(self, support: int):
        self.support = support
        self.parts: list = []
        self.pending = 0

    def add(self, key: np.ndarray) -> None:
        self.parts.append(key >> np.uint64(32 - BUCKET))
        self.pending += len(key)

    def take(self):
        key = np.concatenate(self.parts)
        self.parts, self.pending = [], 0
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key = np.repeat(key[first], np.minimum(np.diff(np.append(first, len(key))), self.support))
        at = np.searchsorted(key, np.arange((1 << BUCKET) + 1, dtype=np.uint64) << np.uint64(32))
        bucket = np.flatnonzero(np.diff(at))
        offsets = (np.append(at[bucket], len(key)) * 4).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(bucket), [None, pa.py_buffer(offsets), pa.py_buffer(key.astype(np.uint32))])
        return _emit({"tree": np.full(len(bucket), -1, np.int8), "h": bucket, "word": packed, "n": np.diff(at)[bucket]}, PACKED)


def _frequent(support: int):
    """(h, word), packed pairs in the order of buckets, to (at, bits): words of the bitmap of those that occur ``support`` times."""

    def bits(bucket: int, packed: list[np.ndarray]):
        x = np.sort(np.concatenate(packed))
        x = x[support - 1 :][x[support - 1 :] == x[: len(x) - support + 1]] if len(x) >= support else x[:0]
        k = (np.uint64(bucket) << np.uint64(BITS - BUCKET)) | (x >> np.uint32(32 + BUCKET - BITS)).astype(np.uint64)
        at = k >> np.uint64(6)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        return at[first].astype(np.int32), np.bitwise_or.reduceat(np.uint64(1) << (k & np.uint64(63)), first).view(np.int64) if len(at) else np.zeros(0, np.int64)

    def run(batches):
        bucket, packed = None, []
        for batch in batches:
            data, offsets = buffers(batch.column("word"))
            for i, h in enumerate(batch.column("h").to_pylist()):
                if h != bucket and packed:
                    yield from _emit(dict(zip(("at", "bits"), bits(bucket, packed), strict=True)))
                    packed = []
                bucket = h
                packed.append(np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes(), np.uint32))
        if packed:
            yield from _emit(dict(zip(("at", "bits"), bits(bucket, packed), strict=True)))

    return run


def _counts(trees: int, support: int = SUPPORT):
    """(text, tree) to (tree, h, word, n): tokens with their bytes, summed within a task, and under tree -1 packed pairs of tokens."""

    def tokens(tree: int, words: Words, texts: int):
        if words.parts:
            words.fold()
            h, n, size, data = words.parts[0]
        else:
            h, n, size, data = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        at = np.concatenate(([0], np.cumsum(size), [size.sum()])).astype(np.int32)
        word = pa.Array.from_buffers(pa.binary(), len(h) + 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
        h = np.append(h.view(np.int64), np.int64(END))
        yield from _emit({"tree": np.full(len(h), tree, np.int8), "h": h, "word": word, "n": np.append(n, texts)})

    def run(batches):
        words, texts, pairs = [Words() for _ in range(trees)], [0] * trees, Pairs(support)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            of = batch.column("tree").to_numpy()
            for k, n in enumerate(np.bincount(of, minlength=trees).tolist()):
                texts[k] += n
            for i, j in groups(offsets, PIECE):
                x = _lower[data[offsets[i] : offsets[j]]]
                begin, end, before, h = word_symbols(x, offsets[i : j + 1])
                token, last, _, _ = token_stream(h, before)
                pairs.add(pair(last, token))
                if pairs.pending > PAIRS:
                    yield from pairs.take()
                which = np.repeat(of[i:j], np.diff(before))
                for k in np.unique(which).tolist():
                    at = np.flatnonzero(which == k)
                    words[k].add(h[at], np.ones(len(at), np.int64), x, begin[at], (end - begin)[at])
                if sum(w.pending for w in words) > FLUSH:
                    for w in words:
                        if w.parts:
                            w.fold()
                    while sum(w.pending for w in words) > FLUSH // 2:
                        k = max(range(trees), key=lambda k: words[k].pending)
                        yield from tokens(k, words[k], texts[k])
                        words[k], texts[k] = Words(), 0
        if pairs.parts:
            yield from pairs.take()
        for k in range(trees):
            if texts[k] or words[k].parts:
                yield from tokens(k, words[k], texts[k])

    return run


def _spellings(depth: int):
    """(word, by) to (tree, h, n): n-grams of the bytes of distinct words, by how often the words occur in each tree."""

    def grams(parts):
        data = np.concatenate([p[0] for p in parts])
        size, by = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        begin = np.cumsum(size) - size
        for k in range(by.shape[1]):
            at = np.flatnonzero(by[:, k])
            if len(at):
                key, n = ngrams(size[at], by[at, k], _gather(data, begin[at], size[at]), depth)
                yield from _emit({"tree": np.full(len(key), k, np.int8), "h": key.view(np.int64), "n": n.astype(np.int64)})

    def run(batches):
        parts, words = [], 0
        for batch in batches:
            data, offsets = buffers(batch.column("word"))
            by = batch.column("by").flatten().to_numpy().reshape(batch.num_rows, -1)
            parts.append((data[offsets[0] : offsets[-1]], np.diff(offsets), by))
            words += batch.num_rows
            if words > SPELL:
                yield from grams(parts)
                parts, words = [], 0
        if words:
            yield from grams(parts)

    return run


def _bitmap(rows: DataFrame) -> np.ndarray:
    """The bitmap of words (at, bits): 16 MB, whatever there is."""
    rows = rows.toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _bits(keys: DataFrame) -> np.ndarray:
    """A bitmap over the keys (column h), put together by Spark: each sets two bits, by its highest bits and by those below."""
    k = F.explode(F.array(F.shiftrightunsigned("h", 64 - BITS), F.shiftrightunsigned(F.shiftleft("h", BITS), 64 - BITS))).alias("k")
    rows = keys.select(k).select(F.shiftrightunsigned("k", 6).cast("int").alias("at"), F.expr("shiftleft(1L, CAST(k & 63 AS INT))").alias("bit"))
    return _bitmap(rows.groupBy("at").agg(F.bit_or("bit").alias("bits")))


def _bit(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bit of the highest bits of a key is set."""
    k = key >> np.uint64(64 - BITS)
    return (bits[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63))) & np.uint64(1) > 0


def _known(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a bitmap that ``_bits`` made may know a key."""
    out = _bit(bits, key)
    at = np.flatnonzero(out)
    out[at] = _bit(bits, key[at] << np.uint64(BITS))
    return out


def _following(shared):
    """(text) to (h, u, b, n): tokens b after h (u is h again), where the bitmap may know the pair."""

    def find(token, last, doc):
        key = pair(last, token)
        at = np.flatnonzero(_bit(shared.value, key))
        return key[at], last[at], last[at], token[at]

    return _rows_of(find)


def _longer(shared):
    """(text) to (h, u, b, n): tokens b after two tokens, of which h is the key and u the last, where the bitmap may know them."""

    def find(token, last, doc):
        key = pair(last, token)
        at = np.flatnonzero(_known(shared.value, key[:-1]) & (doc[1:] == doc[:-1])) + 1
        return pair(key[at - 1], token[at]), key[at - 1], last[at], token[at]

    return _rows_of(find)


def _rows_of(find):
    """Tokens of texts to the sums of what ``find`` finds among them: (key of a row, h, u, b)."""

    def emit(sums: Sums):
        _, n, h, u, b = sums.take()
        return _emit({"h": h.view(np.int64), "u": u.view(np.int64), "b": b.view(np.int64), "n": n})

    def run(batches):
        sums = Sums()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in groups(offsets, PIECE):
                _, _, before, h = word_symbols(_lower[data[offsets[i] : offsets[j]]], offsets[i : j + 1])
                token, last, doc, _ = token_stream(h, before)
                sums.add(*find(token, last, doc))
                if sums.pending > FLUSH:
                    yield from emit(sums)
        if sums.parts:
            yield from emit(sums)

    return run


def _summed(rows: DataFrame, support: int, *keys: str) -> DataFrame:
    """Sums of n by keys: tasks have summed their rows, so these are dealt out as they are and summed once more where they arrive."""
    return rows.repartition(parts(rows.sparkSession), *[k for k in keys if k != "word"]).groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= support)


@dataclass
class Tree:
    """Suffix automaton: by state (a context) and byte the log10 probability of the byte and the next state."""

    contexts: list[bytes]
    log: np.ndarray
    goto: np.ndarray
    start: int
    symbol: np.ndarray  # column of each byte; bytes never seen share one

    def spell(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log10 probability of each word's spelling."""
        order = np.argsort(-size, kind="stable")
        b, s = begin[order], size[order]
        out = np.zeros(len(order))
        state = np.full(len(order), self.start, np.int32)
        for i in range(int(s[0]) if len(s) else 0):
            m = int(np.searchsorted(-s, -i, "left"))  # words with more than i bytes
            x = self.symbol[data[b[:m] + i]]
            out[:m] += self.log[state[:m], x]
            state[:m] = self.goto[state[:m], x]
        out += self.log[state, self.symbol[32]]
        back = np.empty(len(order))
        back[order] = out
        return back


def build_tree(keys: np.ndarray, counts: np.ndarray, divergence: float = DIVERGENCE, discount: float = DISCOUNT) -> Tree:
    """Tree from n-grams as ``ngrams`` gives them, of all contexts that pass the test."""
    keys = keys.astype(np.uint64)
    length, last = keys >> np.uint64(56), (keys & np.uint64(255)).astype(np.int64)
    context = ((keys & np.uint64((1 << 56) - 1)) >> np.uint64(8)) | (length << np.uint64(56))
    order = np.argsort(context, kind="stable")
    context, last, counts = context[order], last[order], counts[order].astype(float)
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
    follow: dict[bytes, slice] = {}
    for c, i, j in zip(context[first].tolist(), first.tolist(), [*first[1:].tolist(), len(context)][: len(first)], strict=True):
        follow[(c & ((1 << 56) - 1)).to_bytes(7, "big")[8 - (c >> 56) :]] = slice(i, j)

    def after(at: slice | None) -> np.ndarray:
        row = np.zeros(256)
        if at is not None:
            row[last[at]] = counts[at]
        return row

    root = after(follow.pop(b"", None))
    keep = {b"": None, b" ": None}
    for s in follow:
        row = after(follow[s])
        shorter = s[1:]
        while shorter and shorter not in follow:
            shorter = shorter[1:]
        parent = after(follow[shorter]) if shorter else root
        p, q = row / row.sum(), (parent + 1e-3) / (parent + 1e-3).sum()
        on = p > 0
        gain = row.sum() * float((p[on] * np.log2(p[on] / q[on])).sum())
        if gain >= divergence:
            # All parts of a state are states: the longest suffix is then always one byte away from the last one.
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    keep.setdefault(s[i:j])
    contexts = sorted(keep, key=lambda s: (len(s), s))
    number = {s: i for i, s in enumerate(contexts)}
    seen = np.flatnonzero(root)
    columns = np.append(seen, np.setdiff1d(np.arange(256), seen)[:1])
    symbol = np.full(256, len(seen), np.uint8)
    symbol[seen] = np.arange(len(seen))
    prob = np.zeros((len(contexts), len(columns)))
    for i, s in enumerate(contexts):
        row = after(follow.get(s))[columns]
        if not s:
            prob[i] = ((root + 1) / (root + 1).sum())[columns]
        elif not row.sum():
            prob[i] = prob[number[s[1:]]]
        else:
            used = np.maximum(row - discount, 0)
            prob[i] = (used + (row.sum() - used.sum()) * prob[number[s[1:]]]) / row.sum()
    goto = np.zeros((len(contexts), len(columns)), np.int32)
    # The next state is the longest state that is a suffix of context + byte: shorter ones first, longer ones over them.
    ends: dict[bytes, list[int]] = {}
    for i, s in enumerate(contexts):
        for k in range(len(s) + 1):
            ends.setdefault(s[k:], []).append(i)
    for s in contexts:
        if s:
            rows = ends.get(s[:-1])
            if rows:
                goto[rows, symbol[s[-1]]] = number[s]
    return Tree(contexts, np.log10(prob).astype(np.float32), goto.astype(np.min_scalar_type(len(contexts))), number[b" "], symbol)


class Keys:
    """A sorted set of 64-bit keys, with a table of bits that answers most lookups."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.bits = min(max(16, (16 * len(keys)).bit_length()), 26)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``key`` are there, and where."""
        at = np.flatnonzero(self.seen[(key >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
        hit = self.keys[k] == key[at]
        return at[hit], k[hit]

    def has(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), bool)
        out[self.find(key)[0]] = True
        return out


class Contexts:
    """States of contexts of one length with the weight of the shorter context, and transitions with a probability of their own."""

    def __init__(self, state: np.ndarray, rest: np.ndarray, key: np.ndarray, mass: np.ndarray):
        """States' keys and their weights for all the rest; keys of contexts with a token, and the token's own probability."""
        self.states, self.rest = Keys(state), rest[np.argsort(state)]
        self.keys, self.mass = Keys(key), mass[np.argsort(key)]


def mix_in(parts: list[Contexts], context: np.ndarray, key: np.ndarray, own: np.ndarray, rest: np.ndarray) -> None:
    """From own + rest * p under the shorter context to the same under this one, where it is a state; a key is in one part only."""
    for x in parts:
        at, k = x.states.find(context)
        own[at] *= x.rest[k]
        rest[at] *= x.rest[k]
    for x in parts:
        at, k = x.keys.find(key)
        own[at] += x.mass[k]


@dataclass
class Model:
    trees: list[Tree]
    prior: np.ndarray  # log10 share of each tree in the training texts
    sizes: np.ndarray  # training tokens by tree
    distinct: int  # V
    head: np.ndarray  # hashes of the frequent tokens, in order
    head_count: np.ndarray  # their counts, by tree
    contexts: list[Contexts]  # the frequent ones of one token and of two
    others: DataFrame | None  # all else by key: (h, kind, v); kind is the tree of a token's count, then a transition's probability, then a state's weight
    bits: np.ndarray | None  # bitmap of their keys
    spelled: float = SPELLED  # weight of the tree; the rest is that of the counts

    @property
    def tokens(self) -> int:
        """N"""
        return int(self.sizes.sum())

    def log_known(self, k: int, count: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Log10 probability under tree k of tokens from counts and spelling; both parts sum to their weight over all tokens."""
        with np.errstate(divide="ignore"):
            top = np.log((1 - self.spelled) * count / max(int(self.sizes[k]), 1))
        return np.logaddexp(top, np.log(self.spelled) + spelled * np.log(10)) / np.log(10)


def _keyed(batches):
    """(h, b, n, total, mass, rest) with the key of each transition."""
    for batch in batches:
        h, b = (batch.column(x).to_numpy() for x in ("h", "b"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pair(h, b).view(np.int64))], [*batch.schema.names, "key"])


def _chosen(rows: DataFrame, gain: float, divergence: float, name: str) -> DataFrame:
    """Of (h, b, n, total, base) the transitions that gain enough, with their key, mass and rest.

    Of a context h seen ``total`` times ``n`` were followed by b; ``base`` is its probability under the shorter context.
    rest is the weight that h leaves to the shorter context, null where the divergence test doesn't keep h.
    """
    found = cut(rows.withColumn("mass", (F.col("n") - DISCOUNT) / F.col("total")).where(F.col("n") * F.log2(F.col("mass") / F.col("base")) >= gain), f"{name}-gains")
    held = found.join(found.groupBy("h").agg((1 - F.sum("mass")).alias("rest"), F.sum("n").alias("seen")), "h")
    won = F.sum(F.col("n") * F.log2((F.col("mass") + F.col("rest") * F.col("base")) / F.col("base"))) + (F.max("total") - F.max("seen")) * F.log2(F.max("rest"))
    kept = held.groupBy("h").agg(won.alias("won"), F.max("rest").alias("rest")).where(F.col("won") >= divergence).select("h", "rest")
    out = found.join(kept, "h", "left").select("h", "b", "n", "total", "mass", "rest")
    out = cut(out.mapInArrow(_keyed, "h long, b long, n long, total long, mass double, rest double, key long"), name)
    drop(found)
    return out


def learn(
    docs: DataFrame, usable: Column, depth: int = DEPTH, divergence: float = DIVERGENCE, gain: float = GAIN, support: int = SUPPORT,
    head: int = HEAD, transitions: int = TRANSITIONS, trees: int = TREES,
) -> Model:
    """Model from all texts that are ``usable``; null texts are empty.

    The ``trees`` - 1 commonest languages have a root each, the others and null one together. Contexts of two tokens
    are looked for where both are a transition that gains enough. Collected are the n-grams of bytes, no more than
    ``head`` tokens and ``transitions`` states and transitions of either length, the commonest; all others stay in a
    table, so the scores don't depend on these bounds. All counts are over all usable texts.
    """
    spark = docs.sparkSession
    usable_docs = docs.select("text", "lang", usable.alias("_usable")).where("_usable")
    langs = usable_docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(trees - 1).collect()
    names = [r["lang"] for r in langs if r["lang"] is not None]
    tree = F.lit(len(names))
    for i, name in enumerate(names):
        tree = F.when(F.col("lang") == F.lit(name), F.lit(i)).otherwise(tree)
    k = len(names) + 1
    texts = usable_docs.select(F.coalesce("text", F.lit("")).alias("text"), tree.cast("byte").alias("tree"))
    with _batches(spark, BATCH):
        seen = cut(texts.mapInArrow(_counts(k, support), "tree byte, h long, word binary, n long"), "seen")
    by = F.array(*[F.coalesce(F.sum(F.when(F.col("tree") == i, F.col("n"))), F.lit(0)) for i in range(k)])
    words = cut(seen.where("tree >= 0").repartition(parts(spark), "h").groupBy("h", "word").agg(F.sum("n").alias("c"), by.alias("by")), "tokens")
    packed = seen.where("tree < 0").select("h", "word").repartition(parts(spark), "h").sortWithinPartitions("h")
    with _batches(spark, PACKED):
        pairs = cut(packed.mapInArrow(_frequent(support), "at int, bits long"), "frequent")
    drop(seen)
    sums = words.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.col("by")[i]), F.lit(0)) for i in range(k)]).first()
    distinct, sizes = sums[0], np.array(sums[1:], np.int64)
    least = _threshold(words, "c", head)
    top = words.where(F.col("c") >= least).select("h", "by").toArrow().combine_chunks()
    h = top.column("h").to_numpy().view(np.uint64)
    c = top.column("by").combine_chunks().flatten().to_numpy().reshape(len(h), k)
    order = np.argsort(h)
    spelled = cut(words.select("word", "by").mapInArrow(_spellings(depth), "tree byte, h long, n long").groupBy("tree", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= support), "spellings")
    made = []
    for i in range(k):
        grams = spelled.where(F.col("tree") == i).select("h", "n").toArrow().sort_by("h")
        made.append(build_tree(grams.column("h").to_numpy().view(np.uint64), grams.column("n").to_numpy(), divergence))
        del grams
    head_hash, head_count = h[order], c[order]
    del top, h, c
    pa.default_memory_pool().release_unused()
    prior = np.log10((sizes + 1) / (sizes + 1).sum())
    levels = _contexts(spark, texts, _bitmap(pairs), words, sizes, distinct, gain, support, divergence)
    drop(pairs, spelled)

    def other(rows: DataFrame, h: str, kind: Column, v: str) -> DataFrame:
        return rows.select(F.col(h).alias("h"), kind.cast("byte").alias("kind"), F.col(v).cast("double").alias("v"))

    rare = words.where(F.col("c") < least).select("h", F.posexplode("by").alias("tree", "n")).where("n > 0")
    others, contexts = [other(rare, "h", F.col("tree"), "n")], []
    for level in levels:
        after = level.where("rest IS NOT NULL")
        before = after.groupBy("h").agg(F.max("rest").alias("rest"), F.max("total").alias("n"))
        often, common = _threshold(before, "n", transitions), _threshold(after, "n", transitions)
        a, b = before.where(F.col("n") >= often).select("h", "rest").toArrow(), after.where(F.col("n") >= common).select("key", "mass").toArrow()
        contexts.append(Contexts(a.column("h").to_numpy().view(np.uint64), a.column("rest").to_numpy(), b.column("key").to_numpy().view(np.uint64), b.column("mass").to_numpy()))
        del a, b
        others.append(other(before.where(F.col("n") < often), "h", F.lit(k + 1), "rest"))
        others.append(other(after.where(F.col("n") < common), "key", F.lit(k), "mass"))
    others = cut(reduce(DataFrame.unionAll, others), "others")
    drop(words, *levels)
    pa.default_memory_pool().release_unused()
    return Model(made, prior, sizes, int(distinct), head_hash, head_count, contexts, others, _bits(others.select("h")))


def _threshold(rows: DataFrame, n: str, most: int) -> int:
    """The least count that leaves no more than ``most`` rows; counts from 4096 up are told apart by their powers of two."""
    step = F.when(F.col(n) < 4096, F.col(n)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n)))).cast("long")
    total, least = 0, None
    steps = rows.groupBy(step.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    for c, m in sorted(((r["c"], r["n"]) for r in steps), reverse=True):
        if total + m > most:
            return (least if least is not None else 2 * c)
        total, least = total + m, c
    return 1


def _contexts(spark, texts: DataFrame, pairs: np.ndarray, words: DataFrame, sizes: np.ndarray, distinct: int, gain: float, support: int, divergence: float) -> list[DataFrame]:
    """Transitions after one token and after two, as ``_chosen`` gives them; ``pairs`` is the bitmap of pairs that occur often enough."""
    shared = spark.sparkContext.broadcast(pairs)
    with _batches(spark, BATCH):
        pairs = cut(_summed(texts.select("text").mapInArrow(_following(shared), "h long, u long, b long, n long"), support, "h", "b"), "pairs")
    shared.destroy()
    after, before = words.select(F.col("h").alias("b"), F.col("by").alias("b_by")), words.select("h", F.col("c").alias("total"), "by")
    base = sum((F.col("by")[i] / F.col("c_u") * (F.col("b_by")[i] + 1) / float(n + distinct) for i, n in enumerate(sizes.tolist())), F.lit(0.0))
    rows = pairs.join(before, "h").join(after, "b").withColumn("c_u", F.col("total"))
    one = _chosen(rows.select("h", "b", "n", "total", base.alias("base")), gain, divergence, "transitions")
    shared = spark.sparkContext.broadcast(_bits(one.select(F.col("key").alias("h"))))
    with _batches(spark, BATCH):
        two = cut(_summed(texts.select("text").mapInArrow(_longer(shared), "h long, u long, b long, n long"), support, "h", "u", "b"), "longer")
    shared.destroy()
    own = one.select(F.col("h").alias("u"), "b", F.when(F.col("rest").isNotNull(), F.col("mass")).alias("own"))
    weights = one.where("rest IS NOT NULL").groupBy(F.col("h").alias("u")).agg(F.max("rest").alias("rest"))
    rows = two.join(one.select(F.col("key").alias("h"), F.col("n").alias("total")), "h").join(own, ["u", "b"], "left").join(weights, "u", "left")
    rows = rows.join(words.select(F.col("h").alias("u"), F.col("c").alias("c_u"), "by"), "u").join(after, "b")
    rows = rows.select("h", "b", "n", "total", (F.coalesce("own", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * base).alias("base"))
    longer = _chosen(rows, gain, divergence, "longer-transitions")
    drop(pairs, two)
    return [one, longer]


def _needed(shared):
    """(_lm_key, _lm_text) to (_lm_key, _lm_h): what each text needs of the table of others, as far as the bitmap can tell; once in a task."""

    def run(batches):
        m = shared.value
        one, two = m.contexts
        words, met = Keys(m.head), set()
        for batch in batches:
            new = [k not in met and not met.add(k) for k in batch.column("_lm_key").to_pylist()]
            batch = batch.filter(pa.array(new, pa.bool_()))
            data, offsets = buffers(batch.column("_lm_text"))
            keys = batch.column("_lm_key").to_numpy()
            for i, j in groups(offsets, PIECE):
                _, _, before, h = word_symbols(_lower[data[offsets[i] : offsets[j]]], offsets[i : j + 1])
                token, last, doc, ends = token_stream(h, before)
                key = pair(last, token)
                known = _known(m.bits, key)
                longer = np.flatnonzero((doc[1:] == doc[:-1]) & (known | two.states.has(key))[:-1]) + 1
                three = pair(key[longer - 1], token[longer])
                # A token or pair may be in the table in one of its two parts only.
                token, of = (x[_known(m.bits, token)] for x in (token, doc))
                at = np.flatnonzero(~(words.has(token) & one.states.has(token)))
                pairs = np.flatnonzero(known)
                pairs = pairs[~(one.keys.has(key[pairs]) & two.states.has(key[pairs]))]
                most = np.flatnonzero(_known(m.bits, three) & ~two.keys.has(three))
                h, of = np.concatenate((token[at], key[pairs], three[most])), np.concatenate((of[at], doc[pairs], doc[longer[most]]))
                first = _merge(mix(h + mix(of.astype(np.uint64))), np.ones(len(h), np.int64))[2]
                yield from _emit({"_lm_key": keys[i + of[first]], "_lm_h": h[first].view(np.int64)})

    return run


def _score(shared, carry: list[str]):
    """Texts, each after the rows that it met in the table of others, to the ``carry`` columns and the sums of their tokens."""
    names = [*carry, "n_tokens", "n_known", "logs", "score"]

    def looked_up(h: np.ndarray, kind: np.ndarray, v: np.ndarray, trees: int) -> tuple[Keys, np.ndarray, Contexts]:
        """Rows of the table: tokens with their counts, states and transitions."""
        at = np.flatnonzero(kind < trees)
        token, of = np.unique(h[at], return_inverse=True)
        by = np.zeros((len(token), trees), np.int64)
        by[of, kind[at]] = v[at]
        key, state = (np.flatnonzero(kind == trees + i) for i in range(2))
        key, state = (at[_merge(h[at], at)[2]] for at in (key, state))
        return Keys(token), by, Contexts(h[state], v[state], h[key], v[key])

    def tokens(texts: pa.Table, given: list[np.ndarray], m: Model, frequent: Keys) -> pa.RecordBatch:
        trees = len(m.trees)
        end = np.uint64(END & (2**64 - 1))
        data, offsets = buffers(texts.column("_lm_text"))
        other, other_count, more = looked_up(given[1].view(np.uint64), given[2], given[3], trees)
        out: list[list] = [[] for _ in range(4)]
        for i, j in groups(offsets, PIECE):
            x = _lower[data[offsets[i] : offsets[j]]]
            begin, stop, before, h = word_symbols(x, offsets[i : j + 1])
            n = j - i
            order = np.argsort(h)
            new = np.append(True, h[order[1:]] != h[order[:-1]])[: len(h)]
            first, inverse = order[new], np.empty(len(h), np.int64)
            inverse[order] = np.cumsum(new) - 1
            u = h[first]
            # The end of a text is a token of no bytes.
            u = np.append(u, end)
            b, size = np.append(begin[first], 0), np.append((stop - begin)[first], 0)
            hashes, last, doc, ends = token_stream(h, before)
            length = np.diff(before) + 1
            token = np.full(ends[-1], len(u) - 1)
            inner = np.ones(ends[-1], bool)
            inner[ends - 1] = False
            token[inner] = inverse
            count = np.zeros((len(u), trees), np.int64)
            for keys, counts in ((other, other_count), (frequent, m.head_count)):
                at, k = keys.find(u)
                count[at] = counts[k]
            spelled = np.stack([t.spell(x, b, size) for t in m.trees], axis=1)
            log_p = np.stack([m.log_known(t, count[:, t], spelled[:, t]) for t in range(trees)], axis=1)
            # The root for a token is the one that best spells the tokens before it.
            seen = np.cumsum(spelled[token], axis=0)
            past = np.zeros_like(seen)
            past[1:] = seen[:-1]
            past -= past[ends - length][doc]
            tree = (past + m.prior).argmax(axis=1)
            # Probability of a token: own + rest * that under the root.
            own, rest = np.zeros(len(token)), np.ones(len(token))
            one = pair(last, hashes)
            mix_in([m.contexts[0], more], last, one, own, rest)
            longer = np.flatnonzero(doc[1:] == doc[:-1]) + 1
            a, c = own[longer], rest[longer]
            mix_in([m.contexts[1], more], one[longer - 1], pair(one[longer - 1], hashes[longer]), a, c)
            own[longer], rest[longer] = a, c
            total = count.sum(axis=1)
            root = log_p[token, tree]
            with np.errstate(divide="ignore"):
                p = np.where(own == 0, np.log10(rest) + root, np.logaddexp(np.log(own), np.log(rest) + root * np.log(10)) / np.log(10))
            out[0].append(length)
            out[1].append(np.bincount(doc, weights=total[token] > 0, minlength=n).astype(np.int64))
            out[2].append(np.bincount(doc, weights=np.log10(total + 1)[token], minlength=n))
            out[3].append(np.bincount(doc, weights=p, minlength=n))
        return pa.RecordBatch.from_arrays([*(texts.column(c).combine_chunks() for c in carry), *(pa.array(np.concatenate(v)) for v in out)], names)

    def scored(rows: pa.Table, before: list[np.ndarray], m: Model, frequent: Keys):
        """(what the texts among ``rows`` give, rows of the table that belong to the last key)"""
        given = rows.filter(rows.column("_lm_text").is_null()).select(["_lm_key", "_lm_h", "_lm_kind", "_lm_v"])
        given = [np.concatenate((x, c.to_numpy())) for x, c in zip(before, given.columns, strict=True)]
        last = rows.column("_lm_key")[-1].as_py() & -2
        texts = rows.filter(rows.column("_lm_text").is_valid())
        out = tokens(texts, given, m, frequent) if texts.num_rows else None
        at = np.flatnonzero(given[0] == last)
        return out, [x[at] for x in given]

    def run(batches):
        m = shared.value
        frequent = Keys(m.head)
        held, size, kept = [], 0, [np.zeros(0, t) for t in (np.int64, np.int64, np.int8, np.float64)]
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if held and (batch is None or size > ROWS):
                out, kept = scored(pa.Table.from_batches(held), kept, m, frequent)
                held, size = [], 0
                if out is not None:
                    yield out

    return run


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), slices: int = SLICES) -> DataFrame:
    """The ``carry`` columns of each row, n_tokens, n_known, train_tokens, base_score and score.

    score is the model's log10 probability of the text with its end, base_score that of single tokens with one added
    to every count. Null texts are empty: one token, the end. Repeated rows score alike. With nothing learned every
    token is unknown. An empty table gives no rows. Columns besides text and ``carry`` are ignored, whatever their names.
    """
    spark, carry = docs.sparkSession, list(carry)
    schema = docs.select(*carry).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    lookup, scorer = (spark.sparkContext.broadcast(replace(model, others=None, **unused)) for unused in ({"trees": []}, {"bits": None}))
    # Texts under one key share what either needs, so a clash of hashes does no harm. A key is even, that of a text one more, so it comes last.
    deal = F.pmod(F.xxhash64(*[F.col(f.name) for f in schema if isinstance(f.dataType, IntegralType | StringType)], F.lit(0)), F.lit(COPIES))
    read = docs.select(*carry, F.coalesce("text", F.lit("")).alias("_lm_text"), F.xxhash64(text_key(), deal).bitwiseAND(F.lit(-2)).alias("_lm_key"))
    others = model.others.select(F.col("h").alias("_lm_h"), F.col("kind").alias("_lm_kind"), F.col("v").alias("_lm_v"))
    out = []
    for i in range(slices):
        part = read.where(F.pmod(F.shiftright("_lm_key", 1), F.lit(slices)) == i)
        needed = part.select("_lm_key", "_lm_text").mapInArrow(_needed(lookup), "_lm_key long, _lm_h long")
        found = needed.join(others.hint("shuffle_hash"), "_lm_h").select("_lm_key", "_lm_h", "_lm_kind", "_lm_v")
        rows = found.unionByName(part.withColumn("_lm_key", F.col("_lm_key") + 1), allowMissingColumns=True)
        rows = rows.repartition(parts(spark), F.col("_lm_key").bitwiseAND(F.lit(-2))).sortWithinPartitions("_lm_key")
        with _batches(spark, BATCH):
            out.append(cut(rows.mapInArrow(_score(scorer, carry), f"{kinds}, n_tokens long, n_known long, logs double, score double"), "scores"))
    rows = reduce(DataFrame.unionAll, out)
    lookup.destroy()
    scorer.destroy()
    n, v = float(model.tokens), float(model.distinct)
    return rows.select(
        *[F.col(x) for x in carry],
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        "score",
    )
