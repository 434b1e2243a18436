"""Benchmark decontamination by rare n-gram seeds that join passages to test items, and Smith-Waterman alignment.

A seed is a skip-gram of a test item: two words, next to each other or with one between, that stand so in a text. An
alignment that scores S has at least ceil(S / 2) - 1 seeds, from different words each: of M matches 2 M - S edits at most
lie between, so M - ceil(S / 2) gaps at most hold two edits or more. An item may therefore leave out its commonest seeds,
as long as those left must turn up in every leak; how often words occur in the corpus decides which go, for speed alone.

Texts emit the seeds they hold, with their places; these join the items' seeds. Where enough of an item's seeds lie
close together in a text, the words around are aligned with the item. No alignment over the threshold is missed,
whatever the corpus holds. Nothing but a bitmap of fixed size is broadcast, so there may be any number of items.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.windows import C1, PUNCTUATION, buffers, groups, lower, text_key, word_symbols
from folioflow.session import cut

#: Least words of an item; score of a leak; bits of a hash that the bitmap knows; cost of an alignment next to that of a seed found.
LEAST, SCORE, BITS, COST = 3, 0.4, 22, 5000
MATCH, MISMATCH, GAP = 2, -1, -1


def symbols(data: np.ndarray, offsets: np.ndarray):
    """Words of letters and digits, in lower case: (words before each text, hash of each word)."""
    x = lower(data[offsets[0] : offsets[-1]])
    return word_symbols(x, offsets, PUNCTUATION)[2:]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word sequences with linear gaps: (score, where it ends in b)."""
    best, end = 0, 0
    steps = np.arange(1, len(b) + 1) * -GAP
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        t = np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(t, 0, out=t)
        row[1:] = np.maximum.accumulate(t + steps) - steps
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two words in order."""
    return a * C1 + b


def item_links(w: np.ndarray, share: np.ndarray, threshold: float = SCORE) -> tuple[np.ndarray, int, int]:
    """Seeds of an item without the commonest that an alignment of the threshold can do without, how many of them a leak must have, and its most words.

    ``share`` is how often each word occurs among all words.
    """
    score = math.ceil(threshold * MATCH * len(w) - 1e-9)
    sure = max(1, -(-score // 2) - 1)
    longest = 3 * len(w) - score  # M matches and 2 M - S more
    rate = 2 * share[:-1] * (share[1:] + np.append(share[2:], 0))
    order = np.argsort(-rate, kind="stable")
    # Seeds found against alignments in vain, if words fell at random but eight times as dense.
    left = np.cumsum(rate[order][::-1])[::-1][:sure]
    more = np.arange(sure)[::-1]
    vain = np.array([k * np.log(8 * r * longest) - math.lgamma(k + 1) for k, r in zip(more.tolist(), left, strict=True)])
    out = int((left * (1 + COST * np.exp(np.minimum(vain, 0)))).argmin())
    at = np.sort(order[out:])
    two = at[at + 2 < len(w)]
    return np.unique(np.concatenate([link(w[at], w[at + 1]), link(w[two], w[two + 2])])), sure - out, longest


def _item_words(batches):
    """(item_no, text) to the hashes of the item's words."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        before, h = symbols(data, offsets)
        words = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("item_no"), words], ["item_no", "words"])


def _item_seeds(total: int, threshold: float):
    def run(batches):
        for batch in batches:
            words, need, reach, links = [], [], [], []
            for order in batch.column("counted").to_pylist():
                order.sort(key=lambda x: x["pos"])
                w = np.array([x["h"] for x in order], np.int64).view(np.uint64)
                share = np.array([(x["n"] + 1) / (total + 1) for x in order])
                found, n, longest = item_links(w, share, threshold)
                words.append(w.view(np.int64)), need.append(n), reach.append(longest), links.append(found.view(np.int64))
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item_no"), pa.array(need, pa.int32()), pa.array(reach, pa.int32()), pa.array(words, long), pa.array(links, long)], ["item_no", "need", "reach", "words", "links"])

    return run


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Which values the highest ``BITS`` bits of the hashes (column h) take."""
    found = hashes.select(F.shiftrightunsigned("h", 64 - BITS).cast("int").alias("b")).distinct().toArrow().column("b").to_numpy()
    out = np.zeros(1 << BITS, bool)
    out[found] = True
    return out


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    return bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)]


def _word_counts(shared):
    """(text) to (h, n): how often words occur that the bitmap may know, and under null how many words there are."""

    def run(batches):
        known, total = shared.value, 0
        h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in groups(offsets):
                w = symbols(data, offsets[i : j + 1])[1]
                total += len(w)
                u, c = np.unique(w[_in(known, w)], return_counts=True)
                h, at = np.unique(np.concatenate([h, u]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([n, c]), minlength=len(h)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([*h.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(n, total))], ["h", "n"])

    return run


def _hits(shared):
    """(key, text) to (key, h, place): seeds that the bitmap may know, once for each text of a task."""

    def run(batches):
        known, done = shared.value, set()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for i, j in groups(offsets):
                before, h = symbols(data, offsets[i : j + 1])
                text = np.repeat(np.arange(j - i), np.diff(before))
                fresh = np.array([k not in done and not done.add(k) for k in keys[i:j].tolist()], bool)
                for d in (1, 2):
                    g = link(h[:-d], h[d:])
                    at = np.flatnonzero(_in(known, g) & (text[d:] == text[: len(text) - d]))
                    at = at[fresh[text[at]]]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[i + text[at]]), pa.array(g[at].view(np.int64)), pa.array((at - before[text[at]]).astype(np.int32))], ["key", "h", "place"])

    return run


def find(a: np.ndarray, w: np.ndarray, places: np.ndarray, need: int, reach: int, threshold: float) -> tuple[float, int, int, int] | None:
    """Score, seeds, first word and end of the best place of an item in the words of one text, if it reaches the threshold."""
    full = np.flatnonzero(places[need - 1 :] - places[: len(places) - need + 1] < reach)
    live = np.zeros(len(places) + 1, np.int64)
    np.add.at(live, full, 1)
    np.add.at(live, full + need, -1)
    places = places[np.cumsum(live)[:-1] > 0].tolist()
    best = (0.0, 0, 0, 0)
    k = 0
    while k < len(places):
        j = k
        while j + 1 < len(places) and places[j + 1] - places[j] <= reach:
            j += 1
        lo, hi = max(0, places[k] - reach), min(len(w), places[j] + reach)
        score, end = align(a, w[lo:hi])
        best = max(best, (score / (MATCH * len(a)), j - k + 1, -lo, lo + end))
        k = j + 1
    return (best[0], best[1], -best[2], best[3]) if best[0] >= threshold else None


def _matches(threshold: float, carry: list[str]):
    """Texts with their candidates to those that align."""

    def run(batches):
        done: dict = {}
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            lists = batch.column("found")
            flat, first = lists.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
            need, reach = flat.field("need").to_numpy(), flat.field("reach").to_numpy()
            rows: list = []
            for i, key in enumerate(batch.column("key").to_pylist()):
                if key not in done:
                    w = symbols(data, offsets[i : i + 2])[1]
                    done[key] = []
                    for c in range(int(first[i]), int(first[i + 1])):
                        a = np.array(flat.field("words")[c].values, np.int64).view(np.uint64)
                        m = find(a, w, np.sort(np.array(flat.field("places")[c].values, np.int64)), int(need[c]), int(reach[c]), threshold)
                        if m:
                            done[key].append((c - int(first[i]), *m))
                rows += [(i, int(first[i]) + c, *m) for c, *m in done[key]]
            if rows:
                row, at, score, seeds, begin, end = zip(*rows, strict=True)
                item = flat.field("item_id").take(pa.array(at, pa.int64()))
                arrays = [*(batch.column(c).take(pa.array(row, pa.int64())) for c in carry), item, pa.array(score, pa.float64()), pa.array(seeds, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, [*carry, "item_id", "score", "n_seeds", "begin_word", "end_word"])

    return run


def seeded_items(benchmark: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """(item_no, item_id, need, reach, words, links) of the items of at least ``width`` words."""
    spark = texts.sparkSession
    rows = cut(benchmark.where(F.col("text").isNotNull()).select("item_id", "text"), "items").withColumn("item_no", F.monotonically_increasing_id())
    words = rows.select("item_no", "text").mapInArrow(_item_words, "item_no long, words array<long>").where(F.size("words") >= max(width, 2))
    words = cut(words.select("item_no", F.posexplode("words").alias("pos", "h")), "item-words")
    shared = spark.sparkContext.broadcast(_bitmap(words))
    counts = cut(texts.select("text").mapInArrow(_word_counts(shared), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "item-counts")
    shared.destroy()
    total = counts.where("h IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = words.join(counts, "h", "left").groupBy("item_no").agg(F.collect_list(F.struct("pos", "h", F.coalesce("n", F.lit(0)).alias("n"))).alias("counted"))
    seeds = counted.mapInArrow(_item_seeds(total, threshold), "item_no long, need int, reach int, words array<long>, links array<long>")
    return cut(seeds.join(rows.select("item_no", "item_id"), "item_no"), "seeds")


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = SCORE, width: int = LEAST, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pairs of a document and a test item that it holds a copy of, edited perhaps.

    Returns the ``carry`` columns of the document, item_id, score (of the best local alignment as a share of the item's
    full score; at least ``threshold``), n_seeds (seeds found there), and the words [begin_word, end_word) around the
    place. Case and punctuation don't count. Null and empty texts match nothing, nor do items of fewer than ``width``
    words. Repeated rows, of documents or items, give rows of their own. Ids may be of any type, and null. An empty
    table gives no rows. Other columns are ignored, whatever their names. The threshold must ask for more than one word
    of every item. Texts are told apart by a 64-bit hash.
    """
    spark = docs.sparkSession
    carry = list(carry)
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    read = docs.where(F.length("text") > 0).select(F.struct(*carry).alias("row"), "text", text_key().alias("key"))
    items = seeded_items(benchmark, read, threshold, width)
    seeds = items.select("item_no", "need", "reach", F.explode("links").alias("h"))
    shared = spark.sparkContext.broadcast(_bitmap(seeds))
    hits = read.select("key", "text").mapInArrow(_hits(shared), "key long, h long, place int")
    met = hits.join(seeds, "h").groupBy("key", "item_no").agg(F.first("need").alias("need"), F.first("reach").alias("reach"), F.sort_array(F.collect_set("place")).alias("places"))
    met = cut(met.where(F.expr("size(places) >= need AND exists(sequence(need - 1, size(places) - 1), i -> places[i] - places[i - need + 1] < reach)")), "met")
    shared.destroy()
    found = met.join(items.select("item_no", "item_id", "words"), "item_no")
    found = found.groupBy("key").agg(F.collect_list(F.struct("item_id", "need", "reach", "words", "places")).alias("found"))
    rows = read.join(found, "key").select(*[F.col("row")[c].alias(f"_{i}") for i, c in enumerate(carry)], "text", "key", "found")
    made = rows.mapInArrow(_matches(threshold, [f"_{i}" for i in range(len(carry))]), ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.select(*carry).schema)) + f", item_id {item_kind}, score double, n_seeds int, begin_word int, end_word int")
    return made.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)], "item_id", "score", "n_seeds", "begin_word", "end_word")
