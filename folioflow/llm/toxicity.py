"""Toxicity by weak supervision.

Many voters look at a document and vote toxic, clean or not at all: lexicons mined from labelled rows, lexicons
written by hand, densities and surface patterns. A generative model estimates, without labels, how often each voter
is right and which voters say the same thing, and gives every sampled document a posterior. A linear classifier
learns the posteriors and scores whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.langid import sample_rows
from folioflow.llm.windows import BYTE_SYMBOL, TOP, buffers, groups, lower, mix, powers, prefix
from folioflow.session import cut

BITS, PREFIXES = 20, (3, 4, 5, 6, 7, 8, 10)
#: Labelled rows the lexicons are mined from, for each label; rows, labelled or not, that the label model sees; stems kept.
LABELLED, UNLABELLED, STEMS, MINED = 4000, 4000, 1500, 12

HAND = {
    "en": "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumb fool bastard bitch asshole fuck shit whore slut retard pig vermin",
    "fr": "idiote connard connasse salaud salope merde putain abruti crétin débile ordure minable",
    "de": "idioten arschloch scheiße dumm dummkopf trottel schwein hurensohn abschaum versager widerlich",
    "es": "idiota imbécil estúpido pendejo cabrón mierda puta basura asqueroso inútil patético",
}
N_SURFACE = 5

_letter = np.zeros(256, bool)
_letter[97:123] = True
_letter[128:] = True


def word_features(data: np.ndarray, ends: np.ndarray):
    """Hashed prefixes and whole words of texts that lie one after the other: (text of each feature, bucket), and words per text."""
    x = lower(data)
    letter = np.zeros(len(x) + 2, np.int8)
    letter[1:-1] = _letter[x]
    d = np.diff(letter)
    b, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    cuts = ends[:-1]
    if len(cuts) and len(b):
        i = np.searchsorted(b, cuts, "left") - 1
        inside = (i >= 0) & (cuts < e[i]) & (cuts > b[i])
        if inside.any():
            extra = np.unique(cuts[inside])
            b, e = np.sort(np.append(b, extra)), np.sort(np.append(e, extra))
    p, inv = prefix(BYTE_SYMBOL[x]), powers()[1]
    text = np.searchsorted(ends, b, "right")
    size = e - b
    at, bucket = [text], [mix((p[e] - p[b]) * inv[b] + np.uint64(1)) >> np.uint64(64 - BITS)]
    for n in PREFIXES:
        k = np.flatnonzero(size > n)
        at.append(text[k])
        bucket.append(mix((p[b[k] + n] - p[b[k]]) * inv[b[k]]) >> np.uint64(64 - BITS))
    return np.concatenate(at), np.concatenate(bucket).astype(np.int64), np.bincount(text, minlength=len(ends))


def word_bucket(word: str) -> int:
    raw = np.frombuffer(word.lower().encode(), np.uint8)
    return int(mix(np.array([prefix(BYTE_SYMBOL[raw])[-1] + np.uint64(1)]))[0] >> np.uint64(64 - BITS))


def surface(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Surface counts of each text: letters A-Z, exclamation marks, doubled symbols, digits, bytes."""
    starts = np.concatenate(([0], ends[:-1]))
    out = []
    for hit in ((data >= 65) & (data <= 90), data == 33, np.append((data[1:] == data[:-1]) & (data[1:] > 32) & (data[1:] < 65), [False])[: len(data)], (data >= 48) & (data <= 57), np.ones(len(data), bool)):
        total = np.concatenate(([0], np.cumsum(hit)))
        out.append(total[ends] - total[starts])
    return np.stack(out, axis=1)


def pieces(data: np.ndarray, offsets: np.ndarray):
    """Ranges of texts with their bytes; a text of over a million bytes comes in parts cut at white space, under the same number."""
    for i, j in groups(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= TOP:
            yield i, data[lo:hi], offsets[i + 1 : j + 1] - lo
            continue
        while lo < hi:
            to = min(hi, lo + TOP)
            if to < hi:
                gap = np.flatnonzero(data[lo:to] <= 32)
                to = lo + int(gap[-1]) + 1 if len(gap) else to
            yield i, data[lo:to], np.array([to - lo])
            lo = to


def _counts(batches):
    """(text, toxic) to (bucket, toxic texts, texts) summed over the rows that a task reads."""
    toxic, both = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        last = (-1, set())
        for i, x, ends in pieces(data, offsets):
            text, bucket, _ = word_features(x, ends)
            seen = np.unique((text << BITS) | bucket)
            text, bucket = seen >> BITS, seen & ((1 << BITS) - 1)
            if len(ends) == 1:  # perhaps a part of a text
                old = last[1] if last[0] == i else set()
                bucket = np.array([k for k in bucket.tolist() if k not in old], np.int64)
                text = np.zeros(len(bucket), np.int64)
                last = (i, old | set(bucket.tolist()))
            np.add.at(both, bucket, 1)
            np.add.at(toxic, bucket[label[i + text] == 1], 1)
    at = np.flatnonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(toxic[at].astype(np.int64)), pa.array(both[at].astype(np.int64))], ["bucket", "toxic", "n"])


@dataclass
class Lexicon:
    """Buckets that count, by place; the voter that each mined stem belongs to; hand-written words."""

    buckets: np.ndarray
    owner: np.ndarray  # mined voter of each bucket, or MINED + i for the i-th list written by hand

    def lookup(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out


def hits(lexicon: Lexicon, lookup: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """For the texts of a batch: (text, stem, count) of every stem that occurs, words and surface counts."""
    n = len(offsets) - 1
    key, words, look = [], np.zeros(n, np.int64), np.zeros((n, N_SURFACE), np.int64)
    for i, x, ends in pieces(data, offsets):
        text, bucket, count = word_features(x, ends)
        stem = lookup[bucket]
        on = np.flatnonzero(stem >= 0)
        key.append(((i + text[on]) * len(lexicon.buckets) + stem[on]).astype(np.int64))
        words[i : i + len(ends)] += count
        look[i : i + len(ends)] += surface(x, ends)
    both, count = np.unique(np.concatenate(key), return_counts=True) if key else (np.zeros(0, np.int64),) * 2
    size = max(1, len(lexicon.buckets))
    return both // size, both % size, count, words, look


def votes(lexicon: Lexicon, text, stem, count, words: np.ndarray, look: np.ndarray) -> np.ndarray:
    """Votes of every voter on every text: 1 toxic, 0 clean, -1 none."""
    n = len(words)
    owner = lexicon.owner[stem] if len(stem) else np.zeros(0, np.int64)
    per = np.zeros((n, MINED + len(HAND)), np.int64)
    np.add.at(per, (text, owner), count)
    total, mined = per.sum(axis=1), per[:, :MINED].sum(axis=1)
    rate = total / np.maximum(words, 1)
    size = np.maximum(look[:, 4], 1)
    out = [np.where(per[:, k] > 0, 1, -1) for k in range(per.shape[1])]
    out.append(np.where(rate >= 0.01, 1, np.where(total == 0, 0, -1)))
    out.append(np.where(total >= 3, 1, np.where(total == 0, 0, -1)))
    out.append(np.where((per > 0).sum(axis=1) >= 2, 1, np.where(mined == 0, 0, -1)))
    out.append(np.where((total == 1) & (words > 1500), 0, -1))
    for k, much in ((0, 0.3), (1, 0.02), (2, 0.05), (3, 0.2)):
        out.append(np.where((look[:, k] / size > much) & (words > 5), 1, -1))
    return np.stack(out, axis=1).astype(np.int8)


@dataclass
class LabelModel:
    """How voters vote given the class, and how much each voter counts next to those it agrees with anyway."""

    prior: float
    table: np.ndarray  # class, voter, vote + 1
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        log = np.log(self.table[1] / self.table[0])
        score = np.log(self.prior / (1 - self.prior)) + sum(self.weight[j] * log[j, v[:, j] + 1] for j in range(v.shape[1]))
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def fit_label_model(v: np.ndarray, prior: float = 0.1, rounds: int = 40) -> LabelModel:
    """Expectation maximisation over the class; correlations given the class weigh voters down that repeat each other."""
    n, k = v.shape
    hot = np.stack([(v == x) for x in (-1, 0, 1)], axis=2).astype(np.float64)
    side = hot[:, :, 2] - hot[:, :, 1]
    # Voters that repeat each other outright count once from the start.
    x = side - side.mean(axis=0)
    size = np.sqrt(np.maximum((x * x).sum(axis=0), 1e-12))
    same = np.abs(x.T @ x / np.outer(size, size)) > 0.8
    np.fill_diagonal(same, True)
    m = LabelModel(prior, np.full((2, k, 3), 1 / 3), 1 / same.sum(axis=1), np.eye(k))
    q = np.clip(1 / (1 + np.exp(-2 * side @ m.weight)), 0.05, 0.95)
    for step in range(rounds):
        for y, w in ((0, 1 - q), (1, q)):
            m.table[y] = (np.einsum("i,ijx->jx", w, hot) + 0.5) / (w.sum() + 1.5)
        m.prior = float(np.clip(q.mean(), 0.01, 0.6))
        if step % 5 == 4:
            corr = np.zeros((k, k))
            for w, y in ((1 - q, 0), (q, 1)):
                x = hot[:, :, 2] - hot[:, :, 1]
                x = (x - (m.table[y][:, 2] - m.table[y][:, 1])) * np.sqrt(w / max(w.sum(), 1e-9))[:, None]
                c = x.T @ x
                s = np.sqrt(np.maximum(np.diag(c), 1e-12))
                corr += 0.5 * np.abs(c / np.outer(s, s))
            np.fill_diagonal(corr, 1.0)
            m.correlation = corr
            m.weight = 1 / np.maximum(1.0, np.where(corr > 0.1, corr, 0).sum(axis=1))
            m.weight = np.maximum(m.weight, 0.15)
        q = m.posterior(v)
    return m


def design(n_stems: int, text, stem, count, words: np.ndarray) -> np.ndarray:
    """Columns of the linear classifier: stems present, and how many hits there are, alone and to the words."""
    x = np.zeros((len(words), n_stems + 3), np.float32)
    x[text, stem] = np.minimum(count, 3) / 3
    total = np.bincount(text, weights=count, minlength=len(words))
    kinds = np.bincount(text, minlength=len(words))
    x[:, n_stems] = np.log1p(total)
    x[:, n_stems + 1] = np.minimum(total / np.maximum(words, 1) * 50, 2)
    x[:, n_stems + 2] = np.log1p(kinds)
    return x


def fit_linear(x: np.ndarray, q: np.ndarray, l2: float = 1e-3, rounds: int = 400, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression on posteriors, by accelerated full gradient steps."""
    w = np.zeros(x.shape[1], np.float32)
    b = float(np.log(max(q.mean(), 1e-3) / max(1 - q.mean(), 1e-3)))
    z, zb, last = w.copy(), b, 1.0
    bound = 0.25 * float((x * x).sum(axis=1).mean() * 3 + 1) + l2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ z + zb, -40, 40)))
        d = (p - q).astype(np.float32) / len(q)
        new, nb = z - rate / bound * (x.T @ d + l2 * z), zb - rate / bound * float(d.sum())
        t = (1 + (1 + 4 * last * last) ** 0.5) / 2
        z, zb = new + (last - 1) / t * (new - w), nb + (last - 1) / t * (nb - b)
        w, b, last = new, nb, t
    return w, b


@dataclass
class Model:
    lexicon: Lexicon
    label_model: LabelModel | None
    weight: np.ndarray
    bias: float


def _hits(shared):
    def run(batches):
        lexicon = shared.value
        lookup = lexicon.lookup()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            text, stem, count, words, look = hits(lexicon, lookup, data, offsets)
            cut_at = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut_at), pa.array(v.astype(np.int32))) for v in (stem, count)]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(look.ravel()), N_SURFACE).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("_h"), *lists, pa.array(words), flat], ["_h", "stem", "count", "words", "look"])

    return run


def mine(labelled: DataFrame, each: int = LABELLED, stems: int = STEMS) -> Lexicon:
    """Lexicon from a bounded sample of labelled rows (text, toxic): the stems that tell toxic texts best."""
    rows = sample_rows(labelled, "toxic", each, 2 * each)
    total = rows.groupBy("toxic").agg(F.count(F.lit(1))).collect()
    total = {r[0]: r[1] for r in total}
    counts = rows.mapInArrow(_counts, "bucket int, toxic long, n long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    pos, neg = total.get(1, 0), total.get(0, 0)
    rate = F.log((F.col("toxic") + 0.1) / (pos + 0.2)) - F.log((F.col("n") - F.col("toxic") + 0.1) / (neg + 0.2))
    found = counts.where("toxic >= 4").withColumn("rate", rate).where("rate > 2.5")
    best = found.orderBy((F.col("rate") * F.sqrt("toxic")).desc(), "bucket").limit(stems).select("bucket").collect()
    buckets = [r["bucket"] for r in best]
    owner = [i % MINED for i in range(len(buckets))]
    for i, words in enumerate(HAND.values()):
        for w in words.split():
            k = word_bucket(w)
            if k not in buckets:
                buckets.append(k)
                owner.append(MINED + i)
    return Lexicon(np.array(buckets, np.int64), np.array(owner, np.int64))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, each: int = LABELLED, unlabelled: int = UNLABELLED) -> Model:
    """Model from bounded samples: labelled usable rows for the lexicons, any usable rows for the label model and the classifier.

    Null texts and labels other than 0 and 1 are left out; of several labels of a doc_id the greatest holds, and a null
    doc_id meets none. Repeated texts count once. Columns besides doc_id, text and toxic are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    usable_docs = docs.where(usable & F.col("text").isNotNull()).select("doc_id", "text")
    # The labels are sampled before they meet the texts: at most about 2 * each rows, so no text is moved but theirs.
    known = labels.where(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").agg(F.count(F.lit(1))).collect()}
    spot = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, each / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, each / max(1, sizes.get(0, 0)))))
    picked = known.where(spot < share)
    labelled = usable_docs.join(F.broadcast(picked), "doc_id").select("text", "toxic")
    labelled = cut(sample_rows(labelled, "toxic", 2 * each, 4 * each), "toxicity-labelled")
    lexicon = mine(labelled, 2 * each)
    shared = spark.sparkContext.broadcast(lexicon)
    others = sample_rows(usable_docs.select("text", F.lit(0).alias("any")), "any", unlabelled, unlabelled).select("text")
    seen = labelled.select("text").unionByName(others).select(F.xxhash64("text").alias("_h"), "text").dropDuplicates(["_h"])
    rows = seen.mapInArrow(_hits(shared), "_h long, stem array<int>, count array<int>, words long, look array<long>").toArrow().combine_chunks().sort_by("_h")
    n_stems = len(lexicon.buckets)
    if not rows.num_rows:
        return Model(lexicon, None, np.zeros(n_stems + 3, np.float32), 0.0)
    stem, count = rows.column("stem").combine_chunks(), rows.column("count").combine_chunks()
    text = np.repeat(np.arange(rows.num_rows), np.diff(stem.offsets.to_numpy()))
    stem, count = stem.flatten().to_numpy(), count.flatten().to_numpy()
    words = rows.column("words").to_numpy()
    look = rows.column("look").combine_chunks().flatten().to_numpy().reshape(-1, N_SURFACE)
    v = votes(lexicon, text, stem, count, words, look)
    m = fit_label_model(v)
    weight, bias = fit_linear(design(n_stems, text, stem, count, words), m.posterior(v))
    return Model(lexicon, m, weight, bias)


def _score(shared, carry: list[str]):
    def run(batches):
        m = shared.value
        lookup = m.lexicon.lookup()
        n_stems = len(m.lexicon.buckets)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            text, stem, count, words, _ = hits(m.lexicon, lookup, data, offsets)
            total = np.bincount(text, weights=count, minlength=len(words))
            kinds = np.bincount(text, minlength=len(words))
            z = m.bias + np.bincount(text, weights=m.weight[stem] * np.minimum(count, 3) / 3, minlength=len(words))
            z = z + m.weight[n_stems] * np.log1p(total) + m.weight[n_stems + 1] * np.minimum(total / np.maximum(words, 1) * 50, 2) + m.weight[n_stems + 2] * np.log1p(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], [*carry, "score"])

    return run


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and score (0 to 1, higher: toxic likelier) of each row, over the whole text.

    Null and empty texts get the score of a text without any hit. Repeated rows score alike. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    carry = list(carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*carry, *([] if "text" in carry else ["text"])).mapInArrow(_score(shared, carry), f"{kinds}, score double")
