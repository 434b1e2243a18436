"""Language identification by hierarchical discrimination.

Linear support vector machines over hashed byte n-grams: one against the rest chooses the language family, then
one-versus-one machines separate the languages within it, by vote.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.windows import buffers, groups

BITS, ORDERS, SCALE = 17, (2, 3, 4), 25.0
#: Labelled rows that the machines are fitted on: so many of a language, so many altogether.
PER_LANGUAGE, SAMPLE = 1500, 15000

FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi",
    "romance": "fr es it pt ro ca gl oc ast la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "iranian": "fa ku ps tg",
    "tai": "th lo",
    "sino-tibetan": "zh my bo",
    "austronesian": "id ms tl jv",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def family(lang: str) -> str:
    """The family of a language code; a code not known is a family of its own."""
    return FAMILY.get(lang.split("-")[0].split("_")[0].lower(), lang)


def grams(data: np.ndarray, bits: int = BITS):
    """For each order n, the hashed n-gram that begins at each byte."""
    x = data.astype(np.uint32)
    shift = np.uint32(32 - bits)
    out = []
    for n in ORDERS:
        if len(x) < n:
            out.append((n, np.zeros(0, np.int64)))
            continue
        h = np.full(len(x) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ x[i : len(x) - n + 1 + i]) * np.uint32(0x01000193 + 2 * 0x5BD1E9)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append((n, (h >> shift).astype(np.int64)))
    return out


@dataclass
class Machine:
    """What is learned: for each family against the rest and each pair of languages within a family, a weight vector."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    outer: np.ndarray | None = None
    inner: dict[str, np.ndarray] = field(default_factory=dict)
    bias_outer: np.ndarray | None = None
    bias_inner: dict[str, np.ndarray] = field(default_factory=dict)


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, c: float = 4.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Squared-hinge linear support vector machine by dual coordinate descent; rows are sparse, y is -1 or 1."""
    w, b = np.zeros(size, np.float64), 0.0
    alpha = np.zeros(len(rows))
    q = np.array([float(v.astype(np.float64) @ v) + 1.0 for _, v in rows]) + 1 / (2 * c)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            v = v.astype(np.float64)
            g = y[i] * (float(w[at] @ v) + b) - 1 + alpha[i] / (2 * c)
            new = max(alpha[i] - g / q[i], 0.0)
            d = (new - alpha[i]) * y[i]
            if d:
                w[at] += d * v
                b += d
                alpha[i] = new
    return w.astype(np.float32), b


def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], bits: int = BITS) -> Machine:
    """Machines from sparse rows and their languages."""
    m = Machine(families=sorted({family(x) for x in langs}))
    m.languages = {f: sorted({x for x in langs if family(x) == f}) for f in m.families}
    size = 1 << bits
    of = np.array([m.families.index(family(x)) for x in langs])
    if len(m.families) > 1:
        both = [fit_svm(rows, np.where(of == i, 1.0, -1.0), size) for i in range(len(m.families) if len(m.families) > 2 else 1)]
        if len(both) == 1:
            both.append((-both[0][0], -both[0][1]))
        m.outer, m.bias_outer = np.stack([w for w, _ in both]), np.array([b for _, b in both])
    lang = np.array(langs)
    for f, names in m.languages.items():
        if len(names) > 1:
            both = []
            for a, b in combinations(names, 2):
                at = np.flatnonzero((lang == a) | (lang == b))
                both.append(fit_svm([rows[i] for i in at], np.where(lang[at] == a, 1.0, -1.0), size))
            m.inner[f], m.bias_inner[f] = np.stack([w for w, _ in both]), np.array([b for _, b in both])
    return m


def _margins(weights: np.ndarray, bias: np.ndarray, hashed, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Margin of each text (rows) for each machine (columns); texts lie in the bytes that were hashed."""
    out = np.zeros((len(starts), len(weights)))
    count = np.zeros(len(starts))
    for n, h in hashed:
        stop = np.maximum(ends - n + 1, starts)
        count += stop - starts
        for j, w in enumerate(weights):
            total = np.zeros(len(h) + 1)
            np.cumsum(w[h], out=total[1:], dtype=np.float64)
            out[:, j] += total[np.minimum(stop, len(h))] - total[np.minimum(starts, len(h))]
    return out * (SCALE / np.maximum(count, 1))[:, None] + bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2 * x, -50, 50)))


def predict(m: Machine, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of texts that lie one after the other."""
    hashed = grams(data)
    n = len(starts)
    if m.outer is None:
        of, score = np.zeros(n, np.int64), np.ones(n)
    else:
        margin = _margins(m.outer, m.bias_outer, hashed, starts, ends)
        of = margin.argmax(axis=1)
        score = _sigmoid(margin[np.arange(n), of])
    lang = [""] * n
    for i, f in enumerate(m.families):
        at = np.flatnonzero(of == i)
        names = m.languages[f]
        if len(names) == 1 or not len(at):
            for k in at:
                lang[k] = names[0]
            continue
        margin = _margins(m.inner[f], m.bias_inner[f], hashed, starts[at], ends[at])
        votes, trust = np.zeros((len(at), len(names))), np.zeros((len(at), len(names)))
        for j, (a, b) in enumerate(combinations(range(len(names)), 2)):
            p = _sigmoid(margin[:, j])
            votes[:, a] += p >= 0.5
            votes[:, b] += p < 0.5
            trust[:, a] += p
            trust[:, b] += 1 - p
        best = (votes + trust / (2 * len(names))).argmax(axis=1)
        score[at] *= trust[np.arange(len(at)), best] / (len(names) - 1)
        for k, x in zip(at, best, strict=True):
            lang[k] = names[x]
    return lang, score


def _sparse(batches):
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        at, val = [], []
        for i in range(batch.num_rows):
            total = np.zeros(1 << BITS, np.float32)
            count = 0
            for lo in range(int(offsets[i]), int(offsets[i + 1]), 1 << 20):
                for n, h in grams(data[lo : min(int(offsets[i + 1]), lo + (1 << 20) + ORDERS[-1] - 1)]):
                    h = h[: 1 << 20]
                    total += np.bincount(h, minlength=1 << BITS)
                    count += len(h)
            k = np.flatnonzero(total)
            at.append(k.astype(np.int32))
            val.append(total[k] * np.float32(SCALE / max(count, 1)))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["lang", "at", "val"])


def sample_rows(labelled: DataFrame, label: str, each: int, most: int) -> DataFrame:
    """A bounded sample of distinct (text, label) rows, about ``each`` of a label and ``most`` altogether, by hash of the text.

    The same rows whatever their order or layout; copies are one row.
    """
    spot = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = {r[0]: r[1] for r in labelled.groupBy(label).agg(F.count(F.lit(1))).collect()}
    each = min(each, max(1, most // max(1, len(counts))))
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, each / n))).otherwise(share)
    return labelled.where(spot < share).groupBy(F.xxhash64("text").alias("_h"), label).agg(F.first("text").alias("text")).drop("_h")


def learn(docs: DataFrame, usable: Column, each: int = PER_LANGUAGE, most: int = SAMPLE) -> Machine:
    """Machines fitted on a bounded sample of the rows with a language, a letter and ``usable``."""
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang")
    rows = sample_rows(labelled, "lang", each, most).mapInArrow(_sparse, "lang string, at array<int>, val array<float>").toArrow()
    langs, out = [], []
    for batch in rows.to_batches():  # views of what arrived, never a second copy
        langs += batch.column("lang").to_pylist()
        for a, v in zip(batch.column("at"), batch.column("val"), strict=True):
            out.append((a.values.to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False)))
    order = sorted(range(len(langs)), key=lambda i: (langs[i], len(out[i][0]), out[i][0][:8].tolist(), float(out[i][1].sum()), out[i][1][:4].tolist()))
    return fit([out[i] for i in order], [langs[i] for i in order])


def _predict(machine, carry: list[str]):
    def run(batches):
        m = machine.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            letter = batch.column("_letter").to_numpy(zero_copy_only=False)
            lang, score = [], []
            for i, j in groups(offsets):
                names, s = predict(m, data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i])
                lang += names
                score.append(s)
            known = letter.astype(bool) if m.families else np.zeros(len(lang), bool)
            lang = [x if k else "und" for x, k in zip(lang, known, strict=True)]
            score = np.where(known, np.concatenate(score), 0.0) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*carry, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, machine: Machine, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of each row, lang_pred and score (0 to 1, of the language predicted).

    Whole texts are scored. A null text or one without a letter is ``und`` with score 0, as is every text if nothing
    was learned. Repeated rows are scored alike. An empty table gives no rows. Other columns are ignored.
    """
    carry = list(carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    read = docs.select(*carry, letter.alias("_letter"), *([] if "text" in carry else [F.col("text")]))
    return read.mapInArrow(_predict(shared, carry), f"{kinds}, lang_pred string, score double")
