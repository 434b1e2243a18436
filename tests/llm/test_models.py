"""Operators 2, 3 and 8: held-out accuracy, exact base scores and odd inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import langid, queries, suffix_tree, toxicity
from folioflow.llm.split import held_out
from folioflow.llm.windows import word_symbols

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    rows = queries.queries()["op3_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_odd_rows(spark, docs, texts, no_docs):
    m = langid.learn(docs, ~held_out())
    rows = langid.identify(docs, m).collect()
    got = Counter((r.doc_id, r.lang_pred) for r in rows)
    letter = re.compile(r"[^\W\d_]")
    assert got == Counter((i, "en" if letter.search(t or "") else "und") for i, t in texts)
    nothing = langid.learn(no_docs, ~held_out())
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(no_docs, m).count() == 0


def test_toxicity_accuracy(spark):
    rows = queries.queries()["op2_toxicity"](spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    known = [r for r in rows if r.doc_id in labels]
    assert sum(labels[r.doc_id] == r.predicted for r in known) / len(known) > 0.93


def test_toxicity_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, 0), (3, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for d, n in ((docs, docs.count()), (no_docs, 0)):
        m = toxicity.learn(d, labels, ~held_out())
        rows = toxicity.score(d, m).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs, toxicity.learn(docs, labels.limit(0), ~held_out())).count() == docs.count()
    clashing = docs.withColumn("toxic", F.lit(7)).withColumn("quality", F.lit(None).cast("int"))
    assert toxicity.score(clashing, toxicity.learn(clashing, labels, ~held_out())).count() == docs.count()


def test_label_model_weighs_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.15
    good = [np.where(rng.random(4000) < 0.9, y, ~y).astype(np.int8) for _ in range(4)]
    noise = (rng.random(4000) < 0.3).astype(np.int8)
    v = np.stack([*good, noise, noise, noise, np.full(4000, -1, np.int8)], axis=1)
    m = toxicity.fit_label_model(v)
    assert ((m.posterior(v) > 0.5) == y).mean() > 0.95
    assert m.weight[4:7].max() < 0.5 < m.weight[:4].min()  # three voters that say the same count as one


@pytest.mark.parametrize("head", [600_000, 40])
def test_base_score(spark, docs, texts, head):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in texts]
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
    counts: Counter = Counter()
    for w, h in zip(words, held):
        if not h:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, len(w) + 1, sum(x in counts for x in [*w, None]), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, None]), 4)) for (i, _), w in zip(texts, words))
    rows = suffix_tree.score(docs, suffix_tree.learn(docs, ~held_out(7, 2), head=head)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_head_size_does_not_change_scores(spark, docs):
    a, b = (sorted((str(r.doc_id), round(r.score, 6)) for r in suffix_tree.score(docs, suffix_tree.learn(docs, ~held_out(7, 2), head=h)).collect()) for h in (1_000_000, 40))
    assert a == b


def _follow(seqs, depth):
    """Of sequences of symbols, each with how often it occurs, the counts of symbols after contexts; the first symbol isn't predicted."""
    out: dict = {}
    for seq, n in seqs:
        for i in range(1, len(seq)):
            for k in range(min(depth, i) + 1):
                out.setdefault(seq[i - k : i], Counter())[seq[i]] += n
    return {s: Counter({x: n for x, n in row.items() if n >= 2}) for s, row in out.items()}


def _speller(words, divergence=suffix_tree.DIVERGENCE, d=suffix_tree.DISCOUNT):
    follow = {s: row for s, row in _follow([(b" " + w + b" ", n) for w, n in words.items()], suffix_tree.DEPTH).items() if row}
    root = follow.pop(b"", Counter())
    keep = {b"", b" "}
    for s, row in follow.items():
        t = s[1:]
        while t and t not in follow:
            t = t[1:]
        parent = follow[t] if t else root
        n, m = sum(row.values()), sum(parent.values()) + 0.256
        if sum(c * math.log2(c / n / ((parent[x] + 1e-3) / m)) for x, c in row.items()) >= divergence:
            keep |= {s[i:j] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}

    def p(s, x):
        if not s:
            return (root[x] + 1) / (sum(root.values()) + 256)
        row = follow.get(s)
        n = sum(row.values()) if row else 0
        if not n:
            return p(s[1:], x)
        used = {y: max(c - d, 0) for y, c in row.items()}
        return (used.get(x, 0) + (n - sum(used.values())) * p(s[1:], x)) / n

    def spell(w):
        total, text = 0.0, b" " + w + b" "
        for i in range(1, len(text)):
            state = next(text[k:i] for k in range(i + 1) if text[k:i] in keep)
            total += math.log10(p(state, text[i]))
        return total

    return spell


def _brute_scores(train, texts, gain, divergence, d=suffix_tree.DISCOUNT, spelled=suffix_tree.SPELLED):
    """Score of each text under a model of (words, lang) pairs, by dictionaries alone."""
    langs = [x for x, _ in sorted(Counter(lang for _, lang in train).items(), key=lambda x: (-x[1], x[0]))]
    by = [Counter(x for w, lang in train if lang == k for x in [*w, b""]) for k in langs] + [Counter()]
    c: Counter = sum(by, Counter())
    size, v = [sum(x.values()) for x in by], len(c)
    spell = [_speller(x, divergence) for x in by]
    prior = [math.log10((n + 1) / (sum(size) + len(by))) for n in size]
    pairs = Counter(p for w, _ in train for p in zip([b"", *w], [*w, b""]))
    three = Counter(t for w, _ in train for t in zip([b"", *w], w, [*w[1:], b""]))

    def base(u, x):
        return sum(by[k][u] / c[u] * (by[k][x] + 1) / (size[k] + v) for k in range(len(by)))

    def states(counts, total, shorter):
        found: dict = {}
        for (*s, x), n in counts.items():
            s = tuple(s)
            if n >= 2 and n * math.log2((n - d) / total(s) / shorter(s, x)) >= gain:
                found.setdefault(s, {})[x] = n
        out = {}
        for s, row in found.items():
            t = total(s)
            rest = 1 - sum((n - d) / t for n in row.values())
            g = sum(n * math.log2(((n - d) / t + rest * shorter(s, x)) / shorter(s, x)) for x, n in row.items())
            if g + (t - sum(row.values())) * math.log2(rest) >= divergence:
                out[s] = ({x: (n - d) / t for x, n in row.items()}, rest)
        return found, out

    found, one = states(pairs, lambda s: c[s[0]], lambda s, x: base(s[0], x))

    def under_one(s, x):
        own, rest = one.get(s[1:], ({}, 1.0))
        return own.get(x, 0) + rest * base(s[1], x)

    _, two = states({k: n for k, n in three.items() if k[1] in found.get(k[:1], {})}, lambda s: pairs[s], under_one)
    scores = []
    for w in texts:
        seen, total = [0.0] * len(by), 0.0
        for i, x in enumerate([*w, b""]):
            k = max(range(len(by)), key=lambda j: (seen[j] + prior[j], -j))
            p = (1 - spelled) * by[k][x] / max(size[k], 1) + spelled * 10 ** spell[k](x)
            for n, table in ((1, one), (2, two)):
                s = tuple([b"", *w][i + 1 - n : i + 1]) if i + 1 >= n else None
                if s in table:
                    p = table[s][0].get(x, 0) + table[s][1] * p
            total += math.log10(p)
            seen = [a + f(x) for a, f in zip(seen, spell)]
        scores.append(total)
    return scores, len(one), len(two)


@pytest.mark.parametrize("head", [600_000, 5])
def test_score_by_brute_force(spark, head):
    rng = random.Random(4)
    phrases = ["the old mill by the river", "a cup of hot tea", "by the river we sat", "the cup by the tea"]
    tail = ["der alte weg am fluss", "am fluss der alte"]
    rows = [(i, " ".join(rng.choice(tail if i % 4 == 0 else phrases) + rng.choice(["", " Xy", " zebra" + "abc"[i % 3]]) for _ in range(rng.randrange(8))), "de" if i % 4 == 0 else "en") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = [t.lower().encode().split() for _, t, _ in rows]
    train = [(w, lang) for w, (i, _, lang) in zip(words, rows) if zlib.crc32(str(i).encode()) % 7 != 2]
    want, n_one, n_two = _brute_scores(train, words, 4.0, 12.0)
    assert n_one > 5 and n_two > 5
    model = suffix_tree.learn(docs, ~held_out(7, 2), gain=4.0, divergence=12.0, support=2, head=head)
    got = {r.doc_id: r.score for r in suffix_tree.score(docs, model).collect()}
    assert [round(got[i], 2) for i in range(160)] == [round(x, 2) for x in want]
    assert [len(x.states.keys) for x in model.contexts] == [n_one, n_two]


@pytest.mark.parametrize("transitions", [200_000, 3, 0])
def test_no_transition_is_dropped(spark, transitions):
    """What isn't broadcast is joined: scores are those of the whole model, in copies, null texts and an unknown language too."""
    rng = random.Random(5)
    phrases = ["the old mill by the river", "a cup of hot tea", "by the river we sat", "the cup by the tea", "der alte weg am fluss"]
    rows = [(i, " ".join(rng.choice(phrases) + rng.choice(["", " Xy", f" z{i % 11}"]) for _ in range(rng.randrange(6))), "de" if i % 5 == 0 else "en") for i in range(120)]
    docs = spark.createDataFrame([*rows, *[(200 + i, rows[7][1], "en") for i in range(30)], (300, None, "en")], "doc_id long, text string, lang string").repartition(3)
    everything = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    words = [t.lower().encode().split() for _, t, _ in everything]
    train = [(w, lang) for w, (i, _, lang) in zip(words, everything) if zlib.crc32(str(i).encode()) % 7 != 2]
    want, n_one, n_two = _brute_scores(train, words, 4.0, 12.0)
    assert n_one > 5 and n_two > 5
    model = suffix_tree.learn(docs, ~held_out(7, 2), gain=4.0, divergence=12.0, support=2, head=4, transitions=transitions)
    assert all(len(x.keys.keys) <= transitions and len(x.states.keys) <= transitions for x in model.contexts)
    got = {r.doc_id: r.score for r in suffix_tree.score(docs, model).collect()}
    assert {i: round(got[i], 2) for i in got} == {i: round(x, 2) for (i, _, _), x in zip(everything, want)}


def test_pairs_take_four_bytes_and_frequent_ones_are_all_found():
    """A row for each pair took more disk than all else; packed, no pair that is frequent over all tasks may be missed."""
    rng = np.random.default_rng(5)
    tasks = [[" ".join(f"w{i}" for i in rng.integers(0, 150, 3000)) for _ in range(4)] for _ in range(3)]
    packed, n = [], Counter()
    for texts in tasks:
        batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.zeros(len(texts), np.int8))], ["text", "tree"])
        rows = [r for out in suffix_tree._counts(1, 3)(iter([batch])) for r in out.to_pylist() if r["tree"] < 0]
        assert sum(len(r["word"]) for r in rows) <= 4 * sum(len(t.split()) + 1 for t in texts) and len(rows) <= 1 << suffix_tree.BUCKET
        packed += rows
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            _, _, before, h = word_symbols(data, np.array([0, len(data)]))
            token, last, _, _ = suffix_tree.token_stream(h, before)
            n.update(suffix_tree.pair(last, token).tolist())
    packed.sort(key=lambda r: r["h"])
    table = pa.table({"h": [r["h"] for r in packed], "word": pa.array([r["word"] for r in packed], pa.binary())})
    got = {(a, b) for out in suffix_tree._frequent(3)(iter(table.to_batches(max_chunksize=100))) for a, b in zip(out["at"].to_pylist(), out["bits"].to_pylist(), strict=True)}
    want = Counter()
    for k in {k >> (64 - suffix_tree.BITS) for k, m in n.items() if m >= 3}:
        want[k >> 6] |= 1 << (k & 63)
    assert 0 < len(want) and {a: b % 2**64 for a, b in got} == dict(want)


@pytest.mark.parametrize("slices", [1, 5])
def test_slices_and_copies_do_not_change_scores(spark, docs, slices, monkeypatch):
    """Texts meet what they need slice by slice, in batches that may end between a text and its rows; a text's copies are dealt out."""
    model = suffix_tree.learn(docs, ~held_out(7, 2), gain=4.0, divergence=12.0, support=2, head=4, transitions=0)
    many = docs.unionAll(docs)
    a, b = (sorted((str(r.doc_id), round(r.score, 6)) for r in x.collect()) for x in (suffix_tree.score(many, model), suffix_tree.score(docs, model, slices=slices)))
    assert a == sorted(b + b) and len(b) == docs.count()
    monkeypatch.setattr(suffix_tree, "ROWS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        c = sorted((str(r.doc_id), round(r.score, 6)) for r in suffix_tree.score(docs, model, slices=slices).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert b == c


def test_no_state_of_a_spelling_tree_is_dropped():
    letters = b"abcdefghijklmnopqrstuvwxyz"
    words = [bytes((a, b, c, letters[zlib.crc32(bytes((a, b, c))) % 26])) for a in letters for b in letters for c in letters]
    key, n = suffix_tree.ngrams(np.full(len(words), 4), np.full(len(words), 100), np.frombuffer(b"".join(words), np.uint8))
    tree = suffix_tree.build_tree(key, n)
    assert {w[:3] for w in words} <= set(tree.contexts)


def test_words_before_matter(spark):
    """What follows a phrase of the training texts is likelier than the same words in another order."""
    docs = spark.createDataFrame([(i, "one two three four five six seven eight", "en") for i in range(60)] + [(1000 + i, f"w{i} x{i % 7} y{i % 5}", "en") for i in range(200)], "doc_id long, text string, lang string")
    probe = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "five one eight three seven two six four")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree.score(probe, suffix_tree.learn(docs, ~held_out(7, 2))).collect()}
    assert got[1] > got[2] + 5


def test_nothing_to_learn(spark, docs, no_docs):
    rows = suffix_tree.score(docs, suffix_tree.learn(no_docs, ~held_out(7, 2))).collect()
    assert len(rows) == docs.count() and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)
    assert suffix_tree.score(no_docs, suffix_tree.learn(docs, ~held_out(7, 2))).count() == 0


def test_tree_is_a_distribution():
    rng = random.Random(0)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(4000)]
    size = np.array([len(w) for w in words])
    key, n = suffix_tree.ngrams(size, np.ones(len(words), np.int64), np.frombuffer(b"".join(words), np.uint8))
    tree = suffix_tree.build_tree(key, n, 2.0)
    columns = np.bincount(tree.symbol, minlength=tree.log.shape[1])
    assert len(tree.contexts) > 20 and np.allclose((10.0**tree.log * columns).sum(axis=1), 1, atol=1e-4)
    # The state after each byte is the longest suffix that is a state.
    states = {s: i for i, s in enumerate(tree.contexts)}
    text, at = b" abcabcaab", tree.start
    for i in range(1, len(text)):
        at = int(tree.goto[at, tree.symbol[text[i]]])
        assert at == next(states[text[k : i + 1]] for k in range(i + 2) if text[k : i + 1] in states)
