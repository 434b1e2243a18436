"""Operators 4, 6 and 10, the pipeline and the template language."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioflow.llm import chat, decontaminate, packing
from folioflow.llm.template import TemplateError, compile_template
from folioflow.session import table


def words(rng, n):
    return [rng.choice("qwertzuiopasdfghjklyxcvbnm") + rng.choice(["elo", "ira", "ost", "unt", "ame"]) + str(rng.randrange(300)) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(9)
    items = [words(rng, 40) for _ in range(6)]
    clean = [(i, " ".join(words(rng, 200))) for i in range(40)]
    edited = [w if rng.random() > 0.2 else "changed" for w in items[1]]
    docs = [
        *clean,
        (100, " ".join(words(rng, 50) + items[0] + words(rng, 50))),
        (101, " ".join(words(rng, 3000) + edited + words(rng, 9))),
        (102, ", ".join(x.upper() for x in items[2])),
        (103, " ".join(items[3] + items[4])),
        (103, " ".join(items[3] + items[4])),
        (104, None),
        (105, ""),
        (106, " ".join(items[5][:6] + words(rng, 60))),
        (None, " ".join(items[0])),
    ]
    benchmark = [(i, " ".join(w), "x") for i, w in enumerate(items)] + [(50, None, "x"), (51, "", "x"), (52, "one two", "x")]
    left = spark.createDataFrame([(a, b, 1, 1.0) for a, b in docs], "doc_id long, text string, item_id int, score double")
    right = spark.createDataFrame(benchmark, "item_id long, text string, doc_id string")
    want = Counter([(100, 0), (101, 1), (102, 2), (103, 3), (103, 4), (103, 3), (103, 4), (None, 0)])
    got = decontaminate.matches(left, right).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == want
    named = decontaminate.matches(left.withColumn("key", F.lit("k")).withColumn("row", F.lit(0)), right.select(F.concat(F.lit("q"), F.col("item_id")).alias("item_id"), "text"), carry=("doc_id", "key", "row")).collect()
    assert Counter((r.doc_id, r.item_id) for r in named) == Counter((d, f"q{i}") for d, i in want.elements()) and {(r.key, r.row) for r in named} == {("k", 0)}
    assert decontaminate.matches(left.limit(0), right).count() == 0
    assert decontaminate.matches(left, right.limit(0)).count() == 0


def test_every_alignment_is_met(spark):
    """Edited and partial copies beside a hot group that holds the item, as an alignment of all pairs tells."""
    rng = random.Random(12)
    common = words(rng, 12)
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else words(rng, 1)[0] for _ in range(n)]
    items = [prose(n) for n in (3, 4, 9, 15, 24, 40, 60)]
    texts = [" ".join(prose(30) + items[5] + prose(30))] * 150 + [" ".join(prose(rng.randrange(1, 200))) for _ in range(60)]
    for item in items:
        third = [w if i % 3 < 2 else "changed" for i, w in enumerate(item)]
        apart = [x for w in item for x in (w, "between")]
        less = [w for i, w in enumerate(item) if i % 3 < 2]
        half = item[: len(item) // 2]
        texts += [" ".join(prose(20) + x + prose(20)) for x in (third, apart, less, half, item)]
        texts += [" ".join(prose(9) + [w if rng.random() > p else rng.choice(common) for w in item] + prose(9)) for p in (0.1, 0.3, 0.4, 0.5) for _ in range(3)]
    number: dict = {}
    codes = lambda t: np.array([number.setdefault(w, len(number)) for w in t])
    score = {(t, k): decontaminate.align(codes(item), codes(t.split()))[0] / (2 * len(item)) for t in set(texts) for k, item in enumerate(items)}
    want = Counter((i, k, score[t, k]) for i, t in enumerate(texts) for k in range(len(items)) if score[t, k] >= 0.4)
    left = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    right = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert Counter((r.doc_id, r.item_id, r.score) for r in decontaminate.matches(left, right).collect()) == want


def test_alignment():
    def brute(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return int(h.max())

    rng = np.random.default_rng(1)
    for _ in range(80):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        assert decontaminate.align(a, b)[0] == brute(a, b)


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want: Counter = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at, k = 0, 0
        while at < len(ids):
            to = (len(ids) - 1) % 1024 + 1 if k == 0 else at + 1024
            want[i, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
            at, k = to, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 for n in filled.values())


def test_packing(docs, texts, no_docs):
    rows = packing.pack(docs).collect()
    check_packing(rows, texts)
    assert packing.pack(no_docs).count() == 0


def test_plan_uses_everything_and_fills():
    rng = random.Random(4)
    for _ in range(5):
        histogram = Counter(rng.randrange(1, 1024) for _ in range(4000))
        plan = packing.plan(dict(histogram))
        used: Counter = Counter()
        for q, lengths in plan:
            assert sum(lengths) <= 1024 and q > 0
            for x in lengths:
                used[x] += q
        assert used == histogram
        bound = -(-sum(k * n for k, n in histogram.items()) // 1024)
        assert sum(q for q, _ in plan) <= bound * 1.02 + 2
        assert len(plan) < 4000
    assert packing.plan({1000: 5, 24: 3, 20: 1, 4: 1}) == [(3, [1000, 24]), (1, [1000, 20, 4]), (1, [1000])]
    assert packing.plan({512: 5}) == [(2, [512, 512]), (1, [512])]
    assert packing.plan({}) == []


def test_chat(spark):
    says = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", says), (-7, 1, "assistant", says), (1, 2, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, None, None, "\\"), (2, 0, "a:### </turn>", "</turn>\n### user: x"), (None, 0, "assistant", "é\n" * 2000), (3, 0, "assistant", "####"), (3, 1, "assistant", "<<</turn></turn>\\\\")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss int")
    made = chat.format_conversations(table)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by: dict = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        said = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(said), sha(said))
    assert chat.format_conversations(table.limit(0)).count() == 0
    named = chat.digests(chat.format_conversations(table.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id"))))).collect()
    assert {(r.conv_id, r.turns_sha256) for r in named} == {(None if c is None else f"c{c}", r.turns_sha256) for c, r in got.items()}


def test_escapes_are_undone():
    rng = random.Random(0)
    for _ in range(500):
        turns = [("".join(rng.choice(["#", "###", ":", " ", "\\", "</turn>", "<", "a", "\n"]) for _ in range(rng.randrange(8))) for _ in range(2)) for _ in range(3)]
        turns = [tuple(t) for t in turns]
        text = "".join(f"### {chat.escape_head(r)}: {chat.escape_body(x)}</turn>\n" for r, x in turns)
        assert chat.read_back(text) == turns


def test_template_language():
    def show(source, **v):
        return compile_template(source)(v)[0]

    assert show("a{{ 'b' ~ 1 + 2 }}{# no #}c") == "ab12c"
    assert show("{% for x in xs %}{{ loop.index }}{{ x.k|upper }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"k": "p"}, {"k": "q"}]) == "1P,2Q"
    assert show("{% if a == 1 %}x{% elif a in [2, 3] %}y{% else %}z{% endif %}", a=3) == "y"
    assert show("{% set n = 'v' %}{{ n }}{{ missing }}{{ none }}{{ true }}") == "vtrue"
    assert show("{% if false %}{{ x.y }}{% else %}k{% endif %}") == "k"
    assert show("{{ '}}' }}") == "}}"
    text, spans = compile_template("a{% generation %}bc{% endgeneration %}d{% generation %}{% endgeneration %}")({})
    assert text == "abcd" and spans == [(1, 3), (4, 4)]
    for bad in ("{{ x.__class__", "{% if %}", "{% for x in y %}", "{{ f(x) }}", "{% endif %}", "{{ 'a }}", "{{ a | nofilter }}", "{% else %}", "{% import os %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    with pytest.raises(TemplateError):
        compile_template("{{ x.__class__ }}")({"x": "text"})
    with pytest.raises(TemplateError):
        compile_template("{% for c in x %}{% endfor %}")({"x": "text"})


def test_pipeline(spark, docs, tmp_path):
    """Odd documents go through every stage; each one's columns and decisions hold."""
    sf = str(tmp_path)
    columns = list(corpus_pipeline.COLUMNS)
    docs.select(*columns).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = table(spark, sf, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        stage(spark, now, sf).write.parquet(f"{sf}/{k}")
        now = spark.read.parquet(f"{sf}/{k}")
        if name != "packing":
            assert now.columns == columns and now.count() <= before.count()
        if name == "near_dedup":
            assert now.count() == now.dropDuplicates().count()
            assert now.where("doc_id IN (51, 52, 53)").count() == 0 and now.where("doc_id = 50").count() == 1
        if name == "span_dedup":
            texts = [(r.doc_id, r.text) for r in now.collect()]
    check_packing(now.collect(), texts)
    assert corpus_pipeline.run(spark, sf).count() == now.count()
    empty = docs.select(*columns).limit(0)
    clashing = docs.select(*columns, *[F.lit(1).alias(c) for c in ("_id", "_k", "_h", "_n", "key", "fp", "root", "kept", "spans", "row", "_0", "component_id", "lang_pred")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf).count() == 0
        assert sorted(map(repr, stage(spark, clashing, sf).collect())) == sorted(map(repr, stage(spark, docs.select(*columns), sf).collect())), name


def test_span_dedup_finds_short_passages(spark, tmp_path):
    """A passage of 55 words that two documents share goes from both; their own words and white space stay."""
    rng = random.Random(23)
    own = [" ".join(words(rng, 80)) for _ in range(6)]
    passage = " ".join(rng.choice(["of", "the", "long", "river", "bends", "quiet", "stone"]) for _ in range(55))
    rows = [(0, f"{own[0]}\n\t{passage}  {own[1]}"), (1, f"{own[2]} {passage} {own[3]}"), (2, f"{own[4]}\n {own[5]}")]
    got = {r.doc_id: r.text for r in corpus_pipeline.span_dedup(spark, _documents(spark, rows), str(tmp_path)).collect()}
    assert all(own[i] in got[i // 2] for i in range(6)) and got[2] == rows[2][1]
    assert all(passage[20:-20] not in got[i] and len(got[i]) < len(rows[i][1]) - len(passage) + 3 for i in range(2))


def _documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_dedup_keeps_one_of_each_group(spark, tmp_path):
    """Unrelated texts without a number, or with one number, are groups of their own."""
    rng = random.Random(17)
    a, b, c, d, e, f, g = (" ".join(words(rng, 60)) for _ in range(7))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (None, e), (8, e), (9, e), (3, f), (3, f), (None, g), (7, g)]
    got = corpus_pipeline.near_dedup(spark, _documents(spark, rows), str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(None, a), (None, b), (7, c), (7, d), (8, e), (3, f), (7, g)])


def test_decontaminate_tells_rows_apart_by_text(spark, tmp_path):
    """A leak without a number goes; a clean row that shares a leak's number stays."""
    rng = random.Random(18)
    item = " ".join(words(rng, 40))
    leak, clean, other = " ".join([*words(rng, 20), item]), " ".join(words(rng, 60)), " ".join(words(rng, 60))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.decontaminate(spark, _documents(spark, [(None, leak), (None, clean), (5, leak), (5, other)]), str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(None, clean), (5, other)])
