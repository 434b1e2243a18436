"""Small tables with every odd case the operators must stand."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, fp long, spans string"


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma".split()) + str(rng.randrange(90)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, shared passages, edits, nulls, blanks, ties, repeated rows and one long text."""
    rng = random.Random(3)
    shared = prose(rng, 90)
    long = prose(rng, 9000)
    base = prose(rng, 120)
    words = base.split()
    rows = [(i, prose(rng, rng.randrange(1, 160))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, " \t\n"), (43, "é" * 700), (44, "x" * 900), (45, "ab" * 500), (46, "| " * 300)]
    rows += [(50 + i, base) for i in range(4)] + [(60, " ".join(words[:60] + ["other"] + words[61:])), (60, " ".join(words[:60] + ["other"] + words[61:]))]
    rows += [(70 + i, prose(rng, 20) + "\n" + shared + "  " + prose(rng, 20)) for i in range(6)]
    rows += [(80, long), (81, prose(rng, 7) + " " + long[2000:9000]), (82, shared[:401]), (83, shared + "\x0b" + shared), (None, base), (None, "Straße ÄÖÜ und so"), (90, "One two"), (91, "one TWO"), (92, "a <|endoftext|> b")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table with more columns, whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, None if (i or 0) % 7 == 3 else "en", "s", None, 0.5, 1, 2, "x") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
