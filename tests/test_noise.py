"""Spark's spelling of the noise patterns against the one that the SQL has."""

import random
import re

from folioflow.plans import ranking


def test_spellings_agree():
    draw = random.Random(3)
    java = lambda p: re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{m[1]}", p))
    pairs = [*ranking._WORDS.values(), (ranking.LINK, ranking._LINK_AT)]
    for _ in range(5000):
        t = "".join(draw.choice("abYyeEzZ1@@..-# \nกาwWhtps:/") for _ in range(draw.randrange(30)))
        for a, b in pairs:
            assert len(java(a).findall(t)) == len(java(b).findall(t)) or (a == ranking.LINK and bool(java(a).search(t)) == bool(java(b).search(t))), (a, t)
