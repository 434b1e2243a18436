"""Candidates and attempts: scoring, ranking, votes; noise in recognised text; progress and job figures.

Events stand for recognition attempts: a user's events of one hour are the attempts on one block.
"""

from __future__ import annotations

from folioflow.functions import patterns as P
from folioflow.plans.dialect import both, values


def attempts(d) -> str:
    """(block, attempt, text, confidence, agreement, image, repetition, dictionary, format)."""
    made = ", ".join(f"(event_id * {31 + 12 * i}) % 97 / 97e0 AS {n}" for i, n in enumerate(["agreement", "image", "repetition", "dictionary", "format"]))
    block = "CAST(user_id * 100 + hour(ts) AS BIGINT)"
    return f"(SELECT {block} AS block, event_id AS attempt, event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' text' END AS text, (event_id * 17) % 101 / 103e0 AS confidence, {made} FROM events)"


@both("candidate_topk")
def candidate_topk(d):
    """Best five candidates of each block; one is chosen if it is good enough and no other is close."""
    score = "round(confidence * 0.42 + agreement * 0.22 + image * 0.18 + repetition * 0.08 + dictionary * 0.05 + format * 0.05 - CASE WHEN block % 7 = 0 THEN 0.2 ELSE 0 END, 9)"
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY block ORDER BY score DESC, attempt) AS no, lead(score) OVER (PARTITION BY block ORDER BY score DESC, attempt) AS next_score FROM (SELECT block, attempt, text, greatest(least({score}, 1.0), 0.0) AS score FROM {attempts(d)} AS a) AS b)"
    return f"SELECT block, CAST(no AS INT) AS no, attempt, text, round(CAST(score AS DOUBLE), 6) AS score, no = 1 AND score >= 0.82 AND (next_score IS NULL OR score - next_score >= 0.08) AS selected FROM {ranked} AS c WHERE no <= 5"


@both("candidate_ranks")
def candidate_ranks(d):
    """Distinct texts of a block by the weights for book pages."""
    score = "max(confidence) * 0.34 + max(image) * 0.28 + max(agreement) * 0.16 + 0.12 + CASE WHEN max(dictionary) > 0.9 THEN 0.07 ELSE 0.0 END + max(repetition) * 0.03"
    return f"SELECT block, text, round(CAST({score} AS DOUBLE), 6) AS score, count(*) AS n FROM {attempts(d)} AS a GROUP BY block, text"


def _best(d, score: str) -> str:
    return f"SELECT block, attempt, text, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY score DESC, attempt) AS no FROM (SELECT *, round({score}, 9) AS score FROM {attempts(d)} AS a) AS b) AS c WHERE no = 1"


@both("attempt_best")
def attempt_best(d):
    return _best(d, "confidence * 0.58 + repetition * 0.20 + CASE WHEN length(text) >= 3 THEN 0.08 ELSE 0.0 END - CASE WHEN dictionary < 0.1 THEN 0.35 ELSE 0.0 END")


@both("attempt_best_hard_block")
def attempt_best_hard(d):
    return _best(d, "confidence * 0.54 + repetition * 0.28 + CASE WHEN length(text) >= 3 THEN 0.12 ELSE 0.0 END - CASE WHEN dictionary < 0.1 THEN 0.55 ELSE 0.0 END")


@both("attempt_best_legacy")
def attempt_best_legacy(d):
    return _best(d, "confidence * 0.48 + agreement * 0.18 + repetition * 0.15 + format * 0.09 + image * 0.06 - CAST(attempt % 4 AS DOUBLE) * 0.04")


@both("variant_agreement")
def variant_agreement(d):
    """How often a block's attempts read the same, and the score with it."""
    share = "count(*) OVER (PARTITION BY block, lower(trim(text))) * 1e0 / count(*) OVER (PARTITION BY block)"
    return f"SELECT block, attempt, round(CAST(agree AS DOUBLE), 6) AS agreement, round(CAST(confidence * 0.55 + agree * 0.20 + image * 0.18 + format * 0.07 AS DOUBLE), 6) AS score FROM (SELECT *, {share} AS agree FROM {attempts(d)} AS a) AS b"


@both("variant_votes")
def variant_votes(d):
    """Votes for each reading of a block: count, agreement, best confidence, dictionary."""
    score = "votes * 0.38 + agree * 0.28 + best * 0.22 + CASE WHEN known THEN 0.12 ELSE 0.0 END"
    return f"SELECT block, text, votes, round(CAST({score} AS DOUBLE), 6) AS score FROM (SELECT block, text, count(*) AS votes, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY block) AS agree, max(confidence) AS best, contains(text, 'error') AS known FROM {attempts(d)} AS a GROUP BY block, text) AS b"


@both("layout_candidates")
def layout_candidates(d):
    """Recognition of a page by confidence, content, lines and words, less what looks corrupt; conversations are pages, turns candidates."""
    words, lines, odd = d.count("text", r"\S+"), d.count("text", r"[^\n]+"), d.count("text", r"[|@#+\[\]]")
    score = f"(turn * 37 % 10 / 10.0) * 0.68 + least(1.0, length(text) / 500.0) * 0.12 + least(1.0, {lines} / 12.0) * 0.07 + least(1.0, {words} / 80.0) * 0.13 - least(0.2, {odd} / 20.0)"
    return f"SELECT conv_id, turn, round(CAST(score AS DOUBLE), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS no FROM (SELECT conv_id, turn, round({score}, 9) AS score FROM conversations) AS a) AS b WHERE no = 1"


NOISY = [
    (1, "Normal sentence here.", 0.95, True, True), (2, "| [ @ # + ]", 0.4, True, True), (3, "a1ก2b3ค", 0.5, True, True), (4, "ABC-123", 0.5, True, True), (5, "02-123-4567", 0.9, True, True), (6, "https://a.test", 0.8, True, True), (7, "", 0.9, True, True), (8, "xx yy zz qq", 0.7, False, True),
    (9, "สวัสดีครับ ทุกคน", 0.97, True, True), (10, "กA1B", 0.9, True, False), (11, "bcdfg hjklm", 0.9, True, True), (12, "[[[ |||", 0.1, False, False), (13, "no 1 a b c", 0.81, True, True),
]
CODE = r"(?i)^(?:[0-9A-Z]{2,}[-/_])+[-./0-9A-Z_]+$"
_AREA = r"\(?\d\d\d?\)?"
PHONE = r"^(?:\+?\d{1,3}[-\s]?)?" + rf"(?:{_AREA}[-\s]?)?" + r"\d{3,4}[-\s]?\d{3,4}$"
LINK = r"(?i)(?:www\.|https?://|[^@\s]+@[^@\s]+\.[^@\s]+)"
#: Spark's spelling of the last one and of counts of words by a letter: whether and how often they match is the same, but each starts at the sign that decides.
_LINK_AT = r"(?i)(?:www\.|https?://|[^@\s]@[^@\s]+\.[^@\s])"
_WORDS = {letters: (rf"[^\x{{0E00}}-\x{{0E7F}}\s{letters}]*[{letters}][^\x{{0E00}}-\x{{0E7F}}\s]*", rf"[{letters}][^\x{{0E00}}-\x{{0E7F}}\s]*") for letters in ("A-Za-z", "AEIOUaeiouy")}
SYLLABLE = "(?:[เแโใไ]?[ก-ฮ]+[ะ-ูเ-์]?|[ก-ฮ]+[รลว][ก-ฮ]?)"
MIXED = r"[A-Za-z][ก-๙][0-9A-Za-z]" + "|" + r"[ก-๙][#+0-9@A-Z\[\]a-z|]{2,}"


def gibberish(d, source: str) -> str:
    """(id, status, score, reasons) of texts with confidence, baseline and fit, by ten penalties that add up."""
    n = "length(" + d.sub("t", r"\s", "") + ")"
    symbols = d.count("t", r"[\p{P}\p{S}]")
    tokens, english, vowels = d.count("t", r"\S+"), *(d.count("x", of[d.spark]) for of in _WORDS.values())
    odd = d.count("t", r"[#+@\[\]|]")
    short = d.count("(' ' || " + d.sub("t", r"\s+", "  ") + " || ' ')", r"\s\S{1,2}\s")
    suspicious = d.count("(' ' || " + d.sub("t", r"\s+", "  ") + " || ' ')", r"\s[^\s#+<>@\[\]{|}\\]{0,8}[#+<>@\[\]{|}\\]\S{0,8}\s")
    parts = {
        "symbol_ratio": f"CASE WHEN {n} > 0 AND {symbols} * 1.0 / greatest({n}, 1) > 0.25 THEN 0.34 ELSE 0.0 END",
        "script_switches": f"CASE WHEN NOT {d.has('t', '[#+<>@' + chr(92) + '[' + chr(92) + ']{|}' + chr(92) * 2 + ']')} THEN 0.0 ELSE least(0.3, {suspicious} * 0.5 / greatest({tokens}, 1)) END",
        "thai_syllables": f"CASE WHEN {d.has('t', f'[{P.THAI}]')} AND NOT {d.has('t', SYLLABLE)} THEN 0.25 ELSE 0.0 END",
        "english_tokens": f"CASE WHEN NOT {d.has('t', '[A-Za-z]{4,}')} THEN 0.0 WHEN {vowels} * 1.0 / greatest({english}, 1) < 0.45 THEN 0.16 ELSE 0.0 END",
        "confidence": "CASE WHEN confidence < 0.6 THEN 0.28 WHEN confidence < 0.82 THEN 0.12 ELSE 0.0 END",
        "noise_symbols": f"CASE WHEN {odd} >= 3 THEN 0.24 ELSE 0.0 END",
        "short_tokens": f"CASE WHEN {tokens} >= 3 AND {short} * 1.0 / greatest({tokens}, 1) > 0.58 THEN 0.18 ELSE 0.0 END",
        "mixed_script": f"CASE WHEN {d.has('t', MIXED)} THEN 0.22 ELSE 0.0 END",
        "no_baseline": "CASE WHEN NOT baseline THEN 0.3 ELSE 0.0 END",
        "box_mismatch": "CASE WHEN NOT fit THEN 0.22 ELSE 0.0 END",
    }
    exempt = f"({d.has('t', CODE)} OR {d.has('t', PHONE)} OR {d.has('t', _LINK_AT if d.spark else LINK)})"
    cols = ", ".join(f"{v} AS g_{k}" for k, v in parts.items())
    score = "least(1.0, " + " + ".join("g_" + k for k in parts) + ")"
    final = f"CASE WHEN t = '' THEN 1.0 WHEN exempt THEN CASE WHEN confidence >= 0.72 THEN 0.0 ELSE 0.35 END ELSE round({score}, 9) END"
    return f"(SELECT *, CASE WHEN t = '' THEN 'rejected_as_non_text' WHEN exempt THEN CASE WHEN score < 0.1 THEN 'accepted' ELSE 'manual_review' END WHEN score >= 0.58 THEN 'rejected_as_non_text' WHEN score >= 0.28 THEN 'manual_review' ELSE 'accepted' END AS status FROM (SELECT *, {final} AS score FROM (SELECT *, t AS x0, {exempt} AS exempt, {cols} FROM (SELECT *, t AS x FROM (SELECT id, confidence, baseline, fit, {d.trim('text')} AS t FROM {source} AS g0) AS g1) AS g2) AS g3) AS g4)"


@both("gibberish_scores")
def gibberish_scores(d):
    return f"SELECT id, status, round(CAST(score AS DOUBLE), 6) AS score FROM {gibberish(d, values(d, NOISY, 'id, text, confidence, baseline, fit'))} AS g"


@both("gibberish_lines")
def gibberish_lines(d):
    """Lines of all documents by what the noise rules make of them; each distinct line is judged once."""
    lines = f"(SELECT count(*) AS id, s AS text, 0.9 AS confidence, true AS baseline, true AS fit FROM {d.lines('documents', 'doc_id')} AS l GROUP BY s)"
    return f"SELECT status, CAST(sum(id) AS BIGINT) AS n FROM {gibberish(d, lines)} AS g GROUP BY status"


@both("ocr_gibberish")
def ocr_gibberish(d):
    """The faster noise test: seven reasons, noise at two."""
    n = "length(" + d.sub("t", r"\s", "") + ")"
    symbols = d.count("t", r"[^\p{L}\p{N}\s]")
    pattern = "(?i)" + "|".join([r"[A-Z]{2,}-\d+", r"\d\d[-./:]\d\d", r"[-+.\w]+@[-.\w]+", "https?://", "ISBN"])
    sound = f"({d.has('t', '[ก-ฮ][ะ-ูเ-ไำ]')} OR {d.has('t', '[ก-ฮ]{2,}')} OR {d.has('t', '(?:^|[^0-9A-Z_a-z])[A-Za-z]{2,}(?:[^0-9A-Z_a-z]|$)')})"
    reasons = [f"({symbols} * 1.0 / greatest({n}, 1) > 0.30)", f"(NOT {sound} AND NOT {d.has('t', pattern)} AND {n} >= 3)", "(confidence > 0 AND confidence < 0.35)", "(NOT baseline)", "(NOT fit)"]
    total = " + ".join(f"CASE WHEN {r} THEN 1 ELSE 0 END" for r in reasons)
    return f"SELECT id, n AS n_reasons, n >= 2 AS gibberish, round(CAST(least(1.0, n / 4.0 + share * 0.45) AS DOUBLE), 6) AS score FROM (SELECT id, CASE WHEN t = '' THEN 0 ELSE {total} END AS n, CASE WHEN t = '' THEN 0.0 ELSE {symbols} * 1.0 / greatest({n}, 1) END AS share FROM (SELECT id, confidence, baseline, fit, {d.trim('text')} AS t FROM {values(d, NOISY, 'id, text, confidence, baseline, fit')} AS v) AS w) AS y"


@both("progress_percent")
def progress_percent(d):
    """Overall progress from a stage and its share done; event types stand for stages."""
    lo = "CASE event_type WHEN 'click' THEN 0.01 WHEN 'view' THEN 0.12 WHEN 'error' THEN 0.2 ELSE 0.9 END"
    hi = "CASE event_type WHEN 'click' THEN 0.12 WHEN 'view' THEN 0.2 WHEN 'error' THEN 0.9 ELSE 1.0 END"
    return f"SELECT event_id, round(CAST({lo} + ({hi} - {lo}) * least(1.0, greatest(0.0, (event_id % 11) / 8.0)) AS DOUBLE), 6) AS progress FROM events"


@both("job_metrics")
def job_metrics(d):
    """Counters of a job: attempts, distinct work, best, worst and mean confidence, long ones."""
    return f"SELECT block, count(*) AS n_attempts, count(DISTINCT text) AS n_distinct, CAST(max(confidence) AS DOUBLE) AS best, CAST(min(confidence) AS DOUBLE) AS worst, round(CAST(avg(confidence) AS DOUBLE), 6) AS mean, {d.if_('length(text) > 8')} AS n_long FROM {attempts(d)} AS a GROUP BY block"


@both("deduped_work")
def deduped_work(d):
    """Attempts that need doing: one of each block and text, the first."""
    return f"SELECT block, text, min(attempt) AS attempt, count(*) - 1 AS n_saved FROM {attempts(d)} AS a GROUP BY block, text"
