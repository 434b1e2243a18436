"""Queries on broken Sara Am."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import patterns as P
from folioflow.functions import sara_am as S
from folioflow.plans.registry import query
from folioflow.plans.text import HAS, SUB, duck, values

PAIRS = [
    ("จ านวน", "จำนวน"), ("ส านักงาน", "สำนักงาน"), ("ค าแนะน า", "คำแนะนำ"), ("ช านาญ", "ชำนาญ"), ("ส าคัญ", "สำคัญ"), ("ก าหนด", "กำหนด"), ("ต าแหน่ง", "ตำแหน่ง"), ("ส าเร็จ", "สำเร็จ"), ("อ าเภอ", "อำเภอ"), ("ส าหรับ", "สำหรับ"),
    ("ล าดับ", "ลำดับ"), ("การน าเสนอ", "การนำเสนอ"), ("การด าเนินงาน", "การดำเนินงาน"), ("บทร าพัน", "บทรำพัน"), ("จํานวน", "จำนวน"), ("จานวน", "จำนวน"), ("การศึกษา", "การศึกษา"), ("มา นาน", "มา นาน"), ("น  ้า", "น  ้า"), ("ทํ า", "ทำ"), ("นางสาวร าไพ", "นางสาวรำไพ"),
]
ROWS = [(i, raw, want) for i, (raw, want) in enumerate(PAIRS)]
COMPOSED = f"nfc_normalize({SUB('raw', S.DECOMPOSED, 'ำ')})"
N_BROKEN = f"len(regexp_extract_all(t, {duck(S.BROKEN)}))"
PLAIN_SQL = "CASE " + " ".join(f"WHEN contains(t, {duck(a)}) THEN replace(t, {duck(a)}, {duck(b)})" for a, b in S.PLAIN.items()) + " ELSE t END"
BASE = f"(SELECT id, expected, t, {N_BROKEN} AS broken, CASE WHEN {N_BROKEN} > 0 THEN regexp_replace(t, {duck(S.BROKEN)}, '\\1\\2ำ', 'g') ELSE {PLAIN_SQL} END AS fixed FROM (SELECT id, expected, {COMPOSED} AS t FROM {values(ROWS, 'id, raw, expected')}) AS a)"


def pairs(spark):
    return spark.createDataFrame(ROWS, "id int, raw string, expected string")


@query("sara_am_candidates", f"SELECT id, t AS text, CASE WHEN broken > 0 THEN broken WHEN fixed <> t THEN 1 ELSE 0 END AS issues, fixed AS candidate, {HAS('fixed', '|'.join(S.WORDS))} AS known, fixed = expected AS hit FROM {BASE} AS b")
def sara_am_candidates(spark, sf_dir):
    p = pairs(spark).withColumn("a", S.analyse(S.compose(F.col("raw"))))
    return p.select("id", "a.text", F.col("a.issues").cast("long").alias("issues"), "a.candidate", "a.known", (F.col("a.candidate") == F.col("expected")).alias("hit"))


@query("grapheme_issues", f"SELECT id, NOT {HAS('t', f'(?:^|[^{P.CONSONANT}{P.MARKS}])[{P.MARKS}]')} AND NOT {HAS('t', f'[{P.TONES}]' + '{2,}')} AS valid FROM {BASE} AS b")
def grapheme_issues(spark, sf_dir):
    return pairs(spark).select("id", S.valid_graphemes(S.compose(F.col("raw"))).alias("valid"))


def attempts(spark):
    """Three attempts on each pair: the raw reading and two that got it right, with rising confidence."""
    p = pairs(spark)
    one = lambda name, col, c: p.select(F.col("id").alias("block"), F.lit(name).alias("name"), F.col(col).alias("text"), F.lit(c).alias("confidence"))
    return one("original", "raw", 0.92).unionByName(one("upscale4", "expected", 0.95)).unionByName(one("small_mark", "expected", 99.0))


def blocks(spark):
    kinds = F.when(F.col("id") == 20, "person_name").otherwise("paragraph")
    strong = F.col("id") % 2 == 0
    return pairs(spark).select(F.col("id").alias("block"), "raw", kinds.alias("type"), F.lit(0.99).alias("confidence"), F.when(strong, 0.99).otherwise(0.92).alias("image"), F.lit(0.67).alias("agreement"), F.lit(True).alias("bbox"))


@query("variant_readings")
def variant_readings(spark, sf_dir):
    return S.votes(attempts(spark))


@query("sara_am_resolve")
def sara_am_resolve(spark, sf_dir):
    return S.resolve(blocks(spark), attempts(spark))


@query("sara_am_metrics")
def sara_am_metrics(spark, sf_dir):
    return S.recovery_metrics(sara_am_resolve(spark, sf_dir).join(pairs(spark).select(F.col("id").alias("block"), "expected"), "block"))
