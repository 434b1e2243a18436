"""Sara Am: the vowel that recognition breaks apart. Repairs are proposed as column expressions, and made only on strong evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import patterns as P
from folioflow.functions.text import nfc

#: Words that a repair must lead to; sorted.
WORDS = sorted("กำลัง กำหนด คำสั่ง คำแนะนำ คุณธรรม จำนวน จำเป็น ชำนาญ ดำเนินการ ดำเนินงาน ตำแหน่ง ธรรมาภิบาล นำเสนอ บำรุง ลำดับ วัฒนธรรม สำคัญ สำนักงาน สำหรับ สำเร็จ อำนาจ อำเภอ บทรำพัน กิจกรรม วรรณคดี ชั้นมัธยมศึกษา".split())
#: Words read without the vowel's ring, longest first: what they may stand for.
PLAIN = {w.replace("ำ", "า"): w for w in sorted(["การนำเสนอ", "การดำเนินงาน", "การดำเนินการ", "จำนวน", "สำนักงาน", "คำแนะนำ", "ชำนาญ", "สำคัญ", "กำหนด", "ตำแหน่ง", "สำเร็จ", "อำเภอ", "สำหรับ", "ลำดับ"], key=len, reverse=True)}
BROKEN = rf"([{P.CONSONANT}])([{P.MARKS}]*)\s{{1,3}}(?:\x{{0E4D}}\s*)?[\x{{0E32}}\x{{0E33}}]"
DECOMPOSED = r"\x{0E4D}\s*\x{0E32}"
PROPER = "อำเภอ|จังหวัด|สำนักงาน|มหาวิทยาลัย|วิทยาลัย|โรงเรียน|นางสาว|นาง|นาย"
PROPER_TYPES = ("person_name", "school_name", "organization_name", "place_name")


def compose(x: Column) -> Column:
    return nfc(F.regexp_replace(F.coalesce(x, F.lit("")), DECOMPOSED, "ำ"))


def broken_count(x: Column) -> Column:
    """Places where a consonant and its vowel stand apart."""
    return F.regexp_count(x, F.lit(BROKEN))


def candidate(x: Column) -> Column:
    """The text with every broken vowel joined; else the first word known to be misread put right; else the text itself."""
    joined = F.regexp_replace(x, BROKEN, "$1$2ำ")
    plain = reduce(lambda rest, w: F.when(x.contains(w), F.replace(x, F.lit(w), F.lit(PLAIN[w]))).otherwise(rest), reversed(PLAIN), x)
    return F.when(broken_count(x) > 0, joined).otherwise(plain)


def dictionary(x: Column) -> Column:
    return x.rlike("|".join(WORDS))


def valid_graphemes(x: Column) -> Column:
    return ~x.rlike(rf"(?:^|[^{P.CONSONANT}{P.MARKS}])[{P.MARKS}]") & ~x.rlike(rf"[{P.TONES}]{{2,}}")


def proper_noun(type_: Column, context: Column) -> Column:
    return F.coalesce(type_.isin(*PROPER_TYPES), F.lit(False)) | F.coalesce(context.rlike(PROPER), F.lit(False))


def analyse(x: Column) -> Column:
    """STRUCT text, issues, candidate, known (a dictionary word in the candidate), valid."""
    fixed = candidate(x)
    plain = F.when(fixed != x, 1).otherwise(0)
    n = broken_count(x)
    return F.struct(x.alias("text"), F.when(n > 0, n).otherwise(plain).alias("issues"), fixed.alias("candidate"), dictionary(fixed).alias("known"), valid_graphemes(fixed).alias("valid"))


def votes(attempts: DataFrame) -> DataFrame:
    """(block, name, text, confidence) to (block, text, votes, agreement, confidence, known, score): readings that the attempts of a block lead to."""
    share = lambda c: F.when(c > 1, c / 100).otherwise(c)
    one = attempts.where("text <> ''").withColumn("text", compose(F.col("text"))).withColumn("reading", candidate(F.col("text")))
    one = one.where((F.col("reading") != F.col("text")) | F.col("reading").contains("ำ") | (broken_count(F.col("text")) > 0))
    out = one.groupBy("block", F.col("reading").alias("text")).agg(F.count(F.lit(1)).alias("votes"), F.max(share(F.col("confidence"))).alias("confidence"))
    out = out.join(attempts.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block")
    out = out.withColumn("agreement", F.col("votes") / F.col("n")).withColumn("known", dictionary(F.col("text")))
    return out.withColumn("score", F.round(F.col("votes") * 0.38 + F.col("agreement") * 0.28 + F.col("confidence") * 0.22 + F.when(F.col("known"), 0.12).otherwise(0.0), 9)).drop("n")


def resolve(blocks: DataFrame, attempts: DataFrame) -> DataFrame:
    """(block, raw, type, confidence, image, agreement, bbox) with the attempts' best reading: suggested, corrected, auto_fix, review.

    A repair is made by itself only if two attempts and half of them agree, image, provider, box and confidence are strong, a dictionary
    word comes of it and it is no name. Evidence that is null or 0 falls back on the attempts' agreement.
    """
    best = votes(attempts).withColumn("no", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("score"), "text"))).where("no = 1")
    best = best.select("block", F.col("text").alias("b_text"), F.col("votes").alias("b_votes"), F.col("agreement").alias("b_agreement"), F.col("confidence").alias("b_confidence"), F.col("known").alias("b_known"))
    rows = blocks.withColumn("text", compose(F.col("raw"))).withColumn("a", analyse(F.col("text"))).join(best, "block", "left")
    or_ = lambda x, y: F.when(F.coalesce(F.col(x), F.lit(0.0)) != 0, F.col(x)).otherwise(F.coalesce(F.col(y), F.lit(0.0)))
    suggested = F.coalesce("b_text", F.col("a.candidate"))
    auto = (
        (F.col("a.issues") > 0) & (suggested != F.col("text")) & (F.col("b_votes") >= 2) & (F.col("b_agreement") >= 0.5) & (or_("image", "b_agreement") >= 0.98) & (or_("agreement", "b_agreement") >= 0.66)
        & F.col("bbox") & (or_("confidence", "b_confidence") >= 0.98) & F.col("b_known") & ~F.coalesce(F.col("type").isin(*PROPER_TYPES), F.lit(False))
    )
    auto = F.coalesce(auto, F.lit(False))
    return rows.select("block", "text", F.col("a.issues").alias("issues"), suggested.alias("suggested"), F.when(auto, suggested).otherwise(F.col("text")).alias("corrected"), auto.alias("auto_fix"), ((F.col("a.issues") > 0) & ~auto).alias("review"))


def recovery_metrics(resolved: DataFrame) -> DataFrame:
    """Counts over ``resolve``'s rows with a column expected: detected, recovered, sent to review, unchanged, wrongly merged."""
    right = F.col("auto_fix") & (F.col("corrected") == F.col("expected"))
    out = resolved.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("issues") > 0).alias("detected"), F.count_if(right).alias("recovered"), F.count_if(~right & F.col("review")).alias("review"),
        F.count_if(~right & ~F.col("review")).alias("unchanged"), F.count_if(F.col("auto_fix") & (F.col("corrected") != F.col("expected"))).alias("false_merge"),
    )
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(1.0))
    return out.withColumns({"detection": share("detected"), "recovery": share("recovered")})
