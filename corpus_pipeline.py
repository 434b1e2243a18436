"""A corpus pipeline of five stages, each one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one works on all that it kept. All but the last
return the columns of documents. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.decontaminate import matches
from folioflow.llm.langid import identify, learn
from folioflow.llm.packing import pack
from folioflow.llm.rlbwt import remove_repeats
from folioflow.llm.simhash import near_duplicates
from folioflow.llm.split import held_out
from folioflow.session import cut, table

#: Bytes of a repeat that span_dedup removes, some 40 words (op5 has 400 bytes), and of the grams that find it.
SPAN, ANCHOR = 240, 80

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; lang becomes the language predicted.

    Null, empty and blank texts and those without a letter go. Rows with a null doc_id, source or n_chars stay as they
    are; a null lang only means that the row isn't learned from. Repeated rows all stay. Nothing to learn from (no
    lang at all, or an empty table) leaves no documents. Columns besides those of documents are left out.
    """
    docs = docs.select(*COLUMNS)
    found = identify(docs, learn(docs, ~held_out()), carry=COLUMNS)
    return found.where("lang_pred <> 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least number, or any one if none has a number.

    Rows that repeat it whole are one. Different texts that share a doc_id, or have none, are documents of their own.
    Null, empty and blank texts are one group. Ties are broken by a hash of the row. An empty table gives no rows.
    Columns besides those of documents are left out, whatever their names.
    """
    named = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in COLUMNS[1:]])
    hashed = docs.select(*COLUMNS).withColumn("_h", F.xxhash64(named))
    groups = near_duplicates(hashed, carry=("doc_id", "_h"))
    kept = groups.where("doc_id <=> component_id").groupBy("root", "doc_id", "_h").agg(F.count(F.lit(1)).alias("_n"))
    kept = kept.groupBy("root").agg(F.min(F.struct("_h", "_n", "doc_id")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k._h").alias("_k"), F.col("k._n").alias("_n"))
    kept = cut(kept, "kept")

    def rows(which: DataFrame) -> DataFrame:
        return hashed.join(which, (F.col("_h") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select(*COLUMNS)

    return rows(kept.where("_n = 1")).unionByName(rows(kept.where("_n > 1")).dropDuplicates())


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``SPAN`` bytes that occur anywhere else too; n_chars is counted again.

    What is left of a code point cut in two goes too, as do texts that are null or of which nothing is left. Repeated
    rows are copies of each other, so those of ``SPAN`` bytes or more go whole. Null doc_id, lang and source stay as
    they are. An empty table gives no rows. Columns besides those of documents are left out, whatever their names.
    """
    left = remove_repeats(docs, SPAN, ANCHOR, carry=("doc_id", "lang", "source"))
    text = F.when(F.col("n_removed") > 0, F.try_validate_utf8(F.col("kept").cast("string"))).otherwise(F.col("kept").cast("string"))
    text = F.coalesce(text, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))
    return left.select("doc_id", text.alias("text"), "lang", "source").where("text <> ''").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edited or not.

    Rows are told apart by doc_id and text, so a leak without a number goes and a clean row that shares its number
    stays. Null and empty texts hold nothing and stay; repeated rows go or stay together. An empty table, or no items,
    changes nothing. Columns besides those of documents are left out, whatever their names.
    """
    hashed = docs.select(*COLUMNS).withColumn("_h", F.xxhash64("text"))
    leaks = matches(hashed, table(spark, sf_dir, "benchmark"), carry=("doc_id", "_h")).select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k")).distinct()
    return hashed.join(leaks, (F.col("_h") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences for training: every piece with its place; null and empty texts are a piece of the end token alone.

    Repeated rows are packed as often as they occur, null doc_id too. An empty table gives no rows.
    """
    return pack(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("span_dedup", span_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Learned machines, alignment and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
