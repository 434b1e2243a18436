"""The queries of this subpackage and the SQL that states the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.llm.sql import SQL
from folioflow.session import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@query
def op5_suffix_array_dedup(spark, sf_dir):
    from folioflow.llm.rlbwt import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


@query
def op1_substring_dedup(spark, sf_dir):
    from folioflow.llm.debruijn import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op7_simhash_near_dedup(spark, sf_dir):
    from folioflow.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


@query
def op10_best_fit_packing(spark, sf_dir):
    from folioflow.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark, sf_dir):
    from folioflow.llm.langid import identify, learn
    from folioflow.llm.split import held_out

    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs, ~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op2_toxicity(spark, sf_dir):
    from folioflow.llm.split import held_out
    from folioflow.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_embedding_near_dedup(spark, sf_dir):
    from folioflow.llm.lattice import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_lm_scoring(spark, sf_dir):
    from folioflow.llm.split import held_out
    from folioflow.llm.suffix_tree import learn, score

    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, ~held_out(7, 2)))
    return out.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_benchmark_decontamination(spark, sf_dir):
    from folioflow.llm.decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_chat_formatting(spark, sf_dir):
    from folioflow.llm.chat import digests, format_conversations

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.unionByName(probe)))
