"""Queries of the corpus operators over the whole tables they are meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.llm.common import save, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvlog.llm.similar import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvlog.llm.fingerprints import edited_fingerprints, groups, prints

    docs = table(spark, sf_dir, "documents")
    known = prints(docs)
    same = groups(docs, known).groupBy("doc_id", "fingerprint").agg(F.min("group_id").alias("group_id"), F.max("n_copies").alias("n_copies"))
    same = save(same, "copies").select(F.col("doc_id").alias("id"), F.col("fingerprint").alias("of"), "group_id", "n_copies")
    out = edited_fingerprints(docs, known)
    out = out.join(same, out.doc_id.eqNullSafe(same.id) & (out.fingerprint == same.of))
    return out.drop("id", "of")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvlog.llm.quality import score_documents

    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    scored = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held, columns=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvlog.llm.language import language_scores

    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    scored = language_scores(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvlog.llm.licences import TEXTS, find

    return find(table(spark, sf_dir, "documents"), TEXTS)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvlog.llm.tokens import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvlog.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvlog.llm.nearest import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvlog.llm.shards import read_shards, write_shards

    return read_shards(write_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvlog.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_fingerprints,
        op3_quality,
        op4_lm_scores,
        op5_licences,
        op6_bpe,
        op7_packing,
        op8_topk,
        op9_token_shards,
        op10_substring_dedup,
    )
}
