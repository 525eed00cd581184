"""The registered queries of this subpackage, and their DuckDB SQL where SQL
can express them. Each query reads whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, jaccard, langid, licenses, mixing, neardup, quality, topk, toxicity
from .common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "conversations")
    return chat.read_back(chat.format_events(chat.conversation_events(own).unionByName(chat.planted_events(own))))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_rows(read(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), tokenizer_path(), outputs=("digests",))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted", "passages")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat": op1_chat,
    "op2_mixing": op2_mixing,
    "op3_jaccard": op3_jaccard,
    "op4_topk": op4_topk,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_neardup": op9_neardup,
    "op10_licenses": op10_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat": chat.ORACLE_SQL,
    "op2_mixing": mixing.ORACLE_SQL,
    "op3_jaccard": jaccard.ORACLE_SQL,
    "op4_topk": topk.ORACLE_SQL,
    "op9_neardup": neardup.ORACLE_SQL,
}
