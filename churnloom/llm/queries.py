"""The registered queries of these operators and the SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from churnloom.llm.common import table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    from churnloom.llm.ngram_jaccard import ngram_jaccard

    return ngram_jaccard(table(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    from churnloom.llm.packing import pack

    return pack(table(spark, folder, "documents"), _tokenizer())


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from churnloom.llm.quality_classifier import quality_classifier

    return quality_classifier(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from churnloom.llm.line_dedup import line_dedup

    return line_dedup(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from churnloom.llm.quality_rules import quality_rules

    return quality_rules(table(spark, folder, "documents").select("doc_id", "text"), keep_text=False).drop("clean_text")


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from churnloom.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, folder, "embeddings"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from churnloom.llm.language_id import language_id

    return language_id(table(spark, folder, "documents"))


def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    from churnloom.llm.url_filters import url_filters

    return url_filters(table(spark, folder, "pages"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from churnloom.llm.mixing import mix

    return mix(table(spark, folder, "documents").select("doc_id", "text", "source"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from churnloom.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents"), _tokenizer())


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from churnloom.llm.license_scan import license_scan

    return license_scan(table(spark, folder, "documents")).drop("matches")


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from churnloom.llm.merkle import verify_documents

    return verify_documents(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from churnloom.llm.whitening import whiten

    return whiten(table(spark, folder, "embeddings"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_ngram_jaccard, op2_packing, op3_quality_classifier, op4_line_dedup, op5_quality_rules,
    op6_embedding_dedup, op7_language_id, op8_url_filters, op9_mixing, op10_token_counts,
    op11_license_scan, op12_merkle_manifest, op13_whitening)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    from churnloom.llm import license_scan, line_dedup, merkle, mixing

    return {"op4_line_dedup": line_dedup.ORACLE, "op9_mixing": mixing.ORACLE,
            "op11_license_scan": license_scan.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
