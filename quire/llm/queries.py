"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.chat import FORMAT_SQL, format_chats
from quire.llm.common import table
from quire.llm.decontam import contaminated
from quire.llm.html_extract import extract
from quire.llm.langid import identify
from quire.llm.lexical import RANK_SQL, rank_documents
from quire.llm.licenses import scan, scan_sql
from quire.llm.mixing import mix
from quire.llm.pii import personal_data
from quire.llm.quality import quality
from quire.llm.simhash import near_duplicates
from quire.llm.tokens import token_counts
from quire.llm.toxicity import toxicity
from quire.llm.whitening import whiten


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_token_counts": op4_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op2_html_extraction": op2_html_extraction,
    "op7_toxicity": op7_toxicity,
    "op9_decontamination": op9_decontamination,
    "op8_personal_data": op8_personal_data,
    "op5_source_mixing": op5_source_mixing,
    "op10_license_scan": op10_license_scan,
    "op11_language_id": op11_language_id,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": FORMAT_SQL,
    "op10_license_scan": scan_sql(),
    "op13_lexical_search": RANK_SQL,
}
