"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_mrf, licenses, media, minhash, packing, pii, quality, suffix_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: In production the key comes from a secret store; surrogates change with it.
PII_KEY = b"documents"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymise_checked(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents")).drop("member", "error")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mrf.main_text(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digest(suffix_dedup.remove_repeats(docs))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    return {
        "op1_pii": op1_pii,
        "op2_media": op2_media,
        "op3_quality": op3_quality,
        "op4_html": op4_html,
        "op5_toxicity": op5_toxicity,
        "op6_bpe": op6_bpe,
        "op7_suffix_array": op7_suffix_array,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_packing": op9_packing,
        "op10_licenses": op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": quality.score_sql()}
