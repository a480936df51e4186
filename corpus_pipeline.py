"""A corpus from raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes each stage's rows to the
shared folder and reads them again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from extractspark.llm import minhash, packing, pii, quality, suffix_dedup
from extractspark.llm.common import drop_folder, new_folder, scratch, written
from extractspark.llm.queries import PII_KEY

#: The documents' columns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL: near duplicates, repeated byte strings, surrogates and token packing are tested against brute force instead.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now; null for a null text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, by references from the documents that the table labels calls good.

    A null, empty or short text goes, as it has fewer than 50 words; a null lang is judged by characters only; equal
    rows fare alike; a null doc_id or source changes nothing; a text of any length is judged whole; an empty table gives no
    rows; columns beyond those of documents are left out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filter_kept(docs.select(*COLUMNS), quality.fit(docs, labels))


def keep_first_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id.

    Null and empty texts are linked with nothing and stay; a row without doc_id stays and removes none; rows that share a
    doc_id share its verdict, so that equal rows of the least doc_id all stay; an empty table gives no rows.
    """
    judged = minhash.near_duplicates(docs.select(*COLUMNS))
    gone = judged.where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that also start in an earlier one.

    A null text stays null and an empty one empty; of characters that lose a part of their bytes nothing stays; of equal
    rows the first keeps its text, rows of one doc_id don't cut each other, a null doc_id comes after all others; an empty
    table gives no rows.
    """
    return _counted(suffix_dedup.remove_repeats(docs.select(*COLUMNS), replace=True))


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data, after the collision check over all of them.

    A null text stays null and an empty one empty; equal texts get equal results, whatever their ids; an empty table gives
    no rows.
    """
    return _counted(pii.anonymise_checked(docs.select(*COLUMNS), PII_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens.

    A null or empty text is one piece of the end id alone; equal rows are packed each for itself; a null doc_id stays null;
    an empty table gives no rows.
    """
    # Workers stay between stages: what they remember here is memory that the others lack.
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=60_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_first_of_alike),
    ("suffix_array", cut_repeats),
    ("pii", replace_personal),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage read and what it wrote on its way is removed once its own rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            drop_folder(spark, before)
        before = path
    return docs
