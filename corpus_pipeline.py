"""Language ID, near-dedup, benchmark decontamination, PII and packing, in this order, over whole documents.

Each stage takes the documents its predecessor kept. All but the last return the columns of documents, others than those too.

Nulls: a document without text, or without a letter, goes with the first stage, as it has no language. A null lang becomes the language
found; a null doc_id is linked with nothing and stays; a null source conflicts with none. Rows that repeat: of equal or near-equal
texts the first stays, different texts under one doc_id all stay. Very long texts are read whole and packed in several pieces. An
empty documents table gives an empty result, an empty benchmark removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontaminate, language_id, near_dup, packing, pii
from keyloom.llm.common import Workspace, table

#: Documents that fit no learnt language go. Low, so that short or mixed but clean documents stay: with four languages chance scores 0.25.
LEAST_SCORE = 0.3
#: Languages that are wanted; None for all that are learnt. Documents of others go.
WANTED: frozenset[str] | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, in no learnt language or in none that is wanted, go; the others have their language."""
    network = language_id.learn(docs)
    return docs if network is None else language_id.keep_identified(docs, network, LEAST_SCORE, WANTED)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id."""
    return near_dup.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two benchmark items or more go; hit words are cut from the others."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.redact(docs, pii.learn(docs))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins."""
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontaminate", remove_benchmark), ("pii", redact_pii), ("packing", pack_bins)]

#: Learnt models and packing have no SQL form; a test holds all five stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again as the next stage's documents."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.stage(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs
