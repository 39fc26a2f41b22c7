"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontaminate, html_text, inner_product, language_id, near_dup, packing, pii, sentence_spans, token_store, url_filter
from keyloom.llm.common import Workspace, table
from keyloom.llm.oracle import ORACLE  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.outcomes_of(table(spark, sf_dir, "labels")))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.learn(docs))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return inner_product.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = Workspace(spark, "tokens").root
    manifest = token_store.write(table(spark, sf_dir, "documents"), root, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_back(spark, root, manifest)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_url_reputation, op2_main_text, op3_near_duplicates, op4_pii, op5_best_fit, op6_inner_product, op7_token_store, op8_decontaminate, op9_language_id, op10_sentence_spans)}
