"""Queries ``opN_<name>``: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.llm import bpe, decontaminate, language, line_dedup, main_text, minhash, quality, token_store, toxicity, url_rules
from siftmark.llm.oracles import ORACLE_SQL
from siftmark.llm.common import table

#: Id appended to each document of the token store.
END_ID = 2
#: Links of ``op9``: 100 * intersection >= 85 * union, and the bands that find them.
PERCENT, N_BANDS = 85, 24
#: Hand-written rules of ``op8``.
HOST_RULES = [
    url_rules.HostRule("block", "com", "/en/"),
    url_rules.HostRule("allow", "example.com", "/en/7"),
    url_rules.HostRule("allow", "net", "/de/"),
    url_rules.HostRule("block", "example.net", "/de/8"),
    url_rules.HostRule("block", "org", "/es/"),
]


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"), main_text.trained())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` (of the text that is left) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    docs = line_dedup.dedup_lines(docs, counted="n_dropped")
    return docs.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    return token_store.store_and_read(table(spark, sf_dir, "documents"), definition, public_tokenizers.PATTERN, END_ID)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), HOST_RULES)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), PERCENT, N_BANDS)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark", "items", "places", "near_items")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_main_text, op2_language_id, op3_byte_bpe, op4_quality_rules, op5_toxicity, op6_line_dedup, op7_token_store, op8_url_rules, op9_minhash, op10_decontaminate)
}
__all__ = ["ORACLE_SQL", "QUERIES"]
