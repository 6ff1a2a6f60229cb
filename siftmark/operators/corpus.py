"""Duplicate rates of a corpus and overlap of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import normalized
from siftmark.operators.cluster import lsh_bands


def _prints(norm: Column) -> list[Column]:
    """128 bits that stand for a text in a shuffle; null for the empty text."""
    return [F.when(norm != "", F.xxhash64(norm, F.lit(k))).alias(f"print_{k}") for k in (0, 1)]


def _rate() -> list[Column]:
    total, unique = F.count(F.lit(1)), F.count_distinct("print_0", "print_1")
    return [total.alias("total"), unique.alias("n_unique"), F.when(total == 0, 0.0).otherwise(100 * (total - unique) / total).alias("dup_pct")]


def exact_dup_rate(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: texts, distinct non-empty normalised ones, and the share of the rest in percent."""
    return docs.select(*_prints(normalized(F.col(text)))).agg(*_rate())


def exact_dup_by_group(docs: DataFrame, group: str, text: str = "text") -> DataFrame:
    """The same for each value of a column."""
    return docs.select(group, *_prints(normalized(F.col(text)))).groupBy(group).agg(*_rate())


def cross_exact(a: DataFrame, b: DataFrame, text: str = "text") -> DataFrame:
    """One row: distinct normalised texts of ``a``, those that ``b`` has too, and their share in percent."""
    left, right = (side.select(*_prints(normalized(F.col(text)))).where("print_0 is not null").distinct() for side in (a, b))
    right = right.withColumn("hit", F.lit(1))
    n, hits = F.count(F.lit(1)), F.count("hit")
    return left.join(right, ["print_0", "print_1"], "left").agg(n.alias("n_unique"), hits.alias("n_matched"), F.when(n == 0, 0.0).otherwise(100 * hits / n).alias("matched_pct"))


def cross_lsh(a: DataFrame, b: DataFrame, bands: int = 16, slots: int = 128) -> DataFrame:
    """One row: signatures of ``a``, those that share a band with one of ``b``, and their share in percent.

    Only digests cross over: ``a`` and ``b`` have columns ``id, signature``.
    """
    keys = lsh_bands(b, bands, slots).select("band", "key").distinct()
    hit = lsh_bands(a, bands, slots).join(keys, ["band", "key"], "left_semi").select("id").distinct().withColumn("hit", F.lit(1))
    n, hits = F.count(F.lit(1)), F.count("hit")
    return a.select("id").join(hit, "id", "left").agg(n.alias("n_unique"), hits.alias("n_matched"), F.when(n == 0, 0.0).otherwise(100 * hits / n).alias("matched_pct"))
