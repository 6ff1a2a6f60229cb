"""Comparison of two digests of one scheme, whichever it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmark.functions import lexical, semantic


def compare(a: str, b: str) -> float:
    """Similarity of two digests; ValueError for different or unknown schemes."""
    x, y = a.partition(":")[0], b.partition(":")[0]
    if x != y:
        raise ValueError(f"digests of different schemes: {x} and {y}")
    if x == lexical.SCHEME:
        return lexical.similarity(a, b)
    if x in (semantic.PLAIN, semantic.CENTRED):
        return semantic.semantic_similarity(a, b)
    raise ValueError(f"unknown scheme: {x}")


def compare_of(a: Column, b: Column, strict: bool = True) -> Column:
    """Column of similarities; what can't be compared raises, or is null if not ``strict``."""
    x, y = F.split_part(a, F.lit(":"), F.lit(1)), F.split_part(b, F.lit(":"), F.lit(1))
    error = F.raise_error(F.concat(F.lit("digests of different or unknown schemes: "), x, F.lit(" and "), y)).cast("double") if strict else F.lit(None).cast("double")
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(x != y, error)
        .when(x == lexical.SCHEME, lexical.digest_similarity(a, b, strict))
        .when(x.isin(semantic.PLAIN, semantic.CENTRED), semantic.digest_similarity(a, b, strict))
        .otherwise(error)
    )
