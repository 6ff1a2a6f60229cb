"""Digest functions by name for ``spark.sql``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftmark.functions.compare import compare
from siftmark.functions.lexical import LexicalHasher, parse_digest
from siftmark.functions.shingling import normalized_text


def register(spark: SparkSession, hasher: LexicalHasher | None = None) -> list[str]:
    """Register ``lexical_digest, lexical_signature, lexical_slots, normalized_text, digest_compare, try_digest_compare``.

    They are Arrow functions over Python, for SQL text alone: a session can register no column
    expression under a name. DataFrames should use the column factories of this package, which stay in the JVM.
    """
    own = hasher or LexicalHasher()

    def attempt(a: str | None, b: str | None) -> float | None:
        try:
            return compare(a, b)
        except (ValueError, AttributeError):
            return None

    @F.pandas_udf("string")
    def lexical_digest(texts: pd.Series) -> pd.Series:
        return texts.map(own.digest)

    @F.pandas_udf("array<long>")
    def lexical_signature(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: own.signature(t))

    @F.pandas_udf("string")
    def normalized(texts: pd.Series) -> pd.Series:
        return texts.map(normalized_text)

    @F.pandas_udf("double")
    def digest_compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else compare(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    @F.pandas_udf("double")
    def try_digest_compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([attempt(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    @F.pandas_udf("array<long>")
    def lexical_slots(digests: pd.Series) -> pd.Series:
        return digests.map(lambda d: None if d is None else parse_digest(d))

    found = {"lexical_digest": lexical_digest, "lexical_signature": lexical_signature, "normalized_text": normalized, "digest_compare": digest_compare, "try_digest_compare": try_digest_compare, "lexical_slots": lexical_slots}
    for name, function in found.items():
        spark.udf.register(name, function)
    return sorted(found)
