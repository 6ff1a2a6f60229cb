"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python; whole texts can be long, so batches are small.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't pile up in a Python worker.

    A smaller value of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def remainder(column: str, divisor: int) -> Column:
    """crc32 of a column as text, modulo ``divisor``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``rows`` has, whatever its case."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(rows: DataFrame) -> list[Column]:
    """All columns by quoted names, which may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]
