"""Digests of a stream. All digest columns are row functions, so they work on streams unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siftmark.functions.lexical import LexicalHasher


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 16) -> DataFrame:
    """Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def with_digest(rows: DataFrame, text: str = "text", hasher: LexicalHasher | None = None) -> DataFrame:
    """Rows with a column ``digest``."""
    return rows.withColumn("digest", (hasher or LexicalHasher()).digest_of(F.col(text)))


def first_seen(rows: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose digest was not seen within the watermark; state is dropped as it passes."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])


def write_stream(rows: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet; ``once`` takes what is there and ends."""
    writer = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
