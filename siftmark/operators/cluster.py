"""Near-duplicate clusters of signatures by banding and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.lexical import LexicalHasher
from siftmark.functions.text import normalized
from siftmark.operators.components import connected_components
from siftmark.operators.numbering import with_index
from siftmark.session import lookup, materialize

BANDS = 16


def unique_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``id, text``: distinct non-empty normalised texts, numbered in code-point order."""
    return with_index(docs.select(normalized(F.col(text)).alias("text")).where("text <> ''").distinct(), "text")


def signed(texts: DataFrame, hasher: LexicalHasher | None = None) -> DataFrame:
    """``id, text, signature``, written once so that no later join computes it again."""
    spread = texts.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return materialize(spread.select("id", "text", (hasher or LexicalHasher()).signature_of(F.col("text")).alias("signature")), "signed")


def lsh_bands(signatures: DataFrame, bands: int = BANDS, slots: int = 128) -> DataFrame:
    """``id, band, key``: slots of each band, joined by a colon; slots beyond bands * rows don't count."""
    if not 1 <= bands <= slots:
        raise ValueError(f"bands must be from 1 to {slots}")
    rows = slots // bands
    keys = [F.array_join(F.transform(F.slice("signature", b * rows + 1, rows), lambda v: v.cast("string")), ":") for b in range(bands)]
    return signatures.select("id", F.posexplode(F.array(*keys)).alias("band", "key"))


def collisions(banded: DataFrame) -> DataFrame:
    """``src, dst``: each member of a bucket with its least one; a star, so as many as members."""
    # buckets hold ids only, and the least id of each comes from partial aggregates
    least = banded.groupBy("band", "key").agg(F.min("id").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return lookup(banded, materialize(least, "buckets"), ["band", "key"], ["id"]).where("id <> dst").select(F.col("id").alias("src"), "dst").distinct()


def clusters(signatures: DataFrame, bands: int = BANDS, slots: int = 128) -> DataFrame:
    """``id, cluster_id`` of every signature; the cluster's id is its least member."""
    edges = materialize(collisions(lsh_bands(signatures, bands, slots)), "collisions")
    found = connected_components(edges).select(F.col("id").alias("_id"), "component")
    return signatures.select("id").join(found, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("component", "id").alias("cluster_id"))


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """One row: clusters, those of several members, members of these, and their share in percent."""
    sizes = clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    several = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return sizes.agg(
        total.alias("n_unique"),
        F.count(F.lit(1)).alias("n_clusters"),
        F.count_if(F.col("n") > 1).alias("n_multi"),
        several.alias("n_in_multi"),
        F.when(total == 0, 0.0).otherwise(100 * several / total).alias("pct_in_multi"),
    )


def top_clusters(clustered: DataFrame, texts: DataFrame, most: int = 3, examples: int = 3, chars: int = 100) -> DataFrame:
    """The largest clusters of several members, each with its first texts: a report, so limited."""
    sizes = clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1").orderBy(F.desc("size"), "cluster_id").limit(most)
    members = clustered.join(F.broadcast(sizes), "cluster_id")
    first = _first_members(members, examples)
    return first.join(texts.select("id", F.substring("text", 1, chars).alias("snippet")), "id").select("cluster_id", "size", "id", "snippet")


def _first_members(members: DataFrame, examples: int) -> DataFrame:
    # Spark cuts each partition to the first ranks before the shuffle (WindowGroupLimit), so no task gets a whole cluster
    ranked = members.withColumn("rank", F.expr("row_number() over (partition by cluster_id order by id)"))
    return ranked.where(F.col("rank") <= examples).drop("rank")
