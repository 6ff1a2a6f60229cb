"""Evaluation of digests on labelled sets: all pairs, their similarities, and thresholds.

Pairs are inherent to this evaluation: its time grows with the square of the labelled set. They are
compared in blocks (see ``pairs``), and counted there where only a histogram of similarities is
asked for; everything else works on that histogram, which has as many rows as similarities have
values. ``max_items`` refuses larger sets for those who want that; there is no limit by default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.lexical import LexicalHasher
from siftmark.operators import pairs
from siftmark.session import broadcast_if_small, materialize


def signatures(labelled: DataFrame, hasher: LexicalHasher | None = None) -> DataFrame:
    """``id, label, digest``: lexical signatures of ``id, text, label``."""
    return labelled.select("id", "label", (hasher or LexicalHasher()).signature_of(F.col("text")).alias("digest"))


def lexical_pairs(labelled: DataFrame, hasher: LexicalHasher | None = None, max_items: int | None = None) -> DataFrame:
    """Pairs of ``id, text, label`` by lexical similarity."""
    return pair_similarities(signatures(labelled, hasher), pairs.Slots(), max_items)


def pair_similarities(digests: DataFrame, similarity: pairs.Kernel | Callable[[Column, Column], Column], max_items: int | None = None) -> DataFrame:
    """``a, b, sim, is_intra`` of all unordered pairs of ``id, label, digest``.

    A kernel compares blocks; any other similarity is a function of two columns, and its pairs are
    joined. Digests are written once: a self-join would else compute them for both sides.
    """
    if max_items is not None and (n := digests.count()) > max_items:
        raise ValueError(f"{n} items make too many pairs; the limit is {max_items} items")
    if isinstance(similarity, pairs.Kernel):
        return pairs.similarities(digests, similarity)
    rows = materialize(digests.select("id", "label", "digest"), "digests")
    spread = rows.repartition(max(8, rows.sparkSession.sparkContext.defaultParallelism))
    a = spread.select(F.col("id").alias("a"), F.col("label").alias("label_a"), F.col("digest").alias("digest_a"))
    b = rows.select(F.col("id").alias("b"), F.col("label").alias("label_b"), F.col("digest").alias("digest_b"))
    both = a.join(broadcast_if_small(b), F.col("a") < F.col("b"))
    return both.select("a", "b", similarity(F.col("digest_a"), F.col("digest_b")).alias("sim"), F.col("label_a").eqNullSafe(F.col("label_b")).alias("is_intra"))


def histogram(found: DataFrame) -> DataFrame:
    """``sim, intra, inter``: pairs by similarity."""
    return found.groupBy("sim").agg(F.count_if("is_intra").alias("intra"), F.count_if(~F.col("is_intra")).alias("inter"))


def family_summary(hist: DataFrame, n_items: int | None = None) -> DataFrame:
    """One row: items, pairs within and between families, mean similarities, their difference."""
    intra, inter = F.coalesce(F.sum("intra"), F.lit(0)), F.coalesce(F.sum("inter"), F.lit(0))
    mean = lambda kind, n: F.when(n == 0, 0.0).otherwise(F.sum(F.col("sim") * F.col(kind)) / n)
    within, between = mean("intra", intra), mean("inter", inter)
    # n items make n (n - 1) / 2 pairs
    items = F.lit(n_items).cast("long") if n_items is not None else F.round((1 + F.sqrt(1 + 8 * (intra + inter))) / 2).cast("long")
    return hist.agg(items.alias("n_items"), intra.alias("n_pairs_intra"), inter.alias("n_pairs_inter"), within.alias("mean_intra"), between.alias("mean_inter"), (within - between).alias("separation"))


def threshold_curve(hist: DataFrame, steps: int = 100) -> DataFrame:
    """Metrics of predicting "same family" at i/steps for i from 0 to ``steps``."""
    return metrics_at(hist, [i / steps for i in range(steps + 1)])


def metrics_at(hist: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold, precision, recall, f1, tp, fp, fn, tn`` at each threshold.

    Similarities are counted by the thresholds they reach, so the histogram, which may be as long as
    the pairs, is read once; what is joined has a row for each number of thresholds.
    """
    spark, cuts = hist.sparkSession, sorted(map(float, thresholds))
    table = spark.createDataFrame([(t, sum(c <= t for c in cuts)) for t in map(float, thresholds)], "threshold double, place long")
    reached = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t <= F.col("sim"))).alias("reached")
    by_place = hist.select(reached, "intra", "inter").groupBy("reached").agg(F.sum("intra").alias("intra"), F.sum("inter").alias("inter"))
    count = lambda kind, over: F.coalesce(F.sum(F.when((F.col("reached") >= F.col("place")) == over, F.col(kind))), F.lit(0))
    counts = table.join(F.broadcast(by_place), F.lit(True), "left").groupBy("threshold").agg(count("intra", True).alias("tp"), count("inter", True).alias("fp"), count("intra", False).alias("fn"), count("inter", False).alias("tn"))
    ratio = lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)
    rated = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both)).select("threshold", "precision", "recall", "f1", "tp", "fp", "fn", "tn")


def best_threshold(hist: DataFrame, steps: int = 100) -> DataFrame:
    """The row of the curve with the best F1; of several, that of the least threshold."""
    return threshold_curve(hist, steps).orderBy(F.desc("f1"), "threshold").limit(1)


def family_count(labelled: DataFrame, label: str = "label") -> DataFrame:
    """One row: how many labels there are."""
    return labelled.agg(F.count_distinct(label).alias("n_families"))
