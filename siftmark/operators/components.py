"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two aggregations and two joins on vertex ids; nothing of the graph comes to the
driver but a count and a checksum. Each round's edges are written to the shared scratch folder,
which cuts lineage. Edges only shrink towards stars, so a star, whatever its size, settles in two
rounds and a path of n vertices in O(log n).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.session import materialize


# The joins on ``u`` bring the edges of a large star's centre to one key, against one row of ``least``:
# adaptive execution splits such a partition of the edges and copies that row.


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``id, component`` of every vertex that has an edge to another; component is its least id.

    Self-loops and repeated edges are harmless; rows with a null end are ignored; an empty table
    gives an empty result. Ids may be of any ordered type.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct()
    state = None
    for _ in range(max_rounds):
        now = materialize(_small_star(_large_star(now)), "edges")
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("x")).first()
        if state == (mark.n, mark.x):
            break
        state = (mark.n, mark.x)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
