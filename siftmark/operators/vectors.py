"""Cosine similarity, int8 quantisation, centring and nearest neighbours of embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import once
from siftmark.session import materialize

#: Vectors of one side of a comparison in ``nearest``.
BLOCK = 8_192


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(vector: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    divided = lambda v, length: F.when(length == 0, v).otherwise(F.transform(v, lambda x: x / length))
    return once(vector, lambda v: once(F.sqrt(dot(v, v)), lambda length: divided(v, length)))


def quantised(vector: Column) -> Column:
    """Whole numbers from -127 to 127, scaled by the largest magnitude (our definition); zeros stay."""
    largest = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))) / 127
    whole = lambda v, scale: F.when(scale == 0, v).otherwise(F.transform(v, lambda x: F.rint(x / scale)))
    return once(vector, lambda v: once(largest(v), lambda scale: whole(v, scale)))


def rounded(x: Column, digits: int) -> Column:
    """What ``F.round`` gives, without its decimals where no tie is near: for many rows of small numbers."""
    scaled = x * float(10**digits)
    whole = F.floor(scaled + 0.5)
    near = F.abs(scaled + 0.5 - whole)
    plain = (F.abs(x) < 1000.0) & (near > 1e-4) & (near < 1 - 1e-4)
    return F.when(plain, whole / F.lit(float(10**digits))).otherwise(F.round(x, digits))


def centred(vector: Column, mean: list[float]) -> Column:
    return F.zip_with(vector, F.array(*map(F.lit, mean)), lambda v, m: v - m)


def nearest(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``query, nearest, sim`` for ``id, vector`` of unit length: the best other one, the least id in ties.

    All against all, for evaluation sets. Queries and candidates are dealt into blocks; each task
    compares two blocks by matrix operations and returns the best candidate of each query, so nothing
    is broadcast and a task holds at most about ``block`` vectors a side. Null vectors have no neighbour.
    """
    rows = materialize(vectors.select("id", "vector").where("vector is not null"), "vectors")
    many = -(-rows.count() // block) or 1
    asked = max(many, rows.sparkSession.sparkContext.defaultParallelism)
    own = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = rows.select("id", "vector", F.lit(True).alias("asks"), own(1, asked).alias("i"), every(many).alias("j"))
    b = rows.select("id", "vector", F.lit(False).alias("asks"), every(asked).alias("i"), own(2, many).alias("j"))
    found = a.unionByName(b).groupBy("i", "j").applyInPandas(_best_of_block, "query long, nearest long, sim double")
    best = found.groupBy("query").agg(F.max(F.struct("sim", (-F.col("nearest")).alias("o"))).alias("best"))
    return best.select("query", (-F.col("best.o")).alias("nearest"), F.col("best.sim").alias("sim"))


def _best_of_block(rows: pd.DataFrame) -> pd.DataFrame:
    """The best candidate in one block for each query of another; sums run over dimensions in order."""
    rows = rows.sort_values("id", kind="stable")  # so that the first of equal candidates is the least
    asks = rows.asks.to_numpy(bool)
    ids, queries = rows.id.to_numpy()[~asks], rows.id.to_numpy()[asks]
    out = pd.DataFrame({"query": queries, "nearest": 0, "sim": np.nan})
    if not len(ids) or not len(queries):
        return out.iloc[:0]
    x, y = np.stack(rows.vector[asks].tolist()), np.stack(rows.vector[~asks].tolist()).T.copy()
    for at in range(0, len(queries), 64):
        sims = np.zeros((len(x[at : at + 64]), len(ids)))
        for d in range(x.shape[1]):
            sims += x[at : at + 64, d, None] * y[d]
        sims = np.round(sims, 9)
        sims[queries[at : at + 64, None] == ids] = -np.inf  # not itself
        best = sims.argmax(1)
        out.iloc[at : at + 64, 1], out.iloc[at : at + 64, 2] = ids[best], sims[np.arange(len(sims)), best]
    return out[out.sim > -np.inf]


def recall_at_1(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: queries, those whose nearest has their label (``id, label``), and the share."""
    own, other = labels.select(F.col("id").alias("query"), F.col("label").alias("x")), labels.select(F.col("id").alias("nearest"), F.col("label").alias("y"))
    joined = neighbours.join(own, "query").join(other, "nearest")
    n, hits = F.count(F.lit(1)), F.count_if(F.col("x") == F.col("y"))
    return joined.agg(n.alias("n_queries"), hits.alias("n_hits"), F.when(n == 0, 0.0).otherwise(hits / n).alias("recall"))
