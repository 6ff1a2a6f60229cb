"""Deterministic edits of texts, to see how digests respond (recipes are our own)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.lexical import LexicalHasher, slot_similarity
from siftmark.functions.text import tokens

KINDS = ("insert", "delete", "substitute", "reorder")
EVERY = 5
#: Slots and words of a shingle that the sweep looks at.
SETTINGS = ((128, 3), (128, 2), (64, 3), (256, 3))


def edited(words: Column, kind: str, every: int = EVERY) -> Column:
    """Every fifth word followed by a new one, left out or replaced; or all words in reverse."""
    hit = lambda i: i % every == every - 1
    new = lambda w: F.concat(F.lit("zz"), F.reverse(w))
    if kind == "reorder":
        return F.reverse(words)
    if kind == "delete":
        return F.filter(words, lambda w, i: ~hit(i))
    if kind == "substitute":
        return F.transform(words, lambda w, i: F.when(hit(i), new(w)).otherwise(w))
    if kind == "insert":
        return F.flatten(F.transform(words, lambda w, i: F.when(hit(i), F.array(w, new(w))).otherwise(F.array(w))))
    raise ValueError(f"unknown edit: {kind}")


def sweep(docs: DataFrame, text: str = "text", settings: tuple[tuple[int, int], ...] = SETTINGS) -> DataFrame:
    """``edit, num_perm, shingle_size, n, mean_sim``: similarity of texts with their edited form."""
    words = docs.select(tokens(F.col(text)).alias("words"))
    forms = words.select(F.array_join("words", " ").alias("plain"), F.explode(F.array(*(F.struct(F.lit(k).alias("edit"), F.array_join(edited(F.col("words"), k), " ").alias("text")) for k in KINDS))).alias("e"))
    parts = []
    for slots, size in settings:
        h = LexicalHasher(slots, size)
        sims = forms.select("e.edit", slot_similarity(h.signature_of(F.col("plain")), h.signature_of(F.col("e.text"))).alias("sim"))
        parts.append(sims.groupBy("edit").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sim"), 9).alias("mean_sim")).select("edit", F.lit(slots).alias("num_perm"), F.lit(size).alias("shingle_size"), "n", "mean_sim"))
    return reduce(DataFrame.unionByName, parts)
