"""Command line: ``digest``, ``compare``, ``compare-digests``, ``cluster``, ``evaluate``, ``families``."""

from __future__ import annotations

import argparse
import sys

from siftmark.functions.lexical import digest, similarity, similarity_text


def _session(scratch: str | None):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("siftmark").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    return (builder if scratch is None else builder.config("spark.checkpoint.dir", scratch)).getOrCreate()


def cluster_report(spark, path: str, column: str | None, limit: int | None, bands: int) -> tuple[int, list[str]]:
    """Exit code and lines of the report on a corpus."""
    from siftmark.operators import cluster, corpus
    from siftmark.session import materialize
    from siftmark.sources.loaders import load_texts

    rate = corpus.exact_dup_rate(texts := load_texts(spark, path, column, limit)).first()
    if not rate.total:
        return 1, ["no prompts loaded"]
    signed = cluster.signed(cluster.unique_texts(texts))
    found = materialize(cluster.clusters(signed, bands), "clusters")
    s = cluster.cluster_stats(found).first()
    lines = [
        f"total prompts         : {rate.total}",
        f"unique (normalised)   : {rate.n_unique}  ({100 - rate.dup_pct:.1f}%)",
        f"exact-duplicate rate  : {rate.dup_pct:.1f}%",
        f"clusters              : {s.n_clusters} ({bands} bands)",
        f"clusters of several   : {s.n_multi}",
        f"prompts in these      : {s.n_in_multi}  ({s.pct_in_multi:.1f}% of unique)",
    ]
    last = None
    for r in cluster.top_clusters(found, signed).orderBy("size", "cluster_id", "id", ascending=[False, True, True]).collect():
        if r.cluster_id != last:
            lines.append(f"cluster of {r.size}:")
            last = r.cluster_id
        lines.append(f"  - {r.snippet}")
    return 0, lines


def family_report(spark, name: str, labelled, hasher=None) -> list[str]:
    """Lines of the report on a labelled set ``id, text, label``; ``hasher``: a semantic one besides the lexical."""
    from pyspark.sql import functions as F

    from siftmark.functions.semantic import digest_similarity
    from siftmark.operators import evaluate
    from siftmark.session import materialize

    kinds = [("lexical", evaluate.lexical_pairs(labelled))]
    if hasher is not None:
        vectors = materialize(labelled.select("id", "label", hasher.embed_of(F.col("text")).alias("vector")), "embedded")
        if (first := vectors.first()) is not None:
            digests = vectors.select("id", "label", hasher.digest_of(F.col("vector"), len(first.vector)).alias("digest"))
            kinds.append(("semantic", evaluate.pair_similarities(digests, digest_similarity)))
    lines = [f"## {name}  ({labelled.count()} prompts, {evaluate.family_count(labelled).first().n_families} families)"]
    for kind, pairs in kinds:
        hist = materialize(evaluate.histogram(pairs), "histogram")
        s, b = evaluate.family_summary(hist).first(), evaluate.best_threshold(hist).first()
        lines.append(f"  {kind:10s} intra {s.mean_intra:.3f}  inter {s.mean_inter:.3f}  separation {s.separation:.3f}  best F1 {b.f1:.3f} @ {b.threshold:.2f} (precision {b.precision:.3f}, recall {b.recall:.3f})")
    return lines


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siftmark", description=__doc__)
    parser.add_argument("--scratch", help="folder for intermediate tables that all executors share (else the session's spark.checkpoint.dir)")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("digest", help="print the lexical digest of a text").add_argument("text")
    for name, what in (("compare", "similarity of two texts"), ("compare-digests", "similarity of two lexical digests")):
        p = commands.add_parser(name, help=what)
        p.add_argument("a")
        p.add_argument("b")
    p = commands.add_parser("cluster", help="duplicate rate and near-duplicate clusters of a corpus")
    p.add_argument("path")
    p.add_argument("--column")
    p.add_argument("--limit", type=int)
    p.add_argument("--bands", type=int, default=16)
    p = commands.add_parser("evaluate", help="separation of labelled families: a CSV of text,label, or built-in sets")
    p.add_argument("--corpus")
    p.add_argument("--semantic", action="store_true")
    p = commands.add_parser("families", help="separation of labelled families of any CSV")
    p.add_argument("path")
    p.add_argument("--text-col")
    p.add_argument("--label-col")
    p.add_argument("--limit", type=int)
    p.add_argument("--semantic", action="store_true")
    p.add_argument("--model", default=None)
    a = parser.parse_args(argv)
    if a.command == "digest":
        print(digest(a.text))
        return 0
    if a.command in ("compare", "compare-digests"):
        print(f"{(similarity_text if a.command == 'compare' else similarity)(a.a, a.b):.4f}")
        return 0
    from siftmark.operators.numbering import with_index
    from siftmark.sources import loaders

    spark = _session(a.scratch)
    if a.command == "cluster":
        code, lines = cluster_report(spark, a.path, a.column, a.limit, a.bands)
        print("\n".join(lines))
        return code
    hasher = None
    if a.semantic:
        from siftmark.functions.providers import FASTEMBED_MODEL, fastembed_hasher

        hasher = fastembed_hasher(getattr(a, "model", None) or FASTEMBED_MODEL)
    if a.command == "families":
        sets = [(a.path, with_index(loaders.load_labelled_flexible(spark, a.path, a.text_col, a.label_col, a.limit), "text"))]
    elif a.corpus:
        sets = [(a.corpus, with_index(loaders.load_labelled(spark, a.corpus), "text"))]
    else:
        sets = [("lexical families", loaders.fixture(spark, loaders.LEXICAL_FAMILIES)), ("semantic families", loaders.fixture(spark, loaders.SEMANTIC_FAMILIES))]
    for name, labelled in sets:
        print("\n".join(family_report(spark, name, labelled, hasher)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
