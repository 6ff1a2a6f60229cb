r"""URL filters by association rules (DataFrame and ML functions of the JVM only).

A URL has a host and a path. Hand-written rules judge what they fit. For the rest, FP-growth mines
combinations of URL tokens (labels of the host with their place from the end, parts of the path
with their depth, digits replaced by 0, names of query parameters, extension) from labelled URLs;
combinations are kept as rules if support and confidence suffice and no part of them does as well.
Rules are found by an inverted index from their rarest token, then compared whole.

By default the labelled URLs are those that hand-written rules judge.

Edge cases: a null URL, or one without ``://``, has an empty host and path and no rule; equally
long rules: the one that blocks wins; several mined rules: the most confident wins, then the one
of more support, then blocking; nothing labelled, or an empty table: no mined rules, and what no
rule fits is allowed; repeated rows repeat their result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import ascii_lower
from siftmark.session import broadcast_if_small, materialize

ALLOW, BLOCK = "allow", "block"
#: Mined rules up to which they are literals of the plan; more are joined as a table.
LITERAL_RULES = 200


@dataclass(frozen=True)
class HostRule:
    """Verdict for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[HostRule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; its fields are null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == BLOCK)):  # the longest is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL."""
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), F.regexp_replace(F.lower(x), r"\d+", "0")))
    query = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.concat(labels, parts, query))


@dataclass(frozen=True)
class MinedRule:
    """Tokens that together mean a verdict."""

    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: int


def mine_table(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """``body, verdict, confidence, freq``: every rule from ``tokens, verdict`` that passes, less the redundant ones.

    A rule is redundant if a part of it means the same verdict with no less confidence. Frequent
    tokens that are always found together stand for each other: one of each such class is mined,
    and its rules are written out for the others. The table is bounded by the support, not by the corpus.
    """
    mark = "verdict="
    rows = labelled.where("verdict is not null").select(F.array_sort(F.array_distinct("tokens")).alias("tokens"), "verdict")
    rows = materialize(rows, "labelled", "lz4")
    contents = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("w")).select("w", F.explode("tokens").alias("token"), F.xxhash64("tokens").alias("a"), F.xxhash64("tokens", F.lit(1)).alias("b"))
    places = contents.groupBy("token").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("w").alias("w")).where(F.col("w") >= min_support * rows.count())
    classes = [r.members for r in places.groupBy("a", "b", "w").agg(F.array_sort(F.collect_list("token")).alias("members")).where("size(members) > 1").collect()]  # frequent tokens only

    others = F.array(*(F.lit(t) for c in classes for t in c[1:])).cast("array<string>")
    baskets = rows.select(F.concat(F.array_except("tokens", others), F.array(F.concat(F.lit(mark), "verdict"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).freqItemsets
    sets = sets.select(F.filter("items", lambda x: x.startswith(mark)).alias("head"), F.array_sort(F.filter("items", lambda x: ~x.startswith(mark))).alias("body"), "freq").where(F.size("body") > 0)
    sets = materialize(sets, "itemsets", "lz4")
    bodies = sets.where(F.size("head") == 0).select("body", F.col("freq").alias("all"))
    rules = sets.where(F.size("head") == 1).join(bodies, "body").select("body", F.expr(f"substring(head[0], {len(mark) + 1})").alias("verdict"), (F.col("freq") / F.col("all")).alias("confidence"), "freq")
    rules = materialize(rules, "rules", "lz4")

    # by size: the most confidence of any part is that of the parts one token less, or of their parts
    own = rules.where(F.size("body") == 1).withColumn("best", F.lit(0.0))
    kept = own
    for size in range(2, (rules.agg(F.max(F.size("body"))).first()[0] or 1) + 1):
        upper = own.select(F.col("body").alias("part"), "verdict", F.greatest("confidence", "best").alias("top"))
        longer = rules.where(F.size("body") == size)
        parts = longer.select("body", "verdict", F.explode(F.transform("body", lambda t: F.array_remove("body", t))).alias("part"))
        best = parts.join(upper, ["part", "verdict"]).groupBy("body", "verdict").agg(F.max("top").alias("best"))
        own = materialize(longer.join(best, ["body", "verdict"]).select(*own.columns), "rules-by-size", "lz4")
        kept = kept.unionByName(own)
    kept = kept.where((F.col("confidence") >= min_confidence) & (F.col("best") < F.col("confidence"))).drop("best")
    if classes:
        members = F.create_map(*(x for c in classes for x in (F.lit(c[0]), F.array(*map(F.lit, c)))))
        options = F.transform("body", lambda t: F.coalesce(members[t], F.array(t)))
        chosen = F.aggregate(options, F.array(F.array().cast("array<string>")), lambda done, ts: F.flatten(F.transform(done, lambda d: F.transform(ts, lambda t: F.concat(d, F.array(t))))))
        kept = kept.select(F.explode(chosen).alias("body"), "verdict", "confidence", "freq").withColumn("body", F.array_sort("body"))
    return materialize(kept, "kept-rules", "lz4")


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8) -> list[MinedRule]:
    """The rules of ``mine_table`` as a list."""
    return _listed(mine_table(labelled, min_support, min_confidence))


def _listed(rules: DataFrame) -> list[MinedRule]:
    return [MinedRule(tuple(r.body), r.verdict, float(r.confidence), int(r.freq)) for r in rules.collect()]


def with_mined_verdict(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` with ``mined``, the verdict of the best rule whose tokens are all among ``tokens``; null without one."""
    if rules.count() <= LITERAL_RULES:
        return rows.withColumn("mined", mined_verdict(F.col("tokens"), _listed(rules)))
    spread = rules.select("*", F.explode("body").alias("token"))
    use = spread.groupBy("token").agg(F.count(F.lit(1)).alias("use"))
    index = spread.join(use, "token").groupBy(*rules.columns).agg(F.min_by("token", F.struct("use", "token")).alias("token"))
    asked = rows.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    fits = asked.join(broadcast_if_small(materialize(index, "rule-index", "lz4")), "token").where(F.size(F.array_except("body", "tokens")) == 0)
    rank = F.struct((-F.col("confidence")).alias("a"), (-F.col("freq")).alias("b"), (F.col("verdict") != BLOCK).alias("c"), "verdict")
    best = materialize(fits.groupBy("tokens").agg(F.min(rank)["verdict"].alias("mined")), "mined-verdicts", "lz4")
    return rows.join(broadcast_if_small(best), "tokens", "left")


def mined_verdict(found: Column, rules: list[MinedRule]) -> Column:
    """Verdict of the best mined rule whose tokens are all among ``found``; null without one."""
    if not rules:
        return F.lit(None).cast("string")
    ranked = sorted(rules, key=lambda r: (-r.confidence, -r.support, r.verdict != BLOCK, r.tokens))
    use: dict[str, int] = {}
    for r in ranked:
        for t in r.tokens:
            use[t] = use.get(t, 0) + 1
    index: dict[str, list[int]] = {}
    for k, r in enumerate(ranked):
        index.setdefault(min(r.tokens, key=lambda t: (use[t], t)), []).append(k)
    lookup = F.create_map(*(x for t, ks in sorted(index.items()) for x in (F.lit(t), F.array(*map(F.lit, ks)))))
    bodies = F.array(*(F.array(*map(F.lit, r.tokens)) for r in ranked))
    verdicts = F.array(*(F.lit(r.verdict) for r in ranked))
    candidates = F.flatten(F.transform(F.filter(found, lambda t: F.map_contains_key(lookup, t)), lambda t: lookup[t]))
    best = F.array_min(F.filter(candidates, lambda k: F.size(F.array_except(F.element_at(bodies, k + 1), found)) == 0))
    return F.when(best.isNotNull(), F.element_at(verdicts, best + 1))


def judge(pages: DataFrame, rules: list[HostRule], labelled: DataFrame | None = None, **options) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; beyond ``LITERAL_RULES`` mined rules, distinct token sets are shuffled.

    ``labelled`` has columns ``url, verdict``; None: the URLs that ``rules`` judge.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    if labelled is None:
        examples = rows.where("host <> ''").select("tokens", F.col("fit.verdict").alias("verdict"))
    else:
        split = labelled.select("url", "verdict", host.alias("host"), path.alias("path")).where("host <> ''")
        examples = split.select(tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "verdict")
    rows = with_mined_verdict(rows, mine_table(examples, **options))
    own = F.when(F.col("host") != "", F.col("mined"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own, F.lit(ALLOW)).alias("verdict"))
