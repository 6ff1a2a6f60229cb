r"""Benchmark decontamination by a distributed positional inverted index (DataFrame functions only).

1. The index: postings (document, term, position) of every term of the benchmark, over all documents.
   A posting of the term ``END`` tells each document's number of words.
2. Each *window* of an item (``SIZE`` consecutive words; a shorter item is one window) names its
   ``RAREST`` rarest positions by counts of the postings; a window with a term that the corpus lacks
   cannot occur and is left out.
3. A posting shifted by the position in the item gives a diagonal. Lists are intersected, document
   and item by item: a window is a candidate for a phrase on a diagonal that all its rarest positions
   agree on, and for a proximity match near diagonals of theirs that lie at most ``slop`` apart.
4. Candidates are compared with the document's words, all of them. A phrase is exact; a proximity
   match has each word of the window, in place but for a shift of 0 to ``slop`` words.

The index lower-cases whole texts by Spark's fast ``lower`` and maps the final form of sigma, the only
letter whose lower case depends on what is around a word, to the other one. So words that are equal
once A-Z are lower-cased have equal terms; step 4 compares words in which A-Z alone are lower-cased.

Edge cases: null and empty texts have no words; null or empty items have no window; items of the
same id are one item for counting, each of its texts gives windows; rows that share doc_id and text
share their result; null ids are kept as they are; an empty benchmark marks nothing; extra columns
are ignored, or carried along by ``clean``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import ascii_lower, columns_of, fresh
from siftmark.session import broadcast_if_small, join_texts, lookup, materialize

#: Words of a window, how many of its rarest positions are looked up, and the tolerance of proximity matches.
SIZE, RAREST, SLOP = 10, 2, 5
#: Stands behind a document's last word; no word has a space.
END = " end"
#: Fixed value: characters of a word, after and before lower-casing of A-Z.
LOWERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column, pattern: str = LOWERED) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _terms(text: Column) -> Column:
    """Words as the index has them."""
    return _words(F.replace(F.lower(text), F.lit("ς"), F.lit("σ")))


class Index:
    """Windows of a benchmark, and postings of its terms."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, size: int = SIZE, rarest: int = RAREST):
        items = benchmark.where("text is not null").select("item_id", "text").distinct()
        # a text of an item is told from others by its hash
        items = items.select("item_id", F.xxhash64("text").alias("variant"), _terms(F.col("text")).alias("terms"), _words(ascii_lower(F.col("text"))).alias("words"))
        self.items = materialize(items.where(F.size("terms") > 0), "items", "lz4")
        spark = docs.sparkSession
        vocabulary = self.items.select(F.explode("terms").alias("word")).distinct().select("word", F.monotonically_increasing_id().alias("term"))
        vocabulary = materialize(vocabulary.unionByName(spark.createDataFrame([(END, -1)], "word string, term long")), "vocabulary", "lz4")
        places = F.posexplode(F.array_append(_terms(F.col("text")), END)).alias("place", "word")
        every = lookup(docs.select("doc_id", F.xxhash64("text").alias("mark"), places), vocabulary, ["word"], ["doc_id", "mark", "place"])
        self.postings = materialize(every.select("doc_id", "mark", "place", "term"), "postings", "lz4")
        counts = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        counted = materialize(vocabulary.join(counts, "term").select(F.col("word").alias("term"), F.col("term").alias("number"), "n"), "term-counts", "lz4")
        starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("terms") - size, F.lit(0))))
        windows = self.items.select("item_id", "variant", "terms", starts.alias("start")).withColumn("long", F.least(F.lit(size), F.size("terms") - F.col("start")))
        offsets = windows.select("item_id", "variant", "start", "long", F.posexplode(F.slice("terms", F.col("start") + 1, F.col("long"))).alias("off", "term"))
        ordered = offsets.join(counted, "term", "left").groupBy("item_id", "variant", "start", "long").agg(F.sort_array(F.collect_list(F.struct("n", "off", "number"))).alias("all"))  # ``long`` entries each
        able = ordered.where(F.forall("all", lambda x: x["n"].isNotNull()))
        able = able.withColumn("anchors", F.transform(F.slice("all", 1, rarest), lambda x: F.struct((F.col("start") + x["off"]).alias("at"), x["number"].alias("term"))))
        self.windows = materialize(able.select("item_id", "variant", "start", "long", "anchors"), "windows", "lz4")
        self.anchors = materialize(self.windows.select("item_id", "variant", F.explode("anchors").alias("a")).select("item_id", "variant", "a.at", "a.term").distinct(), "anchors", "lz4")

    def lengths(self) -> DataFrame:
        """``doc_id, mark, n_words``: a row for each document row."""
        return self.postings.where("term = -1").select("doc_id", "mark", F.col("place").cast("long").alias("n_words"))

    def hits(self) -> DataFrame:
        """``doc_id, mark, item_id, variant, at, place``: postings where an item names their term."""
        return lookup(self.postings, self.anchors, ["term"], ["doc_id", "mark", "place"]).select("doc_id", "mark", "item_id", "variant", "at", "place")

    def candidates(self, slop: int | None) -> DataFrame:
        """``doc_id, mark, item_id, variant, start, long, low, high``: windows whose rarest terms agree.

        ``low`` to ``high`` are places where the window may begin: one for a phrase, several for a
        proximity match (none of these if ``slop`` is None).
        """
        step = (slop or 0) + 1
        met = self.hits().groupBy("doc_id", "mark", "item_id", "variant")
        # at most the document's words times the places of a term in the item
        met = met.agg(F.collect_set(F.struct("at", (F.col("place") - F.col("at")).alias("diagonal"))).alias("seen"))
        of_item = self.windows.groupBy("item_id", "variant").agg(F.collect_list(F.struct("start", "long", F.col("anchors.at").alias("need"))).alias("windows"))
        met = _null_safe(met, broadcast_if_small(materialize(of_item, "item-windows", "lz4")), ["item_id", "variant"])
        found_at = F.transform("seen", lambda x: x["at"])
        able = F.filter("windows", lambda w: F.size(F.array_except(w["need"], found_at)) == 0)
        met = met.select("doc_id", "mark", "item_id", "variant", "seen", F.explode(able).alias("w"))
        diagonals = lambda at: F.transform(F.filter("seen", lambda x: x["at"] == at), lambda x: x["diagonal"].cast("int"))
        met = met.select("doc_id", "mark", "item_id", "variant", "w.start", "w.long", F.transform("w.need", diagonals).alias("lists"))
        rest = F.slice("lists", 2, F.size("lists"))
        exact = F.aggregate(rest, F.array_distinct(F.col("lists")[0]), lambda d, e: F.array_intersect(d, e))
        wide = F.transform(exact, lambda d: F.struct(d.alias("low"), d.alias("high")))
        if slop is not None:
            # a cell is slop + 1 diagonals wide; lists meet in the cell of the least diagonal or the next
            cell = lambda d: F.floor(d / step).cast("int")
            cells = lambda ds, shifts: F.array_distinct(F.flatten(F.transform(ds, lambda d: F.array(*(cell(d) + k for k in shifts)))))
            both = F.aggregate(rest, cells(F.col("lists")[0], (-1, 0)), lambda c, e: F.array_intersect(c, cells(e, (-1, 0))))
            wide = F.concat(wide, F.transform(both, lambda c: F.struct((c * step).alias("low"), (c * step + slop).alias("high"))))
        met = met.select("doc_id", "mark", "item_id", "variant", "start", "long", F.explode(wide).alias("d"))
        return met.select("doc_id", "mark", "item_id", "variant", "start", "long", (F.col("d.low") + F.col("start")).alias("low"), (F.col("d.high") + F.col("start")).alias("high")).where("low >= 0 or high > low")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls are equal."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = None
    for k in keys:
        same = left[k].eqNullSafe(right[f"_right_{k}"])
        on = same if on is None else on & same
    return left.join(right, on, how).drop(*(f"_right_{k}" for k in keys))


def _in_place(words: str, sought: str, slop: int) -> str:
    """SQL: whether, beginning somewhere in the first slop + 1 of ``words``, each word of ``sought`` is in place or up to ``slop`` behind it."""
    within = f"array_contains(slice({words}, b + i + 1, {slop + 1}), t)"
    return f"exists(sequence(0, {slop}), b -> size(filter({sought}, (t, i) -> not coalesce({within}, false))) = 0)"


def matches(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, rarest: int = RAREST, slop: int | None = SLOP) -> DataFrame:
    """``doc_id, mark, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, near_items_sha256, items, places, near_items``.

    One row for each row. ``items`` are the ids found, as sorted strings; ``places`` the numbers
    (from 0) of words hit; ``near_items`` ids with a proximity match, phrases included (the same as
    ``items`` if ``slop`` is None); ``mark`` the hash of the text.
    """
    index = Index(docs, benchmark, size, rarest)
    # windows of one document: in proportion to its own words
    asked = index.candidates(slop).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("item_id", "variant", "start", "long", "low", "high")).alias("asked"))
    asked = materialize(asked, "candidates", "lz4").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "asked")
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    texts = join_texts(texts, asked)
    words = texts.select("doc_id", "mark", "asked", _words(F.col("text"), ANY_CASE).alias("words"))
    begin = lambda c: F.greatest(c["low"], F.lit(0))
    spelt = lambda c: F.split(ascii_lower(F.array_join(F.slice("words", begin(c) + 1, c["long"] + 2 * (c["high"] - c["low"])), " ")), " ")
    phrase = lambda c: F.concat(F.array_repeat(F.lit(""), begin(c) - c["low"]), spelt(c))  # a place before the text has no word
    shown = words.select("doc_id", "mark", F.explode(F.transform("asked", lambda c: F.struct(c["item_id"], c["variant"], c["start"], begin(c).alias("place"), c["long"], (c["high"] > c["low"]).alias("near"), phrase(c).alias("phrase")))).alias("c"))
    sought = _null_safe(index.windows.select("item_id", "variant", "start", "long"), index.items.select("item_id", "variant", "words"), ["item_id", "variant"])
    sought = materialize(sought.select("item_id", "variant", "start", F.slice("words", F.col("start") + 1, F.col("long")).alias("sought")), "sought", "lz4")
    met = _null_safe(shown.select("doc_id", "mark", "c.*"), broadcast_if_small(sought), ["item_id", "variant", "start"])
    met = met.where(F.when(F.col("near"), F.expr(_in_place("phrase", "sought", slop or 0))).otherwise(F.col("phrase") == F.col("sought")))
    exact, ids = ~F.col("near"), F.col("item_id").cast("string")
    found = met.groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(F.when(exact, ids))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(exact, F.sequence("place", F.col("place") + F.col("long") - 1)))))).alias("places"),
        F.array_sort(F.collect_set(ids)).alias("near_items"),
    )
    none = {"items": "array<string>", "places": "array<int>", "near_items": "array<string>"}
    rows = _null_safe(index.lengths(), found, ["doc_id", "mark"], "left").withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in none.items()})
    count = lambda c: F.size(c).cast("long")
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    return rows.select(
        "doc_id", "mark", "n_words", count("places").alias("n_hit"), count("items").alias("n_items"), digest("items").alias("items_sha256"), (F.size("places") > 0).alias("contaminated"),
        count("near_items").alias("n_near_items"), digest("near_items").alias("near_items_sha256"), "items", "places", "near_items",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit (proximity matches are no hits), with all their columns."""
    doc, mark = fresh(docs, "bad_id", "bad_mark")
    bad = matches(docs.select("doc_id", "text"), benchmark, slop=None).where("contaminated").select(F.col("doc_id").alias(doc), F.col("mark").alias(mark)).distinct()
    return docs.join(broadcast_if_small(materialize(bad, "contaminated", "lz4")), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(mark)), "left_anti").select(columns_of(docs))
