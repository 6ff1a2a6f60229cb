"""Toxicity by weak supervision.

1. *Voters.* Terms (words, and word beginnings of 4 to 7 letters, so that inflected forms count)
   are mined from labelled training documents by smoothed log-odds and dealt to lexicon voters by
   kind and, within a kind, by strength. Density voters look at how many distinct terms a text has
   and how densely. Pattern voters read the text itself: letters masked by signs, shouting in
   capitals, runs of exclamation marks, drawn-out letters, two terms side by side. A voter says
   toxic, clean or nothing.
2. *Label model.* A generative model with a latent label: each voter has an accuracy and a rate of
   abstaining by class, and correlated voters are joined by a tree of pairwise dependences (the
   maximum spanning tree of their mutual information given the label). EM fits it and starts from
   the majority of votes, ranked so that the share of toxic rows is that of the training labels.
   The label of a training row is one more witness, of fixed accuracy and independent of the
   voters: from votes alone EM can end at another split of the rows (copies, languages) than theirs.
3. *Classifier.* A logistic regression on term counts and votes is trained on the posterior labels.

The fit sees at most ``max_docs`` labelled rows (expected; taken by a hash of doc_id, a documented
bound) whose crc32(doc_id) modulo 4 isn't 2, and at most ``max_terms`` terms, a size of the model;
the driver gets their counts, never texts. Scoring reads every whole text.

Edge cases: null and empty texts get the score of a text without words; labels other than 0 and 1
are ignored; several labels of a document all count; without labels of both classes the score is 0
for all; repeated rows repeat their score; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import bounded_batches, remainder

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SPARK_WORD = r"\p{L}[\p{L}\p{M}]*"
THRESHOLD = 0.3
#: How often the label of a training row is right, for the label model.
LABEL_ACCURACY = 0.95
#: Patterns of a text: what is looked for, and how often in a hundred words it takes for a vote of toxic (none: of nothing).
PATTERNS = {
    "masked": (regex.compile(r"\p{L}[*#@$%!]+\p{L}|\p{L}\*{2,}"), 1.0),
    "shouting": (regex.compile(r"\b\p{Lu}{4,}\b"), 10.0),
    "exclaiming": (regex.compile(r"[!?]{2,}"), 2.0),
    "drawn-out": (regex.compile(r"(\p{L})\1{3,}"), 1.0),
}
#: Lengths of word beginnings; a term of this kind ends in *.
STEMS = (4, 5, 6, 7)
TOXIC, ABSTAIN, CLEAN = 1, 0, -1


class Lexicon:
    """Mined terms with weights, and the voters over them."""

    def __init__(self, weights: dict[str, float], groups: int = 6):
        self.weights = weights
        self.terms = sorted(weights, key=lambda t: (-weights[t], t))
        self.index = {t: i for i, t in enumerate(self.terms)}
        self.heads = {t[:4] for t in self.terms}
        kinds = [[t for t in self.terms if not t.endswith("*")], [t for t in self.terms if t.endswith("*")]]
        self.voter_of: dict[int, int] = {}
        self.names: list[str] = []
        for kind, terms in zip(("words", "stems"), kinds, strict=True):
            for g in range(groups):  # the strongest terms first
                for t in terms[g * len(terms) // groups : (g + 1) * len(terms) // groups]:
                    self.voter_of[self.index[t]] = len(self.names)
                self.names.append(f"{kind}-{g}")
        self.lexicons = len(self.names)
        self.names += ["distinct", "dense", "strong", "beside", *PATTERNS]

    def hits(self, text: str | None) -> tuple[Counter, int, list[bool]]:
        """Counts of terms, the number of words, and which pattern voters say toxic."""
        if not text:
            return Counter(), 0, [False] * (1 + len(PATTERNS))
        words = WORD.findall(text.lower())
        heads, found, beside, last = self.heads, Counter(), False, -2
        for k, w in [x for x in enumerate(words) if x[1][:4] in heads]:
            own = [w, *(w[:n] + "*" for n in STEMS if len(w) >= n)]
            own = [i for t in own if (i := self.index.get(t)) is not None]
            if own:
                found.update(own)
                beside, last = beside or last == k - 1, k
        shown = [beside]
        for pattern, least in PATTERNS.values():
            need = max(1, math.ceil(least * len(words) / 100))
            shown.append(any(k + 1 >= need for k, _ in enumerate(pattern.finditer(text))))
        return found, len(words), shown

    def votes(self, found: Counter, words: int, shown: list[bool]) -> np.ndarray:
        """One vote of each voter."""
        out = np.zeros(len(self.names), np.int8)
        for i in found:
            out[self.voter_of[i]] = TOXIC
        total = sum(found.values())
        strong = max((self.weights[self.terms[i]] for i in found), default=0.0)
        k = self.lexicons
        out[k] = TOXIC if len(found) >= 2 else CLEAN if not found else ABSTAIN
        out[k + 1] = TOXIC if total >= 0.01 * words and total else CLEAN if total < 0.001 * words or not total else ABSTAIN
        out[k + 2] = TOXIC if strong >= 3 else CLEAN if strong < 1 else ABSTAIN
        out[k + 3 :] = np.where(shown, TOXIC, ABSTAIN)
        return out

    def features(self, found: Counter, words: int, votes: np.ndarray) -> tuple[list[int], list[float]]:
        """Sparse row: log counts of terms, then votes, then summed weight for the text and a word."""
        at, value = [], []
        for i, n in found.items():
            at.append(i)
            value.append(math.log1p(n))
        base = len(self.terms)
        for v in np.flatnonzero(votes):
            at.append(base + int(v))
            value.append(float(votes[v]))
        mass = sum(self.weights[self.terms[i]] * math.log2(1 + n) for i, n in found.items())
        at += [base + len(self.names), base + len(self.names) + 1]
        value += [math.log1p(mass), math.log1p(100 * mass / max(words, 20))]
        return at, value

    @property
    def width(self) -> int:
        return len(self.terms) + len(self.names) + 2


def majority(votes: np.ndarray, share: float) -> np.ndarray:
    """Beginning of EM: the most toxic rows by their votes have a high probability, ``share`` of all as labels have it."""
    total = votes.astype(int).sum(1)
    cut = np.quantile(total, 1 - share, method="higher")
    above, ties = total > cut, total == cut
    rest = (share * len(total) - above.sum()) / ties.sum()  # what is due to the rows in between
    return np.where(above, 0.95, np.where(ties, np.clip(rest, 0.05, 0.95), 0.05))


class LabelModel:
    """Naive Bayes over voters with a tree of pairwise dependences, fitted by EM; ``labels`` (0, 1) of the rows, if given, are witnesses."""

    def __init__(self, votes: np.ndarray, start: np.ndarray, rounds: int = 15, smooth: float = 0.5, labels: np.ndarray | None = None):
        states = votes.astype(int) + 1
        n, m = states.shape
        hot = np.zeros((m, 3, n))
        for s in range(3):
            hot[:, s] = (states == s).T
        posterior = np.clip(start.astype(float), 0.02, 0.98)
        for _ in range(rounds):
            by_class = np.stack([1 - posterior, posterior])
            self.prior = (by_class.sum(1) + 1) / (n + 2)
            joint = np.einsum("asn,btn,cn->cabst", hot, hot, by_class, optimize=True) + smooth / 3
            self.parent = self._tree(joint)
            self.table = np.zeros((m, 2, 3, 3))  # voter, class, state of the parent, state
            for v, p in enumerate(self.parent):
                pair = joint[:, p, v] if p >= 0 else np.repeat(joint[:, v, v].diagonal(axis1=1, axis2=2)[:, None], 3, 1)
                self.table[v] = np.log(pair / pair.sum(2, keepdims=True))
            new = self.posterior(votes, labels)
            if np.abs(new - posterior).max() < 1e-4:
                break
            posterior = np.clip(new, 1e-6, 1 - 1e-6)

    @staticmethod
    def _tree(joint: np.ndarray) -> list[int]:
        """Parents in the maximum spanning tree of mutual information given the class; -1 at the root."""
        p = joint / joint.sum(axis=(3, 4), keepdims=True)
        own = p.sum(4, keepdims=True) * p.sum(3, keepdims=True)
        gain = (joint.sum(axis=(3, 4)) * (p * np.log(p / own)).sum(axis=(3, 4))).sum(0)
        m = len(gain)
        parent, inside, best = [-1] * m, {0}, [0] * m
        while len(inside) < m:
            v = max((x for x in range(m) if x not in inside), key=lambda x: gain[x, best[x]])
            parent[v] = best[v]
            inside.add(v)
            for x in range(m):
                if x not in inside and gain[x, v] > gain[x, best[x]]:
                    best[x] = v
        return parent

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """Probability of the toxic class for rows of votes, and of labels if given."""
        states = votes.astype(int) + 1
        score = np.repeat(np.log(self.prior)[None], len(states), 0)
        for v, p in enumerate(self.parent):
            score += self.table[v][:, states[:, p] if p >= 0 else 0, states[:, v]].T if p >= 0 else self.table[v][:, 0][:, states[:, v]].T
        if labels is not None:
            right, wrong = math.log(LABEL_ACCURACY), math.log(1 - LABEL_ACCURACY)
            score += np.where(np.asarray(labels)[:, None] == np.arange(2), right, wrong)
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))


def fit_logistic(rows: list[tuple[list[int], list[float]]], target: np.ndarray, width: int, l2: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on soft labels (Adam, full batch)."""
    index = np.concatenate([np.array(a, np.int64) for a, _ in rows])
    value = np.concatenate([np.array(v) for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    w, m, s = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, value * w[index], len(rows)) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(rows)
        g = np.append(np.bincount(index, value * e[row], width) + l2 * w[:-1] / 10, e.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return w


class ToxicityModel:
    """Lexicon and linear classifier; without a lexicon every score is 0."""

    def __init__(self, lexicon: Lexicon | None = None, weights: np.ndarray | None = None):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        if self.lexicon is None:
            return 0.0
        found, words, shown = self.lexicon.hits(text)
        at, value = self.lexicon.features(found, words, self.lexicon.votes(found, words, shown))
        z = float(np.dot(self.weights[at], value) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _terms(text: Column) -> Column:
    """Distinct terms of a text: its words, and the beginnings of longer ones, marked by *."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(SPARK_WORD), F.lit(0)))
    stems = [F.transform(F.filter(words, lambda w, n=n: F.length(w) >= n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]
    return F.array_distinct(F.concat(words, *stems))


def _with_kin(rows: DataFrame, size: int = 5) -> DataFrame:
    """``rows`` with ``kin``, the least hash of a text's runs of ``size`` words: mostly equal for copies with edits, different for other texts.

    A text of fewer words has no such run and is kin of none.
    """
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(SPARK_WORD), F.lit(0)), lambda w: F.xxhash64(w))
    runs = [F.slice("words", k + 1, F.greatest(F.size("words") - (size - 1), F.lit(1))) for k in range(size)]
    print_of = F.array_min(F.transform(F.arrays_zip(*(r.alias(f"w{k}") for k, r in enumerate(runs))), lambda z: F.xxhash64(*(z[f"w{k}"] for k in range(size)))))
    return rows.withColumn("words", words).withColumn("kin", F.when(F.size("words") >= size, print_of).otherwise(F.xxhash64("doc_id"))).drop("words")


def _counted(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``toxic, terms, times, words, shown`` of each text, counted on the executors."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.hits(t.as_py()) for t in batch.column("text")]
            columns = [list(found) for found, _, _ in got], [list(found.values()) for found, _, _ in got], [n for _, n, _ in got], [s for _, _, s in got]
            kinds = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.bool_())
            yield pa.record_batch([batch.column("toxic"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["toxic", "terms", "times", "words", "shown"])

    bounded_batches(rows.sparkSession)
    return rows.select("toxic", "text").mapInArrow(run, "toxic int, terms array<int>, times array<long>, words long, shown array<boolean>")


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 12_000, max_terms: int = 1_500, min_docs: int = 4, least: float = 1.2) -> ToxicityModel:
    """Fit on at most about ``max_docs`` labelled rows (crc32(doc_id) modulo 4 not 2).

    ``max_terms`` terms found in ``min_docs`` documents or more, with log-odds of ``least`` or more.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (remainder("doc_id", 4) != 2))
    balance = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(balance.values())
    if len(balance) < 2:
        return ToxicityModel()
    rate = math.ceil(1_000_000 * max_docs / total)
    if rate < 1_000_000:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate)
    rows = _with_kin(docs.select("doc_id", "text").join(marks, "doc_id").select("doc_id", "toxic", "text")).cache()
    try:
        # copies of a text, with edits or without, are one witness for its terms
        found = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count_distinct("kin").alias("n")).collect()}
        bad, good = found.get(1, 0), found.get(0, 0)
        if not bad or not good:
            return ToxicityModel()
        seen = rows.select("toxic", "kin", F.explode(_terms(F.col("text"))).alias("term")).distinct().groupBy("term").agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.count(F.lit(1)).alias("all"))
        odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("all") - F.col("bad") + 0.5) / (good + 1))
        # significance: more toxic documents than their share gives by chance, by some standard errors
        share = bad / (bad + good)
        z = (F.col("bad") - F.col("all") * share) / F.sqrt(F.col("all") * share * (1 - share))
        best = seen.where((F.col("bad") >= min_docs) & (z >= 4)).select("term", odds.alias("odds")).where(F.col("odds") >= least).orderBy(F.desc("odds"), "term").limit(max_terms).collect()
        if not best:
            return ToxicityModel()
        lexicon = Lexicon({r.term: float(r.odds) for r in best})
        counted = list(_counted(rows, lexicon).toLocalIterator())  # at most about ``max_docs``
        gathered = [(Counter(dict(zip(r.terms, r.times, strict=True))), r.words, r.shown) for r in counted]
    finally:
        rows.unpersist()
    votes = np.stack([lexicon.votes(*h) for h in gathered])
    marked = np.array([r.toxic for r in counted])
    posterior = LabelModel(votes, majority(votes, share), labels=marked).posterior(votes, marked)
    sparse = [lexicon.features(found, words, v) for (found, words, _), v in zip(gathered, votes, strict=True)]
    return ToxicityModel(lexicon, fit_logistic(sparse, posterior, lexicon.width))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; row-local, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.score(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(got, pa.float64()), pa.array([int(x >= THRESHOLD) for x in got], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows that the model doesn't reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py()) < THRESHOLD for t in batch.column("text")], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
