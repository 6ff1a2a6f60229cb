"""Language identification by word-first backoff.

Each word of a text that training knows adds its log frequency in each language. A word that it
doesn't know backs off to character n-grams of the word with its edges marked: from each position
the longest known n-gram counts, from ``max_n`` characters down to one, and their mean stands for
the word, less ``penalty``.

Training aggregates words by language in Spark and sends the table to the driver: at most
``max_docs`` documents are expected in the sample (a documented bound; rows are taken by a hash of
doc_id), and all their words, with all n-grams of these, are kept.

Edge cases: null text, or text without a letter, gives ``und`` with score 0; empty tables give
empty results; without training rows every text is ``und``; ties go to the language first in
alphabetical order; repeated rows repeat their result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import bounded_batches, remainder

#: A run of letters; in Spark, and in Python (where letter-like numbers also count, which ``LETTER`` rules out).
SPARK_WORD = r"\p{L}+"
WORD = re.compile(r"[^\W\d_]+")
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Scores of unknown words that a worker remembers.
MEMO = 100_000
#: Characters of remembered words beyond which a worker forgets, and positions of a word scored at once.
MEMO_CHARS, PIECE = 20_000_000, 65_536


class LanguageModel:
    """Scores of words and n-grams: a row of log frequencies, a column for each language."""

    def __init__(self, counts: dict[str, dict[str, int]], max_n: int = 5, penalty: float = 1.0, floor: float = 0.5):
        self.languages = sorted(counts)
        self.max_n, self.penalty = max_n, penalty
        self.index, self.rows = self._table([counts[x] for x in self.languages], floor)
        self.known = len(self.index)
        self.grams: dict[str, int] = {}
        tables = []
        for size in range(1, max_n + 1):
            kept = []
            for language in self.languages:
                own: Counter = Counter()
                for word, n in counts[language].items():
                    marked = f"\x02{word}\x03"
                    for i in range(len(marked) - size + 1):
                        own[marked[i : i + size]] += n
                kept.append(own)
            index, rows = self._table(kept, floor)
            base = len(self.grams)
            self.grams |= {k: base + i for k, i in index.items()}
            tables.append(rows - rows.max(1, keepdims=True) if len(rows) else rows)
        self.gram_rows = np.concatenate(tables)
        self._forget()

    def _forget(self) -> None:
        """Make room for scores of unknown words."""
        for word in getattr(self, "memo", ()):
            del self.index[word]
        self.memo: list[str] = []
        self.memo_chars = 0
        self.all_rows = np.concatenate([self.rows, np.zeros((MEMO, len(self.languages)), np.float32)])

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("all_rows", "memo", "index")} | {"index": {k: i for k, i in self.index.items() if i < self.known}}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _table(self, counts: list[dict[str, int]], floor: float) -> tuple[dict[str, int], np.ndarray]:
        index = {k: i for i, k in enumerate(sorted(set().union(*counts)))}
        table = np.full((len(index), len(counts)), floor)
        for column, own in enumerate(counts):
            table[[index[k] for k in own], column] += list(own.values())
        return index, np.log(table / (table.sum(0) + floor)).astype(np.float32)

    def backoff(self, word: str) -> np.ndarray:
        """Score of an unknown word by the longest known n-gram at each position."""
        marked, at, grams = f"\x02{word}\x03", [], self.grams
        for i in range(len(marked)):
            for size in range(min(self.max_n, len(marked) - i), 0, -1):
                if (row := grams.get(marked[i : i + size])) is not None:
                    at.append(row)
                    break
        if len(at) > PIECE:  # a long run of letters, such as text without spaces
            return sum(self.gram_rows[at[i : i + PIECE]].sum(0, dtype=np.float64) for i in range(0, len(at), PIECE)) / len(at) * 2 - self.penalty
        return self.gram_rows[at].mean(0) * 2 - self.penalty if at else np.full(len(self.languages), -20.0)

    def place(self, word: str) -> int:
        """Row of an unknown word, scored now."""
        if len(self.memo) >= MEMO:
            self._forget()
        at = self.known + len(self.memo)
        self.all_rows[at] = self.backoff(word)
        self.index[word] = at
        self.memo.append(word)
        self.memo_chars += len(word)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its posterior."""
        words = WORD.findall(text.lower()) if text and self.languages and LETTER.search(text) else []
        if not words:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.languages))
        found, get = [*Counter(words).items()], self.index.get
        for part in range(0, len(found), MEMO // 2):  # the memo never turns over between a place and its use
            own = found[part : part + MEMO // 2]
            if len(self.memo) + len(own) > MEMO or self.memo_chars > MEMO_CHARS:
                self._forget()
            at = [k if (k := get(w)) is not None else self.place(w) for w, _ in own]
            total += np.array([n for _, n in own], np.float64) @ self.all_rows[at]
        best = int(np.argmax(total))
        # divided by the square root of the length: words of a text aren't independent
        return self.languages[best], float(1 / np.exp((total - total[best]) / math.sqrt(len(words))).sum())


def train(docs: DataFrame, max_docs: int = 20_000, **options) -> LanguageModel:
    """Fit on rows with a language whose crc32(doc_id) modulo 5 isn't 0.

    Word counts are aggregated in Spark; the driver gets a row for each word of a language in the sample.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 5) != 0))
    total = rows.select("doc_id").count()
    if total > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(1_000_000 * max_docs / total))
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(SPARK_WORD), F.lit(0))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counted.toLocalIterator():
        counts[r.lang][r.word] = r.n
    return LanguageModel(counts, **options)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text; row-local, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
