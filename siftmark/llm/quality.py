"""Quality rules by repetition coverage.

Words are numbered within the text. Prefix sums of a polynomial over the numbers are taken once; the
hash of a window of any length rolls out of them as a difference of two. Duplicated hashes are found
by sorting, and the characters inside duplicated n-grams (and duplicated lines) are measured as a
share of all characters in words.

Edge cases: null and empty texts have no words, all counts are 0, the base fails and they are not
kept. Whole texts are read, whatever their length. Rows are independent: repeated rows repeat their
result, ties don't arise, an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftmark.llm.common import bounded_batches

WHITE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Odd multiplier of the rolling hash, and the one that spreads word numbers.
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Limits:
    """Rules of the verdict: shares of the characters in words, symbols for each word.

    dup_ngram: most share inside duplicated n-grams, by n; below the base rule of 20 % of words in
    repeated 5-grams, and falling with n, as longer windows repeat only where shorter ones do.
    dup_line: most share inside duplicated lines. symbols: most symbols for each word.
    mean_word: least and most mean length of a word.
    """

    dup_ngram: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    dup_line: float = 0.1
    symbols: float = 0.1
    mean_word: tuple[float, float] = (1.5, 30.0)


class Rolling:
    """Hashes of the windows of a sequence of numbers, modulo 2**64.

    With x of the numbers and S its sums of x[j] * BASE**j, the window of n at i has the hash
    (S[i + n] - S[i]) * BASE**-i: equal windows have equal hashes wherever they are.
    """

    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        if len(Rolling.up) <= n:  # powers are kept for later texts
            size = max(n + 1, 2 * len(Rolling.up))
            Rolling.up, Rolling.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (BASE, Rolling.inverse))
        x = (ids.astype(np.uint64) + np.uint64(1)) * SPREAD
        x ^= x >> np.uint64(29)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(x * Rolling.up[:n], dtype=np.uint64)])

    def windows(self, n: int) -> np.ndarray:
        """Hash of each window of n."""
        count = max(0, len(self.sums) - n)
        return (self.sums[n : n + count] - self.sums[:count]) * Rolling.down[:count]


def duplicated(ids: np.ndarray, n: int, rolling: Rolling | None = None) -> np.ndarray:
    """Which words lie in a window of n words that occurs twice or more, the first included.

    Equal hashes are compared word by word; if one ever clashes, windows are sorted whole.
    """
    inside = np.zeros(len(ids), bool)
    h = (rolling or Rolling(ids)).windows(n)
    if len(h) < 2:
        return inside
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return inside
    a, b = order[:-1][same], order[1:][same]
    if any((ids[a + k] != ids[b + k]).any() for k in range(n)):
        windows = np.lib.stride_tricks.sliding_window_view(ids, n)
        _, where, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[where.ravel()] > 1)
    else:
        at = np.union1d(a, b)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, limits: Limits = Limits()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, dup_share, dup_line_share."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in data.split(b"\n"):
        if line.strip():
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(b"".join(line.split()).decode("utf-8", "surrogatepass"))
            else:
                seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    rolling = Rolling(ids)
    inside = duplicated(ids, 5, rolling)
    repeats = int(inside.sum())
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    kept, share = not failed, 0.0
    if repeats:
        size = np.array([len(w.decode("utf-8", "surrogatepass")) for w in number])[ids]
        share = float(size[inside].sum() / chars)
        for n, most in limits.dup_ngram.items():
            if not kept:
                break
            if n != 5:
                inside = duplicated(ids, n, rolling)
            kept = size[inside].sum() <= most * chars
    line_share = dup_line_chars / chars if chars else 0.0
    if kept:
        mean = chars / len(words)
        kept = line_share <= limits.dup_line and symbols <= limits.symbols * len(words) and limits.mean_word[0] <= mean <= limits.mean_word[1]
    return len(words), chars, symbols, dup_lines, repeats, failed, bool(kept), share, line_share


NAMES = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept dup_share dup_line_share".split()
KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_share double, dup_line_share double"


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Measures and verdict of every text; row-local, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py(), limits) for t in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, KINDS, strict=True))], names=["doc_id", *NAMES])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
