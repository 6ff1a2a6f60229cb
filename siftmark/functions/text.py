"""Case folding, tokens and shingles as Spark columns, in the JVM.

They agree with ``shingling`` on every code point that the JVM's Unicode version knows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmark.functions.shingling import UNSEGMENTED_RANGES

#: White space: what Java calls so in Unicode mode, and four separators more.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
TOKEN = r"[\p{L}\p{N}_]+"


@lru_cache(maxsize=1)
def _folds() -> tuple[tuple[str, str], dict[str, str]]:
    """What folding changes after lower-casing: one-to-one pairs (as translate takes them), and longer ones."""
    single, longer = {"ς": "σ"}, {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        low, fold = c.lower(), c.casefold()
        if low != fold and len(low) == 1:
            (single if len(fold) == 1 else longer)[low] = fold
    longer.pop("ß", None)
    return ("".join(single), "".join(single.values())), longer


def _ranges(characters: str) -> str:
    """A character class of runs of code points: a class of single ones is tested one by one."""
    codes = sorted({ord(c) for c in characters})
    runs: list[list[int]] = []
    for c in codes:
        if runs and c <= runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def casefold(text: Column) -> Column:
    """Full case folding. Rare folds cost only the texts that contain one."""
    (old, new), longer = _folds()
    low = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    rare = old + "".join(longer)
    first = sorted(map(ord, rare))[1]  # one of them, the micro sign, is apart from the others
    full = F.translate(low, old, new)
    for c, fold in longer.items():
        full = F.replace(full, F.lit(c), F.lit(fold))
    far = low.rlike(f"[\\x{{{min(map(ord, rare)):x}}}\\x{{{first:x}}}-\\x{{10ffff}}]")
    return F.when(~far, low).when(~low.rlike(_ranges(rare)), low).otherwise(full)


def tokens(text: Column) -> Column:
    """Case-folded word tokens; null is the empty text."""
    return F.regexp_extract_all(casefold(text), F.lit(TOKEN), F.lit(0))


def normalized(text: Column) -> Column:
    """Tokens joined by a space."""
    return F.array_join(tokens(text), " ")


def is_unsegmented(text: Column) -> Column:
    """Whether a text has a character of a script without spaces between words."""
    return F.coalesce(text, F.lit("")).rlike("[" + "".join(f"{a}-{b}" for a, b in UNSEGMENTED_RANGES) + "]")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once: what a lambda refers to is else computed again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def char_shingles(text: Column) -> Column:
    """Distinct pairs of characters of the folded text without white space."""
    dense = F.regexp_replace(casefold(text), SPACE + "+", "")

    def pairs(c: Column) -> Column:
        return F.when(F.size(c) <= 1, c).otherwise(F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.concat(F.get(c, i), F.get(c, i + 1))))

    return F.array_distinct(once(F.when(dense == "", F.array().cast("array<string>")).otherwise(F.split(dense, "")), pairs))


def word_shingles(words: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` tokens; fewer tokens make one run."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(size))))
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(F.array_join(w, " "))).otherwise(each)

    return F.array_distinct(once(words, runs))


def shingles(text: Column, size: int = 3) -> Column:
    """Character pairs for unsegmented scripts and texts without tokens, else word runs."""
    return once(tokens(text), lambda w: F.when(is_unsegmented(text) | (F.size(w) == 0), char_shingles(text)).otherwise(word_shingles(w, size)))
