"""Tokens and shingles of one text, in Python (what the Arrow functions run on a worker)."""

from __future__ import annotations

import re

#: Unicode ranges of scripts without spaces between words (kana, CJK, Thai).
UNSEGMENTED_RANGES = (("぀", "ヿ"), ("㐀", "䶿"), ("一", "鿿"), ("豈", "﫿"), ("฀", "๿"))
UNSEGMENTED = re.compile("[" + "".join(f"{a}-{b}" for a, b in UNSEGMENTED_RANGES) + "]")
WORD = re.compile(r"\w+")


def normalize(text: str | None) -> list[str]:
    """Case-folded word tokens; null is the empty text."""
    return WORD.findall(text.casefold()) if text else []


def normalized_text(text: str | None) -> str:
    """Tokens joined by a space."""
    return " ".join(normalize(text))


def _windows(units, size: int, glue: str) -> set[str]:
    if len(units) <= size:
        return {glue.join(units)} if units else set()
    return {glue.join(units[i : i + size]) for i in range(len(units) - size + 1)}


def shingle_set(text: str | None, size: int = 3) -> set[str]:
    """Distinct shingles: character pairs for unsegmented scripts and texts without words, else words.

    A text of nothing but white space, and null, has none.
    """
    tokens = [] if text and UNSEGMENTED.search(text) else normalize(text)
    if tokens:
        return _windows(tokens, size, " ")
    return _windows("".join((text or "").casefold().split()), 2, "")
