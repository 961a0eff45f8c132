"""Native paragraph cleaning: drop-empty → per-page dedup → min words → whitespace collapse.

The order is the reference's: dedup precedes collapsing, so two blocks that differ only in
whitespace both survive and may become equal afterwards. All steps are higher-order array
functions or regex expressions, evaluated in codegen; no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ws import NON_WS, WS

# Fixed value: a block is kept when it has more than this many words.
MIN_WORDS = 3


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def word_count(text) -> Column:
    """``len(text.split())`` with Python's whitespace set."""
    return F.regexp_count(_c(text), F.lit(f"{NON_WS}+"))


def more_words_than(text, k: int) -> Column:
    """``len(text.split()) > k`` without counting every word: an anchored match that stops
    after ``k + 1`` words (constant work per block instead of one string per word)."""
    return _c(text).rlike(f"^{WS}*{NON_WS}+(?:{WS}+{NON_WS}+){{{k}}}")


def collapse_ws(text) -> Column:
    """``re.sub(r'\\s+', ' ', t).strip()``: runs become one space, then ends trimmed."""
    return F.trim(F.regexp_replace(_c(text), f"{WS}+", " "))


def drop_empty(blocks) -> Column:
    return F.filter(_c(blocks), lambda x: x != F.lit(""))


def clean_paragraphs(blocks, min_words: int = MIN_WORDS) -> Column:
    """Blocks → kept paragraphs, document order: P15 → F2 → P9 → F3."""
    deduped = F.array_distinct(drop_empty(blocks))
    long_enough = F.filter(deduped, lambda x: more_words_than(x, min_words))
    return F.transform(long_enough, lambda x: collapse_ws(x))


def char_count(text) -> Column:
    """length in code points."""
    return F.char_length(_c(text))
