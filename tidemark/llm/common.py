"""Pieces that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the contracts: the characters that part words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than space and U+0009..U+000D; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def collapse_space(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty. Matches only where something changes."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_replace(t, rf"[\x09-\x0D]{SPACE_CLASS}*|\x20{SPACE_CLASS}+", " ")
