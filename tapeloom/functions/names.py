"""Columns that compare names, words and ids by what they say, not how they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(c: Column) -> Column:
    """Letters and digits only, lower case; null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def words(c: Column) -> Column:
    """Array of the longest runs of letters and digits, in lower case; null stays null, a text without any gives an empty array."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def id_key(c: Column, kind: str) -> Column:
    """The letters and the number of an id, ignoring case, leading zeros and all else; null without a digit."""
    number = F.regexp_replace(F.regexp_replace(c, r"[^0-9]", ""), r"^0+(?=[0-9])", "")
    letters = F.regexp_replace(F.lower(c), r"[^\p{L}]", "")
    return F.when(number != "", F.concat(F.lit(kind), letters, F.lit("#"), number))
