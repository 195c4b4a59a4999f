"""Text normalisation shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything but letters, marks and digits: white space, punctuation, symbols, invisible characters.
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def squash(c: Column) -> Column:
    """Letters and digits only, in lower case: equal for texts that differ in case, white space or punctuation."""
    return F.regexp_replace(F.lower(c), NOT_WORD, "")


def words_of(c: Column) -> Column:
    """Lower-case words in order; NULL counts as no words."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def digest(c: Column) -> Column:
    """A 128-bit key: at 10^12 distinct texts a collision is still less likely than 10^-14."""
    return F.unhex(F.md5(c.cast("binary")))


def source_name(c: Column) -> Column:
    """A source as mix_targets spells it: lower case, words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
