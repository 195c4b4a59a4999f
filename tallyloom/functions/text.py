"""Text features as Column expressions (2.13): every one stays in generated code or built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(t: Column) -> Column:
    """White-space words."""
    return F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))


def sentence_count(t: Column) -> Column:
    """Parts between . ! ? followed by white space or the end that are not blank; at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(t, r"[.!?](\s|$)"), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")))


# What a line starts with, and what is bold.
BOLD, BULLET, NUMBERED, HEADER, TABLE = r"\*\*[^*]+\*\*", r"^\s*[-*]\s", r"^\s*\d+\.\s", r"^#{1,6}\s", r"^\s*\|.+\|.+\|"


def lines_like(t: Column, pattern: str) -> Column:
    """Lines that match at their start."""
    return F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(pattern)))


def n_bold(t: Column) -> Column:
    return F.regexp_count(t, F.lit(BOLD))


def n_bullets(t: Column) -> Column:
    return lines_like(t, BULLET)


def n_numbered(t: Column) -> Column:
    return lines_like(t, NUMBERED)


def n_headers(t: Column) -> Column:
    return lines_like(t, HEADER)


def n_tables(t: Column) -> Column:
    return lines_like(t, TABLE)


def n_code_blocks(t: Column) -> Column:
    return F.floor(F.regexp_count(t, F.lit("```")) / 2)


def n_emojis(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"[\p{So}\x{1F600}-\x{1FAFF}]"))


def formatting_density(t: Column) -> Column:
    """Marks a word; tables and emojis do not count."""
    return (n_bold(t) + n_bullets(t) + n_numbered(t) + n_headers(t) + n_code_blocks(t)) / F.greatest(F.lit(1), word_count(t))


def normal(t: Column) -> Column:
    """Letters and digits in lower case: how prompts typed in several ways are told to be one."""
    return F.regexp_replace(F.lower(t), r"[^\p{L}\p{M}\p{N}]+", "")
