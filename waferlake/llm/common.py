"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waferlake.session import checkpoint_dir, staged

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = {ord(c): c.lower() for c in ASCII_UPPER}
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.translate(_LOWER)


def lower_column(text: Column) -> Column:
    """Lower-case A-Z only; texts of ASCII alone take the cheaper built-in, which is equal on them."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def let(value: Column, body) -> Column:
    """Bind an expression to a name, so that an array function using it often evaluates it once."""
    return F.transform(F.array(value), body)[0]


def words_column(text: Column, separators: str) -> Column:
    """Words of a text as an array: what stands between runs of separators."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators, -1), lambda w: w != "")


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


__all__ = ["ascii_lower", "lower_column", "let", "words_column", "partitions", "staged", "checkpoint_dir", "SPACE_WORD", "ALNUM_WORD"]
