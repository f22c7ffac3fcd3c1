"""Words and row identity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"  # what separates words
SPACE_CHARS = " \t\n\x0b\f\r"


def split_words(text: Column) -> Column:
    """Words of a text as an array; null and empty texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def split_lines(text: Column) -> Column:
    r"""Stretches between ``\n`` as an array; a null text has none, an empty one has one empty line."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def content_tag(text_col: str) -> list[Column]:
    """Two 64-bit hashes of a text; a null text differs from an empty one."""
    return [F.xxhash64(F.col(text_col)), F.xxhash64(F.lit("second"), F.col(text_col))]


def row_key(id_col: str, text_col: str) -> list[Column]:
    """``(id, tag)``: null ids sort last; the tag, 128 bits of content, tells rows apart that share an id but not the text."""
    first, second = content_tag(text_col)
    return [F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.struct(first.alias("a"), second.alias("b")).alias("tag")]


def positions(n: Column) -> Column:
    """``0 .. n - 1`` as an array, empty for ``n`` below 1."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n.cast("int") - 1))
