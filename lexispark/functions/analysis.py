"""Text analysis as column expressions: letters and decimal digits, lower-cased code point by code point."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Longer runs of letters are split, not dropped.
MAX_TOKEN = 255
_TOKEN = r"[\p{L}\p{Nd}]{1,%d}" % MAX_TOKEN


def tokenize(text: Column) -> Column:
    """Array of the tokens of a text; empty for null.

    lower() alone would turn a final capital sigma and a dotted capital I into what depends on their neighbours.
    """
    folded = F.lower(F.translate(F.coalesce(text, F.lit("")), "Σİ", "σi"))
    return F.regexp_extract_all(folded, F.lit(_TOKEN), F.lit(0))


def normalize_term(text: Column) -> Column:
    """The first token of a text, or null."""
    return F.get(tokenize(text), F.lit(0))


def tokenize_text(spark: SparkSession, text: str) -> list[str]:
    """The tokens of one query text, by the expression that documents go through."""
    return list(spark.createDataFrame([(text,)], "text string").select(tokenize(F.col("text"))).first()[0])
