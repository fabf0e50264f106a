"""Words, lines and symbols of whole texts, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The maximal runs of characters other than space and U+0009 to U+000D; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_of(text: Column, characters: str) -> Column:
    """How many code points of ``text`` belong to a regular expression's character class."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.regexp_replace(text, characters + "+", ""))).cast("long")


def row_of(docs: DataFrame) -> Column:
    """A row's own columns as one struct, so no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def in_small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with few enough rows in an Arrow batch that whole texts fit a Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df
