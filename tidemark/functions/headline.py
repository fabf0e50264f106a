"""Canonical headlines: the words in order, whatever an outlet did to their styling."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _fold_unicode(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def canonical_headline(headline: Column) -> Column:
    """NFKC, case fold, keep ``0-9a-z`` words.

    ASCII text needs neither Unicode step and stays in the JVM; only other rows carry
    their text through the Arrow batch.
    """
    wide = headline.rlike(r"[^\x00-\x7F]")
    folded = F.coalesce(_fold_unicode(F.when(wide, headline)), F.lower(headline))
    words = F.regexp_replace(folded, "[^0-9a-z ]+", " ")
    return F.trim(F.regexp_replace(words, " +", " "))
