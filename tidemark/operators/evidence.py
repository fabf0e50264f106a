"""The evidence card: both feature families of one (symbol, as_of) side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import guards
from tidemark.operators import news, price_features


def refuse_not_finite(block: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """NaN and infinity are never features."""
    broken = F.lit(False)
    for name in features:
        broken = broken | F.isnan(name) | (F.abs(name) == float("inf"))
    guards.refuse(
        block, F.coalesce(broken, F.lit(False)), guards.IntegrityError, "feature is not finite", key
    )
    return block


def evidence_card(price: DataFrame, told: DataFrame) -> DataFrame:
    """Full outer join of the two blocks with the union of their flags."""
    p = price.withColumnsRenamed({"quality_flags": "_pf", "feature_version": "price_feature_version"})
    n = told.withColumnsRenamed({"quality_flags": "_nf", "feature_version": "news_feature_version"})
    none = F.array().cast("array<string>")
    flags = F.array_sort(F.array_union(F.coalesce("_pf", none), F.coalesce("_nf", none)))
    names = [*price_features.FEATURES, *news.FEATURES]
    return p.join(n, ["symbol", "as_of"], "full_outer").select(
        "symbol", "as_of", *names, flags.alias("quality_flags"),
        "price_feature_version", "news_feature_version",
    )
