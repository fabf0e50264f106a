"""The point-in-time universe: latest facts, screening with all reasons, ranking, address."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
import hashlib
import json

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions import guards, spread
from tidemark.functions.exprs import all_failures, iso_utc
from tidemark.functions.fixed import STATIC_FALLBACK_SYMBOLS

FACTS = (
    "feed", "first_seen_time", "active", "tradable", "options_enabled", "prior_close",
    "median_dollar_volume", "near_money_quotes_7_to_21_dte", "unresolved_corporate_action",
)


@dataclass(frozen=True)
class Floors:
    min_prior_close: Decimal = Decimal("10.0000")
    min_median_dollar_volume: Decimal = Decimal("10000000.0000")
    max_symbols: int = 30

    def __post_init__(self) -> None:
        if not 1 <= self.max_symbols <= 30:
            raise ValueError("max_symbols must be between 1 and 30")
        if self.min_prior_close < 0 or self.min_median_dollar_volume < 0:
            raise ValueError("floors must not be negative")
        for name in ("min_prior_close", "min_median_dollar_volume"):
            object.__setattr__(self, name, Decimal(getattr(self, name)).quantize(Decimal("0.0001")))


def fallback_list_hash() -> str:
    return hashlib.sha256(
        json.dumps(list(STATIC_FALLBACK_SYMBOLS), separators=(",", ":")).encode()
    ).hexdigest()


def static_fallback(spark) -> DataFrame:
    """The fixed fallback symbols as a table."""
    return spark.createDataFrame(
        [(i + 1, s) for i, s in enumerate(STATIC_FALLBACK_SYMBOLS)], "position int, symbol string"
    )


def median_dollar_volume(bars: DataFrame, sessions: int = 20) -> DataFrame:
    """Trailing median of close times volume over the last ``sessions`` rows, this one included.

    NULL until the symbol has that many rows.
    """
    [heavy] = spread.is_heavy(bars, ["symbol"])
    placed = spread.numbered(bars, ["symbol"], ["session"], heavy)
    laid, part = spread.in_blocks(placed, ["symbol"], heavy, before=sessions)
    traded = (F.col("close") * F.col("volume").cast("decimal(18,0)")).cast("decimal(36,4)")
    frame = W.partitionBy(*part).orderBy("session").rowsBetween(-(sessions - 1), 0)
    laid = laid.withColumn("_all", F.sort_array(F.collect_list(traded).over(frame))).where("_core")
    low, high = (sessions + 1) // 2, sessions // 2 + 1
    middle = (F.element_at("_all", low) + F.element_at("_all", high)) / F.lit(2).cast("decimal(1,0)")
    return laid.select(
        "symbol", "session", "first_seen_time", "close",
        F.when(F.size("_all") == sessions, F.bround(middle, 4)).cast("decimal(36,4)").alias(
            "median_dollar_volume"
        ),
    )


def latest_as_of(spine: DataFrame, facts: DataFrame) -> DataFrame:
    """The newest fact first seen at or before each (symbol, as_of); none means no row.

    Facts of one symbol sharing an instant must agree.
    """
    facts = guards.collapse_duplicates(facts.select("symbol", *FACTS), ["symbol", "first_seen_time"])
    point = facts.select(
        "symbol", F.col("first_seen_time").alias("as_of"), F.lit(0).alias("_asked"),
        F.struct(*FACTS).alias("fact"),
    )
    asked = spine.select("symbol", "as_of").distinct().select(
        "symbol", "as_of", F.lit(1).alias("_asked"),
        F.lit(None).cast(point.schema["fact"].dataType).alias("fact"),
    )
    both = point.unionByName(asked)
    [heavy] = spread.is_heavy(both, ["symbol"])
    carried = spread.last_known(both, ["symbol"], ["as_of", "_asked"], heavy, "fact")
    return carried.where("_asked = 1 and fact is not null").select("as_of", "symbol", "fact.*")


def screened(latest: DataFrame, floors: Floors, fallback: bool = False) -> DataFrame:
    """Every reason a symbol fails, identity first, then optionability, then the floors.

    A missing flag, price or volume fails the check it belongs to.
    """
    c = F.col
    lacks = lambda flag: ~F.coalesce(c(flag), F.lit(False))
    below = lambda value, floor: F.coalesce(c(value) < F.lit(floor), F.lit(True))
    if fallback:
        options = [(~c("symbol").isin(*STATIC_FALLBACK_SYMBOLS), "options_not_enabled")]
    else:
        options = [
            (lacks("options_enabled"), "options_not_enabled"),
            (lacks("near_money_quotes_7_to_21_dte"), "no_quoted_near_money_expiration"),
        ]
    checks = [
        (lacks("active"), "inactive"),
        (lacks("tradable"), "not_tradable"),
        (F.coalesce(c("unresolved_corporate_action"), F.lit(True)), "unresolved_corporate_action"),
        *options,
        (below("prior_close", floors.min_prior_close), "below_price_floor"),
        (below("median_dollar_volume", floors.min_median_dollar_volume), "below_dollar_volume_floor"),
    ]
    return latest.withColumn("reasons", all_failures(checks))


def members(judged: DataFrame, floors: Floors) -> DataFrame:
    """The passing symbols by dollar volume, at most ``max_symbols`` per instant."""
    w = W.partitionBy("as_of").orderBy(F.col("median_dollar_volume").desc(), F.col("symbol"))
    return (
        judged.where(F.size("reasons") == 0)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= floors.max_symbols)
        .select("as_of", "rank", "symbol", "median_dollar_volume")
    )


def exclusions(judged: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every symbol that is no member, with its reasons."""
    failed = judged.where(F.size("reasons") > 0).select("as_of", "symbol", "reasons")
    rest = (
        judged.where(F.size("reasons") == 0)
        .join(chosen.select("as_of", "symbol"), ["as_of", "symbol"], "left_anti")
        .select("as_of", "symbol", F.array(F.lit("outside_cap")).alias("reasons"))
    )
    return failed.unionByName(rest)


def headers(judged: DataFrame, chosen: DataFrame, floors: Floors, fallback: bool = False) -> DataFrame:
    """One row per instant: ordered symbols, feeds, and the address of the decided set.

    The lists are bounded: at most 30 members, and one entry per registered feed.
    """
    feeds = judged.groupBy("as_of").agg(F.array_sort(F.collect_set("feed")).alias("feeds"))
    ranked = chosen.groupBy("as_of").agg(
        F.array_sort(F.collect_list(F.struct("rank", "symbol"))).alias("_ranked")
    )
    out = feeds.join(ranked, "as_of", "left").withColumn(
        "symbols",
        F.coalesce(F.transform("_ranked", lambda m: m.symbol), F.array().cast("array<string>")),
    )
    body = F.struct(
        iso_utc(F.col("as_of")).alias("as_of"),
        F.lit(fallback_list_hash() if fallback else None).cast("string").alias("fallback_list_hash"),
        F.col("feeds").alias("feeds"),
        F.lit(floors.max_symbols).alias("max_symbols"),
        F.lit(str(floors.min_median_dollar_volume)).alias("min_median_dollar_volume"),
        F.lit(str(floors.min_prior_close)).alias("min_prior_close"),
        F.col("symbols").alias("symbols"),
        F.lit(fallback).alias("used_static_fallback"),
    )
    address = F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)
    return out.select("as_of", "symbols", "feeds", address.alias("universe_hash"))
