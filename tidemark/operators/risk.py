"""Sizing and pre-trade screening of candidate plans against account snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import guards, spread
from tidemark.functions.exprs import DAY_SECONDS, all_failures, utc_day
from tidemark.settings import counted, known_rows, max_broadcast_rows, settle_counted


@dataclass(frozen=True)
class RiskConfig:
    maximum_loss_fraction_per_new_trade: Decimal = Decimal("0.00375")
    max_snapshot_age_seconds: int = 30
    daily_loss_stop_fraction: Decimal = Decimal("0.015")
    peak_to_valley_fraction: Decimal = Decimal("0.03")
    maximum_concurrent_positions: int = 2
    max_contracts_per_structure: int = 3
    smoke_test_max_contracts: int = 1
    total_open_risk_fraction: Decimal = Decimal("0.03")
    sector_open_risk_fraction: Decimal = Decimal("0.015")


def max_approved_quantity(config: RiskConfig, mode: str) -> Column:
    """Whole contracts the risk budget covers, under the cap of the sizing mode.

    None when the equity or the loss is missing or not positive.
    """
    cap = {"standard": config.max_contracts_per_structure, "smoke": config.smoke_test_max_contracts}[mode]
    budget = F.col("equity").cast("decimal(18,4)") * F.lit(config.maximum_loss_fraction_per_new_trade)
    loss = F.col("exact_max_loss").cast("decimal(18,4)")
    sized = F.floor(F.try_divide(budget, loss))
    return F.when((loss > 0) & (sized > 0), F.least(sized, F.lit(cap))).otherwise(0).cast("int")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot per account; two of one instant that disagree raise."""
    body = F.struct("equity", "open_position_count", "frozen_config_hash", "snapshot_time")
    newest = snapshots.groupBy("account").agg(F.max("snapshot_time").alias("_at"))
    held = snapshots.join(newest, "account").where(F.col("snapshot_time") == F.col("_at"))
    found = held.groupBy("account").agg(F.min(body).alias("_s"), F.max(body).alias("_other"))
    guards.refuse(
        found, ~F.col("_s").eqNullSafe(F.col("_other")), guards.AmbiguityError,
        "snapshots of one instant disagree", ["account"],
    )
    return found.select("account", "_s.*")


def screen_plans(
    plans: DataFrame, snapshots: DataFrame, config: RiskConfig, config_hash: str, mode: str, now: Column
) -> DataFrame:
    """Every gate each plan fails against its account's latest snapshot.

    ``plans``: plan_id, account, quantity, limit_price, entry_limit_bound, exact_max_loss, legs.
    A missing or non-positive input is a failed gate of its own, never a pass.
    """
    c = F.col
    positive = lambda n: F.coalesce(c(n) > 0, F.lit(False))
    known = c("snapshot_time").isNotNull()
    rows = plans.join(latest_snapshots(snapshots), "account", "left")
    ratio = lambda side: F.aggregate(
        F.filter("legs", lambda l: l.side == side), F.lit(0), lambda a, l: a + l.ratio_qty
    )
    rows = rows.withColumn("approved_quantity", max_approved_quantity(config, mode))
    age = F.unix_micros(now) - F.unix_micros("snapshot_time")
    checks = [
        *[(~positive(n), f"{n}_not_positive") for n in ("quantity", "limit_price", "entry_limit_bound", "exact_max_loss")],
        (F.coalesce(F.size("legs"), F.lit(0)) <= 0, "legs_missing"),
        (known & ~positive("equity"), "equity_not_positive"),
        (known & c("open_position_count").isNull(), "open_position_count_missing"),
        (known & c("frozen_config_hash").isNull(), "config_hash_missing"),
        (c("limit_price") > c("entry_limit_bound"), "entry_limit_bound_exceeded"),
        (c("quantity") > c("approved_quantity"), "quantity_exceeds_approved_cap"),
        (ratio("buy") != ratio("sell"), "unbalanced_legs"),
        (c("open_position_count") >= config.maximum_concurrent_positions, "concurrent_position_limit_reached"),
        (c("frozen_config_hash") != config_hash, "config_hash_mismatch"),
        (c("snapshot_time") > now, "snapshot_in_future"),
        (age > config.max_snapshot_age_seconds * 1_000_000, "snapshot_stale"),
        (c("snapshot_time").isNull(), "snapshot_missing"),
    ]
    return rows.withColumn("failed_gates", all_failures(checks)).withColumn(
        "approved", F.size("failed_gates") == 0
    )


def equity_stops(readings: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Both stops per reading, inclusive at their exact boundary, by cross-multiplication.

    ``readings``: session_start_equity, peak_equity, current_equity as exact decimals.  A start
    or peak that is missing or not positive, or a missing current equity, triggers by name.
    """
    c = F.col
    wide = lambda n: c(n).cast("decimal(20,4)")
    loss = wide("session_start_equity") - wide("current_equity")
    fall = wide("peak_equity") - wide("current_equity")
    bad = lambda n: F.coalesce(wide(n) <= 0, F.lit(True))
    checks = [
        *[(bad(n), f"{n}_not_positive") for n in ("session_start_equity", "peak_equity")],
        (c("current_equity").isNull(), "current_equity_missing"),
        (loss >= wide("session_start_equity") * F.lit(config.daily_loss_stop_fraction), "daily_loss_stop"),
        (fall >= wide("peak_equity") * F.lit(config.peak_to_valley_fraction), "peak_to_valley_kill_switch"),
    ]
    return readings.withColumn("reasons", all_failures(checks)).withColumn(
        "triggered", F.size("reasons") > 0
    )


def equity_readings(series: DataFrame, opening_cents: int) -> DataFrame:
    """Start-of-day, running peak and current equity from a series of signed changes.

    ``series``: account, seq, as_of, change_cents.  The peak covers the account's whole
    history up to the row; the start is the equity before the day's first change.
    """
    [heavy] = spread.is_heavy(series, ["account"])
    rows = spread.running(
        series, ["account"], ["seq"], heavy, {"_sum": ("sum", F.col("change_cents"))}
    )
    rows = rows.withColumn("_now", F.col("_sum") + opening_cents)
    rows = spread.running(
        rows, ["account"], ["seq"], heavy, {"_top": ("max", F.greatest(F.col("_now"), F.lit(opening_cents)))}
    )
    day = utc_day(F.col("as_of"))
    first = rows.groupBy("account", day.alias("day")).agg(
        F.min_by(F.col("_now") - F.col("change_cents"), "seq").alias("_start")
    )
    cents = lambda n: (F.col(n).cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,4)")
    return rows.withColumn("day", day).join(first, ["account", "day"]).select(
        "account", "seq", "as_of", cents("_start").alias("session_start_equity"),
        cents("_top").alias("peak_equity"), cents("_now").alias("current_equity"),
    )


def within_portfolio_limits(plans: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Walk plans in rank order and name the open-risk limits each one would break.

    ``plans``: account, rank, underlying_symbol, sector, equity, exact_max_loss, quantity.
    Risk accumulates over all plans up to and including the row, in rank order.
    """
    [heavy] = spread.is_heavy(plans, ["account"])
    rows = plans.withColumn("_risk", F.col("exact_max_loss") * F.col("quantity"))
    rows = spread.running(rows, ["account"], ["rank"], heavy, {"_total": ("sum", F.col("_risk"))})
    rows = spread.running(
        rows, ["account", "sector"], ["rank"], heavy, {"_in_sector": ("sum", F.col("_risk"))}
    )
    first = rows.groupBy("account", "underlying_symbol").agg(F.min("rank").alias("_first"))
    rows = spread.join_same(rows, first, ["account", "underlying_symbol"])
    c = F.col
    limit = lambda fraction: c("equity").cast("decimal(20,4)") * F.lit(fraction)
    checks = [
        (c("_risk").isNull() | c("equity").isNull(), "risk_or_equity_missing"),
        (c("_total") > limit(config.total_open_risk_fraction), "total_open_risk"),
        (c("_in_sector") > limit(config.sector_open_risk_fraction), "sector_open_risk"),
        (c("rank") > c("_first"), "underlying_already_open"),
    ]
    return rows.withColumn("reasons", all_failures(checks)).drop("_risk", "_total", "_in_sector", "_first")


def lots_within_portfolio_limits(
    lots: DataFrame, expand: Callable[[DataFrame], DataFrame], config: RiskConfig = RiskConfig()
) -> DataFrame:
    """:func:`within_portfolio_limits` of plans that come in lots, cheapest first and then by ``plan_id``.

    ``lots``: account, sector, underlying_symbol, equity, exact_max_loss, quantity, count, and what
    ``expand`` makes the lot's plans of, a row each with ``plan_id``.  Risk is positive and an account
    has one equity (others are refused), so a limit is broken from one plan on and never kept again.
    Sums by loss tell the loss of that plan; only plans of such a loss are put in order, all others
    know their reasons from the loss of their lot and never move.
    """
    c = F.col
    by = ["account", "sector", "underlying_symbol"]
    lots = lots.withColumn("_risk", c("exact_max_loss") * c("quantity"))
    sound = F.coalesce((c("_risk") > 0) & c("equity").isNotNull(), F.lit(False))
    sums, _ = settle_counted(lots.groupBy(*by, "exact_max_loss").agg(
        F.sum(c("_risk") * c("count")).alias("_sum"), F.min("equity").alias("equity"), F.max("equity").alias("_most"),
        F.count(F.when(~sound, 1)).alias("_bad"),
    ), "lot-sums")
    guards.refuse(
        sums.groupBy("account").agg(F.sum("_bad").alias("_bad"), F.min("equity").alias("equity"), F.max("_most").alias("_most")),
        (c("_bad") > 0) | (c("equity") != c("_most")), guards.IntegrityError,
        "a plan's risk is missing or not positive, or its account's equity is missing or not one", ["account"],
    )
    limits = {
        "total": (["account"], config.total_open_risk_fraction), "sector": (["account", "sector"], config.sector_open_risk_fraction),
    }
    over = lambda col, name: c(col) > c("equity").cast("decimal(20,4)") * F.lit(limits[name][1])

    def losses(name: str) -> DataFrame:
        """The loss at which a limit is first broken, and the risk of everything cheaper."""
        keys = limits[name][0]
        per_loss = sums.groupBy(*keys, "exact_max_loss").agg(F.sum("_sum").alias("_sum"), F.min("equity").alias("equity"))
        per_loss = counted(per_loss, known_rows(sums))
        [heavy] = spread.is_heavy(per_loss, keys)
        run = spread.running(per_loss, keys, ["exact_max_loss"], heavy, {"_upto": ("sum", c("_sum"))})
        return run.where(over("_upto", name)).groupBy(*keys).agg(
            F.min("exact_max_loss").alias(f"_{name}_loss"), F.min_by(c("_upto") - c("_sum"), "exact_max_loss").alias(f"_{name}_before")
        )

    opened = ["account", "underlying_symbol"]
    marks = sums.groupBy(*by).agg(F.min("equity").alias("_equity"))
    for name, (keys, _) in limits.items():
        marks = spread.join_same(marks, losses(name), keys, "left")
    marks = spread.join_same(marks, sums.groupBy(*opened).agg(F.min("exact_max_loss").alias("_first_loss")), opened)
    marks, _ = settle_counted(marks.drop("_equity"), "lot-marks")
    names = ("total", "sector", "first")
    near = F.lit(False)
    for name in names:
        near = near | F.coalesce(c("exact_max_loss") == c(f"_{name}_loss"), F.lit(False))
    close, _ = settle_counted(expand(_marked(lots, marks, by).where(near)), "lot-plans")

    def plans(name: str, keys: Sequence[str]) -> DataFrame:
        """The plan of the marked loss from which the limit is broken."""
        rows = counted(close.where(c("exact_max_loss") == c(f"_{name}_loss")), known_rows(close))
        [heavy] = spread.is_heavy(rows, keys)
        run = spread.running(rows, keys, ["plan_id"], heavy, {"_here": ("sum", c("_risk"))})
        broken = run.withColumn("_upto", c("_here") + c(f"_{name}_before")).where(over("_upto", name))
        return broken.groupBy(*keys).agg(F.min("plan_id").alias(f"_{name}_plan"))

    first = close.where("exact_max_loss = _first_loss").groupBy(*opened).agg(F.min("plan_id").alias("_first_plan"))
    cuts = marks
    for name, (keys, _) in limits.items():
        cuts = spread.join_same(cuts, plans(name, keys), keys, "left")
    cuts, _ = settle_counted(spread.join_same(cuts, first, opened, "left"), "lot-cuts")
    reasons = {"total": "total_open_risk", "sector": "sector_open_risk", "first": "underlying_already_open"}
    later = lambda name: c("exact_max_loss") > c(f"_{name}_loss")
    behind = {name: c("plan_id") >= c(f"_{name}_plan") for name in limits} | {"first": c("plan_id") > c("_first_plan")}
    beyond = lambda name: later(name) | ((c("exact_max_loss") == c(f"_{name}_loss")) & behind[name])
    told = _marked(lots, cuts, by).withColumns({
        "_near": near, "_told": all_failures([(later(n), reasons[n]) for n in names]),
    })
    exact = all_failures([(beyond(n), reasons[n]) for n in names])
    return expand(told).withColumn("reasons", F.when(c("_near"), exact).otherwise(c("_told"))).drop(
        "_risk", "_near", "_told", "_total_before", "_sector_before", *[f"_{n}_{k}" for n in names for k in ("loss", "plan")]
    )


def _marked(lots: DataFrame, marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lots with the marks of their keys; a small table of marks goes to the lots."""
    small = known_rows(marks) <= max_broadcast_rows(lots.sparkSession)
    return spread.join_same(lots, F.broadcast(marks) if small else marks, keys)


def entry_blackout(instants: DataFrame, zone: str = "America/New_York", opens_at: int = 570,
                   closes_at: int = 960, first: int = 10, final: int = 45) -> DataFrame:
    """Whether an entry at each instant falls outside the permitted part of the session.

    Minutes are local to ``zone``: nothing before the open, in its first ``first`` or the
    final ``final`` minutes, after the close, or on a weekend.
    """
    # The shift moves an instant by the zone's offset; day and clock are then read as UTC.
    local = F.from_utc_timestamp("instant", zone)
    minute = F.floor(F.pmod(F.unix_micros(local), F.lit(DAY_SECONDS * 1_000_000)) / 60_000_000)
    reason = (
        F.when(F.dayofweek(utc_day(local)).isin(1, 7), "market_closed")
        .when((minute < opens_at) | (minute >= closes_at), "market_closed")
        .when(minute < opens_at + first, "first_minutes")
        .when(minute >= closes_at - final, "final_minutes")
    )
    scan = minute.isin(600, 750, 900)
    return instants.withColumns({"blackout": reason, "scheduled_scan": scan})
