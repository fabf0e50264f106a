"""Measuring forecasts and accounts: rank IC, permutation null, deciles, attribution, drawdown."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import guards, spread
from tidemark.functions.exprs import sign


class ArmMismatch(ValueError):
    """Two arms were not measured on the same folds and labels."""


def seeded_order(seed: str, salt: str, member: Column) -> Column:
    """A number in [0, 2**60) fixed by seed, salt and member."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.lit(salt), member), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def shuffled_within_date(labels: DataFrame, date: str, value: str, seed: str) -> DataFrame:
    """Permute ``value`` among the labels of each date; nothing crosses a date.

    Two seeded orders of a date's labels are matched position by position, so the result
    depends on the seed and the ids alone.
    """
    rows = labels.select(
        "label_id", date, value,
        seeded_order(seed, "from", F.col("label_id")).alias("_from"),
        seeded_order(seed, "to", F.col("label_id")).alias("_to"),
    )
    [heavy] = spread.is_heavy(rows, [date])
    givers = spread.numbered(rows.select(date, value, "_from", "label_id"), [date], ["_from", "label_id"], heavy)
    takers = spread.numbered(rows.select(date, "_to", "label_id"), [date], ["_to", "label_id"], heavy)
    given = givers.select(date, "pos", F.col(value).alias(f"shuffled_{value}"))
    return spread.join_same(takers.select(date, "pos", "label_id"), given, [date, "pos"]).drop("pos")


def average_ranks(df: DataFrame, key: str, value: str, heavy: bool, name: str) -> DataFrame:
    """Rank within the key, ties sharing their mean rank."""
    if not heavy:
        w = W.partitionBy(key)
        ties = F.count("*").over(W.partitionBy(key, value))
        return df.withColumn(name, F.rank().over(w.orderBy(value)) + (ties - 1) / 2.0)
    placed = spread.numbered(df, [key], [value, "label_id"], True, name="_at")
    shared = placed.groupBy(key, value).agg(F.avg("_at").alias(name))
    return spread.join_same(placed.drop("_at"), shared, [key, value])


def daily_ic(scored: DataFrame, date: str = "date") -> DataFrame:
    """Spearman correlation of prediction and outcome per date, with why a date has none.

    ``scored``: label_id, the date, prediction, outcome, uniqueness.
    """
    [heavy] = spread.is_heavy(scored, [date])
    ranked = average_ranks(scored, date, "prediction", heavy, "_p")
    ranked = average_ranks(ranked, date, "outcome", heavy, "_o")
    per = ranked.groupBy(date).agg(
        F.count("*").alias("n"), F.sum("uniqueness").alias("effective_size"),
        F.try_divide(F.covar_pop("_p", "_o"), F.stddev_pop("_p") * F.stddev_pop("_o")).alias("_ic"),
        (F.min("_p") == F.max("_p")).alias("_flat_p"), (F.min("_o") == F.max("_o")).alias("_flat_o"),
    )
    reason = (
        F.when(F.col("n") < 2, "too_few_scored")
        .when(F.col("_flat_p"), "constant_prediction")
        .when(F.col("_flat_o"), "constant_outcome")
    )
    return per.select(
        date, "n", "effective_size", reason.alias("excluded"),
        F.when(reason.isNull(), F.col("_ic")).alias("ic"),
    )


def ic_summary(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean IC and its t-statistic on the effective size, which is the sum of uniqueness.

    The dates are discounted by effective size over rows.  The correction covers overlap
    within a symbol, not dependence across symbols on one date; the flag says so.
    """
    used = F.col("excluded").isNull()
    out = daily.groupBy(*by).agg(
        F.count(F.when(used, 1)).alias("dates"),
        F.count(F.when(~used, 1)).alias("excluded_dates"),
        F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("_sd"),
        F.sum(F.when(used, F.col("effective_size"))).alias("effective_sample_size"),
        F.sum(F.when(used, F.col("n"))).alias("_rows"),
    )
    share = F.col("effective_sample_size") / F.col("_rows")
    t = F.try_divide(F.col("mean_ic"), F.col("_sd")) * F.sqrt(F.col("dates") * share)
    return out.withColumn("ic_t_statistic", t).drop("_sd", "_rows").withColumn(
        "quality_flags", F.array(F.lit("no_cross_sectional_dependence_correction"))
    )


def deflated_t(observed: Column, trials: int) -> Column:
    """The t-statistic less the largest one expected from that many independent tries."""
    if trials < 1:
        raise ValueError("at least one trial must be registered")
    if trials == 1:
        return observed
    gamma, normal = 0.5772156649015329, NormalDist()
    best = (1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * math.e))
    return observed - best


def refuse_different_arms(scored: DataFrame) -> None:
    """Every arm must have scored the same (fold, label) set; ``scored`` carries ``arm``."""
    arms = scored.select("arm").distinct().count()
    seen = scored.groupBy("fold", "label_id").agg(F.count_distinct("arm").alias("n"), F.count("*").alias("rows"))
    guards.refuse(
        seen, (F.col("n") != arms) | (F.col("rows") != arms), ArmMismatch,
        "arms saw different labels", ["fold", "label_id"],
    )


def net_of_cost(cost: float) -> Column:
    """What following the prediction's sign earned after a fixed round-trip charge."""
    return sign(F.col("prediction")) * F.col("outcome") - F.lit(cost)


def hit_rate_after_cost(scored: DataFrame, cost: float, by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.avg((net_of_cost(cost) > 0).cast("double")).alias("hit_rate_after_cost"),
        F.avg(net_of_cost(cost)).alias("mean_net"), F.count("*").alias("n"),
    )


def deciles(scored: DataFrame, date: str = "date") -> DataFrame:
    """Decile of the prediction within its date, 1 to 10, ties broken by label id."""
    [heavy] = spread.is_heavy(scored, [date])
    placed = spread.numbered(scored, [date], ["prediction", "label_id"], heavy)
    sizes = scored.groupBy(date).agg(F.count("*").alias("_n"))
    return spread.join_same(placed, sizes, [date]).withColumn(
        "decile", (F.floor((F.col("pos") - 1) * 10 / F.col("_n")) + 1).cast("int")
    ).drop("pos", "_n")


def decile_means(scored: DataFrame, date: str = "date") -> DataFrame:
    return deciles(scored, date).groupBy("decile").agg(
        F.avg("outcome").alias("mean_outcome"), F.count("*").alias("n")
    )


def decile_spread(means: DataFrame, cost: float) -> DataFrame:
    """Top less bottom decile after the charge on both legs."""
    at = lambda d: F.max(F.when(F.col("decile") == d, F.col("mean_outcome")))
    return means.agg((at(10) - at(1) - 2 * cost).alias("decile_spread_after_cost"))


def attribution(scored: DataFrame, cost: float) -> DataFrame:
    """Net result by symbol, sector, fold, volatility regime, and overall, in one pass.

    Every breakdown adds up to the overall row.
    """
    dims = ["symbol", "sector", "fold", "regime"]
    rows = scored.withColumn("_net", net_of_cost(cost)).withColumn("sector", F.coalesce("sector", F.lit("none")))
    grouped = rows.groupingSets([[d] for d in dims] + [[]], *dims).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), F.sum("_net").alias("net"),
        F.avg((F.col("_net") > 0).cast("double")).alias("hit_rate"),
    )
    which = (
        F.when(F.col("_g") == 0b0111, "symbol").when(F.col("_g") == 0b1011, "sector")
        .when(F.col("_g") == 0b1101, "fold").when(F.col("_g") == 0b1110, "regime").otherwise("all")
    )
    member = F.coalesce("symbol", "sector", F.col("fold").cast("string"), "regime", F.lit("all"))
    return grouped.select(which.alias("dimension"), member.alias("member"), "n", "net", "hit_rate")


def forecast_quality(judged: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Brier score and the precision and recall of the up call.  Needs p_up and y."""
    up, called = F.col("y") > 0, F.col("p_up") >= 0.5
    n = lambda test: F.sum(test.cast("int"))
    return judged.groupBy(*by).agg(
        F.avg(F.pow(F.col("p_up") - up.cast("double"), 2)).alias("brier_score"),
        F.try_divide(n(up & called), n(called)).alias("up_precision"),
        F.try_divide(n(up & called), n(up)).alias("up_recall"),
        F.count("*").alias("n"),
    )


def calibration_curve(judged: DataFrame, bins: int = 10) -> DataFrame:
    """Mean probability and observed frequency per equal-width bin and fold."""
    from tidemark.operators.model import probability_bin

    return judged.groupBy("fold", probability_bin(bins).alias("bin")).agg(
        F.avg("p_up").alias("mean_probability"),
        F.avg((F.col("y") > 0).cast("double")).alias("observed_frequency"), F.count("*").alias("n"),
    )


def account_metrics(readings: DataFrame) -> DataFrame:
    """Per account: largest fall from a running peak, turnover, and time below the peak.

    ``readings``: account, seq, current_equity, peak_equity, change (all exact decimals).
    """
    fall = (F.col("peak_equity") - F.col("current_equity")).cast("double") / F.col("peak_equity").cast("double")
    return readings.groupBy("account").agg(
        F.max(fall).alias("max_drawdown"),
        (F.sum(F.abs("change")).cast("double") / F.avg(F.col("current_equity").cast("double"))).alias("turnover"),
        F.avg((F.col("current_equity") < F.col("peak_equity")).cast("double")).alias("time_below_peak"),
        F.count("*").alias("n"),
    )


def exposure(positions: DataFrame) -> DataFrame:
    """Per account, sector and direction: what was held for how long, and its share of the account.

    ``positions``: account, sector, direction, opened, closed (dates), notional_cents (whole).
    A position counts for its days from ``opened`` to before ``closed``; one that closes before it
    opens, or lacks a day or an amount, counts as ``unusable`` and for nothing else.
    ``average_cents`` is over the account's days from its first opening to its last closing.
    """
    keys = ["account", "sector", "direction"]
    days = F.datediff("closed", "opened")
    fine = F.coalesce((days >= 0) & F.col("notional_cents").isNotNull(), F.lit(False))
    held = (F.abs("notional_cents") * days).cast("decimal(38,0)")
    parts = positions.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(fine, held)), F.lit(0)).alias("cent_days"), F.count(F.when(fine, 1)).alias("positions"),
        F.count(F.when(~fine, 1)).alias("unusable"),
        F.min(F.when(fine, F.col("opened"))).alias("_from"), F.max(F.when(fine, F.col("closed"))).alias("_to"),
    )
    whole = parts.groupBy("account").agg(
        F.sum("cent_days").alias("_all"), F.datediff(F.max("_to"), F.min("_from")).alias("_span")
    )
    number = lambda n: F.col(n).cast("double")
    return spread.join_same(parts, whole, ["account"]).select(
        *keys, "positions", "unusable", F.try_divide(number("cent_days"), number("_all")).alias("share"),
        F.try_divide(number("cent_days"), number("_span")).alias("average_cents"),
    )


def ranked_selection(candidates: DataFrame, cost: float, per_scan: int = 2) -> DataFrame:
    """At most ``per_scan`` candidates per scan by edge after cost.

    One per underlying, then one per sector, then the best of those.  Candidates without a
    positive edge are never taken.
    """
    edge = F.abs("expected_residual_return") - cost
    rows = candidates.where("eligible").withColumn("edge", edge).where("edge > 0")
    best = [F.col("edge").desc(), F.col("candidate_id")]
    for scope in (["underlying_symbol"], ["sector"]):
        w = W.partitionBy("scan", *scope).orderBy(*best)
        rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    w = W.partitionBy("scan").orderBy(*best)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_scan)


def option_surface(chain: DataFrame, stock: DataFrame, required_feed: str = "opra") -> DataFrame:
    """Option-surface features per underlying and instant, only from the required feed.

    ``chain``: underlying_symbol, as_of, option_type, expiry, delta, implied_vol, volume,
    open_interest, prior_open_interest, feed.  ``stock``: underlying_symbol, as_of,
    realized_vol, volume.  Any other feed leaves every feature NULL and says so.
    """
    c = F.col
    usable = c("delta").isNotNull() & c("implied_vol").isNotNull()
    closest = lambda kind, target, expiry: F.min_by(
        c("implied_vol"),
        F.when(
            usable & (c("option_type") == kind) & expiry,
            F.struct(F.abs(F.abs("delta") - F.lit(target).cast("decimal(3,2)")), c("symbol")),
        ),
    )
    ends = chain.groupBy("underlying_symbol", "as_of").agg(F.min("expiry").alias("_near"), F.max("expiry").alias("_far"))
    near, far = c("expiry") == c("_near"), c("expiry") == c("_far")
    total = lambda kind, col: F.sum(F.when(c("option_type") == kind, c(col)).otherwise(0))
    made = chain.join(ends, ["underlying_symbol", "as_of"]).groupBy("underlying_symbol", "as_of").agg(
        F.max((c("feed") != required_feed).cast("int")).alias("_other"),
        closest("put", "0.25", near).alias("_put25"), closest("call", "0.25", near).alias("_call25"),
        closest("call", "0.50", near).alias("_atm_near"), closest("call", "0.50", far).alias("_atm_far"),
        total("call", "volume").alias("_cv"), total("put", "volume").alias("_pv"),
        (total("call", "open_interest") - total("call", "prior_open_interest")).alias("_coi"),
        (total("put", "open_interest") - total("put", "prior_open_interest")).alias("_poi"),
    )
    rows = made.join(
        stock.select("underlying_symbol", "as_of", "realized_vol", c("volume").alias("_sv")),
        ["underlying_symbol", "as_of"], "left",
    )
    enabled = c("_other") == 0
    only = lambda col: F.when(enabled, col)
    return rows.select(
        "underlying_symbol", "as_of",
        only(c("_put25") - c("_call25")).alias("skew_25_delta"),
        only(c("_atm_far") - c("_atm_near")).alias("term_slope"),
        only(c("_atm_near") - c("realized_vol")).alias("implied_less_realized"),
        only(F.try_divide((c("_cv") + c("_pv")).cast("double"), c("_sv").cast("double"))).alias("option_to_stock_volume"),
        only(F.try_divide((c("_cv") - c("_pv")).cast("double"), (c("_cv") + c("_pv")).cast("double"))).alias(
            "call_put_imbalance"
        ),
        only(c("_coi")).alias("call_open_interest_change"), only(c("_poi")).alias("put_open_interest_change"),
        F.when(enabled, F.array().cast("array<string>")).otherwise(
            F.array(F.lit("options_family_disabled"))
        ).alias("quality_flags"),
    )


def sanity_report(bars: DataFrame, extreme: float, stale_seconds: int, future: Column) -> DataFrame:
    """Per symbol: repeated, missing, extreme, stale and future-stamped bars.

    A session is missing when the panel has it between the symbol's first and last but the
    symbol does not.
    """
    from tidemark.operators import panel

    layout = panel.Layout.measure(bars)
    once = bars.groupBy("symbol", "session").agg(F.count("*").alias("copies"))
    calendar = once.select("session").distinct().withColumn("_all", F.lit(0))
    [heavy] = spread.is_heavy(calendar, ["_all"])
    calendar = spread.numbered(calendar, ["_all"], ["session"], heavy, name="day").drop("_all")
    placed = once.join(calendar, "session").groupBy("symbol").agg(
        F.sum(F.col("copies") - 1).alias("repeated"),
        (F.max("day") - F.min("day") + 1 - F.count("*")).alias("missing_sessions"),
    )
    moved = panel.moves(bars, layout).groupBy("symbol").agg(
        F.count(F.when(F.abs("ret") > extreme, 1)).alias("extreme_moves")
    )
    late = F.unix_micros("first_seen_time") - F.unix_micros("session") > stale_seconds * 1_000_000
    stamped = bars.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.count(F.when(late, 1)).alias("stale"),
        F.count(F.when(F.col("first_seen_time") > future, 1)).alias("future_stamped"),
    )
    return stamped.join(placed, "symbol").join(moved, "symbol")
