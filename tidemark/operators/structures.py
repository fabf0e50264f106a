"""Defined-risk debit verticals: contract gates, pairing, exact payoffs, ranking, rung prices.

Money stays decimal; ratios are compared by cross-multiplication, and prices on the tick
grid are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import guards, spread
from tidemark.functions.exprs import blank, first_failure, ticks, utc_day
from tidemark.settings import settle

CALL_SPREAD = "bull_call_debit_vertical"
PUT_SPREAD = "bear_put_debit_vertical"
_WIDE = "decimal(28,8)"
QUOTE = ("bid", "ask", "bid_size", "ask_size", "quote_time")
SIDES = {"long": "buy", "short": "sell"}


@dataclass(frozen=True)
class StructureRules:
    dte_min: int = 7
    dte_max: int = 21
    max_quote_age_seconds: int = 900
    max_relative_spread: Decimal = Decimal("0.25")
    max_absolute_spread: Decimal = Decimal("0.50")
    long_abs_delta_min: Decimal = Decimal("0.45")
    long_abs_delta_max: Decimal = Decimal("0.65")
    short_abs_delta_min: Decimal = Decimal("0.20")
    short_abs_delta_max: Decimal = Decimal("0.40")
    expected_feed: str = "indicative"


def contract_rejection(rules: StructureRules) -> Column:
    """First gate a contract fails for its candidate (as_of, quantity)."""
    c = F.col
    dte = F.datediff("expiry", utc_day(F.col("as_of")))
    age = F.unix_micros("as_of") - F.unix_micros("quote_time")
    gap, total = c("ask") - c("bid"), c("ask") + c("bid")
    return first_failure(
        [
            ((dte < rules.dte_min) | (dte > rules.dte_max), "dte_window"),
            ((c("bid") <= 0) | (c("ask") <= 0) | (c("bid") > c("ask")), "quote_integrity"),
            ((age < 0) | (age > rules.max_quote_age_seconds * 1_000_000), "quote_freshness"),
            (c("multiplier").isNull() | (c("multiplier") <= 0), "contract_metadata"),
            (c("delta").isNull(), "delta_required"),
            (gap * 2 > total * F.lit(rules.max_relative_spread), "relative_spread"),
            (gap > F.lit(rules.max_absolute_spread), "absolute_spread"),
            (
                F.coalesce((c("bid_size") < c("quantity")) | (c("ask_size") < c("quantity")), F.lit(True)),
                "displayed_size",
            ),
            (c("feed") != rules.expected_feed, "feed_identity"),
        ]
    )


def screened_contracts(
    candidates: DataFrame, contracts: DataFrame, rules: StructureRules
) -> DataFrame:
    """Each candidate's contracts of the wanted type with ``rejection`` and leg bands.

    ``candidates``: candidate_id, kind, underlying_symbol, as_of, quantity.
    """
    wanted = F.when(F.col("kind") == CALL_SPREAD, "call").otherwise("put")
    joined = candidates.withColumn("option_type", wanted).join(
        contracts.dropDuplicates(), ["underlying_symbol", "option_type"]
    )
    delta = F.abs("delta")
    band = lambda lo, hi: F.coalesce((delta >= F.lit(lo)) & (delta <= F.lit(hi)), F.lit(False))
    return joined.withColumns(
        {
            "rejection": contract_rejection(rules),
            "fits_long": band(rules.long_abs_delta_min, rules.long_abs_delta_max),
            "fits_short": band(rules.short_abs_delta_min, rules.short_abs_delta_max),
        }
    ).withColumn(
        "rejection",
        F.coalesce("rejection", F.when(~F.col("fits_long") & ~F.col("fits_short"), F.lit("delta_band"))),
    )


def ambiguous_underlyings(contracts: DataFrame) -> DataFrame:
    """Underlyings with a contract symbol described in two ways: they fail closed."""
    key = ["underlying_symbol", "symbol"]
    return guards.conflicting_keys(contracts, key).select("underlying_symbol").distinct()


def vertical_pairs(passed: DataFrame) -> DataFrame:
    """Every ordered long/short pair of one candidate, expiry and multiplier, with its payoff.

    An equality join on (candidate, expiry, multiplier) with the strike order as residual.
    ``admissible`` says whether 0 < debit < width.  Legs are few and make many pairs, so they are
    dealt to a given number of tasks whatever their size.
    """
    key, parts = ["candidate_id", "expiry", "multiplier"], int(passed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    legs = passed.where("rejection is null").withColumn(
        "side", F.when(F.col("kind") == CALL_SPREAD, F.col("strike")).otherwise(-F.col("strike"))
    )
    pick = lambda flag, tag: legs.where(flag).select(
        "candidate_id", "expiry", "multiplier",
        *[F.col(n).alias(f"{tag}_{n}") for n in ("symbol", "strike", "side", *QUOTE)],
        *(["kind", "quantity", "as_of", "underlying_symbol"] if tag == "long" else []),
    ).repartition(parts, *key)
    pairs = pick("fits_long", "long").join(pick("fits_short", "short"), key).where("long_side < short_side")
    c = F.col
    debit = (c("long_ask") - c("short_bid")).cast("decimal(19,4)")
    width = F.abs(c("short_strike") - c("long_strike")).cast("decimal(19,4)")
    pairs = pairs.withColumns({"net_debit": debit, "width": width})
    return pairs.withColumn("admissible", (c("net_debit") > 0) & (c("net_debit") < c("width")))


def candidate_legs(
    candidates: DataFrame, contracts: DataFrame, rules: StructureRules = StructureRules()
) -> DataFrame:
    """The contracts that pass the gates, a row for each candidate they are a leg of."""
    return screened_contracts(candidates, _clear(contracts), rules).where("rejection is null")


def lots(legs: DataFrame, shared: tuple[str, ...] = ()) -> DataFrame:
    """Admissible pairs in lots: long legs of one strike and ask with short legs of one strike and bid.

    ``count`` is the number of pairs, which share ``net_debit``, ``width`` and with them every
    payoff.  Prices lie on a grid, so lots stay far fewer than pairs; they hold the symbols of their
    legs, and :func:`plans_of_lots` makes the pairs where a lot is.  Legs of a lot agree in the columns
    ``shared``, too, which it has as ``long_`` and ``short_`` columns.
    """
    c = F.col
    key, parts = ["candidate_id", "expiry", "multiplier"], int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = legs.withColumn("side", F.when(c("kind") == CALL_SPREAD, c("strike")).otherwise(-c("strike"))).repartition(parts, *key)
    # A structure around each symbol: a list of plain values would lose a missing one.
    held = lambda tag: [F.count("*").alias(f"{tag}_count"), F.collect_list(F.struct("symbol")).alias(f"{tag}_legs")]
    by = lambda tag, price: [c(n).alias(f"{tag}_{n}") for n in dict.fromkeys(("strike", "side", price, *shared))]
    longs = dealt.where("fits_long").groupBy(*key, "kind", "quantity", "underlying_symbol", *by("long", "ask")).agg(*held("long"))
    shorts = dealt.where("fits_short").groupBy(*key, *by("short", "bid")).agg(*held("short"))
    both = longs.join(shorts, key).where("long_side < short_side").withColumns({
        "net_debit": (c("long_ask") - c("short_bid")).cast("decimal(19,4)"),
        "width": F.abs(c("short_strike") - c("long_strike")).cast("decimal(19,4)"),
        "count": c("long_count") * c("short_count"),
    })
    spent = {"long_ask", "short_bid"} - {f"{tag}_{n}" for tag in ("long", "short") for n in shared}
    return both.where((c("net_debit") > 0) & (c("net_debit") < c("width"))).drop(
        *spent, "long_side", "short_side", "long_count", "short_count"
    )


def plans_of_lots(found: DataFrame) -> DataFrame:
    """Every plan of the lots with its ``plan_id``.

    Both ends of the names are made before they meet, so a plan costs one concatenation.
    """
    tails = F.transform("short_legs", lambda leg: F.coalesce(F.concat(F.lit("/"), leg["symbol"]), F.lit("")))
    heads = found.withColumn("_tails", tails).withColumn("_long", F.explode("long_legs")).withColumn(
        "_head", F.concat_ws("/", "candidate_id", "_long.symbol")
    )
    pairs = heads.withColumn("_tail", F.explode("_tails")).withColumn("plan_id", F.concat("_head", "_tail"))
    return pairs.drop("long_legs", "short_legs", "_long", "_tails", "_head", "_tail")


def pair_outcomes(passed: DataFrame) -> DataFrame:
    """Per candidate whether some pair is admissible (``_good``) and some is not (``_bad``), from legs alone.

    With x for the strike in the direction of the spread, a pair is admissible when the short leg's
    bid is below the long leg's ask and its bid + x above the long leg's ask + x; that x rises from
    long to short follows.  So the largest bid + x among lower bids decides for an ask.  A pair fails
    when x rises and the bid reaches the ask, or its bid + x does not exceed the ask + x: the
    extremes of bid and bid + x behind each x decide.  Pairs are never formed.
    """
    c = F.col
    key = ["candidate_id", "expiry", "multiplier"]
    x = F.when(c("kind") == CALL_SPREAD, c("strike")).otherwise(-c("strike"))
    legs = passed.where("rejection is null").select(
        *key, x.cast("decimal(19,4)").alias("x"), F.when(c("fits_long"), c("ask")).cast("decimal(19,4)").alias("ask"),
        F.when(c("fits_short"), c("bid")).cast("decimal(19,4)").alias("bid"),
    ).dropna(subset=[*key, "x"])
    prices = settle(
        legs.groupBy(*key, "x").agg(
            F.min("ask").alias("least_ask"), F.max("ask").alias("most_ask"), F.max("bid").alias("most_bid"),
            F.min("bid").alias("least_bid"),
        ), "leg-prices",
    )
    [heavy] = spread.is_heavy(prices, key)
    behind = prices.select(*key, (-c("x")).alias("_at"), F.lit(1).alias("_kind"), c("most_bid"), (c("least_bid") + c("x")).alias("least_end"),
                           F.lit(None).cast("decimal(19,4)").alias("least_ask"), F.lit(None).cast("decimal(20,4)").alias("ask_end"))
    asked = prices.select(*key, (-c("x")).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("decimal(19,4)").alias("most_bid"),
                          F.lit(None).cast("decimal(20,4)").alias("least_end"), c("least_ask"), (c("most_ask") + c("x")).alias("ask_end"))
    seen = spread.running(
        behind.unionByName(asked), key, ["_at", "_kind"], heavy,
        {"_bid": ("max", c("most_bid")), "_end": ("min", c("least_end"))},
    )
    bad = seen.where((c("_bid") >= c("least_ask")) | (c("_end") <= c("ask_end"))).select("candidate_id").distinct()

    shorts = legs.where("bid is not null").groupBy(*key, "bid").agg(F.max(c("bid") + c("x")).alias("_short_end"))
    longs = legs.where("ask is not null").groupBy(*key, "ask").agg(F.min(c("ask") + c("x")).alias("_long_end"))
    # An ask stands before an equal bid, which is not below it.
    offers = longs.select(*key, c("ask").alias("_at"), F.lit(0).alias("_kind"), "_long_end", F.lit(None).cast("decimal(20,4)").alias("_short_end"))
    bids = shorts.select(*key, c("bid").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("decimal(20,4)").alias("_long_end"), "_short_end")
    prices = settle(offers.unionByName(bids), "leg-offers")
    [heavy] = spread.is_heavy(prices, key)
    best = spread.running(prices, key, ["_at", "_kind"], heavy, {"_best": ("max", c("_short_end"))})
    good = best.where(c("_best") > c("_long_end")).select("candidate_id").distinct()
    both = good.withColumn("_good", F.lit(1)).unionByName(bad.withColumn("_bad", F.lit(1)), allowMissingColumns=True)
    return both.groupBy("candidate_id").agg(F.coalesce(F.max("_good"), F.lit(0)).alias("_good"), F.coalesce(F.max("_bad"), F.lit(0)).alias("_bad"))


def _money(col: Column) -> Column:
    return F.bround(col, 4).cast("decimal(28,4)")


def max_loss() -> Column:
    """What a pair of ``net_debit`` and ``multiplier`` can lose."""
    return _money(F.col("net_debit") * F.col("multiplier"))


def _max_profit() -> Column:
    return _money((F.col("width") - F.col("net_debit")) * F.col("multiplier"))


def payoffs() -> list[Column]:
    """Bound, extremes and breakeven of a pair of ``kind``, ``long_strike``, ``net_debit``, ``width`` and ``multiplier``."""
    c = F.col
    ends = F.when(c("kind") == CALL_SPREAD, c("long_strike") + c("net_debit")).otherwise(c("long_strike") - c("net_debit"))
    return [
        c("net_debit").cast("decimal(28,4)").alias("entry_limit_bound"), max_loss().alias("exact_max_loss"),
        _max_profit().alias("exact_max_profit"), _money(ends).alias("expiry_breakeven"),
    ]


def _plan_id() -> Column:
    return F.concat_ws("/", "candidate_id", "long_symbol", "short_symbol")


def ranked_plans(pairs: DataFrame) -> DataFrame:
    """Admissible plans in their total order, cheapest share of the width first."""
    c = F.col
    good = pairs.where("admissible").withColumn(
        "cost_drag", c("net_debit").cast("decimal(18,4)") / c("width").cast("decimal(18,4)")
    )
    order = ["cost_drag", "expiry", "long_strike", "long_symbol", "short_strike", "short_symbol"]
    [heavy] = spread.is_heavy(good, ["candidate_id"])
    placed = spread.numbered(good, ["candidate_id"], order, heavy, name="rank")
    leg = lambda tag, side: F.struct(
        c(f"{tag}_symbol").alias("symbol"), F.lit(1).alias("ratio_qty"), F.lit(side).alias("side"),
        F.lit(f"{side}_to_open").alias("position_intent"),
    )
    return placed.select(
        "candidate_id", "rank",
        _plan_id().alias("plan_id"),
        "kind", "underlying_symbol", "as_of", "expiry", "quantity", "multiplier",
        F.array(leg("long", "buy"), leg("short", "sell")).alias("legs"),
        *payoffs(), (-max_loss()).alias("stress_max_loss"), _max_profit().alias("stress_max_profit"),
        c("long_quote_time"), c("short_quote_time"), "cost_drag",
    )


def enumerate_candidates(
    candidates: DataFrame, contracts: DataFrame, rules: StructureRules = StructureRules()
) -> tuple[DataFrame, DataFrame]:
    """All admissible plans, and for candidates without one the sorted distinct reasons."""
    return ranked_plans(candidate_pairs(candidates, contracts, rules)), no_trades(candidates, contracts, rules)


def _clear(contracts: DataFrame) -> DataFrame:
    return contracts.join(ambiguous_underlyings(contracts), "underlying_symbol", "left_anti")


def candidate_pairs(
    candidates: DataFrame, contracts: DataFrame, rules: StructureRules = StructureRules()
) -> DataFrame:
    """The pairs of every candidate's contracts that pass the gates."""
    return vertical_pairs(screened_contracts(candidates, _clear(contracts), rules))


def no_trades(
    candidates: DataFrame, contracts: DataFrame, rules: StructureRules = StructureRules()
) -> DataFrame:
    """The sorted distinct reasons of candidates without an admissible plan, without forming pairs."""
    unclear, clear = ambiguous_underlyings(contracts), _clear(contracts)
    passed = screened_contracts(candidates, clear, rules)

    some = lambda flag: F.max(F.when(flag, 1).otherwise(0))
    per_contract = passed.groupBy("candidate_id").agg(F.collect_set("rejection").alias("_gates"))
    # Whether a long and a short leg differ in expiry follows from the extremes of each side;
    # no pair has to be looked at.  The same holds for multipliers within one expiry.
    legs = passed.where("rejection is null")
    side = lambda flag, col, fn: fn(F.when(F.col(flag), F.col(col)))
    differ = lambda n: (F.col(f"_l0{n}") != F.col(f"_s1{n}")) | (F.col(f"_l1{n}") != F.col(f"_s0{n}"))
    ends = lambda col, n: [
        side("fits_long", col, F.min).alias(f"_l0{n}"), side("fits_long", col, F.max).alias(f"_l1{n}"),
        side("fits_short", col, F.min).alias(f"_s0{n}"), side("fits_short", col, F.max).alias(f"_s1{n}"),
    ]
    by_expiry = legs.groupBy("candidate_id", "expiry").agg(
        *ends("multiplier", "m"), *ends("expiry", "e")
    )
    per_leg = by_expiry.groupBy("candidate_id").agg(
        *[fn(f"_{k}e").alias(f"_{k}e") for k, fn in (("l0", F.min), ("l1", F.max), ("s0", F.min), ("s1", F.max))],
        some(F.coalesce(differ("m"), F.lit(False))).alias("_multipliers"),
    )
    per_pair = pair_outcomes(passed)
    present = clear.groupBy("underlying_symbol").agg(
        some(F.col("option_type") == "call").alias("_calls"), some(F.col("option_type") == "put").alias("_puts")
    )
    told = (
        candidates.join(unclear.withColumn("_unclear", F.lit(True)), "underlying_symbol", "left")
        .join(present, "underlying_symbol", "left")
        .join(per_contract, "candidate_id", "left")
        .join(per_leg, "candidate_id", "left")
        .join(per_pair, "candidate_id", "left")
        .where(F.coalesce("_good", F.lit(0)) == 0)
    )
    c = F.col
    no_type = F.when(
        (c("kind") == CALL_SPREAD) & (c("_calls") == 0), "no_call_contracts"
    ).when((c("kind") == PUT_SPREAD) & (c("_puts") == 0), "no_put_contracts")
    reasons = F.array_compact(
        F.concat(
            F.coalesce("_gates", F.array().cast("array<string>")),
            F.array(
                F.when(F.coalesce(differ("e"), F.lit(False)), F.lit("expiry_match")),
                F.when(c("_multipliers") == 1, F.lit("contract_metadata")),
                F.when(c("_bad") == 1, F.lit("payoff_invariant")),
            ),
        )
    )
    final = (
        F.when(c("_unclear"), F.array(F.lit("contract_symbol_uniqueness")))
        .when(c("_calls").isNull(), F.array(F.lit("no_contracts")))
        .when(no_type.isNotNull(), F.array(no_type))
        .when(F.size(reasons) == 0, F.array(F.lit("delta_band")))
        .otherwise(F.array_sort(F.array_distinct(reasons)))
    )
    return told.select("candidate_id", final.alias("rejection_reasons"))


def priced_legs(plans: DataFrame, quotes: DataFrame, max_quote_age_seconds: int) -> DataFrame:
    """Each plan leg with its quote and the first reason it cannot be priced."""
    legs = plans.select("plan_id", "as_of", "quantity", F.posexplode("legs").alias("leg_no", "leg"))
    legs = legs.select("plan_id", "as_of", "quantity", "leg_no", "leg.symbol", "leg.ratio_qty", "leg.side")
    book = quotes.select("symbol", *QUOTE)
    return legs.join(book, "symbol", "left").withColumn("problem", _leg_problem(F.col, max_quote_age_seconds))


def _leg_problem(c: Callable[[str], Column], max_quote_age_seconds: int) -> Column:
    """The first reason a leg cannot be priced, of columns that ``c`` finds by name."""
    need = c("ratio_qty") * c("quantity")
    age = F.unix_micros(c("as_of")) - F.unix_micros(c("quote_time"))
    return first_failure(
        [
            (blank(c("symbol")), "leg_symbol"),
            (c("bid").isNull(), "quote_missing"),
            (F.coalesce(c("ratio_qty") <= 0, F.lit(True)), "leg_ratio"),
            (~F.coalesce(c("side").isin("buy", "sell"), F.lit(False)), "leg_side"),
            ((c("bid") <= 0) | (c("ask") <= 0), "non_positive_market"),
            (c("bid") > c("ask"), "crossed_market"),
            (F.coalesce(c("bid_size") < need, F.lit(True)), "bid_size"),
            (F.coalesce(c("ask_size") < need, F.lit(True)), "ask_size"),
            (age < 0, "quote_after_as_of"),
            (age > max_quote_age_seconds * 1_000_000, "quote_stale"),
        ]
    )


def _leg_prices(c: Callable[[str], Column]) -> tuple[Column, Column]:
    """What a leg adds to twice the midpoint and to the natural debit, in ticks."""
    bid, ask, buy = ticks(c("bid")), ticks(c("ask")), c("side") == "buy"
    return F.when(buy, 1).otherwise(-1) * c("ratio_qty") * (bid + ask), c("ratio_qty") * F.when(buy, ask).otherwise(-bid)


def rung_prices(
    plans: DataFrame, quotes: DataFrame, rungs: int, max_quote_age_seconds: int = 900
) -> DataFrame:
    """``rungs`` net debits per plan from midpoint to natural, each rounded up to the tick.

    Returns plan_id, reason and prices; exactly one of the last two is NULL.
    """
    c = F.col
    twice_mid, natural = _leg_prices(c)
    summed = priced_legs(plans, quotes, max_quote_age_seconds).groupBy("plan_id").agg(
        F.sum(twice_mid).alias("mid2"), F.sum(natural).alias("nat"),
        F.min(F.when(c("problem").isNotNull(), F.struct("leg_no", "problem"))).alias("_first"),
    ).withColumn("problem", c("_first.problem"))
    rows = plans.select("plan_id", ticks(c("entry_limit_bound")).alias("bound")).join(summed, "plan_id")
    return _rungs(rows, rungs, max_quote_age_seconds, "plan_id")


def pair_rung_prices(pairs: DataFrame, rungs: int, max_quote_age_seconds: int = 900) -> DataFrame:
    """:func:`rung_prices` of the admissible pairs by the quotes their legs were paired on.

    A pair carries both quotes, so it is priced where the join makes it and never moves.
    """
    of = lambda tag: _one(tag, lambda n: F.col(f"{tag}_{n}" if n in ("symbol", *QUOTE) else n))
    rows = pairs.where("admissible").select(
        _plan_id().alias("plan_id"), *_vertical_terms(of),
        F.coalesce(*[_leg_problem(of(tag), max_quote_age_seconds) for tag in SIDES]).alias("problem"),
    )
    return _rungs(rows, rungs, max_quote_age_seconds, "plan_id")


def lot_rung_prices(legs: DataFrame, rungs: int, max_quote_age_seconds: int = 900) -> DataFrame:
    """:func:`pair_rung_prices` of all admissible pairs of the legs, in lots that share a reason or prices.

    What a leg brings to its pairs are strike, bid, ask and the first problem of its own, so pairs of
    legs equal in these are priced once.  Returns candidate_id, long_legs, short_legs, reason and
    prices; :func:`plans_of_lots` names the plans.
    """
    problem = _leg_problem(_one("long", F.col), max_quote_age_seconds)
    found = lots(legs.withColumn("problem", problem), ("bid", "ask", "problem"))
    of = lambda tag: _one(tag, lambda n: F.col(f"{tag}_{n}"))
    held = ("candidate_id", "long_legs", "short_legs")
    rows = found.select(*held, *_vertical_terms(of), F.coalesce("long_problem", "short_problem").alias("problem"))
    return _rungs(rows, rungs, max_quote_age_seconds, *held)


def _one(tag: str, named: Callable[[str], Column]) -> Callable[[str], Column]:
    """A leg of a vertical: one contract on its side, everything else as ``named`` finds it."""
    fixed = {"side": F.lit(SIDES[tag]), "ratio_qty": F.lit(1)}
    return lambda n: fixed[n] if n in fixed else named(n)


def _vertical_terms(of: Callable[[str], Callable[[str], Column]]) -> list[Column]:
    """Bound, twice the midpoint and natural debit of a long and a short leg, in ticks."""
    mids, naturals = zip(*[_leg_prices(of(tag)) for tag in SIDES])
    return [ticks(F.col("net_debit")).alias("bound"), (mids[0] + mids[1]).alias("mid2"), (naturals[0] + naturals[1]).alias("nat")]


def _rungs(rows: DataFrame, rungs: int, max_quote_age_seconds: int, *kept: str) -> DataFrame:
    """Rung prices of bound, mid2, nat and the first problem of a leg, beside the columns ``kept``."""
    if rungs <= 0 or max_quote_age_seconds <= 0:
        raise ValueError("rungs and the quote age must be positive")
    c = F.col
    up = lambda num, den: F.floor((num + (den - 1)) / den).cast("long") if den == 1 else F.expr(
        f"({num}) div {den} + cast(pmod({num}, {den}) > 0 as bigint)"
    )
    steps = max(rungs - 1, 1)
    den = 2 * steps
    price = lambda i: f"mid2 * {steps} + (2 * nat - mid2) * {i}"
    rows = rows.withColumns({f"_p{i}": up(price(i), den) for i in range(rungs)})
    climbing = F.lit(True)
    for i in range(1, rungs):
        climbing = climbing & (c(f"_p{i}") > c(f"_p{i - 1}"))
    mid_up = F.expr("mid2 div 2 + cast(pmod(mid2, 2) > 0 as bigint)")
    reason = F.coalesce(
        c("problem"),
        first_failure(
            [
                (c("mid2") <= 0, "midpoint_not_positive"),
                (c("nat") <= 0, "natural_not_positive"),
                (mid_up > c("bound"), "midpoint_above_bound"),
                (c("nat") > c("bound"), "natural_above_bound"),
                (F.lit(rungs > 1) & (c("nat") * 2 <= c("mid2")), "not_increasing"),
                (~climbing, "not_increasing"),
            ]
        ),
    )
    money = lambda t: (t.cast("decimal(20,0)") / F.lit(10000).cast("decimal(5,0)")).cast("decimal(18,4)")
    as_money = F.array(*[money(c(f"_p{i}")) for i in range(rungs)])
    return rows.withColumn("reason", reason).select(*kept, "reason", F.when(c("reason").isNull(), as_money).alias("prices"))
