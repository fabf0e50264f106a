import random
from datetime import date, datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tests.builders import as_dicts
from tidemark.functions import guards
from tidemark.operators import risk, structures as st
from tidemark.settings import settle_counted

NOW = datetime(2026, 6, 1, 15)
CHAIN = (
    "symbol string, underlying_symbol string, option_type string, strike decimal(18,4), bid decimal(18,4), "
    "ask decimal(18,4), expiry date, bid_size int, ask_size int, multiplier int, delta decimal(18,8), "
    "quote_time timestamp, feed string"
)


def contract(symbol, strike, bid, ask, delta, kind="call", **change):
    row = dict(
        symbol=symbol, underlying_symbol="U", option_type=kind, strike=D(strike), bid=D(bid), ask=D(ask),
        expiry=date(2026, 6, 15), bid_size=50, ask_size=50, multiplier=100,
        delta=None if delta is None else D(delta),
        quote_time=NOW - timedelta(seconds=10), feed="indicative",
    )
    row.update(change)
    return tuple(row.values())


LONG = contract("L", "100", "2.90", "3.00", "0.52")
SHORT = contract("S", "105", "1.20", "1.30", "0.30")


def enumerated(spark, rows, kind=st.CALL_SPREAD, quantity=2):
    asked = spark.createDataFrame(
        [("cand", kind, "U", NOW, quantity)],
        "candidate_id string, kind string, underlying_symbol string, as_of timestamp, quantity int",
    )
    plans, none = st.enumerate_candidates(asked, spark.createDataFrame(rows, CHAIN))
    return plans, [r["rejection_reasons"] for r in as_dicts(none)]


def test_golden_call_spread(spark):
    plans, none = enumerated(spark, [LONG, SHORT])
    [row] = as_dicts(plans)
    got = [row[k] for k in ("entry_limit_bound", "exact_max_loss", "exact_max_profit", "expiry_breakeven")]
    assert got == [D("1.8000"), D("180"), D("320"), D("101.8")] and none == []
    assert row["plan_id"] == "cand/L/S"


def test_put_mirror(spark):
    rows = [contract("L", "105", "2.90", "3.00", "-0.52", "put"), contract("S", "100", "1.20", "1.30", "-0.30", "put")]
    plans, _ = enumerated(spark, rows, st.PUT_SPREAD)
    assert plans.first().expiry_breakeven == D("103.2")


@pytest.mark.parametrize(
    "change, reason",
    [
        (dict(expiry=date(2026, 6, 5)), "dte_window"), (dict(bid=D(0)), "quote_integrity"),
        (dict(quote_time=NOW + timedelta(seconds=1)), "quote_freshness"), (dict(multiplier=0), "contract_metadata"),
        (dict(delta=None), "delta_required"), (dict(bid=D("1.00")), "relative_spread"),
        (dict(bid_size=1), "displayed_size"), (dict(feed="other"), "feed_identity"), (dict(delta=D("0.9")), "delta_band"),
    ],
)
def test_each_gate_names_itself(spark, change, reason):
    plans, [reasons] = enumerated(spark, [contract(**{**dict(symbol="L", strike="100", bid="2.90", ask="3.00", delta="0.52"), **change})])
    assert plans.isEmpty() and reasons == [reason]


def test_no_trade_reasons(spark):
    assert enumerated(spark, [contract("P", "100", "2.90", "3.00", "-0.5", "put")])[1] == [["no_call_contracts"]]
    other = contract("S", "105", "1.20", "1.30", "0.30", expiry=date(2026, 6, 16))
    assert enumerated(spark, [LONG, other])[1] == [["expiry_match"]]
    mixed = contract("S", "105", "1.20", "1.30", "0.30", multiplier=10)
    assert enumerated(spark, [LONG, mixed])[1] == [["contract_metadata"]]
    dear = contract("S", "105", "3.10", "3.20", "0.30")
    assert enumerated(spark, [LONG, dear])[1] == [["payoff_invariant"]]
    assert enumerated(spark, [LONG])[1] == [["delta_band"]]
    assert enumerated(spark, [LONG, SHORT, contract("S", "105", "1.21", "1.30", "0.30")])[1] == [["contract_symbol_uniqueness"]]


def test_rung_prices(spark):
    chain = spark.createDataFrame([LONG, SHORT], CHAIN)
    plans, _ = enumerated(spark, [LONG, SHORT])
    four = st.rung_prices(plans, chain, 4).first()
    assert four.prices == [D("1.7000"), D("1.7334"), D("1.7667"), D("1.8000")] and four.reason is None
    assert st.rung_prices(plans, chain, 1).first().prices == [D("1.7000")]
    assert st.rung_prices(plans, chain, 4, 5).first().reason == "quote_stale"
    assert st.rung_prices(plans, chain.where("symbol = 'L'"), 4).first().reason == "quote_missing"


@pytest.mark.parametrize("start, peak, now, want", [
    ("100000", "100000", "98500", ["daily_loss_stop"]), ("100000", "100000", "98500.01", []),
    ("97000", "100000", "97000", ["peak_to_valley_kill_switch"]), ("97000", "100000", "97000.01", []),
    ("100000", "100000", "97000", ["daily_loss_stop", "peak_to_valley_kill_switch"]),
])
def test_equity_stops_are_inclusive(spark, start, peak, now, want):
    row = spark.createDataFrame([(D(start), D(peak), D(now))], "session_start_equity decimal(18,4), peak_equity decimal(18,4), current_equity decimal(18,4)")
    assert risk.equity_stops(row).first().reasons == want


@pytest.mark.parametrize("loss, mode, want", [("180", "standard", 2), ("10", "standard", 3), ("10", "smoke", 1), ("400", "standard", 0)])
def test_sized_quantity(spark, loss, mode, want):
    row = spark.createDataFrame([(D("100000"), D(loss))], "equity decimal(18,4), exact_max_loss decimal(18,4)")
    assert row.select(risk.max_approved_quantity(risk.RiskConfig(), mode).alias("q")).first().q == want


def test_pair_outcomes_equal_the_pairs(spark, small_groups):
    """Legs alone tell which candidates have an admissible pair and which a failing one."""
    rng = random.Random(3)
    rows, asked = [], []
    for u in range(60):
        for n in range(rng.randrange(2, 9)):
            bid = D(rng.randrange(100, 700)) / 100
            rows.append(contract(
                f"c{u}-{n}", rng.choice(["100", "101", "102", "105"]), bid, bid + D("0.10"), rng.choice(["0.5", "0.3"]),
                rng.choice(["call", "call", "put"]), underlying_symbol=f"U{u}", multiplier=rng.choice([10, 100]),
                expiry=date(2026, 6, rng.choice([12, 15])),
            ))
        asked += [(f"{u}-up", st.CALL_SPREAD, f"U{u}", NOW, 2), (f"{u}-down", st.PUT_SPREAD, f"U{u}", NOW, 2)]
    asked = spark.createDataFrame(asked, "candidate_id string, kind string, underlying_symbol string, as_of timestamp, quantity int")
    passed = st.screened_contracts(asked, spark.createDataFrame(rows, CHAIN), st.StructureRules())
    want = {}
    for r in st.vertical_pairs(passed).select("candidate_id", "admissible").collect():
        good, bad = want.get(r.candidate_id, (0, 0))
        want[r.candidate_id] = (max(good, int(r.admissible)), max(bad, int(not r.admissible)))
    assert {r.candidate_id: (r._good, r._bad) for r in st.pair_outcomes(passed).collect()} == want
    assert {(0, 1), (1, 0), (1, 1)} <= set(want.values())


def test_no_trades_form_no_pairs(spark):
    asked = spark.createDataFrame([("cand", st.CALL_SPREAD, "U", NOW, 2)], "candidate_id string, kind string, underlying_symbol string, as_of timestamp, quantity int")
    none = st.no_trades(asked, spark.createDataFrame([LONG, SHORT], CHAIN))
    assert "long_strike" not in none._jdf.queryExecution().toString() and none.isEmpty()


def test_pair_rungs_equal_those_by_symbol(spark):
    """Quotes carried by a pair give what a lookup of its legs gives, and no pair is shuffled."""
    rows = [contract(f"L{n}", "100", D(290 + n) / 100, D(300 + n) / 100, "0.52", bid_size=2 + n % 2) for n in range(4)]
    rows += [contract(f"S{n}", str(103 + n), D(120 - 9 * n) / 100, D(130 - 9 * n) / 100, "0.30",
                      quote_time=NOW - timedelta(seconds=8 * n)) for n in range(4)]
    asked = spark.createDataFrame([("cand", st.CALL_SPREAD, "U", NOW, 2)], "candidate_id string, kind string, underlying_symbol string, as_of timestamp, quantity int")
    chain = spark.createDataFrame(rows, CHAIN)
    pairs = st.candidate_pairs(asked, chain)
    plans = st.ranked_plans(pairs)
    for rungs, age in ((4, 900), (1, 900), (4, 15)):
        key = lambda df: {r.plan_id: (r.reason, r.prices) for r in df.collect()}
        got = key(st.pair_rung_prices(pairs, rungs, age))
        assert got == key(st.rung_prices(plans, chain, rungs, age)) and len(got) == plans.count()
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(st.pair_rung_prices(pairs, 4)) == shuffles(pairs)


def lotted_chain(spark, seed, underlyings=6, legs=60):
    """Legs on a coarse price grid, so lots hold several pairs and losses tie."""
    rng, rows, asked = random.Random(seed), [], []
    for u in range(underlyings):
        for n in range(legs):
            bid = D(rng.choice([200, 230, 260, 290])) / 100
            rows.append(contract(
                f"c{rng.randrange(10**6)}-{n}", rng.choice(["100", "101", "102", "104"]), bid, bid + D("0.10"), rng.choice(["0.5", "0.3"]),
                rng.choice(["call", "put"]), underlying_symbol=f"U{u}", multiplier=rng.choice([10, 100]),
                expiry=date(2026, 6, rng.choice([12, 15])),
            ))
        asked += [(f"{u}-up", st.CALL_SPREAD, f"U{u}", NOW, 2), (f"{u}-down", st.PUT_SPREAD, f"U{u}", NOW, 2)]
    asked = spark.createDataFrame(asked, "candidate_id string, kind string, underlying_symbol string, as_of timestamp, quantity int")
    return asked, spark.createDataFrame(rows, CHAIN)


def owned(df):
    """Two accounts with three underlyings each; two of those share a sector."""
    number = F.substring("underlying_symbol", 2, 9).cast("int")
    return df.withColumns({
        "account": F.concat(F.lit("A"), F.floor(number / 3).cast("string")), "sector": F.when(number % 3 == 0, "x").otherwise("y"),
        "equity": F.when(number < 3, 20_000).otherwise(100_000).cast("decimal(18,4)"),
    })


def test_lot_rungs_equal_those_of_their_pairs(spark):
    """Pairs of legs with equal quotes are priced once, and every plan has the reason and the prices of its pair."""
    rows = [contract(f"L{n}", "100", D(290 + n // 3) / 100, D(300 + n // 3) / 100, "0.52", bid_size=2 + n % 2) for n in range(9)]
    rows += [contract(f"S{n}", str(103 + n // 3), D(120 - 9 * (n // 3)) / 100, D(130 - 9 * (n // 3)) / 100, "0.30",
                      quote_time=NOW - timedelta(seconds=8 * (n % 3))) for n in range(9)]
    rows += [contract(None, "100", "2.90", "3.00", "0.52"), contract(" ", "104", "1.11", "1.21", "0.30", ask_size=None)]
    asked = spark.createDataFrame([("cand", st.CALL_SPREAD, "U", NOW, 2)], "candidate_id string, kind string, underlying_symbol string, as_of timestamp, quantity int")
    chain = spark.createDataFrame(rows, CHAIN)
    legs, pairs = st.candidate_legs(asked, chain), st.candidate_pairs(asked, chain)
    key = lambda df: sorted(((r.plan_id, r.reason, r.prices) for r in df.collect()), key=str)
    for rungs, age in ((4, 900), (1, 900), (4, 15)):
        lots = st.lot_rung_prices(legs, rungs, age)
        want = key(st.pair_rung_prices(pairs, rungs, age))
        assert key(st.plans_of_lots(lots)) == want and 2 * lots.count() < len(want)
        assert len({reason for _, reason, _ in want}) > 1


def test_lots_break_the_limits_that_their_plans_break(spark, small_groups):
    """Limits told by lots are those of a walk over all plans, and no plan is shuffled."""
    from tidemark.functions import spread

    asked, chain = lotted_chain(spark, 11)
    plans = owned(st.ranked_plans(st.candidate_pairs(asked, chain)).drop("rank"))
    walked = risk.within_portfolio_limits(spread.numbered(plans, ["account"], ["exact_max_loss", "plan_id"], False, name="rank"))
    lots = owned(st.lots(st.candidate_legs(asked, chain)).withColumn("exact_max_loss", st.max_loss()))
    told = risk.lots_within_portfolio_limits(lots, st.plans_of_lots)
    key = lambda df: sorted((r.account, r.plan_id, r.exact_max_loss, r.reasons) for r in df.collect())
    assert key(told) == key(walked)
    found = {tuple(r.reasons) for r in told.collect()}
    assert {(), ("sector_open_risk", "underlying_already_open"), ("total_open_risk", "sector_open_risk", "underlying_already_open")} <= found
    assert lots.count() < plans.count()
    plan = told._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange" in plan and "Exchange" not in plan[:plan.rindex("Generate")]


@pytest.mark.parametrize("column, change", [
    ("exact_max_loss", "cast(null as decimal(28,4))"), ("quantity", "0"), ("equity", "cast(null as decimal(18,4))"),
    ("equity", "cast(if(multiplier = 10, 1, 2) as decimal(18,4))"),
])
def test_lots_without_one_positive_risk_and_equity_are_refused(spark, column, change):
    asked, chain = lotted_chain(spark, 12, 1)
    lots = owned(st.lots(st.candidate_legs(asked, chain)).withColumn("exact_max_loss", st.max_loss())).withColumn(column, F.expr(change))
    with pytest.raises(guards.IntegrityError):
        risk.lots_within_portfolio_limits(lots, st.plans_of_lots)


@pytest.mark.parametrize("chunk, batch", [(1, 1), (4, 30), (256, 50_000)])
def test_chunks_rank_as_a_sort_of_all_pairs_does(spark, small_groups, monkeypatch, chunk, batch):
    """Ranks counted by chunks are those of a sort, whatever the chunk, and no pair is shuffled."""
    from tidemark.operators import verticals

    monkeypatch.setattr(verticals, "CHUNK", chunk)
    monkeypatch.setattr(verticals, "BATCH", batch)
    asked, chain = lotted_chain(spark, 13, 6)
    want = st.ranked_plans(st.candidate_pairs(asked, chain))
    got = verticals.placed_plans(settle_counted(st.candidate_legs(asked, chain), "test-legs")[0])
    both = ["candidate_id", "rank", "plan_id", "kind", "expiry", "multiplier", "entry_limit_bound", "exact_max_loss", "exact_max_profit", "expiry_breakeven"]
    rows = sorted(map(tuple, got.select(both).collect()))
    assert rows == sorted(map(tuple, want.select(both).collect())) and len(rows) > 100
    assert want.groupBy("candidate_id", "cost_drag").count().where("count > 1").count() > 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[:plan.index("MapInArrow")]


def test_chunks_without_pairs(spark):
    from tidemark.operators import verticals

    asked, chain = lotted_chain(spark, 13, 1)
    for kept in (chain.limit(0), chain.where("delta = 0.5"), chain.where("delta = 0.3")):
        assert verticals.placed_plans(settle_counted(st.candidate_legs(asked, kept), "test-legs")[0]).isEmpty()
