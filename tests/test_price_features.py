import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.builders import as_dicts, bar, bars, price_panel, sectors, session
from tidemark.functions import guards
from tidemark.operators import panel, price_features as pf

ALL = ["TARGET", "PEER1", "PEER2"]


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "symbol string, as_of timestamp, event_time timestamp")


def late(i):
    return session(i) + timedelta(hours=1)


@pytest.fixture(scope="module")
def golden(spark):
    return bars(spark, price_panel()).cache()


def test_golden_block(spark, golden):
    spine = ask(spark, ("TARGET", late(79), session(78)))
    [row] = as_dicts(pf.feature_block(spine, golden, sectors(spark, ALL)))
    want = {
        "residual_return_1s": 0.02, "residual_return_5s": 0.02, "opening_gap_residual": 0.01,
        "residual_return_zscore": 4.472136, "abnormal_volume": 1.0, "range_over_atr": 2.0,
        "proximity_to_extreme": 0.75, "cumulative_abnormal_return": 0.02,
    }
    assert {k: row[k] for k in want} == pytest.approx(want, abs=1e-6)
    assert row["quality_flags"] == ["abnormal_volume_daily_baseline"]


def test_block_at_one_instant_refuses_bars_seen_later(spark, golden):
    got = {r["symbol"]: r for r in as_dicts(pf.block_at(late(79), golden, sectors(spark, ALL)))}
    assert set(got) == set(ALL) and got["TARGET"]["residual_return_1s"] == pytest.approx(0.02, abs=1e-6)
    with pytest.raises(guards.LeakError):
        pf.block_at(session(40), golden, sectors(spark, ALL))


def test_split_form_is_the_same(spark, golden, small_groups):
    test_golden_block(spark, golden)


def scattered(spark):
    """Five symbols whose bars move at random; some come late, some in runs, one by most of the span."""
    rng = random.Random(12)
    names, held = ["A", "B", "C", "D", "E"], []
    for k, name in enumerate(names):
        price = 100.0 + 10 * k
        for i in range(95):
            if name == "E" and i % 3:
                continue
            price = round(price * (1 + rng.uniform(-0.05, 0.05)), 2)
            wait = timedelta(days=rng.choice([2, 3, 6]), hours=1) if rng.random() < 0.06 else timedelta(minutes=15)
            wait = timedelta(days=70, hours=1) if (name, i) == ("B", 15) else wait
            wait = timedelta(days=9 - i % 7, hours=2) if name == "C" and 50 <= i < 56 else wait
            row = bar(name, i, price, o=price, h=price + 1, l=price - 1, volume=1000 + rng.randint(0, 50))
            held.append((*row[:3], row[2] + wait, *row[4:]))
    return bars(spark, held), sectors(spark, ["A", "B", "C", "E"])


def test_late_bars_equal_the_panel_each_instant_sees(spark):
    """Every instant alone, over only the bars it sees as if they had come in order."""
    panel_rows, mapped = scattered(spark)
    panel_rows = panel_rows.cache()
    instants = [3, 29, 51, 53, 57, 86]
    asked = [(s, late(i), session(i - 8) if i % 2 else None) for s in "ABCDEZ" for i in instants]
    got = {(r["symbol"], r["as_of"]): r for r in as_dicts(pf.feature_block(ask(spark, *asked), panel_rows, mapped))}
    assert len(got) == len(asked)
    for i in instants:
        seen = panel_rows.where(F.col("first_seen_time") <= F.lit(late(i))).withColumn(
            "first_seen_time", F.col("session") + F.expr("interval 15 minutes")
        )
        one = ask(spark, *[a for a in asked if a[1] == late(i)])
        for want in as_dicts(pf.feature_block(one, seen, mapped)):
            row = got[(want["symbol"], want["as_of"])]
            assert row["quality_flags"] == want["quality_flags"], (i, want["symbol"])
            assert [row[f] for f in pf.FEATURES] == pytest.approx([want[f] for f in pf.FEATURES]), (i, want["symbol"])


def test_the_versions_of_a_panel_in_order_are_its_rows(spark, golden):
    """Without late bars every session has one version and no question needs a lookup."""
    spine = ask(spark, *[(s, late(i), session(i - 3)) for s in ALL for i in (4, 30, 79)])
    mapped, config = sectors(spark, ALL), pf.FeatureConfig()
    layout, sizes = panel.Layout.measure(golden), pf._Sizes.measure(spine, golden)
    rows = pf._global_rows(golden, mapped, layout)
    series = pf._series_block(spine, golden, rows, mapped, layout, config, sizes)
    table, calendar = pf._version_table(rows, pf._arrival_order(golden, layout), mapped, layout)
    assert table.count() == golden.count() and calendar.where("first < final").isEmpty()
    versioned = pf._late_block(spine, golden, mapped, layout, config, sizes)
    order = lambda df: df.orderBy("symbol", "as_of").collect()
    assert order(series) == order(versioned)


def test_a_long_wait_costs_a_lookback_of_questions(spark):
    """A bar that is late by most of the span is looked up at a lookback of instants, not at all of them."""
    rows = [r if (r[0], r[2]) != ("B", session(5)) else (*r[:3], session(390), *r[4:])
            for s in ("A", "B", "C") for r in [bar(s, i, 100 + i % 7) for i in range(400)]]
    panel_rows, mapped = bars(spark, rows), sectors(spark, ["A", "B", "C"])
    spine = ask(spark, *[(s, late(i), None) for s in ("A", "B", "C") for i in range(400)])
    layout, sizes = panel.Layout.measure(panel_rows), pf._Sizes.measure(spine, panel_rows)
    told = pf._seen_by_questions(spine, panel_rows, sizes)
    table, _ = pf._version_table(pf._global_rows(told, mapped, layout), pf._arrival_order(told, layout), mapped, layout)
    assert table.count() <= 3 * 400 + 6
    assert pf.feature_block(spine, panel_rows, mapped).count() == 1200


def test_visibility_is_inclusive(spark, golden):
    seen = session(79) + timedelta(minutes=15)
    spine = ask(spark, ("TARGET", seen, None), ("TARGET", seen - timedelta(seconds=1), None))
    got = {r["as_of"]: r["residual_return_1s"] for r in as_dicts(pf.feature_block(spine, golden, sectors(spark, ALL)))}
    assert got[seen] == pytest.approx(0.02)
    assert got[seen - timedelta(seconds=1)] == pytest.approx(0.0)


def test_nothing_visible_is_an_empty_block(spark, golden):
    spine = ask(spark, ("TARGET", session(-1), None), ("NOBODY", late(79), None))
    for row in as_dicts(pf.feature_block(spine, golden, sectors(spark, ALL))):
        assert row["quality_flags"] == ["no_qualifying_data"]
        assert all(row[f] is None for f in pf.FEATURES)


def test_thin_sector_falls_back_to_the_market(spark, golden):
    spine = ask(spark, ("TARGET", late(79), None))
    [row] = as_dicts(pf.feature_block(spine, golden, sectors(spark, ["TARGET", "PEER1"])))
    assert "sector_fallback_market" in row["quality_flags"]
    assert row["residual_return_1s"] == pytest.approx(0.02)


def test_a_symbol_alone_keeps_its_raw_return_and_says_how_often(spark):
    rows = [bar("ONLY", i, 100 + i) for i in range(4)]
    [row] = as_dicts(
        pf.feature_block(ask(spark, ("ONLY", late(3), None)), bars(spark, rows), sectors(spark, ["ONLY"]))
    )
    assert "no_peer_data:3" in row["quality_flags"]
    assert row["residual_return_1s"] == pytest.approx(103 / 102 - 1)


def test_late_bar_is_invisible_until_it_arrives(spark):
    rows = price_panel()
    held = [r if (r[0], r[2]) != ("PEER1", session(79)) else (*r[:3], session(85), *r[4:]) for r in rows]
    panel_rows = bars(spark, held)
    spine = ask(spark, ("TARGET", late(79), None), ("PEER1", late(79), None), ("PEER1", session(90), None))
    waiting = pf.disturbed_instants(spine, panel_rows).collect()
    assert [(r.as_of, r.front) for r in waiting] == [(late(79), session(79))]
    got = {(r["symbol"], r["as_of"]): r for r in as_dicts(pf.feature_block(spine, panel_rows, sectors(spark, ALL)))}
    assert got[("TARGET", late(79))]["residual_return_1s"] == pytest.approx(0.02)
    # On its own 79th session TARGET's move shows in PEER1's demeaned return only once PEER1's bar is there.
    assert got[("PEER1", late(79))]["residual_return_1s"] == pytest.approx(0.0)
    assert got[("PEER1", session(90))]["residual_return_1s"] == pytest.approx(-0.01)


def test_contradicting_bars_stop_the_job_and_repeats_collapse(spark):
    same = bar("A", 0, 100)
    assert panel.checked_bars(bars(spark, [same, same])).count() == 1
    with pytest.raises(guards.AmbiguityError):
        panel.checked_bars(bars(spark, [same, bar("A", 0, 101)]))


@pytest.mark.parametrize("broken", [
    bar("A", 0, 100, h=99, l=98), bar("A", 0, 100, o=0, l=0), bar(" ", 0, 100), bar("A", 0, 100, volume=-1),
])
def test_malformed_bars_are_refused(spark, broken):
    with pytest.raises(guards.IntegrityError):
        panel.checked_bars(bars(spark, [broken]))


def test_row_order_and_partitioning_do_not_matter(spark, golden):
    spine = ask(spark, *[(s, late(i), None) for s in ALL for i in (25, 60)])
    mapped = sectors(spark, ALL)
    one = pf.feature_block(spine, golden, mapped).orderBy("symbol", "as_of").collect()
    two = pf.feature_block(spine, golden.orderBy(F.desc("session")).repartition(7), mapped)
    assert one == two.orderBy("symbol", "as_of").collect()


def test_configuration_is_checked_and_versioned():
    with pytest.raises(ValueError):
        pf.FeatureConfig(lookback_sessions=10)
    assert pf.FeatureConfig().version != pf.FeatureConfig(atr_sessions=13).version


def test_late_bars_in_the_split_form(spark, small_groups):
    test_late_bar_is_invisible_until_it_arrives(spark)
