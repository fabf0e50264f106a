from dataclasses import replace
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.builders import as_dicts, bar, bars, sectors, session
from tidemark.functions import guards
from tidemark.operators import folds, labels, panel, price_features as pf

ALL = ["TARGET", "PEER1", "PEER2"]


def panel_rows(target, peer=lambda i: 50, n=12):
    rows = [bar("TARGET", i, target.get(i, target.get("rest", 100))) for i in range(n)]
    return rows + [bar(p, i, peer(i)) for p in ("PEER1", "PEER2") for i in range(n)]


def label_of(spark, rows, config, at=0, symbol="TARGET", strict=True):
    asked = spark.createDataFrame([(symbol, session(at))], "symbol string, decision_session timestamp")
    [row] = as_dicts(labels.forward_labels(asked, bars(spark, rows), sectors(spark, ALL), config, strict))
    return row


RISING = {0: 100, 1: 150, 2: 165, 3: 181.5, "rest": 181.5}


def test_entry_offset_skips_the_first_move(spark):
    one = label_of(spark, panel_rows(RISING), labels.LabelConfig(horizon_sessions=2))
    assert one["forward_residual_return"] == pytest.approx(0.20)
    assert one["entry_session"] == session(1) and one["exit_session"] == session(3)
    zero = label_of(spark, panel_rows(RISING), labels.LabelConfig(horizon_sessions=2, entry_offset_sessions=0))
    assert zero["forward_residual_return"] == pytest.approx(0.60)
    assert zero["quality_flags"] == ["implausible_magnitude", "untradeable_entry"]


def test_rising_peers_make_a_flat_symbol_negative(spark):
    peer = lambda i: {0: 50, 1: 50, 2: 55}.get(i, 60.5)
    row = label_of(spark, panel_rows({"rest": 100}, peer), labels.LabelConfig(horizon_sessions=2))
    assert row["forward_residual_return"] == pytest.approx(-0.20)


def test_outcome_waits_for_a_peer_bar_behind_a_gap(spark):
    seen = session(4) + timedelta(days=730)
    rows = [r for r in panel_rows({"rest": 100}) if not (r[0] == "PEER1" and r[2] in (session(5), session(6)))]
    rows = [(*r[:3], seen, *r[4:]) if (r[0], r[2]) == ("PEER1", session(4)) else r for r in rows]
    row = label_of(spark, rows, labels.LabelConfig(horizon_sessions=2), at=5)
    assert row["entry_session"] == session(6) and row["outcome_time"] == seen


def test_why_there_is_no_label(spark):
    config = labels.LabelConfig(horizon_sessions=2)
    rows = panel_rows({"rest": 100})
    assert label_of(spark, rows, config, at=-1)["status"] == "no_history"
    assert label_of(spark, rows, config, at=9)["status"] == "incomplete_horizon"
    assert label_of(spark, rows, config, at=11, strict=False)["status"] == "panel_too_short"
    with pytest.raises(labels.InsufficientHistory):
        label_of(spark, rows, config, at=11)
    gone = [r for r in rows if not (r[0] == "TARGET" and r[2] > session(6))]
    assert label_of(spark, gone, config, at=6)["status"] == "delisted"


def test_labels_and_features_share_one_residual(spark):
    rows = bars(spark, panel_rows({i: 100 + (i * 7) % 5 for i in range(12)}, lambda i: 50 + i % 3))
    mapped = sectors(spark, ALL)
    label = label_of(spark, [tuple(r) for r in rows.collect()], labels.LabelConfig(horizon_sessions=1), at=4)
    spine = spark.createDataFrame([("TARGET", session(6) + timedelta(hours=1))], "symbol string, as_of timestamp")
    [block] = as_dicts(pf.feature_block(spine, rows, mapped))
    assert label["forward_residual_return"] == pytest.approx(block["residual_return_1s"])


def test_split_form_gives_the_same_labels(spark, small_groups):
    test_entry_offset_skips_the_first_move(spark)
    test_outcome_waits_for_a_peer_bar_behind_a_gap(spark)
    test_uniqueness(spark)


def test_uniqueness(spark):
    rows = [("a", "X", 1, 2, 1.0), ("b", "X", 2, 2, 1.0), ("c", "Y", 2, 2, 1.0), ("d", "Y", 9, 4, 1.0), ("e", "Y", 9, 4, 1.0)]
    rows += [(f"r{i}", "Z", (i * 7) % 40, 1 + i % 6, 1.0) for i in range(30)]
    schema = "label_id string, symbol string, first_outcome int, sessions_used int, uniqueness double"
    got = {r.label_id: r.uniqueness for r in labels.with_uniqueness(spark.createDataFrame(rows, schema)).collect()}
    open_on = Counter((s, p) for _, s, first, n, _ in rows for p in range(first, first + n))
    want = {i: sum(1 / open_on[(s, p)] for p in range(first, first + n)) / n for i, s, first, n, _ in rows}
    assert want["a"] == 0.75 and got == pytest.approx(want)
    with pytest.raises(guards.IntegrityError):
        labels.with_uniqueness(spark.createDataFrame([rows[0], rows[0]], schema))


ORIGIN = datetime(2026, 1, 1, tzinfo=timezone.utc)
DAYS = lambda n: timedelta(days=n)
SPLIT = folds.SplitConfig(DAYS(5), DAYS(5), DAYS(100), DAYS(20), DAYS(20), 3)


def test_fold_windows(spark):
    plan = folds.FoldPlan(ORIGIN, SPLIT, ORIGIN + DAYS(400))
    day = lambda t: (t.replace(tzinfo=timezone.utc) - ORIGIN).days
    held = plan.table(spark).orderBy("fold").collect()
    assert [day(t) for t in held[0][1:]] == [0, 100, 105, 125, 130, 150]
    assert [day(w.train_end) for w in held] == [100, 120, 140] and plan.shortfall(spark).count() == 0
    plan = folds.FoldPlan(ORIGIN, SPLIT, ORIGIN + DAYS(171))
    assert plan.count == 2
    [short] = plan.shortfall(spark).collect()
    assert (short.fold, short.code, day(short.ends), day(short.available_until)) == (2, "span_too_short", 190, 171)
    assert folds.FoldPlan(ORIGIN, SPLIT, ORIGIN + DAYS(149)).count == 0


def test_assignment_and_purge(spark):
    held = folds.FoldPlan(ORIGIN, SPLIT, ORIGIN + DAYS(150))
    naive = lambda d: (ORIGIN + DAYS(d)).replace(tzinfo=None)
    assert folds.assign(spark.createDataFrame([("x", naive(1), naive(0))], "label_id string, prediction_time timestamp, outcome_time timestamp"), held).first().reason == "outcome_before_prediction"
    rows = [(f"l{d}", naive(d), naive(d + 5)) for d in (0, 94, 95, 96, 100, 102, 105, 130, 145, 146, 150)]
    df = spark.createDataFrame(rows, "label_id string, prediction_time timestamp, outcome_time timestamp")
    got = {r.label_id: (r.window, r.reason) for r in folds.assign(df, held).collect()}
    assert got["l95"] == ("train", None) and got["l96"] == (None, "outcome_crosses_boundary")
    assert got["l100"] == (None, "in_purge_gap") and got["l105"] == ("calibration", None)
    assert got["l145"] == ("test", None) and got["l146"] == (None, "outcome_crosses_boundary")
    assert "l150" not in got


def test_a_hash_moves_with_any_member(spark):
    schema = "fold int, label_id string, window string, reason string"
    base = [(0, f"l{i}", "train", None) for i in range(50)]
    plan = lambda **change: folds.FoldPlan(ORIGIN, replace(SPLIT, folds=1, **change), ORIGIN + DAYS(150))
    address = lambda rows, **change: folds.fold_hash(spark.createDataFrame(rows, schema), plan(**change)).first().digest
    assert address(base) == address(list(reversed(base)))
    assert address(base) != address(base[:-1])
    assert address(base) != address([*base[:-1], (0, "l49", None, "in_purge_gap")])
    assert address(base) != address(base, horizon=DAYS(4))
    assert address([]) != address([], horizon=DAYS(4))


@pytest.mark.parametrize("change", [{"purge": DAYS(4)}, {"test": DAYS(5)}, {"folds": 0}, {"train": DAYS(0)}])
def test_split_configuration(change):
    good = dict(horizon=DAYS(5), purge=DAYS(5), train=DAYS(100), calibration=DAYS(20), test=DAYS(20), folds=3)
    with pytest.raises(ValueError):
        folds.SplitConfig(**{**good, **change})
