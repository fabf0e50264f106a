import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import guards
from tidemark.operators import analogs, gates, metrics, model

NAMES = ["x1", "x2", "x3", "x4"]
CONFIG = model.ModelConfig(families={"price": NAMES[:2], "news": NAMES[2:]})


def data(n=90):
    i = np.arange(n)
    x = np.stack([(i % 7) / 7 - 0.5, (i % 5) / 5 - 0.5, (i % 3) / 3 - 0.5, (i % 11) / 11 - 0.5], axis=1)
    return x, 0.20 * x[:, 0] - 0.10 * x[:, 2], 1.0 / (1 + i % 4)


@pytest.fixture(scope="module")
def rows(spark):
    x, y, w = data()
    out = []
    for i in range(85):
        out.append((0, "train" if i < 60 else "calibration", f"l{i}", *map(float, x[i]), float(y[i]), float(w[i])))
    return spark.createDataFrame(out, "fold int, window string, label_id string, x1 double, x2 double, x3 double, x4 double, y double, w double").cache()


def test_ridge_is_the_closed_form(spark, rows):
    x, y, w = (a[:60] for a in data())
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc = x - mx
    want = np.linalg.solve(xc.T @ (xc * w[:, None]) + np.eye(4), xc.T @ (w * (y - my)))
    got = model.ridge(rows, NAMES, 1.0).first()
    assert got.coef == pytest.approx(want.tolist(), rel=1e-9)
    assert got.intercept == pytest.approx(my - mx @ want)
    assert got.effective_sample_size == pytest.approx(w.sum() ** 2 / (w**2).sum())


def test_logistic_is_the_weighted_optimum(spark, rows):
    x, y, w = (a[:60] for a in data())
    up, full, beta = (y > 0).astype(float), np.c_[np.ones(60), x], np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ beta))
        penalty = np.diag([0.0, 1, 1, 1, 1])
        beta -= np.linalg.solve(full.T @ (full * (w * p * (1 - p))[:, None]) + penalty, full.T @ (w * (p - up)) + penalty @ beta)
    got = model.logistic(rows, NAMES, 1.0).first()
    assert [got.direction_intercept, *got.direction_coef] == pytest.approx(beta.tolist(), abs=1e-6)


def test_single_class_is_refused(spark, rows):
    with pytest.raises(model.Uncalibrated):
        model.logistic(rows.withColumn("y", F.abs("y") + 1), NAMES, 1.0)


def test_predict_splits_into_families_and_refuses_the_past(spark, rows):
    from datetime import datetime

    stamp = datetime(2026, 1, 1)
    table = spark.createDataFrame([(0, stamp)], "fold int, calibration_end timestamp")
    trials = spark.createDataFrame([("t1", {"model": CONFIG.version}), ("t2", {"model": "cfg-other"})],
                                   "trial_id string, configuration map<string,string>")
    fitted = model.fit(rows, table, CONFIG, trials, "t1")
    assert [r.trial_id for r in fitted.select("trial_id").collect()] == ["t1"]
    for unknown in ("t0", "t2"):
        with pytest.raises(guards.IntegrityError):
            model.fit(rows, table, CONFIG, trials, unknown)
    # Nothing of the rows is read before the registry has answered.
    with pytest.raises(guards.IntegrityError):
        model.fit(None, None, CONFIG, trials, "t0")
    asked = rows.limit(3).select("fold", F.col("label_id").alias("candidate_id"), F.lit(stamp).alias("as_of"), *NAMES)
    for r in model.predict(fitted, asked, CONFIG).join(fitted.select("fold", "intercept"), "fold").collect():
        assert r.family_price + r.family_news + r.intercept == pytest.approx(r.expected_residual_return)
        assert r.q10 <= r.q50 <= r.q90 and not r.eligible
    early = asked.withColumn("as_of", F.lit(datetime(2025, 12, 31)))
    with pytest.raises(guards.LeakError):
        model.predict(fitted, early, CONFIG)


def test_leaks_into_a_fit_are_refused(spark):
    assigned = spark.createDataFrame(
        [(0, "a", "train"), (0, "b", "calibration"), (0, "c", "test")], "fold int, label_id string, window string"
    )
    ok = spark.createDataFrame([(0, "a"), (0, "b")], "fold int, label_id string")
    model.refuse_leaked_features(assigned, ok)
    for bad in ("c", "unknown"):
        with pytest.raises(guards.LeakError):
            model.refuse_leaked_features(assigned, ok.union(spark.createDataFrame([(0, bad)], ok.schema)))
    twice = assigned.union(spark.createDataFrame([(0, "a", "calibration")], assigned.schema))
    with pytest.raises(guards.LeakError):
        model.refuse_leaked_features(twice, ok)


def test_a_missing_outcome_or_weight_is_refused(spark):
    assigned = spark.createDataFrame([(0, "a", "train")], "fold int, label_id string, window string")
    features = spark.createDataFrame([(0, "a", 1.0, 1.0, 1.0, 1.0)], "fold int, label_id string, x1 double, x2 double, x3 double, x4 double")
    schema = "label_id string, forward_residual_return double, uniqueness double"
    for row in (("b", 0.1, 1.0), ("a", 0.1, 0.0), ("a", None, 1.0)):
        with pytest.raises(guards.IntegrityError):
            model.training_rows(assigned, features, spark.createDataFrame([row], schema), CONFIG)


def test_bins_follow_the_edges_as_doubles(spark):
    rows = [(0, p, y) for p, y in ((0.3, 1.0), (0.29, -1.0), (0.5, 1.0), (0.49, -1.0), (1.0, 1.0), (0.0, -1.0))]
    df = spark.createDataFrame(rows, "fold int, p_up double, y double")
    p, hit = np.array([r[1] for r in rows]), np.array([r[2] > 0 for r in rows])
    at = np.digitize(p, np.linspace(0, 1, 11)[1:-1])
    want = sum(abs(p[at == b].mean() - hit[at == b].mean()) * (at == b).sum() for b in set(at)) / len(p)
    assert model.calibration_error(df, 10).first().calibration_error == pytest.approx(want)


FORECAST = dict(p_up=0.61, expected_residual_return=0.03, q10=-0.05, q90=0.11, calibration_error=0.02, effective_sample_size=250.0, pv=0.6, news=0.4)


@pytest.mark.parametrize("change, want", [
    ({}, []), ({"news": 0.0}, ["gate_1_single_family_shadow_book"]),
    ({"news": -0.1}, ["gate_1_families_disagree_on_direction"]), ({"p_up": 0.54}, ["gate_2_below_non_negotiable_floor"]),
    ({"p_up": 0.57}, ["gate_2_below_calibrated_threshold"]),
    ({"expected_residual_return": -0.03, "p_up": 0.4, "pv": -0.6, "news": -0.4}, []),
    ({"expected_residual_return": 0.009}, ["gate_3_expected_move_below_cost_hurdle"]),
    ({"calibration_error": 0.06, "effective_sample_size": 99.0}, ["gate_4_calibration_error_above_limit", "gate_4_effective_sample_size_below_floor"]),
    ({"q90": None}, ["gate_4_quantile_spread_above_limit"]),
])
def test_gates(spark, change, want):
    row = {**FORECAST, **change}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    got = gates.decide(df, ["pv", "news"]).first()
    assert got.rejection_reasons == want and got.eligible == (not want)


def test_shuffle_stays_within_its_date_and_depends_on_the_seed(spark):
    rows = spark.createDataFrame([(f"l{i}", i % 4, float(i)) for i in range(80)], "label_id string, date int, y double")
    one = metrics.shuffled_within_date(rows, "date", "y", "s1").collect()
    assert {(r.date, r.shuffled_y) for r in one} == {(i % 4, float(i)) for i in range(80)}
    again = metrics.shuffled_within_date(rows.repartition(9), "date", "y", "s1").collect()
    other = metrics.shuffled_within_date(rows, "date", "y", "s2").collect()
    assert sorted(one) == sorted(again) and sorted(one) != sorted(other)


def test_ic_excludes_what_it_cannot_rank(spark):
    rows = [("a", 1, 1.0, 1.0, 1.0), ("b", 1, 2.0, 2.0, 1.0), ("c", 1, 3.0, 3.0, 0.5), ("d", 2, 1.0, 1.0, 1.0), ("e", 3, 1.0, 1.0, 1.0), ("f", 3, 1.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "label_id string, date int, prediction double, outcome double, uniqueness double")
    got = {r.date: (r.ic, r.excluded) for r in metrics.daily_ic(df).collect()}
    assert got[1] == (pytest.approx(1.0), None) and got[2] == (None, "too_few_scored") and got[3] == (None, "constant_prediction")


def test_arms_must_see_the_same_labels(spark):
    schema = "fold int, label_id string, arm string"
    metrics.refuse_different_arms(spark.createDataFrame([(0, "a", "x"), (0, "a", "y")], schema))
    with pytest.raises(metrics.ArmMismatch):
        metrics.refuse_different_arms(spark.createDataFrame([(0, "a", "x"), (0, "b", "y"), (0, "a", "y")], schema))


def test_analogs_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, i, [float(v) for v in vectors[i]]) for i in range(60)], "event_id long, at long, vector array<double>").repartition(5)
    got = analogs.closest_analogs(rows.where("event_id in (10, 40, 59)"), rows, 3, size=2).collect()
    for q in (10, 40, 59):
        d = np.sqrt(((vectors[:q] - vectors[q]) ** 2).sum(axis=1))
        assert [r.event_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(d)[:3].tolist()


def test_analogs_search_few_blocks_and_lose_nothing(spark):
    """Clusters that come one after another, ties, broken vectors; equal to brute force."""
    import numpy as np

    draw = np.random.default_rng(5)
    rows = []
    for i in range(1200):
        place = 100.0 * (i // 40 % 6)
        vector = (place + np.round(draw.normal(size=4), 1)).tolist()
        rows.append((i, i // 3, vector))
    broken = [(5000, 50, None), (5001, None, [0.0] * 4), (5002, 60, [float("nan")] * 4), (5003, 70, [None, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows + broken, "event_id long, at long, vector array<double>").repartition(5)
    asked = table.where("event_id % 7 = 0")
    got = {}
    for r in analogs.closest_analogs(asked, table, 3, size=16).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.event_id
    have = np.array([v for _, _, v in rows])
    for i, at, vector in rows[::7]:
        far = np.sqrt(((have - np.array(vector)) ** 2).sum(axis=1))
        best = sorted((far[j], j) for j, then, _ in rows if then < at)[:3]
        assert got.get(i, {}) == {n + 1: j for n, (_, j) in enumerate(best)}
    known = analogs.blocks(table, 16)
    searched, every = analogs.needed_pairs(known, known, 3).count(), known.count() ** 2
    assert searched < every / 4, (searched, every)
    assert analogs.closest_analogs(asked.limit(0), table, 3).isEmpty()
    assert analogs.closest_analogs(asked, table.limit(0), 3).isEmpty()


def test_exposure_by_hand(spark):
    from datetime import date

    day = lambda n: date(2024, 1, n)
    rows = [
        ("a", "S1", "up", day(1), day(3), 100), ("a", "S1", "up", day(2), day(3), -200), ("a", "S2", "down", day(5), day(11), 100),
        ("a", "S1", "up", day(9), day(8), 100), ("a", "S1", "up", None, day(8), 100), ("b", "S1", "up", day(4), day(4), 100),
        (None, "S1", "up", day(1), day(2), 10), ("c", "S1", "up", day(1), day(2), None),
    ]
    schema = "account string, sector string, direction string, opened date, closed date, notional_cents long"
    table = spark.createDataFrame(rows, schema)
    got = {(r.account, r.sector): tuple(r)[3:] for r in metrics.exposure(table).collect()}
    assert got[("a", "S1")] == (2, 2, 0.4, 40.0)
    assert got[("a", "S2")] == (1, 0, 0.6, 60.0)
    assert got[("b", "S1")] == (1, 0, None, None)
    assert got[(None, "S1")] == (1, 0, 1.0, 10.0)
    assert got[("c", "S1")] == (0, 1, None, None)
    assert metrics.exposure(table.limit(0)).isEmpty()


def test_analog_blocks_move_once_per_tile(spark, monkeypatch):
    """A search lays as many rows as blocks times shares, not one per pair of blocks; ties and huge numbers included."""
    draw = np.random.default_rng(9)
    rows = [(i, i // 2, np.round(draw.normal(size=4), 1).tolist()) for i in range(900)]
    rows += [(900 + i, 450 + i, [1e200 * (-1) ** i, 1e200, 0.0, float(i)]) for i in range(6)]
    table = spark.createDataFrame(rows, "event_id long, at long, vector array<double>").repartition(3)
    monkeypatch.setattr(analogs, "SHARES", 3)
    known = analogs.blocks(table, 8)
    pairs = analogs.settle(analogs.needed_pairs(known, known, 4), "test-pairs")
    found = analogs._searched(pairs, known, known, 4)
    assert len({(r.query_id, r.event_id) for r in found.collect()}) == found.count() <= 906 * 3 * 4
    assert pairs.count() > 10 * 2 * 3 * known.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "q_flat" not in plan and "wanted" in plan
    got = {}
    for r in analogs.closest_analogs(table, table, 4, size=8).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.event_id
    have, ats = np.array([v for _, _, v in rows]), np.array([at for _, at, _ in rows])
    with np.errstate(over="ignore"):
        for i, at, vector in rows:
            far = np.sqrt(((have - np.array(vector)) ** 2).sum(axis=1))
            best = sorted((far[j], j) for j in np.flatnonzero(ats < at))[:4]
            assert got.get(i, {}) == {n + 1: j for n, (_, j) in enumerate(best)}, i
