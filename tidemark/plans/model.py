"""Queries on forecasts: design rows, fits, calibration, gates, trials and metrics."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import spread
from tidemark.functions.exprs import r6, utc_day, utc_floor
from tidemark.operators import analogs, folds, gates, ledger, metrics, model, panel, price_features
from tidemark.plans.price import (
    FOLDS, LABELS, PLAN, _IN_ORDER, _digest_sql, all_labels, stored_bars, weighted_labels,
)
from tidemark.plans.registry import at, joined, r6_sql, registered, stamp
from tidemark.settings import counted, settle, settle_counted
from tidemark.sources import tables

CONFIG = model.ModelConfig(
    families={"return": ["residual_return_1s"], "range": ["proximity_to_extreme"]}
)
_RAW_FEATURES = re.sub(r"round\((.*?), 6\) \+ 0\.0 AS (\w+)", r"(\1) AS \2", _IN_ORDER)

DESIGN = f"""{LABELS}, {FOLDS},
feat AS (SELECT symbol, as_of, residual_return_1s AS x1, proximity_to_extreme AS x2 FROM ({_RAW_FEATURES})),
rows_all AS (
  SELECT a.fold, a.win, a.label_id, l.symbol, l.session, value AS y, uniqueness AS w, x1, x2
  FROM assigned a JOIN labels_done l USING (label_id) JOIN weights USING (label_id)
  JOIN feat f ON f.symbol = l.symbol AND f.as_of = strftime(l.session + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S')
  WHERE x1 IS NOT NULL AND x2 IS NOT NULL),
moments AS (
  SELECT fold, count(*) AS n, sum(w) AS sw, sum(w * w) AS sww, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2,
    sum(w * y) / sum(w) AS my FROM rows_all WHERE win = 'train' GROUP BY fold),
centred AS (
  SELECT r.fold, any_value(n) AS n, any_value(sw) AS sw, any_value(sww) AS sww, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my,
    sum(w * (x1 - m1) * (x1 - m1)) + 1.0 AS a, sum(w * (x1 - m1) * (x2 - m2)) AS b, sum(w * (x2 - m2) * (x2 - m2)) + 1.0 AS c,
    sum(w * (x1 - m1) * (y - my)) AS p, sum(w * (x2 - m2) * (y - my)) AS q
  FROM rows_all r JOIN moments m USING (fold) WHERE win = 'train' GROUP BY r.fold),
ridge AS (
  SELECT *, (p * c - q * b) / (a * c - b * b) AS b1, (q * a - p * b) / (a * c - b * b) AS b2 FROM centred),
fitted AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM ridge)"""


REGISTERED = datetime(2020, 1, 1, tzinfo=timezone.utc)


def registry_of(spark: SparkSession, configurations: Iterable[dict[str, str]], purpose: str) -> DataFrame:
    """A registry that holds one trial per configuration."""
    raw = spark.createDataFrame(
        [(c, purpose, REGISTERED) for c in configurations], "configuration map<string,string>, purpose string, registered_at timestamp"
    )
    return ledger.new_trials(spark.createDataFrame([], "trial_id string"), raw)


def fitted_under_trial(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The model's trial is registered, then it is fitted."""
    trials = registry_of(spark, [{"model": CONFIG.version, "folds": repr(PLAN)}], "price forecast")
    return model.fit(rows, PLAN.table(spark), CONFIG, trials, trials.first().trial_id)


def design(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored design rows of the training and calibration windows, and of the test window."""
    bars = stored_bars(spark, sf_dir)
    told, found = settle_counted(weighted_labels(spark, sf_dir, bars), "weighted")
    asked = told.select(
        "symbol", (F.col("prediction_time") + F.expr("interval 15 minutes")).alias("as_of"), "label_id"
    )
    counted(asked, found["rows"])
    block = price_features.feature_block(asked, bars, tables.sectors(spark, sf_dir))
    names = CONFIG.feature_names
    have = F.lit(True)
    for name in names:
        have = have & F.col(name).isNotNull()
    features = settle(asked.join(block.where(have), ["symbol", "as_of"]).select("label_id", *names), "features")
    assigned = settle(folds.assign(told, PLAN), "assigned")
    rows = model.training_rows(assigned, model.fold_features(assigned, features), told, CONFIG)
    when = told.select("label_id", "symbol", F.col("prediction_time").alias("date"))
    test = (
        assigned.where("window = 'test'").select("fold", "window", "label_id")
        .join(features, "label_id")
        .join(told.select("label_id", F.col("forward_residual_return").alias("y"), F.col("uniqueness").alias("w")), "label_id")
    )
    keep = ["fold", "window", "label_id", "symbol", "date", "y", "w", *names]
    return (
        settle_counted(rows.join(when, "label_id").select(*keep), "design")[0],
        settle_counted(test.join(when, "label_id").select(*keep), "design")[0],
    )


@registered(
    "design_rows",
    f"""WITH {DESIGN} SELECT fold, win AS "window", label_id, {r6_sql('x1')} AS residual_return_1s,
      {r6_sql('x2')} AS proximity_to_extreme, {r6_sql('y')} AS y, {r6_sql('w')} AS w FROM rows_all WHERE win IS NOT NULL""",
)
def design_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit, test = design(spark, sf_dir)
    names = [*CONFIG.feature_names, "y", "w"]
    return fit.unionByName(test).select("fold", "window", "label_id", *[r6(F.col(n)).alias(n) for n in names])


@registered(
    "ridge_coefficients",
    f"""WITH {DESIGN} SELECT fold, {r6_sql('b0')} AS intercept, {r6_sql('b1')} AS coef_1, {r6_sql('b2')} AS coef_2,
      {r6_sql('sw * sw / sww')} AS kish_size, {r6_sql('sw')} AS weight_sum, n FROM fitted""",
)
def ridge_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = design(spark, sf_dir)
    fitted = model.ridge(rows, CONFIG.feature_names, CONFIG.ridge_alpha)
    return fitted.join(model.effective_sample_sizes(rows), "fold").select(
        "fold", r6(F.col("intercept")).alias("intercept"), r6(F.col("coef")[0]).alias("coef_1"),
        r6(F.col("coef")[1]).alias("coef_2"), r6(F.col("kish_size")).alias("kish_size"),
        r6(F.col("weight_sum")).alias("weight_sum"), "n",
    )


@registered(
    "calibration_residual_bands",
    f"""WITH {DESIGN}, heldout AS (SELECT fold, y - b0 - b1 * x1 - b2 * x2 AS e FROM rows_all JOIN fitted USING (fold) WHERE win = 'calibration')
    SELECT fold, {r6_sql('quantile_cont(e, 0.1)')} AS low, {r6_sql('quantile_cont(e, 0.5)')} AS middle,
      {r6_sql('quantile_cont(e, 0.9)')} AS high, count(*) AS n FROM heldout GROUP BY fold""",
)
def residual_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = design(spark, sf_dir)
    names = CONFIG.feature_names
    fitted = model.ridge(rows, names, CONFIG.ridge_alpha)
    held = rows.where("window = 'calibration'").join(fitted, "fold")
    held = held.select("fold", (F.col("y") - F.col("intercept") - model.dot("coef", names)).alias("e"))
    [heavy] = spread.is_heavy(rows, ["fold"])
    out = spread.quantiles(held, ["fold"], "e", heavy, {"low": 0.1, "middle": 0.5, "high": 0.9})
    return out.select("fold", *[r6(F.col(n)).alias(n) for n in ("low", "middle", "high")], "n")


def _newton_sql(steps: int) -> str:
    """Newton's method for two features and an intercept, a few sums per fold and step."""
    out = """,
up_rows AS MATERIALIZED (SELECT fold, w, x1, x2, CAST(y > 0 AS DOUBLE) AS up FROM rows_all WHERE win = 'train'),
t0 AS (SELECT DISTINCT fold, 0.0::DOUBLE AS t0, 0.0::DOUBLE AS t1, 0.0::DOUBLE AS t2 FROM up_rows)"""
    for k in range(steps):
        out += f""",
s{k} AS (
  SELECT fold, t0, t1, t2, sum(w * (p - up)) AS g0, sum(w * (p - up) * x1) + t1 AS g1, sum(w * (p - up) * x2) + t2 AS g2,
    sum(v) AS a, sum(v * x1) AS b, sum(v * x2) AS c, sum(v * x1 * x1) + 1 AS d, sum(v * x1 * x2) AS e, sum(v * x2 * x2) + 1 AS f
  FROM (SELECT *, w * p * (1 - p) AS v FROM (SELECT r.*, t0, t1, t2, 1 / (1 + exp(-(t0 + t1 * x1 + t2 * x2))) AS p
        FROM up_rows r JOIN t{k} USING (fold))) GROUP BY fold, t0, t1, t2),
t{k + 1} AS MATERIALIZED (
  SELECT fold, t0 - (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / q AS t0,
    t1 - (a * (g1 * f - e * g2) - g0 * (b * f - e * c) + c * (b * g2 - g1 * c)) / q AS t1,
    t2 - (a * (d * g2 - g1 * e) - b * (b * g2 - g1 * c) + g0 * (b * e - d * c)) / q AS t2
  FROM (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS q FROM s{k}))"""
    return out + f", direction AS (SELECT * FROM t{steps})"


_SCORE_BINS = " + ".join(
    f"CAST(p >= '{e}'::DOUBLE AS INT)" for e in "0.1 0.2 0.30000000000000004 0.4 0.5 0.6000000000000001 0.7000000000000001 0.8 0.9".split()
)
FITTED = f"""{DESIGN}{_newton_sql(14)},
calibrated AS (
  SELECT fold, sum(n * abs(mp - my)) / sum(n) AS ece FROM (
    SELECT fold, {_SCORE_BINS} AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(y > 0 AS INT)) AS my
    FROM (SELECT fold, y, 1 / (1 + exp(-(t0 + t1 * x1 + t2 * x2))) AS p FROM rows_all JOIN direction USING (fold) WHERE win = 'calibration')
    GROUP BY fold, bin) GROUP BY fold),
members AS ({_digest_sql("(SELECT * FROM rows_all WHERE win IN ('train', 'calibration'))", 'fold', "win || '|' || label_id")})"""


@registered(
    "fitted_models",
    f"""WITH {FITTED} SELECT fold, 'mdl-' || substr(sha256('{CONFIG.version}|' || fold || '|' || digest || '|'
        || {" || '|' || ".join(f"epoch_us({e})" for e in folds.EDGES)}), 1, 16) AS model_version,
      {r6_sql('b0')} AS intercept, {r6_sql('t0')} AS direction_intercept, {r6_sql('t1')} AS direction_1, {r6_sql('t2')} AS direction_2,
      {r6_sql('ece')} AS calibration_error, {r6_sql('sw * sw / sww')} AS effective_sample_size, {at('calibration_end')} AS fitted_through
    FROM fitted JOIN direction USING (fold) JOIN calibrated USING (fold) JOIN members USING (fold) JOIN folds USING (fold)""",
)
def fitted_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models with calibration and address, one row per fold."""
    rows, _ = design(spark, sf_dir)
    made = fitted_under_trial(spark, rows)
    return made.select(
        "fold", "model_version", r6(F.col("intercept")).alias("intercept"),
        r6(F.col("direction_intercept")).alias("direction_intercept"),
        *[r6(F.col("direction_coef")[i]).alias(f"direction_{i + 1}") for i in (0, 1)],
        r6(F.col("calibration_error")).alias("calibration_error"),
        r6(F.col("effective_sample_size")).alias("effective_sample_size"),
        stamp("fitted_through").alias("fitted_through"),
    )


@registered(
    "forecast_magnitudes",
    f"""WITH {FITTED}, heldout AS (
      SELECT fold, quantile_cont(y - b0 - b1 * x1 - b2 * x2, 0.5) AS md, quantile_cont(y - b0 - b1 * x1 - b2 * x2, 0.1) AS lo, quantile_cont(y - b0 - b1 * x1 - b2 * x2, 0.9) AS hi
      FROM rows_all JOIN fitted USING (fold) WHERE win = 'calibration' GROUP BY fold)
    SELECT fold, label_id AS candidate_id, {r6_sql('b0 + b1 * x1 + b2 * x2')} AS expected_residual_return,
      {r6_sql('1 / (1 + exp(-(t0 + t1 * x1 + t2 * x2)))')} AS p_up, {r6_sql('b0 + b1 * x1 + b2 * x2 + md')} AS q50,
      {r6_sql('b0 + b1 * x1 + b2 * x2 + lo')} AS q10, {r6_sql('b0 + b1 * x1 + b2 * x2 + hi')} AS q90,
      {r6_sql('b1 * x1')} AS family_return, {r6_sql('b2 * x2')} AS family_range
    FROM rows_all JOIN fitted USING (fold) JOIN heldout USING (fold) JOIN direction USING (fold) WHERE win = 'test'""",
)
def forecast_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of every test label: direction, magnitude, band and family shares."""
    rows, test = design(spark, sf_dir)
    made = settle(fitted_under_trial(spark, rows), "models")
    asked = test.withColumnsRenamed({"label_id": "candidate_id", "date": "as_of"})
    out = model.predict(made, asked, CONFIG)
    shown = ("p_up", "expected_residual_return", "q10", "q50", "q90", "family_return", "family_range")
    return out.select("fold", "candidate_id", *[r6(F.col(n)).alias(n) for n in shown])


@registered("model_arm_comparison")
def arm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-family, combined and shuffled arms on the same folds, measured alike."""
    rows, test = design(spark, sf_dir)
    both = CONFIG.feature_names
    arms = {"shuffled": both, "return_only": both[:1], "range_only": both[1:], "combined": both}
    trials = registry_of(spark, [{"model": CONFIG.version, "arm": arm} for arm in arms], "baseline arms")
    tries = ledger.trial_count(trials)
    scored = settle(model.arm_predictions(rows, test, arms, CONFIG.ridge_alpha, CONFIG.version), "arms")
    metrics.refuse_different_arms(scored)
    keyed = scored.withColumn("_d", F.concat_ws("|", "arm", F.col("fold").cast("string"), F.col("date").cast("string")))
    daily = metrics.daily_ic(keyed, "_d").withColumn("arm", F.split("_d", "[|]")[0])
    told = metrics.ic_summary(daily, ["arm"]).withColumn(
        "deflated_t", metrics.deflated_t(F.col("ic_t_statistic"), tries)
    )
    return told.join(metrics.hit_rate_after_cost(scored, 0.01, ["arm"]), "arm").select(
        "arm", "dates", *[r6(F.col(n)).alias(n) for n in (
            "mean_ic", "ic_t_statistic", "deflated_t", "effective_sample_size", "hit_rate_after_cost")],
        joined("quality_flags").alias("quality_flags"),
    )


# Forecast judgements with known probabilities: every event as one scored candidate.
_JUDGED = """
judged AS (
  SELECT CAST(user_id % 5 AS INT) AS fold, ((event_id * 37) % 1000) / 1000.0::DOUBLE AS p,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0 ELSE -1.0 END AS y FROM events)"""


def judged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("int").alias("fold"),
        ((F.col("event_id") * 37) % 1000 / 1000.0).alias("p_up"),
        F.when(F.col("event_type").isin("purchase", "signup"), 1.0).otherwise(-1.0).alias("y"),
    )


_EDGES = "0.1 0.2 0.30000000000000004 0.4 0.5 0.6000000000000001 0.7000000000000001 0.8 0.9".split()
_BIN = "CAST(" + " + ".join(f"CAST(p >= '{e}'::DOUBLE AS INT)" for e in _EDGES) + " AS INT)"


@registered(
    "expected_calibration_error",
    f"""WITH {_JUDGED}, b AS (SELECT fold, {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(y > 0 AS INT)) AS my FROM judged GROUP BY ALL)
    SELECT fold, {r6_sql('sum(n * abs(mp - my)) / sum(n)')} AS calibration_error FROM b GROUP BY fold""",
)
def expected_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = model.calibration_error(judged_events(spark, sf_dir), 10)
    return out.select("fold", r6(F.col("calibration_error")).alias("calibration_error"))


@registered(
    "calibration_curve",
    f"""WITH {_JUDGED} SELECT fold, {_BIN} AS bin, {r6_sql('avg(p)')} AS mean_probability,
      {r6_sql('avg(CAST(y > 0 AS INT))')} AS observed_frequency, count(*) AS n FROM judged GROUP BY ALL""",
)
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.calibration_curve(judged_events(spark, sf_dir))
    return out.select("fold", "bin", r6(F.col("mean_probability")).alias("mean_probability"),
                      r6(F.col("observed_frequency")).alias("observed_frequency"), "n")


@registered(
    "forecast_quality",
    f"""WITH {_JUDGED} SELECT fold, {r6_sql('avg(pow(p - CAST(y > 0 AS INT), 2))')} AS brier_score,
      {r6_sql('count(*) FILTER (y > 0 AND p >= 0.5) / count(*) FILTER (p >= 0.5)')} AS up_precision,
      {r6_sql('count(*) FILTER (y > 0 AND p >= 0.5) / count(*) FILTER (y > 0)')} AS up_recall, count(*) AS n
    FROM judged GROUP BY fold""",
)
def forecast_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.forecast_quality(judged_events(spark, sf_dir))
    return out.select("fold", *[r6(F.col(n)).alias(n) for n in ("brier_score", "up_precision", "up_recall")], "n")


_FORECASTS = """
forecasts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.5 + l_discount AS p_up, l_tax - 0.04 AS m,
    l_tax - 0.04 - l_quantity / 100 AS q10,
    CASE WHEN l_returnflag <> 'R' THEN l_tax - 0.04 + l_quantity / 100 END AS q90,
    l_discount / 1.5 AS ece, l_quantity * 5 AS ess, l_tax - 0.03 AS v1, l_discount - 0.05 AS v2 FROM lineitem)"""


@registered(
    "eligibility_gates",
    f"""WITH {_FORECASTS}, gapped AS (SELECT * REPLACE (
        CASE WHEN l_orderkey % 59 = 6 THEN 'nan'::DOUBLE WHEN l_orderkey % 53 <> 5 THEN p_up END AS p_up,
        CASE WHEN l_orderkey % 61 <> 7 THEN ece END AS ece, CASE WHEN l_orderkey % 67 <> 8 THEN ess END AS ess) FROM forecasts),
    judged AS (SELECT *, CASE WHEN m >= 0 THEN p_up ELSE 1.0 - p_up END AS conf FROM gapped),
    told AS (SELECT array_to_string(list_sort(list_filter([
        CASE WHEN p_up IS NULL OR isnan(p_up) THEN 'missing_p_up' END, CASE WHEN ece IS NULL THEN 'missing_calibration_error' END,
        CASE WHEN ess IS NULL THEN 'missing_effective_sample_size' END,
        CASE WHEN sign(v1) = 0 OR sign(v2) = 0 THEN 'gate_1_single_family_shadow_book'
             WHEN sign(v1) <> sign(v2) THEN 'gate_1_families_disagree_on_direction' END,
        CASE WHEN conf < 0.55 THEN 'gate_2_below_non_negotiable_floor' WHEN conf < 0.58 THEN 'gate_2_below_calibrated_threshold' END,
        CASE WHEN abs(m) < 0.01 THEN 'gate_3_expected_move_below_cost_hurdle' END,
        CASE WHEN ece > 0.05 THEN 'gate_4_calibration_error_above_limit' END,
        CASE WHEN ess < 100 THEN 'gate_4_effective_sample_size_below_floor' END,
        CASE WHEN q90 IS NULL OR q90 - q10 > 0.4 THEN 'gate_4_quantile_spread_above_limit' END], lambda x: x IS NOT NULL)), ',') AS reasons
      FROM judged)
    SELECT reasons, CAST(reasons = '' AS INT) AS eligible, count(*) AS n FROM told GROUP BY ALL""",
)
def eligibility_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a forecast, some with a missing or NaN input, counted by its full set of reasons."""
    c = F.col
    key = c("l_orderkey")
    m = c("l_tax") - 0.04
    forecasts = tables.table(spark, sf_dir, "lineitem").select(
        F.when(key % 59 == 6, float("nan")).when(key % 53 != 5, c("l_discount") + 0.5).alias("p_up"), m.alias("expected_residual_return"),
        (m - c("l_quantity") / 100).alias("q10"),
        F.when(c("l_returnflag") != "R", m + c("l_quantity") / 100).alias("q90"),
        F.when(key % 61 != 7, c("l_discount") / 1.5).alias("calibration_error"),
        F.when(key % 67 != 8, c("l_quantity") * 5).alias("effective_sample_size"),
        (c("l_tax") - 0.03).alias("view_tax"), (c("l_discount") - 0.05).alias("view_discount"),
    )
    out = gates.decide(forecasts, ["view_tax", "view_discount"])
    return out.groupBy(
        joined("rejection_reasons").alias("reasons"), c("eligible").cast("int").alias("eligible")
    ).agg(F.count("*").alias("n"))


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as registered trials: feed and user as configuration, the hour as instant."""
    return tables.table(spark, sf_dir, "events").select(
        F.create_map(F.lit("feed"), F.col("event_type"), F.lit("arm"), (F.col("user_id") % 10).cast("string")).alias(
            "configuration"
        ),
        F.lit("baseline arms").alias("purpose"), utc_floor(F.col("ts"), "hour").alias("registered_at"),
    )


_TRIALS = """
trials AS (
  SELECT DISTINCT sha256('{"configuration_hash":"' || sha256('{"arm":"' || (user_id % 10) || '","feed":"' || event_type || '"}')
    || '","purpose":"baseline arms","registered_at":"' || strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00"}') AS trial_id,
    date_trunc('hour', ts) AS registered_at, event_type FROM events)"""


@registered("trial_registry", f"WITH {_TRIALS} SELECT trial_id, {at('registered_at')} AS registered_at FROM trials")
def trial_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _trials(spark, sf_dir)
    none = spark.createDataFrame([], "trial_id string")
    return ledger.new_trials(none, raw).select("trial_id", stamp("registered_at").alias("registered_at"))


@registered(
    "trial_history",
    f"""WITH {_TRIALS} SELECT event_type AS feed, count(*) AS trials, count(*) FILTER (event_type <> 'error') AS with_result
    FROM trials GROUP BY event_type""",
)
def trial_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trials but those of one feed have a result; the count still sees every trial."""
    held = settle(
        ledger.new_trials(spark.createDataFrame([], "trial_id string"), _trials(spark, sf_dir)), "trials"
    )
    done = held.where(F.col("configuration")["feed"] != "error").select("trial_id", F.lit("ok").alias("result"))
    none = spark.createDataFrame([], "trial_id string, result string")
    told = ledger.trial_history(held, ledger.new_results(held, none, done))
    return told.groupBy(F.col("configuration")["feed"].alias("feed")).agg(
        F.count("*").alias("trials"), F.count("result").alias("with_result")
    )


# Labels scored by the raw return of their decision session.
SCORED = LABELS + """,
scored AS (
  SELECT l.label_id, l.symbol, l.session AS date, m.ret AS prediction, l.value AS outcome, uniqueness,
    m.sector, CASE WHEN abs(m.ret) > 1 THEN 'wild' ELSE 'calm' END AS regime
  FROM labels_done l JOIN weights USING (label_id) JOIN moves m ON m.symbol = l.symbol AND m.session = l.session
  WHERE m.ret IS NOT NULL)"""


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stored_bars(spark, sf_dir)
    told = weighted_labels(spark, sf_dir, bars)
    moved = panel.moves(bars, panel.Layout.measure(bars)).where("ret is not null")
    rows = told.withColumnRenamed("prediction_time", "session").join(
        moved.select("symbol", "session", F.col("ret").alias("prediction")), ["symbol", "session"]
    )
    rows = rows.join(tables.sectors(spark, sf_dir), "symbol", "left").select(
        "label_id", "symbol", F.col("session").alias("date"), "prediction",
        F.col("forward_residual_return").alias("outcome"), "uniqueness", "sector",
        F.when(F.abs("prediction") > 1, "wild").otherwise("calm").alias("regime"),
    )
    return settle(rows, "scored")


DAILY = SCORED + """,
ranked AS (
  SELECT *, rank() OVER (PARTITION BY date ORDER BY prediction) + (count(*) OVER (PARTITION BY date, prediction) - 1) / 2.0 AS rp,
    rank() OVER (PARTITION BY date ORDER BY outcome) + (count(*) OVER (PARTITION BY date, outcome) - 1) / 2.0 AS ro FROM scored),
daily AS (
  SELECT date, count(*) AS n, sum(uniqueness) AS eff, CASE WHEN count(*) < 2 THEN 'too_few_scored' END AS excluded,
    CASE WHEN count(*) >= 2 THEN corr(rp, ro) END AS ic FROM ranked GROUP BY date)"""


@registered(
    "daily_information_coefficient",
    f"WITH {DAILY} SELECT {at('date')} AS date, n, {r6_sql('eff')} AS effective_size, excluded, {r6_sql('ic')} AS ic FROM daily",
)
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.daily_ic(scored_labels(spark, sf_dir))
    return out.select(stamp("date").alias("date"), "n", r6(F.col("effective_size")).alias("effective_size"),
                      "excluded", r6(F.col("ic")).alias("ic"))


# The standard normal quantile by Newton steps on the series of its distribution, from the left.
_BEST_OF = """
tries AS (SELECT count(*) AS tries FROM trials),
probabilities AS (
  SELECT unnest([1 - 1 / tries, 1 - 1 / (tries * exp(1))]) AS p, unnest([1 - 0.5772156649015329::DOUBLE, 0.5772156649015329::DOUBLE]) AS share
  FROM tries),
newton AS (
  SELECT p, share, 0.5::DOUBLE AS x, 0 AS step FROM probabilities
  UNION ALL
  SELECT p, share, x - (0.5 - p) * sqrt(2 * pi()) * exp(x * x / 2)
      - list_sum(list_transform(range(0, 80), lambda k: exp((2 * k + 1) * ln(x) - lgamma(2 * k + 2) + k * ln(2.0) + lgamma(k + 1)))), step + 1
  FROM newton WHERE step < 60),
expected AS (SELECT sum(share * x) AS best FROM newton WHERE step = 60)"""


@registered(
    "information_coefficient_summary",
    f"""WITH RECURSIVE {DAILY}, {_TRIALS}, {_BEST_OF}, s AS (
      SELECT count(*) FILTER (excluded IS NULL) AS dates, count(*) FILTER (excluded IS NOT NULL) AS gone, avg(ic) AS m,
        stddev_samp(ic) AS sd, sum(eff) FILTER (excluded IS NULL) AS eff, sum(n) FILTER (excluded IS NULL) AS rows_used FROM daily)
    SELECT dates, gone AS excluded_dates, {r6_sql('m')} AS mean_ic, {r6_sql('eff')} AS effective_sample_size,
      {r6_sql('m / sd * sqrt(dates * eff / rows_used)')} AS ic_t_statistic, (SELECT tries FROM tries) AS trials,
      {r6_sql('m / sd * sqrt(dates * eff / rows_used) - (SELECT best FROM expected)')} AS deflated_t FROM s""",
)
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean daily coefficient, deflated by as many tries as the registry holds."""
    out = metrics.ic_summary(metrics.daily_ic(scored_labels(spark, sf_dir)))
    tries = ledger.trial_count(ledger.new_trials(spark.createDataFrame([], "trial_id string"), _trials(spark, sf_dir)))
    t = F.col("ic_t_statistic")
    return out.select(
        "dates", "excluded_dates", r6(F.col("mean_ic")).alias("mean_ic"),
        r6(F.col("effective_sample_size")).alias("effective_sample_size"), r6(t).alias("ic_t_statistic"),
        F.lit(tries).cast("long").alias("trials"), r6(metrics.deflated_t(t, tries)).alias("deflated_t"),
    )


@registered(
    "hit_rate_after_cost",
    f"""WITH {SCORED} SELECT regime, {r6_sql('avg(CAST(sign(prediction) * outcome - 0.01 > 0 AS INT))')} AS hit_rate_after_cost,
      {r6_sql('avg(sign(prediction) * outcome - 0.01)')} AS mean_net, count(*) AS n FROM scored GROUP BY regime""",
)
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.hit_rate_after_cost(scored_labels(spark, sf_dir), 0.01, ["regime"])
    return out.select("regime", r6(F.col("hit_rate_after_cost")).alias("hit_rate_after_cost"),
                      r6(F.col("mean_net")).alias("mean_net"), "n")


_DECILES = SCORED + """,
dec AS (
  SELECT CAST((row_number() OVER (PARTITION BY date ORDER BY prediction, label_id) - 1) * 10 // count(*) OVER (PARTITION BY date) + 1 AS INT) AS decile,
    outcome FROM scored)"""


@registered(
    "decile_means",
    f"WITH {_DECILES} SELECT decile, {r6_sql('avg(outcome)')} AS mean_outcome, count(*) AS n FROM dec GROUP BY decile",
)
def decile_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.decile_means(scored_labels(spark, sf_dir))
    return out.select("decile", r6(F.col("mean_outcome")).alias("mean_outcome"), "n")


@registered(
    "decile_spread",
    f"""WITH {_DECILES} SELECT {r6_sql('avg(outcome) FILTER (decile = 10) - avg(outcome) FILTER (decile = 1) - 0.02')}
      AS decile_spread_after_cost FROM dec""",
)
def decile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.decile_spread(metrics.decile_means(scored_labels(spark, sf_dir)), 0.01)
    return out.select(r6(F.col("decile_spread_after_cost")).alias("decile_spread_after_cost"))


@registered(
    "result_attribution",
    f"""WITH {SCORED}, s AS (SELECT *, sign(prediction) * outcome - 0.01 AS net, coalesce(sector, 'none') AS sec,
        CAST(year(date) % 5 AS VARCHAR) AS fold FROM scored)
    SELECT dimension, member, count(*) AS n, round(sum(net), 4) + 0.0 AS net, {r6_sql('avg(CAST(net > 0 AS INT))')} AS hit_rate
    FROM (SELECT net, unnest(['symbol', 'sector', 'fold', 'regime', 'all']) AS dimension,
                 unnest([symbol, sec, fold, regime, 'all']) AS member FROM s) GROUP BY ALL""",
)
def result_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_labels(spark, sf_dir).withColumn("fold", (F.year(utc_day(F.col("date"))) % 5).cast("int"))
    out = metrics.attribution(rows, 0.01)
    return out.select("dimension", "member", "n", (F.round("net", 4) + 0.0).alias("net"), r6(F.col("hit_rate")).alias("hit_rate"))


_ORDER = lambda salt: f"CAST('0x' || substr(sha256('seed-1|{salt}|' || label_id), 1, 15) AS BIGINT)"


@registered(
    "label_permutation",
    f"""WITH {LABELS}, g AS (SELECT session, value, row_number() OVER (PARTITION BY session ORDER BY {_ORDER('from')}, label_id) AS i FROM labels_done),
    t AS (SELECT session, label_id, row_number() OVER (PARTITION BY session ORDER BY {_ORDER('to')}, label_id) AS i FROM labels_done)
    SELECT label_id, {at('session')} AS date, {r6_sql('value')} AS shuffled FROM t JOIN g USING (session, i)""",
)
def label_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = settle(all_labels(spark, sf_dir, stored_bars(spark, sf_dir)).where("status = 'labelled'"), "labels")
    out = metrics.shuffled_within_date(done, "prediction_time", "forward_residual_return", "seed-1")
    return out.select("label_id", stamp("prediction_time").alias("date"),
                      r6(F.col("shuffled_forward_residual_return")).alias("shuffled"))


@registered(
    "closest_analogs",
    """WITH d AS (
      SELECT t.vec_id AS query_id, e.vec_id AS event_id,
        sqrt(list_sum(list_transform(list_zip(e.embedding, t.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))) AS distance
      FROM embeddings t JOIN embeddings e ON e.vec_id < t.vec_id)
    SELECT query_id, event_id, round(distance, 6) AS distance, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, event_id) AS rank FROM d) WHERE rank <= 5""",
)
def closest_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event against everything before it."""
    rows = tables.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("event_id"), F.col("vec_id").alias("at"), F.col("embedding").alias("vector")
    )
    out = analogs.closest_analogs(rows, rows, 5)
    return out.select("query_id", "event_id", F.round("distance", 6).alias("distance"), "rank")
