"""Queries on bars: residuals, features, labels, folds, universe."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.fixed import STATIC_FALLBACK_SYMBOLS
from tidemark.functions.exprs import DAY_SECONDS, plus_seconds, r6, ticks
from tidemark.operators import folds, labels, metrics, panel, price_features, universe
from tidemark.plans.registry import (
    BARS, MOVES, RESIDUALS, SECTORS, at, joined, r6_sql, registered, stamp,
)
from tidemark.settings import counted, known_rows, settle, settle_counted
from tidemark.sources import tables


def stored_bars(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    """The weekly bars as a stored, checked table."""
    made = (tables.late_bars if late else tables.bars)(spark, sf_dir)
    return panel.stored_bars(made)


@registered(
    "residual_returns",
    f"""WITH {RESIDUALS}
    SELECT symbol, {at('session')} AS session, {r6_sql('ret_sec')} AS ret_sec,
           {r6_sql('ret_mkt')} AS ret_mkt, {r6_sql('gap_sec')} AS gap_sec,
           {r6_sql('gap_mkt')} AS gap_mkt, alone_sec, alone_mkt
    FROM (SELECT * REPLACE (CASE WHEN sector IS NOT NULL THEN ret_sec END AS ret_sec,
                            CASE WHEN sector IS NOT NULL THEN gap_sec END AS gap_sec,
                            CASE WHEN sector IS NOT NULL THEN alone_sec END AS alone_sec) FROM resid)""",
)
def residual_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stored_bars(spark, sf_dir)
    layout = panel.Layout.measure(bars)
    rows = panel.residuals(panel.moves(bars, layout), tables.sectors(spark, sf_dir), layout)
    mapped = F.col("sector").isNotNull()
    return rows.select(
        "symbol", stamp("session").alias("session"),
        r6(F.when(mapped, F.col("ret_sec"))).alias("ret_sec"), r6(F.col("ret_mkt")).alias("ret_mkt"),
        r6(F.when(mapped, F.col("gap_sec"))).alias("gap_sec"), r6(F.col("gap_mkt")).alias("gap_mkt"),
        F.when(mapped, F.col("alone_sec")).alias("alone_sec"), "alone_mkt",
    )


# How a feature row reads off a series ``s`` (one row per symbol and session, position ``pos``
# and both residual flavours); ``{k}`` holds the extra partition keys of the series.
def _feature_sql(series: str, keys: str, final: str) -> str:
    part = f"PARTITION BY {keys}symbol ORDER BY pos"
    rows = lambda a, b: f"OVER ({part} ROWS BETWEEN {a} AND {b})"
    flavour = lambda t: f"""
      CASE WHEN count(ret_{t}) {rows('4 PRECEDING', 'CURRENT ROW')} = 5
           THEN sum(ret_{t}) {rows('4 PRECEDING', 'CURRENT ROW')} END AS sum5_{t},
      CASE WHEN count(ret_{t}) {rows('19 PRECEDING', 'CURRENT ROW')} = 20
           THEN stddev_samp(ret_{t}) {rows('19 PRECEDING', 'CURRENT ROW')} END AS sd_{t},
      sum(coalesce(alone_{t}, 0)) {rows('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS bare_{t}"""
    return f"""
    framed AS (
      SELECT *, {flavour('sec')}, {flavour('mkt')},
        CASE WHEN count(v) {rows('20 PRECEDING', '1 PRECEDING')} = 20
             THEN median(v) {rows('20 PRECEDING', '1 PRECEDING')} END AS centre,
        CASE WHEN count(tr) {rows('14 PRECEDING', '1 PRECEDING')} = 14
             THEN avg(tr) {rows('14 PRECEDING', '1 PRECEDING')} END AS atr,
        CASE WHEN count(l) {rows('19 PRECEDING', 'CURRENT ROW')} = 20
             THEN min(l) {rows('19 PRECEDING', 'CURRENT ROW')} END AS low20,
        max(h) {rows('19 PRECEDING', 'CURRENT ROW')} AS high20
      FROM {series}),
    {final},
    car AS (
      SELECT q.symbol, q.as_of, sum(e.ret_sec) AS car_sec, sum(e.ret_mkt) AS car_mkt
      FROM asked q JOIN {series} e ON q.symbol = e.symbol {'AND q.as_of = e.as_of' if keys else ''}
       AND e.pos BETWEEN q.pos - 59 AND q.pos AND e.prev_session >= q.event_time
      GROUP BY q.symbol, q.as_of),
    chosen AS (
      SELECT a.*, fb, CASE WHEN fb THEN ret_mkt ELSE ret_sec END AS r1,
        CASE WHEN fb THEN sum5_mkt ELSE sum5_sec END AS r5, CASE WHEN fb THEN gap_mkt ELSE gap_sec END AS g,
        CASE WHEN fb THEN sd_mkt ELSE sd_sec END AS sd, CASE WHEN fb THEN bare_mkt ELSE bare_sec END AS bare,
        CASE WHEN fb THEN car_mkt ELSE car_sec END AS car
      FROM (SELECT *, (sector IS NULL OR peers_seen < 2) AS fb FROM asked) a LEFT JOIN car USING (symbol, as_of)),
    raw AS (
      SELECT *, r1 AS f1, r5 AS f2, g AS f3, r1 / nullif(sd, 0) AS f4, v / nullif(centre, 0) - 1 AS f5,
        (h - l) / nullif(atr, 0) AS f6, CAST(c - low20 AS DOUBLE) / nullif(high20 - low20, 0) AS f7,
        CASE WHEN event_time IS NOT NULL THEN car END AS f8
      FROM chosen),
    flags AS (
      SELECT *, CASE WHEN pos IS NULL THEN 'no_qualifying_data' ELSE array_to_string(list_sort(list_filter([
        CASE WHEN fb THEN 'sector_fallback_market' END,
        CASE WHEN bare > 0 THEN 'no_peer_data:' || CAST(bare AS BIGINT) END,
        'abnormal_volume_daily_baseline',
        CASE WHEN event_time IS NULL THEN 'no_event_time' END,
        CASE WHEN f1 IS NULL THEN 'insufficient_history:residual_return_1s' END,
        CASE WHEN f2 IS NULL THEN 'insufficient_history:residual_return_5s' END,
        CASE WHEN f3 IS NULL THEN 'insufficient_history:opening_gap_residual' END,
        CASE WHEN sd = 0 THEN 'zero_denominator:residual_return_zscore'
             WHEN f4 IS NULL THEN 'insufficient_history:residual_return_zscore' END,
        CASE WHEN centre = 0 THEN 'zero_denominator:abnormal_volume'
             WHEN f5 IS NULL THEN 'insufficient_history:abnormal_volume' END,
        CASE WHEN atr = 0 THEN 'zero_denominator:range_over_atr'
             WHEN f6 IS NULL THEN 'insufficient_history:range_over_atr' END,
        CASE WHEN high20 = low20 THEN 'zero_denominator:proximity_to_extreme'
             WHEN f7 IS NULL THEN 'insufficient_history:proximity_to_extreme' END,
        CASE WHEN event_time IS NOT NULL AND f8 IS NULL
             THEN 'insufficient_history:cumulative_abnormal_return' END,
        CASE WHEN abs(f1) > 5 THEN 'winsorized:residual_return_1s' END,
        CASE WHEN abs(f2) > 5 THEN 'winsorized:residual_return_5s' END,
        CASE WHEN abs(f3) > 5 THEN 'winsorized:opening_gap_residual' END,
        CASE WHEN abs(f4) > 5 THEN 'winsorized:residual_return_zscore' END,
        CASE WHEN abs(f5) > 5 THEN 'winsorized:abnormal_volume' END,
        CASE WHEN abs(f6) > 5 THEN 'winsorized:range_over_atr' END,
        CASE WHEN abs(f8) > 5 THEN 'winsorized:cumulative_abnormal_return' END
        ], lambda x: x IS NOT NULL)), ',') END AS quality_flags
      FROM raw)
    SELECT symbol, {at('as_of')} AS as_of,
      {r6_sql('CASE WHEN f1 IS NOT NULL THEN least(greatest(f1, -5), 5) END')} AS residual_return_1s,
      {r6_sql('CASE WHEN f2 IS NOT NULL THEN least(greatest(f2, -5), 5) END')} AS residual_return_5s,
      {r6_sql('CASE WHEN f3 IS NOT NULL THEN least(greatest(f3, -5), 5) END')} AS opening_gap_residual,
      {r6_sql('CASE WHEN f4 IS NOT NULL THEN least(greatest(f4, -5), 5) END')} AS residual_return_zscore,
      {r6_sql('CASE WHEN f5 IS NOT NULL THEN least(greatest(f5, -5), 5) END')} AS abnormal_volume,
      {r6_sql('CASE WHEN f6 IS NOT NULL THEN least(greatest(f6, -5), 5) END')} AS range_over_atr,
      {r6_sql('f7')} AS proximity_to_extreme,
      {r6_sql('CASE WHEN f8 IS NOT NULL THEN least(greatest(f8, -5), 5) END')} AS cumulative_abnormal_return, quality_flags
    FROM flags"""


_IN_ORDER = f"""WITH {RESIDUALS},
series AS (SELECT *, seen AS as_of FROM resid),
firsts AS (SELECT symbol, min(seen) AS first_seen FROM bars GROUP BY symbol),
{_feature_sql('series', '', '''
    asked AS (
      SELECT f.*, CASE WHEN CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS BIGINT) % 2 = 0
                       THEN session - INTERVAL 36 DAY END AS event_time,
        (SELECT count(*) FROM firsts g JOIN sectors t USING (symbol)
         WHERE t.sector = f.sector AND g.symbol <> f.symbol AND g.first_seen <= f.as_of) AS peers_seen
      FROM framed f)''')}"""


def _show_features(block: DataFrame) -> DataFrame:
    return block.select(
        "symbol", stamp("as_of").alias("as_of"),
        *[r6(F.col(n)).alias(n) for n in price_features.FEATURES],
        joined("quality_flags").alias("quality_flags"),
    )


def _feature_spine(bars: DataFrame) -> DataFrame:
    """One question per bar, at its regular arrival; every second brand has an event."""
    even = tables.brand_number(F.col("symbol")) % 2 == 0
    asked = bars.select(
        "symbol", (F.col("session") + F.expr("interval 15 minutes")).alias("as_of"),
        F.when(even, plus_seconds(F.col("session"), F.lit(-36 * DAY_SECONDS))).alias("event_time"),
    )
    return counted(asked, known_rows(bars))


@registered("price_features", _IN_ORDER)
def price_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stored_bars(spark, sf_dir)
    return _show_features(
        price_features.feature_block(_feature_spine(bars), bars, tables.sectors(spark, sf_dir))
    )


_LATE = f"""WITH {BARS}, {SECTORS},
arriving AS (
  SELECT b.* REPLACE (CASE WHEN CAST(floor(epoch(session) / 604800) AS BIGINT) = 1200
          AND CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS BIGINT) % 5 = 3 THEN seen + INTERVAL 2000 DAY
        WHEN (CAST(floor(epoch(session) / 604800) AS BIGINT)
        + CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS BIGINT)) % 29 = 0
      THEN seen + INTERVAL 10 DAY ELSE seen END AS seen), seen AS regular FROM bars b),
instants AS (SELECT DISTINCT regular AS as_of FROM arriving),
visible AS (
  SELECT i.as_of, b.*, s.sector FROM instants i JOIN arriving b ON b.seen <= i.as_of LEFT JOIN sectors s USING (symbol)),
vm AS (
  SELECT *, row_number() OVER w AS pos, lag(session) OVER w AS prev_session,
    CAST(c AS DOUBLE) / lag(c) OVER w - 1 AS ret, CAST(o AS DOUBLE) / lag(c) OVER w - 1 AS gap,
    CASE WHEN lag(c) OVER w IS NOT NULL
         THEN greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) END AS tr,
    count(*) OVER (PARTITION BY as_of, symbol) AS n
  FROM visible WINDOW w AS (PARTITION BY as_of, symbol ORDER BY session)),
counted AS (
  SELECT *, count(ret) OVER (PARTITION BY as_of, session, sector) - 1 AS peers_sec,
    count(ret) OVER (PARTITION BY as_of, session) - 1 AS peers_mkt FROM vm),
near AS (SELECT * FROM counted WHERE pos > n - 62),
vs AS (
  SELECT a.as_of, a.symbol, a.session, median(b.ret) AS m_ret, median(b.gap) AS m_gap
  FROM near a JOIN vm b ON a.as_of = b.as_of AND a.session = b.session AND a.sector = b.sector
   AND a.symbol <> b.symbol GROUP BY ALL),
vk AS (
  SELECT a.as_of, a.symbol, a.session, median(b.ret) AS m_ret, median(b.gap) AS m_gap
  FROM near a JOIN vm b ON a.as_of = b.as_of AND a.session = b.session AND a.symbol <> b.symbol GROUP BY ALL),
series AS (
  SELECT m.*, m.ret - coalesce(s.m_ret, 0) AS ret_sec, m.gap - coalesce(s.m_gap, 0) AS gap_sec,
    m.ret - coalesce(k.m_ret, 0) AS ret_mkt, m.gap - coalesce(k.m_gap, 0) AS gap_mkt,
    CASE WHEN m.ret IS NOT NULL THEN CAST(peers_sec = 0 AS INT) END AS alone_sec,
    CASE WHEN m.ret IS NOT NULL THEN CAST(peers_mkt = 0 AS INT) END AS alone_mkt
  FROM counted m LEFT JOIN vs s USING (as_of, symbol, session) LEFT JOIN vk k USING (as_of, symbol, session)),
members AS (SELECT as_of, sector, count(DISTINCT symbol) AS n_symbols FROM visible GROUP BY ALL),
{_feature_sql('series', 'as_of, ', '''
    asked AS (
      SELECT q.symbol, q.as_of, q.event_time, f.* EXCLUDE (symbol, as_of, sector), t.sector,
        coalesce(g.n_symbols, 0) - 1 AS peers_seen
      FROM (SELECT symbol, regular AS as_of,
                   CASE WHEN CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS BIGINT) % 2 = 0
                        THEN session - INTERVAL 36 DAY END AS event_time FROM arriving) q
      LEFT JOIN sectors t USING (symbol)
      LEFT JOIN framed f ON f.symbol = q.symbol AND f.as_of = q.as_of AND f.pos = f.n
      LEFT JOIN members g ON g.as_of = q.as_of AND g.sector = t.sector)''')}"""


@registered("price_features_late_bars", _LATE)
def price_block_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stored_bars(spark, sf_dir, late=True)
    return _show_features(
        price_features.feature_block(_feature_spine(bars), bars, tables.sectors(spark, sf_dir))
    )


@registered(
    "bar_rejects",
    """WITH landed AS (
      SELECT p_brand AS symbol, CASE WHEN l_returnflag = 'R' THEN ' ' ELSE 'prints' END AS feed,
        CAST(floor(l_extendedprice / l_quantity * 10000) AS BIGINT) AS px, l_linenumber, l_suppkey,
        CAST(l_quantity AS BIGINT) - 2 AS v
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    shaped AS (SELECT *, px - 7000000 AS o, px + 10 * (l_linenumber - 3) AS h, px - 10 * (l_suppkey % 3) AS l, px AS c FROM landed)
    SELECT symbol, reasons, count(*) AS n FROM (
      SELECT symbol, array_to_string(list_filter([
        CASE WHEN trim(feed) = '' THEN 'feed' END, CASE WHEN v < 0 THEN 'volume' END,
        CASE WHEN h < l THEN 'high_below_low' END,
        CASE WHEN o <= 0 THEN 'open_not_positive' END, CASE WHEN h <= 0 THEN 'high_not_positive' END,
        CASE WHEN l <= 0 THEN 'low_not_positive' END, CASE WHEN c <= 0 THEN 'close_not_positive' END,
        CASE WHEN o < l OR o > h THEN 'open_outside_range' END,
        CASE WHEN c < l OR c > h THEN 'close_outside_range' END], lambda x: x IS NOT NULL), ',') AS reasons
      FROM shaped) WHERE reasons <> '' GROUP BY ALL""",
)
def bar_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single prints landed as bars, with the defects they carry."""
    lines = tables.table(spark, sf_dir, "lineitem").join(
        tables.table(spark, sf_dir, "part").select("p_partkey", "p_brand"),
        F.col("l_partkey") == F.col("p_partkey"),
    )
    px = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000).cast("long")
    money = lambda c: (c.cast("decimal(18,0)") / F.lit(10000).cast("decimal(5,0)")).cast("decimal(18,4)")
    landed = lines.select(
        F.col("p_brand").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", F.lit(" ")).otherwise(F.lit("prints")).alias("feed"),
        F.col("l_shipdate").alias("session"), F.col("l_shipdate").alias("first_seen_time"),
        money(px - 7000000).alias("open"), money(px + 10 * (F.col("l_linenumber") - 3)).alias("high"),
        money(px - 10 * (F.col("l_suppkey") % 3)).alias("low"), money(px).alias("close"),
        (F.col("l_quantity").cast("long") - 2).alias("volume"),
    )
    told = panel.bar_rejects(landed)
    return told.groupBy("symbol", joined("reasons").alias("reasons")).agg(F.count("*").alias("n"))


LABEL_CONFIG = labels.LabelConfig()

LABELS = RESIDUALS + f""",
choice AS (
  SELECT r.*, (sector IS NULL OR (SELECT count(*) FROM sectors t WHERE t.sector = r.sector
     AND t.symbol IN (SELECT symbol FROM bars)) - 1 < 2) AS fb FROM resid r),
forward AS (
  SELECT symbol, session, lead(session, 1) OVER w AS entry_session, lead(session, 6) OVER w AS exit_session,
    max(session) OVER (PARTITION BY symbol) AS last_own,
    sum(CASE WHEN fb THEN ret_mkt ELSE ret_sec END) OVER f AS value,
    sum(CASE WHEN fb THEN alone_mkt ELSE alone_sec END) OVER f AS bare,
    max(CASE WHEN fb THEN seen_mkt ELSE seen_sec END) OVER f AS outcome_time, fb,
    list(session) OVER f AS outcome_sessions
  FROM choice
  WINDOW w AS (PARTITION BY symbol ORDER BY session),
         f AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING)),
labels_all AS (
  SELECT 'lbl-' || substr(sha256(symbol || '|' || strftime(session, '%Y-%m-%dT%H:%M:%S') || '+00:00|{LABEL_CONFIG.version}'), 1, 20) AS label_id,
    *, CASE WHEN entry_session IS NULL THEN
              CASE WHEN last_own < (SELECT max(session) FROM bars) THEN 'delisted' ELSE 'panel_too_short' END
            WHEN exit_session IS NULL THEN 'incomplete_horizon' ELSE 'labelled' END AS status
  FROM forward),
labels_done AS (SELECT * FROM labels_all WHERE status = 'labelled'),
held AS (SELECT label_id, symbol, unnest(outcome_sessions) AS s FROM labels_done),
weights AS (
  SELECT h.label_id, avg(1.0 / o.n) AS uniqueness
  FROM held h JOIN (SELECT symbol, s, count(*) AS n FROM held GROUP BY ALL) o USING (symbol, s)
  GROUP BY h.label_id)"""


def all_labels(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    asked = bars.select("symbol", F.col("session").alias("decision_session"))
    return labels.forward_labels(asked, bars, tables.sectors(spark, sf_dir), LABEL_CONFIG, strict=False)


def weighted_labels(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """Stored labels with their overlap weights."""
    done, _ = settle_counted(labels.labelled(all_labels(spark, sf_dir, bars)), "labels")
    return labels.with_uniqueness(done)


@registered(
    "forward_labels",
    f"""WITH {LABELS}
    SELECT label_id, symbol, {at('session')} AS prediction_time, status,
      CASE WHEN status = 'labelled' THEN {at('outcome_time')} END AS outcome_time,
      CASE WHEN status = 'labelled' THEN {at('entry_session')} END AS entry_session,
      CASE WHEN status = 'labelled' THEN {at('exit_session')} END AS exit_session,
      CASE WHEN status = 'labelled' THEN {r6_sql('value')} END AS forward_residual_return,
      CASE WHEN status = 'labelled' THEN array_to_string(list_sort(list_filter([
        CASE WHEN fb THEN 'sector_fallback_market' END,
        CASE WHEN bare > 0 THEN 'no_peer_data:' || CAST(bare AS BIGINT) END,
        CASE WHEN abs(value) > 0.5 THEN 'implausible_magnitude' END], lambda x: x IS NOT NULL)), ',') END AS quality_flags
    FROM labels_all""",
)
def forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_labels(spark, sf_dir, stored_bars(spark, sf_dir))
    return found.select(
        "label_id", "symbol", stamp("prediction_time").alias("prediction_time"), "status",
        *[stamp(n).alias(n) for n in ("outcome_time", "entry_session", "exit_session")],
        r6(F.col("forward_residual_return")).alias("forward_residual_return"),
        joined("quality_flags").alias("quality_flags"),
    )


@registered(
    "label_uniqueness",
    f"""WITH {LABELS} SELECT label_id, symbol, {r6_sql('uniqueness')} AS uniqueness,
      len(outcome_sessions) AS sessions FROM labels_done JOIN weights USING (label_id)""",
)
def label_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weighted_labels(spark, sf_dir, stored_bars(spark, sf_dir))
    return out.select(
        "label_id", "symbol", r6(F.col("uniqueness")).alias("uniqueness"),
        F.size("outcome_sessions").alias("sessions"),
    )


DAYS = lambda n: timedelta(days=n)
SPLIT = folds.SplitConfig(DAYS(50), DAYS(60), DAYS(700), DAYS(200), DAYS(200), 5)
ORIGIN = datetime(1995, 1, 9, tzinfo=timezone.utc)
UNTIL = datetime(2001, 11, 1, tzinfo=timezone.utc)


PLAN = folds.FoldPlan(ORIGIN, SPLIT, UNTIL)


def _folds_sql(train: int, cal: int, test: int, purge: int, n: int) -> str:
    return f"""
folds AS (
  SELECT CAST(i AS INT) AS fold, o AS train_start, o + to_days(CAST({train} + i * {test} AS INT)) AS train_end,
    o + to_days(CAST({train} + i * {test} + {purge} AS INT)) AS calibration_start,
    o + to_days(CAST({train} + i * {test} + {purge} + {cal} AS INT)) AS calibration_end,
    o + to_days(CAST({train} + i * {test} + {2 * purge} + {cal} AS INT)) AS test_start,
    o + to_days(CAST({train} + i * {test} + {2 * purge} + {cal} + {test} AS INT)) AS test_end
  FROM (SELECT unnest(range({n})) AS i, TIMESTAMP '1995-01-09' AS o)
  WHERE o + to_days(CAST({train} + i * {test} + {2 * purge} + {cal} + {test} AS INT)) <= TIMESTAMP '2001-11-01'),
placed AS (
  SELECT fold, label_id, session, outcome_time,
    CASE WHEN session >= train_start AND session < train_end THEN 'train'
         WHEN session >= calibration_start AND session < calibration_end THEN 'calibration'
         WHEN session >= test_start AND session < test_end THEN 'test' END AS predicted_in,
    CASE WHEN session >= train_start AND session < train_end THEN train_end
         WHEN session >= calibration_start AND session < calibration_end THEN calibration_end
         WHEN session >= test_start AND session < test_end THEN test_end END AS closes
  FROM labels_done, folds WHERE session >= train_start AND session < test_end),
assigned AS (
  SELECT fold, label_id, session, outcome_time, predicted_in,
    CASE WHEN outcome_time <= closes THEN predicted_in END AS win,
    CASE WHEN predicted_in IS NULL THEN 'in_purge_gap' WHEN outcome_time > closes THEN 'outcome_crosses_boundary' END AS reason
  FROM placed)"""


FOLDS = _folds_sql(700, 200, 200, 60, 5)


@registered(
    "fold_assignment",
    f"WITH {LABELS}, {FOLDS} SELECT fold, label_id, win AS \"window\", reason FROM assigned",
)
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = labels.labelled(all_labels(spark, sf_dir, stored_bars(spark, sf_dir)))
    return folds.assign(done, PLAN).select("fold", "label_id", "window", "reason")


@registered(
    "fold_windows",
    f"""WITH {LABELS}, {FOLDS}
    SELECT f.fold, {', '.join(f"{at('f.' + e)} AS {e}" for e in folds.EDGES)},
      CAST(count(a.win) AS BIGINT) AS placed
    FROM folds f LEFT JOIN assigned a ON a.fold = f.fold GROUP BY ALL""",
)
def fold_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = labels.labelled(all_labels(spark, sf_dir, stored_bars(spark, sf_dir)))
    placed = folds.assign(done, PLAN).groupBy("fold").agg(F.count("window").alias("placed"))
    return PLAN.table(spark).join(placed, "fold", "left").select(
        "fold", *[stamp(e).alias(e) for e in folds.EDGES], F.coalesce("placed", F.lit(0)).alias("placed")
    )


TIGHT = folds.SplitConfig(DAYS(3), DAYS(45), DAYS(700), DAYS(5), DAYS(30), 60)


@registered(
    "fold_empty_windows",
    f"""WITH {LABELS}, {_folds_sql(700, 5, 30, 45, 60)},
    spine AS (SELECT fold, unnest(['calibration', 'test']) AS win FROM folds),
    seen AS (SELECT fold, predicted_in AS win, count(*) AS predicted, count(assigned.win) AS members
             FROM assigned WHERE predicted_in IS NOT NULL GROUP BY ALL)
    SELECT fold, win AS "window", CAST(coalesce(predicted, 0) AS BIGINT) AS predicted,
      CASE WHEN coalesce(predicted, 0) > 0 THEN 'all_purged' ELSE 'none_predicted' END AS code
    FROM spine LEFT JOIN seen USING (fold, win) WHERE coalesce(members, 0) = 0""",
)
def fold_empty_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = labels.labelled(all_labels(spark, sf_dir, stored_bars(spark, sf_dir)))
    plan = folds.FoldPlan(ORIGIN, TIGHT, UNTIL)
    return folds.empty_windows(folds.assign(done, plan), plan.table(spark))


def _digest_sql(rows: str, key: str, member: str) -> str:
    lane = lambda i: f"CAST(sum(CAST(CAST('0x' || substr(sha256({member}), {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"
    return f"""SELECT {key}, count(*) AS members,
      sha256(count(*) || '|' || {" || '|' || ".join(lane(i) for i in range(4))}) AS digest FROM {rows} GROUP BY {key}"""


@registered(
    "fold_hash",
    f"""WITH {LABELS}, {FOLDS},
    sums AS ({_digest_sql('assigned', 'fold', "label_id || '|' || coalesce(win, '') || '|' || coalesce(reason, '')")})
    SELECT f.fold, coalesce(members, 0) AS members,
      sha256(coalesce(digest, '') || '|{50 * 86_400_000_000}|{60 * 86_400_000_000}|' || {" || '|' || ".join(f"epoch_us({e})" for e in folds.EDGES)}) AS digest
    FROM folds f LEFT JOIN sums h ON f.fold = h.fold""",
)
def fold_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = labels.labelled(all_labels(spark, sf_dir, stored_bars(spark, sf_dir)))
    return folds.fold_hash(folds.assign(done, PLAN), PLAN)


MDV = BARS + """,
mdv AS (
  SELECT symbol, session, seen, c, n, CASE WHEN n = 20 THEN m END AS m FROM (
    SELECT *, count(*) OVER w AS n, median(c * v) OVER w AS m
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))"""


@registered(
    "median_dollar_volume",
    f"WITH {MDV} SELECT symbol, {at('session')} AS session, CAST(round_even(m, 0) AS BIGINT) AS median_ticks FROM mdv",
)
def median_dollar_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = universe.median_dollar_volume(stored_bars(spark, sf_dir))
    return out.select(
        "symbol", stamp("session").alias("session"),
        ticks(F.col("median_dollar_volume")).alias("median_ticks"),
    )


FLOORS = universe.Floors(Decimal("300"), Decimal("150000"), 8)

# Facts: one per bar whose trailing median is known; flags come from the brand and the week.
FACTS = MDV + """,
facts AS (
  SELECT symbol, session, seen, 'feed' || (b % 3) AS feed, c, m, b, wk,
    CASE WHEN (b + wk) % 29 <> 3 THEN (b + wk) % 17 <> 0 END AS active, (b * 3 + wk) % 19 <> 0 AS tradable, (b + 2 * wk) % 13 <> 0 AS options_enabled,
    (b + wk) % 11 <> 0 AS near_money, CASE WHEN (b + wk) % 31 <> 4 THEN (b + 5 * wk) % 23 = 0 END AS corporate_action
  FROM (SELECT *, CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS BIGINT) AS b,
               CAST(floor(epoch(session) / 604800) AS BIGINT) AS wk FROM mdv WHERE m IS NOT NULL)),
latest AS (
  SELECT q.as_of, f.* FROM (SELECT symbol, session - INTERVAL 1 HOUR AS as_of FROM bars) q
  ASOF JOIN facts f ON q.symbol = f.symbol AND f.seen <= q.as_of),
judged AS (
  SELECT *, list_filter([
    CASE WHEN NOT coalesce(active, false) THEN 'inactive' END, CASE WHEN NOT tradable THEN 'not_tradable' END,
    CASE WHEN coalesce(corporate_action, true) THEN 'unresolved_corporate_action' END,
    CASE WHEN NOT options_enabled THEN 'options_not_enabled' END,
    CASE WHEN NOT near_money THEN 'no_quoted_near_money_expiration' END,
    CASE WHEN c < 3000000 THEN 'below_price_floor' END,
    CASE WHEN m < 1500000000 THEN 'below_dollar_volume_floor' END], lambda x: x IS NOT NULL) AS reasons FROM latest),
ranked AS (
  SELECT *, CASE WHEN len(reasons) = 0 THEN row_number() OVER (
    PARTITION BY as_of, len(reasons) = 0 ORDER BY m DESC, symbol) END AS rk FROM judged)"""


def universe_facts(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    b = tables.brand_number(F.col("symbol"))
    wk = F.floor(F.unix_timestamp("session") / 604800)
    return universe.median_dollar_volume(bars).where("median_dollar_volume is not null").select(
        "symbol", F.concat(F.lit("feed"), (b % 3).cast("string")).alias("feed"), "first_seen_time",
        F.when((b + wk) % 29 != 3, (b + wk) % 17 != 0).alias("active"), ((b * 3 + wk) % 19 != 0).alias("tradable"),
        ((b + 2 * wk) % 13 != 0).alias("options_enabled"), F.col("close").alias("prior_close"),
        "median_dollar_volume", ((b + wk) % 11 != 0).alias("near_money_quotes_7_to_21_dte"),
        F.when((b + wk) % 31 != 4, (b + 5 * wk) % 23 == 0).alias("unresolved_corporate_action"),
    )


def _judged(spark: SparkSession, sf_dir: str, fallback: bool = False) -> DataFrame:
    """Facts as of an hour before each session's own bar."""
    bars = stored_bars(spark, sf_dir)
    spine = bars.select("symbol", (F.col("session") - F.expr("interval 1 hour")).alias("as_of"))
    latest = universe.latest_as_of(spine, settle(universe_facts(spark, sf_dir, bars), "facts"))
    return settle(universe.screened(latest, FLOORS, fallback), "judged")


@registered(
    "universe_latest_facts",
    f"""WITH {FACTS} SELECT {at('as_of')} AS as_of, symbol, {at('seen')} AS first_seen_time, feed,
      CAST(c AS BIGINT) AS close_ticks FROM latest""",
)
def universe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select(
        stamp("as_of").alias("as_of"), "symbol", stamp("first_seen_time").alias("first_seen_time"),
        "feed", ticks(F.col("prior_close")).alias("close_ticks"),
    )


@registered(
    "universe_members",
    f"WITH {FACTS} SELECT {at('as_of')} AS as_of, CAST(rk AS BIGINT) AS rank, symbol FROM ranked WHERE rk <= 8",
)
def universe_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.members(_judged(spark, sf_dir), FLOORS).select(stamp("as_of").alias("as_of"), "rank", "symbol")


@registered(
    "universe_exclusions",
    f"""WITH {FACTS} SELECT {at('as_of')} AS as_of, symbol,
      CASE WHEN rk > 8 THEN 'outside_cap' ELSE array_to_string(reasons, ',') END AS reasons
    FROM ranked WHERE rk IS NULL OR rk > 8""",
)
def universe_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    out = universe.exclusions(judged, universe.members(judged, FLOORS))
    return out.select(stamp("as_of").alias("as_of"), "symbol", joined("reasons").alias("reasons"))


@registered(
    "universe_hash",
    f"""WITH {FACTS},
    parts AS (
      SELECT as_of, list_sort(list_distinct(list(feed))) AS feeds,
        coalesce(list(symbol ORDER BY rk) FILTER (rk <= 8), []) AS symbols FROM ranked GROUP BY as_of)
    SELECT {at('as_of')} AS as_of, array_to_string(symbols, ',') AS symbols, array_to_string(feeds, ',') AS feeds,
      sha256('{{"as_of":"' || strftime(as_of, '%Y-%m-%dT%H:%M:%S') || '+00:00","fallback_list_hash":null,"feeds":['
        || array_to_string(list_transform(feeds, lambda x: '"' || x || '"'), ',')
        || '],"max_symbols":8,"min_median_dollar_volume":"150000.0000","min_prior_close":"300.0000","symbols":['
        || array_to_string(list_transform(symbols, lambda x: '"' || x || '"'), ',')
        || '],"used_static_fallback":false}}') AS universe_hash
    FROM parts""",
)
def universe_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    out = universe.headers(judged, universe.members(judged, FLOORS), FLOORS)
    return out.select(
        stamp("as_of").alias("as_of"), joined("symbols").alias("symbols"), joined("feeds").alias("feeds"),
        "universe_hash",
    )


@registered(
    "universe_fallback_screen",
    f"""WITH {FACTS}, fb AS (
      SELECT symbol, array_to_string(list_filter([
        CASE WHEN NOT coalesce(active, false) THEN 'inactive' END, CASE WHEN NOT tradable THEN 'not_tradable' END,
        CASE WHEN coalesce(corporate_action, true) THEN 'unresolved_corporate_action' END, 'options_not_enabled',
        CASE WHEN c < 3000000 THEN 'below_price_floor' END,
        CASE WHEN m < 1500000000 THEN 'below_dollar_volume_floor' END], lambda x: x IS NOT NULL), ',') AS reasons FROM latest)
    SELECT symbol, reasons, count(*) AS n FROM fb GROUP BY ALL""",
)
def universe_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No brand is on the fixed fallback list, so every symbol lacks option evidence."""
    out = _judged(spark, sf_dir, fallback=True)
    return out.groupBy("symbol", joined("reasons").alias("reasons")).agg(F.count("*").alias("n"))


LISTED = ", ".join(f"({i + 1}, '{name}')" for i, name in enumerate(STATIC_FALLBACK_SYMBOLS))


@registered(
    "universe_fallback_members",
    f"""WITH {FACTS}, listed(b, name) AS (VALUES {LISTED}), fb AS (
      SELECT name AS symbol, array_to_string(list_filter([
        CASE WHEN NOT coalesce(active, false) THEN 'inactive' END, CASE WHEN NOT tradable THEN 'not_tradable' END,
        CASE WHEN coalesce(corporate_action, true) THEN 'unresolved_corporate_action' END,
        CASE WHEN c < 3000000 THEN 'below_price_floor' END,
        CASE WHEN m < 1500000000 THEN 'below_dollar_volume_floor' END], lambda x: x IS NOT NULL), ',') AS reasons
      FROM latest JOIN listed USING (b))
    SELECT symbol, reasons, count(*) AS n FROM fb GROUP BY ALL""",
)
def universe_fallback_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands under the names of the fixed list, judged without option evidence."""
    bars = stored_bars(spark, sf_dir)
    spine = bars.select("symbol", (F.col("session") - F.expr("interval 1 hour")).alias("as_of"))
    latest = universe.latest_as_of(spine, settle(universe_facts(spark, sf_dir, bars), "facts"))
    listed = universe.static_fallback(spark).withColumnRenamed("symbol", "_name")
    named = latest.join(listed, tables.brand_number(F.col("symbol")) == F.col("position"))
    named = named.withColumn("symbol", F.col("_name")).drop("_name", "position")
    out = universe.screened(named, FLOORS, fallback=True)
    return out.groupBy("symbol", joined("reasons").alias("reasons")).agg(F.count("*").alias("n"))


@registered(
    "bar_sanity_report",
    f"""WITH {MOVES},
    cal AS (SELECT session, row_number() OVER (ORDER BY session) AS day FROM (SELECT DISTINCT session FROM bars)),
    late AS (SELECT symbol, session, week_no % 29 = 0 AS is_late, CASE WHEN week_no % 31 = 7 THEN 2 ELSE 1 END AS copies FROM (
      SELECT symbol, session, CAST(floor(epoch(session) / 604800) AS BIGINT) + CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS BIGINT) AS week_no FROM bars))
    SELECT m.symbol, CAST(sum(copies) AS BIGINT) AS bars, CAST(coalesce(sum(copies) FILTER (is_late), 0) AS BIGINT) AS stale,
      CAST(coalesce(sum(copies) FILTER (m.seen + CASE WHEN is_late THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END > TIMESTAMP '2001-06-01'), 0) AS BIGINT) AS future_stamped,
      count(*) FILTER (copies = 2) AS repeated, max(day) - min(day) + 1 - count(*) AS missing_sessions,
      count(*) FILTER (abs(m.ret) > 10) AS extreme_moves
    FROM moves m JOIN cal USING (session) JOIN late ON late.symbol = m.symbol AND late.session = m.session
    GROUP BY m.symbol""",
)
def bar_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar once, and some of them twice."""
    bars = stored_bars(spark, sf_dir, late=True)
    week = F.floor(F.unix_micros("session") / (604_800 * 1_000_000)) + tables.brand_number(F.col("symbol"))
    twice = bars.unionByName(bars.where(week % 31 == 7))
    return metrics.sanity_report(twice, 10.0, 86_400, F.lit("2001-06-01T00:00:00Z").cast("timestamp"))
