"""Queries on logs: observations, broker feeds, reconciliation, ledger, replay, stops, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import fixed
from tidemark.functions.exprs import money, r6, ticks, utc_day, utc_floor, utc_text
from tidemark.operators import ledger, lifecycle, metrics, reconcile, risk
from tidemark.plans.registry import ORACLES, at, joined, r6_sql, registered, stamp
from tidemark.settings import settle, work_path
from tidemark.sources import broker, jsonl, observations, tables
from tidemark.streaming import jobs

# --- observations -------------------------------------------------------------------------

_ISO = lambda c: (
    f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 = 0 THEN '' "
    f"ELSE '.' || lpad(CAST(epoch_us({c}) % 1000000 AS VARCHAR), 6, '0') END || '+00:00'"
)

OBSERVED = f"""
raw AS (
  SELECT event_id AS i, event_type AS feed, ts AS source_time,
    CASE WHEN event_id % 131 = 11 THEN ' ' ELSE CAST(user_id AS VARCHAR) END AS subject,
    CASE WHEN event_id % 109 = 8 THEN ts + INTERVAL 2 DAY ELSE ts END AS event_time,
    CASE WHEN event_id % 97 = 3 THEN ts - INTERVAL 1 MINUTE ELSE ts + to_seconds(event_id % 90) END AS received_time,
    CASE WHEN event_type IN ('click', 'error') THEN
           CASE WHEN event_id % 101 = 5 THEN NULL WHEN event_id % 103 = 6 THEN ts - INTERVAL 2 MINUTE ELSE ts + INTERVAL 90 SECOND END
         WHEN event_id % 107 = 7 THEN ts END AS given,
    CASE WHEN event_id % 113 = 9 THEN ts ELSE ts + INTERVAL 1 DAY END AS as_of,
    event_id % 127 <> 10 AS has_payload, printf('%.2f', value) AS v, props
  FROM events),
known AS (
  SELECT *, feed IN ('click', 'error') AS proves, feed = 'signup' AS unregistered, feed = 'error' AS future_ok,
    CASE feed WHEN 'view' THEN 60 WHEN 'purchase' THEN 3600 ELSE 0 END AS lag FROM raw),
dated AS (SELECT *, CASE WHEN proves THEN given WHEN NOT unregistered THEN source_time + to_seconds(lag) END AS seen FROM known),
judged AS (
  SELECT *, CASE WHEN unregistered THEN 'feed' WHEN trim(subject) = '' THEN 'subject_id' WHEN NOT has_payload THEN 'payload'
    WHEN proves AND given IS NULL THEN 'first_seen_time' WHEN NOT proves AND given IS NOT NULL THEN 'first_seen_time'
    WHEN seen < source_time THEN 'first_seen_time' WHEN received_time < source_time THEN 'received_time'
    WHEN proves AND seen < received_time THEN 'first_seen_time' WHEN seen > as_of THEN 'first_seen_time'
    WHEN event_time > seen AND NOT future_ok THEN 'event_time' END AS reject FROM dated),
addressed AS (
  SELECT *, sha256('{{"as_of":"' || {_ISO('as_of')} || '","availability_lag_seconds":' || lag || ',"event_time":"' || {_ISO('event_time')}
    || '","feed":"' || feed || '","first_seen_time":"' || {_ISO('seen')} || '","payload":{{"props":' || CAST(to_json(props) AS VARCHAR)
    || ',"value":"' || v || '"}},"quality_flags":[' || CASE WHEN proves THEN '' ELSE '"availability_lag_applied"' END
    || '],"received_time":"' || {_ISO('received_time')} || '","source_time":"' || {_ISO('source_time')}
    || '","subject_id":"' || subject || '"}}') AS observation_id FROM judged WHERE reject IS NULL)"""


def judged_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.judged_observations(tables.observations(spark, sf_dir), tables.feed_policies(spark))


@registered(
    "recorded_observations",
    f"""WITH {OBSERVED} SELECT DISTINCT observation_id, feed, subject AS subject_id, {at('seen')} AS first_seen_time,
      lag AS availability_lag_seconds FROM addressed""",
)
def recorded_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording everything twice stores everything once."""
    path = work_path(spark, "store")
    judged = judged_observations(spark, sf_dir)
    observations.record(judged, path)
    observations.record(judged, path)
    return observations.stored(spark, path).select(
        "observation_id", "feed", "subject_id", stamp("first_seen_time").alias("first_seen_time"),
        "availability_lag_seconds",
    )


@registered(
    "observation_rejects",
    f"WITH {OBSERVED} SELECT i AS seq, feed, reject AS reject_field FROM judged WHERE reject IS NOT NULL",
)
def observation_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.rejected(judged_observations(spark, sf_dir)).select("seq", "feed", "reject_field")


@registered(
    "observations_as_of",
    f"""WITH {OBSERVED} SELECT DISTINCT observation_id, {at('seen')} AS first_seen_time FROM addressed
    WHERE feed = 'purchase' AND seen <= TIMESTAMP '2024-01-15 12:00:00'""",
)
def observations_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "store")
    observations.record(judged_observations(spark, sf_dir), path)
    out = observations.read_as_of(
        observations.stored(spark, path), F.lit("2024-01-15T12:00:00Z").cast("timestamp"), feed="purchase"
    )
    return out.select("observation_id", stamp("first_seen_time").alias("first_seen_time"))


@registered(
    "jsonl_bad_lines",
    """SELECT CASE WHEN event_id % 31 = 4 THEN 'blank' WHEN event_id % 29 = 5 THEN 'undecodable' ELSE 'not_an_object' END AS problem,
      count(*) AS n FROM events WHERE event_id % 31 = 4 OR event_id % 29 = 5 OR event_id % 23 = 6 GROUP BY 1""",
)
def jsonl_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines with blank, cut and non-object lines among them."""
    i = F.col("event_id")
    text = F.to_json(F.struct("event_id", "event_type", "value"))
    line = (
        F.when(i % 31 == 4, F.lit("  ")).when(i % 29 == 5, F.substring(text, 1, 9))
        .when(i % 23 == 6, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    )
    path = work_path(spark, "lines")
    tables.table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return jsonl.bad_lines(spark.read.text(path)).groupBy("problem").agg(F.count("*").alias("n"))


@registered(
    "jsonl_strict_scan",
    "SELECT event_id, event_type, round(value, 2) AS value FROM events",
)
def jsonl_strict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "lines")
    rows = tables.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return jsonl.read_strict(spark, path, rows.schema).withColumn("value", F.round("value", 2))


@registered(
    "normalised_landing",
    f"""SELECT doc_id, CAST(doc_id % 3 = 1 AS INT) AS is_revision,
      {at("TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7919 % 43200) + CASE WHEN doc_id % 3 = 1 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END + INTERVAL 60 SECOND")} AS first_seen_time
    FROM documents""",
)
def normalised_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    created = tables.instant(d * 7919 % 43200)
    landed = tables.table(spark, sf_dir, "documents").select(
        "doc_id", created.alias("created_at"),
        F.when(d % 3 == 1, created + F.expr("interval 30 minutes")).when(d % 3 == 2, created).alias("updated_at"),
    )
    out = observations.normalised_raw(landed, 60, "all", "2024-02-01")
    return out.select("doc_id", F.col("is_revision").cast("int").alias("is_revision"), stamp("first_seen_time").alias("first_seen_time"))


@registered(
    "uncovered_symbols",
    "SELECT DISTINCT p_brand || '/' || p_type AS symbol FROM part WHERE p_brand || '/' || p_type NOT IN (SELECT p_brand || '/' || p_type FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 49)",
)
def uncovered_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and type pairs asked for, against those with a large returned lot."""
    parts = tables.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("symbol"))
    lots = tables.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49")
    return observations.uncovered(parts, lots.join(parts, F.col("l_partkey") == F.col("p_partkey")))


# --- broker feeds -------------------------------------------------------------------------

def _order_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    statuses = F.array(*[F.lit(s) for s in (*fixed.BROKER_STATUSES, "brand_new_status")])
    when = F.concat(utc_text(F.col("o_orderdate"), "T"), F.lit("Z"))
    body = F.struct(
        F.concat(F.lit("b"), k).alias("id"),
        F.when(k % 17 == 3, F.lit("")).otherwise(F.concat(F.lit("c"), k)).alias("client_order_id"),
        F.element_at(statuses, (k % 20 + 1).cast("int")).alias("status"),
        F.when(k % 19 == 4, F.lit("01.5")).otherwise((k % 7).cast("string")).alias("filled_qty"),
        F.when(k % 23 == 5, F.lit("yesterday")).otherwise(when).alias("created_at"),
        when.alias("updated_at"), when.alias("submitted_at"),
        F.when(k % 2 == 0, when).alias("filled_at"),
    )
    raw = F.to_json(body, {"ignoreNullFields": "false"})
    raw = F.when(k % 29 == 6, F.regexp_replace(raw, ',"submitted_at":"[^"]*"', "")).otherwise(raw)
    raw = F.when(k % 37 == 8, F.regexp_replace(raw, '"filled_qty":"[^"]*"', '"filled_qty":1.5')).otherwise(raw)
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))


@registered(
    "broker_order_feed",
    f"""WITH s AS (SELECT *, list_extract({[*fixed.BROKER_STATUSES, 'unknown']}, CAST(o_orderkey % 20 + 1 AS INT)) AS st FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 3 THEN 'client_order_id' WHEN o_orderkey % 19 = 4 OR o_orderkey % 37 = 8 THEN 'filled_qty'
      WHEN o_orderkey % 23 = 5 THEN 'created_at' WHEN o_orderkey % 29 = 6 THEN 'submitted_at' END AS reject_field, st AS status,
      CASE WHEN o_orderkey % 2 = 0 THEN {at('o_orderdate')} END AS filled_at FROM s""",
)
def broker_order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = broker.orders(_order_json(spark, sf_dir))
    return out.select("o_orderkey", "reject_field", "status", stamp("filled_at").alias("filled_at"))


@registered(
    "broker_activity_feed",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q,
      CASE WHEN l_partkey % 41 = 1 THEN 'side' WHEN l_partkey % 43 = 2 THEN 'qty' WHEN l_partkey % 47 = 3 THEN 'price' END AS reject_field,
      CASE WHEN l_partkey % 43 = 2 OR l_partkey % 41 = 1 THEN NULL WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS signed_quantity,
      CASE WHEN l_linestatus = 'F' THEN 'fill' ELSE 'unknown' END AS activity_type FROM lineitem""",
)
def broker_activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    q = F.col("l_quantity").cast("long")
    body = F.struct(
        F.lit("a").alias("id"), F.col("l_orderkey").cast("string").alias("order_id"), p.cast("string").alias("symbol"),
        F.when(F.col("l_linestatus") == "F", F.lit("fill")).otherwise(F.lit("other")).alias("type"),
        F.when(p % 41 == 1, F.lit("hold")).when(F.col("l_returnflag") == "R", F.lit("sell")).otherwise(F.lit("buy")).alias("side"),
        F.when(p % 43 == 2, F.lit("1e2")).otherwise(q.cast("string")).alias("qty"),
        F.when(p % 47 == 3, F.lit("1,5")).otherwise(F.lit("1.25")).alias("price"),
        F.concat(utc_text(F.col("l_shipdate"), "T"), F.lit("+00:00")).alias("transaction_time"),
    )
    raw = tables.table(spark, sf_dir, "lineitem").withColumn("raw", F.to_json(body))
    return broker.activities(raw).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("q"), "reject_field", "signed_quantity", "activity_type"
    )


@registered(
    "broker_position_feed",
    """SELECT p_partkey, CASE WHEN p_partkey % 13 = 1 AND p_size <> 0 THEN 'qty_side_conflict' WHEN p_partkey % 17 = 2 THEN 'symbol' END AS reject_field,
      CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -p_size END * CASE WHEN p_partkey % 13 = 1 THEN -1 ELSE 1 END AS signed_quantity FROM part""",
)
def broker_position_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    qty = F.when(p % 2 == 0, F.col("p_size")).otherwise(-F.col("p_size")) * F.when(p % 13 == 1, -1).otherwise(1)
    body = F.struct(
        F.when(p % 17 == 2, F.lit("")).otherwise(F.col("p_brand")).alias("symbol"), qty.cast("string").alias("qty"),
        F.when(p % 2 == 0, F.lit("long")).otherwise(F.lit("short")).alias("side"), F.lit("10.5").alias("avg_entry_price"),
    )
    raw = tables.table(spark, sf_dir, "part").withColumn("raw", F.to_json(body))
    return broker.positions(raw).select("p_partkey", "reject_field", "signed_quantity")


# --- reconciliation: one book per order priority ------------------------------------------

BOOKS = f"""
b_orders AS (
  SELECT o_orderpriority AS book, 'b' || o_orderkey AS broker_id,
    CASE WHEN o_orderkey % 13 = 1 THEN 'x' ELSE 'c' END || o_orderkey AS client_order_id, o_orderkey,
    list_extract(['new', 'filled', 'canceled', 'held', 'pending_cancel', 'partially_filled', 'replaced'], CAST(o_orderkey % 7 + 1 AS INT)) AS status
  FROM orders WHERE o_orderkey % 11 <> 2),
o_orders AS (SELECT * FROM b_orders WHERE status NOT IN ('filled', 'canceled')),
known AS (
  SELECT o_orderpriority AS book, 'c' || o_orderkey AS client_order_id, CASE WHEN o_orderkey % 17 <> 4 THEN 'r' || o_orderkey END AS attempt_id,
    CASE WHEN o_orderkey % 19 = 5 THEN 'other' ELSE 'c' || o_orderkey END AS attempt_order_id, 'Brand#' || (o_orderkey % 23 + 1) AS symbol FROM orders),
decided AS (
  SELECT k.*, b.status, CASE WHEN attempt_id IS NULL THEN 'submission_attempt_record_required'
      WHEN attempt_order_id <> k.client_order_id THEN 'submission_attempt_record_mismatch'
      WHEN b.broker_id IS NULL THEN NULL WHEN status IN ('held', 'replaced') THEN 'unknown_order_state' END AS blocked,
    b.broker_id IS NULL AS missing, CASE status WHEN 'new' THEN 'working' WHEN 'filled' THEN 'filled' WHEN 'canceled' THEN 'canceled'
      WHEN 'pending_cancel' THEN 'cancel_pending' WHEN 'partially_filled' THEN 'partial' END AS state
  FROM known k LEFT JOIN b_orders b ON b.book = k.book AND b.client_order_id = k.client_order_id),
fills AS (
  SELECT DISTINCT o_orderpriority AS book, 'b' || l_orderkey AS order_id, p_brand AS symbol
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
holds AS (
  SELECT o_orderpriority AS book, p_brand || CASE WHEN l_suppkey % 9 = 0 THEN '/x' ELSE '' END AS symbol,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS BIGINT) AS signed_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
loose AS (
  SELECT h.* FROM holds h WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.book = h.book AND k.symbol = h.symbol)
    OR NOT EXISTS (SELECT 1 FROM fills f JOIN b_orders b ON b.book = f.book AND b.broker_id = f.order_id
                   JOIN known k ON k.book = b.book AND k.client_order_id = b.client_order_id
                   WHERE f.book = h.book AND f.symbol = h.symbol))"""


def books(
    spark: SparkSession, sf_dir: str, lines_twice: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Known orders, broker orders, positions and activities with gaps on every side.

    With ``lines_twice`` the joined lines are written once, as both positions and activities read them.
    """
    orders = tables.table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "book")
    k = F.col("o_orderkey")
    name = lambda tag: F.concat(F.lit(tag), k.cast("string"))
    statuses = F.array(*[F.lit(s) for s in ("new", "filled", "canceled", "held", "pending_cancel", "partially_filled", "replaced")])
    known = orders.select(
        "book", name("c").alias("client_order_id"), F.when(k % 17 != 4, name("r")).alias("attempt_id"),
        F.when(k % 19 == 5, F.lit("other")).otherwise(name("c")).alias("attempt_order_id"),
        F.array(F.concat(F.lit("Brand#"), (k % 23 + 1).cast("string"))).alias("covered_symbols"),
    )
    at_broker = orders.where(k % 11 != 2).select(
        "book", name("b").alias("broker_id"), F.when(k % 13 == 1, name("x")).otherwise(name("c")).alias("client_order_id"),
        F.element_at(statuses, (k % 7 + 1).cast("int")).alias("status"),
    )
    # Only what positions and activities read moves through the joins.
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    narrow = tables.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", signed.alias("signed"), (F.col("l_suppkey") % 9 == 0).alias("other")
    )
    lines = (
        narrow.join(orders.select("o_orderkey", "book"), F.col("l_orderkey") == k)
        .join(tables.table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    ).select("book", "l_orderkey", "p_brand", "signed", "other")
    if lines_twice:
        lines = settle(lines, "lines")
    activities = lines.select(
        "book", F.concat(F.lit("b"), F.col("l_orderkey").cast("string")).alias("order_id"), F.col("p_brand").alias("symbol")
    )
    symbol = F.concat("p_brand", F.when(F.col("other"), F.lit("/x")).otherwise(F.lit("")))
    positions = lines.groupBy("book", symbol.alias("symbol")).agg(F.sum("signed").cast("long").alias("signed_quantity"))
    return known, at_broker, positions, activities


def open_at_broker(at_broker: DataFrame) -> DataFrame:
    """The broker's list of open orders: what is neither filled nor canceled."""
    return at_broker.where("status not in ('filled', 'canceled')")


@registered(
    "submission_decisions",
    f"""WITH {BOOKS} SELECT book, client_order_id, CASE WHEN blocked IS NOT NULL THEN 'block' WHEN missing THEN 'submit' ELSE 'adopt_existing' END AS action,
      blocked AS reason, CASE WHEN blocked IS NULL AND NOT missing THEN state END AS state FROM decided""",
)
def submission_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, at_broker, _, _ = books(spark, sf_dir)
    return reconcile.submission_decisions(known, at_broker).select("book", "client_order_id", "action", "reason", "state")


@registered(
    "recovery_decisions",
    f"""WITH {BOOKS} SELECT book, client_order_id, CASE WHEN blocked IS NOT NULL OR missing THEN 'block' ELSE 'adopt_existing' END AS action,
      CASE WHEN blocked IS NULL AND missing THEN 'ambiguous_submission' ELSE blocked END AS reason,
      CASE WHEN blocked IS NULL AND NOT missing THEN state END AS state FROM decided""",
)
def recovery_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, at_broker, _, _ = books(spark, sf_dir)
    return reconcile.recovery_decisions(known, at_broker).select("book", "client_order_id", "action", "reason", "state")


@registered(
    "unexplained_orders",
    f"WITH {BOOKS} SELECT book, broker_id, client_order_id FROM b_orders WHERE client_order_id LIKE 'x%'",
)
def unexplained_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders at the broker are judged, closed ones too; the reports read the open ones."""
    known, at_broker, _, _ = books(spark, sf_dir)
    return reconcile.unexplained_orders(at_broker, known).select("book", "broker_id", "client_order_id")


@registered("unexplained_positions", f"WITH {BOOKS} SELECT book, symbol, signed_quantity FROM loose")
def unexplained_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, at_broker, positions, activities = books(spark, sf_dir, lines_twice=True)
    return reconcile.unexplained_positions(positions, known, at_broker, activities)


@registered(
    "reconciliation_report",
    f"""WITH {BOOKS}, r AS (
      SELECT book, coalesce(blocked, CASE WHEN missing THEN 'ambiguous_submission' ELSE 'order_not_reconciled' END) AS reason FROM decided
      UNION SELECT book, 'unexplained_order' FROM o_orders WHERE client_order_id LIKE 'x%' UNION SELECT book, 'unexplained_position' FROM loose)
    SELECT book, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons, 1 AS blocks_new_entries FROM r GROUP BY book""",
)
def reconciliation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, at_broker, positions, activities = books(spark, sf_dir, lines_twice=True)
    out = reconcile.report(known, at_broker, open_at_broker(at_broker), positions, activities)
    return out.select("book", joined("reasons").alias("reasons"), F.col("blocks_new_entries").cast("int").alias("blocks_new_entries"))


@registered(
    "reconciliation_without_positions",
    f"""WITH {BOOKS}, r AS (
      SELECT book, coalesce(blocked, CASE WHEN missing THEN 'ambiguous_submission' ELSE 'order_not_reconciled' END) AS reason FROM decided
      UNION SELECT book, 'unexplained_order' FROM o_orders WHERE client_order_id LIKE 'x%' UNION SELECT book, 'broker_truth_unavailable' FROM known)
    SELECT book, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM r GROUP BY book""",
)
def reconciliation_without_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot that could not be read is a reason, not an empty table."""
    known, at_broker, _, activities = books(spark, sf_dir)
    return reconcile.report(known, at_broker, open_at_broker(at_broker), None, activities).select("book", joined("reasons").alias("reasons"))


@registered(
    "flatten_report",
    f"""WITH {BOOKS}, still AS (SELECT DISTINCT h.book, h.symbol FROM holds h JOIN known k ON k.book = h.book AND k.symbol = h.symbol WHERE signed_quantity <> 0),
    r AS (SELECT book, coalesce(blocked, 'ambiguous_submission') AS reason FROM decided WHERE blocked IS NOT NULL OR missing
          UNION SELECT book, 'position_still_open' FROM still),
    n AS (SELECT book, count(*) AS still_open, min(symbol) AS first_open_symbol FROM still GROUP BY book)
    SELECT book, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons, any_value(still_open) AS still_open, any_value(first_open_symbol) AS first_open_symbol
    FROM r JOIN n USING (book) GROUP BY book""",
)
def flatten_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, at_broker, positions, _ = books(spark, sf_dir)
    out = reconcile.flatten_report(known, at_broker, positions)
    return out.select("book", joined("reasons").alias("reasons"), "still_open", "first_open_symbol")


@registered(
    "still_open_symbols",
    f"WITH {BOOKS} SELECT DISTINCT h.book, h.symbol FROM holds h JOIN known k ON k.book = h.book AND k.symbol = h.symbol WHERE signed_quantity <> 0",
)
def still_open_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per covered symbol that the positions still hold."""
    known, _, positions, _ = books(spark, sf_dir)
    return reconcile.still_open(known, positions)


# --- equity stops --------------------------------------------------------------------------

EQUITY = """
moved AS (
  SELECT user_id AS account, event_id AS seq, ts, CAST(round(value * 100) AS BIGINT) * CASE WHEN event_type IN ('error', 'view') THEN -10 ELSE 10 END AS change FROM events),
run AS (SELECT *, 10000000 + sum(change) OVER (PARTITION BY account ORDER BY seq) AS now FROM moved),
top AS (SELECT *, greatest(10000000, max(now) OVER (PARTITION BY account ORDER BY seq)) AS peak,
  first_value(now - change) OVER (PARTITION BY account, CAST(ts AS DATE) ORDER BY seq) AS start FROM run),
stops AS (SELECT *, array_to_string(list_filter([CASE WHEN (start - now) * 1000 >= start * 15 THEN 'daily_loss_stop' END,
  CASE WHEN (peak - now) * 100 >= peak * 3 THEN 'peak_to_valley_kill_switch' END], lambda x: x IS NOT NULL), ',') AS reasons FROM top)"""


@registered(
    "equity_stops",
    f"WITH {EQUITY} SELECT account, seq, CAST(start AS BIGINT) AS start_cents, CAST(peak AS BIGINT) AS peak_cents, CAST(now AS BIGINT) AS now_cents, reasons FROM stops",
)
def equity_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.equity_stops(risk.equity_readings(tables.equity(spark, sf_dir), 10_000_000))
    cents = lambda n: (F.col(n) * 100).cast("long")
    return out.select(
        "account", "seq", cents("session_start_equity").alias("start_cents"), cents("peak_equity").alias("peak_cents"),
        cents("current_equity").alias("now_cents"), joined("reasons").alias("reasons"),
    )


@registered(
    "account_metrics",
    f"""WITH {EQUITY} SELECT account, {r6_sql('max((peak - now) / peak)')} AS max_drawdown, {r6_sql('sum(abs(change)) / avg(now)')} AS turnover,
      {r6_sql('avg(CAST(now < peak AS INT))')} AS time_below_peak, count(*) AS n FROM top GROUP BY account""",
)
def account_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = tables.equity(spark, sf_dir)
    readings = risk.equity_readings(series, 10_000_000).join(
        series.select("account", "seq", (F.col("change_cents") / 100).cast("decimal(18,4)").alias("change")), ["account", "seq"]
    )
    out = metrics.account_metrics(readings)
    return out.select("account", *[r6(F.col(n)).alias(n) for n in ("max_drawdown", "turnover", "time_below_peak")], "n")


@registered(
    "position_exposure",
    f"""WITH p AS (
      SELECT o_custkey AS account, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) % 5 AS sector,
        CASE WHEN l_returnflag = 'R' THEN 'down' ELSE 'up' END AS direction, CAST(o_orderdate AS DATE) AS f, CAST(l_shipdate AS DATE) AS t,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
    g AS (SELECT account, sector, direction, sum(CASE WHEN t >= f THEN cents * (t - f) ELSE 0 END) AS held, count(*) FILTER (t >= f) AS positions,
      count(*) FILTER (t < f) AS unusable, min(f) FILTER (t >= f) AS f, max(t) FILTER (t >= f) AS t FROM p GROUP BY ALL),
    w AS (SELECT *, sum(held) OVER (PARTITION BY account) AS total, max(t) OVER (PARTITION BY account) - min(f) OVER (PARTITION BY account) AS span FROM g)
    SELECT account, CAST(sector AS BIGINT) AS sector, direction, positions, unusable, {r6_sql('CASE WHEN total <> 0 THEN held / total END')} AS share,
      CAST(round(CASE WHEN span <> 0 THEN held / span END) AS BIGINT) AS average_cents FROM w""",
)
def position_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a position of its customer, held from its order to shipping."""
    c = F.col
    lines = tables.table(spark, sf_dir, "lineitem").join(
        tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey")
    ).join(tables.table(spark, sf_dir, "part").select("p_partkey", "p_brand"), c("l_partkey") == c("p_partkey"))
    out = metrics.exposure(lines.select(
        c("o_custkey").alias("account"), (tables.brand_number(c("p_brand")) % 5).cast("long").alias("sector"),
        F.when(c("l_returnflag") == "R", "down").otherwise("up").alias("direction"),
        utc_day(c("o_orderdate")).alias("opened"), utc_day(c("l_shipdate")).alias("closed"),
        F.round(c("l_extendedprice") * 100).cast("long").alias("notional_cents"),
    ))
    return out.select(
        "account", "sector", "direction", "positions", "unusable", r6(c("share")).alias("share"),
        F.round("average_cents").cast("long").alias("average_cents"),
    )


@registered(
    "entry_blackout",
    """WITH l AS (SELECT event_id, timezone('America/New_York', ts AT TIME ZONE 'UTC') AS lt FROM events),
    m AS (SELECT *, hour(lt) * 60 + minute(lt) AS mi, dayofweek(lt) AS dw FROM l)
    SELECT CASE WHEN dw IN (0, 6) OR mi < 570 OR mi >= 960 THEN 'market_closed' WHEN mi < 580 THEN 'first_minutes' WHEN mi >= 915 THEN 'final_minutes' END AS blackout,
      CAST(strftime(lt, '%H:%M') IN ('10:00', '12:30', '15:00') AS INT) AS scheduled_scan, count(*) AS n FROM m GROUP BY ALL""",
)
def entry_blackout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("instant"))
    out = risk.entry_blackout(rows)
    return out.groupBy("blackout", F.col("scheduled_scan").cast("int").alias("scheduled_scan")).agg(F.count("*").alias("n"))


# --- replay and ledger ----------------------------------------------------------------------

def _replay_sql(edges: dict, events: str, initial: str) -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, targets in edges.items() for b in targets)
    return f"""
edges(a, b) AS (VALUES {pairs}),
ev AS ({events}),
num AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY seq) AS i FROM ev),
walk AS (
  SELECT n.subject_id, n.seq, n.i, n.event, '{initial}' AS before,
    ('{initial}', n.event) IN (SELECT (a, b) FROM edges) AS legal FROM num n WHERE i = 1
  UNION ALL
  SELECT n.subject_id, n.seq, n.i, n.event, CASE WHEN w.legal THEN w.event ELSE w.before END,
    (CASE WHEN w.legal THEN w.event ELSE w.before END, n.event) IN (SELECT (a, b) FROM edges)
  FROM walk w JOIN num n ON n.subject_id = w.subject_id AND n.i = w.i + 1)"""


_ORDER_EVENTS = """SELECT CAST(user_id AS VARCHAR) AS subject_id, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'submitted' ELSE
  list_extract(['submitted', 'working', 'partial', 'filled', 'cancel_pending', 'canceled', 'closing', 'reconciled'], CAST((event_id * 7 + user_id) % 8 + 1 AS INT)) END AS event FROM events"""


@registered(
    "order_transition_audit",
    f"WITH RECURSIVE {_replay_sql(fixed.ORDER_EDGES, _ORDER_EVENTS, 'proposed')} SELECT subject_id, seq, event, before, CAST(legal AS INT) AS legal FROM walk",
)
def order_transition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lifecycle.replay(tables.order_events(spark, sf_dir), fixed.ORDER_STATES, fixed.ORDER_EDGES, "proposed")
    return out.select("subject_id", "seq", "event", "before", F.col("legal").cast("int").alias("legal"))


_SESSION_EVENTS = f"""SELECT CAST(user_id AS VARCHAR) AS subject_id, event_id AS seq,
  list_extract({list(fixed.SESSION_STATES)}, CAST((event_id * 5 + user_id) % 7 + 1 AS INT)) AS event FROM events"""


@registered(
    "session_illegal_steps",
    f"""WITH RECURSIVE {_replay_sql(fixed.SESSION_EDGES, _SESSION_EVENTS, 'disarmed')}
    SELECT before, event, CAST(before = 'ready' AS INT) AS permits_new_entry, count(*) AS n FROM walk WHERE NOT legal GROUP BY ALL""",
)
def session_illegal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    pick = F.element_at(F.array(*[F.lit(s) for s in fixed.SESSION_STATES]), ((i * 5 + F.col("user_id")) % 7 + 1).cast("int"))
    events = tables.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("subject_id"), i.alias("seq"), pick.alias("event"))
    out = lifecycle.replay(events, fixed.SESSION_STATES, fixed.SESSION_EDGES, "disarmed")
    bad = lifecycle.permits_new_entry(lifecycle.illegal_steps(out), "before")
    return bad.groupBy("before", "event", F.col("permits_new_entry").cast("int").alias("permits_new_entry")).agg(F.count("*").alias("n"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.order_events(spark, sf_dir).select("subject_id", "seq", F.col("event").alias("state"), "recorded_at")


@registered(
    "coalesced_order_states",
    f"""WITH ev AS ({_ORDER_EVENTS}), p AS (SELECT *, lag(event) OVER (PARTITION BY subject_id ORDER BY seq) AS b FROM ev)
    SELECT subject_id, seq, event AS state FROM p WHERE b IS NULL OR b <> event""",
)
def coalesced_order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.coalesced_states(_states(spark, sf_dir)).select("subject_id", "seq", "state")


@registered(
    "latest_order_state",
    f"WITH ev AS ({_ORDER_EVENTS}) SELECT subject_id, arg_max(event, seq) AS state, max(seq) AS seq, count(*) AS entries FROM ev GROUP BY subject_id",
)
def latest_order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_state(_states(spark, sf_dir))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return tables.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("subject_id"),
        F.when(i % 50 == 7, F.lit("order_state")).otherwise(F.col("event_type")).alias("kind"),
        F.when(i % 60 == 8, F.create_map().cast("map<string,string>")).otherwise(
            F.create_map(F.lit("z"), (i % 3).cast("string"), F.lit("a"), F.lit("1"))
        ).alias("payload"),
        utc_floor(F.col("ts"), "day").alias("recorded_at"), i.alias("seq"),
    )


@registered(
    "recorded_decisions",
    f"""SELECT sha256('{{"kind":"' || event_type || '","payload":{{"a":"1","z":"' || (event_id % 3) || '"}},"recorded_at":"'
        || strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00","subject_id":"' || user_id || '"}}') AS entry_id,
      min(event_id) AS seq FROM events WHERE event_id % 50 <> 7 AND event_id % 60 <> 8 GROUP BY 1
    HAVING entry_id NOT IN (SELECT sha256('{{"kind":"' || event_type || '","payload":{{"a":"1","z":"' || (event_id % 3) || '"}},"recorded_at":"'
        || strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00","subject_id":"' || user_id || '"}}') FROM events
        WHERE event_id % 50 <> 7 AND event_id % 60 <> 8 AND event_id % 3 = 0)""",
)
def recorded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to append once every third event is in the log."""
    raw = _decisions(spark, sf_dir)
    none = spark.createDataFrame([], "entry_id string")
    stored = settle(ledger.new_decisions(none, raw.where("seq % 3 = 0")), "ledger")
    return ledger.new_decisions(stored, raw).select("entry_id", "seq")


@registered(
    "submission_attempt_conflicts",
    """WITH a AS (SELECT 'c' || (o_orderkey // 3) AS subject_id, o_orderstatus AS p FROM orders)
    SELECT subject_id, count(*) AS attempts FROM a GROUP BY subject_id HAVING count(DISTINCT p) > 1""",
)
def submission_attempt_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.col("o_orderkey") / 3).cast("string")
    attempts = tables.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), k).alias("subject_id"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("payload")
    )
    return ledger.attempt_conflicts(attempts)


@registered(
    "new_submission_attempts",
    """SELECT 'c' || (o_orderkey // 3) AS subject_id, min(o_orderkey) AS seq FROM orders GROUP BY 1 HAVING min(o_orderkey // 3 % 3) > 0""",
)
def new_submission_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries with an unchanged payload against a log that holds every third id."""
    k = F.col("o_orderkey")
    raw = tables.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.floor(k / 3).cast("string")).alias("subject_id"),
        F.create_map(F.lit("plan"), F.floor(k / 3).cast("string")).alias("payload"), k.alias("seq"),
    )
    stored = raw.where(F.floor(k / 3) % 3 == 0).groupBy("subject_id").agg(F.min("seq").alias("seq"), F.any_value("payload").alias("payload"))
    return ledger.new_attempts(stored, raw).select("subject_id", "seq")


# --- streams --------------------------------------------------------------------------------

@registered(
    "money_at_four_places",
    """WITH a AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 7919 + l_partkey * 50) % 1000000 AS rest FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_orderkey * 10000 + rest // 100
      + CASE WHEN rest % 100 > 50 OR (rest % 100 = 50 AND (l_orderkey * 10000 + rest // 100) % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) END AS ticks FROM a""",
)
def money_at_four_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with six decimals as text, some unreadable, as exact money in ticks."""
    rest = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 50) % 1_000_000
    text = F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.lpad(rest.cast("string"), 6, "0"))
    )
    return tables.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", ticks(money(text)).alias("ticks")
    )


def _stream(spark: SparkSession, *parts: DataFrame) -> DataFrame:
    """Tables as a file stream in the shared folder; several tables arrive one by one."""
    path = work_path(spark, "stream")
    for part in parts:
        (part if len(parts) == 1 else part.coalesce(1)).write.mode("append").parquet(path)
    reader = spark.readStream.schema(parts[0].schema)
    return (reader if len(parts) == 1 else reader.option("maxFilesPerTrigger", 1)).parquet(path)


def _folder(spark: SparkSession, name: str) -> str:
    return work_path(spark, name)


@registered("stream_recorded_observations", f"WITH {OBSERVED} SELECT DISTINCT observation_id, feed FROM addressed")
def stream_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, rejects, check = (_folder(spark, n) for n in ("store", "rejects", "progress"))
    raw = _stream(spark, tables.observations(spark, sf_dir))
    jobs.record_stream(raw, tables.feed_policies(spark), store, rejects, check).awaitTermination()
    return observations.stored(spark, store).select("observation_id", "feed")


@registered("stream_deduplicated_observations", f"WITH {OBSERVED} SELECT DISTINCT observation_id FROM addressed")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is sent twice over several triggers, days late; each content comes out once."""
    out, check = _folder(spark, "unique"), _folder(spark, "progress")
    seen = tables.observations(spark, sf_dir)
    raw = _stream(spark, seen, seen.where("day(received_time) % 2 = 0"), seen.where("day(received_time) % 2 = 1"))
    jobs.deduplicate_stream(raw, tables.feed_policies(spark), out, check).awaitTermination()
    return observations.stored(spark, out).select("observation_id")


# Rows of one of these streams come within four triggers of their place, a minute a trigger.
HOLD = "5 minutes"


def _shuffled_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows dealt to four triggers by a digest of ``seq``, and a last row that only moves the clock."""
    opened = F.lit("2024-01-02T00:00:00Z").cast("timestamp")
    sent = lambda minutes, part: part.withColumn("arrived", opened + F.make_dt_interval(mins=F.lit(minutes)))
    drawn = F.pmod(F.xxhash64("seq"), F.lit(4))
    close = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    return _stream(spark, *[sent(i, rows.where(drawn == i)) for i in range(4)], sent(60, close))


def _state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, check = _folder(spark, "log"), _folder(spark, "progress")
    states = _shuffled_stream(spark, _states(spark, sf_dir))
    jobs.to_table(jobs.state_log(states, HOLD), out, check).awaitTermination()
    return spark.read.parquet(out)


@registered("stream_coalesced_states", ORACLES["coalesced_order_states"])
def stream_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_stream(spark, sf_dir).where("changed").select("subject_id", "seq", "state")


@registered("stream_latest_state", ORACLES["latest_order_state"])
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _state_stream(spark, sf_dir).where("not disorder")
    last = F.max_by(F.struct("state", "seq", "entries"), "seq").alias("l")
    return log.groupBy("subject_id").agg(last).select("subject_id", "l.*")


@registered(
    "stream_transition_audit",
    f"WITH RECURSIVE {_replay_sql(fixed.ORDER_EDGES, _ORDER_EVENTS, 'proposed')} SELECT subject_id, seq, before, CAST(legal AS INT) AS legal FROM walk",
)
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, check = _folder(spark, "audit"), _folder(spark, "progress")
    events = _shuffled_stream(spark, tables.order_events(spark, sf_dir))
    jobs.to_table(jobs.audited_transitions(events, hold=HOLD), out, check).awaitTermination()
    return spark.read.parquet(out).select("subject_id", "seq", "before", F.col("legal").cast("int").alias("legal"))


@registered(
    "stream_equity_stops",
    f"WITH {EQUITY} SELECT account, seq, CAST(start AS BIGINT) AS start_cents, CAST(peak AS BIGINT) AS peak_cents, CAST(now AS BIGINT) AS current_cents, reasons FROM stops WHERE reasons <> ''",
)
def stream_equity_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, check = _folder(spark, "stops"), _folder(spark, "progress")
    changes = _shuffled_stream(spark, tables.equity(spark, sf_dir))
    jobs.to_table(jobs.equity_stop_monitor(changes, 10_000_000, hold=HOLD), out, check).awaitTermination()
    return spark.read.parquet(out).select("account", "seq", "start_cents", "peak_cents", "current_cents", joined("reasons").alias("reasons"))
