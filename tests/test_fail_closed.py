"""Missing, NaN and non-positive inputs never pass a gate; unreadable input is refused."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import guards
from tidemark.operators import gates, reconcile, risk, universe
from tidemark.sources import broker, jsonl
from tidemark.streaming import jobs

NOW = datetime(2024, 1, 2, 15)
LEGS = [("buy", 1), ("sell", 1)]


def screen(spark, loss="40", price="1", bound="1", quantity=1, legs=LEGS, equity="100000", count=0, cfg="c"):
    number = lambda x: None if x is None else Decimal(x)
    plans = spark.createDataFrame(
        [("p", "a", quantity, number(price), number(bound), number(loss), legs)],
        "plan_id string, account string, quantity int, limit_price decimal(18,4), entry_limit_bound decimal(18,4),"
        "exact_max_loss decimal(18,4), legs array<struct<side:string,ratio_qty:int>>",
    )
    snaps = spark.createDataFrame(
        [("a", number(equity), count, cfg, NOW)],
        "account string, equity decimal(18,4), open_position_count int, frozen_config_hash string, snapshot_time timestamp",
    )
    return risk.screen_plans(plans, snaps, risk.RiskConfig(), "c", "standard", F.lit(NOW)).first()


def test_a_complete_plan_passes(spark):
    row = screen(spark)
    assert row.approved and row.approved_quantity == 3


@pytest.mark.parametrize(
    "change, gate",
    [
        ({"loss": None}, "exact_max_loss_not_positive"), ({"loss": "0"}, "exact_max_loss_not_positive"),
        ({"loss": "-1"}, "exact_max_loss_not_positive"), ({"price": None}, "limit_price_not_positive"),
        ({"bound": None}, "entry_limit_bound_not_positive"), ({"quantity": None}, "quantity_not_positive"),
        ({"legs": None}, "legs_missing"), ({"legs": []}, "legs_missing"), ({"equity": None}, "equity_not_positive"),
        ({"equity": "0"}, "equity_not_positive"), ({"count": None}, "open_position_count_missing"),
        ({"cfg": None}, "config_hash_missing"),
    ],
)
def test_risk_gate_names_what_is_missing(spark, change, gate):
    row = screen(spark, **change)
    assert not row.approved and gate in row.failed_gates
    if "loss" in change or "equity" in change:
        assert row.approved_quantity == 0


def test_equity_stops_name_bad_divisors(spark):
    schema = "session_start_equity decimal(18,4), peak_equity decimal(18,4), current_equity decimal(18,4)"
    d = Decimal
    rows = [(d(0), d(10), d(10)), (d(10), None, d(10)), (d(10), d(10), None), (d(10), d(10), d(10))]
    got = [r.reasons for r in risk.equity_stops(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert "session_start_equity_not_positive" in got[0] and got[1] == ["peak_equity_not_positive"]
    assert got[2] == ["current_equity_missing"] and got[3] == []


@pytest.mark.parametrize("field", ["p_up", "expected_residual_return", "calibration_error", "effective_sample_size"])
@pytest.mark.parametrize("value", [None, float("nan")])
def test_eligibility_names_missing_and_nan(spark, field, value):
    good = dict(p_up=0.61, expected_residual_return=0.03, q10=-0.05, q90=0.11, calibration_error=0.02,
                effective_sample_size=250.0, a=0.6, b=0.4)
    schema = ", ".join(f"{n} double" for n in good)
    decide = lambda row: gates.decide(spark.createDataFrame([tuple(row.values())], schema), ["a", "b"]).first()
    assert decide(good).eligible
    row = decide({**good, field: value})
    assert not row.eligible and f"missing_{field}" in row.rejection_reasons


def test_universe_fails_on_missing_facts(spark):
    names = ("options_enabled", "near_money_quotes_7_to_21_dte", "active", "tradable", "unresolved_corporate_action")
    schema = "symbol string, prior_close decimal(18,4), median_dollar_volume decimal(18,4), " + ", ".join(
        f"{n} boolean" for n in names
    )
    row = spark.createDataFrame([("X", *[None] * 7)], schema)
    reasons = universe.screened(row, universe.Floors()).first().reasons
    assert len(reasons) == 7


def test_an_attempt_without_order_id_is_a_mismatch(spark):
    attempts = spark.createDataFrame([("b", "c1", "t", None)], "book string, client_order_id string, attempt_id string, attempt_order_id string")
    assert reconcile.submission_decisions(attempts, None).first().reason == "submission_attempt_record_mismatch"


@pytest.mark.parametrize("line", ['{"a":"oops","b":1}', '{"a":1}'])
def test_mistyped_or_absent_json_fields_stop_the_job(spark, line):
    schema = spark.createDataFrame([], "a long, b long").schema
    lines = spark.createDataFrame([(line,), ('{"a":1,"b":2}',)], "value string")
    with pytest.raises((guards.IntegrityError, Exception)) as caught:
        jsonl.parse_strict(lines, schema).collect()
    assert "missing_field" in str(caught.value) or "MALFORMED" in str(caught.value).upper()


def test_broker_numbers_are_never_rounded(spark):
    time = "2024-01-02T15:00:00Z"
    raw = lambda qty: '{"status":"new","id":"1","client_order_id":"c","filled_qty":"%s","created_at":"%s","updated_at":null,"submitted_at":null,"filled_at":null}' % (qty, time)
    rows = spark.createDataFrame([(raw(q),) for q in ("1.12345678", "1.123456780", "1.123456789", "1" * 30)], "raw string")
    assert [r.reject_field for r in broker.orders(rows.coalesce(1)).collect()] == [None, None, "filled_qty", "filled_qty"]


def test_stream_state_log_names_disorder_across_triggers(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "subject_id string, seq long, state string"
    for rows in ([("s", 1, "a"), ("s", 2, "a"), ("s", 4, "b")], [("s", 3, "c"), ("s", 5, "b"), ("s", 6, "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.to_table(jobs.state_log(stream), out, check).awaitTermination()
    log = spark.read.parquet(out)
    assert sorted(r.seq for r in log.where("changed").collect()) == [1, 4, 6]
    assert [r.seq for r in log.where("disorder").collect()] == [3]
    assert log.where("not disorder").orderBy(F.desc("seq")).first().entries == 5
