import uuid
from datetime import datetime, timedelta
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs, fixed, guards
from tidemark.operators import ledger, lifecycle, reconcile, risk, universe
from tidemark.sources import jsonl, observations
from tidemark.streaming import jobs

T = datetime(2026, 6, 1, 12)
RAW = (
    "feed string, subject_id string, event_time timestamp, source_time timestamp, received_time timestamp, "
    "as_of timestamp, payload map<string,string>, first_seen_time timestamp"
)


def policies(spark, rows=None):
    return spark.createDataFrame(
        rows or [("iex_bars", True, 0, False), ("news", False, 60, False), ("calendar", True, 0, True)],
        "feed string, proves_delivery_time boolean, lag_seconds long, event_time_may_follow_first_seen boolean",
    )


def raw(feed="iex_bars", subject="AAPL", event=0, source=0, received=1, as_of=100, payload={"p": "1"}, seen=2):
    at = lambda s: None if s is None else T + timedelta(seconds=s)
    return (feed, subject, at(event), at(source), at(received), at(as_of), payload, at(seen))


def judged(spark, *rows):
    return observations.judged_observations(spark.createDataFrame(list(rows), RAW), policies(spark))


@pytest.mark.parametrize("change, field", [
    ({}, None), ({"feed": "nope"}, "feed"), ({"feed": " "}, "feed"), ({"subject": " "}, "subject_id"), ({"payload": {}}, "payload"),
    ({"seen": None}, "first_seen_time"), ({"feed": "news"}, "first_seen_time"), ({"feed": "news", "seen": None}, None),
    ({"seen": -1}, "first_seen_time"), ({"received": -1}, "received_time"), ({"seen": 0}, "first_seen_time"),
    ({"as_of": 1}, "first_seen_time"), ({"event": 50}, "event_time"), ({"feed": "calendar", "event": 50}, None),
])
def test_first_failing_field(spark, change, field):
    assert judged(spark, raw(**change)).first().reject_field == field


def test_unproven_feed_gets_its_lag(spark):
    row = judged(spark, raw("news", seen=None)).first()
    assert row.first_seen_time == T + timedelta(seconds=60) and row.availability_lag_seconds == 60
    assert row.quality_flags == ["availability_lag_applied"]


@pytest.mark.parametrize("rows", [
    [("a", True, 5, False)], [("a", False, 0, False)], [("a", True, 0, False), ("a", True, 0, False)], [(" ", True, 0, False)],
])
def test_policies_are_checked(spark, rows):
    with pytest.raises(guards.IntegrityError):
        observations.checked_policies(policies(spark, rows))


def test_recording_twice_changes_nothing_and_revisions_stay(spark, tmp_path):
    store = str(tmp_path / "store")
    observations.record(judged(spark, raw(), raw(), raw(payload={"p": "2"})), store)
    assert observations.stored(spark, store).count() == 2
    observations.record(judged(spark, raw()), store)
    held = observations.stored(spark, store)
    assert held.count() == 2
    at = lambda s: F.lit(T + timedelta(seconds=s))
    assert observations.read_as_of(held, at(2)).count() == 2
    assert observations.read_as_of(held, at(1)).count() == 0
    assert observations.read_as_of(held, at(9), feed="news", policies=policies(spark)).count() == 0
    with pytest.raises(observations.Rejected):
        observations.read_as_of(held, at(9), feed="typo", policies=policies(spark))


def test_payload_order_does_not_change_the_address(spark):
    one = judged(spark, raw(payload={"a": "1", "b": "2"})).first().observation_id
    assert one == judged(spark, raw(payload={"b": "2", "a": "1"})).first().observation_id


def test_strict_lines(spark, tmp_path):
    schema = spark.createDataFrame([], "a int").schema
    assert jsonl.read_strict(spark, str(tmp_path / "none"), schema).count() == 0
    for line in ("", "{", "[1]", "3"):
        lines = spark.createDataFrame([('{"a":1}',), (line,)], "value string")
        with pytest.raises(guards.IntegrityError):
            jsonl.parse_strict(lines, schema)
    assert jsonl.parse_strict(spark.createDataFrame([('{"a":1}',)], "value string"), schema).first().a == 1


def walk(edges, initial, events):
    at, out = initial, []
    for e in events:
        ok = e in edges.get(at, ())
        out.append((at, ok))
        at = e if ok else at
    return out


@pytest.mark.parametrize("states, edges, initial", [
    (fixed.ORDER_STATES, fixed.ORDER_EDGES, "proposed"), (fixed.SESSION_STATES, fixed.SESSION_EDGES, "disarmed"),
])
def test_replay_over_several_levels_of_blocks(spark, monkeypatch, states, edges, initial):
    monkeypatch.setattr(lifecycle, "BLOCK", 3)
    names = {s: [states[(i * 7 + i // 3 + len(s)) % len(states)] for i in range(n)] for s, n in (("a", 90), ("bb", 1), ("ccc", 10))}
    rows = [(s, i, e) for s, events in names.items() for i, e in enumerate(events)]
    got = lifecycle.replay(spark.createDataFrame(rows, "subject_id string, seq long, event string").repartition(4), states, edges, initial)
    found = {(r.subject_id, r.seq): (r.before, r.legal) for r in got.collect()}
    assert found == {(s, i): w for s, events in names.items() for i, w in enumerate(walk(edges, initial, events))}


def test_edge_counts():
    assert sum(map(len, fixed.ORDER_EDGES.values())) == 26
    assert sum(map(len, fixed.SESSION_EDGES.values())) == 17


def test_states_coalesce_by_append_order(spark):
    rows = [("c", 1, "submitted"), ("c", 2, "submitted"), ("c", 3, "working"), ("c", 4, "submitted")]
    df = spark.createDataFrame(rows, "subject_id string, seq long, state string")
    assert [r.seq for r in ledger.coalesced_states(df).orderBy("seq").collect()] == [1, 3, 4]
    assert ledger.latest_state(df).first().state == "submitted"


def test_attempts(spark):
    schema = "subject_id string, payload map<string,string>, seq long"
    stored = spark.createDataFrame([("c1", {"a": "1"}, 0)], schema)
    again = spark.createDataFrame([("c1", {"a": "1"}, 5), ("c2", {"a": "1"}, 6)], schema)
    assert [r.subject_id for r in ledger.new_attempts(stored, again).collect()] == ["c2"]
    with pytest.raises(guards.IntegrityError):
        ledger.new_attempts(stored, spark.createDataFrame([("c1", {"a": "2"}, 5)], schema))
    with pytest.raises(guards.IntegrityError):
        ledger.new_attempts(stored.union(stored), again)


def test_trials(spark):
    schema = "configuration map<string,string>, purpose string, registered_at timestamp"
    rows = [({"a": "1"}, "p", T), ({"a": "1"}, "p", T), ({"a": "1"}, "p", T + timedelta(days=1))]
    none = spark.createDataFrame([], "trial_id string")
    made = ledger.new_trials(none, spark.createDataFrame(rows, schema)).cache()
    assert made.count() == 2
    results = made.select("trial_id", F.lit("x").alias("result"))
    assert ledger.trial_history(made, results).where("result is not null").count() == 2
    with pytest.raises(guards.IntegrityError):
        ledger.trial_history(made.limit(1), results)
    with pytest.raises(guards.IntegrityError):
        ledger.new_results(made, results, results)


def test_missing_snapshot_is_a_reason_and_never_explains_a_position(spark):
    known = spark.createDataFrame(
        [("b", "c1", "r1", "c1", ["X"])],
        "book string, client_order_id string, attempt_id string, attempt_order_id string, covered_symbols array<string>",
    )
    orders = spark.createDataFrame([("b", "o1", "c1", "filled")], "book string, broker_id string, client_order_id string, status string")
    held = spark.createDataFrame([("b", "X", 1)], "book string, symbol string, signed_quantity long")
    fills = spark.createDataFrame([("b", "o1", "X")], "book string, order_id string, symbol string")
    reasons = lambda *a: reconcile.report(known, *a).first().reasons
    none, stray = orders.limit(0), orders.withColumns({"client_order_id": F.lit("who"), "status": F.lit("new")})
    assert reasons(orders, none, held, fills) == ["order_not_reconciled"]
    assert reasons(orders, none, held, fills.limit(0)) == ["order_not_reconciled", "unexplained_position"]
    assert reasons(orders, none, held, None) == ["broker_truth_unavailable", "order_not_reconciled"]
    assert reasons(None, none, held, fills) == ["broker_truth_unavailable"]
    # A closed order nobody knows is in the lookup alone; an open one is in the snapshot.
    lookup = orders.unionByName(stray.withColumn("status", F.lit("filled")))
    assert reasons(lookup, none, held, fills) == ["order_not_reconciled"]
    assert reasons(lookup, stray, held, fills) == ["order_not_reconciled", "unexplained_order"]
    assert reasons(orders, None, held, fills) == ["broker_truth_unavailable", "order_not_reconciled"]
    assert [r.symbol for r in reconcile.still_open(known, held).collect()] == ["X"]
    assert reconcile.still_open(known, held.withColumn("signed_quantity", F.lit(0))).isEmpty()
    assert reconcile.still_open(known, None).count() == 1
    assert reconcile.recovery_decisions(known, orders.limit(0)).first().reason == "ambiguous_submission"
    assert reconcile.submission_decisions(known, orders.limit(0)).first().action == "submit"


def test_stream_audit_keeps_state_between_batches(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "subject_id string, seq long, event string"
    for part in ([("s", 1, "submitted"), ("s", 2, "reconciled")], [("s", 3, "filled"), ("s", 4, "working")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        events = spark.readStream.schema(schema).parquet(source)
        jobs.to_table(jobs.audited_transitions(events), out, check).awaitTermination()
    rows = spark.read.parquet(out).orderBy("seq").collect()
    assert [(r.before, r.legal) for r in rows] == [("proposed", True), ("submitted", False), ("submitted", True), ("filled", False)]


def test_universe_boundaries_and_tie(spark):
    from decimal import Decimal as D

    def fact(symbol, mdv="10000000", close="10", seen=T, **change):
        row = dict(feed="f", first_seen_time=seen, active=True, tradable=True, options_enabled=True, prior_close=D(close),
                   median_dollar_volume=D(mdv), near=True, action=False)
        row.update(change)
        return (symbol, *row.values())

    schema = ("symbol string, feed string, first_seen_time timestamp, active boolean, tradable boolean, options_enabled boolean, "
              "prior_close decimal(18,4), median_dollar_volume decimal(36,4), near_money_quotes_7_to_21_dte boolean, unresolved_corporate_action boolean")
    rows = [fact("A"), fact("B"), fact("C", close="9.9999", active=False), fact("D", mdv="20000000")]
    spine = spark.createDataFrame([(s, T) for s in "ABCD"], "symbol string, as_of timestamp")
    floors = universe.Floors(max_symbols=2)
    judged = universe.screened(universe.latest_as_of(spine, spark.createDataFrame(rows, schema)), floors)
    chosen = universe.members(judged, floors)
    assert [r.symbol for r in chosen.orderBy("rank").collect()] == ["D", "A"]
    got = {r.symbol: r.reasons for r in universe.exclusions(judged, chosen).collect()}
    assert got == {"B": ["outside_cap"], "C": ["inactive", "below_price_floor"]}
    with pytest.raises(guards.AmbiguityError):
        universe.latest_as_of(spine, spark.createDataFrame([fact("A"), fact("A", close="11")], schema))


NEW_YORK = "America/New_York"


@pytest.fixture
def elsewhere(spark):
    """A session whose zone is not UTC."""
    spark.conf.set("spark.sql.session.timeZone", NEW_YORK)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def instants(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp").alias("t"))


def test_utc_arithmetic_does_not_ask_the_session(elsewhere):
    # Both sides of the hour New York skips, the hour it repeats, and one before 1970.
    texts = ["2024-03-10T06:30:00Z", "2024-03-10T07:30:00.25Z", "2024-11-03T05:30:00Z", "2024-11-03T06:30:00Z", "1969-12-31T23:59:59.000001Z"]
    rows = instants(elsewhere, *texts).select(
        exprs.iso_utc(F.col("t")).alias("iso"), exprs.utc_day(F.col("t")).cast("string").alias("day"),
        *[exprs.utc_text(exprs.utc_floor(F.col("t"), unit)).alias(unit) for unit in ("hour", "day", "week", "month")],
    ).collect()
    assert [r.iso for r in rows] == [
        "2024-03-10T06:30:00+00:00", "2024-03-10T07:30:00.250000+00:00", "2024-11-03T05:30:00+00:00",
        "2024-11-03T06:30:00+00:00", "1969-12-31T23:59:59.000001+00:00",
    ]
    assert [r.day for r in rows] == ["2024-03-10", "2024-03-10", "2024-11-03", "2024-11-03", "1969-12-31"]
    assert tuple(rows[1])[2:] == ("2024-03-10 07:00:00", "2024-03-10 00:00:00", "2024-03-04 00:00:00", "2024-03-01 00:00:00")
    assert tuple(rows[4])[2:] == ("1969-12-31 23:00:00", "1969-12-31 00:00:00", "1969-12-29 00:00:00", "1969-12-01 00:00:00")


def test_a_store_reads_the_same_in_every_zone(spark, tmp_path):
    """A row seen at 01:00 UTC is found at 02:00 UTC, is stored once, and keeps a feed named 007."""
    at = lambda t: F.lit(t).cast("timestamp")
    policies = spark.createDataFrame([("007", True, 0, False)], "feed string, proves_delivery_time boolean, lag_seconds long, event_time_may_follow_first_seen boolean")
    path, seen = str(tmp_path / "store"), set()
    try:
        for zone in ("UTC", NEW_YORK, "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            raw = spark.range(1).select(
                F.lit("007").alias("feed"), F.lit("s").alias("subject_id"), at("2024-06-02T00:30:00Z").alias("event_time"),
                at("2024-06-02T01:00:00Z").alias("first_seen_time"), at("2024-06-02T00:40:00Z").alias("source_time"),
                at("2024-06-02T00:50:00Z").alias("received_time"), at("2024-06-02T02:00:00Z").alias("as_of"),
                F.create_map(F.lit("k"), F.lit("v")).alias("payload"),
            )
            observations.record(observations.judged_observations(raw, policies), path)
            store = observations.stored(spark, path)
            found = observations.read_as_of(store, at("2024-06-02T02:00:00Z"), feed="007").collect()
            assert len(found) == 1 and found[0].feed == "007" and store.count() == 1
            seen.add((found[0].observation_id, str(found[0].seen_on)))
            assert observations.read_as_of(store, at("2024-06-02T00:59:59Z"), feed="007").isEmpty()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(seen) == 1


def test_blackout_is_local_to_the_market_in_every_zone(elsewhere):
    texts = ["2024-07-01T13:35:00Z", "2024-07-01T14:00:00Z", "2024-12-02T14:35:00Z", "2024-07-01T19:20:00Z", "2024-07-06T15:00:00Z"]
    rows = risk.entry_blackout(instants(elsewhere, *texts).withColumnRenamed("t", "instant")).collect()
    assert [(r.blackout, r.scheduled_scan) for r in rows] == [
        ("first_minutes", False), (None, True), ("first_minutes", False), ("final_minutes", False), ("market_closed", False),
    ]


def test_snapshots_of_one_instant_must_agree(spark):
    schema = "account string, equity decimal(18,4), open_position_count int, frozen_config_hash string, snapshot_time timestamp"
    now = datetime(2024, 1, 2)
    rows = [("a", Decimal(1), 1, "h", now), ("a", Decimal(1), 1, "h", now), ("a", Decimal(9), 1, "h", datetime(2024, 1, 1))]
    assert risk.latest_snapshots(spark.createDataFrame(rows, schema)).collect()[0].equity == 1
    with pytest.raises(guards.AmbiguityError):
        risk.latest_snapshots(spark.createDataFrame([*rows, ("a", Decimal(2), 1, "h", now)], schema))


def test_a_missing_payload_conflicts_with_a_given_one(spark):
    rows = [("s", None), ("s", {"a": "1"}), ("t", None), ("t", None)]
    df = spark.createDataFrame(rows, "subject_id string, payload map<string,string>")
    assert [r.subject_id for r in ledger.attempt_conflicts(df).collect()] == ["s"]


def test_stop_monitor_names_disorder(spark, tmp_path):
    """A row of an earlier day in a later trigger changes neither the day nor its start."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "account long, seq long, as_of timestamp, change_cents long"
    day = lambda d: datetime(2024, 1, d, 12)
    for part in ([(1, 1, day(2), 100), (1, 3, day(3), -100_000)], [(1, 2, day(2), 50)], [(1, 4, day(3), -100_000)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        rows = spark.readStream.schema(schema).parquet(source)
        jobs.to_table(jobs.equity_stop_monitor(rows, 10_000_000), out, check).awaitTermination()
    got = [(r.seq, r.start_cents, r.current_cents, r.reasons) for r in spark.read.parquet(out).orderBy("seq").collect()]
    assert got == [(2, 10_000_100, 9_900_100, ["disorder"]), (4, 10_000_100, 9_800_100, ["daily_loss_stop"])]


def test_streams_put_rows_in_place_within_the_hold(spark, tmp_path):
    """Rows come shuffled over triggers; the one that comes after its place has passed is named."""
    from pyspark.sql import functions as F

    def run(name, schema, parts, build):
        source, out, check = (str(tmp_path / f"{name}-{n}") for n in ("in", "out", "check"))
        for minute, rows in parts:
            part = spark.createDataFrame(rows, schema)
            moment = F.lit(f"2024-01-02T00:{minute:02d}:00Z").cast("timestamp")
            part.withColumn("arrived", moment).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(f"{schema}, arrived timestamp").parquet(source)
            jobs.to_table(build(stream), out, check).awaitTermination()
        return spark.read.parquet(out)

    spark.conf.unset(jobs.STATE_STORE)
    key = "subject_id string, seq long"
    clock = (None, None, None)
    parts = [
        (0, [("s", 4, "filled"), ("s", 2, "working"), ("t", 1, "submitted")]),
        (3, [("s", 1, "submitted"), ("s", 4, "filled")]),
        (20, [clock]), (21, [("s", 3, "working"), ("s", 5, "reconciled")]), (50, [clock]),
    ]
    log = run("log", f"{key}, state string", parts, lambda s: jobs.state_log(s, "5 minutes"))
    assert sorted((r.subject_id, r.seq) for r in log.where("changed").collect()) == [
        ("s", 1), ("s", 2), ("s", 4), ("s", 5), ("t", 1)]
    assert sorted(r.seq for r in log.where("disorder").collect()) == [3, 4]
    assert log.where("subject_id = 's' and not disorder").orderBy(F.desc("seq")).first().entries == 4

    audit = run("audit", f"{key}, event string", parts, lambda s: jobs.audited_transitions(s, hold="5 minutes"))
    rows = audit.where("subject_id = 's' and not disorder").orderBy("seq").collect()
    assert [(r.seq, r.before, r.legal) for r in rows] == [
        (1, "proposed", True), (2, "submitted", True), (4, "working", True), (5, "filled", True)]
    assert sorted(r.seq for r in audit.where("disorder").collect()) == [3, 4]

    day = lambda n: T.replace(day=n)
    stops = run(
        "stops", "account long, seq long, as_of timestamp, change_cents long",
        [(0, [(1, 3, day(3), -200)]), (2, [(1, 1, day(2), -100), (1, 2, day(2), -100)]), (20, [clock + (None,)]),
         (21, [(1, 2, day(2), -9000)]), (40, [clock + (None,)])],
        lambda s: jobs.equity_stop_monitor(s, 10_000, hold="5 minutes"),
    )
    got = {(r.seq, r.current_cents, tuple(r.reasons)) for r in stops.collect()}
    assert got == {(2, 9800, ("daily_loss_stop",)), (3, 9600, ("daily_loss_stop", "peak_to_valley_kill_switch")), (2, 9600, ("disorder",))}
    assert spark.conf.get(jobs.STATE_STORE, None) is None or "RocksDB" not in spark.conf.get(jobs.STATE_STORE)


def test_state_calls_follow_buckets_not_subjects():
    """A trigger of many subjects makes as many calls to the state store as one of few."""

    class Kept:
        def __init__(self, calls):
            self.rows, self.calls = [], calls

        def exists(self):
            self.calls.append("exists")
            return bool(self.rows)

        def get(self):
            self.calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            self.calls.append("put")
            self.rows = rows

        def appendList(self, rows):
            self.calls.append("append")
            self.rows = self.rows + rows

        def clear(self):
            self.calls.append("clear")
            self.rows = []

    class Handle:
        def __init__(self):
            self.calls = []

        def getListState(self, name, schema):
            return Kept(self.calls)

        def registerTimer(self, at):
            self.calls.append("timer")

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 10

    def calls(subjects):
        fold = lambda key, head, rows: ((int(rows["seq"].iloc[-1]),), rows.assign(key=key[0]))
        columns = {"subject": "string", "seq": "long", "arrived_ms": "long"}
        processor, handle = jobs.InOrder(fold, None, columns, "last long", True, int), Handle()
        processor.init(handle)
        names = [str(n) for n in range(subjects)] + [None]
        rows = pd.DataFrame([(n, q, 1) for q in (3, 1, 2) for n in names], columns=list(columns))
        assert list(processor.handleInputRows((0,), iter([rows]), Clock())) == []
        [out] = processor.handleExpiredTimer((0,), Clock(), None)
        for _, mine in out.groupby("key", dropna=False):
            assert mine["seq"].tolist() == [1, 2, 3]
        assert out["key"].nunique(dropna=False) == subjects + 1
        return handle.calls

    assert calls(300) == calls(2)


def test_json_fields_tell_missing_from_null_in_one_parse(spark):
    from tidemark.functions.fields import JsonFields

    texts = ['{"a": "x"}', '{"a": null}', '{"b": 1}', "[1]", "{", '{"a": "x", "a": "y"}', '{"a": ""}']
    fields = JsonFields(spark.createDataFrame([(t,) for t in texts], "raw string"), "raw", ["a"])
    rows = fields.df.select("raw", fields.missing("a").alias("m"), fields.not_text("a").alias("n"), fields.kind("a").alias("k")).collect()
    got = {r.raw: (r.m, r.n, r.k) for r in rows}
    assert got[texts[0]] == (False, False, "STRING") and got[texts[1]] == (False, True, "VOID")
    assert got[texts[6]] == (False, True, "STRING")
    assert all(got[t] == (True, True, None) for t in texts[2:6])
    assert "json_object_keys" not in fields.df._jdf.queryExecution().toString()


def test_folders_of_a_batch_are_listed_without_addresses(spark, tmp_path, monkeypatch):
    """The folders come from feed and day alone; repeats within and across batches are stored once."""
    from tidemark.sources import tables

    raw = tables.observations(spark, "/root/testdata/sf0.001")
    judged = observations.judged_observations(raw.unionByName(raw), tables.feed_policies(spark))
    plans, real = [], observations.in_folders_of

    def listed(store, batch, *rest):
        days = batch.select("feed", "seen_on").distinct()
        plans.append(days._jdf.queryExecution().optimizedPlan().toString())
        return real(store, batch, *rest)

    monkeypatch.setattr(observations, "in_folders_of", listed)
    store = str(tmp_path / "store")
    for _ in range(2):
        observations.record(judged, store)
    assert len(plans) == 1 and "sha2" not in plans[0]
    got = [r[0] for r in observations.stored(spark, store).select("observation_id").collect()]
    assert len(got) == len(set(got)) == observations.accepted(judged).count()
