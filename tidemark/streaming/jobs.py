"""Streaming forms: recording, state log, live transition audit, and the equity stop monitor.

A late observation is never dropped: it is compared with what is stored, however old, and it
is visible from its first-seen time on.

The three folds over a subject's history go by ``seq`` and share one reorder buffer.  A row
waits in keyed list state until ``hold`` has passed since its arrival, as the watermark of
``arrived`` tells; a timer then releases it behind every held row of a smaller ``seq``.  So
rows that come in any order within ``hold`` are put in place.  A row whose place has passed, or
whose ``seq`` came before, is named as disorder and changes nothing.  A row without ``seq`` only
moves the clock: send one to release the rest of a stream that ends.  Without ``hold`` nothing
waits, and rows are ordered within their trigger only.

State per subject is one small row and the rows of the last ``hold``.  Subjects are dealt to
``BUCKETS`` buckets by a hash, and a trigger makes a few calls to the state store per bucket it
touches.  A bucket's waiting rows are ordered in one task, so size triggers with
``maxFilesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.functions import fixed
from tidemark.functions.exprs import utc_day
from tidemark.operators.risk import RiskConfig
from tidemark.sources import observations


def record_stream(
    raw: DataFrame, policies: DataFrame, store: str, rejects: str, checkpoint: str
) -> StreamingQuery:
    """Validate arriving observations and append what is new; rejects go to their own table.

    A batch that is run again after a failure finds its rows already stored and adds
    nothing; its rejects are written under the batch number, so they are replaced.
    """

    def take(batch: DataFrame, number: int) -> None:
        judged = observations.judged_observations(batch, policies)
        observations.rejected(judged).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        observations.record(judged, store)

    return (
        raw.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def deduplicate_stream(raw: DataFrame, policies: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append each accepted content once, however late its repeats arrive.

    The store itself is the memory: a batch reads the folders of its own feeds and days.
    """

    def take(batch: DataFrame, number: int) -> None:
        observations.record(observations.judged_observations(batch, policies), store)

    return (
        raw.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
LIST_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Subjects share state by buckets.  A stream keeps this number for as long as its checkpoint lives.
BUCKETS = 256

# A fold takes the subject, its head (last seq first; None before the first row) and rows in
# order, and gives the new head and what to put out.
Fold = Callable[[tuple, tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]
Late = Callable[[tuple, tuple | None, pd.DataFrame], pd.DataFrame]


class InOrder(StatefulProcessor):
    """Hands the rows of a bucket's subjects to ``fold`` by ``seq`` and rows out of place to ``late``.

    A bucket holds many subjects, so a trigger costs a few calls to the state store per bucket,
    not per subject: heads are one list, waiting rows another, and one timer stands for the
    earliest waiting row.  Each subject keeps its own head and its own order.  The first column
    names the subject as text; ``read`` turns it back.
    """

    def __init__(self, fold: Fold, late: Late, columns: Mapping[str, str], head: str, waits: bool, read: Callable):
        self.fold, self.late, self.waits, self.read = fold, late, waits, read
        self.columns, self.head_schema, self.subject = dict(columns), head, next(iter(columns))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getListState("heads", f"{self.subject} string, {self.head_schema}")
        if self.waits:
            self.held = handle.getListState("held", ", ".join(f"{n} {t}" for n, t in self.columns.items()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)[list(self.columns)].dropna(subset=["seq"])
        if self.waits and len(frame):
            heads = self._heads()
            passed = self._passed(frame, heads)
            waiting = frame[~passed]
            if len(waiting):
                # The timer of rows that wait already may be later than these rows.
                self.handle.registerTimer(int(waiting["arrived_ms"].min()))
                self.held.appendList(self._plain(waiting))
            if passed.any():
                yield from self._told(frame[passed], heads)
        elif len(frame):
            yield from self._release(frame)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame(list(self.held.get()) if self.held.exists() else [], columns=list(self.columns))
        due = frame["arrived_ms"] <= timerValues.getCurrentWatermarkInMs()
        if not due.any():
            return
        last = frame[due].groupby(self.subject, dropna=False)["seq"].max().rename("_last").reset_index()
        out = (frame["seq"] <= frame[[self.subject]].merge(last, on=self.subject, how="left")["_last"]).to_numpy()
        stay = frame[~out]
        if len(stay):
            self.held.put(self._plain(stay))
            self.handle.registerTimer(int(stay["arrived_ms"].min()))
        else:
            self.held.clear()
        yield from self._release(frame[out])

    def _heads(self) -> dict:
        return {h[0]: tuple(h)[1:] for h in self.heads.get()} if self.heads.exists() else {}

    def _passed(self, frame: pd.DataFrame, heads: dict) -> pd.Series:
        """Rows at or before the last ``seq`` that their subject released."""
        last = {s: head[0] for s, head in heads.items()}
        found = [s in last and q <= last[s] for s, q in zip(frame[self.subject].tolist(), frame["seq"].tolist())]
        return pd.Series(found, index=frame.index, dtype=bool)

    def _plain(self, frame: pd.DataFrame) -> list[tuple]:
        return list(zip(*[frame[n].tolist() for n in self.columns]))

    def _subjects(self, frame: pd.DataFrame) -> Iterator[tuple[str | None, tuple, pd.DataFrame]]:
        """Each subject as the state names it, as its key, and its rows."""
        for name, rows in frame.groupby(self.subject, sort=False, dropna=False):
            name = name if isinstance(name, str) else None
            yield name, (None if name is None else self.read(name),), rows

    def _told(self, frame: pd.DataFrame, heads: dict) -> Iterator[pd.DataFrame]:
        for name, key, rows in self._subjects(frame):
            yield self.late(key, heads.get(name), rows)

    def _release(self, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Fold rows in order.  Of rows with one ``seq`` the first to arrive counts."""
        heads, made = self._heads(), []
        frame = frame.sort_values(list(self.columns), kind="stable").reset_index(drop=True)
        frame["seq"] = frame["seq"].astype("int64")
        misplaced = frame.duplicated([self.subject, "seq"]) | self._passed(frame, heads)
        for name, key, rows in self._subjects(frame[~misplaced]):
            heads[name], out = self.fold(key, heads.get(name), rows.reset_index(drop=True))
            made.append(out)
        if made:
            self.heads.put([(name, *head) for name, head in heads.items()])
        made = [out for out in made if len(out)]
        if made:
            yield pd.concat(made, ignore_index=True)
        if misplaced.any():
            yield from self._told(frame[misplaced], heads)


def in_order(
    rows: DataFrame, subject: str, values: Mapping[str, str], fold: Fold, late: Late, head: str, out: str,
    hold: str | None,
) -> DataFrame:
    """Fold a stream of ``subject``, seq, ``values`` and, with ``hold``, arrived, by ``seq``."""
    columns = {subject: "string", "seq": "long", **({"arrived_ms": "long"} if hold else {}), **values}
    read = int if rows.schema[subject].dataType.typeName() in ("long", "integer") else str
    if hold:
        rows = rows.withWatermark("arrived", hold).withColumn("arrived_ms", F.unix_millis("arrived"))
    bucket = F.pmod(F.xxhash64(subject), F.lit(BUCKETS)).cast("int")
    rows = rows.withColumns({subject: F.col(subject).cast("string"), "_bucket": bucket})
    kept = rows.select("_bucket", *columns, *(["arrived"] if hold else []))
    return kept.groupBy("_bucket").transformWithStateInPandas(
        InOrder(fold, late, columns, head, hold is not None, read), out, "Append", "EventTime" if hold else "None",
    )


def state_log(states: DataFrame, hold: str | None = None) -> DataFrame:
    """Per release and subject its changes of state and its last entry.

    ``states``: a stream of subject_id, seq, state (and arrived).  Rows where ``changed`` holds
    are the coalesced log; of all rows without ``disorder`` the one of the highest seq is the
    subject's latest state, ``entries`` counts what came so far.
    """
    names = ["subject_id", "seq", "state", "changed", "disorder", "entries"]

    def fold(key: tuple, head: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        _, held, entries = head or (None, None, 0)
        changed = rows["state"] != rows["state"].shift(fill_value=held)
        changed.iloc[0] |= head is None
        made = rows.assign(
            subject_id=key[0], changed=changed, disorder=False, entries=range(entries + 1, entries + 1 + len(rows))
        )
        last = made.iloc[-1]
        kept = made[changed | (made.index == made.index[-1])]
        return (int(last["seq"]), last["state"], int(last["entries"])), kept[names]

    def late(key: tuple, head: tuple | None, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(subject_id=key[0], changed=False, disorder=True, entries=head[2] if head else 0)[names]

    return in_order(
        states, "subject_id", {"state": "string"}, fold, late, "last long, held string, entries long",
        "subject_id string, seq long, state string, changed boolean, disorder boolean, entries long", hold,
    )


def audited_transitions(
    events: DataFrame,
    edges: Mapping[str, Sequence[str]] = fixed.ORDER_EDGES,
    initial: str = "proposed",
    hold: str | None = None,
) -> DataFrame:
    """Each event with the subject's state before and after it, and whether it was legal.

    ``events``: a stream of subject_id, seq, event (and arrived).  Rows where ``changed`` is true
    moved the subject's state.  An event whose place has passed is marked ``disorder``.
    """
    table = {s: frozenset(t) for s, t in edges.items()}
    names = ["subject_id", "seq", "event", "before", "after", "legal", "changed", "disorder"]

    def fold(key: tuple, head: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        at = head[1] if head else initial
        path = [at]
        for event in rows["event"].tolist():
            at = event if event in table.get(at, ()) else at
            path.append(at)
        before, after = path[:-1], path[1:]
        legal = [e in table.get(b, ()) for e, b in zip(rows["event"].tolist(), before)]
        out = rows.assign(subject_id=key[0], before=before, after=after, legal=legal, disorder=False)
        return (int(rows["seq"].iloc[-1]), at), out.assign(changed=out["before"] != out["after"])[names]

    def late(key: tuple, head: tuple | None, rows: pd.DataFrame) -> pd.DataFrame:
        at = head[1] if head else initial
        return rows.assign(subject_id=key[0], before=at, after=at, legal=False, changed=False, disorder=True)[names]

    return in_order(
        events, "subject_id", {"event": "string"}, fold, late, "last long, at string",
        "subject_id string, seq long, event string, before string, after string, legal boolean, changed boolean, disorder boolean",
        hold,
    )


def equity_stop_monitor(
    changes: DataFrame, opening_cents: int, config: RiskConfig = RiskConfig(), hold: str | None = None
) -> DataFrame:
    """Readings at which a stop is reached, from a stream of signed changes in cents.

    ``changes``: account, seq, as_of, change_cents (and arrived).  Per account the state is the
    last ``seq``, the day, the equity before its first change, the peak and the current equity.
    A row whose place has passed, or repeated, is reported as ``disorder`` and changes nothing.
    """
    daily, valley = config.daily_loss_stop_fraction, config.peak_to_valley_fraction
    names = ["account", "seq", "start_cents", "peak_cents", "current_cents", "reasons"]
    flags = ["session_start_equity_not_positive", "peak_equity_not_positive", "daily_loss_stop", "peak_to_valley_kill_switch"]

    def fold(key: tuple, head: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        _, day, start, peak, now = head or (None, "", opening_cents, opening_cents, opening_cents)
        change = rows["change_cents"].to_numpy("int64")
        current = now + np.cumsum(change)
        top = np.maximum(peak, np.maximum.accumulate(current))
        days = rows["day"].to_numpy(object)
        opens = days != np.concatenate([[day], days[:-1]])
        at = np.maximum.accumulate(np.where(opens, np.arange(len(rows)), -1))
        begun = np.where(at >= 0, (current - change)[at], start)
        # Fractions stay exact decimals: the limits are compared as whole multiples of cents.
        over = lambda loss, base, share: np.array([l >= b * share for l, b in zip(loss.tolist(), base.tolist())], bool)
        hit = np.stack([begun <= 0, top <= 0, over(begun - current, begun, daily), over(top - current, top, valley)], axis=1)
        found = np.flatnonzero(hit.any(axis=1))
        out = pd.DataFrame({
            "account": key[0], "seq": rows["seq"].to_numpy()[found], "start_cents": begun[found],
            "peak_cents": top[found], "current_cents": current[found],
            "reasons": pd.Series([[f for f, h in zip(flags, row) if h] for row in hit[found]], dtype=object),
        }, columns=names)
        return (int(rows["seq"].iloc[-1]), days[-1], int(begun[-1]), int(top[-1]), int(current[-1])), out

    def late(key: tuple, head: tuple | None, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, start, peak, now = head or (None, "", opening_cents, opening_cents, opening_cents)
        named = rows.assign(account=key[0], start_cents=start, peak_cents=peak, current_cents=now)
        return named.assign(reasons=[["disorder"]] * len(named))[names]

    dated = changes.withColumn("day", utc_day(F.col("as_of")).cast("string"))
    return in_order(
        dated, "account", {"day": "string", "change_cents": "long"}, fold, late,
        "last long, day string, start long, peak long, now long",
        "account long, seq long, start_cents long, peak_cents long, current_cents long, reasons array<string>", hold,
    )


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet, everything available now, exactly once.

    Keyed lists need a store that holds them.  A query copies the session's settings when it
    starts, so the setting is named for that moment only.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, LIST_STATE_STORE)
    try:
        return (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        conf.set(STATE_STORE, before) if before is not None else conf.unset(STATE_STORE)
