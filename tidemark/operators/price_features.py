"""Residual price and volume features for a spine of (symbol, as_of).

``feature_block`` answers every spine row from one plan.  Where all bars arrive in order
the features are row frames over one series per symbol.  Where some bar arrives after a later
session was seen, the panel has two axes, session and arrival: a table of versions says which
values a session showed from which instant on.  Questions whose lookback holds no open session
still read the row frames; the others look their few rows up in the versions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions import guards, spread
from tidemark.functions.exprs import config_version, flag_list
from tidemark.operators import panel
from tidemark.settings import known_rows, max_group_rows, settle

FEATURES = (
    "residual_return_1s",
    "residual_return_5s",
    "opening_gap_residual",
    "residual_return_zscore",
    "abnormal_volume",
    "range_over_atr",
    "proximity_to_extreme",
    "cumulative_abnormal_return",
)
NEVER_CLIPPED = ("proximity_to_extreme",)


@dataclass(frozen=True)
class FeatureConfig:
    lookback_sessions: int = 60
    residual_volatility_sessions: int = 20
    abnormal_volume_sessions: int = 20
    atr_sessions: int = 14
    extreme_sessions: int = 20
    min_sector_peers: int = 2
    winsor_lower: float = -5.0
    winsor_upper: float = 5.0

    def __post_init__(self) -> None:
        counts = [v for k, v in asdict(self).items() if k.endswith("_sessions")]
        if min(counts) <= 0 or self.min_sector_peers < 1:
            raise ValueError("session counts and min_sector_peers must be positive")
        if self.lookback_sessions < max(self.residual_volatility_sessions, 5):
            raise ValueError("lookback_sessions is shorter than the residuals derived from it need")
        if not self.winsor_lower < self.winsor_upper:
            raise ValueError("winsor_lower must be below winsor_upper")

    @property
    def version(self) -> str:
        return config_version("pv", asdict(self))


FLAVOURS = ("sec", "mkt")


def _global_rows(bars: DataFrame, sectors: DataFrame, layout: panel.Layout) -> DataFrame:
    """The stored residual panel with two running sums per symbol and flavour.

    ``undemeaned`` counts sessions nothing was demeaned against, ``upto`` sums the residual returns.
    """
    rows = panel.residuals(panel.moves(bars, layout), sectors, layout)
    sums = {f"undemeaned_{t}": ("sum", F.coalesce(F.col(f"alone_{t}"), F.lit(0))) for t in FLAVOURS}
    sums |= {f"upto_{t}": ("sum", F.coalesce(F.col(f"ret_{t}"), F.lit(0.0))) for t in FLAVOURS}
    return settle(spread.running(rows, ["symbol"], ["session"], layout.by_symbol, sums), "panel")


def _reach(config: FeatureConfig) -> int:
    """Rows before the current one that any feature looks back to."""
    return max(
        config.lookback_sessions, config.abnormal_volume_sessions, config.atr_sessions,
        config.extreme_sessions,
    )


def _frames(
    rows: DataFrame, layout: panel.Layout, config: FeatureConfig, keep: Sequence[str] = ()
) -> DataFrame:
    """Every window feature at every bar, residual ones in both flavours, and the columns ``keep``.

    ``behind`` is the residual sum up to the last bar before the lookback, ``far`` the calendar
    number (``idx``) of the oldest bar that any feature looks back to.
    """
    keys = layout.symbol_keys
    rows, part = spread.in_blocks(rows, keys, layout.by_symbol, before=_reach(config))
    w = W.partitionBy(*part).orderBy("session")
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    earlier = lambda n: w.rowsBetween(-n, -1)
    n_sd, n_vol = config.residual_volatility_sessions, config.abnormal_volume_sessions
    n_atr, n_ext = config.atr_sessions, config.extreme_sessions
    made = {}
    for t in FLAVOURS:
        r = F.col(f"ret_{t}")
        made[f"sum5_{t}"] = F.when(F.count(r).over(last(5)) == 5, F.sum(r).over(last(5)))
        made[f"sd_{t}"] = F.when(
            F.count(r).over(last(n_sd)) == max(n_sd, 2), F.stddev_samp(r).over(last(n_sd))
        )
    if "upto_sec" in rows.columns:
        for t in FLAVOURS:
            made[f"behind_{t}"] = F.coalesce(F.lag(f"upto_{t}", config.lookback_sessions).over(w), F.lit(0.0))
    if "idx" in rows.columns:
        made["far"] = F.lag("idx", _reach(config)).over(w)
    made["_volumes"] = F.sort_array(F.collect_list("volume").over(earlier(n_vol)))
    made["_atr"] = F.when(
        F.count("true_range").over(earlier(n_atr)) == n_atr, F.avg("true_range").over(earlier(n_atr))
    )
    made["_low"] = F.when(F.count("low_t").over(last(n_ext)) == n_ext, F.min("low_t").over(last(n_ext)))
    made["_high"] = F.max("high_t").over(last(n_ext))
    rows = rows.withColumns(made).where("_core")
    lower, upper = (n_vol + 1) // 2, n_vol // 2 + 1
    centre = F.when(
        F.size("_volumes") == n_vol,
        (F.element_at("_volumes", lower) + F.element_at("_volumes", upper)) / 2.0,
    )
    return rows.select(
        *keys, "session", "first_seen_time", "pos",
        *[f"{n}_{t}" for t in FLAVOURS for n in ("ret", "gap", "sum5", "sd", "undemeaned")],
        "volume", centre.alias("volume_centre"),
        (F.col("high_t") - F.col("low_t")).alias("range"), F.col("_atr").alias("atr"),
        (F.col("close_t") - F.col("_low")).alias("above_low"),
        (F.col("_high") - F.col("_low")).alias("extent"),
        *[n for n in made if n.startswith(("behind_", "far"))], *keep,
    )


UPTO = [f"upto_{t}" for t in FLAVOURS]


def _with_event_sums(
    seen: DataFrame, rows: DataFrame, layout: panel.Layout, config: FeatureConfig
) -> DataFrame:
    """Add the residual sum of the sessions wholly after each event, within the lookback.

    The first session after an event is one ordered lookup; the sum is then the running sum at
    the bar seen less the one before that session, or before the lookback where that is later.
    """
    before = [(F.col(f"upto_{t}") - F.col(f"ret_{t}")).alias(t) for t in FLAVOURS]
    point = rows.where("prev_session is not null").select(
        "symbol", (-F.unix_micros("prev_session")).alias("_key"), F.lit(0).alias("_asked"),
        F.struct("pos", *before).alias("first"), F.lit(None).cast("timestamp").alias("event_time"),
    )
    asked = seen.where("event_time is not null").select("symbol", "event_time").distinct().select(
        "symbol", (-F.unix_micros("event_time")).alias("_key"), F.lit(1).alias("_asked"),
        F.lit(None).cast(point.schema["first"].dataType).alias("first"), "event_time",
    )
    found = spread.last_known(
        point.unionByName(asked), ["symbol"], ["_key", "_asked"], layout.by_symbol, "first"
    )
    seen = seen.join(
        found.where("_asked = 1").select("symbol", "event_time", "first"), ["symbol", "event_time"], "left"
    )
    inside = F.col("first.pos") > F.col("pos") - config.lookback_sessions
    start = lambda t: F.when(inside, F.col(f"first.{t}")).otherwise(F.col(f"behind_{t}"))
    held = F.col("first.pos") <= F.col("pos")
    return seen.withColumns(
        {f"car_{t}": F.when(held, F.col(f"upto_{t}") - start(t)) for t in FLAVOURS}
    ).drop("first")


def _assemble(found: DataFrame, config: FeatureConfig) -> DataFrame:
    """Choose the flavour, name what is missing, clip, and flag."""
    c = F.col
    held = c("pos").isNotNull()
    fallback = c("sector").isNull() | (c("sector_peers") < config.min_sector_peers)
    either = lambda n: F.when(fallback, c(f"{n}_mkt")).otherwise(c(f"{n}_sec"))
    found = found.withColumns(
        {"_fallback": fallback}
        | {f"_{n}": either(n) for n in ("ret", "gap", "sum5", "sd", "undemeaned", "car")}
    )
    nonzero = lambda col: F.when(col != 0, col)
    raw = {
        "residual_return_1s": c("_ret"),
        "residual_return_5s": c("_sum5"),
        "opening_gap_residual": c("_gap"),
        "residual_return_zscore": c("_ret") / nonzero(c("_sd")),
        "abnormal_volume": c("volume") / nonzero(c("volume_centre")) - 1.0,
        "range_over_atr": c("range") / nonzero(c("atr")),
        "proximity_to_extreme": c("above_low") / nonzero(c("extent")),
        "cumulative_abnormal_return": F.when(c("event_time").isNotNull(), c("_car")),
    }
    zero = {
        "residual_return_zscore": c("_sd") == 0,
        "abnormal_volume": c("volume_centre") == 0,
        "range_over_atr": c("atr") == 0,
        "proximity_to_extreme": c("extent") == 0,
    }
    found = found.withColumns({f"_raw_{n}": v for n, v in raw.items()})
    flags = [
        F.when(c("_fallback"), F.lit("sector_fallback_market")),
        F.when(c("_undemeaned") > 0, F.concat(F.lit("no_peer_data:"), c("_undemeaned").cast("string"))),
        F.lit("abnormal_volume_daily_baseline"),
        F.when(c("event_time").isNull(), F.lit("no_event_time")),
    ]
    out = {}
    for name in FEATURES:
        value = c(f"_raw_{name}")
        is_zero = F.coalesce(zero.get(name, F.lit(False)), F.lit(False))
        absent = value.isNull() & ~is_zero
        if name == "cumulative_abnormal_return":
            absent = absent & c("event_time").isNotNull()
        flags.append(F.when(is_zero, F.lit(f"zero_denominator:{name}")))
        flags.append(F.when(absent, F.lit(f"insufficient_history:{name}")))
        if name in NEVER_CLIPPED:
            out[name] = value
            continue
        clipped = F.when(
            value.isNotNull(),
            F.least(F.greatest(value, F.lit(config.winsor_lower)), F.lit(config.winsor_upper)),
        )
        flags.append(F.when(clipped != value, F.lit(f"winsorized:{name}")))
        out[name] = clipped
    listed = F.when(held, flag_list(*flags)).otherwise(F.array(F.lit("no_qualifying_data")))
    return found.select(
        "symbol", "as_of",
        *[v.cast("double").alias(n) for n, v in out.items()],
        listed.alias("quality_flags"),
        F.lit(config.version).alias("feature_version"),
    )


@dataclass(frozen=True)
class _Sizes:
    """Whether the small per-instant tables could outgrow one task, from upper bounds."""

    by_time: bool
    by_sector: bool

    @staticmethod
    def measure(spine: DataFrame, bars: DataFrame) -> "_Sizes":
        limit, rows = max_group_rows(spine.sparkSession), [known_rows(spine), known_rows(bars)]
        if None not in rows and sum(rows) <= limit:
            return _Sizes(False, False)
        count = lambda df, name, tag: df.agg(F.count_distinct(name).alias("n")).select(F.lit(tag).alias("t"), "n")
        counted = (
            count(spine, "as_of", "instants").unionByName(count(bars, "session", "sessions"))
            .unionByName(count(bars, "symbol", "symbols"))
        )
        n = {r.t: r.n for r in counted.collect()}
        return _Sizes(n["instants"] + n["sessions"] > limit, n["instants"] + n["symbols"] > limit)


def _sector_members(
    spine: DataFrame, bars: DataFrame, sectors: DataFrame, sizes: _Sizes
) -> DataFrame:
    """How many other symbols of each sector have shown a bar by each instant asked about."""
    firsts = bars.groupBy("symbol").agg(F.min("first_seen_time").alias("as_of")).join(sectors, "symbol")
    arrivals = firsts.groupBy("sector", "as_of").agg(F.count("*").alias("_new"))
    instants = spine.join(sectors, "symbol").select("sector", "as_of").distinct()
    steps = (
        arrivals.unionByName(instants.withColumn("_new", F.lit(0).cast("bigint")))
        .groupBy("sector", "as_of").agg(F.sum("_new").alias("_new"))
    )
    counted = spread.running(
        steps, ["sector"], ["as_of"], sizes.by_sector, {"members": ("sum", F.col("_new"))}
    )
    return counted.select("sector", "as_of", (F.col("members") - 1).alias("sector_peers"))


def _finish(
    seen: DataFrame, bars: DataFrame, sectors: DataFrame, config: FeatureConfig, sizes: _Sizes
) -> DataFrame:
    """Join what a spine row sees with its sector's size, then assemble."""
    counts = _sector_members(seen, bars, sectors, sizes)
    seen = seen.join(sectors, "symbol", "left").join(counts, ["sector", "as_of"], "left")
    return _assemble(seen, config)


def _questions(spine: DataFrame, framed: DataFrame, values: Sequence[str]) -> DataFrame:
    """Frames at the instants their bars arrive, and the spine's questions (``_asked`` 1)."""
    point = framed.select(
        "symbol", F.col("first_seen_time").alias("as_of"), F.lit(0).alias("_asked"),
        F.struct(*values).alias("bar"), F.lit(None).cast("timestamp").alias("event_time"),
    )
    asked = spine.select(
        "symbol", "as_of", F.lit(1).alias("_asked"),
        F.lit(None).cast(point.schema["bar"].dataType).alias("bar"), "event_time",
    )
    return point.unionByName(asked)


def _series_block(
    spine: DataFrame, bars: DataFrame, rows: DataFrame, sectors: DataFrame, layout: panel.Layout,
    config: FeatureConfig, sizes: _Sizes,
) -> DataFrame:
    """Blocks for instants whose visible bars are a prefix of one series per symbol."""
    framed = _frames(rows, layout, config, UPTO)
    values = [n for n in framed.columns if n not in ("symbol", "first_seen_time")]
    # Two bars of a symbol may arrive together: the later session is the one seen.
    both = _questions(spine, framed, values).withColumn("_session", F.col("bar.session"))
    carried = spread.last_known(
        both, ["symbol"], ["as_of", "_asked", "_session"], layout.by_symbol, "bar"
    )
    seen = carried.where("_asked = 1").select("symbol", "as_of", "event_time", "bar.*")
    return _finish(_with_event_sums(seen, rows, layout, config), bars, sectors, config, sizes)


def _seen_by_questions(spine: DataFrame, bars: DataFrame, sizes: _Sizes) -> DataFrame:
    """The bars, each arriving at the first instant asked about that sees it.

    Arrivals between two questions make no difference, so they make no version either.  Bars
    that no question sees are left out.
    """
    key = lambda c: (-F.unix_micros(c)).alias("_key")
    none = lambda name: F.lit(None).cast("timestamp").alias(name)
    point = spine.select("as_of").distinct().select(
        F.lit(0).alias("_all"), key("as_of"), F.lit(0).alias("_asked"), "as_of", none("first_seen_time")
    )
    asked = bars.select("first_seen_time").distinct().select(
        F.lit(0).alias("_all"), key("first_seen_time"), F.lit(1).alias("_asked"), none("as_of"), "first_seen_time"
    )
    found = spread.last_known(point.unionByName(asked), ["_all"], ["_key", "_asked"], sizes.by_time, "as_of")
    found = found.where("_asked = 1 and as_of is not null").select("first_seen_time", F.col("as_of").alias("_at"))
    return bars.join(found, "first_seen_time").withColumn("first_seen_time", F.col("_at")).drop("_at")


PRICES = ("open_t", "high_t", "low_t", "close_t")
MOVE_VERSION = (
    "symbol string, session long, since long, until long, prev_session long, prev_t long, steady long, volume long, "
    + ", ".join(f"{n} long" for n in PRICES)
)


def _arrival_order(bars: DataFrame, layout: panel.Layout) -> DataFrame:
    """Bars with ``late``, whether a later session of the symbol was seen first, and ``steady``.

    ``steady`` numbers the bars that are not late; a late bar carries the number before it.
    """
    rows = bars.select(
        "symbol", "session", "first_seen_time", "volume",
        *[panel.ticks(F.col(n)).alias(f"{n}_t") for n in ("open", "high", "low", "close")],
        (-F.unix_micros("session")).alias("_back"),
    )
    soonest = {"_soonest": ("min", F.col("first_seen_time"))}
    rows = spread.running(rows, ["symbol"], ["_back"], layout.by_symbol, soonest)
    rows = rows.withColumn("late", F.col("first_seen_time") > F.col("_soonest"))
    number = {"steady": ("sum", (~F.col("late")).cast("long"))}
    rows = spread.running(rows, ["symbol"], ["session"], layout.by_symbol, number)
    return settle(rows.drop("_back", "_soonest"), "arrival_order")


def _versions_of_run(run: pd.DataFrame) -> pd.DataFrame:
    """Which bar each bar of a run of late ones moves against, and from when to when.

    A bar's first predecessor is the latest earlier one seen by its own arrival.  A late bar takes
    over as predecessor of the first later bar seen before it, so a stack of bars with rising
    arrivals finds every version in one pass.
    """
    out, stack = [], []
    rows = run.sort_values("session").to_dict("records")
    for i, row in enumerate(rows):
        taken = []
        while stack and stack[-1]["seen"] > row["seen"]:
            taken.append(stack.pop())
        head = not row["late"] and row["steady"] == row["_run"]
        if not head:
            first = [(row["seen"], stack[-1] if stack else None)]
            cuts = first + [(p["seen"], p) for p in reversed(taken)]
            for k, (since, p) in enumerate(cuts):
                until = cuts[k + 1][0] if k + 1 < len(cuts) else None
                if until != since:
                    past = (p["session"], p["close_t"]) if p else (None, None)
                    own = [row[n] for n in ("steady", "volume", *PRICES)]
                    out.append((row["symbol"], row["session"], since, until, *past, *own))
        stack.append(row)
    names = [part.split()[0] for part in MOVE_VERSION.split(", ")]
    longs = {n: "Int64" for n in names if n != "symbol"}
    return pd.DataFrame(out, columns=names).astype(longs)


def _move_versions(ordered: DataFrame) -> DataFrame:
    """Every version of the moves around late bars: ``since``, ``until`` (exclusive, NULL if it stays).

    A run is a bar in order, the late bars behind it and the next bar in order.  Runs without late
    bars never reach Python; one with many holds a few whole numbers per late bar of one symbol.
    """
    runs = ordered.where("late").select("symbol", F.col("steady").alias("_run")).distinct()
    own = F.when(F.col("late"), F.array("steady")).otherwise(F.array("steady", F.col("steady") - 1))
    members = ordered.withColumn("_run", F.explode(own)).join(runs, ["symbol", "_run"]).select(
        "symbol", "_run", F.unix_micros("session").alias("session"),
        F.unix_micros("first_seen_time").alias("seen"), "late", "steady", "volume", *PRICES,
    )
    made = members.groupBy("symbol", "_run").applyInPandas(_versions_of_run, MOVE_VERSION)
    stamps = {n: F.timestamp_micros(n) for n in ("session", "since", "until", "prev_session")}
    return made.withColumns(stamps).select(
        "symbol", "session", "since", "until", "prev_session", "volume", *PRICES[1:], *panel.move_values()
    )


SHOWN = ("volume", "prev_session", "high_t", "low_t", "close_t", "true_range")
DEMEANED = tuple(f"{n}_{t}" for t in FLAVOURS for n in ("ret", "gap", "alone"))


def _version_table(
    rows: DataFrame, ordered: DataFrame, sectors: DataFrame, layout: panel.Layout
) -> tuple[DataFrame, DataFrame]:
    """What every bar showed from which instant on, and per session its first and last version.

    One row per (symbol, session, version).  A session has a version per instant at which a bar of
    it, or the bar that one of them moves against, came in; between two such instants the order
    statistics of its cross-section stay.  Sessions with one version keep the panel's rows.
    """
    moves = settle(_move_versions(ordered), "move_versions")
    touched = moves.select("symbol", "session").distinct()
    plain = rows.join(touched, ["symbol", "session"], "left_anti").select(
        "symbol", "session", F.col("first_seen_time").alias("since"), F.lit(None).cast("timestamp").alias("until"),
        *SHOWN, "ret", "gap",
    )
    all_moves = plain.unionByName(moves.select(*plain.columns))
    calendar = settle(
        all_moves.groupBy("session").agg(F.min("since").alias("first"), F.max("since").alias("final")), "calendar"
    )
    changing = calendar.where(F.col("first") < F.col("final")).select("session")
    members = all_moves.join(changing, "session", "left_semi")
    bounds = members.select("session", F.col("since").alias("b")).distinct().withColumn(
        "b_to", F.lead("b").over(W.partitionBy("session").orderBy("b"))
    )
    stands = (F.col("b") >= F.col("since")) & (F.col("until").isNull() | (F.col("b") < F.col("until")))
    spans = members.join(bounds, "session").where(stands).join(sectors, "symbol", "left")
    # A group holds one version of a session, so it is no larger than the session.
    again = panel.leave_one_out(spans, ["session", "b"], ("ret", "gap"), layout.by_session, "mkt")
    again = panel.leave_one_out(again, ["session", "b", "sector"], ("ret", "gap"), layout.by_session, "sec")
    shown = ["symbol", "session", "b", "b_to", *SHOWN, *DEMEANED]
    settled = rows.join(changing, "session", "left_anti").select(
        "*", F.col("first_seen_time").alias("b"), F.lit(None).cast("timestamp").alias("b_to")
    )
    table = settled.select(*shown).unionByName(again.select(*shown))
    numbered = table.join(ordered.select("symbol", "session", "steady"), ["symbol", "session"])
    return settle(numbered, "versions"), calendar


def _bare_sessions(spine: DataFrame, table: DataFrame, layout: panel.Layout) -> DataFrame:
    """Visible sessions without peers at each question: a running sum over arrivals.

    A version counts from its first instant and no longer from its last on.
    """
    alone = [F.coalesce(F.col(f"alone_{t}"), F.lit(0)).cast("long").alias(f"d_{t}") for t in FLAVOURS]
    bare = table.where("alone_sec = 1 or alone_mkt = 1")
    comes = bare.select("symbol", F.col("b").alias("as_of"), F.lit(0).alias("_asked"), *alone)
    goes = bare.where("b_to is not null").select(
        "symbol", F.col("b_to").alias("as_of"), F.lit(0).alias("_asked"), *[-a for a in alone]
    ).toDF(*comes.columns)
    asked = spine.select("symbol", "as_of").distinct().select(
        "symbol", "as_of", F.lit(1).alias("_asked"), *[F.lit(0).cast("long").alias(f"d_{t}") for t in FLAVOURS]
    )
    sums = {f"undemeaned_{t}": ("sum", F.col(f"d_{t}")) for t in FLAVOURS}
    both = comes.unionByName(goes).unionByName(asked)
    counted = spread.running(both, ["symbol"], ["as_of", "_asked"], layout.by_symbol, sums)
    return counted.where("_asked = 1").select("symbol", "as_of", *sums)


def _open_sessions(spine: DataFrame, calendar: DataFrame, span: int, heavy: bool) -> tuple[DataFrame, DataFrame]:
    """Calendar numbers of the sessions, and what each instant knows of open ones.

    Per instant: ``upto``, the number of the last session visible then, and the latest instant at
    which one of the ``span`` sessions up to it (``recent``), or any session up to it (``ever``),
    took its last version.  A session is open while that lies ahead.
    """
    known = calendar.withColumn("_all", F.lit(0)).withColumn("_back", -F.unix_micros("session"))
    known = spread.running(known, ["_all"], ["_back"], heavy, {"_open": ("min", F.col("first"))})
    known = spread.numbered(known, ["_all"], ["session"], heavy, "idx")
    known = spread.running(known, ["_all"], ["session"], heavy, {"ever": ("max", F.col("final"))})
    laid, part = spread.in_blocks(known, ["_all"], heavy, before=span - 1, pos="idx")
    last = W.partitionBy(*part).orderBy("session").rowsBetween(-(span - 1), 0)
    known = settle(laid.withColumn("recent", F.max("final").over(last)).where("_core"), "open_sessions")
    point = known.select(
        "_all", F.col("_open").alias("as_of"), F.lit(0).alias("_asked"), "session",
        F.struct(F.col("idx").alias("upto"), "recent", "ever").alias("state"),
    )
    asked = spine.select("as_of").distinct().select(
        F.lit(0).alias("_all"), "as_of", F.lit(1).alias("_asked"), F.lit(None).cast("timestamp").alias("session"),
        F.lit(None).cast(point.schema["state"].dataType).alias("state"),
    )
    found = spread.last_known(point.unionByName(asked), ["_all"], ["as_of", "_asked", "session"], heavy, "state")
    return known.select("session", "idx"), found.where("_asked = 1").select("as_of", "state.*")


def _looked_up(
    waiting: DataFrame, table: DataFrame, config: FeatureConfig
) -> DataFrame:
    """Frames for questions with an open session in their lookback, from the versions they see.

    Of the bars in order all are visible, so as many of them as a feature looks back to, with the
    late bars between them, hold every row that is needed.
    """
    steps = F.sequence(F.greatest(F.col("steady") - (_reach(config) + 1), F.lit(0)), F.col("steady"))
    wanted = waiting.select("symbol", "as_of", "event_time", F.explode(steps).alias("steady"))
    seen = (F.col("b") <= F.col("as_of")) & (F.col("b_to").isNull() | (F.col("as_of") < F.col("b_to")))
    within = W.partitionBy("as_of", "symbol")
    series = wanted.join(table, ["symbol", "steady"]).where(seen).withColumns(
        {
            "pos": F.row_number().over(within.orderBy("session")),
            "_nth": F.row_number().over(within.orderBy(F.desc("session"))), "first_seen_time": F.col("b"),
        } | {f"undemeaned_{t}": F.lit(0) for t in FLAVOURS}
    )
    counted = (F.col("_nth") <= config.lookback_sessions) & (F.col("prev_session") >= F.col("event_time"))
    framed = _frames(
        series.withColumns({f"_car_{t}": F.when(counted, F.col(f"ret_{t}")) for t in FLAVOURS}),
        panel.Layout(False, False, ("as_of",)), config, [f"_car_{t}" for t in FLAVOURS],
    )
    sums = [f"_car_{t}" for t in FLAVOURS]
    values = [n for n in framed.columns if n not in ("symbol", "as_of", "first_seen_time", *sums)]
    newest = framed.groupBy("symbol", "as_of").agg(
        F.max_by(F.struct(*values), F.col("pos")).alias("bar"),
        *[F.sum(f"_car_{t}").alias(f"car_{t}") for t in FLAVOURS],
    )
    return waiting.select("symbol", "as_of", "event_time").join(newest, ["symbol", "as_of"]).select(
        "symbol", "as_of", "event_time", "bar.*", *[f"car_{t}" for t in FLAVOURS]
    )


def _late_block(
    spine: DataFrame, bars: DataFrame, sectors: DataFrame, layout: panel.Layout, config: FeatureConfig,
    sizes: _Sizes,
) -> DataFrame:
    """Blocks where bars arrive out of order.

    The row frames over the final panel hold for every question whose lookback is settled by then;
    the others number at most a lookback of instants per late bar, however late it is.
    """
    told = settle(_seen_by_questions(spine, bars, sizes), "arrivals")
    rows = _global_rows(told, sectors, layout)
    ordered = _arrival_order(told, layout)
    table, calendar = _version_table(rows, ordered, sectors, layout)
    span = 2 * _reach(config) + 2
    numbers, states = _open_sessions(spine, calendar, span, sizes.by_time)
    placed = rows.join(numbers, "session").join(ordered.select("symbol", "session", "steady"), ["symbol", "session"])
    framed = _frames(placed, layout, config, [*UPTO, "steady"])
    values = ["session", *[n for n in framed.columns if n not in ("symbol", "first_seen_time", "session")]]
    newest = {"bar": ("max", F.col("bar"))}
    carried = spread.running(_questions(spine, framed, values), ["symbol"], ["as_of", "_asked"], layout.by_symbol, newest)
    seen = carried.where("_asked = 1").select("symbol", "as_of", "event_time", "bar.*").join(states, "as_of", "left")
    near = F.coalesce(F.col("upto") - F.col("far") < span, F.lit(False))
    unsettled = F.when(near, F.col("recent")).otherwise(F.col("ever")) > F.col("as_of")
    seen = settle(seen.withColumn("_waits", F.coalesce(unsettled & F.col("pos").isNotNull(), F.lit(False))), "newest")
    calm = _with_event_sums(seen.where("not _waits"), rows, layout, config)
    looked = _looked_up(seen.where("_waits"), table, config)
    columns = [n for n in looked.columns if not n.startswith("undemeaned_")]
    both = calm.select(*columns).unionByName(looked.select(*columns))
    both = both.join(_bare_sessions(spine, table, layout), ["symbol", "as_of"], "left")
    return _finish(both, bars, sectors, config, sizes)


def disturbed_instants(spine: DataFrame, bars: DataFrame, sizes: _Sizes | None = None) -> DataFrame:
    """Spine instants at which a bar of an already visible session has not arrived.

    Returns each with its ``front``: the earliest session that is incomplete then.
    """
    heavy = (sizes or _Sizes.measure(spine, bars)).by_time
    sessions = bars.groupBy("session").agg(
        F.min("first_seen_time").alias("_from"), F.max("first_seen_time").alias("_until")
    )
    # A session counts as visible once it or any later one has shown a bar.  The latest
    # arrival among all sessions up to one never decreases, so the first session whose value
    # exceeds an instant is found by one ordered lookup.
    sessions = sessions.withColumn("_all", F.lit(0)).withColumn("_back", -F.unix_micros("session"))
    known = spread.running(sessions, ["_all"], ["_back"], heavy, {"_open": ("min", F.col("_from"))})
    known = spread.running(known, ["_all"], ["session"], heavy, {"_reach": ("max", F.col("_until"))})
    point = known.select(
        "_all", (-F.unix_micros("_reach")).alias("_key"), F.lit(1).alias("_kind"), "_back",
        F.struct("session", "_open").alias("front"), F.lit(None).cast("timestamp").alias("as_of"),
    )
    asked = spine.select("as_of").distinct().select(
        F.lit(0).alias("_all"), (-F.unix_micros("as_of")).alias("_key"), F.lit(0).alias("_kind"),
        F.lit(0).cast("bigint").alias("_back"),
        F.lit(None).cast(point.schema["front"].dataType).alias("front"), "as_of",
    )
    both = point.unionByName(asked)
    found = spread.last_known(both, ["_all"], ["_key", "_kind", "_back"], heavy, "front")
    return found.where("_kind = 0 and front._open <= as_of").select(
        "as_of", F.col("front.session").alias("front")
    )


def feature_block(
    spine: DataFrame, bars: DataFrame, sectors: DataFrame, config: FeatureConfig = FeatureConfig()
) -> DataFrame:
    """One row per spine row: eight features, quality flags and the configuration version.

    ``spine``: symbol, as_of and optionally event_time.  ``bars``: checked bars that are
    cheap to read again (a stored table).  A missing feature is NULL and named in a flag.
    """
    if "event_time" not in spine.columns:
        spine = spine.withColumn("event_time", F.lit(None).cast("timestamp"))
    spine = spine.select("symbol", "as_of", "event_time")
    layout = panel.Layout.measure(bars)
    sizes = _Sizes.measure(spine, bars)
    if not disturbed_instants(spine, bars, sizes).isEmpty():
        return _late_block(spine, bars, sectors, layout, config, sizes)
    rows = _global_rows(bars, sectors, layout)
    return _series_block(spine, bars, rows, sectors, layout, config, sizes)


def block_at(
    as_of: datetime, bars: DataFrame, sectors: DataFrame, config: FeatureConfig = FeatureConfig()
) -> DataFrame:
    """:func:`feature_block` of every symbol at one instant.

    The caller claims that ``bars`` are what was known at ``as_of``; a bar first seen later
    contradicts that and raises.
    """
    guards.refuse_leaks(bars, "first_seen_time", F.lit(as_of), ["symbol", "session"])
    spine = bars.select("symbol").distinct().withColumn("as_of", F.lit(as_of))
    return feature_block(spine, bars, sectors, config)
