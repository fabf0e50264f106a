"""Bars, returns and leave-one-out cross-section residuals.

One panel serves both the features and the forward labels, so the two can never be
demeaned against different cross-sections.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import guards, spread
from tidemark.functions.exprs import blank, all_failures, first_failure, loo_median, ticks
from tidemark.settings import settle_counted

BAR_COLUMNS = (
    "symbol", "feed", "session", "first_seen_time", "open", "high", "low", "close", "volume",
)


def bar_problems() -> list[tuple[Column, str]]:
    """What makes a bar malformed, in the order it is reported."""
    c = F.col
    return [
        (blank(c("symbol")), "symbol"),
        (blank(c("feed")), "feed"),
        (c("session").isNull(), "session"),
        (c("first_seen_time").isNull(), "first_seen_time"),
        (c("volume").isNull() | (c("volume") < 0), "volume"),
        (c("high") < c("low"), "high_below_low"),
        *[
            (c(n).isNull() | (c(n) <= 0), f"{n}_not_positive")
            for n in ("open", "high", "low", "close")
        ],
        *[
            ((c(n) < c("low")) | (c(n) > c("high")), f"{n}_outside_range")
            for n in ("open", "close")
        ],
    ]


def bar_rejects(bars: DataFrame) -> DataFrame:
    """Malformed bars with every reason."""
    return bars.withColumn("reasons", all_failures(bar_problems())).where(F.size("reasons") > 0)


def stored_bars(bars: DataFrame) -> DataFrame:
    """:func:`checked_bars` of a table that is written down on the way; the write does the checking."""
    first = first_failure(bar_problems())
    measures = guards.broken_rows(first.isNotNull(), ["symbol", "session"])
    held, found = settle_counted(bars.select(*BAR_COLUMNS), "bars", **measures)
    guards.refuse_observed(found, guards.IntegrityError, "malformed bar")
    return guards.collapse_duplicates(held, ["symbol", "session"])


def checked_bars(bars: DataFrame) -> DataFrame:
    """The panel once its bars are well formed and no session is described twice."""
    bars = bars.select(*BAR_COLUMNS)
    first = first_failure(bar_problems())
    guards.refuse(
        bars, first.isNotNull(), guards.IntegrityError, "malformed bar", ["symbol", "session"]
    )
    return guards.collapse_duplicates(bars, ["symbol", "session"])


@dataclass(frozen=True)
class Layout:
    """Which keys are too large for one task.  ``within`` are leading keys of every group."""

    by_symbol: bool
    by_session: bool
    within: tuple[str, ...] = ()

    @staticmethod
    def measure(bars: DataFrame, within: Sequence[str] = ()) -> "Layout":
        symbol, session = spread.is_heavy(bars, [*within, "symbol"], [*within, "session"])
        return Layout(symbol, session, tuple(within))

    @property
    def symbol_keys(self) -> list[str]:
        return [*self.within, "symbol"]

    @property
    def session_keys(self) -> list[str]:
        return [*self.within, "session"]


def moves(bars: DataFrame, layout: Layout) -> DataFrame:
    """Each bar with its position, close-to-close return, opening gap and true range.

    The return reaches back to the previous row of the symbol, however far that is.
    Prices are divided as whole ticks, so the quotient is the correctly rounded one.
    """
    keys = layout.symbol_keys
    placed = spread.numbered(bars, keys, ["session"], layout.by_symbol)
    laid, part = spread.in_blocks(placed, keys, layout.by_symbol, before=1)
    w = W.partitionBy(*part).orderBy("session")
    o, h, l, c = (ticks(F.col(n)) for n in ("open", "high", "low", "close"))
    prev = F.lag(ticks(F.col("close"))).over(w)
    laid = laid.withColumns(
        {
            "open_t": o, "high_t": h, "low_t": l, "close_t": c, "prev_t": prev,
            "prev_session": F.lag("session").over(w),
            "prev_seen": F.lag("first_seen_time").over(w),
        }
    ).where("_core")
    return laid.select(
        *layout.within, "symbol", "session", "first_seen_time", "volume", "pos", "prev_session",
        "high_t", "low_t", "close_t",
        F.when(F.col("prev_t").isNotNull(), F.greatest("first_seen_time", "prev_seen")).alias("move_seen"),
        *move_values(),
    )


def move_values() -> list[Column]:
    """Return, opening gap and true range of a row against ``prev_t``, all in ticks."""
    p = F.col("prev_t")
    reach = F.greatest(
        F.col("high_t") - F.col("low_t"), F.abs(F.col("high_t") - p), F.abs(F.col("low_t") - p)
    )
    return [
        (F.col("close_t") / p - 1.0).alias("ret"),
        (F.col("open_t") / p - 1.0).alias("gap"),
        F.when(p.isNotNull(), reach).alias("true_range"),
    ]


def leave_one_out(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], heavy: bool, tag: str
) -> DataFrame:
    """Add ``<value>_<tag>``: own value minus the median of the others in the group.

    Alone in its group, a value stays as it is and ``alone_<tag>`` is 1.  Only three order
    statistics of a group are needed for all its members, so nothing is paired or collected.
    """
    keys = list(keys)
    if not heavy:
        w = W.partitionBy(*keys)
        df = df.withColumns(
            {
                f"_rn_{v}": F.row_number().over(w.orderBy(F.col(v).asc_nulls_last()))
                for v in values
            }
            | {f"_n_{v}": F.count(v).over(w) for v in values}
        )
        at = lambda v, k: F.max(
            F.when(F.col(f"_rn_{v}") == F.floor(F.col(f"_n_{v}") / 2) + k, F.col(v))
        ).over(w)
        df = df.withColumns({f"_x{k}_{v}": at(v, k) for v in values for k in (0, 1, 2)})
    else:
        for v in values:
            stats = spread.middle_values(df, keys, v, True).toDF(
                *keys, f"_n_{v}", f"_x0_{v}", f"_x1_{v}", f"_x2_{v}"
            )
            df = spread.join_same(df, stats, keys, "left")
    made = {}
    for v in values:
        peer = loo_median(F.col(v), *[F.col(f"_{n}_{v}") for n in ("n", "x0", "x1", "x2")])
        made[f"{v}_{tag}"] = F.col(v) - F.coalesce(peer, F.lit(0.0))
    first = values[0]
    made[f"alone_{tag}"] = F.when(F.col(first).isNotNull(), (F.col(f"_n_{first}") <= 1).cast("int"))
    helpers = [f"_{n}_{v}" for v in values for n in ("rn", "n", "x0", "x1", "x2")]
    return df.withColumns(made).drop(*helpers)


def residuals(
    moved: DataFrame, sectors: DataFrame, layout: Layout, values: Sequence[str] = ("ret", "gap")
) -> DataFrame:
    """Both residual flavours per bar: against the sector (``_sec``) and the market (``_mkt``).

    The market pass runs first: its partitioning by session also serves the sector pass.
    ``seen_mkt`` and ``seen_sec`` are the latest instant at which any bar behind that
    session's cross-section was first seen, the member's own included.
    """
    mapped = moved.join(sectors, "symbol", "left")
    session = layout.session_keys
    sector = [*session, "sector"]
    heavy = layout.by_session
    out = leave_one_out(mapped, session, values, heavy, "mkt")
    out = leave_one_out(out, sector, values, heavy, "sec")
    if not heavy:
        return out.withColumns(
            {
                "seen_mkt": F.max("move_seen").over(W.partitionBy(*session)),
                "seen_sec": F.max("move_seen").over(W.partitionBy(*sector)),
            }
        )
    latest = mapped.groupBy(*sector).agg(F.max("move_seen").alias("seen_sec"))
    overall = latest.groupBy(*session).agg(F.max("seen_sec").alias("seen_mkt"))
    return spread.join_same(spread.join_same(out, latest, sector, "left"), overall, session, "left")
