"""Forward residual labels, their outcome instants, and overlap weights."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions import guards, spread
from tidemark.functions.exprs import config_version, flag_list, iso_utc
from tidemark.operators import panel


class InsufficientHistory(ValueError):
    """The panel ends before the session an entry would have filled on."""


@dataclass(frozen=True)
class LabelConfig:
    horizon_sessions: int = 5
    entry_offset_sessions: int = 1
    min_sector_peers: int = 2
    implausible_return: float = 0.5

    def __post_init__(self) -> None:
        if self.horizon_sessions <= 0 or self.entry_offset_sessions < 0:
            raise ValueError("horizon must be positive and the entry offset not negative")
        if self.min_sector_peers < 1 or not self.implausible_return > 0.0:
            raise ValueError("min_sector_peers and implausible_return must be positive")

    @property
    def version(self) -> str:
        return config_version("lbl", asdict(self))


def forward_labels(
    decisions: DataFrame,
    bars: DataFrame,
    sectors: DataFrame,
    config: LabelConfig = LabelConfig(),
    strict: bool = True,
) -> DataFrame:
    """One row per decision (symbol, decision_session) with its label or why there is none.

    ``status`` is ``labelled``, ``no_history``, ``delisted``, ``incomplete_horizon`` or
    ``panel_too_short``; with ``strict`` the last one raises.  Labels may see the future:
    ``outcome_time`` is the instant the last bar they consumed was first seen.
    """
    layout = panel.Layout.measure(bars)
    rows = panel.residuals(panel.moves(bars, layout), sectors, layout, ("ret",))
    members = (
        bars.select("symbol").distinct().join(sectors, "symbol").groupBy("sector")
        .agg((F.count("*") - 1).alias("sector_peers"))
    )
    rows = rows.join(members, "sector", "left")
    fallback = F.col("sector").isNull() | (F.col("sector_peers") < config.min_sector_peers)
    either = lambda n: F.when(fallback, F.col(f"{n}_mkt")).otherwise(F.col(f"{n}_sec"))
    rows = rows.withColumns(
        {
            "_fallback": fallback, "_value": either("ret"),
            "_alone": either("alone"), "_seen": either("seen"),
        }
    )
    offset, horizon = config.entry_offset_sessions, config.horizon_sessions
    rows, part = spread.in_blocks(
        rows, layout.symbol_keys, layout.by_symbol, before=0, after=offset + horizon
    )
    w = W.partitionBy(*part).orderBy("session")
    held = w.rowsBetween(offset + 1, offset + horizon)
    rows = rows.withColumns(
        {
            "entry_session": F.lead("session", offset).over(w),
            "exit_session": F.lead("session", offset + horizon).over(w),
            "forward": F.sum("_value").over(held),
            "undemeaned": F.sum("_alone").over(held),
            "outcome_time": F.max("_seen").over(held),
            "outcome_sessions": F.collect_list("session").over(held),
        }
    ).where("_core")
    facts = F.struct(
        "pos", "entry_session", "exit_session", "forward", "undemeaned", "outcome_time",
        "outcome_sessions", F.col("_fallback").alias("fallback"),
    )
    point = rows.select(
        "symbol", F.col("session").alias("prediction_time"), F.lit(0).alias("_asked"),
        facts.alias("own"),
    )
    asked = decisions.select(
        "symbol", F.col("decision_session").alias("prediction_time"), F.lit(1).alias("_asked"),
        F.lit(None).cast(point.schema["own"].dataType).alias("own"),
    ).distinct()
    carried = spread.last_known(
        point.unionByName(asked), ["symbol"], ["prediction_time", "_asked"], layout.by_symbol, "own"
    )
    ends = bars.groupBy("symbol").agg(F.max("session").alias("_last"))
    panel_last = bars.agg(F.unix_micros(F.max("session"))).first()[0]
    found = carried.where("_asked = 1").join(ends, "symbol", "left").select(
        "symbol", "prediction_time", "_last", "own.*"
    )
    c = F.col
    status = (
        F.when(c("pos").isNull(), "no_history")
        .when(
            c("entry_session").isNull(),
            F.when(c("_last") < F.timestamp_micros(F.lit(panel_last)), "delisted").otherwise("panel_too_short"),
        )
        .when(c("exit_session").isNull(), "incomplete_horizon")
        .otherwise("labelled")
    )
    found = found.withColumn("status", status)
    if strict:
        guards.refuse(
            found, c("status") == "panel_too_short", InsufficientHistory,
            "the panel ends before the entry session", ["symbol", "prediction_time"],
        )
    done = c("status") == "labelled"
    only = lambda col: F.when(done, col)
    address = F.concat_ws("|", "symbol", iso_utc(c("prediction_time")), F.lit(config.version))
    flags = flag_list(
        F.when(c("fallback"), F.lit("sector_fallback_market")),
        F.when(c("undemeaned") > 0, F.concat(F.lit("no_peer_data:"), c("undemeaned").cast("string"))),
        F.lit("untradeable_entry") if offset == 0 else F.lit(None).cast("string"),
        F.when(F.abs("forward") > config.implausible_return, F.lit("implausible_magnitude")),
    )
    return found.select(
        F.concat(F.lit("lbl-"), F.substring(F.sha2(address, 256), 1, 20)).alias("label_id"),
        "symbol", "prediction_time", "status",
        *[only(c(n)).alias(n) for n in ("outcome_time", "entry_session", "exit_session")],
        only(c("forward")).alias("forward_residual_return"),
        only(F.lit(horizon)).alias("sessions_used"),
        only(c("pos") + offset + 1).alias("first_outcome"),
        only(c("outcome_sessions")).alias("outcome_sessions"),
        only(F.lit(1.0)).alias("uniqueness"),
        only(flags).alias("quality_flags"),
        F.lit(config.version).alias("label_version"),
    )


def labelled(found: DataFrame) -> DataFrame:
    """Only the decisions that have a label."""
    return found.where("status = 'labelled'").drop("status")


def with_uniqueness(labels: DataFrame) -> DataFrame:
    """Weigh each label by the average of 1 / labels open on its own outcome sessions.

    A label is open on the ``sessions_used`` positions of its symbol from ``first_outcome`` on.
    Ends of these spans are swept in order: the running sum of +1 and -1 is the number open until
    the next end, the running sum of its reciprocals over the positions passed is read at both ends
    of a label.  The work does not depend on the horizon.  Concurrency counts labels of the same
    symbol.  A repeated label id raises.
    """
    guards.refuse_repeats(labels, ["label_id"], guards.IntegrityError, "label appears more than once")
    c = F.col
    last = c("first_outcome") + c("sessions_used")
    ends = labels.select(
        "label_id", "symbol",
        F.explode(F.array(
            F.struct(c("first_outcome").alias("at"), F.lit(1).alias("step")),
            F.struct(last.alias("at"), F.lit(-1).alias("step")),
        )).alias("_end"),
    ).select("label_id", "symbol", "_end.*")
    [heavy] = spread.is_heavy(labels, ["symbol"])
    swept = ends.groupBy("symbol", "at").agg(F.sum("step").alias("step"))
    swept = spread.running(swept, ["symbol"], ["at"], heavy, {"open": ("sum", c("step"))})
    swept = spread.numbered(swept, ["symbol"], ["at"], heavy, "n")
    laid, part = spread.in_blocks(swept, ["symbol"], heavy, before=1, pos="n")
    w = W.partitionBy(*part).orderBy("at")
    passed = F.try_divide(c("at") - F.lag("at").over(w), F.lag("open").over(w))
    laid = laid.withColumn("_passed", F.coalesce(passed, F.lit(0.0))).where("_core").select("symbol", "at", "_passed")
    summed = spread.running(laid, ["symbol"], ["at"], heavy, {"_sum": ("sum", c("_passed"))})
    shares = (
        ends.join(summed, ["symbol", "at"]).groupBy("label_id")
        .agg(F.sum(-c("step") * c("_sum")).alias("_share"))
    )
    return (
        labels.join(shares, "label_id", "left")
        .withColumn("uniqueness", F.coalesce(F.try_divide("_share", "sessions_used"), "uniqueness"))
        .drop("_share")
    )
