"""Reconciling recorded intents with broker truth, one report per book.

Every table carries ``book``: the scope one report covers.  A snapshot that could not be
read is passed as None; it is a fact of its own, never an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import fixed

UNAVAILABLE = "broker_truth_unavailable"
BLOCKING_STATES = tuple(s for s in fixed.ORDER_STATES if s != "reconciled")


def broker_state(status: Column) -> Column:
    """The order state a broker status means; NULL when it means none."""
    out = F.lit(None).cast("string")
    for name, state in fixed.BROKER_STATE.items():
        out = F.when(status == name, F.lit(state)).otherwise(out)
    return out


def _decided(attempts: DataFrame, orders: DataFrame | None, nothing: Column) -> DataFrame:
    if orders is None:
        found = attempts.withColumns({"status": F.lit(None).cast("string"), "_found": F.lit(None).cast("boolean")})
    else:
        held = orders.select("book", "client_order_id", "status", F.lit(True).alias("_found"))
        found = attempts.join(held, ["book", "client_order_id"], "left").withColumn(
            "_found", F.coalesce("_found", F.lit(False))
        )
    c = F.col
    state = broker_state(c("status"))
    outcome = (
        F.when(c("attempt_id").isNull(), F.struct(F.lit("block").alias("action"), F.lit("submission_attempt_record_required").alias("reason")))
        .when(
            ~c("attempt_order_id").eqNullSafe(c("client_order_id")),
            F.struct(F.lit("block").alias("action"), F.lit("submission_attempt_record_mismatch").alias("reason")),
        )
        .when(c("_found").isNull(), F.struct(F.lit("block").alias("action"), F.lit(UNAVAILABLE).alias("reason")))
        .when(~c("_found"), nothing)
        .when(state.isNull(), F.struct(F.lit("block").alias("action"), F.lit("unknown_order_state").alias("reason")))
        .otherwise(F.struct(F.lit("adopt_existing").alias("action"), F.lit(None).cast("string").alias("reason")))
    )
    return found.withColumn("_o", outcome).withColumns(
        {
            "action": c("_o.action"),
            "reason": c("_o.reason"),
            "state": F.when(c("_o.action") == "adopt_existing", state),
        }
    ).drop("_o", "_found")


def submission_decisions(attempts: DataFrame, orders: DataFrame | None) -> DataFrame:
    """Before first transport: submit, adopt what the broker already has, or block.

    ``attempts``: book, client_order_id, attempt_id, attempt_order_id.
    """
    return _decided(
        attempts, orders,
        F.struct(F.lit("submit").alias("action"), F.lit(None).cast("string").alias("reason")),
    )


def recovery_decisions(attempts: DataFrame, orders: DataFrame | None) -> DataFrame:
    """After transport: adopt broker truth or block; never submit."""
    return _decided(
        attempts, orders,
        F.struct(F.lit("block").alias("action"), F.lit("ambiguous_submission").alias("reason")),
    )


def unexplained_orders(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Orders of a broker's list that no recorded intent explains.

    A report hands in the list of open orders, for which a closed order that nobody knows is no
    reason; an audit hands in all of them.
    """
    return listed.join(known.select("book", "client_order_id"), ["book", "client_order_id"], "left_anti")


def covered_symbols(known: DataFrame) -> DataFrame:
    return known.select("book", F.explode("covered_symbols").alias("symbol")).distinct()


def unexplained_positions(
    positions: DataFrame, known: DataFrame, orders: DataFrame | None, activities: DataFrame | None
) -> DataFrame:
    """Positions in a symbol nobody covers, or no fill of a known order accounts for.

    Attribution is judged only when both orders and activities could be read.
    """
    covered = covered_symbols(known).withColumn("_covered", F.lit(True))
    rows = positions.join(covered, ["book", "symbol"], "left")
    unexplained = F.col("_covered").isNull()
    if orders is not None and activities is not None:
        ids = orders.join(known.select("book", "client_order_id"), ["book", "client_order_id"], "left_semi")
        fills = (
            activities.join(
                ids.select("book", F.col("broker_id").alias("order_id")), ["book", "order_id"], "left_semi"
            )
            .select("book", "symbol").distinct().withColumn("_filled", F.lit(True))
        )
        rows = rows.join(fills, ["book", "symbol"], "left")
        unexplained = unexplained | F.col("_filled").isNull()
    return rows.where(unexplained).select(*positions.columns)


def report(
    known: DataFrame, orders: DataFrame | None, open_orders: DataFrame | None,
    positions: DataFrame | None, activities: DataFrame | None,
) -> DataFrame:
    """One row per book: distinct reasons and whether new entries are blocked.

    ``orders`` answers lookups of single orders, ``open_orders`` is the snapshot of open ones.
    """
    decided = recovery_decisions(known, orders)
    reason = F.when(F.col("action") == "block", F.col("reason")).when(
        F.col("state").isin(*BLOCKING_STATES), F.lit("order_not_reconciled")
    )
    told = decided.select("book", reason.alias("reason")).where("reason is not null").distinct()
    books = known.select("book")
    for snapshot in (orders, open_orders, positions, activities):
        if snapshot is not None:
            books = books.unionByName(snapshot.select("book"))
    books = books.distinct()
    if any(x is None for x in (orders, open_orders, positions, activities)):
        told = told.unionByName(books.select("book", F.lit(UNAVAILABLE).alias("reason")))
    if open_orders is not None:
        told = told.unionByName(
            unexplained_orders(open_orders, known).select("book", F.lit("unexplained_order").alias("reason")).distinct()
        )
    if positions is not None:
        loose = unexplained_positions(positions, known, orders, activities)
        told = told.unionByName(loose.select("book", F.lit("unexplained_position").alias("reason")).distinct())
    reasons = told.groupBy("book").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    out = books.join(reasons, "book", "left").withColumn(
        "reasons", F.coalesce("reasons", F.array().cast("array<string>"))
    )
    return out.withColumn("blocks_new_entries", F.size("reasons") > 0)


def still_open(known: DataFrame, positions: DataFrame | None) -> DataFrame:
    """``book, symbol``: the covered symbols still open, all of them without a position snapshot."""
    covered = covered_symbols(known)
    if positions is None:
        return covered
    return covered.join(positions.where("signed_quantity != 0").select("book", "symbol").distinct(), ["book", "symbol"], "left_semi")


def flatten_report(known: DataFrame, orders: DataFrame | None, positions: DataFrame | None) -> DataFrame:
    """Per book the covered symbols still open, and every reason not to call it flat.

    Without a position snapshot every covered symbol counts as open.
    """
    decided = recovery_decisions(known, orders).where("action = 'block'").select("book", "reason").distinct()
    still = still_open(known, positions)
    if positions is None:
        extra = known.select("book", F.lit(UNAVAILABLE).alias("reason")).distinct()
    else:
        extra = still.select("book", F.lit("position_still_open").alias("reason")).distinct()
    reasons = decided.unionByName(extra).groupBy("book").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    counts = still.groupBy("book").agg(
        F.count("*").alias("still_open"), F.min("symbol").alias("first_open_symbol")
    )
    none = F.array().cast("array<string>")
    return (
        known.select("book").distinct().join(reasons, "book", "left").join(counts, "book", "left")
        .select(
            "book", F.coalesce("reasons", none).alias("reasons"),
            F.coalesce("still_open", F.lit(0)).alias("still_open"), "first_open_symbol",
            (F.size(F.coalesce("reasons", none)) > 0).alias("blocks_new_entries"),
        )
    )
