"""Broker JSON feeds as typed rows, with the first defect named for rows that cannot be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import fixed
from tidemark.functions.exprs import first_failure
from tidemark.functions.fields import JsonFields

_ORDER_TIMES = ("created_at", "updated_at", "submitted_at", "filled_at")


def _either(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit("unknown"))


def orders(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Orders; a status outside the vocabulary reads as ``unknown``.

    Optional times must be present but may be null.
    """
    r = JsonFields(raw, column, ("status", "id", "client_order_id", "filled_qty", *_ORDER_TIMES))
    need = ("status", "id", "client_order_id")
    checks = [
        *[(r.missing(n) | r.not_text(n), n) for n in need],
        (r.missing("filled_qty") | r.not_number("filled_qty", fixed.NONNEGATIVE_DECIMAL_PATTERN), "filled_qty"),
        (r.exact("filled_qty").isNull(), "filled_qty"),
        (r.missing("created_at") | r.not_time("created_at", fixed.RFC3339_PATTERN), "created_at"),
    ]
    for n in _ORDER_TIMES[1:]:
        given = F.coalesce(r.kind(n) != "VOID", F.lit(False))
        checks.append((r.missing(n) | (given & r.not_time(n, fixed.RFC3339_PATTERN)), n))
    return r.df.withColumn("reject_field", first_failure(checks)).withColumns(
        {
            "broker_id": r.text("id"),
            "client_order_id": r.text("client_order_id"),
            "status": _either(r.text("status"), fixed.BROKER_STATUSES),
            "filled_quantity": r.exact("filled_qty"),
            **{n: r.time(n) for n in _ORDER_TIMES},
        }
    ).drop(*r.helpers)


def activities(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Fills with a quantity signed by their side."""
    r = JsonFields(
        raw, column, ("type", "side", "qty", "id", "order_id", "symbol", "price", "transaction_time")
    )
    side = r.text("side")
    checks = [
        (r.missing("type") | r.not_text("type"), "type"),
        (r.missing("side") | r.not_text("side") | ~F.coalesce(side.isin("buy", "sell"), F.lit(False)), "side"),
        (r.missing("qty") | r.not_number("qty", fixed.INTEGER_PATTERN), "qty"),
        (r.whole("qty").isNull() | (r.whole("qty") < 0), "qty"),
        *[(r.missing(n) | r.not_text(n), n) for n in ("id", "order_id", "symbol")],
        (r.missing("price") | r.not_number("price", fixed.DECIMAL_PATTERN), "price"),
        (r.exact("price").isNull(), "price"),
        (r.missing("transaction_time") | r.not_time("transaction_time", fixed.RFC3339_PATTERN), "transaction_time"),
    ]
    whole = r.whole("qty")
    signed = F.when(side == "buy", whole).when(side == "sell", -whole)
    return r.df.withColumn("reject_field", first_failure(checks)).withColumns(
        {
            "broker_id": r.text("id"),
            "order_id": r.text("order_id"),
            "activity_type": _either(r.text("type"), fixed.ACTIVITY_TYPES),
            "symbol": r.text("symbol"),
            "signed_quantity": signed,
            "price": r.exact("price"),
            "transaction_time": r.time("transaction_time"),
        }
    ).drop(*r.helpers)


def positions(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Signed positions; a sign that contradicts the side is a defect."""
    r = JsonFields(raw, column, ("side", "qty", "symbol", "avg_entry_price"))
    side, qty = r.text("side"), r.whole("qty")
    checks = [
        (r.missing("side") | r.not_text("side"), "side"),
        (r.missing("qty") | r.not_number("qty", fixed.INTEGER_PATTERN) | qty.isNull(), "qty"),
        (((side == "long") & (qty < 0)) | ((side == "short") & (qty > 0)), "qty_side_conflict"),
        (r.missing("symbol") | r.not_text("symbol"), "symbol"),
        (r.missing("avg_entry_price") | r.not_number("avg_entry_price", fixed.DECIMAL_PATTERN), "avg_entry_price"),
        (r.exact("avg_entry_price").isNull(), "avg_entry_price"),
    ]
    return r.df.withColumn("reject_field", first_failure(checks)).withColumns(
        {
            "symbol": r.text("symbol"),
            "signed_quantity": qty,
            "average_entry_price": r.exact("avg_entry_price"),
            "side": _either(side, fixed.POSITION_SIDES),
        }
    ).drop(*r.helpers)
