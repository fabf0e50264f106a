"""Column expressions shared by the operators."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

MONEY_SCALE = 4
TICKS = 10_000


def blank(col: Column) -> Column:
    """True for NULL and for text without any visible character."""
    return F.coalesce(~col.rlike(r"\S"), F.lit(True))


def money(col: Column, precision: int = 18) -> Column:
    """Exact decimal at four places, rounded half to even; unparsable text is NULL."""
    return F.bround(col.try_cast(f"decimal(38,10)"), MONEY_SCALE).try_cast(
        f"decimal({precision},{MONEY_SCALE})"
    )


def ticks(col: Column) -> Column:
    """Money as a whole number of 1/10000 units, exact in double arithmetic below 2**53."""
    return (col * TICKS).cast("long")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    """Instant arithmetic in microseconds, independent of the session's calendar and zone."""
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("long") * F.lit(1_000_000))


DAY_SECONDS = 86_400
_MICROS = {"hour": 3_600_000_000, "day": DAY_SECONDS * 1_000_000}


def utc_day(ts: Column) -> Column:
    """The UTC calendar day of an instant, whatever the session's zone is."""
    micros = F.unix_micros(ts)
    whole = micros - F.pmod(micros, F.lit(_MICROS["day"]))
    return F.date_from_unix_date((whole / _MICROS["day"]).cast("int"))


def day_start(day: Column) -> Column:
    """The first instant of a UTC calendar day."""
    return F.timestamp_seconds(F.unix_date(day).cast("long") * DAY_SECONDS)


def utc_floor(ts: Column, unit: str) -> Column:
    """The start of the UTC hour, day, week (from Monday) or month that holds an instant."""
    if unit in _MICROS:
        micros = F.unix_micros(ts)
        return F.timestamp_micros(micros - F.pmod(micros, F.lit(_MICROS[unit])))
    return day_start(F.trunc(utc_day(ts), unit).cast("date"))


def utc_text(ts: Column, between: str = " ") -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of an instant in UTC, by whole-number arithmetic."""
    micros = F.unix_micros(ts)
    second = F.floor(F.pmod(micros, F.lit(_MICROS["day"])) / 1_000_000).cast("int")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(second / 3600)), two(F.floor(second / 60) % 60), two(second % 60))
    return F.when(ts.isNotNull(), F.concat(utc_day(ts).cast("string"), F.lit(between), clock))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with a +00:00 offset; the fraction appears only when it is not zero."""
    fraction = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(
        utc_text(ts, "T"),
        F.when(fraction == 0, F.lit("")).otherwise(
            F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))
        ),
        F.lit("+00:00"),
    )


def sorted_map(col: Column) -> Column:
    """A map with its entries in key order, so its JSON text is stable."""
    return F.map_from_entries(F.array_sort(F.map_entries(col)))


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """Compact JSON with keys in sorted order; NULL fields stay as null."""
    body = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.to_json(body, {"ignoreNullFields": "false"})


def config_version(prefix: str, body: Mapping[str, object]) -> str:
    """A short address of a frozen configuration."""
    text = json.dumps(dict(body), sort_keys=True, separators=(",", ":"))
    return f"{prefix}-{hashlib.sha256(text.encode('utf-8')).hexdigest()[:16]}"


def first_failure(checks: Sequence[tuple[Column, str]]) -> Column:
    """The name of the first failing check, NULL when none fails."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for failed, name in checks])


def all_failures(checks: Sequence[tuple[Column, str]]) -> Column:
    """Every failing check, in the given order."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for failed, name in checks]))


def flag_list(*flags: Column) -> Column:
    """Sorted distinct flags; a NULL entry is an absent flag."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*flags))))


def sign(col: Column) -> Column:
    return F.when(col > 0, 1).when(col < 0, -1).otherwise(0)


def loo_median(value: Column, n: Column, low: Column, mid: Column, high: Column) -> Column:
    """Median of a group without one member's own value.

    ``n`` counts the group with the member.  ``low, mid, high`` are the consecutive
    order statistics starting at ``floor(n / 2)``: removing one value shifts the middle
    by at most one place, so three values decide the result for every member.
    NULL when nobody else is in the group.
    """
    first = F.when(value > low, low).otherwise(mid)
    second = F.when(value > mid, mid).otherwise(high)
    return F.when(n <= 1, F.lit(None).cast("double")).otherwise(
        F.when((n - 1) % 2 == 1, first).otherwise((first + second) / 2)
    )


def r6(col: Column) -> Column:
    """Six decimals, never minus zero: the form results are compared in."""
    return F.round(col, 6) + F.lit(0.0)
