"""Recording raw observations and reading them as of an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from tidemark.functions import guards
from tidemark.functions.exprs import blank, canonical_json, first_failure, iso_utc, plus_seconds, sorted_map, utc_day
from tidemark.settings import max_broadcast_rows

STAMPS = ("event_time", "first_seen_time", "source_time", "received_time", "as_of")


class Rejected(ValueError):
    """A request names a feed nobody registered or stored."""


def checked_policies(policies: DataFrame) -> DataFrame:
    """Feed policies, refused when one is repeated, blank or contradicts itself."""
    c = F.col
    guards.refuse_repeats(policies, ["feed"], guards.IntegrityError, "feed registered twice")
    if policies.isEmpty():
        raise guards.IntegrityError("a recorder needs at least one feed policy")
    proves, lag = c("proves_delivery_time"), c("lag_seconds")
    wrong = (
        blank(F.col("feed"))
        | (lag < 0)
        | (proves & (lag != 0))
        | (~proves & (lag == 0))
    )
    guards.refuse(policies, wrong, guards.IntegrityError, "feed policy contradicts itself", ["feed"])
    return policies


def judged_observations(raw: DataFrame, policies: DataFrame) -> DataFrame:
    """Every raw row with its derived availability, address and first failing field.

    ``reject_field`` is NULL for an acceptable row.  The feed's policy decides whether
    ``first_seen_time`` must be given or is derived from the source time plus the lag.
    """
    policies = checked_policies(policies)
    small = policies.limit(max_broadcast_rows(raw.sparkSession) + 1).count()
    if small <= max_broadcast_rows(raw.sparkSession):
        policies = F.broadcast(policies)
    # Works on a stream as well: one static join and column expressions.
    rows = raw.withColumnRenamed("first_seen_time", "_given").join(policies, "feed", "left")
    c = F.col
    proves = c("proves_delivery_time")
    rows = rows.withColumn(
        "first_seen_time",
        F.when(proves, c("_given")).otherwise(plus_seconds(c("source_time"), c("lag_seconds"))),
    )
    seen = c("first_seen_time")
    reject = first_failure(
        [
            (blank(F.col("feed")), "feed"),
            (proves.isNull(), "feed"),
            (blank(F.col("subject_id")), "subject_id"),
            *[(c(n).isNull(), n) for n in ("event_time", "source_time", "received_time", "as_of")],
            (F.coalesce(F.size("payload") <= 0, F.lit(True)), "payload"),
            (F.exists(F.map_values("payload"), lambda v: v.isNull()), "payload"),
            (proves & c("_given").isNull(), "first_seen_time"),
            (~proves & c("_given").isNotNull(), "first_seen_time"),
            (seen < c("source_time"), "first_seen_time"),
            (c("received_time") < c("source_time"), "received_time"),
            (proves & (seen < c("received_time")), "first_seen_time"),
            (seen > c("as_of"), "first_seen_time"),
            ((c("event_time") > seen) & ~c("event_time_may_follow_first_seen"), "event_time"),
        ]
    )
    flags = F.when(proves, F.array().cast("array<string>")).otherwise(
        F.array(F.lit("availability_lag_applied"))
    )
    made = rows.withColumns(
        {
            "reject_field": reject,
            "availability_lag_seconds": F.when(proves, F.lit(0).cast("bigint")).otherwise(c("lag_seconds")),
            "quality_flags": flags,
        }
    )
    extra = [n for n in raw.columns if n not in ("feed", "subject_id", "payload", *STAMPS)]
    return made.select(
        F.when(c("reject_field").isNull(), observation_id()).alias("observation_id"),
        "feed", "subject_id", *STAMPS, "payload", "quality_flags", "availability_lag_seconds",
        "reject_field", *extra,
    )


def observation_id() -> Column:
    """Address of the whole content: canonical JSON with sorted keys, SHA-256."""
    fields = {n: iso_utc(F.col(n)) for n in STAMPS} | {
        "feed": F.col("feed"),
        "subject_id": F.col("subject_id"),
        "availability_lag_seconds": F.col("availability_lag_seconds"),
        "quality_flags": F.col("quality_flags"),
        "payload": sorted_map(F.col("payload")),
    }
    return F.sha2(canonical_json(fields), 256)


def accepted(judged: DataFrame) -> DataFrame:
    """Acceptable rows, each content once."""
    return judged.where("reject_field is null").drop("reject_field").dropDuplicates(["observation_id"])


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where("reject_field is not null")


def record(judged: DataFrame, path: str) -> None:
    """Append what the store does not hold yet; recording again changes nothing.

    The store is Parquet by feed and day of first sight, so a point-in-time read prunes
    whole folders.
    """
    spark = judged.sparkSession
    fine = judged.where("reject_field is null").drop("reject_field")
    fresh = fine.withColumn("seen_on", utc_day(F.col("first_seen_time")))
    held = stored(spark, path)
    if held is not None:
        # Equal contents share feed and day, so only the batch's own folders are read.  What is
        # held goes first: neither the list of folders nor a repeat pays for deduplication.
        same = ["feed", "seen_on", "observation_id"]
        fresh = fresh.join(in_folders_of(held, fresh).select(*same), same, "left_anti")
    # Rebalancing gathers a folder's rows into few files and still splits a folder that is
    # too large for one task.
    laid = fresh.dropDuplicates(["observation_id"]).hint("rebalance", "feed", "seen_on")
    laid.write.mode("append").partitionBy("feed", "seen_on").parquet(path)


def in_folders_of(store: DataFrame, batch: DataFrame, most: int = 10_000) -> DataFrame:
    """The store's rows in the feeds and days of the batch.

    Up to ``most`` folders are listed one by one; beyond that the span of days selects.
    """
    days = batch.select("feed", "seen_on").distinct()
    listed = days.limit(most + 1).collect()
    if len(listed) > most:
        span = days.agg(F.min("seen_on").alias("a"), F.max("seen_on").alias("b")).first()
        return store.where(F.col("seen_on").between(F.lit(span.a), F.lit(span.b)))
    by_feed: dict[str, list] = {}
    for row in listed:
        by_feed.setdefault(row.feed, []).append(row.seen_on)
    chosen = F.lit(False)
    for feed, dates in sorted(by_feed.items()):
        chosen = chosen | ((F.col("feed") == feed) & F.col("seen_on").isin(sorted(dates)))
    return store.where(chosen)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The store, or None while nothing was recorded.

    Folder names hold text: they are read as such and ``seen_on`` is cast, so a feed named by
    digits keeps its name.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return None
    found = spark.read.parquet(path).schema
    kinds = {"feed": StringType(), "seen_on": DateType()}
    known = StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in found])
    return spark.read.schema(known).parquet(path)


def read_as_of(
    store: DataFrame, as_of: Column, feed: str | None = None, subject_id: str | None = None,
    policies: DataFrame | None = None,
) -> DataFrame:
    """Rows first seen at or before ``as_of``; an empty answer stays empty.

    Asking for a feed that is neither registered nor stored raises.
    """
    rows = store
    if feed is not None:
        known = policies is not None and not policies.where(F.col("feed") == feed).isEmpty()
        if not feed.strip() or not (known or not store.where(F.col("feed") == feed).isEmpty()):
            raise Rejected(f"{feed!r} is neither a registered feed nor present in the store")
        rows = rows.where(F.col("feed") == feed)
    if "seen_on" in store.columns:
        rows = rows.where(F.col("seen_on") <= utc_day(as_of))
    rows = rows.where(F.col("first_seen_time") <= as_of)
    if subject_id is not None:
        rows = rows.where(F.col("subject_id") == subject_id)
    return rows


def normalised_raw(
    landed: DataFrame, lag_seconds: int, adjustment: str, asof: str
) -> DataFrame:
    """Landed market records as raw facts.

    ``first_seen_time`` is the source time plus the feed's documented lag; a revision is a
    second fact keyed by both its stamps; how prices were adjusted and as of which date is
    recorded on every row.
    """
    if lag_seconds <= 0 or not adjustment.strip() or not asof.strip():
        raise ValueError("lag, adjustment and asof are always explicit")
    return landed.withColumns(
        {
            "source_time": F.coalesce("updated_at", "created_at"),
            "is_revision": F.coalesce(F.col("updated_at") > F.col("created_at"), F.lit(False)),
            "adjustment": F.lit(adjustment),
            "adjusted_as_of": F.lit(asof).cast("date"),
        }
    ).withColumn("first_seen_time", plus_seconds(F.col("source_time"), F.lit(lag_seconds)))


def uncovered(requested: DataFrame, landed: DataFrame) -> DataFrame:
    """Requested symbols for which nothing landed."""
    return requested.select("symbol").distinct().join(landed, "symbol", "left_anti")
