"""Running totals within groups of any size.

A window partitioned by the group would put a hot group into one task.  Rows are dealt by
ranges of (group, order) instead, so a group spans as many tasks as it needs; each range
adds the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.settings import settle


def running_total(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the group's rows up to and including each row.

    ``groups`` must hold no nulls.  Rows that tie in ``order`` are interchangeable.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(
        df.repartitionByRange(parts, *groups, *order).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        placed.groupBy(*groups, "_range")
        .agg(F.sum(value).alias("_here"))
        .select(*groups, "_range", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_ahead"))
    )
    inside = W.partitionBy(*groups, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.join(totals, [*groups, "_range"])
        .withColumn(name, F.col("_ahead") + F.sum(value).over(inside))
        .drop("_ahead", "_range")
    )
