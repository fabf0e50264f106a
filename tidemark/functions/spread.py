"""Ordered and ranked work over keys of any size.

A window partitioned by a key puts that key's rows into one task.  That is the right
plan for keys of ordinary size.  For keys above ``spark.tidemark.maxGroupRows`` the
functions here take a split form with the same result: rows are dealt by ranges of the key
and the whole order, small summaries per range are combined, and each range is finished
alone.  A key spans as many ranges as its rows need, so the number of ranges follows
``spark.sql.shuffle.partitions`` and with it the size of the data.  Ranges only balance the
work; no result depends on where they lie.  They are written down once (``settle``) so every
use within a plan sees the same ones.  NULL keys are keys like any other and NULL order
values come first, in both forms.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.settings import known_rows, max_group_rows, settle

_measured: dict[tuple, int] = {}


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where NULL equals NULL; keeps the left side's key columns."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def largest_group(df: DataFrame, *key_sets: Sequence[str]) -> list[int]:
    """Rows of the largest group for each key set, in one job.

    Asked again for the same plan the answer is remembered: it only chooses between two forms
    with the same result.
    """
    app, plan = df.sparkSession.sparkContext.applicationId, df.semanticHash()
    names = [(app, plan, tuple(keys)) for keys in key_sets]
    missing = [i for i, name in enumerate(names) if name not in _measured]
    counted = None
    for index in missing:
        one = (
            df.groupBy(*key_sets[index])
            .count()
            .agg(F.max("count").alias("n"))
            .select(F.lit(index).alias("i"), F.coalesce("n", F.lit(0)).alias("n"))
        )
        counted = one if counted is None else counted.unionByName(one)
    if counted is not None:
        _measured.update({names[row.i]: row.n for row in counted.collect()})
    return [_measured[name] for name in names]


def is_heavy(df: DataFrame, *key_sets: Sequence[str]) -> list[bool]:
    """Whether a group outgrows one task.  A table known to be within the limit is not measured."""
    limit, rows = max_group_rows(df.sparkSession), known_rows(df)
    if rows is not None and rows <= limit:
        return [False] * len(key_sets)
    return [n > limit for n in largest_group(df, *key_sets)]


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Deal rows by ranges of key and order; ``_piece`` numbers the ranges, written down."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, *order)
    return settle(dealt.withColumn("_piece", F.spark_partition_id()), "pieces")


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], heavy: bool, name: str = "pos"
) -> DataFrame:
    """Position within the key from 1, by ``order`` (a total order)."""
    keys = list(keys)
    if not heavy:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    pieced = in_ranges(df, keys, order)
    ahead = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        pieced.groupBy(*keys, "_piece")
        .count()
        .withColumn("_ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
        .drop("count")
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_piece").orderBy(*order))
    return (
        join_same(pieced.withColumn("_inside", inside), offsets, [*keys, "_piece"])
        .withColumn(name, (F.col("_inside") + F.col("_ahead")).cast("long"))
        .drop("_inside", "_ahead", "_piece")
    )


def in_blocks(
    df: DataFrame, keys: Sequence[str], heavy: bool, before: int, after: int = 0, pos: str = "pos"
) -> tuple[DataFrame, list[str]]:
    """Prepare ``df`` for row frames of at most ``before``/``after`` rows.

    Returns the frame and the columns to partition windows by.  In the split form the
    rows near a block edge are copied into the neighbouring block so frames are complete
    for every row marked ``_core``; filter on it after the frames are evaluated.
    """
    if not heavy:
        return df.withColumn("_core", F.lit(True)), list(keys)
    rows = max(max_group_rows(df.sparkSession), before, after, 1)
    own = F.floor((F.col(pos) - 1) / rows)
    place = F.col(pos) - 1 - own * rows
    targets = F.array_compact(
        F.array(
            own,
            F.when(place >= rows - before, own + 1) if before else F.lit(None).cast("bigint"),
            F.when((place < after) & (own > 0), own - 1),
        )
    )
    laid = (
        df.withColumn("_own", own)
        .withColumn("_blk", F.explode(targets))
        .withColumn("_core", F.col("_blk") == F.col("_own"))
        .drop("_own")
    )
    return laid, [*keys, "_blk"]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    heavy: bool,
    totals: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` up to and including each row."""
    combine = {"sum": F.sum, "max": F.max, "min": F.min}
    keys = list(keys)
    if not heavy:
        frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({n: combine[kind](c).over(frame) for n, (kind, c) in totals.items()})
    pieced = in_ranges(
        df.withColumns({f"_in_{n}": c for n, (_, c) in totals.items()}), keys, order
    )
    ahead = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    per_piece = pieced.groupBy(*keys, "_piece").agg(
        *[combine[kind](f"_in_{n}").alias(f"_all_{n}") for n, (kind, _) in totals.items()]
    )
    carried = per_piece.select(
        *keys,
        "_piece",
        *[
            combine[kind](f"_all_{n}").over(ahead).alias(f"_carry_{n}")
            for n, (kind, _) in totals.items()
        ],
    )
    frame = W.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = pieced.withColumns(
        {n: combine[kind](f"_in_{n}").over(frame) for n, (kind, _) in totals.items()}
    )
    within = join_same(summed, carried, [*keys, "_piece"])
    joined = {
        "sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(
            F.coalesce(a, b - b) + F.coalesce(b, a - a)
        ),
        "max": F.greatest,
        "min": F.least,
    }
    out = within.withColumns(
        {n: joined[kind](F.col(n), F.col(f"_carry_{n}")) for n, (kind, _) in totals.items()}
    )
    return out.drop(
        "_piece", *[f"_in_{n}" for n in totals], *[f"_carry_{n}" for n in totals]
    )


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], heavy: bool, column: str
) -> DataFrame:
    """Replace ``column`` by its last non-NULL value up to each row (an as-of carry)."""
    keys = list(keys)
    if not heavy:
        frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(column, F.last(column, ignorenulls=True).over(frame))
    pieced = in_ranges(df, keys, order)
    frame = W.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    held = F.col(column).isNotNull()
    ahead = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        pieced.groupBy(*keys, "_piece")
        .agg(F.max_by(F.when(held, F.col(column)), F.when(held, F.struct(*order))).alias("_end"))
        .withColumn("_carry", F.last("_end", ignorenulls=True).over(ahead))
        .drop("_end")
    )
    inside = pieced.withColumn(column, F.last(column, ignorenulls=True).over(frame))
    return (
        join_same(inside, carried, [*keys, "_piece"])
        .withColumn(column, F.coalesce(F.col(column), F.col("_carry")))
        .drop("_piece", "_carry")
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    heavy: bool,
    ranks: Mapping[str, Callable[[Column], Column]],
) -> DataFrame:
    """Exact order statistics per group: ``keys, n`` and one column per requested rank.

    Each rank is a function of the group's non-NULL count, from 1.  A rank outside the
    group gives NULL.  In the split form only the ranges holding a wanted rank are ordered.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull()).select(*keys, value)
    w = W.partitionBy(*keys)
    wanted = {name: rank(F.col("n")).cast("long") for name, rank in ranks.items()}
    if not heavy:
        ranked = present.withColumn("_to", F.row_number().over(w.orderBy(value))).withColumn(
            "n", F.count(value).over(w)
        )
        ranked = ranked.withColumn("_copies", F.lit(1))
    else:
        # Copies of one value collapse before they are dealt, so no value fills a range.
        values = present.groupBy(*keys, value).agg(F.count("*").alias("_copies"))
        pieced = in_ranges(values, keys, [value])
        ahead = w.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
        ranges = (
            pieced.groupBy(*keys, "_piece")
            .agg(F.sum("_copies").alias("_here"))
            .withColumn("_ahead", F.coalesce(F.sum("_here").over(ahead), F.lit(0)))
            .withColumn("n", F.sum("_here").over(w))
        )
        holds = F.lit(False)
        for rank in wanted.values():
            holds = holds | ((rank > F.col("_ahead")) & (rank <= F.col("_ahead") + F.col("_here")))
        # One row per range keeps the group in the result even when no rank falls into it.
        few = join_same(pieced, ranges.where(holds | (F.col("_ahead") == 0)), [*keys, "_piece"])
        upto = W.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        ranked = few.withColumn("_to", F.col("_ahead") + F.sum("_copies").over(upto))
    at = lambda rank: (rank <= F.col("_to")) & (rank > F.col("_to") - F.col("_copies"))
    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(at(rank), F.col(value))).alias(name) for name, rank in wanted.items()],
    )


def middle_values(df: DataFrame, keys: Sequence[str], value: str, heavy: bool) -> DataFrame:
    """Per group: ``n`` and the order statistics ``low, mid, high`` from ``floor(n / 2)``.

    See :func:`tidemark.functions.exprs.loo_median`.
    """
    start = lambda n: F.floor(n / 2)
    return order_statistics(
        df, keys, value, heavy,
        {"low": start, "mid": lambda n: start(n) + 1, "high": lambda n: start(n) + 2},
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, heavy: bool, shares: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group: ``keys, n`` and one column per share."""
    keys = list(keys)
    below = lambda share: (lambda n: F.floor((n - 1) * share) + 1)
    above = lambda share: (lambda n: F.ceil((n - 1) * share) + 1)
    ranks = {}
    for name, share in shares.items():
        ranks[f"_lo_{name}"] = below(share)
        ranks[f"_hi_{name}"] = above(share)
    found = order_statistics(df, keys, value, heavy, ranks)
    made = []
    for name, share in shares.items():
        place = (F.col("n") - 1) * share
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        made.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return found.select(*keys, "n", *made)
