"""Checks that stop a job.  Each reads its table once, counts, and names an offender."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.settings import counted, known_rows


class LeakError(ValueError):
    """A row was not knowable at the instant it is used for."""


class AmbiguityError(ValueError):
    """Two rows claim one key and disagree."""


class IntegrityError(ValueError):
    """Inputs contradict each other."""


def refuse(df: DataFrame, broken: Column, error: type[Exception], what: str, show: Sequence[str]):
    """Raise when any row satisfies ``broken``; the message carries the count and one row."""
    found = (
        df.where(broken)
        .agg(F.count("*").alias("n"), F.min(F.to_json(F.struct(*show))).alias("example"))
        .first()
    )
    if found.n:
        raise error(f"{what}: {found.n} row(s), for example {found.example}")


def broken_rows(broken: Column, show: Sequence[str]) -> dict[str, Column]:
    """Aggregates that a write can observe in place of a job of :func:`refuse`'s own."""
    example = F.min(F.when(broken, F.to_json(F.struct(*show))))
    return {"broken": F.count(F.when(broken, F.lit(1))), "example": example}


def refuse_observed(found: dict, error: type[Exception], what: str) -> None:
    """Raise when a write observed broken rows."""
    if found["broken"]:
        raise error(f"{what}: {found['broken']} row(s), for example {found['example']}")


def refuse_leaks(df: DataFrame, seen: str, as_of: Column, key: Sequence[str]) -> None:
    refuse(df, F.col(seen) > as_of, LeakError, f"{seen} is later than as_of", [*key, seen])


def _content(df: DataFrame, key: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row without its key; which columns are NULL takes part."""
    rest = sorted(c for c in df.columns if c not in key)
    plain = [
        F.to_json(c) if df.schema[c].dataType.simpleString().find("map<") >= 0 else F.col(c) for c in rest
    ]
    holes = [F.col(c).isNull() for c in rest]
    return [
        F.xxhash64(F.lit(0), *plain, *holes).alias("_a"), F.xxhash64(F.lit(1), *plain, *holes).alias("_b")
    ]


def _per_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows per key, and whether they differ: five whole numbers, however often a key repeats."""
    spans = [f(c).alias(f"{c}_{n}") for c in ("_a", "_b") for n, f in (("lo", F.min), ("hi", F.max))]
    clash = (F.col("_a_lo") != F.col("_a_hi")) | (F.col("_b_lo") != F.col("_b_hi"))
    counted = df.select(*key, *_content(df, key)).groupBy(*key).agg(F.count("*").alias("_n"), *spans)
    return counted.withColumn("_clash", clash)


def conflicting_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose rows differ in content."""
    return _per_key(df, key).where("_clash").select(*key)


def collapse_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Drop identical repeats; raise when two rows of a key disagree.

    One aggregate answers both questions, and a table without repeats is returned as it is,
    so nothing downstream pays for a deduplication it does not need.
    """
    found = _per_key(df, key).agg(
        F.max("_n").alias("most"), F.count(F.when(F.col("_clash"), 1)).alias("n"),
        F.min(F.when(F.col("_clash"), F.to_json(F.struct(*key)))).alias("example"),
    ).first()
    if found.n:
        raise AmbiguityError(
            f"rows sharing ({', '.join(key)}) disagree: {found.n} key(s), for example {found.example}"
        )
    return df if (found.most or 0) <= 1 else counted(df.dropDuplicates(list(key)), known_rows(df))


def refuse_repeats(df: DataFrame, key: Sequence[str], error: type[Exception], what: str) -> None:
    counted = df.groupBy(*key).count()
    refuse(counted, F.col("count") > 1, error, what, list(key))
