"""Replaying event logs against a transition table.

An illegal event leaves the state as it was, so a state depends on all events before it.
Each event is a function from state to state and functions compose, which lets a long
history be replayed in pieces: compose each block, find every block's entry state from the
compositions, then replay all blocks at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import fixed, guards, spread
from tidemark.settings import settle

BLOCK = 128


def permits_new_entry(states: DataFrame, column: str = "state") -> DataFrame:
    """Whether a session in each state can reach ``working``; read off the table itself."""
    able = [s for s, targets in fixed.SESSION_EDGES.items() if "working" in targets]
    return states.withColumn("permits_new_entry", F.col(column).isin(*able))


def _next_state(states: Sequence[str], edges: Mapping[str, Sequence[str]]):
    """``(state, event) -> state`` over state numbers, from a literal table."""
    number = {s: i for i, s in enumerate(states)}
    table = F.array(
        *[
            F.array(*[F.lit(number[e] if e in edges.get(s, ()) else number[s]) for e in states])
            for s in states
        ]
    )
    return lambda state, event: F.element_at(F.element_at(table, state + 1), event + 1)


def _entries(blocks: DataFrame, size: int, initial: int) -> DataFrame:
    """Entry state of each block from (subject_id, blk, fn); at most BLOCK rows per group."""
    longest = blocks.agg(F.max("blk")).first()[0] or 0
    listed = F.array_sort(F.collect_list(F.struct("blk", "fn")))
    if longest < BLOCK:
        grouped = blocks.groupBy("subject_id").agg(listed.alias("_f"))
        grouped = grouped.withColumn("_entry", F.lit(initial))
    else:
        parents = settle(
            blocks.groupBy("subject_id", F.floor(F.col("blk") / BLOCK).alias("up")).agg(listed.alias("_f")),
            "replay",
        )
        composed = F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)),
            lambda s: F.aggregate("_f", s, lambda at, f: F.element_at(f.fn, at + 1)),
        )
        above = _entries(
            parents.select("subject_id", F.col("up").alias("blk"), composed.alias("fn")), size, initial
        )
        grouped = parents.join(
            above.select("subject_id", F.col("blk").alias("up"), F.col("entry").alias("_entry")),
            ["subject_id", "up"],
        )
    walked = F.aggregate(
        "_f",
        F.struct(F.col("_entry").alias("at"), F.array().cast("array<struct<blk:bigint,entry:int>>").alias("out")),
        lambda acc, f: F.struct(
            F.element_at(f.fn, acc.at + 1).alias("at"),
            F.concat(acc.out, F.array(F.struct(f.blk.alias("blk"), acc.at.alias("entry")))).alias("out"),
        ),
        lambda acc: acc.out,
    )
    return grouped.select("subject_id", F.explode(walked).alias("_e")).select("subject_id", "_e.*")


def replay(
    events: DataFrame, states: Sequence[str], edges: Mapping[str, Sequence[str]], initial: str
) -> DataFrame:
    """Every event with the state before it, the state after it and whether it was legal.

    ``events``: subject_id, seq, event (named for the state it tries to enter).
    """
    guards.refuse(
        events, ~F.coalesce(F.col("event").isin(*states), F.lit(False)), guards.IntegrityError,
        "unknown event", ["subject_id", "event"],
    )
    [heavy] = spread.is_heavy(events, ["subject_id"])
    number = F.array_position(F.array(*[F.lit(s) for s in states]), F.col("event")).cast("int") - 1
    placed = spread.numbered(events.select("subject_id", "seq", number.alias("e")), ["subject_id"], ["seq"], heavy)
    blk = F.floor((F.col("pos") - 1) / BLOCK)
    step = _next_state(states, edges)
    start = states.index(initial)
    blocks = settle(
        placed.groupBy("subject_id", blk.alias("blk")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "seq", "e"))).alias("events")
        ),
        "replay",
    )
    composed = F.transform(
        F.sequence(F.lit(0), F.lit(len(states) - 1)),
        lambda s: F.aggregate("events", s, lambda at, ev: step(at, ev.e)),
    )
    entries = _entries(blocks.select("subject_id", "blk", composed.alias("fn")), len(states), start)
    walked = F.aggregate(
        "events",
        F.struct(
            F.col("entry").alias("at"),
            F.array().cast("array<struct<seq:bigint,e:int,before:int,after:int>>").alias("out"),
        ),
        lambda acc, ev: F.struct(
            step(acc.at, ev.e).alias("at"),
            F.concat(
                acc.out,
                F.array(
                    F.struct(
                        ev.seq.alias("seq"), ev.e.alias("e"), acc.at.alias("before"),
                        step(acc.at, ev.e).alias("after"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc.out,
    )
    rows = blocks.join(entries, ["subject_id", "blk"]).select("subject_id", F.explode(walked).alias("_r"))
    names = F.array(*[F.lit(s) for s in states])
    name = lambda n: F.element_at(names, F.col(f"_r.{n}") + 1)
    legal = F.lit(False)
    for state, targets in edges.items():
        legal = legal | ((F.col("before") == state) & F.col("event").isin(*targets))
    return rows.select(
        "subject_id", F.col("_r.seq").alias("seq"), name("e").alias("event"),
        name("before").alias("before"), name("after").alias("after"),
    ).withColumn("legal", legal)


def illegal_steps(replayed: DataFrame) -> DataFrame:
    return replayed.where("not legal").select("subject_id", "seq", "before", "event")
