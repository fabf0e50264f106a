"""Ranks of all admissible verticals without moving a pair.

The order of a candidate's pairs is cost, expiry, long leg, short leg.  Long legs of a candidate and
expiry are cut, in their order, into chunks.  How many pairs of a chunk have a cost follows from the
numbers of legs at each price, so the rank at which each chunk continues with each cost is known
before any pair is formed.  A chunk then meets all short legs of its expiry in one task, walks
its long legs in order and counts on from there; pairs leave that task in their final form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions import spread
from tidemark.functions.exprs import ticks
from tidemark.operators.structures import CALL_SPREAD, payoffs
from tidemark.settings import counted, known_rows, settle_counted

# Long legs of a chunk, and pairs that leave a task at once.
CHUNK, BATCH = 256, 50_000

_UNIT = ["candidate_id", "expiry", "chunk"]
_PLACED = (
    "candidate_id string, kind string, expiry date, multiplier int, long_symbol string, short_symbol string, "
    "long_strike_ticks long, debit_ticks long, width_ticks long, rank long"
)


def _chunked(legs: DataFrame) -> DataFrame:
    """Long legs with the number of their chunk, written down."""
    key, order = ["candidate_id", "expiry"], ["strike", "symbol"]
    longs = counted(legs.where("fits_long").dropna(subset=[*key, "multiplier", "strike", "ask"]), known_rows(legs))
    [heavy] = spread.is_heavy(longs, key)
    placed = spread.numbered(longs, key, order, heavy)
    chunk = F.floor((F.col("pos") - 1) / CHUNK).cast("long").alias("chunk")
    return settle_counted(
        placed.select(*key, chunk, "kind", "multiplier", "symbol", ticks(F.col("strike")).alias("strike"), ticks(F.col("ask")).alias("price")),
        "long-legs",
    )[0]


def _starts(longs: DataFrame, shorts: DataFrame) -> DataFrame:
    """Per chunk and cost how many pairs of the candidate come before, with the cost's debits and widths."""
    c = F.col
    asks = longs.groupBy(*_UNIT, "kind", "multiplier", c("strike").alias("long_strike"), c("price").alias("ask")).agg(F.count("*").alias("_l"))
    bids = shorts.groupBy("candidate_id", "expiry", "multiplier", c("strike").alias("short_strike"), c("price").alias("bid")).agg(F.count("*").alias("_s"))
    gap = F.when(c("kind") == CALL_SPREAD, c("short_strike") - c("long_strike")).otherwise(c("long_strike") - c("short_strike"))
    pairs = asks.join(bids, ["candidate_id", "expiry", "multiplier"]).select(
        *_UNIT, (c("ask") - c("bid")).alias("debit"), gap.alias("width"), (c("_l") * c("_s")).alias("n")
    ).where("debit > 0 and debit < width")
    prices = pairs.groupBy(*_UNIT, "debit", "width").agg(F.sum("n").alias("n"))
    money = lambda n: (c(n).cast("decimal(19,0)") / F.lit(10_000).cast("decimal(5,0)")).cast("decimal(18,4)")
    prices = prices.withColumn("cost_drag", money("debit") / money("width"))
    costs, _ = settle_counted(prices.groupBy(*_UNIT, "cost_drag").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("debit", "width")).alias("at")
    ), "chunk-costs")
    [heavy] = spread.is_heavy(costs, ["candidate_id"])
    run = spread.running(costs, ["candidate_id"], ["cost_drag", "expiry", "chunk"], heavy, {"_upto": ("sum", c("n"))})
    return run.select(*_UNIT, (c("_upto") - c("n")).alias("start"), F.explode("at").alias("_at")).select(*_UNIT, "start", "_at.*")


def _walked(longs: pd.DataFrame, shorts: pd.DataFrame, starts: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    """The pairs of a chunk with their ranks; legs come in order."""
    widths, debits = np.unique(starts["width"]), np.unique(starts["debit"])
    place = lambda debit, width: np.searchsorted(widths, width) * len(debits) + np.searchsorted(debits, debit)
    names = place(starts["debit"].to_numpy("int64"), starts["width"].to_numpy("int64"))
    order = np.argsort(names)
    names, firsts = names[order], starts["start"].to_numpy("int64")[order]
    # Equal starts are one cost, in whatever debits and widths.
    begins, cost = np.unique(firsts, return_inverse=True)
    done = begins.copy()
    sides = {
        m: (group["strike"].to_numpy("int64"), group["price"].to_numpy("int64"), pa.array(group["symbol"], pa.string()))
        for m, group in shorts.groupby("multiplier")
    }
    first = longs.iloc[0]
    up, kept, rows = first["kind"] == CALL_SPREAD, [], 0

    def batch() -> pa.RecordBatch:
        n = lambda column: np.concatenate([k[column] for k in kept])
        many = np.array([len(k["rank"]) for k in kept])
        mine = pa.array(np.repeat(np.arange(len(kept)), many))
        of = lambda column, kind: pa.array([k["long"][column] for k in kept], kind).take(mine)
        same = lambda value, kind: pa.repeat(pa.scalar(value, kind), int(many.sum()))
        return pa.RecordBatch.from_arrays([
            same(first["candidate_id"], pa.string()), same(first["kind"], pa.string()), same(first["expiry"], pa.date32()),
            of("multiplier", pa.int32()), of("symbol", pa.string()), pa.concat_arrays([k["short"] for k in kept]),
            of("strike", pa.int64()), pa.array(n("debit")), pa.array(n("width")), pa.array(n("rank")),
        ], names=[f.split()[0] for f in _PLACED.split(", ")])

    for long in longs[["multiplier", "symbol", "strike", "price"]].to_dict("records"):
        if long["multiplier"] not in sides:
            continue
        strikes, bids, symbols = sides[long["multiplier"]]
        debit, width = long["price"] - bids, (strikes - long["strike"]) * (1 if up else -1)
        fits = np.flatnonzero((debit > 0) & (debit < width))
        if not len(fits):
            continue
        debit, width = debit[fits], width[fits]
        at = cost[np.searchsorted(names, place(debit, width))]
        # Among equal costs short legs keep their order.
        turn = np.argsort(at, kind="stable")
        runs, begin, many = np.unique(at[turn], return_index=True, return_counts=True)
        rank = np.empty(len(at), "int64")
        rank[turn] = np.repeat(done[runs] - begin, many) + np.arange(1, len(at) + 1)
        done[runs] += many
        kept.append({"long": long, "short": symbols.take(pa.array(fits)), "debit": debit, "width": width, "rank": rank})
        rows += len(fits)
        if rows >= BATCH:
            yield batch()
            kept, rows = [], 0
    if kept:
        yield batch()


def placed_plans(legs: DataFrame) -> DataFrame:
    """Admissible plans of :func:`tidemark.operators.structures.candidate_legs` with their ``rank``.

    Ranks are those of :func:`tidemark.operators.structures.ranked_plans`.  Legs are copied once per
    chunk of their expiry, and start ranks are as many as costs per chunk; pairs are not shuffled.
    Strike, debit and width come in whole ticks, too.
    """
    c = F.col
    longs = _chunked(legs)
    shorts = legs.where("fits_short").dropna(subset=["candidate_id", "expiry", "multiplier", "strike", "bid"]).select(
        "candidate_id", "expiry", "multiplier", "symbol", ticks(c("strike")).alias("strike"), ticks(c("bid")).alias("price")
    )
    starts = _starts(longs, shorts)
    copied = shorts.join(longs.select(*_UNIT).distinct(), ["candidate_id", "expiry"])
    # Whole numbers of a batch stay whole only where none is missing.
    blank = {"kind": F.lit(""), "symbol": F.lit("")} | {n: F.lit(0).cast("long") for n in ("strike", "price", "start", "debit", "width")}
    blank["multiplier"] = F.lit(0)

    def part(df: DataFrame, side: int) -> DataFrame:
        filled = [c(n) if n in df.columns else value.alias(n) for n, value in blank.items()]
        return df.select(*_UNIT, F.lit(side).alias("side"), *filled)

    laid = part(starts, 0).unionByName(part(copied, 1)).unionByName(part(longs, 2))
    parts = int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = laid.repartition(parts, *_UNIT).sortWithinPartitions(*_UNIT, "side", "strike", "symbol")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def unit() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pd.concat(held)
                side = rows["side"].to_numpy()
                if (side == 0).any():
                    yield from _walked(rows[side == 2], rows[side == 1], rows[side == 0])

        for b in batches:
            frame = b.to_pandas()
            if not len(frame):
                continue
            key = frame[_UNIT]
            cuts = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
            for begin, end in zip(cuts, [*cuts[1:], len(frame)]):
                part = frame.iloc[begin:end]
                name = tuple(part[_UNIT].iloc[0])
                if name != here:
                    yield from unit()
                    here, held = name, []
                held.append(part)
        yield from unit()

    money = lambda n: (c(n).cast("decimal(19,0)") / F.lit(10_000).cast("decimal(5,0)")).cast("decimal(19,4)")
    priced = {"long_strike": "long_strike_ticks", "net_debit": "debit_ticks", "width": "width_ticks"}
    placed = laid.mapInArrow(walk, _PLACED).withColumns({n: money(of) for n, of in priced.items()})
    return placed.select(
        "candidate_id", "rank", F.concat_ws("/", "candidate_id", "long_symbol", "short_symbol").alias("plan_id"),
        "kind", "expiry", "multiplier", "long_symbol", "short_symbol", *priced.values(), *payoffs(),
    )
