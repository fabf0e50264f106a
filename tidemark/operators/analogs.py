"""Closest earlier events by blocks that know their span of time, centre and radius.

Rows are ranged by time, and each stretch of a range is cut in space, at the median of its
widest dimension, into blocks of at most ``size`` rows.  A pair of a query block and an event
block is searched only if the event block begins before the query block ends and lies nearer
than a distance that already holds ``k`` earlier events for each query.  Choosing pairs reads
block summaries alone.  The pairs that remain are searched in tiles, each a share of the query
blocks with a share of the event blocks, so a block moves once per tile and not once per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.settings import known_rows, settle, settle_counted

# Block summaries compared at once.
PACK = 512
# Shares of each side that make the tiles, fewer for few blocks, and the query blocks a task may hold.
SHARES, HELD = 12, 512
# Rounding allowed to squared distances by norms, relative to the norms; far above what occurs.
SLACK = 1e-9

_BLOCK = (
    "block long, first long, last long, n int, radius double, centre array<double>, "
    "ids array<long>, ats array<long>, flat array<double>"
)
_SUMMARY = ["block", "first", "last", "n", "radius", "centre"]


def _leaves(vectors: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``size``, halved at the widest dimension."""
    todo, done = [np.arange(len(vectors))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        here = vectors[rows]
        widest = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
        order, half = np.argsort(here[:, widest], kind="stable"), len(rows) // 2
        todo += [rows[order[half:]], rows[order[:half]]]
    return done


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (event_id, at, vector) as blocks, written down.

    Rows without ``at``, without a vector, or with a missing or non-finite component take no part.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = rows.where("at is not null").where(F.coalesce(F.forall("vector", finite), F.lit(False)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = usable.select("event_id", "at", "vector").repartitionByRange(parts, "at", "event_id")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        kept: list[pd.DataFrame] = []

        def made() -> pd.DataFrame:
            nonlocal number
            frame, out = pd.concat(kept), []
            vectors = np.stack([np.asarray(v, dtype=float) for v in frame["vector"]])
            ids, ats = frame["event_id"].to_numpy("int64"), frame["at"].to_numpy("int64")
            for rows_here in _leaves(vectors, size):
                here = vectors[rows_here]
                centre = here.mean(axis=0)
                radius = float(np.sqrt(((here - centre) ** 2).sum(axis=1)).max())
                span = ats[rows_here]
                out.append((number, span.min(), span.max(), len(here), radius, centre, ids[rows_here], span, here.ravel()))
                number += 1
            return pd.DataFrame(out, columns=[f.split()[0] for f in _BLOCK.split(", ")])

        for frame in frames:
            kept.append(frame)
            if sum(map(len, kept)) >= 64 * size:
                yield made()
                kept = []
        if kept and sum(map(len, kept)):
            yield made()

    cut_up = ranged.sortWithinPartitions("at", "event_id").mapInPandas(cut, _BLOCK)
    return settle_counted(cut_up, "analog-blocks")[0]


def _packed(summaries: DataFrame, number: int, pack: str, held: str) -> DataFrame:
    dealt = F.pmod(F.xxhash64("block"), F.lit(number)).cast("int").alias(pack)
    return summaries.groupBy(dealt).agg(F.collect_list(F.struct(*summaries.columns)).alias(held))


def _packs(blocked: DataFrame) -> int:
    return max(1, -(-known_rows(blocked) // PACK))


def _compared(asked: DataFrame, known: DataFrame, packs: tuple[int, int], step, schema: str) -> DataFrame:
    """``step`` over every pack of query summaries and every pack of event summaries.

    ``step`` sees two frames of summaries and the distances of their centres.
    """
    wanted = _packed(asked, packs[0], "p", "wanted")
    held = _packed(known.select(*_SUMMARY), packs[1], "e", "held")
    pairs = wanted.withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(packs[1] - 1)))).join(held, "e")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q, b in zip(frame["wanted"], frame["held"]):
                q, b = pd.DataFrame(list(q)), pd.DataFrame(list(b))
                ends = np.stack(b["centre"].tolist())
                far = np.stack([np.sqrt(((ends - np.asarray(c)) ** 2).sum(axis=1)) for c in q["centre"]])
                yield step(q, b, far)

    return pairs.select("wanted", "held").mapInPandas(run, schema)


def needed_pairs(asked: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Pairs (q, b) of blocks that may hold one of the ``k`` nearest earlier events of a query."""
    packs = _packs(asked), _packs(known)

    def reaches(q: pd.DataFrame, b: pd.DataFrame, far: np.ndarray) -> pd.DataFrame:
        """The nearest block wholly earlier, and a distance within which ``k`` events surely lie."""
        reach = far + q["radius"].to_numpy()[:, None] + b["radius"].to_numpy()[None, :]
        reach[b["last"].to_numpy()[None, :] >= q["first"].to_numpy()[:, None]] = np.inf
        order = np.argsort(reach, axis=1, kind="stable")
        enough = np.cumsum(b["n"].to_numpy()[order], axis=1) >= k
        at = np.where(enough.any(axis=1), enough.argmax(axis=1), reach.shape[1] - 1)
        rows = np.arange(len(q))
        sure = np.where(enough.any(axis=1), reach[rows, order[rows, at]], np.inf)
        near = reach[rows, order[:, 0]]
        out = pd.DataFrame({"q": q["block"], "b": b["block"].to_numpy()[order[:, 0]], "near": near, "reach": sure})
        return out[np.isfinite(near)]

    found = _compared(asked.select(*_SUMMARY), known, packs, reaches, "q long, b long, near double, reach double")
    first = settle(found.groupBy("q").agg(F.min_by("b", "near").alias("b"), F.min("reach").alias("reach")), "analog-first")
    # The first search replaces the sure distance by the k-th found, where every query has k.
    seen = _searched(first.select("q", "b"), asked, known, k)
    per_query = seen.groupBy("q", "row").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    kth = per_query.groupBy("q").agg(F.min("n").alias("n"), F.max("far").alias("kth"))
    bound = first.join(kth, "q").select("q", F.when(F.col("n") >= k, F.least("kth", "reach")).otherwise(F.col("reach")).alias("reach"))
    told = asked.select(*_SUMMARY).join(bound.withColumnRenamed("q", "block"), "block", "left")
    told = settle(told.withColumn("reach", F.coalesce("reach", F.lit(float("inf")))), "analog-bounds")

    def within(q: pd.DataFrame, b: pd.DataFrame, far: np.ndarray) -> pd.DataFrame:
        least = far - q["radius"].to_numpy()[:, None] - b["radius"].to_numpy()[None, :]
        reach = q["reach"].to_numpy()[:, None]
        # A margin for rounding: distances to centres are not the distances that are compared.
        # Distances that overflow leave a pair in.
        near = ~(least > reach + 1e-9 * (1 + far))
        qs, bs = np.nonzero(near & (b["first"].to_numpy()[None, :] < q["last"].to_numpy()[:, None]))
        return pd.DataFrame({"q": q["block"].to_numpy()[qs], "b": b["block"].to_numpy()[bs]})

    return _compared(told, known, packs, within, "q long, b long")


class _Asked:
    """The queries of a block and the best ``k`` events each has met."""

    def __init__(self, ids: np.ndarray, ats: np.ndarray, flat: np.ndarray, k: int):
        self.ids, self.ats, self.k = ids, ats, k
        self.want = flat.reshape(len(ids), -1)
        self.norms = (self.want**2).sum(axis=1)
        self.lifted = np.hstack([-2 * self.want, np.ones((len(ids), 1))])
        self.row, self.event, self.far = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
        self.kth = np.full(len(ids), np.inf)

    def meet(self, ids: np.ndarray, ats: np.ndarray, have: np.ndarray, lifted: np.ndarray) -> None:
        """Take in a block of events; ``lifted`` is ``have`` with its squared norms behind.

        One product gives squared distances less the query's norm.  They only leave out what is
        surely farther than ``k`` others; distances that count are summed from differences.
        Blocks whose norms come near the largest number are compared in full.
        """
        norms = self.norms.max() + lifted[:, -1].max()
        if norms < 1e300:
            near = self.lifted @ lifted.T
            if ats.max() >= self.ats.min():
                near[ats[None, :] >= self.ats[:, None]] = np.inf
            short = ~np.isfinite(self.kth)
            limit = np.where(short, np.inf, self.kth) ** 2 - self.norms
            if short.any() and len(ids) > self.k:
                limit[short] = np.partition(near[short], self.k - 1, axis=1)[:, self.k - 1]
            rows, cols = np.nonzero(near <= (limit + 2 * SLACK * norms)[:, None])
        else:
            rows, cols = (x.ravel() for x in np.indices((len(self.ids), len(ids))))
        earlier = ats[cols] < self.ats[rows]
        rows, cols = rows[earlier], cols[earlier]
        if not len(rows):
            return
        far = np.sqrt(((have[cols] - self.want[rows]) ** 2).sum(axis=1))
        row, event, far = np.append(self.row, rows), np.append(self.event, ids[cols]), np.append(self.far, far)
        order = np.lexsort((event, far, row))
        row = row[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        self.row, self.event, self.far = row[best], event[order][best], far[order][best]
        full = np.bincount(self.row, minlength=len(self.ids)) == self.k
        last = np.searchsorted(self.row, np.arange(len(self.ids)), side="right") - 1
        self.kth[full] = self.far[last[full]]

    def found(self, block: int) -> pd.DataFrame:
        return pd.DataFrame({
            "q": block, "row": self.row, "query_id": self.ids[self.row], "event_id": self.event, "distance": self.far,
        })


def _searched(pairs: DataFrame, asked: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each tile per query row: q, row, query_id, event_id, distance.

    A tile holds its query blocks and sees its event blocks one by one, each with the names of
    the query blocks it pairs with.  Blocks are copied ``SHARES`` times however many they are;
    only beyond ``SHARES * HELD`` query blocks are there more tiles, so that a task's memory is bounded.
    """
    some = lambda blocked: min(SHARES, max(1, known_rows(blocked) // 4))
    shares, others = max(some(asked), -(-known_rows(asked) // HELD)), some(known)
    dealt = lambda block, n: F.pmod(F.xxhash64(block), F.lit(n)).cast("int")
    tile = (dealt("q", shares) * others + dealt("b", others)).alias("tile")
    cols = ["block", "ids", "ats", "flat"]
    wants = pairs.select(F.col("q").alias("block"), tile).distinct()
    holds = pairs.groupBy(F.col("b").alias("block"), tile).agg(F.collect_list("q").alias("wanted"))
    nobody = F.lit(None).cast("array<bigint>").alias("wanted")
    # The blocks stand on the left: a merge join keeps the rows of the right side of a key.
    laid = asked.select(*cols).join(wants, "block").select("tile", F.lit(0).alias("side"), *cols, nobody).unionByName(
        known.select(*cols).join(holds, "block").select("tile", F.lit(1).alias("side"), *cols, "wanted")
    )
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = laid.repartition(max(parts, shares * others), "tile").sortWithinPartitions("tile", "side", "block")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held = None, {}

        def told() -> Iterator[pd.DataFrame]:
            names = list(held)
            for first in range(0, len(names), 64):
                yield pd.concat([held[n].found(n) for n in names[first : first + 64]])

        np.seterr(over="ignore")
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.tile != here:
                    yield from told()
                    here, held = r.tile, {}
                ids, ats, flat = np.asarray(r.ids), np.asarray(r.ats), np.asarray(r.flat)
                if r.side == 0:
                    held[r.block] = _Asked(ids, ats, flat, k)
                    continue
                have = flat.reshape(len(ids), -1)
                lifted = np.hstack([have, (have**2).sum(axis=1, keepdims=True)])
                for q in r.wanted:
                    held[q].meet(ids, ats, have, lifted)
        yield from told()

    return laid.mapInPandas(search, "q long, row int, query_id long, event_id long, distance double")


def closest_analogs(queries: DataFrame, events: DataFrame, k: int, size: int = 256) -> DataFrame:
    """The ``k`` nearest strictly earlier events of each query by Euclidean distance.

    ``queries``/``events``: event_id, at (long order key), vector.  Ties go to the smaller id.
    """
    known = blocks(events, size)
    asked = known if queries is events else blocks(queries, size)
    pairs = settle(needed_pairs(asked, known, k), "analog-pairs")
    found = _searched(pairs, asked, known, k)
    w = W.partitionBy("query_id").orderBy("distance", "event_id")
    ranked = found.select("query_id", "event_id", "distance").withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)
