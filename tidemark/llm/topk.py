"""Exact inner-product search through a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it, sorted by that key and
cut into blocks: annuli around a pivot.  A query first searches the annuli nearest to it,
which gives a score that its tenth neighbour must reach; by the triangle inequality an
annulus bounds how near its vectors can be, and only annuli that can reach that score are
searched after that.  Queries are handled in blocks as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.taskcontext import TaskContext

from tidemark.settings import settle

PIVOTS = 32
ROWS = 1024
QUERY_ROWS = 256
FIRST_BLOCKS = 2
SLACK = 1e-6
# The bound of a query without k scores yet.  A null would turn a whole array of bounds into floats in a task.
NO_BOUND = -(2**63)
BLOCK = "block long, pivot int, lo double, hi double, norm double, ids binary, vectors binary, width int, size int"


def whole_numbers(embedding: Column, factor: int) -> Column:
    """``floor(factor * x)`` of every component, null where a component is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * factor).cast("long")))


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors picked by a digest of their id; where they lie affects speed only."""
    listed = vectors.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(n).collect()
    rows = [r["v"] for r in listed] or [[0]]
    return _matrix(rows, max(1, *map(len, rows)))


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(points.shape[1], pivots.shape[1])
    a = np.pad(points, ((0, 0), (0, width - points.shape[1])))
    b = np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))
    square = (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def _keyed(pivots: np.ndarray):
    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            points = _matrix(batch["v"].tolist(), max(1, max(map(len, batch["v"]))))
            far = _distances(points, pivots)
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].to_numpy(), "pivot": far.argmin(1).astype("int32"),
                "dist": far.min(1), "norm": np.sqrt((points * points).sum(1)), "v": batch["v"].to_numpy(),
            })

    return body


def _pack(rows: pd.DataFrame, block: int) -> dict:
    width = max(1, max(map(len, rows["v"])))
    points = _matrix(rows["v"].tolist(), width)
    return {
        "block": block, "pivot": int(rows["pivot"].iloc[0]), "lo": float(rows["dist"].min()),
        "hi": float(rows["dist"].max()), "norm": float(rows["norm"].max()),
        "ids": rows["vec_id"].to_numpy("<i8").tobytes(), "vectors": points.astype("<i8").tobytes(),
        "width": width, "size": len(rows),
    }


def _cut(most: int):
    """Cut sorted rows into blocks of one pivot and at most ``most`` rows."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held):
                same = int((held["pivot"].to_numpy() != held["pivot"].iloc[0]).argmax()) or len(held)
                if same == len(held) and same < most:
                    break
                n = min(same, most)
                yield pd.DataFrame([_pack(held.iloc[:n], number)])
                number, held = number + 1, held.iloc[n:].reset_index(drop=True)
        if held is not None and len(held):
            yield pd.DataFrame([_pack(held, number)])

    return body


def _blocks(keyed: DataFrame, most: int) -> DataFrame:
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["pivot", "dist", "vec_id"]
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_cut(most), BLOCK)


def _points(row) -> np.ndarray:
    return np.frombuffer(row.vectors, "<i8").reshape(row.size, row.width)


def _with_pivots(pivots: np.ndarray):
    """Add the distances of a query block's vectors to every pivot, one row per pivot."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                points = _points(row).astype(float)
                far = _distances(points, pivots)
                yield pd.DataFrame({
                    "qblock": row.block, "at": np.arange(far.shape[1], dtype="int32"),
                    "far": [far[:, j].tolist() for j in range(far.shape[1])],
                    "length": [np.sqrt((points * points).sum(1)).tolist()] * far.shape[1],
                })

    return body


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    width = max(q.shape[1], x.shape[1])
    q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width < 2.0**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


def _best(k: int):
    """Score (query block, block) pairs; each task keeps its ``k`` best per query."""

    def merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        rows = rows.sort_values(["qblock", "slot", "score", "vec_id"], ascending=[True, True, False, True])
        return rows[rows.groupby(["qblock", "slot"]).cumcount() < k]

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            for row in batch.itertuples():
                q = np.frombuffer(row.q_vectors, "<i8").reshape(row.q_size, row.q_width)
                qid = np.frombuffer(row.q_ids, "<i8")
                ids = np.frombuffer(row.ids, "<i8")
                score = _products(q, _points(row))
                allowed = ids[None, :] != qid[:, None]
                if row.least is not None:
                    allowed &= score >= np.asarray(row.least, dtype=np.int64)[:, None]
                for slot in np.flatnonzero(allowed.any(1)):
                    at = np.flatnonzero(allowed[slot])
                    at = at[np.lexsort((ids[at], -score[slot, at]))[:k]]
                    parts.append(pd.DataFrame({
                        "qblock": row.qblock, "slot": np.int32(slot), "query_id": qid[slot],
                        "vec_id": ids[at], "score": score[slot, at],
                    }))
                    held += len(at)
                if held > 200_000:
                    parts = [merged(parts)]
                    held = len(parts[0])
        if parts:
            yield merged(parts)

    return body


FOUND = "qblock long, slot int, query_id long, vec_id long, score long"


def _search(pairs: DataFrame, index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    q = asked.select(
        F.col("block").alias("qblock"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
        F.col("width").alias("q_width"), F.col("size").alias("q_size"),
    )
    full = pairs.join(index.select("block", "ids", "vectors", "width", "size"), "block").join(q, "qblock")
    return full.mapInPandas(_best(k), FOUND)


def top_k(
    embeddings: DataFrame, queries: Column, k: int = 10, factor: int = 1024,
    pivots: int = PIVOTS, rows: int = ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query.

    ``embeddings`` has vec_id and embedding; ``queries`` says which rows ask.  Ties go to the
    smaller vec_id.  Rows that share the query's vec_id are not its candidates.  A vector that
    is null or holds a null or non-finite component takes no part, nor does one without an
    id; shorter vectors count as padded with zeros; repeated rows are candidates each, and
    one query.  Components must stay below 2**16 in size for scores to fit 64 bits.
    """
    vectors = settle(
        embeddings.where(F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), factor).alias("v"))
        .where(F.col("v").isNotNull()),
        "vectors",
    )
    around = _pivots(vectors, pivots)
    keyed = settle(
        vectors.mapInPandas(_keyed(around), "vec_id long, pivot int, dist double, norm double, v array<long>"),
        "keyed",
    )
    index = settle(_blocks(keyed, rows), "annuli")
    asked = settle(_blocks(keyed.where(queries).dropDuplicates(["vec_id", "v"]), QUERY_ROWS), "queries")
    annuli = index.select("block", "pivot", "lo", "hi", "norm")
    spread = settle(
        asked.mapInPandas(_with_pivots(around), "qblock long, at int, far array<double>, length array<double>"),
        "query_pivots",
    )

    near = W.partitionBy("qblock").orderBy(F.greatest(F.col("lo") - F.col("q_hi"), F.col("q_lo") - F.col("hi")), "block")
    homes = (
        asked.select(F.col("block").alias("qblock"), "pivot", F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"))
        .join(annuli, "pivot")
        .withColumn("nth", F.row_number().over(near))
        .where(F.col("nth") <= FIRST_BLOCKS)
        .select("qblock", "block", F.lit(None).cast("array<long>").alias("least"))
    )
    first = settle(_search(homes, index, asked, k), "nearest_annuli")
    place = W.partitionBy("qblock", "slot").orderBy(F.desc("score"), "vec_id")
    tenth = (
        first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k)
        .groupBy("qblock").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("reach"))
    )
    slots = F.transform(F.col("far"), lambda _, i: F.coalesce(F.try_element_at("reach", i), F.lit(NO_BOUND)))
    bounds = spread.join(tenth, "qblock", "left").withColumn("least", slots)

    def can_reach(d: Column, i: Column) -> Column:
        gap = F.greatest(d - F.col("hi"), F.col("lo") - d, F.lit(0.0)) * (1 - SLACK)
        length, need = F.get("length", i), F.get("least", i)
        best = (length * length + F.col("norm") * F.col("norm") - gap * gap) / 2
        best = F.least(best, length * F.col("norm")) * (1 + SLACK) + 1
        return best >= need

    pairs = bounds.join(annuli, F.col("at") == F.col("pivot")).where(
        F.exists(F.transform("far", can_reach), lambda ok: ok)
    )
    pairs = pairs.join(homes.select("qblock", "block"), ["qblock", "block"], "left_anti").select("qblock", "block", "least")
    rest = _search(pairs, index, asked, k)
    return (
        first.unionByName(rest)
        .withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
