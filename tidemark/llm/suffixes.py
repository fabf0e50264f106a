"""Duplicate passages from a sparse suffix array.

Of all suffixes of a text only those are kept that start at a minimiser: the k-gram of least
hash in some window.  Every window holds its minimiser at the same offset wherever it occurs,
so equal passages keep suffixes at the same places.

1. Places whose k-gram occurs once are left out; of places whose windows are all the same, the
   neighbours in an order by hashes, only the earliest goes on.
2. The suffixes that remain are sorted over the cluster by their words.  Each is compared with
   the one before: the common words to the right of the minimiser and to the left of it tell
   which windows the two share, and the later one loses them.
3. A suffix may share a window with one that is not its neighbour.  The earliest of equal
   windows is never lost in step 2, so the windows that are left, and only they, are
   compared once more by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.taskcontext import TaskContext

from tidemark.llm import passages
from tidemark.llm.flat import WORD_BASES, Sequences, flat_words, mix, packed, signed, with_text
from tidemark.settings import settle

WINDOW = 50
GRAM = 14


def minimisers(size: int, gram: int) -> passages.Anchors:
    """The leftmost k-gram of least hash among those of each window."""

    def find(words: np.ndarray, runs: Sequences, at: np.ndarray, bounds: np.ndarray):
        grams = runs.of(np.arange(len(words) - gram + 1), gram)
        rank = mix(grams)
        best, reach, wide = np.arange(len(rank)), 1, size - gram + 1
        while reach < wide:
            step = min(reach, wide - reach)
            left, right = best[:-step], best[step:]
            best = np.where(rank[left] <= rank[right], left, right)
            reach += step
        anchor = best[at]
        return anchor, grams[anchor]

    return find


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Within sorted rows: does the row before agree?  Rows like the very first are heads."""
    part, before, lead = TaskContext.get().partitionId(), None, None
    for batch in batches:
        if not len(batch):
            continue
        pair = batch[["key", "span"]].to_numpy()
        lead = pair[0].copy() if lead is None else lead
        last = np.vstack([pair[:1] - 1 if before is None else before, pair[:-1]])
        batch["again"] = (pair == last).all(axis=1)
        batch["head"] = (pair == lead).all(axis=1)
        batch["part"] = part
        before = pair[-1:].copy()
        yield batch


def marked_neighbours(spans: DataFrame) -> DataFrame:
    """Sort the spans by their hashes over the cluster and mark each that equals its neighbour before.

    Sorting takes the position along, so a group of any size spans many tasks and its first
    row is the earliest.  A small table of the tasks' first and last rows joins the ends.
    """
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "span", "doc", "tie", "start"]
    compared = settle(
        spans.dropDuplicates(order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .mapInPandas(_compared, f"{passages.SPAN}, again boolean, head boolean, part int"),
        "suffixes",
    )
    pair = F.struct("key", "span")
    ends = compared.groupBy("part").agg(F.min(pair).alias("lo"), F.max(pair).alias("hi"))
    before = F.lag("hi").over(W.partitionBy(F.lit(0)).orderBy("part"))
    joined = ends.withColumn("before", before).where(F.col("before") == F.col("lo")).select("part")
    running_on = F.array_contains(F.lit([r["part"] for r in joined.collect()]).cast("array<int>"), F.col("part"))
    return compared.withColumn("again", F.col("again") | (F.col("head") & running_on)).drop("head", "part")


SUFFIX = "right binary, left binary, doc long, tie long, at long"


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _binary(words: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Hashes of words as bytes whose order is the order of the words' hashes."""
    ends = np.r_[0, np.cumsum(8 * sizes)].astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(words.astype(">u8").tobytes())]
    )


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of :func:`_binary` and the bounds of each row."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else b""
    return np.frombuffer(raw, ">u8").astype(np.uint64), (ends.astype(np.int64) - ends[0]) // 8


def _suffixes_of(size: int, gram: int):
    """The suffixes of listed spans, as far as the spans' windows reach to both sides."""
    find = minimisers(size, gram)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 200):
                part = with_text(batch.slice(first, 200))
                words, bounds = flat_words(part)
                lists = part.column("at")
                row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                start = np.asarray(lists.flatten().field("start")) + bounds[row]
                end = start + np.asarray(lists.flatten().field("n")) - 1 + size
                anchor, _ = find(words, Sequences(words, WORD_BASES[0]), start, bounds)
                ahead, behind = anchor - start, end - anchor
                left = words[np.repeat(anchor - 1, ahead) - _steps(ahead)]
                right = words[np.repeat(anchor, behind) + _steps(behind)]
                doc, tie = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "tie"))
                yield pa.RecordBatch.from_arrays(
                    [_binary(right, behind), _binary(left, ahead), pa.array(doc), pa.array(tie), pa.array(anchor - bounds[row])],
                    names=["right", "left", "doc", "tie", "at"],
                )

    return body


def _common(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many first words each row shares with the row before."""
    sizes = np.diff(bounds)
    least = np.minimum(sizes[:-1], sizes[1:])
    place = _steps(least)
    differ = words[np.repeat(bounds[:-2], least) + place] != words[np.repeat(bounds[1:-1], least) + place]
    some = least > 0
    first = np.where(differ, place, len(words))
    out = least.copy()
    if some.any():
        out[some] = np.minimum(least[some], np.minimum.reduceat(first, (np.cumsum(least) - least)[some]))
    return out


def _neighbours(size: int):
    """Rows ``doc, tie, start, n, a, b``: runs of windows shared with a neighbour that lies earlier
    (``a`` null), and every window that is not, with two hashes of its words."""

    def told(rows: pa.RecordBatch, lost: np.ndarray) -> pa.RecordBatch:
        """``lost``: per row two runs of lengths left of the minimiser, lowest and highest."""
        (right, rb), (left, lb) = _hashes(rows.column("right")), _hashes(rows.column("left"))
        doc, tie, at = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie", "at"))
        ahead, behind = np.diff(lb), np.diff(rb)
        whole = ahead + behind
        row, place = np.repeat(np.arange(len(rows)), whole), _steps(whole)
        turn = place - ahead[row]
        words = np.empty(len(row), np.uint64)
        words[turn >= 0] = right[(rb[row] + turn)[turn >= 0]]
        words[turn < 0] = left[(lb[row] - 1 - turn)[turn < 0]]
        n = whole - size + 1
        row, place = np.repeat(np.arange(len(rows)), n), _steps(n)
        reach = ahead[row] - place
        kept = np.ones(len(row), bool)
        for lo, hi in lost.transpose(1, 2, 0):
            kept &= (reach < lo[row]) | (reach > hi[row])
        row, place = row[kept], place[kept]
        first = (np.cumsum(whole) - whole)[row] + place
        hashes = [Sequences(words, base).of(first, size) for base in WORD_BASES]
        gone, side = np.nonzero(lost[:, :, 1] >= lost[:, :, 0])
        lo, hi = lost[gone, side].T
        every = np.r_[gone, row]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[every]), pa.array(tie[every]),
             pa.array(np.r_[at[gone] - hi, at[row] - ahead[row] + place]),
             pa.array(np.r_[hi - lo + 1, np.ones(len(row), np.int64)]),
             *(pa.concat_arrays([pa.nulls(len(gone), pa.int64()), signed(h)]) for h in hashes)],
            names=["doc", "tie", "start", "n", "a", "b"],
        )

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.array([1, 0])
        held, carried = None, none
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            right, left = _common(*_hashes(rows.column("right"))), _common(*_hashes(rows.column("left")))
            lo, hi = np.maximum(size - right, 0), left
            doc, tie, at = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie", "at"))
            later = (doc[1:] > doc[:-1]) | (doc[1:] == doc[:-1]) & (
                (tie[1:] > tie[:-1]) | (tie[1:] == tie[:-1]) & (at[1:] > at[:-1])
            )
            lost = np.empty((len(rows), 2, 2), np.int64)
            lost[:] = none
            lost[0, 0] = carried
            lost[1:, 0][later] = np.c_[lo, hi][later]
            lost[:-1, 1][~later] = np.c_[lo, hi][~later]
            if len(rows) > 1:
                yield told(rows.slice(0, len(rows) - 1), lost[:-1])
            held, carried = rows.slice(len(rows) - 1), lost[-1, 0]
        if held is not None:
            yield told(held, np.array([[carried, none]]))

    return body


def repeats(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc, tie, start, n``: runs of windows that also start earlier."""
    keyed, place = passages.keyed(docs), ["doc", "tie", "start"]
    spans = passages.repeated_spans(keyed, size, minimisers(size, gram))
    marked = settle(marked_neighbours(spans), "marked")
    distinct = marked.where(~F.col("again"))
    several = distinct.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    listed = (
        distinct.join(several, "key", "left_semi")
        .groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("at"))
    )
    # Rows that repeat an id and text give their suffixes once.
    texts = packed(keyed).join(listed, ["doc", "tie"]).dropDuplicates(["doc", "tie"])
    kept = settle(texts.mapInArrow(_suffixes_of(size, gram), SUFFIX), "suffix_words")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["right", "left", "doc", "tie", "at"]
    # Ranges are drawn by a few words, as the driver holds a sample of what they are drawn by.
    near = [F.substring("right", 1, 8), F.substring("right", 8 * gram + 1, 16), F.col("doc")]
    compared = settle(
        kept.repartitionByRange(parts, *near).sortWithinPartitions(*order)
        .mapInArrow(_neighbours(size), "doc long, tie long, start long, n long, a long, b long"),
        "compared",
    )
    windows = compared.where("a is not null")
    firsts = (
        windows.groupBy("a", "b").agg(F.min(F.struct(*place)).alias("_first"), F.count("*").alias("m")).where("m > 1")
    )
    apart = windows.join(firsts, ["a", "b"]).where(F.struct(*place) > F.col("_first"))
    return (
        marked.where("again").select(*place, "n")
        .unionByName(compared.where("a is null").select(*place, "n"))
        .unionByName(apart.select(*place, "n"))
    )


def remove_repeats(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document ``doc_id, n_words, n_removed`` and the SHA-256 of the kept words.

    Removed are the words covered by a window of ``size`` words whose sequence also starts
    earlier (smaller doc_id, or same document, earlier start); windows are judged on the
    input.  A null text has no words; a null doc_id comes last; rows that repeat an id and
    text share one result; texts shorter than a window lose nothing; an empty table gives an
    empty result; other columns are ignored.
    """
    return passages.digests(passages.keyed(docs), repeats(docs, size, gram), size)


def clean_documents(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents themselves without the words that :func:`remove_repeats` removes."""
    return passages.cleaned(docs, repeats(docs, size, gram), size)
