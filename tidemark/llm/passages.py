"""Repeated passages: words covered by a window that also starts earlier.

A window is ``size`` consecutive words.  It repeats when its word sequence also starts
earlier in the order (doc_id, start), and every word it covers is removed.  Windows are
assigned to anchors by a rule that looks at nothing but the window's own words, so equal
windows have equal anchors; the neighbouring windows of one anchor form a span.

1. Anchors whose key occurs once cannot lie in a repeat and are left out.
2. Spans that are equal as a whole are found by their key and hash; all windows of the
   later ones repeat.
3. Of the distinct spans that remain under one key, single windows are compared.

The steps move hashes and positions; texts move only where windows are compared and where
words are removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.flat import WORD_BASES, Sequences, flat_words, packed, signed, slices, unpacked, with_text
from tidemark.llm.words import in_small_batches, row_of
from tidemark.settings import settle

LAST = 2**63 - 1
SPAN = "key long, span long, doc long, tie long, start long, n long"

# words, sequence hashes, starts of all windows -> position of each window's anchor and key.
Anchors = Callable[[np.ndarray, Sequences, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def text_tie() -> Column:
    """All 64 bits of the text's hash: rows without an id have no other identity."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc, tie, text``: a null id comes last, equal ids are told apart by their text."""
    return in_small_batches(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        text_tie().alias("tie"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """The starts of all windows that lie within one row."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    ahead = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(bounds[:-1] - ahead, counts)


def _spans(batch: pa.RecordBatch, size: int, anchors: Anchors) -> pa.RecordBatch | None:
    words, bounds = flat_words(batch)
    at = _window_starts(bounds, size)
    if not len(at):
        return None
    runs = Sequences(words, WORD_BASES[0])
    anchor, key = anchors(words, runs, at, bounds)
    fresh = np.r_[True, (np.diff(at) != 1) | (np.diff(anchor) != 0)]
    first = np.flatnonzero(fresh)
    n = np.diff(np.r_[first, len(at)])
    start = at[first]
    row = np.searchsorted(bounds, start, side="right") - 1
    doc, tie = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "tie"))
    return pa.RecordBatch.from_arrays(
        [signed(key[first]), signed(runs.of(start, n - 1 + size)), pa.array(doc), pa.array(tie),
         pa.array(start - bounds[row]), pa.array(n)],
        names=["key", "span", "doc", "tie", "start", "n"],
    )


def _span_rows(size: int, anchors: Anchors):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = _spans(part, size, anchors)
                if found is not None:
                    yield found

    return body


def _key_counts(size: int, anchors: Anchors):
    """Per batch each key once, with how often it occurs."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = _spans(part, size, anchors)
                if found is not None:
                    key, n = np.unique(found.column("key").to_numpy(), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    return body


def repeated_spans(docs: DataFrame, size: int, anchors: Anchors) -> DataFrame:
    """The spans whose anchor's key occurs more than once."""
    counts = docs.mapInArrow(_key_counts(size, anchors), "key long, n long")
    shared = settle(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "keys")
    spans = docs.mapInArrow(_span_rows(size, anchors), SPAN)
    return settle(spans.join(shared, "key"), "spans")


def first_of_equal(spans: DataFrame) -> DataFrame:
    """Mark each span ``again`` when an equal one lies earlier."""
    place = F.struct("doc", "tie", "start")
    firsts = spans.groupBy("key", "span").agg(F.min(place).alias("_first"))
    return spans.join(firsts, ["key", "span"]).withColumn("again", place > F.col("_first")).drop("_first")


def _windows_of(size: int):
    """Hash the single windows of listed spans: rows ``doc, tie, packed, at`` (list of start, n)."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 500):
                part = with_text(batch.slice(first, 500))
                words, bounds = flat_words(part)
                runs = [Sequences(words, b) for b in WORD_BASES]
                lists = part.column("at")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                start = np.asarray(lists.flatten().field("start"))
                n = np.asarray(lists.flatten().field("n"))
                row = np.repeat(np.repeat(np.arange(len(part)), sizes), n)
                ahead = np.cumsum(n) - n
                local = np.arange(n.sum()) - np.repeat(ahead - start, n)
                at = local + bounds[row]
                doc, tie = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "tie"))
                yield pa.RecordBatch.from_arrays(
                    [signed(runs[0].of(at, size)), signed(runs[1].of(at, size)), pa.array(doc), pa.array(tie), pa.array(local)],
                    names=["a", "b", "doc", "tie", "start"],
                )

    return body


def repeated_windows(docs: DataFrame, marked: DataFrame, size: int) -> DataFrame:
    """``doc, tie, start, n``: runs of windows that also start earlier."""
    place = ["doc", "tie", "start"]
    distinct = marked.where(~F.col("again")).dropDuplicates(["key", "span"])
    several = distinct.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    open_spans = distinct.join(several, "key", "left_semi")
    listed = open_spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("at"))
    windows = settle(
        packed(docs).join(listed, ["doc", "tie"]).mapInArrow(
            _windows_of(size), "a long, b long, doc long, tie long, start long"
        ),
        "windows",
    )
    firsts = (
        windows.groupBy("a", "b").agg(F.min(F.struct(*place)).alias("_first"), F.count("*").alias("m")).where("m > 1")
    )
    single = windows.join(firsts, ["a", "b"]).where(F.struct(*place) > F.col("_first"))
    return (
        marked.where("again").select(*place, "n")
        .unionByName(single.select(*place, F.lit(1).cast("long").alias("n")))
    )


def _kept_words(words: list[bytes], start, n, size: int) -> list[bool]:
    """Which words no listed run of windows covers."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    start, n = np.asarray(start, dtype=np.int64), np.asarray(n, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n - 1 + size, -1)
    return (np.cumsum(edge[:-1]) == 0).tolist()


def _digests(size: int):
    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, at in zip(batch["doc"], unpacked(batch["packed"]), batch["at"]):
                words = left = text.split()
                if at is not None and len(at):
                    keep = _kept_words(words, [x["start"] for x in at], [x["n"] for x in at], size)
                    left = [w for w, k in zip(words, keep) if k]
                out.append((doc, len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            yield pd.DataFrame(out, columns=["doc", "n_words", "n_removed", "kept_sha256"])

    return body


def _lists(runs: DataFrame) -> DataFrame:
    return runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("at"))


def digests(docs: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of :func:`keyed` documents."""
    return (
        packed(docs).join(_lists(runs), ["doc", "tie"], "left")
        .mapInPandas(_digests(size), "doc long, n_words long, n_removed long, kept_sha256 string")
        .select(F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
    )


def cleaned(docs: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """The documents with the covered words cut out of ``text``, and ``n_chars`` to match.

    Texts without covered words stay as they are, white space included; a document that loses
    all its words goes.
    """
    solid = re.compile(rb"[^\x20\x09-\x0D]+")

    def cut(text: pd.Series, start: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for t, s, m in zip(text, start, n):
            if t is None or s is None:
                out.append(None)
                continue
            data = t.encode("utf-8")
            spans = [x.span() for x in solid.finditer(data)]
            keep = _kept_words(spans, s, m, size)
            parts, behind = [], 0
            for (a, b), k in zip(spans, keep):
                if k:
                    parts.append(data[behind:b] if parts else data[a:b])
                behind = b
            out.append(b"".join(parts).decode("utf-8"))
        return pd.Series(out, dtype=object)

    cut_udf = F.pandas_udf(cut, "string")
    wide = docs.select(
        row_of(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"), text_tie().alias("_tie")
    )
    lists = _lists(runs).select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), F.col("at").alias("_at"))
    joined = wide.join(lists, ["_doc", "_tie"], "left").withColumn(
        "_cut", cut_udf(F.when(F.col("_at").isNotNull(), F.col("_row.text")), F.col("_at.start"), F.col("_at.n"))
    )
    cut_text, was = F.col("_cut"), lambda c: F.col("_row").getField(c)
    new = {
        "text": F.coalesce(cut_text, was("text")),
        "n_chars": F.when(cut_text.isNotNull(), F.length(cut_text)).otherwise(was("n_chars"))
        .cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None,
    }
    return joined.where(cut_text.isNull() | (F.length(cut_text) > 0)).select(
        *[new[c].alias(c) if new.get(c) is not None else was(c).alias(c) for c in docs.columns]
    )
