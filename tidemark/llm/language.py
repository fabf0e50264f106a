"""Language identification from hashed subwords.

A text is the average of the embeddings of its byte 3-grams and 4-grams, hashed into a fixed
number of buckets; a linear layer and a softmax follow.  Embeddings and layer are trained
together by stochastic gradient descent on a bounded sample of labelled rows, a temperature
calibrates the probabilities, and predictions that are more likely wrong than right are
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.words import in_small_batches

UNKNOWN = "und"
SPACE = 32
SPAN = 1 << 18


@dataclass(frozen=True)
class Training:
    """``rows`` bounds the sample of labelled rows.

    It is drawn by a digest of doc_id, of the text where that is null; of rows equal in doc_id and
    text one is taken.  ``held_back`` of it sets the temperature and the score below which a
    prediction is rejected: the least one from which on ``right`` of the held-back predictions are
    right, and never less than ``least``, so that a prediction is more likely right than wrong.
    """

    rows: int = 3000
    buckets: int = 1 << 14
    width: int = 16
    epochs: int = 10
    rate: float = 2.0
    held_back: float = 0.2
    least: float = 0.5
    right: float = 0.95
    seed: int = 7


def _folding() -> np.ndarray:
    """ASCII letters become lower case, other ASCII becomes a space, the rest stays."""
    table = np.full(256, SPACE, dtype=np.uint8)
    table[128:] = np.arange(128, 256)
    for b in range(ord("a"), ord("z") + 1):
        table[b] = table[b - 32] = b
    return table


FOLDED = _folding()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the bounds of its rows."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def subwords(flat: np.ndarray, bounds: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers and row numbers of all subwords, a span of bytes at a time.

    A subword lies within a word, or reaches over one edge of it by one byte.
    """
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    ends = bounds[1:]
    for at in range(0, len(flat), SPAN):
        b = FOLDED[flat[at : at + SPAN + 3]].astype(np.uint32)
        here = np.arange(at, min(at + SPAN, len(flat)))
        row = np.searchsorted(ends, here, side="right")
        left = ends[row] - here
        wide = b != SPACE
        for n in (3, 4):
            m = min(len(here), len(b) - n + 1)
            if m <= 0:
                continue
            code = np.zeros(m, dtype=np.uint32)
            for j in range(n):
                code = code * np.uint32(0x01000193) + b[j : j + m]
            code = (code ^ (code >> np.uint32(15))) * np.uint32(2654435769)
            fits = (left[:m] >= n) & wide[1 : 1 + m]
            if n == 4:
                fits &= wide[2 : 2 + m]
            yield (code[fits] >> shift).astype(np.int64), row[:m][fits]


def _sample(docs: DataFrame, fold: Column, training: Training) -> DataFrame:
    """At most ``training.rows`` labelled rows outside the held-out fold, however often one repeats."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~fold)
    usable = usable.select("doc_id", "lang", "text", F.xxhash64("text").alias("_hash"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("_hash").cast("string")))
    key = F.md5(F.concat(F.lit(str(training.seed)), own))
    drawn = usable.select(key.alias("_key"), "doc_id", "_hash").distinct()
    drawn = drawn.orderBy("_key", "doc_id", "_hash").limit(training.rows).select(
        F.col("doc_id").alias("_id"), F.col("_hash").alias("_of")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of"))
    rows = usable.join(F.broadcast(drawn), same, "left_semi")
    return rows.groupBy("doc_id", "_hash").agg(F.min("lang").alias("lang"), F.min("text").alias("text")).drop("_hash")


def _counts(training: Training):
    """Turn sampled rows into (doc_id, lang, distinct buckets, shares), packed."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = text_bytes(batch.column("text"))
            found: list[dict[int, int]] = []
            per_row = np.zeros((0,), dtype=np.int64)
            for code, row in subwords(flat, bounds, training.buckets):
                per_row = np.concatenate([per_row, row * training.buckets + code])
                if len(per_row) > 16 * SPAN:
                    found.append(_tally(per_row))
                    per_row = np.zeros((0,), dtype=np.int64)
            found.append(_tally(per_row))
            totals = pd.concat([pd.Series(f) for f in found]).groupby(level=0).sum() if found else pd.Series()
            keys, n = totals.index.to_numpy(dtype=np.int64), totals.to_numpy(dtype=np.float64)
            rows = keys // training.buckets
            packed = []
            for r in range(len(batch)):
                a, b = np.searchsorted(rows, [r, r + 1])
                share = n[a:b] / max(n[a:b].sum(), 1.0)
                packed.append(((keys[a:b] % training.buckets).astype("<i4").tobytes(), share.astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([p[0] for p in packed], pa.binary()),
                 pa.array([p[1] for p in packed], pa.binary())],
                names=["doc_id", "lang", "buckets", "shares"],
            )

    return body


def _tally(keys: np.ndarray) -> pd.Series:
    distinct, n = np.unique(keys, return_counts=True)
    return pd.Series(n, index=distinct)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(sample: pd.DataFrame, training: Training) -> tuple[list[str], np.ndarray, float]:
    """The learned languages, per bucket the calibrated log-score of each, and the least score accepted."""
    sample = sample.sort_values(["doc_id", "buckets", "shares"], kind="stable")
    langs = sorted(sample["lang"].unique())
    label = sample["lang"].map({l: i for i, l in enumerate(langs)}).to_numpy(dtype=np.int64)
    idx = [np.frombuffer(b, "<i4") for b in sample["buckets"]]
    share = [np.frombuffer(b, "<f4").astype(np.float64) for b in sample["shares"]]
    rng = np.random.default_rng(training.seed)
    embed = rng.uniform(-0.5, 0.5, (training.buckets, training.width))
    layer = np.zeros((training.width, len(langs)))
    order = rng.permutation(len(label))
    split = int(len(order) * (1 - training.held_back)) if len(order) >= 50 else len(order)
    learn, check = order[:split], order[split:]
    for epoch in range(training.epochs):
        rate = training.rate * (1 - epoch / training.epochs)
        for i in rng.permutation(learn):
            hidden = share[i] @ embed[idx[i]]
            error = _softmax(hidden @ layer)
            error[label[i]] -= 1.0
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            embed[idx[i]] -= rate * 20.0 * share[i][:, None] * back
    table = embed @ layer
    least = training.least
    if len(check):
        scores = np.array([share[i] @ table[idx[i]] for i in check])
        loss = lambda t: -np.log(np.maximum(_softmax(scores / t)[np.arange(len(check)), label[check]], 1e-12)).mean()
        warm = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        table, share = table / warm, _softmax(scores / warm)
        order = np.argsort(-share.max(axis=1), kind="stable")
        right = np.cumsum((share.argmax(axis=1) == label[check])[order]) / np.arange(1, len(check) + 1)
        enough = np.flatnonzero(right >= training.right)
        least = max(least, float(share.max(axis=1)[order][enough[-1]]) if len(enough) else 1.0)
    return langs, table.astype(np.float32), least


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray
    least: float


def train(docs: DataFrame, fold: Column, training: Training = Training()) -> Model:
    """Learn from a bounded sample of the rows outside ``fold`` that carry a language.

    Rows without doc_id take part; repeated rows count once.
    """
    counted = in_small_batches(_sample(docs, fold, training)).mapInArrow(
        _counts(training), "doc_id long, lang string, buckets binary, shares binary"
    )

    def in_one_task(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        langs, table, least = fit(sample, training)
        return pd.DataFrame({"langs": [langs], "table": [table.tobytes()], "least": [least]})

    made = counted.groupBy(F.lit(0).alias("all")).applyInPandas(in_one_task, "langs array<string>, table binary, least double")
    rows = made.collect()
    if not rows:
        return Model([], np.zeros((training.buckets, 0), np.float32), training.least)
    langs = list(rows[0]["langs"])
    table = np.frombuffer(bytes(rows[0]["table"]), np.float32).reshape(training.buckets, len(langs))
    return Model(langs, table, rows[0]["least"])


def _scored(model: Model):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, buckets = len(model.langs), len(model.table)
        for batch in batches:
            flat, bounds = text_bytes(batch.column("text"))
            total, n = np.zeros((len(batch), k)), np.zeros(len(batch))
            for code, row in subwords(flat, bounds, buckets):
                if not len(row):
                    continue
                at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                total[row[at]] += np.add.reduceat(model.table[code], at, axis=0)
                n[row[at]] += np.diff(np.r_[at, len(row)])
            share = _softmax(total / np.maximum(n, 1)[:, None]) if k else np.zeros((len(batch), 1))
            best = share.argmax(axis=1)
            known = batch.column("has_letter").to_numpy(zero_copy_only=False).astype(bool) & (k > 0)
            score = np.where(known, share.max(axis=1), 0.0)
            pred = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(~known | (score < model.least), pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return body


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is not rejected, with their own columns.

    A null ``lang`` becomes the predicted one.
    """
    score, names = _scored(model), list(docs.columns)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = next(score(iter([batch.select(["_id", "text", "has_letter"]).rename_columns(["doc_id", "text", "has_letter"])])))
            keep = pa.compute.invert(judged.column("rejected"))
            columns = [batch.column(f"_c{i}") for i in range(len(names))]
            if "lang" in names:
                at = names.index("lang")
                columns[at] = pa.compute.coalesce(columns[at], judged.column("lang_pred").cast(columns[at].type))
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    wide = docs.select(
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)],
        F.col("doc_id").cast("long").alias("_id"), "text", has_letter.alias("has_letter"),
    )
    return in_small_batches(wide).mapInArrow(body, docs.schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every whole text.

    A null text, a text without a letter, and every text when nothing was learned, is ``und``
    with score 0 and rejected.  Only the text is looked at; repeated rows agree; columns other
    than doc_id and text are ignored.
    """
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has_letter.alias("has_letter"))
    return in_small_batches(narrow).mapInArrow(
        _scored(model), "doc_id long, lang_pred string, score double, rejected boolean"
    )


def held_out(doc_id: Column) -> Column:
    """The test fold: crc32 of the id's text divisible by 5; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
