"""Vectors compressed to one byte per part, with codebooks learned by k-means.

The nearest entry of a codebook is found by slicing and intersecting.  Per dimension the entries
stand sorted by coordinate, and every place in that order carries the bit mask of the entries
before it.  A radius cuts one range out of each dimension, the difference of two prefix masks; the
masks of all dimensions, ANDed as uint64 words, leave the entries inside a box around the point.
Only these are measured.  The answer is proven once the best distance is within the radius;
points without proof go on with the best distance found, or twice the radius, as their new one.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.spread import join_same
from tidemark.llm.topk import whole_numbers
from tidemark.settings import max_broadcast_rows, settle

POINTS = 2048
PROBES = 32
SALTS = 16
FAR = np.iinfo(np.int64).max


class Slices:
    """The sorted coordinates and prefix masks of one codebook (entries x dimensions)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        words = -(-n // 64)
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        bits = np.zeros((n, words), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.prefix = np.zeros((width, n + 1, words), np.uint64)
        for j in range(width):
            np.bitwise_or.accumulate(bits[self.order[:, j]], axis=0, out=self.prefix[j, 1:])

    def inside(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, entry) whose coordinates all differ by ``radius`` at most, in order."""
        mask = None
        for j in range(points.shape[1]):
            lo = np.searchsorted(self.sorted[:, j], points[:, j] - radius, side="left")
            hi = np.searchsorted(self.sorted[:, j], points[:, j] + radius, side="right")
            here = self.prefix[j, hi] ^ self.prefix[j, lo]
            mask = here if mask is None else mask & here
        if mask is None:
            mask = np.tile(np.bitwise_or.reduce(self.prefix[:, -1], axis=0), (len(points), 1))
        held = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(held[:, : len(self.entries)])

    def measure(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per point the nearest entry inside the box and its squared distance, ``FAR`` if none."""
        entry, best = np.zeros(len(points), np.int64), np.full(len(points), FAR)
        at, e = self.inside(points, radius)
        if len(at):
            gap = points[at] - self.entries[e]
            far = np.einsum("ij,ij->i", gap, gap)
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            least = np.minimum.reduceat(far, starts)
            sizes = np.diff(np.r_[starts, len(at)])
            hits = np.flatnonzero(far == np.repeat(least, sizes))
            # Entries of a point ascend, so its first hit has the lowest index.
            owner = at[hits]
            first = hits[np.r_[True, owner[1:] != owner[:-1]]]
            entry[at[starts]], best[at[starts]] = e[first], least
        return entry, best

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every point, ties to the lower index, and its squared distance."""
        entry, best = np.zeros(len(points), np.int64), np.full(len(points), FAR)
        probes = points[:: max(1, len(points) // PROBES)][:PROBES]
        gaps = np.abs(probes[:, None, :] - self.entries[None, :, :]).max(2).min(1)
        # The radius decides the work only: a typical distance from a point to its nearest box.
        start = max(1, int(np.median(gaps) * 1.5))
        radius = np.full(len(points), start)
        todo = np.arange(len(points))
        while len(todo):
            found, far = self.measure(points[todo], radius[todo])
            entry[todo], best[todo] = found, far
            root = np.sqrt(np.minimum(far, 2**62).astype(float)).astype(np.int64) + 1
            open_ = (far == FAR) | (far > radius[todo] ** 2)
            radius[todo] = np.where(far == FAR, 2 * radius[todo] + 1, root)
            todo = todo[open_]
        return entry, best


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; shorter rows are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _assigned(codebooks: np.ndarray) -> Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Cut points into chunks; each gives its vectors by part, entries and squared distances."""
    parts, _, width = codebooks.shape
    slices = [Slices(book) for book in codebooks]

    def body(vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(vectors), POINTS):
            cut = vectors[at : at + POINTS].reshape(-1, parts, width)
            found = [slices[p].nearest(cut[:, p]) for p in range(parts)]
            yield cut, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    return body


def _partial_sums(codebooks: np.ndarray):
    """A task's sums and counts per part and entry: as many rows as the codebooks have entries."""
    parts, n, width = codebooks.shape

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigned = _assigned(codebooks)
        sums, counts = np.zeros((parts * n, width), np.int64), np.zeros(parts * n, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            for cut, entry, _ in assigned(matrix(batch.column("v"), parts * width)):
                key = (entry + np.arange(parts) * n).ravel()
                order = np.argsort(key, kind="stable")
                key, rows = key[order], cut.reshape(-1, width)[order]
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                sums[key[starts]] += np.add.reduceat(rows, starts, axis=0)
                counts[key[starts]] += np.diff(np.r_[starts, len(key)])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((used // n).astype(np.int32)), pa.array((used % n).astype(np.int32)), pa.array(counts[used]),
                pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * width, pa.array(sums[used].ravel())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    return body


def _codes(codebooks: np.ndarray):
    parts, _, width = codebooks.shape

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigned = _assigned(codebooks)
        for batch in batches:
            if not len(batch):
                continue
            found = list(assigned(matrix(batch.column("v"), parts * width)))
            digits = np.concatenate([f[1] for f in found]).astype(np.uint8).tobytes().hex()
            codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            error = np.concatenate([f[2] for f in found]).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    return body


def kept_vectors(embeddings: DataFrame, factor: int = 1024) -> DataFrame:
    """``vec_id, label, v``: the vectors as whole numbers, without those that hold no finite number."""
    return settle(
        embeddings.select(
            F.col("vec_id").cast("long").alias("vec_id"), "label", whole_numbers(F.col("embedding"), factor).alias("v")
        ).where(F.col("v").isNotNull()),
        "vectors",
    )


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids: an array (part, entry, position).

    Only ``entries`` vectors reach the driver.  An id on several rows stands once, with its
    smallest vector; rows without id count as one id, the last.
    """
    ids = [r[0] for r in kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    one_of = F.col("vec_id").isin([i for i in ids if i is not None])
    if None in ids:
        one_of = F.coalesce(one_of, F.lit(True))
    rows = kept.where(one_of).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("vec_id")).collect()
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    out = np.zeros((len(rows), parts * width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r["v"])] = r["v"]
    return np.ascontiguousarray(out.reshape(len(rows), parts, width).transpose(1, 0, 2))


def train(kept: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray:
    """Codebooks after ``rounds`` of k-means over every vector.

    A round is one pass: tasks sum up their vectors per part and entry, Spark merges the sums,
    and the driver receives one row per entry, however many vectors there are.
    """
    if entries > 256:
        raise ValueError("a code has one byte per part, so a codebook has 256 entries at most")
    books = first_codebooks(kept, parts, entries)
    if not books.shape[1]:
        return books
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(_partial_sums(books), "part int, entry int, n long, sums array<long>")
        merged = sums.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(books.shape[2])]).alias("sums")
        )
        books = books.copy()
        for r in merged.collect():
            books[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits per part and the summed squared distances."""
    kind = kept.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, code string, error long"
    if not books.shape[1]:
        return kept.sparkSession.createDataFrame([], schema)
    return kept.mapInArrow(_codes(books), schema)


def decode(code: str, books: np.ndarray) -> list[int]:
    """The vector that a code stands for."""
    return [x for p, e in enumerate(bytes.fromhex(code)) for x in books[p, e].tolist()]


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the error summed over rows of equal label, nulls together.

    Labels are few as a rule; their totals are copied to the tasks while their number is within
    the session's limit.  Otherwise rows of one label are dealt over several salts.
    """
    coded = settle(coded, "codes")
    totals = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    if totals.count() <= max_broadcast_rows(coded.sparkSession):
        return join_same(coded, F.broadcast(totals), ["label"])
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    spread = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn(
        "_salt", F.col("_salt").cast("long")
    )
    return join_same(salted, spread, ["label", "_salt"]).drop("_salt")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(
    embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, factor: int = 1024
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``, one row per kept row.

    Rows whose vector is null or holds a null or non-finite component are left out.  Vectors
    count as padded with zeros to the longest one, and that to a multiple of ``parts``; repeated
    rows count each; a row without id is coded, and starts an entry only after all ids; a null
    label is a label of its own.  Components must stay below 2**26 in size for errors to fit
    64 bits.  An empty table gives an empty result; other columns are ignored.
    """
    kept = kept_vectors(embeddings, factor)
    books = train(kept, parts, entries, rounds)
    coded = with_label_error(encode(kept, books))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
