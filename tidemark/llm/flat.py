"""Words of a batch of texts as flat numpy arrays: one 64-bit hash per word.

A text column stays one array of bytes; a word's hash is a polynomial over its bytes and
equal sequences of words have equal polynomials over their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.language import text_bytes

BYTE_BASE = np.uint64(0x9E3779B97F4A7C55)
WORD_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D))
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_AS_IS = np.arange(1, 257, dtype=np.uint64)
_LOWER = _AS_IS.copy()
_LOWER[65:91] = _AS_IS[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def word_hashes(flat: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the bounds of each row within them."""
    if not len(flat):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    solid = ~_SPACE[flat]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = bounds[1:-1]
    edge = edge[edge < len(flat)]
    begins[edge] |= solid[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    sizes = np.diff(np.r_[starts, len(flat)])
    flat, solid = flat[starts[0] :], solid[starts[0] :]
    place = np.arange(len(flat)) - np.repeat(starts - starts[0], sizes)
    letters = np.add.reduceat(solid.astype(np.int64), starts - starts[0])
    table = powers(BYTE_BASE, int(letters.max()) + 1)
    value = (_LOWER if lower else _AS_IS)[flat] * table[np.minimum(place, len(table) - 1)]
    value[~solid] = 0
    total = np.add.reduceat(value, starts - starts[0])
    return mix(total + letters.astype(np.uint64)), np.searchsorted(starts, bounds)


class Sequences:
    """Hashes of any run of words in O(1), from running sums of a polynomial."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        self.back = powers(inverse(base), len(words) + 1)
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * powers(base, len(words))[: len(words)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        """Hash of ``size`` words from ``start`` on; the size takes part."""
        raw = (self.sums[start + size] - self.sums[start]) * self.back[start]
        return mix(raw + np.asarray(size, dtype=np.uint64))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds few texts or one, and little memory is used at once."""
    size = np.frombuffer(
        batch.column("text").cast(pa.large_string()).fill_null("").buffers()[1], dtype=np.int64
    )
    offset = batch.column("text").offset
    size = size[offset : offset + len(batch) + 1]
    at = 0
    while at < len(batch):
        end = int(np.searchsorted(size, size[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, at + 1), len(batch))
        yield batch.slice(at, end - at)
        at = end


def flat_words(batch: pa.RecordBatch, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*text_bytes(batch.column("text")), lower)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in slices(batch):
            packed = [squeeze.compress(t.encode("utf-8")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("tie"), pa.array(packed, pa.binary())], names=["doc", "tie", "packed"]
            )


def packed(docs: DataFrame) -> DataFrame:
    """``doc, tie, packed``: the texts compressed for a shuffle, about half the size it gives them."""
    return docs.select("doc", "tie", "text").mapInArrow(_pack, "doc long, tie long, packed binary")


def unpacked(values) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor()
    return [open_.decompress(v) for v in values]


def with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with ``packed`` opened as ``text``."""
    text = pa.array(unpacked(batch.column("packed").to_pylist()), pa.large_binary()).cast(pa.large_string())
    at = batch.schema.get_field_index("packed")
    return batch.set_column(at, pa.field("text", pa.large_string()), text)
