"""Links between the tokens that two tokenizers make of the same text.

Tokenizer A is a byte-level BPE file, tokenizer B a sentencepiece model.  Both see the text behind
one space.  Byte offsets where tokens of both end cut a text into groups, and the tokens of a
group are linked with one another.

The work in a task runs on Arrow arrays.  A text is cut before single spaces that follow a visible
ASCII character, where both tokenizers always cut; equal chunks of a slice of documents are found
by dictionary encoding and aligned once.  Token lists are flattened and keep parent indices; byte
ends are segmented cumulative sums; an Acero hash join on (chunk, end) finds the common ends, one
on the group links tokens; ``Table.group_by`` counts a slice's pairs, and Spark merges the counts.

A slice leaves its task compressed and cut into parts, so what Spark reads, sorts and shuffles are rows
of bounded size that unpack only in the function that wants the slice.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from tidemark.llm.bpe import _byte_alphabet
from tidemark.settings import settle

SLICE_BYTES = 2 << 20
ENCODED_CHUNKS = 8192
LINK_ROWS = 1 << 20
PART_BYTES, PART_PAIRS = 1 << 16, 1 << 12
# Readers and writers hold a row group at a time.
ROW_GROUP_BYTES = 16 << 20
SPACE_SIGN = "▁"

SLICE = "block long, part int, body binary, pair array<long>, docs array<long>"
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of = {c: bytes([i]) for i, c in enumerate(_byte_alphabet())}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = pa.array([b"".join(byte_of.get(c, c.encode()) for c in name) for name in names], pa.binary())
        self.size_b = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = pa.array([self._piece_bytes(i, p) for i, p in enumerate(pieces)], pa.binary())
        # Chunks may be encoded alone while no piece goes on past a space.
        self.cuts = not any(re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}", p) for p in pieces)

    def _piece_bytes(self, i: int, piece: str) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return piece.replace(SPACE_SIGN, " ").encode()

    def encode_a(self, chunks: list[str]) -> list[list[int]]:
        """In steps, as an encoding holds far more than its ids."""
        return [
            e.ids for i in range(0, len(chunks), ENCODED_CHUNKS)
            for e in self.a.encode_batch_fast(chunks[i : i + ENCODED_CHUNKS], add_special_tokens=False)
        ]

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """Chunks start with the space that this tokenizer adds itself."""
        return self.b.encode([c[1:] for c in chunks], num_threads=1)


@cache
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between bounds; an empty stretch sums to 0."""
    return np.diff(np.r_[0, np.cumsum(values)][bounds])


class Tokens:
    """The tokens of all chunks in one array, with their chunk and the byte they end at in it."""

    def __init__(self, ids: list[list[int]], table: pa.BinaryArray, chunks: pa.BinaryArray):
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        listed = _lists(pa.array([i for row in ids for i in row], pa.int32()), np.r_[0, np.cumsum(sizes)])
        self.ids, self.parent = listed.flatten(), pc.list_parent_indices(listed).to_numpy()
        text = table.take(self.ids)
        offsets = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1].astype(np.int64)
        starts = offsets[np.r_[0, np.cumsum(sizes)]]
        self.end = offsets[1:] - starts[self.parent]
        joined = pa.BinaryArray.from_buffers(
            pa.binary(), len(ids), [None, pa.py_buffer(starts.astype(np.int32).tobytes()), text.buffers()[2]]
        )
        self.whole = pc.equal(joined, chunks).to_numpy(zero_copy_only=False)
        self.sizes = sizes

    def only(self, sound: np.ndarray) -> Tokens:
        """The tokens of sound chunks."""
        here = sound[self.parent]
        self.ids, self.parent, self.end = self.ids.filter(pa.array(here)), self.parent[here], self.end[here]
        self.sizes = np.where(sound, self.sizes, 0)
        return self


def _linked(group_a, ids_a, group_b, ids_b, chunk_of_group, size_b: int) -> pa.Table:
    """``chunk, pair, times`` of all links, by a hash join on the group in bounded steps."""

    def counted(group, ids, name):
        rows = pa.table({"group": group, name: ids}).group_by(["group", name], use_threads=False)
        return rows.aggregate([([], "count_all")]).rename_columns(["group", name, f"n_{name}"]).sort_by("group")

    a, b = counted(group_a, ids_a, "a"), counted(group_b, ids_b, "b")
    at, other = a["group"].to_numpy(), b["group"].to_numpy()
    first, last = np.searchsorted(other, at, "left"), np.searchsorted(other, at, "right")
    reach, found, lo = np.cumsum(last - first), [], 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + LINK_ROWS, "right")))
        part = a.slice(lo, hi - lo).join(b.slice(first[lo], last[hi - 1] - first[lo]), "group", join_type="inner", use_threads=False)
        pair = pc.add(pc.multiply(part["a"].cast(pa.int64()), size_b), part["b"].cast(pa.int64()))
        chunk = pa.array(chunk_of_group[part["group"].to_numpy()])
        rows = pa.table({"chunk": chunk, "pair": pair, "times": pc.multiply(part["n_a"], part["n_b"])})
        found.append(rows.group_by(["chunk", "pair"], use_threads=False).aggregate([("times", "sum")]))
        lo = hi
    empty = pa.table({"chunk": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "times_sum": pa.array([], pa.int64())})
    rows = pa.concat_tables(found) if found else empty
    if len(found) > 1:
        rows = rows.rename_columns(["chunk", "pair", "times"]).group_by(["chunk", "pair"], use_threads=False)
        rows = rows.aggregate([("times", "sum")])
    return rows.rename_columns(["chunk", "pair", "times"]).sort_by([("chunk", "ascending"), ("pair", "ascending")])


class Aligned:
    """Distinct chunks with their numbers of tokens, groups and links, their groups as text, and their pairs."""

    def __init__(self, chunks: pa.BinaryArray, tokenizers: Pair):
        texts = chunks.cast(pa.string()).to_pylist()
        a = Tokens(tokenizers.encode_a(texts), tokenizers.bytes_a, chunks)
        b = Tokens(tokenizers.encode_b(texts), tokenizers.bytes_b, chunks)
        self.sound = a.whole & b.whole
        a, b = a.only(self.sound), b.only(self.sound)
        keyed = [pa.table({"chunk": t.parent.astype(np.int64), "end": t.end}) for t in (a, b)]
        common = keyed[0].join(keyed[1], ["chunk", "end"], join_type="inner", use_threads=False)
        # Offsets in all chunks laid end to end put (chunk, end) in one order.
        base = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks)].astype(np.int64)
        ends = np.sort(base[common["chunk"].to_numpy()] + common["end"].to_numpy())
        group_a = np.searchsorted(ends, base[a.parent] + a.end)
        group_b = np.searchsorted(ends, base[b.parent] + b.end)
        chunk_of = np.zeros(len(ends), np.int64)
        chunk_of[group_a] = a.parent
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        bounds = np.searchsorted(chunk_of, np.arange(len(chunks) + 1))
        self.n_a, self.n_b, self.n_groups = a.sizes, b.sizes, np.diff(bounds)
        self.n_links = _sums(in_a * in_b, bounds)
        named = [
            pc.binary_join(_lists(t.ids.cast(pa.string()), np.r_[0, np.cumsum(n)]), ",") for t, n in ((a, in_a), (b, in_b))
        ]
        self.groups = pc.binary_join(_lists(pc.binary_join_element_wise(*named, "|"), bounds), ";")
        pairs = _linked(group_a, a.ids, group_b, b.ids, chunk_of, tokenizers.size_b)
        self.pair, self.times = pairs["pair"].to_numpy(), pairs["times"].to_numpy()
        self.pairs_from = np.searchsorted(pairs["chunk"].to_numpy(), np.arange(len(chunks) + 1))


def _chunked(texts: pa.Array, cuts: bool) -> tuple[pa.BinaryArray, np.ndarray]:
    """The texts behind one space as chunks, and each text's bounds among them."""
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    spaced = pc.binary_join_element_wise(none, texts.cast(pa.large_string()), space).cast(pa.large_binary())
    data, offsets = spaced.buffers()[2], np.frombuffer(spaced.buffers()[1], np.int64)[: len(spaced) + 1]
    flat = np.frombuffer(data, np.uint8)[: offsets[-1]]
    begins = np.zeros(len(flat), bool)
    if cuts:
        begins[1:] = (flat[1:] == 0x20) & (flat[:-1] > 0x20) & (flat[:-1] < 0x7F)
        # A space that ends a text stays with its word: alone, it would be the one that B adds.
        begins[offsets[1:] - 1] = False
    begins[offsets[:-1]] = True
    starts = np.flatnonzero(begins)
    places = pa.py_buffer(np.r_[starts, len(flat)].astype(np.int32).tobytes())
    chunks = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, places, data])
    return chunks, np.searchsorted(starts, offsets)


def _slice(doc_ids: pa.Array, texts: pa.Array, tokenizers: Pair, block: int) -> pa.RecordBatch:
    """The parts of a slice: its documents with their links as places in its ordered list of pairs, and that list."""
    n = len(texts)
    empty = pc.equal(pc.binary_length(texts.fill_null("")), 0).to_numpy(zero_copy_only=False)
    full = np.flatnonzero(~empty)
    chunks, bounds = _chunked(texts.take(pa.array(full)), tokenizers.cuts)
    coded = chunks.dictionary_encode()
    known = Aligned(coded.dictionary, tokenizers)
    of, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(full)), np.diff(bounds))
    sound = _sums(~known.sound[of], bounds) == 0

    def per_doc(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[full] = np.where(sound, _sums(values[of], bounds), 0)
        return out

    named = pc.binary_join(_lists(known.groups.take(coded.indices), bounds), ";").to_pylist()
    sha = [""] * n
    for i in np.flatnonzero(sound):
        sha[full[i]] = hashlib.sha256(named[i].encode()).hexdigest()

    here = sound[doc]
    used = pa.table({"doc": doc[here], "chunk": of[here].astype(np.int64)}).group_by(["doc", "chunk"], use_threads=False)
    used = used.aggregate([([], "count_all")])
    chunk = used["chunk"].to_numpy()
    sizes = np.diff(known.pairs_from)[chunk]
    place = np.arange(sizes.sum()) + np.repeat(known.pairs_from[chunk] - (np.cumsum(sizes) - sizes), sizes)
    rows = pa.table({
        "doc": np.repeat(used["doc"].to_numpy(), sizes), "pair": known.pair[place],
        "times": np.repeat(used["count_all"].to_numpy(), sizes) * known.times[place],
    })
    held = rows.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]).sort_by("doc")
    counts = held.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
    pairs = counts["pair"].to_numpy()
    owner = np.zeros(n, np.int64)
    np.add.at(owner, full[held["doc"].to_numpy()], 1)

    def one(values, kind) -> pa.ListArray:
        return _lists(pa.array(values, kind) if not isinstance(values, pa.Array) else values.cast(kind), np.array([0, len(values)]))

    long = pa.int64()
    fields = {
        "doc_id": one(doc_ids, long), "n_a": one(per_doc(known.n_a), long),
        "n_b": one(per_doc(known.n_b), long), "n_groups": one(per_doc(known.n_groups), long),
        "n_links": one(per_doc(known.n_links), long), "sha": one(sha, pa.string()),
        "bounds": one(np.r_[0, np.cumsum(owner)], long),
        "at": one(np.searchsorted(pairs, held["pair"].to_numpy()).astype(np.int32), pa.int32()),
        "times": one(held["times_sum"].to_numpy(), long),
    }
    body = _packed(pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields)))
    return _parts(block, body, pairs, counts["count_all"].to_numpy())


def _packed(row: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _parts(block: int, body: bytes, pairs: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """The bytes and the pairs of a slice, dealt to rows of bounded size."""
    n = max(-(-len(body) // PART_BYTES), -(-len(pairs) // PART_PAIRS))
    upto = np.minimum(np.arange(n + 1) * PART_PAIRS, len(pairs))
    fields = {
        "block": pa.array(np.full(n, block)), "part": pa.array(np.arange(n, dtype=np.int32)),
        "body": pa.array([body[i * PART_BYTES : (i + 1) * PART_BYTES] for i in range(n)], pa.binary()),
        "pair": _lists(pa.array(pairs, pa.int64()), upto), "docs": _lists(pa.array(docs, pa.int64()), upto),
    }
    return pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields))


def _slices(path_a: str, path_b: str):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, block = pair_of(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text")
            upto = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
            at = 0
            while at < len(batch):
                end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, "right"))
                end = min(max(end, at + 1), len(batch))
                yield _slice(batch.column("doc_id").slice(at, end - at), texts.slice(at, end - at), tokenizers, block)
                block, at = block + 1, end

    return body


def _with_counts(parts: pa.Table, told: pa.Table) -> pa.Table:
    """Back from a slice to documents: sums over each one's links of what the slice's pairs count."""
    body = b"".join(parts.sort_by("part")["body"].to_pylist())
    row = pa.ipc.open_stream(body).read_next_batch()
    values = {name: row.column(name).flatten() for name in row.schema.names}
    # Every pair of the slice is told once, so in order they stand at their places in its list.
    told = told.sort_by("pair")
    count, best = told["count"].to_numpy(), told["best"].to_numpy()
    at, times, bounds = (values[name].to_numpy() for name in ("at", "times", "bounds"))
    return pa.table(
        [values[name] for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        + [pa.array(_sums(times * best[at], bounds)), pa.array(_sums(times * count[at], bounds)), values["sha"]],
        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    )


def pair_counts(slices: DataFrame, size_b: int) -> DataFrame:
    """``pair, count, best``: the documents that link a pair, and whether that is its A id's highest.

    The slices' partial counts are merged; the highest per A id is one row per token of a vocabulary.
    """
    listed = slices.select(F.explode(F.arrays_zip("pair", "docs")).alias("x")).select("x.pair", "x.docs")
    totals = settle(
        listed.groupBy("pair").agg(F.sum("docs").alias("count"))
        .withColumn("a", F.floor(F.col("pair") / size_b).cast("long")),
        "pair_counts",
    )
    highest = totals.groupBy("a").agg(F.max("count").alias("most"))
    return totals.join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document the numbers of tokens, groups and links, and what its pairs count in the corpus.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.  A text that
    is null, empty, or not spelled by the bytes of its A or B tokens has no tokens: zeros and an
    empty digest.  Repeated rows, and rows without id, are documents of their own and counted each.
    An empty table gives an empty result; other columns are ignored.

    A slice of documents carries its links as places in its own list of pairs.  Corpus counts go
    back to the slices per distinct pair, not per document, so a frequent pair costs a row per slice;
    slices and counts meet one slice at a time.
    """
    narrow = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    slices = settle(
        narrow.mapInArrow(_slices(path_a, path_b), SLICE), "token_links", **{"parquet.block.size": str(ROW_GROUP_BYTES)}
    )
    totals = pair_counts(slices, pair_of(path_a, path_b).size_b)
    told = slices.select(F.col("block").alias("of"), F.explode("pair").alias("pair")).join(totals, "pair")
    bodies = slices.select("block", "part", "body").groupBy("block")
    return bodies.cogroup(told.groupBy("of")).applyInArrow(_with_counts, ALIGNED)
