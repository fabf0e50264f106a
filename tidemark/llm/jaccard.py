"""N-gram Jaccard join as a grouped prefix join.

A text's set holds the hashes of its distinct word 5-grams.  Texts with equal sets are one
class.  All tokens have one global order, common ones last, and two sets that are similar
enough share a token within a prefix of that order.  Classes with the same prefix and size
form a group; tokens index groups, group pairs are filtered by size and position, and only
then expanded to class pairs, which are first bounded by parity bitmaps and then verified on
the whole sets.

Links need only be known up to components: each group is first compared with one other group
per token, and later only with groups that hold another component.  Copies and large groups
of near copies therefore never form all their pairs, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from tidemark.llm.components import components
from tidemark.llm.flat import WORD_BASES, Sequences, flat_words, mix, signed, slices
from tidemark.llm.words import in_small_batches, row_of
from tidemark.settings import max_broadcast_rows, settle

GRAM = 5
SHARE = 75
COUNTER_BITS = 22
CHUNKS = 64
HUB_ROUNDS = 2
CELLS = 512
SIGNS = [f"s{i}" for i in range(CELLS // 64)]
PREFIX_ROWS = "cls long, n long, grp long, prefix array<long>, " + ", ".join(f"{c} long" for c in SIGNS)
LAST = 2**63 - 1
SET_ROWS = "doc long, tie long, n long, cls long, bits binary, chunk int, part int, counts binary"


def token_rows(words: np.ndarray, bounds: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes per row, sorted: tokens and row numbers."""
    sizes = np.diff(bounds)
    runs = Sequences(words, WORD_BASES[0])
    counts = np.where(sizes >= gram, sizes - gram + 1, np.minimum(sizes, 1))
    row = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[row]
    tokens = runs.of(start, np.minimum(sizes[row], gram))
    order = np.lexsort((tokens, row))
    tokens, row = tokens[order], row[order]
    fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])][: len(tokens)]
    return tokens[fresh], row[fresh]


def parity_bits(tokens: np.ndarray) -> bytes:
    """The parity of the number of tokens in each of at least 2n cells, as bits."""
    cells = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of how many tokens are in one of two sets only."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def counter_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def token_sets(part: pa.RecordBatch, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of a batch: all tokens, their row numbers, the sets' sizes and classes."""
    words, bounds = flat_words(part, lower=True)
    tokens, row = token_rows(words, bounds, gram)
    cut = np.searchsorted(row, np.arange(len(part) + 1))
    n, sums = np.diff(cut), np.zeros(len(part), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        sums[full] = np.add.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), cut[full])
    return tokens, row, n, mix(sums + n.astype(np.uint64))


def _cuts(n: np.ndarray) -> list[tuple[int, int]]:
    ends = np.cumsum(n)
    return list(zip((ends - n).tolist(), ends.tolist()))


def _sets(gram: int):
    """One row per text with the digest of its set, then the task's counters of tokens."""
    names = ["doc", "tie", "n", "cls", "bits", "chunk", "part", "counts"]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held = np.zeros(1 << COUNTER_BITS, dtype=np.int64), [], 0
        empty = lambda n, kind: pa.nulls(n, kind)
        for batch in batches:
            for part in slices(batch):
                tokens, _, n, cls = token_sets(part, gram)
                waiting.append(counter_of(tokens))
                held += len(tokens)
                if held > 1 << 21:
                    counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
                    waiting, held = [], 0
                size = len(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("tie"), pa.array(n), signed(cls),
                     pa.array([parity_bits(tokens[a:b]) for a, b in _cuts(n)], pa.binary()),
                     empty(size, pa.int32()), empty(size, pa.int32()), empty(size, pa.binary())],
                    names=names,
                )
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
        task, squeeze = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays(
            [*(empty(CHUNKS, k) for k in (*[pa.int64()] * 4, pa.binary())),
             pa.array(range(CHUNKS), pa.int32()), pa.array([task] * CHUNKS, pa.int32()),
             pa.array([squeeze.compress(c.tobytes()) for c in np.split(counts, CHUNKS)], pa.binary())],
            names=names,
        )

    return body


def _whole_sets(gram: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens, _, n, _ = token_sets(part, gram)
                yield pa.RecordBatch.from_arrays(
                    [part.column("cls"), pa.array([tokens[a:b].tobytes() for a, b in _cuts(n)], pa.binary())],
                    names=["cls", "tokens"],
                )

    return body


def _added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of the counters of one chunk."""
    open_ = zstandard.ZstdDecompressor()
    total = np.zeros((1 << COUNTER_BITS) // CHUNKS, dtype=np.int64)
    for c in rows["counts"]:
        total += np.frombuffer(open_.decompress(c), np.int64)
    return pd.DataFrame({"chunk": [key[0]], "counts": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})


def _levels(usual: float):
    """How far each counter of a chunk lies above ``usual``, in powers of two, as bytes."""

    def body(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packed = _added(key, rows)["counts"].iloc[0]
        counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int64)
        beyond = (counts - usual) / max(usual**0.5, 1.0) / 4
        level = np.where(beyond < 1, 0, 1 + np.log2(np.maximum(beyond, 1))).astype(np.uint8)
        return pd.DataFrame({"chunk": [key[0]], "levels": [level.tobytes()]})

    return body


def token_levels(sketch: DataFrame, tokens: int) -> np.ndarray:
    """Per counter how far it stands out from chance: a table of fixed size, 4 MB."""
    halves = sketch.groupBy("chunk", F.col("part") % 64).applyInPandas(_added, "chunk int, counts binary")
    whole = halves.groupBy("chunk").applyInPandas(_levels(tokens / (1 << COUNTER_BITS)), "chunk int, levels binary")
    parts = {r["chunk"]: bytes(r["levels"]) for r in whole.collect()}
    none = bytes((1 << COUNTER_BITS) // CHUNKS)
    return np.frombuffer(b"".join(parts.get(i, none) for i in range(CHUNKS)), np.uint8)


def text_tie() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def prefix_size(n, share: int):
    return n - -(-share * n // 100) + 1


def _prefixes(levels: np.ndarray, gram: int, share: int):
    """Per text its class, its group (size and prefix), the prefix's tokens in global order, and
    the parities of its tokens in 512 cells."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens, row, n, cls = token_sets(part, gram)
                order = np.lexsort((tokens, levels[counter_of(tokens)], row))
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
                full = n > 0
                size = prefix_size(n, share)
                cell = row * CELLS + (tokens & np.uint64(CELLS - 1)).astype(np.int64)
                odd = (np.bincount(cell, minlength=len(part) * CELLS) & 1).astype(np.uint8)
                signs = np.packbits(odd, bitorder="little").view("<i8").reshape(len(part), -1)[full]
                tokens = tokens[order][place < size[row]]
                n, cls, size = n[full], cls[full], size[full]
                if not len(n):
                    continue
                first = np.cumsum(size) - size
                group = mix(np.add.reduceat(mix(tokens), first) + n.astype(np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(tokens)].astype(np.int32)), signed(tokens))
                yield pa.RecordBatch.from_arrays(
                    [signed(cls), pa.array(n), signed(group), lists, *[pa.array(c) for c in signs.T.copy()]],
                    names=["cls", "n", "grp", "prefix", *SIGNS],
                )

    return body


def _may_link(share: int):
    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # 100 * both >= share * union, with union = (n + m + difference) / 2
            most = [(100 - share) * (n + m) // (100 + share) for n, m in zip(batch["xn"], batch["yn"])]
            keep = [least_difference(a, b) <= d for a, b, d in zip(batch["xb"], batch["yb"], most)]
            yield batch.loc[keep, ["x", "y"]]

    return body


def _links(share: int):
    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["xt"], batch["yt"]):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= share * (len(x) + len(y) - both))
            yield batch.loc[keep, ["x", "y"]]

    return body


def sizes_fit(n: Column, m: Column, share: int) -> Column:
    return 100 * F.least(n, m) >= share * F.greatest(n, m)


class Sets:
    """What is known of the classes: their bitmaps, and one text of each."""

    def __init__(self, keyed: DataFrame, rows: DataFrame, gram: int, share: int):
        self.keyed, self.gram, self.share = keyed, gram, share
        self.rows = rows.where("n > 0")
        self.bits = settle(self.rows.select("cls", "n", "bits").dropDuplicates(["cls"]), "signatures")

    def whole(self, needed: DataFrame) -> DataFrame:
        """``cls, tokens``: the whole sets of the listed classes."""
        place = F.struct(F.coalesce("doc", F.lit(LAST)).alias("doc"), "tie")
        texts = settle(
            self.rows.join(needed, "cls", "left_semi").groupBy("cls").agg(F.min(place).alias("p")).select("cls", "p.*"),
            "texts",
        )
        small = texts.count() <= max_broadcast_rows(texts.sparkSession)
        found = self.keyed.withColumn("doc", F.coalesce("doc", F.lit(LAST))).join(
            F.broadcast(texts) if small else texts, ["doc", "tie"]
        )
        made = found.select("cls", "text").mapInArrow(_whole_sets(self.gram), "cls long, tokens binary")
        return settle(made, "whole")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) of classes that link."""
        one = lambda c: self.bits.select(F.col("cls").alias(c), F.col("n").alias(f"{c}n"), F.col("bits").alias(f"{c}b"))
        bounded = (
            pairs.join(one("x"), "x").join(one("y"), "y")
            .where(sizes_fit(F.col("xn"), F.col("yn"), self.share))
            .mapInPandas(_may_link(self.share), "x long, y long")
        )
        near = settle(bounded.distinct(), "near")
        whole = self.whole(near.select(F.col("x").alias("cls")).union(near.select("y")).distinct()).dropDuplicates(["cls"])
        side = lambda c: whole.select(F.col("cls").alias(c), F.col("tokens").alias(f"{c}t"))
        both = near.join(side("x"), "x").join(side("y"), "y")
        return settle(both.mapInPandas(_links(self.share), "x long, y long"), "verified")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after further links: only the components that the links touch are joined anew."""
    if links.isEmpty():
        return roots
    up = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}r"))
    between = links.join(up("x"), "x", "left").join(up("y"), "y", "left").select(
        F.coalesce("xr", "x").alias("x"), F.coalesce("yr", "y").alias("y")
    )
    moved = components(between).select(F.col("node").alias("was"), F.col("root").alias("now"))
    known = roots.unionByName(
        moved.select(F.col("was").alias("node"), F.col("was").alias("root")).join(roots, "node", "left_anti")
    )
    return settle(
        known.join(moved, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root")),
        "roots",
    )


def linked_rows(docs: DataFrame, gram: int, share: int) -> DataFrame:
    """``doc, tie, n, root``: per document its set's size and the class that names its component."""
    keyed = in_small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc"), text_tie().alias("tie"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = settle(keyed.mapInArrow(_sets(gram), SET_ROWS), "sets")
    sketch, rows = rows.where(F.col("chunk").isNotNull()), rows.where(F.col("chunk").isNull())
    levels = token_levels(sketch.select("chunk", "part", "counts"), rows.agg(F.sum("n")).first()[0] or 0)
    sets = Sets(keyed, rows, gram, share)
    prefixed = settle(
        keyed.mapInArrow(_prefixes(levels, gram, share), PREFIX_ROWS), "prefixes"
    )
    members = settle(prefixed.select("cls", "grp", "n").distinct(), "members")
    firsts = members.groupBy("grp").agg(F.min("cls").alias("first"), F.max("cls").alias("last"))
    # Copies of a text repeat its tokens here; they fall together once the lone tokens are gone.
    again = prefixed.select(F.explode("prefix").alias("token")).groupBy("token").count().where("count > 1").select("token")
    postings = settle(
        prefixed.select("grp", F.posexplode("prefix").alias("pos", "token")).join(again, "token")
        .groupBy("token", "grp").agg(F.min("pos").alias("pos")),
        "postings",
    )
    shared = postings.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi")
    sizes = members.groupBy("grp").agg(F.min("n").alias("n"))
    post = settle(postings.join(shared, "token").join(sizes, "grp"), "shared")

    # Every class with the first of its own group, and with the first of one other group per token.
    within = members.join(firsts, "grp").where("cls <> first").select(F.col("cls").alias("x"), F.col("first").alias("y"))

    def stars(table: DataFrame, hub: str) -> DataFrame:
        pairs = table.where(F.col("grp") != F.col(hub)).select("grp", F.col(hub).alias("hub")).distinct()
        hubs = firsts.select(F.col("grp").alias("hub"), F.col("first").alias("y"))
        return pairs.join(hubs, "hub").join(members, "grp").select(F.col("cls").alias("x"), "y")

    roots = components(sets.verified(within.unionByName(stars(post, "lo")).distinct()))

    def open_postings(roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Members with their component, and the postings of tokens that meet two components."""
        placed = settle(
            members.join(roots, members["cls"] == roots["node"], "left")
            .select("cls", "grp", "n", F.coalesce("root", "cls").alias("root")),
            "placed",
        )
        groups = settle(placed.groupBy("grp").agg(F.min("root").alias("r_lo"), F.max("root").alias("r_hi")), "groups")
        held = post.join(groups, "grp")
        mixed = (
            held.groupBy("token").agg(F.min("r_lo").alias("a"), F.max("r_hi").alias("b")).where("a <> b").select("token")
        )
        return placed, groups, settle(held.join(mixed, "token", "left_semi"), "open")

    # Other hubs, so that few components are left to compare pair by pair.
    placed, groups, still = open_postings(roots)
    for salt in range(HUB_ROUNDS):
        if still.isEmpty():
            break
        hubs = still.groupBy("token").agg(F.min_by("grp", F.xxhash64("grp", F.lit(salt))).alias("hub"))
        roots = merged(roots, sets.verified(stars(still.join(hubs, "token"), "hub").distinct()))
        placed, groups, still = open_postings(roots)

    # What remains: all group pairs of a token that hold two components and can still reach the share.
    # Parities bound the difference of two sets; a group of several classes has none to compare.
    alone = (
        prefixed.groupBy("grp").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), *[F.first(c).alias(c) for c in SIGNS])
        .where("a = b").drop("a", "b")
    )
    still = settle(still.join(alone, "grp", "left"), "signed")
    other = still.select(
        *[F.col(c).alias(f"h{c}") for c in SIGNS], "token", F.col("grp").alias("h"), F.col("n").alias("hn"), F.col("pos").alias("hpos"),
        F.col("r_lo").alias("h_lo"), F.col("r_hi").alias("h_hi"),
    )
    least = F.ceil(share * (F.col("n") + F.col("hn")) / (100 + share))
    reach = (F.col("n") - F.col("pos") >= least) & (F.col("hn") - F.col("hpos") >= least)
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"h{c}"))) for c in SIGNS[1:]), F.bit_count(F.col("s0").bitwiseXOR(F.col("hs0"))))
    close = F.coalesce(differ <= F.floor((100 - share) * (F.col("n") + F.col("hn")) / (100 + share)), F.lit(True))
    apart = (F.least("r_lo", "h_lo") != F.greatest("r_hi", "h_hi"))
    group_pairs = (
        still.join(other, "token")
        .where((F.col("grp") < F.col("h")) & sizes_fit(F.col("n"), F.col("hn"), share) & reach & apart & close)
        .select("grp", "h")
        .distinct()
    )
    alike = groups.where("r_lo <> r_hi").select("grp", F.col("grp").alias("h"))
    left = placed.select("grp", F.col("cls").alias("x"), F.col("root").alias("xr"))
    right = placed.select(F.col("grp").alias("h"), F.col("cls").alias("y"), F.col("root").alias("yr"))
    rest = settle(
        group_pairs.unionByName(alike).join(left, "grp").join(right, "h")
        .where("xr <> yr").select("x", "y").distinct(),
        "rest",
    )
    if not rest.isEmpty():
        roots = merged(roots, sets.verified(rest))
    return rows.select("doc", "tie", "n", "cls").join(roots, F.col("cls") == F.col("node"), "left").select(
        "doc", "tie", "n", F.when(F.col("n") > 0, F.coalesce("root", "cls")).alias("root")
    )


def linked_components(docs: DataFrame, gram: int = GRAM, share: int = SHARE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document.

    Two documents link when ``100 * intersection >= share * union`` of their sets of distinct
    shingles of ``gram`` words (A-Z in lower case); a shorter text is one shingle, a text
    without words has an empty set and links with nothing.  ``component_id`` is the smallest
    doc_id reachable; a null doc_id never is one, unless nothing else is reachable.  Repeated
    rows link with each other; an empty table gives an empty result; other columns are
    ignored.  Sets and classes are told apart by 64-bit hashes.
    """
    placed = settle(linked_rows(docs, gram, share), "linked")
    least_ids = placed.where("root is not null").groupBy("root").agg(F.min("doc").alias("least"))
    return placed.join(least_ids, "root", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id")
    )


def representatives(docs: DataFrame, gram: int = GRAM, share: int = SHARE) -> DataFrame:
    """One document of each component, with its own columns: the smallest doc_id.

    Ties in doc_id go to the least text hash, and one of several repeated rows stays.
    Documents without words all stay.
    """
    place = F.struct(F.coalesce("doc", F.lit(LAST)).alias("_doc"), F.col("tie").alias("_tie"))
    kept = settle(
        linked_rows(docs, gram, share).where("n > 0").groupBy("root").agg(F.min(place).alias("p")).select("p.*"),
        "representatives",
    )
    has_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(has_word).select(
        row_of(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"), text_tie().alias("_tie")
    )
    one = keyed.join(kept, ["_doc", "_tie"]).dropDuplicates(["_doc", "_tie"]).select("_row.*")
    return one.unionByName(docs.where(~has_word))
