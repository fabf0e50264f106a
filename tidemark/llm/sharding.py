"""Shards chosen by a hierarchical weighted hash tree.

A tree has regions, racks and shards; a node weighs what its shards weigh.  A row descends from
the root: at every node the children draw exponential numbers from a digest of the row's key and
their own names, each divided by the child's weight, and the smallest draw wins.  A draw depends
on nothing but key, name and weight, so a change of weights moves rows only into or out of the
subtrees whose weights change.  A shard is added under a region of its own: rows that the new
region wins can only go to the new shard, and every other row keeps its place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.spread import numbered
from tidemark.llm.words import row_of
from tidemark.settings import settle

LAW = "key"


@dataclass(frozen=True)
class Leaf:
    """A shard: its place in the tree, its number and its weight (positive)."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0

    @property
    def path(self) -> tuple[str, str, str]:
        region, rack = f"{self.region}", f"{self.region}/{self.rack}"
        return region, rack, f"{rack}/{self.shard}"


@dataclass(frozen=True)
class Tree:
    """The shards of a tree.  The tree is configuration and rides along in the plan."""

    leaves: tuple[Leaf, ...]

    def __post_init__(self):
        numbers = [leaf.shard for leaf in self.leaves]
        if not numbers or len(set(numbers)) < len(numbers) or min(leaf.weight for leaf in self.leaves) <= 0:
            raise ValueError("a tree needs shards with numbers of their own and positive weights")

    def children(self, level: int) -> dict[str, dict[str, float]]:
        """Per node at ``level`` the names and weights of its children; the root is the empty name."""
        found: dict[str, dict[str, float]] = {}
        for leaf in self.leaves:
            path = ("", *leaf.path)
            own = found.setdefault(path[level], {})
            own[path[level + 1]] = own.get(path[level + 1], 0.0) + leaf.weight
        return found

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, alone in a new region."""
        region = 1 + max(leaf.region for leaf in self.leaves)
        shard = 1 + max(leaf.shard for leaf in self.leaves)
        return Tree((*self.leaves, Leaf(region, 0, shard, weight)))

    def reweighted(self, shard: int, weight: float) -> Tree:
        """The tree with another weight for one shard."""
        return Tree(tuple(
            Leaf(x.region, x.rack, x.shard, weight) if x.shard == shard else x for x in self.leaves
        ))


def balanced(regions: int = 4, racks: int = 2, shards: int = 2) -> Tree:
    """A tree of equal weights whose shards are numbered from 0."""
    return Tree(tuple(
        Leaf(r, k, (r * racks + k) * shards + s)
        for r in range(regions) for k in range(racks) for s in range(shards)
    ))


def row_key(doc_id: Column, text: Column) -> Column:
    """What a row draws by: its id, or the digest of its text where it has none."""
    named = doc_id.cast("string")
    return F.coalesce(named, F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))


def _draw(key: Column, name: Column, weight: Column) -> Column:
    digest = F.md5(F.concat(key, F.lit("/"), name))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def _options(tree: Tree, level: int) -> Column:
    """A constant map from a node's name to its children."""
    entries = []
    for name, children in tree.children(level).items():
        listed = [F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in children.items()]
        entries += [F.lit(name), F.array(*listed)]
    return F.create_map(*entries)


def descend(tree: Tree, key: Column) -> Column:
    """The shard a key falls to: one draw among the children of a node per level."""
    node = F.lit("")
    for level in range(3):
        drawn = F.transform(
            F.element_at(_options(tree, level), node),
            lambda child: F.struct(_draw(key, child["name"], child["weight"]).alias("draw"), child["name"].alias("name")),
        )
        node = F.array_min(drawn)["name"]
    return F.element_at(F.split(node, "/"), 3).cast("int")


def assign(docs: DataFrame, tree: Tree) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus one and ``text_crc32`` the CRC of these bytes; a null
    text counts as the empty one.  ``shard`` depends on doc_id and the tree alone, ``grown_shard``
    is the shard with one more.  ``slot`` numbers a shard's rows from 0 in the order of doc_id
    (null last), CRC and size; rows equal in all of these are interchangeable.  Rows without
    doc_id draw by their text, repeated rows share a shard and take a slot each.  Equal texts
    under different ids are not held together: the ids spread a group of copies over the shards.
    An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = row_key(F.col("doc_id"), F.col("text"))
    placed = settle(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), descend(tree, key).alias("shard"),
            descend(tree.grown(), key).alias("grown_shard"),
            # Parts rows that are equal otherwise, so that they spread over ranges.
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shards",
    )
    order = [F.col("doc_id").isNull().alias("_none"), "doc_id", "text_crc32", "size", "_row"]
    slots = numbered(
        placed.select("*", order[0]), ["shard"], ["_none", *order[1:]], heavy=True, name="_pos"
    )
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("_pos") - 1).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, tree: Tree, folder: str) -> None:
    """Write whole rows as ``folder/shard=N``, each row in the column ``document``.

    A shard's rows come from as many tasks as hold them; nothing is moved between tasks.
    """
    key = row_key(F.col("doc_id"), F.col("text"))
    docs.select(row_of(docs).alias("document"), descend(tree, key).alias("shard")).write.partitionBy(
        "shard"
    ).parquet(folder)
