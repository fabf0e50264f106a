"""Connected components of a link table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.settings import settle


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``links`` (x, y): the smallest node it is linked with.

    Each round takes the least root among a node and its neighbours, then the root of that
    root, so the rounds grow with the logarithm of a chain's length.  Nothing is collected
    but the number of nodes that changed.
    """
    both = settle(
        links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        .where("x <> y").distinct(),
        "links",
    )
    if both.isEmpty():
        return both.select(F.col("x").alias("node"), F.col("y").alias("root"))
    roots = settle(
        both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("root")),
        "roots",
    )
    while True:
        seen = both.join(roots, both["y"] == roots["node"]).groupBy("x").agg(F.min("root").alias("near"))
        # A root that hears of a smaller one passes it on to all of its own nodes.
        told = (
            roots.join(seen, roots["node"] == seen["x"])
            .groupBy("root").agg(F.min("near").alias("less"))
            .select(F.col("root").alias("of"), F.least("of", "less").alias("to"))
        )
        moved = roots.join(told, roots["root"] == told["of"], "left").select(
            "node", F.coalesce("to", "root").alias("root"), F.col("root").alias("was")
        )
        step = settle(moved, "moved")
        at = step.select(F.col("node").alias("at"), F.col("root").alias("up"))
        fresh = settle(
            step.join(at, step["root"] == at["at"], "left")
            .select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "was"),
            "roots",
        )
        if not fresh.where("root <> was").limit(1).count():
            return fresh.select("node", "root")
        roots = fresh.select("node", "root")
