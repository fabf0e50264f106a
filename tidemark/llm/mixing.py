"""Mixing sources to target weights by weighted sampling without replacement.

Each document draws an exponential key, scaled by its quality weight (Efraimidis and
Spirakis); within its source the documents stand in key order and their sizes are summed
up to the source's budget of words.  Complete epochs come first, the rest of the budget is
filled in key order.  Draws come from a digest of ``doc_id``, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.ordered import running_total
from tidemark.llm.words import count_of, row_of, word_count
from tidemark.settings import settle

SYMBOLS = r"[#*$%&|<>]"


def quality(text: Column) -> Column:
    """A weight from 0.05 to 1 that falls with the share of symbol characters."""
    chars = F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))
    return F.greatest(1.0 - 5.0 * count_of(text, SYMBOLS) / chars, F.lit(0.05))


def draw(doc_id: Column) -> Column:
    """A number in (0, 1) that depends on ``doc_id`` alone; a null id counts as the text null."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")))
    whole = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    return (whole + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Per source: ``source_size`` and ``target``, the budget in words.

    The sources in code point order, null last, weigh ``weights`` in turn and share the total
    size by weight; a budget stops at ``most`` times its source's size and the excess is
    shared again.  Ordered by size per weight, the stopped sources are a prefix, so one pass
    of running sums finds them.  The windows here run over one row per source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    everything = W.partitionBy(F.lit(0))
    listed = (
        sizes.groupBy("_none", "_name")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_at", F.row_number().over(everything.orderBy("_none", "_name")) - 1)
        .withColumn("_w", F.element_at(cycle, (F.col("_at") % len(weights) + 1).cast("int")))
        .withColumn("_top", F.col("source_size") * float(most))
    )
    ahead = everything.orderBy(F.col("_top") / F.col("_w"), "_at")
    ahead = ahead.rowsBetween(W.unboundedPreceding, -1)
    left = listed.withColumns({
        "_all": F.sum("source_size").over(everything).cast("double"),
        "_open": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(ahead), F.lit(0.0)),
        "_gone": F.coalesce(F.sum("_top").over(ahead), F.lit(0.0)),
    })
    stops = F.col("_top") * F.col("_open") <= (F.col("_all") - F.col("_gone")) * F.col("_w")
    marked = left.withColumn("_stops", stops)
    rest = marked.withColumns({
        "_budget": F.col("_all")
        - F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_top"))).over(everything), F.lit(0.0)),
        "_weight": F.sum(F.when(~F.col("_stops"), F.col("_w"))).over(everything),
    })
    target = F.when(F.col("_stops"), F.col("_top")).otherwise(
        F.col("_budget") * F.col("_w") / F.col("_weight")
    )
    return rest.select("_none", "_name", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0,
    weight: Column | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``size`` counts words, ``copies`` is how often the document enters the mix and ``taken``
    the words it adds.  The document at the end of a budget is taken when that brings the
    source nearer to it, so a source misses its target by at most half a document.
    Documents without words take nothing; a null text has size 0; a null id or source is an
    id or source of its own; repeated rows count as separate documents.  An empty table gives
    an empty result.
    """
    weight = quality(F.col("text")) if weight is None else weight
    key = -F.log(draw(F.col("doc_id"))) / F.greatest(weight, F.lit(1e-6))
    sized = settle(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key"),
            F.col("source").isNull().alias("_none"),
            F.coalesce("source", F.lit("")).alias("_name"),
        ),
        "sizes",
    )
    targets = source_targets(sized, weights, most)
    placed = running_total(
        sized.withColumn("_id", F.coalesce("doc_id", F.lit(-1))),
        ["_none", "_name"], ["_key", "_id", "size"], "size", "_upto",
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    epochs = F.coalesce(epochs, F.lit(0))
    budget = F.col("target") - epochs * F.col("source_size")
    extra = (2 * (budget - (F.col("_upto") - F.col("size"))) >= F.col("size")) & (budget > 0)
    copies = F.when(F.col("size") > 0, epochs + extra.cast("long")).otherwise(0)
    copies = F.least(copies, F.lit(int(most))).cast("long")
    return placed.join(targets, ["_none", "_name"]).select(
        "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"),
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it was taken, with their own columns.

    Rows that share id, source and size also share the number of copies: the larger one.
    """
    keys = ["doc_id", "source", "size"]
    chosen = mix(docs, **options).groupBy(*keys).agg(F.max("copies").alias("_copies"))
    sized = docs.select(row_of(docs), "doc_id", "source", word_count(F.col("text")).alias("_size"))
    chosen = chosen.where(F.col("_copies") > 0).select(
        F.col("doc_id").alias("_doc"), F.col("source").alias("_src"), F.col("size").alias("_sz"),
        "_copies",
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_src"))
        & (F.col("_size") == F.col("_sz"))
    )
    return (
        sized.join(chosen, same)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select("_row.*")
    )
