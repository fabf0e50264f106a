"""Preparing and checking article labels: context, request keys, cache, reply validation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import fixed, guards, spread
from tidemark.functions.exprs import first_failure, iso_utc
from tidemark.functions.fields import JsonFields

PRIOR_CONTEXT = 5


def prior_context(articles: DataFrame, limit: int = PRIOR_CONTEXT) -> DataFrame:
    """For each (ticker, article) the last ``limit`` articles first seen strictly earlier.

    Articles sharing an instant never see each other.  Each instant keeps only its last
    ``limit`` articles, and the frame runs over distinct instants, so it is exact however
    many articles share one.
    """
    tagged = articles.select(
        F.explode(F.array_distinct("symbols")).alias("ticker"), "article_id", "first_seen_time",
        "source_time", "source_domain", "headline",
    )
    if limit == 0:
        return tagged.withColumn("context", F.array().cast("array<bigint>"))
    newest = W.partitionBy("ticker", "first_seen_time").orderBy(F.col("article_id").desc())
    ends = tagged.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit)
    entry = F.struct("article_id", "source_time", "source_domain", "headline")
    instants = ends.groupBy("ticker", "first_seen_time").agg(
        F.array_sort(F.collect_list(entry)).alias("_here")
    )
    [heavy] = spread.is_heavy(tagged, ["ticker"])
    placed = spread.numbered(instants, ["ticker"], ["first_seen_time"], heavy)
    laid, part = spread.in_blocks(placed, ["ticker"], heavy, before=limit)
    frame = W.partitionBy(*part).orderBy("pos").rowsBetween(-limit, -1)
    before = F.flatten(F.collect_list("_here").over(frame))
    known = laid.withColumn("_before", before).where("_core").select(
        "ticker", "first_seen_time",
        F.slice("_before", F.greatest(F.size("_before") - limit + 1, F.lit(1)), limit).alias("context"),
    )
    return tagged.join(known, ["ticker", "first_seen_time"])


def label_requests(
    articles: DataFrame, names: DataFrame, model_version: str, prompt_version: str,
    limit: int = PRIOR_CONTEXT,
) -> DataFrame:
    """One request per (ticker, article): what is asked, and a key over all of it.

    ``names``: ticker, company_name.  A ticker without a name raises.
    """
    asked = prior_context(articles, limit).join(
        articles.select("article_id", "summary"), "article_id"
    ).join(names, "ticker", "left")
    guards.refuse(
        asked, F.col("company_name").isNull(), guards.IntegrityError,
        "no company name is registered", ["ticker"],
    )
    entries = F.transform(
        "context",
        lambda e: F.struct(
            e.article_id.cast("string").alias("article_id"), e.headline.alias("headline"),
            e.source_domain.alias("source_domain"), iso_utc(e.source_time).alias("source_time"),
        ),
    )
    fields = {
        "article_id": F.col("article_id").cast("string"),
        "ticker": F.col("ticker"),
        "company_name": F.col("company_name"),
        "source_name": F.col("source_domain"),
        "source_domain": F.col("source_domain"),
        "source_time": iso_utc(F.col("source_time")),
        "first_seen_time": iso_utc(F.col("first_seen_time")),
        "headline": F.col("headline"),
        "summary": F.col("summary"),
        "prior_story_context": entries,
    }
    text = lambda f: F.to_json(
        F.struct(*[f[k].alias(k) for k in sorted(f)]), {"ignoreNullFields": "false"}
    )
    keyed = fields | {"model_version": F.lit(model_version), "prompt_version": F.lit(prompt_version)}
    return asked.select(
        "ticker", "article_id", F.size("context").alias("context_size"),
        text(fields).alias("payload"), F.sha2(text(keyed), 256).alias("cache_key"),
    )


def split_by_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests the cache answers, and those still to be asked."""
    held = requests.join(cache.dropDuplicates(["cache_key"]), "cache_key")
    return held, requests.join(cache, "cache_key", "left_anti")


def new_cache_rows(cache: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows to append: putting a key that is already there changes nothing."""
    return labels.dropDuplicates(["cache_key"]).join(cache, "cache_key", "left_anti")


REPLY_FIELDS = (
    "article_id", "ticker", "entity_match", "direction", "category", "novelty", "relevance",
    "surprise", "ambiguity", "evidence_spans", "limitations",
)
_TEXT_FIELDS = REPLY_FIELDS[:9]


def judged_replies(requests: DataFrame) -> DataFrame:
    """Check each reply against its request; ``reason`` is NULL for a usable label.

    ``requests``: article_id, ticker, headline, summary and the raw ``reply`` text.  The first
    failing check is the reason.  Values are compared as they came, never coerced or fixed.
    """
    fields = JsonFields(requests, "reply", REPLY_FIELDS)
    lists = lambda n: fields.kind(n).isin("ARRAY<STRING>", "ARRAY<VOID>")
    made = fields.df.withColumns(
        {f"_{n}": F.when(fields.kind(n) == "STRING", fields.text(n)) for n in _TEXT_FIELDS}
        | {
            "_spans_ok": lists("evidence_spans") & lists("limitations"),
            "evidence_spans": F.try_variant_get("_whole", "$.evidence_spans", "array<string>"),
            "limitations": F.try_variant_get("_whole", "$.limitations", "array<string>"),
        }
    )
    c = F.col
    is_object = F.coalesce(F.startswith(c("_kind"), F.lit("OBJECT")), F.lit(False))
    bad_value = ~F.coalesce(c("_spans_ok"), F.lit(False))
    for name, allowed in fixed.LABEL_VOCABULARIES.items():
        bad_value = bad_value | ~F.coalesce(c(f"_{name}").isin(*allowed), F.lit(False))
    missing = reduce(or_, [fields.missing(n) for n in REPLY_FIELDS])
    differs = lambda a, b: ~F.coalesce(a == b, F.lit(False))
    verbatim = F.forall(
        "evidence_spans", lambda s: F.contains(c("headline"), s) | F.contains(c("summary"), s)
    )
    reason = first_failure(
        [
            (~is_object, "not_an_object"),
            (missing, "missing_field"),
            (differs(c("_article_id"), c("article_id").cast("string")), "wrong_article"),
            (differs(c("_ticker"), c("ticker")), "wrong_ticker"),
            (bad_value, "value_not_allowed"),
            (
                (c("_entity_match") == "not_matched")
                & ((c("_relevance") != "incidental") | (c("_ambiguity") != "high")),
                "not_matched_contradicted",
            ),
            (~verbatim, "span_not_verbatim"),
        ]
    )
    return made.select(
        "article_id", "ticker", reason.alias("reason"),
        *[c(f"_{n}").alias(n) for n in fixed.LABEL_VOCABULARIES], "evidence_spans", "limitations",
    )


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("reason is null").drop("reason")


def excluded(judged: DataFrame) -> DataFrame:
    """Every article that is not accepted, so each is in exactly one of the two outputs."""
    return judged.where("reason is not null").select("article_id", "ticker", "reason")
