"""Point-in-time news features: exclusion, de-syndication, decay and weighted scores."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import fixed, guards, spread
from tidemark.functions.exprs import blank, all_failures, config_version, flag_list
from tidemark.functions.headline import canonical_headline
from tidemark.settings import settle

DAY = 86_400
FEATURES = (
    "news_volume_decayed", "independent_source_count", "recency_weight_max",
    "direction_weighted", "ambiguity_weighted", "novelty_new_share",
    "relevance_direct_share", "surprise_weighted",
)
LABEL_FIELDS = tuple(fixed.LABEL_VOCABULARIES)


@dataclass(frozen=True)
class NewsConfig:
    half_life_hours: float = 24.0
    cluster_window_hours: float = 48.0
    lookback_hours: float = 168.0
    category_weights: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if min(self.half_life_hours, self.cluster_window_hours, self.lookback_hours) <= 0:
            raise ValueError("hours must be positive")
        if self.lookback_hours < self.cluster_window_hours:
            raise ValueError("lookback_hours is shorter than cluster_window_hours")
        unknown = sorted(set(self.category_weights) - set(fixed.CATEGORIES))
        if unknown:
            raise ValueError(f"unknown categories: {', '.join(unknown)}")
        weights = {c: float(self.category_weights.get(c, 1.0)) for c in fixed.CATEGORIES}
        if min(weights.values()) < 0:
            raise ValueError("category weights must not be negative")
        object.__setattr__(self, "category_weights", MappingProxyType(weights))

    @property
    def version(self) -> str:
        return config_version(
            "news",
            {
                "half_life_hours": repr(float(self.half_life_hours)),
                "cluster_window_hours": repr(float(self.cluster_window_hours)),
                "lookback_hours": repr(float(self.lookback_hours)),
                "category_weights": {k: repr(v) for k, v in sorted(self.category_weights.items())},
            },
        )


def scored_by(table: Mapping[str, float], col: Column) -> Column:
    """Look a label up in a fixed score table; NULL when the table does not score it."""
    out = F.lit(None).cast("double")
    for name, value in table.items():
        out = F.when(col == name, F.lit(value)).otherwise(out)
    return out


def article_problems() -> list[tuple[Column, str]]:
    """An empty summary is ordinary; an untagged or wordless article is not usable."""
    tagged = F.coalesce((F.size("symbols") > 0) & ~F.exists("symbols", blank), F.lit(False))
    return [
        (~tagged, "symbols"),
        (blank(F.col("headline")), "headline_blank"),
        (F.coalesce(canonical_headline(F.col("headline")) == "", F.lit(True)), "headline_wordless"),
    ]


def article_rejects(articles: DataFrame) -> DataFrame:
    return articles.withColumn("reasons", all_failures(article_problems())).where(F.size("reasons") > 0)


def usable_articles(articles: DataFrame) -> DataFrame:
    """Articles without a reject reason, with the digest of their canonical headline."""
    judged = articles.withColumn("reasons", all_failures(article_problems()))
    return (
        judged.where(F.size("reasons") == 0)
        .drop("reasons")
        .withColumn("headline_hash", F.sha2(canonical_headline(F.col("headline")), 256))
    )


def label_rejects(labels: DataFrame) -> DataFrame:
    """Labels with a value outside its vocabulary, every offending field named."""
    checks = [
        (~F.coalesce(F.col(name).isin(*allowed), F.lit(False)), name)
        for name, allowed in fixed.LABEL_VOCABULARIES.items()
    ]
    return labels.withColumn("reasons", all_failures(checks)).where(F.size("reasons") > 0)


def labels_of_usable(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels without those of rejected articles, which go with them; of unknown articles they stay."""
    return labels.join(article_rejects(articles).select("article_id").distinct(), "article_id", "left_anti")


def label_conflicts(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels about an unknown article, an untagged ticker, or another observation of it."""
    known = articles.select(
        "article_id", "symbols", F.col("first_seen_time").alias("_seen"), F.col("source_time").alias("_source")
    )
    c = F.col
    checks = [
        (c("symbols").isNull(), "unknown_article"),
        (~F.array_contains("symbols", c("ticker")), "ticker_not_tagged"),
        (c("first_seen_time") != c("_seen"), "first_seen_time"),
        (c("source_time") != c("_source"), "source_time"),
    ]
    joined = labels.select("article_id", "ticker", "first_seen_time", "source_time").join(
        known, "article_id", "left"
    )
    return joined.select("article_id", "ticker", all_failures(checks).alias("reasons")).where(
        F.size("reasons") > 0
    )


def checked_panel(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per (article, symbol) with that symbol's label fields, NULL when unlabelled.

    Contradictions stop the job before anything is computed from the panel.
    """
    articles = guards.collapse_duplicates(articles, ["article_id"])
    guards.refuse_repeats(labels, ["article_id", "ticker"], guards.AmbiguityError, "label repeated")
    guards.refuse(
        label_rejects(labels), F.lit(True), guards.IntegrityError, "label outside its vocabulary",
        ["article_id", "ticker"],
    )
    guards.refuse(
        label_conflicts(articles, labels), F.lit(True), guards.IntegrityError,
        "label and article disagree", ["article_id", "ticker"],
    )
    tagged = articles.select(
        "article_id", F.explode(F.array_distinct("symbols")).alias("symbol"), "headline_hash", "first_seen_time"
    )
    told = labels.select("article_id", F.col("ticker").alias("symbol"), *LABEL_FIELDS)
    return tagged.join(told, ["article_id", "symbol"], "left")


def in_lookback(spine: DataFrame, panel: DataFrame, config: NewsConfig) -> DataFrame:
    """Articles visible at each spine row and no older than the lookback, with ``reason``.

    An equality join on (symbol, day) carries the time range; only the residual bounds are
    compared per pair.  ``reason`` is NULL for an article that contributes.
    """
    back = int(config.lookback_hours * 3600)
    day = lambda ts: F.floor(F.unix_timestamp(ts) / DAY)
    asked = spine.select(
        "symbol", "as_of",
        F.explode(
            F.sequence(F.floor((F.unix_timestamp("as_of") - back) / DAY) - 1, day("as_of"))
        ).alias("_day"),
    )
    pairs = asked.join(panel.withColumn("_day", day("first_seen_time")), ["symbol", "_day"]).drop("_day")
    age = (F.unix_micros("as_of") - F.unix_micros("first_seen_time")) / 1e6
    pairs = pairs.withColumn("age_seconds", age).where(
        (F.col("age_seconds") >= 0) & (F.col("age_seconds") <= config.lookback_hours * 3600.0)
    )
    return pairs.withColumn("reason", _label_reason())


def _label_reason() -> Column:
    match = F.col("entity_match")
    return (
        F.when(match.isNull(), "unlabelled")
        .when(match == "not_matched", "entity_not_matched")
        .when(match == "uncertain", "entity_uncertain")
    )


def exclusion_intervals(panel: DataFrame, config: NewsConfig) -> DataFrame:
    """Per article the instants at which it does not contribute: ``symbol, article_id, reason, since, until``.

    At most two rows per article, whatever the spine: its label's reason while it is within
    the lookback, and ``outside_lookback`` ever after.  Both ends are included; an open end is
    NULL.
    """
    back = int(config.lookback_hours * 3_600_000_000)
    seen = F.unix_micros("first_seen_time")
    part = lambda reason, since, until: F.struct(
        reason.alias("reason"), F.timestamp_micros(since).alias("since"), F.timestamp_micros(until).alias("until")
    )
    both = F.array(
        part(_label_reason(), seen, seen + back),
        part(F.lit("outside_lookback"), seen + back + 1, F.lit(None).cast("bigint")),
    )
    rows = panel.select("symbol", "article_id", F.explode(both).alias("_p"))
    return rows.select("symbol", "article_id", "_p.*").where("reason is not null and since is not null")


def exclusions(spine: DataFrame, panel: DataFrame, config: NewsConfig) -> DataFrame:
    """Every visible article that does not contribute at each spine row, with its one reason.

    The intervals expanded over the spine: as large as the visible history of each row.
    """
    held = exclusion_intervals(panel, config)
    inside = (F.col("since") <= F.col("as_of")) & (F.col("until").isNull() | (F.col("as_of") <= F.col("until")))
    return spine.select("symbol", "as_of").join(held, "symbol").where(inside).select(
        "symbol", "as_of", "article_id", "reason"
    )


def contributing(panel: DataFrame) -> DataFrame:
    """The articles of a panel whose labels let them contribute at any instant."""
    return panel.withColumn("reason", _label_reason()).where("reason is null")


def _anchor_chains(stories: DataFrame, config: NewsConfig) -> tuple[DataFrame, DataFrame]:
    """Per (symbol, headline, instant) the first story, and the anchors that would follow it.

    The anchor after a story is the first one of its headline beyond the window, whatever the
    instant asked about: one ordered lookup finds it.  Chains of such pointers double until they
    hold as many anchors as fit into the lookback.
    """
    group, at = ["symbol", "headline_hash"], F.col("first_seen_time")
    story = F.struct("first_seen_time", "article_id", *LABEL_FIELDS)
    firsts = settle(stories.groupBy(*group, "first_seen_time").agg(F.min(story).alias("story")), "stories")
    [heavy] = spread.is_heavy(firsts, group)
    none, back = F.lit(None).cast("timestamp"), -F.unix_micros(at)
    window = int(config.cluster_window_hours * 3_600_000_000)
    point = firsts.select(*group, back.alias("_key"), F.lit(1).alias("_kind"), at.alias("next"), none.alias("first_seen_time"))
    asked = firsts.select(*group, (back - window).alias("_key"), F.lit(0).alias("_kind"), none.alias("next"), "first_seen_time")
    found = spread.last_known(point.unionByName(asked), group, ["_key", "_kind"], heavy, "next")
    chains = found.where("_kind = 0").select(*group, "first_seen_time", F.array_compact(F.array("next")).alias("chain"))
    chains, length = settle(chains, "chains"), 1
    while length < int(config.lookback_hours // config.cluster_window_hours):
        more = chains.select(*group, at.alias("_last"), F.col("chain").alias("_more"))
        longer = chains.withColumn("_last", F.try_element_at("chain", F.lit(-1))).join(more, [*group, "_last"], "left")
        tail = F.coalesce("_more", F.array().cast("array<timestamp>"))
        chains = settle(longer.select(*group, "first_seen_time", F.concat("chain", tail).alias("chain")), "chains")
        length *= 2
    return firsts, chains


def representatives(kept: DataFrame, stories: DataFrame, config: NewsConfig) -> DataFrame:
    """One article per wire story: the anchor of each cluster of equal headlines.

    Within (symbol, as_of, headline) a new cluster starts with the first article further than the
    window from the current anchor.  ``kept`` are the articles that contribute at each instant,
    ``stories`` those that contribute at any.  An instant needs the first article in its lookback;
    the anchors behind it were found once per headline.  A headline copied any number of times
    never sits in one task.
    """
    group = ["symbol", "headline_hash"]
    firsts, chains = _anchor_chains(stories, config)
    starts = kept.groupBy("symbol", "as_of", "headline_hash").agg(
        F.min("first_seen_time").alias("first_seen_time"), F.count("*").alias("n")
    )
    seen = F.filter("chain", lambda t: t <= F.col("as_of"))
    anchors = starts.join(chains, [*group, "first_seen_time"]).select(
        *group, "as_of", "n", F.posexplode(F.concat(F.array("first_seen_time"), seen)).alias("_place", "first_seen_time")
    )
    age = (F.unix_micros("as_of") - F.unix_micros("story.first_seen_time")) / 1e6
    return anchors.join(firsts, [*group, "first_seen_time"]).select(
        *group, "as_of", F.when(F.col("_place") == 0, F.col("n")).otherwise(0).alias("members"),
        "story.*", age.alias("age_seconds"),
    )


def feature_block(
    spine: DataFrame, articles: DataFrame, labels: DataFrame, config: NewsConfig = NewsConfig()
) -> DataFrame:
    """One row per spine row (symbol, as_of): eight features, flags and the version."""
    spine = spine.select("symbol", "as_of").distinct()
    panel = checked_panel(articles, labels)
    pairs = settle(in_lookback(spine, panel, config), "pairs")
    excluded = pairs.groupBy("symbol", "as_of").agg(
        *[
            F.max((F.col("reason") == r).cast("int")).alias(f"_{r}")
            for r in ("unlabelled", "entity_not_matched", "entity_uncertain")
        ]
    )
    chosen = representatives(pairs.where("reason is null"), contributing(panel), config)
    decay = F.pow(F.lit(0.5), F.col("age_seconds") / 3600.0 / config.half_life_hours)
    scored = chosen.withColumns(
        {"decay": decay, "w": decay * scored_by(config.category_weights, F.col("category"))}
    )
    w, c = F.col("w"), F.col
    known = scored_by(fixed.SURPRISE_SCORE, c("surprise"))
    share = lambda test: F.sum(F.when(test, w).otherwise(0.0))
    sums = scored.groupBy("symbol", "as_of").agg(
        F.sum(w).alias("total"),
        F.count("*").cast("double").alias("independent_source_count"),
        F.max("decay").alias("recency_weight_max"),
        F.sum(w * scored_by(fixed.DIRECTION_SCORE, c("direction"))).alias("_direction"),
        F.sum(w * scored_by(fixed.AMBIGUITY_SCORE, c("ambiguity"))).alias("_ambiguity"),
        share(c("novelty") == "new").alias("_novelty"),
        share(c("relevance") == "direct").alias("_relevance"),
        F.sum(w * known).alias("_surprise"),
        F.sum(F.when(known.isNotNull(), w)).alias("_known"),
        F.max(known.isNull().cast("int")).alias("_unknown"),
        (F.sum("members") > F.count("*")).alias("_collapsed"),
    )
    first = panel.groupBy("symbol").agg(F.min("first_seen_time").alias("_first"))
    found = (
        spine.join(first, "symbol", "left")
        .join(excluded, ["symbol", "as_of"], "left")
        .join(sums, ["symbol", "as_of"], "left")
    )
    none = c("_first").isNull() | (c("_first") > c("as_of"))
    weighed = c("total") > 0
    over = lambda part, whole: F.when(weighed & (whole > 0), part / whole)
    flags = flag_list(
        F.when(none, F.lit("no_articles")),
        F.when(c("_unlabelled") == 1, F.lit("unlabelled_article")),
        F.when(c("_entity_not_matched") == 1, F.lit("entity_not_matched")),
        F.when(c("_entity_uncertain") == 1, F.lit("entity_uncertain")),
        F.when(~none & c("total").isNull(), F.lit("no_qualifying_articles")),
        F.when(c("_collapsed"), F.lit("syndication_collapsed")),
        F.when(c("total") <= 0, F.lit("zero_denominator")),
        F.when(weighed & (c("_unknown") == 1), F.lit("surprise_unknown")),
    )
    return found.select(
        "symbol", "as_of",
        c("total").alias("news_volume_decayed"), "independent_source_count", "recency_weight_max",
        over(c("_direction"), c("total")).alias("direction_weighted"),
        over(c("_ambiguity"), c("total")).alias("ambiguity_weighted"),
        over(c("_novelty"), c("total")).alias("novelty_new_share"),
        over(c("_relevance"), c("total")).alias("relevance_direct_share"),
        over(c("_surprise"), c("_known")).alias("surprise_weighted"),
        flags.alias("quality_flags"), F.lit(config.version).alias("feature_version"),
    )
