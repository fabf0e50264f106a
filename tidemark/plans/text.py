"""Queries on documents: news features, label preparation and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.exprs import DAY_SECONDS, plus_seconds, r6, utc_floor
from tidemark.functions.headline import canonical_headline
from tidemark.operators import evidence, labeling, news, price_features
from tidemark.plans.price import stored_bars
from tidemark.plans.registry import at, joined, r6_sql, registered, stamp
from tidemark.settings import settle
from tidemark.sources import tables

# The canonical words in SQL.  Of the characters in the given texts only the sharp s folds to
# ASCII letters; composed accents never do.
_WORDS = (
    "trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize(headline)), 'ß', 'ss'), "
    "'[^0-9a-z ]+', ' ', 'g'), ' +', ' ', 'g'))"
)

ARTICLES = f"""
texts AS (
  SELECT doc_id, 'Brand#' || (doc_id % 25 + 1) AS symbol, source,
    CASE WHEN instr(text, chr(10)) = 0 THEN text ELSE substr(text, 1, instr(text, chr(10)) - 1) END AS headline,
    CASE WHEN instr(text, chr(10)) = 0 THEN '' ELSE substr(text, instr(text, chr(10)) + 1) END AS summary,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7919 % 43200) AS seen
  FROM documents),
worded AS (SELECT *, {_WORDS} AS words FROM texts),
articles AS (SELECT * FROM worded WHERE trim(headline, ' ') <> '' AND words <> '')"""

_PICK = lambda key, *names: "list_extract([" + ", ".join(f"'{n}'" for n in names) + f"], CAST({key} % {len(names)} + 1 AS INT))"

TOLD = f"""
told AS (
  SELECT d.doc_id, 'Brand#' || (d.doc_id % 25 + 1) AS ticker,
    {_PICK('d.doc_id', 'matched', 'matched', 'matched', 'uncertain', 'matched', 'not_matched', 'matched')} AS entity_match,
    CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
         ELSE {_PICK('d.doc_id', 'mixed', 'neutral')} END AS direction,
    {_PICK('d.doc_id', 'earnings', 'guidance', 'analyst', 'regulatory_legal', 'product', 'financing_ma', 'management', 'macro_industry', 'other')} AS category,
    {_PICK('d.doc_id', 'new', 'follow_up', 'duplicate', 'unknown')} AS novelty,
    {_PICK('d.doc_id // 2', 'direct', 'industry_linked', 'incidental', 'unknown')} AS relevance,
    {_PICK('d.doc_id // 3', 'unexpected', 'partly_expected', 'expected', 'unknown')} AS surprise,
    {_PICK('d.doc_id // 5', 'low', 'medium', 'high')} AS ambiguity
  FROM documents d JOIN labels USING (doc_id))"""

# Spine: for every article its symbol at the following two midnights.
SPINE = """
spine AS (
  SELECT DISTINCT symbol, CAST(CAST(seen AS DATE) AS TIMESTAMP) + to_days(CAST(k AS INT)) AS as_of
  FROM articles, (SELECT unnest([1, 2]) AS k))"""

PAIRS = f"""{ARTICLES}, {TOLD}, {SPINE},
panel AS (SELECT a.*, t.* EXCLUDE (doc_id, ticker) FROM articles a LEFT JOIN told t USING (doc_id)),
visible AS (
  SELECT s.as_of, p.*, epoch(s.as_of) - epoch(p.seen) AS age,
    CASE WHEN epoch(s.as_of) - epoch(p.seen) > 604800 THEN 'outside_lookback'
         WHEN entity_match IS NULL THEN 'unlabelled'
         WHEN entity_match = 'not_matched' THEN 'entity_not_matched'
         WHEN entity_match = 'uncertain' THEN 'entity_uncertain' END AS reason
  FROM spine s JOIN panel p ON p.symbol = s.symbol AND p.seen <= s.as_of)"""

# Clusters by walking each headline's articles in order and keeping the running anchor.
CLUSTERS = f"""{PAIRS},
kept AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, as_of, words ORDER BY seen, doc_id) AS i
  FROM visible WHERE reason IS NULL),
walk AS (
  SELECT symbol, as_of, words, i, doc_id, seen, seen AS anchor, true AS starts FROM kept WHERE i = 1
  UNION ALL
  SELECT k.symbol, k.as_of, k.words, k.i, k.doc_id, k.seen,
    CASE WHEN epoch(k.seen) - epoch(w.anchor) > 172800 THEN k.seen ELSE w.anchor END,
    epoch(k.seen) - epoch(w.anchor) > 172800
  FROM walk w JOIN kept k ON k.symbol = w.symbol AND k.as_of = w.as_of AND k.words = w.words AND k.i = w.i + 1),
reps AS (SELECT k.* FROM kept k JOIN walk w USING (symbol, as_of, words, i) WHERE w.starts)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(news.usable_articles(tables.articles(spark, sf_dir)), "articles")


def article_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without those of rejected articles."""
    told = news.labels_of_usable(tables.articles(spark, sf_dir), tables.article_labels(spark, sf_dir))
    return settle(told, "labels")


def spine_of(found: DataFrame) -> DataFrame:
    """Each article's symbol at the two midnights after it was first seen."""
    day = utc_floor(F.col("first_seen_time"), "day")
    ahead = F.explode(F.array(*[plus_seconds(day, F.lit(n * DAY_SECONDS)) for n in (1, 2)]))
    return found.select(F.explode("symbols").alias("symbol"), ahead.alias("as_of")).distinct()


@registered("canonical_headlines", f"WITH {ARTICLES} SELECT doc_id AS article_id, words FROM worded")
def canonical_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.articles(spark, sf_dir).select(
        "article_id", canonical_headline(F.col("headline")).alias("words")
    )


@registered(
    "article_rejects",
    f"""WITH {ARTICLES} SELECT doc_id AS article_id, array_to_string(list_filter([
      CASE WHEN doc_id % 40 = 7 THEN 'symbols' END, CASE WHEN trim(headline, ' ') = '' THEN 'headline_blank' END,
      CASE WHEN words = '' THEN 'headline_wordless' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM (SELECT * EXCLUDE (headline, words), CASE WHEN doc_id % 50 = 9 THEN '!?' ELSE headline END AS headline,
                 CASE WHEN doc_id % 50 = 9 THEN '' ELSE words END AS words FROM worded)
    WHERE doc_id % 40 = 7 OR trim(headline, ' ') = '' OR words = ''""",
)
def article_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with some untagged and some wordless ones among them."""
    d = F.col("article_id")
    landed = tables.articles(spark, sf_dir).withColumns(
        {
            "symbols": F.when(d % 40 == 7, F.array(F.lit(" "))).otherwise(F.col("symbols")),
            "headline": F.when(d % 50 == 9, F.lit("!?")).otherwise(F.col("headline")),
        }
    )
    return news.article_rejects(landed).select("article_id", joined("reasons").alias("reasons"))


@registered(
    "label_vocabulary_rejects",
    f"""WITH {TOLD} SELECT doc_id AS article_id, array_to_string(list_filter([
      CASE WHEN doc_id % 9 = 2 THEN 'direction' END, CASE WHEN doc_id % 7 = 3 THEN 'surprise' END],
      lambda x: x IS NOT NULL), ',') AS reasons FROM told WHERE doc_id % 9 = 2 OR doc_id % 7 = 3""",
)
def label_vocabulary_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("article_id")
    landed = tables.article_labels(spark, sf_dir).withColumns(
        {
            "direction": F.when(d % 9 == 2, F.lit("upward")).otherwise(F.col("direction")),
            "surprise": F.when(d % 7 == 3, F.lit(None)).otherwise(F.col("surprise")),
        }
    )
    return news.label_rejects(landed).select("article_id", joined("reasons").alias("reasons"))


@registered(
    "label_article_conflicts",
    f"""WITH {TOLD} SELECT doc_id AS article_id, CASE WHEN doc_id % 19 = 4 THEN 'unknown_article' ELSE
      array_to_string(list_filter([CASE WHEN doc_id % 17 = 5 THEN 'ticker_not_tagged' END,
      CASE WHEN doc_id % 23 = 6 THEN 'first_seen_time' END], lambda x: x IS NOT NULL), ',') END AS reasons
    FROM told WHERE doc_id % 19 = 4 OR doc_id % 17 = 5 OR doc_id % 23 = 6""",
)
def label_article_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels some of which name a missing article, another ticker, or another observation."""
    d = F.col("article_id")
    landed = tables.article_labels(spark, sf_dir).withColumns(
        {
            "article_id": F.when(d % 19 == 4, -d - 1).otherwise(d),
            "ticker": F.when(d % 17 == 5, F.lit("Other")).otherwise(F.col("ticker")),
            "first_seen_time": F.when(d % 23 == 6, F.col("first_seen_time") + F.expr("interval 1 second")).otherwise(
                F.col("first_seen_time")
            ),
        }
    )
    found = news.label_conflicts(tables.articles(spark, sf_dir), landed)
    back = F.when(F.col("article_id") < 0, -F.col("article_id") - 1).otherwise(F.col("article_id"))
    return found.select(back.alias("article_id"), joined("reasons").alias("reasons"))


@registered(
    "news_exclusions",
    f"""WITH {PAIRS} SELECT symbol, {at('as_of')} AS as_of, doc_id AS article_id, reason
    FROM visible WHERE reason IS NOT NULL""",
)
def news_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = articles(spark, sf_dir)
    panel = news.checked_panel(found, article_labels(spark, sf_dir))
    out = news.exclusions(spine_of(found), panel, news.NewsConfig())
    return out.select("symbol", stamp("as_of").alias("as_of"), "article_id", "reason")


@registered(
    "news_exclusion_intervals",
    f"""WITH {ARTICLES}, {TOLD}, placed AS (
      SELECT symbol, a.doc_id, epoch_us(seen) AS t0, CASE WHEN entity_match IS NULL THEN 'unlabelled'
        WHEN entity_match = 'not_matched' THEN 'entity_not_matched' WHEN entity_match = 'uncertain' THEN 'entity_uncertain' END AS why
      FROM articles a LEFT JOIN told t ON t.doc_id = a.doc_id)
    SELECT symbol, doc_id AS article_id, why AS reason, t0 AS since, t0 + 604800000000 AS until FROM placed WHERE why IS NOT NULL
    UNION ALL SELECT symbol, doc_id, 'outside_lookback', t0 + 604800000001, NULL FROM placed""",
)
def news_exclusion_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each article does not contribute, and why."""
    panel = news.checked_panel(articles(spark, sf_dir), article_labels(spark, sf_dir))
    return news.exclusion_intervals(panel, news.NewsConfig()).select(
        "symbol", "article_id", "reason", F.unix_micros("since").alias("since"), F.unix_micros("until").alias("until")
    )


@registered(
    "news_story_representatives",
    f"WITH RECURSIVE {CLUSTERS} SELECT symbol, {at('as_of')} AS as_of, doc_id AS article_id FROM reps",
)
def news_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = articles(spark, sf_dir)
    config = news.NewsConfig()
    panel = news.checked_panel(found, article_labels(spark, sf_dir))
    pairs = settle(news.in_lookback(spine_of(found), panel, config), "pairs")
    chosen = news.representatives(pairs.where("reason is null"), news.contributing(panel), config)
    return chosen.select("symbol", stamp("as_of").alias("as_of"), "article_id")


NEWS_BLOCK = f"""{CLUSTERS},
scored AS (
  SELECT *, pow(0.5, age / 3600.0 / 24.0) AS w,
    CASE direction WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END AS d,
    CASE ambiguity WHEN 'low' THEN 0.0 WHEN 'medium' THEN 0.5 ELSE 1.0 END AS am,
    CASE surprise WHEN 'unexpected' THEN 1.0 WHEN 'partly_expected' THEN 0.5 WHEN 'expected' THEN 0.0 END AS su
  FROM reps),
sums AS (
  SELECT symbol, as_of, sum(w) AS total, CAST(count(*) AS DOUBLE) AS sources, max(w) AS recency,
    sum(w * d) / sum(w) AS direction, sum(w * am) / sum(w) AS ambiguity,
    coalesce(sum(w) FILTER (novelty = 'new'), 0) / sum(w) AS novelty,
    coalesce(sum(w) FILTER (relevance = 'direct'), 0) / sum(w) AS relevance,
    sum(w * su) / sum(w) FILTER (su IS NOT NULL) AS surprise, bool_or(su IS NULL) AS unknown
  FROM scored GROUP BY symbol, as_of),
sizes AS (SELECT symbol, as_of, count(*) AS members FROM kept GROUP BY symbol, as_of),
gone AS (
  SELECT symbol, as_of, bool_or(reason = 'unlabelled') AS u, bool_or(reason = 'entity_not_matched') AS n,
    bool_or(reason = 'entity_uncertain') AS c FROM visible GROUP BY symbol, as_of),
news_block AS (
  SELECT s.symbol, s.as_of, total AS news_volume_decayed, sources AS independent_source_count,
    recency AS recency_weight_max, direction AS direction_weighted, ambiguity AS ambiguity_weighted,
    novelty AS novelty_new_share, relevance AS relevance_direct_share, surprise AS surprise_weighted,
    list_sort(list_filter([
      CASE WHEN g.symbol IS NULL THEN 'no_articles' END, CASE WHEN u THEN 'unlabelled_article' END,
      CASE WHEN n THEN 'entity_not_matched' END, CASE WHEN c THEN 'entity_uncertain' END,
      CASE WHEN g.symbol IS NOT NULL AND total IS NULL THEN 'no_qualifying_articles' END,
      CASE WHEN members > sources THEN 'syndication_collapsed' END,
      CASE WHEN unknown THEN 'surprise_unknown' END], lambda x: x IS NOT NULL)) AS flags
  FROM spine s LEFT JOIN sums USING (symbol, as_of) LEFT JOIN sizes USING (symbol, as_of)
  LEFT JOIN gone g ON g.symbol = s.symbol AND g.as_of = s.as_of)"""


@registered(
    "news_features",
    f"""WITH RECURSIVE {NEWS_BLOCK} SELECT symbol, {at('as_of')} AS as_of,
      {', '.join(f"{r6_sql(n)} AS {n}" for n in news.FEATURES)}, array_to_string(flags, ',') AS quality_flags
    FROM news_block""",
)
def news_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = articles(spark, sf_dir)
    block = news.feature_block(spine_of(found), found, article_labels(spark, sf_dir))
    return block.select(
        "symbol", stamp("as_of").alias("as_of"), *[r6(F.col(n)).alias(n) for n in news.FEATURES],
        joined("quality_flags").alias("quality_flags"),
    )


@registered(
    "evidence_cards",
    f"""WITH RECURSIVE {NEWS_BLOCK},
    last_bar AS (
      SELECT p_brand AS symbol, max(CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) + INTERVAL 7 DAY) AS session
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
    SELECT symbol, {at('as_of')} AS as_of, {r6_sql('news_volume_decayed')} AS news_volume_decayed,
      {r6_sql('direction_weighted')} AS direction_weighted, CAST(l.symbol IS NOT NULL AS INT) AS has_price,
      array_to_string(list_filter(flags, lambda f: f <> ''), ',') AS news_flags
    FROM news_block b LEFT JOIN last_bar l USING (symbol)""",
)
def evidence_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both families for every news spine row; the price family reads each symbol's last bar."""
    found, bars = articles(spark, sf_dir), stored_bars(spark, sf_dir)
    spine = settle(spine_of(found), "spine")
    price = price_features.feature_block(spine, bars, tables.sectors(spark, sf_dir))
    told = news.feature_block(spine, found, article_labels(spark, sf_dir))
    cards = settle(evidence.evidence_card(price, told), "cards")
    evidence.refuse_not_finite(cards, [*price_features.FEATURES, *news.FEATURES], ["symbol", "as_of"])
    news_only = F.array_intersect(
        "quality_flags",
        F.array(*[F.lit(f) for f in (
            "entity_not_matched", "entity_uncertain", "no_articles", "no_qualifying_articles",
            "surprise_unknown", "syndication_collapsed", "unlabelled_article",
        )]),
    )
    return cards.select(
        "symbol", stamp("as_of").alias("as_of"),
        r6(F.col("news_volume_decayed")).alias("news_volume_decayed"),
        r6(F.col("direction_weighted")).alias("direction_weighted"),
        F.col("residual_return_1s").isNotNull().cast("int").alias("has_price"),
        joined(F.array_sort(news_only)).alias("news_flags"),
    )


CONTEXT = f"""{ARTICLES},
numbered AS (SELECT *, count(*) OVER (PARTITION BY symbol ORDER BY seen RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS x FROM articles),
context AS (
  SELECT a.doc_id, a.symbol, list(b.doc_id ORDER BY b.seen, b.doc_id) AS before
  FROM articles a LEFT JOIN articles b ON a.symbol = b.symbol AND b.seen < a.seen GROUP BY a.doc_id, a.symbol),
last_five AS (
  SELECT doc_id, symbol, list_filter(before, lambda x: x IS NOT NULL)[-5:] AS ctx FROM context)"""


@registered(
    "prior_story_context",
    f"""WITH {CONTEXT} SELECT symbol AS ticker, doc_id AS article_id, array_to_string(ctx, ',') AS context FROM last_five""",
)
def prior_story_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labeling.prior_context(articles(spark, sf_dir))
    ids = F.transform("context", lambda e: e.article_id.cast("string"))
    return out.select("ticker", "article_id", F.array_join(ids, ",").alias("context"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    names = names.withColumn("company_name", F.concat(F.col("ticker"), F.lit(" Inc")))
    return labeling.label_requests(articles(spark, sf_dir), names, "model-1", "prompt-1")


@registered(
    "label_requests",
    f"""WITH {CONTEXT}, stamped AS (
      SELECT *, strftime(seen, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS seen_iso,
        strftime(seen - INTERVAL 5 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS source_iso FROM articles),
    asked AS (
      SELECT a.*, len(ctx) AS context_size,
        coalesce((SELECT list({{'article_id': CAST(b.doc_id AS VARCHAR), 'headline': b.headline, 'source_domain': b.source,
            'source_time': b.source_iso}} ORDER BY b.seen, b.doc_id) FROM stamped b WHERE list_contains(ctx, b.doc_id)), []) AS entries
      FROM stamped a JOIN last_five USING (doc_id)),
    keyed AS (
      SELECT *, CAST(to_json({{'article_id': CAST(doc_id AS VARCHAR), 'company_name': symbol || ' Inc', 'first_seen_time': seen_iso,
        'headline': headline, 'model_version': 'model-1', 'prior_story_context': entries, 'prompt_version': 'prompt-1',
        'source_domain': source, 'source_name': source, 'source_time': source_iso, 'summary': summary,
        'ticker': symbol}}) AS VARCHAR) AS body FROM asked)
    SELECT symbol AS ticker, doc_id AS article_id, context_size, sha256(body) AS cache_key FROM keyed""",
)
def label_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("ticker", "article_id", "context_size", "cache_key")


@registered(
    "label_cache_split",
    f"""WITH {CONTEXT} SELECT symbol AS ticker, doc_id AS article_id,
      CASE WHEN len(ctx) = 5 THEN 'held' ELSE 'asked' END AS outcome FROM last_five""",
)
def label_cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that already answers every request with a full context."""
    asked = settle(requests(spark, sf_dir), "requests")
    cache = asked.where("context_size = 5").select("cache_key")
    held, rest = labeling.split_by_cache(asked, cache)
    tag = lambda df, name: df.select("ticker", "article_id", F.lit(name).alias("outcome"))
    return tag(held, "held").unionByName(tag(rest, "asked"))


@registered(
    "label_cache_put",
    f"WITH {CONTEXT} SELECT symbol AS ticker, doc_id AS article_id FROM last_five WHERE len(ctx) <> 5",
)
def label_cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label offered twice to a cache that already holds the full contexts."""
    asked = settle(requests(spark, sf_dir), "requests")
    cache = asked.where("context_size = 5").select("cache_key")
    return labeling.new_cache_rows(cache, asked.unionByName(asked)).select("ticker", "article_id")


_DEFECTS = 11


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply per labelled article; the id's residue decides its defect."""
    told = tables.article_labels(spark, sf_dir)
    texts = tables.articles(spark, sf_dir).select("article_id", "headline", "summary")
    d = F.col("article_id")
    k = d % _DEFECTS
    rows = told.select("article_id", "ticker", *news.LABEL_FIELDS).join(texts, "article_id")
    # Whole headlines, or a stretch of the summary that starts anywhere in it and may reach its end.
    size = F.length("summary")
    middle = F.substring(F.col("summary"), F.pmod(d * 7919, F.greatest(size, F.lit(1))).cast("int") + 1, (d % 90 + 1).cast("int"))
    told_span = F.when((d % 2 == 0) | (size == 0), F.col("headline")).otherwise(middle)
    span = F.when(k == 6, F.lit("never said ☃")).otherwise(told_span)
    body = F.struct(
        F.when(k == 2, F.lit("0x")).otherwise(d.cast("string")).alias("article_id"),
        F.when(k == 3, F.lit("Other")).otherwise(F.col("ticker")).alias("ticker"),
        "entity_match",
        F.when(k == 4, F.lit("upward")).otherwise(F.col("direction")).alias("direction"),
        "category", "novelty", "relevance", "surprise", "ambiguity",
        F.array(span).alias("evidence_spans"), F.array().cast("array<string>").alias("limitations"),
        F.lit("extra keys are ignored").alias("note"),
    )
    text = F.to_json(body)
    reply = (
        F.when(k == 0, F.concat(F.lit("["), text, F.lit("]")))
        .when(k == 1, F.regexp_replace(text, '"surprise":"[a-z_]*",', ""))
        .when(k == 5, F.regexp_replace(text, '"ambiguity":"[a-z]*"', '"ambiguity":3'))
        .otherwise(text)
    )
    return rows.select("article_id", "ticker", "headline", "summary", reply.alias("reply"))


@registered(
    "label_reply_validation",
    f"""WITH {TOLD} SELECT doc_id AS article_id, CASE
      WHEN doc_id % 11 = 0 THEN 'not_an_object' WHEN doc_id % 11 = 1 THEN 'missing_field'
      WHEN doc_id % 11 = 2 THEN 'wrong_article' WHEN doc_id % 11 = 3 THEN 'wrong_ticker'
      WHEN doc_id % 11 IN (4, 5) THEN 'value_not_allowed'
      WHEN entity_match = 'not_matched' AND (relevance <> 'incidental' OR ambiguity <> 'high') THEN 'not_matched_contradicted'
      WHEN doc_id % 11 = 6 THEN 'span_not_verbatim' ELSE 'accepted' END AS outcome FROM told""",
)
def label_reply_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = labeling.judged_replies(replies(spark, sf_dir))
    return judged.select("article_id", F.coalesce("reason", F.lit("accepted")).alias("outcome"))
