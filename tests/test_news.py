import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.builders import as_dicts
from tests.compare import check
from tidemark.functions import guards
from tidemark.functions.headline import canonical_headline
from tidemark.operators import labeling, news

AS_OF = datetime(2026, 6, 1, 12)
ARTICLE = (
    "article_id string, symbols array<string>, headline string, summary string, source_domain string, "
    "source_time timestamp, first_seen_time timestamp"
)
LABEL = (
    "article_id string, ticker string, entity_match string, direction string, category string, novelty string, "
    "relevance string, surprise string, ambiguity string, source_time timestamp, first_seen_time timestamp"
)


def article(name, age, headline=None, symbol="AAPL"):
    seen = AS_OF - timedelta(hours=age)
    return (name, [symbol], headline or f"Story {name}", "", "wire", seen, seen)


def label(name, age, direction="positive", surprise="unexpected", ambiguity="low", match="matched", symbol="AAPL"):
    seen = AS_OF - timedelta(hours=age)
    return (name, symbol, match, direction, "earnings", "new", "direct", surprise, ambiguity, seen, seen)


def block(spark, articles, labels, config=news.NewsConfig(), symbol="AAPL"):
    held = news.usable_articles(spark.createDataFrame(articles, ARTICLE))
    told = spark.createDataFrame(labels, LABEL)
    spine = spark.createDataFrame([(symbol, AS_OF)], "symbol string, as_of timestamp")
    [row] = as_dicts(news.feature_block(spine, held, told, config))
    return row


def test_golden_block(spark):
    row = block(
        spark, [article("a1", 0), article("a2", 24)],
        [label("a1", 0), label("a2", 24, "neutral", "expected", "medium")],
    )
    want = {
        "news_volume_decayed": 1.5, "independent_source_count": 2.0, "direction_weighted": 1 / 1.5,
        "surprise_weighted": 1 / 1.5, "novelty_new_share": 1.0, "relevance_direct_share": 1.0,
        "ambiguity_weighted": 0.25 / 1.5, "recency_weight_max": 1.0,
    }
    assert {k: row[k] for k in want} == pytest.approx(want)
    assert row["quality_flags"] == []


def chain(spark, ages, copies=1):
    names = [(f"r{a}-{c}", a) for a in ages for c in range(copies)]
    config = news.NewsConfig(lookback_hours=200)
    return block(
        spark, [article(n, a, "Same wire story!") for n, a in names], [label(n, a) for n, a in names], config
    )


def test_republication_is_measured_from_the_anchor(spark):
    row = chain(spark, (80, 40, 0))
    assert row["independent_source_count"] == 2.0
    assert row["quality_flags"] == ["syndication_collapsed"]


def test_many_copies_and_several_generations(spark):
    row = chain(spark, (190, 189, 141, 100, 92, 40, 0), copies=9)
    assert row["independent_source_count"] == 4.0


def test_copies_apart_by_more_than_the_window_are_separate(spark):
    row = chain(spark, (98, 49, 0))
    assert row["independent_source_count"] == 3.0 and row["quality_flags"] == []


def test_two_kinds_of_empty(spark):
    none = block(spark, [article("a", 1, symbol="MSFT")], [], symbol="AAPL")
    assert none["quality_flags"] == ["no_articles"]
    old = block(spark, [article("a", 300)], [])
    assert old["quality_flags"] == ["no_qualifying_articles"]
    bare = block(spark, [article("a", 1)], [label("a", 1, match="uncertain")])
    assert bare["quality_flags"] == ["entity_uncertain", "no_qualifying_articles"]


def test_lookback_boundary_is_inclusive(spark):
    assert block(spark, [article("a", 168)], [label("a", 168)])["independent_source_count"] == 1.0


def test_zero_weights_leave_the_counts(spark):
    row = block(spark, [article("a", 1)], [label("a", 1)], news.NewsConfig(category_weights={"earnings": 0.0}))
    assert row["independent_source_count"] == 1.0 and row["direction_weighted"] is None
    assert row["quality_flags"] == ["zero_denominator"]


def test_unknown_surprise_has_its_own_denominator(spark):
    row = block(
        spark, [article("a", 0), article("b", 0)],
        [label("a", 0, surprise="unknown"), label("b", 0, surprise="partly_expected")],
    )
    assert row["surprise_weighted"] == pytest.approx(0.5) and row["quality_flags"] == ["surprise_unknown"]


@pytest.mark.parametrize("bad", [label("zzz", 1), label("a", 2), label("a", 1, symbol="MSFT"), label("a", 1, direction="up")])
def test_contradicting_labels_stop_the_job(spark, bad):
    with pytest.raises(guards.IntegrityError):
        block(spark, [article("a", 1)], [bad])


def test_canonical_headline(spark):
    rows = [("Apple’s  ＮＥＷ ﬁling — beats!",), ("apple s new filing beats",), ("Straße",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(canonical_headline(F.col("h"))).collect()]
    assert got == ["apple s new filing beats", "apple s new filing beats", "strasse"]


def test_prior_context_never_shows_a_simultaneous_article(spark):
    rows = [article(f"t{i}", 10) for i in range(70)] + [article("late", 1), article("first", 20)]
    held = spark.createDataFrame(rows, ARTICLE)
    got = {r.article_id: [e.article_id for e in r.context] for r in labeling.prior_context(held).collect()}
    assert got["first"] == [] and got["t3"] == ["first"]
    assert got["late"] == sorted(f"t{i}" for i in range(70))[-5:]


def test_prior_context_split_form(spark, small_groups):
    test_prior_context_never_shows_a_simultaneous_article(spark)


def test_anchors_of_many_copies_equal_a_plain_pass(spark, small_groups):
    """Headlines copied at random instants, ties among them, over windows that overlap the lookback."""
    rng = random.Random(5)
    config = news.NewsConfig(lookback_hours=200, cluster_window_hours=48)
    start = datetime(2026, 6, 1)
    when = lambda h: start + timedelta(hours=h)
    rows = [("S", f"h{rng.randrange(3)}", when(rng.randrange(400)), f"a{i:03d}") for i in range(120)]
    names = [n for n in news.LABEL_FIELDS]
    stories = spark.createDataFrame(rows, "symbol string, headline_hash string, first_seen_time timestamp, article_id string")
    stories = stories.withColumns({n: F.lit("x") for n in names})
    instants = [when(h) for h in range(0, 420, 20)]
    asked = spark.createDataFrame([(t,) for t in instants], "as_of timestamp")
    age = (F.unix_micros("as_of") - F.unix_micros("first_seen_time")) / 3.6e9
    kept = stories.join(asked, (age >= 0) & (age <= 200)).withColumn("age_seconds", age * 3600)
    got = sorted((r.as_of, r.headline_hash, r.article_id, r.members) for r in news.representatives(kept, stories, config).collect())
    want = []
    for t in instants:
        for h in ("h0", "h1", "h2"):
            seen = sorted((at, i) for _, k, at, i in rows if k == h and timedelta(0) <= t - at <= timedelta(hours=200))
            anchor = None
            for at, i in seen:
                if anchor is None or at - anchor > timedelta(hours=48):
                    want.append((t, h, i, len(seen) if anchor is None else 0))
                    anchor = at
    assert got == sorted(want)


def test_labels_of_rejected_articles_go_with_them(spark, tmp_path):
    """Labelled documents without a text, or with a blank or wordless headline, stop no query."""
    texts = [None, "", "\nA summary alone", "?!\nA summary", "One story\nand its text", "One story", "Another"]
    docs = [(i, t, "en", "wire", len(t or "")) for i, t in enumerate(texts)]
    told = [(i, i % 2, 0) for i in range(len(texts))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("news_exclusion_intervals", "news_exclusions", "news_features", "news_story_representatives"):
        text, _, _, same = check(spark, con, str(tmp_path), name)
        assert same, f"{name}: {text}"


def test_labels_of_unknown_articles_stay(spark):
    held = spark.createDataFrame([article("a", 1), article("b", 1, headline="?!")], ARTICLE)
    told = spark.createDataFrame([label("a", 1), label("b", 1), label("c", 1)], LABEL)
    assert sorted(r.article_id for r in news.labels_of_usable(held, told).collect()) == ["a", "c"]
