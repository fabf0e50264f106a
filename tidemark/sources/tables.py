"""The given tables as the domain tables the operators take.

Derivations are deterministic and exact: prices are whole numbers of 1/10000 units, and
timestamps stored without a zone are read as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from tidemark.functions.exprs import DAY_SECONDS, plus_seconds, utc_day, utc_floor

EPOCH_2024 = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path).schema
    plain = [f.name for f in found if f.dataType.typeName() == "timestamp_ntz"]
    as_utc = lambda f: StructField(f.name, TimestampType()) if f.name in plain else f
    return spark.read.schema(StructType([as_utc(f) for f in found])).parquet(path)


def brand_number(brand: Column) -> Column:
    return F.regexp_extract(brand, "([0-9]+)$", 1).cast("long")


def instant(minutes: Column) -> Column:
    """Minutes after 2024-01-01 as a timestamp."""
    return F.timestamp_seconds(F.lit(EPOCH_2024) + minutes.cast("long") * 60)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade per line item: brand as symbol, derived unit price in 1/10000."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("symbol"),
        utc_floor(F.col("l_shipdate"), "week").alias("week"),
        F.col("l_shipdate").alias("traded"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("print_no"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000).cast("long").alias("px"),
        F.col("l_quantity").cast("long").alias("qty"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars.  Open and close are the first and last print of the week.

    The print order and its price travel as one decimal, so the partial aggregate stays a
    fixed-width hash aggregate (repeated print numbers resolve to the smaller price for
    the open and the larger one for the close).
    """
    day = F.datediff(utc_day(F.col("traded")), utc_day(F.col("week"))).cast("decimal(1,0)")
    place = (day * F.lit(10**17).cast("decimal(18,0)") + F.col("print_no").cast("decimal(17,0)")).cast(
        "decimal(19,0)"
    )
    packed = (place * F.lit(10**14).cast("decimal(15,0)") + F.col("px").cast("decimal(14,0)")).cast(
        "decimal(38,0)"
    )
    span = F.lit(10**14).cast("decimal(38,0)")
    to_money = lambda c: (c.cast("decimal(20,0)") / F.lit(10000).cast("decimal(5,0)")).cast(
        "decimal(18,4)"
    )
    made = (
        ticks(spark, sf_dir)
        .groupBy("symbol", "week")
        .agg(
            F.min(packed).alias("_first"),
            F.max(packed).alias("_last"),
            F.max("px").alias("_high"),
            F.min("px").alias("_low"),
            F.sum("qty").alias("volume"),
        )
    )
    session = plus_seconds(F.col("week"), F.lit(7 * DAY_SECONDS))
    return made.select(
        "symbol",
        F.lit("weekly_prints").alias("feed"),
        session.alias("session"),
        (session + F.expr("interval 15 minutes")).alias("first_seen_time"),
        to_money(F.col("_first") % span).alias("open"),
        to_money(F.col("_high")).alias("high"),
        to_money(F.col("_low")).alias("low"),
        to_money(F.col("_last") % span).alias("close"),
        "volume",
    )


def late_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly bars with some arriving ten days late, and one of every fifth brand 2000 days late."""
    week, brand = F.floor(F.unix_timestamp("session") / 604800), brand_number(F.col("symbol"))
    seen = F.col("first_seen_time")
    return bars(spark, sf_dir).withColumn(
        "first_seen_time",
        F.when((week == 1200) & (brand % 5 == 3), plus_seconds(seen, F.lit(2000 * DAY_SECONDS)))
        .when((week + brand) % 29 == 0, plus_seconds(seen, F.lit(10 * DAY_SECONDS))).otherwise(seen),
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol to sector; Brand#25 stays unmapped."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    number = brand_number(F.col("symbol"))
    return brands.where(number != 25).select(
        "symbol", F.concat(F.lit("S"), (number % 5).cast("string")).alias("sector")
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: the first line is the headline, the rest the summary."""
    docs = table(spark, sf_dir, "documents")
    cut = F.instr("text", "\n")
    seen = instant(F.col("doc_id") * 7919 % 43200)
    return docs.select(
        F.col("doc_id").alias("article_id"),
        F.array(F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string"))).alias("symbols"),
        F.when(cut == 0, F.col("text")).otherwise(F.expr("substring(text, 1, instr(text, '\n') - 1)")).alias(
            "headline"
        ),
        F.when(cut == 0, F.lit("")).otherwise(F.expr("substring(text, instr(text, '\n') + 1)")).alias(
            "summary"
        ),
        F.col("source").alias("source_domain"),
        (seen - F.expr("interval 5 minutes")).alias("source_time"),
        seen.alias("first_seen_time"),
    )


def article_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label per labelled document, from its id and its two scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = table(spark, sf_dir, "labels").join(docs.select("doc_id"), "doc_id")
    d = F.col("doc_id")
    pick = lambda key, *names: F.element_at(
        F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int")
    )
    seen = instant(d * 7919 % 43200)
    return scored.select(
        d.alias("article_id"),
        F.concat(F.lit("Brand#"), (d % 25 + 1).cast("string")).alias("ticker"),
        pick(d, "matched", "matched", "matched", "uncertain", "matched", "not_matched", "matched").alias(
            "entity_match"
        ),
        F.when(F.col("toxic") == 1, "negative")
        .when(F.col("quality") == 1, "positive")
        .otherwise(pick(d, "mixed", "neutral"))
        .alias("direction"),
        pick(
            d, "earnings", "guidance", "analyst", "regulatory_legal", "product", "financing_ma",
            "management", "macro_industry", "other",
        ).alias("category"),
        pick(d, "new", "follow_up", "duplicate", "unknown").alias("novelty"),
        pick(F.floor(d / 2), "direct", "industry_linked", "incidental", "unknown").alias("relevance"),
        pick(F.floor(d / 3), "unexpected", "partly_expected", "expected", "unknown").alias("surprise"),
        pick(F.floor(d / 5), "low", "medium", "high").alias("ambiguity"),
        F.array().cast("array<string>").alias("evidence_spans"),
        F.array().cast("array<string>").alias("limitations"),
        F.lit("rules-1").alias("labeler_version"),
        (seen - F.expr("interval 5 minutes")).alias("source_time"),
        seen.alias("first_seen_time"),
    )


def feed_policies(spark: SparkSession) -> DataFrame:
    """Four of the five event feeds; signup stays unregistered."""
    return spark.createDataFrame(
        [
            ("click", True, 0, False),
            ("view", False, 60, False),
            ("purchase", False, 3600, False),
            ("error", True, 0, True),
        ],
        "feed string, proves_delivery_time boolean, lag_seconds long, "
        "event_time_may_follow_first_seen boolean",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw observations; residues of the id inject every kind of defect."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    received = F.col("ts") + F.make_dt_interval(secs=(i % 90).cast("decimal(18,6)"))
    late = lambda k, **unit: F.col("ts") + F.make_dt_interval(**{n: F.lit(v) for n, v in unit.items()})
    received = F.when(i % 97 == 3, late(0, mins=-1)).otherwise(received)
    proves = F.col("event_type").isin("click", "error")
    first_seen = (
        F.when(proves & (i % 101 == 5), F.lit(None).cast("timestamp"))
        .when(proves & (i % 103 == 6), F.col("ts") - F.expr("interval 2 minutes"))
        .when(proves, F.col("ts") + F.expr("interval 90 seconds"))
        .when(i % 107 == 7, F.col("ts"))
    )
    event_time = F.when(i % 109 == 8, plus_seconds(F.col("ts"), F.lit(2 * DAY_SECONDS))).otherwise(F.col("ts"))
    as_of = F.when(i % 113 == 9, F.col("ts")).otherwise(plus_seconds(F.col("ts"), F.lit(DAY_SECONDS)))
    payload = F.when(i % 127 == 10, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(
            F.lit("value"), F.col("value").cast("decimal(18,2)").cast("string"),
            F.lit("props"), F.col("props"),
        )
    )
    return e.select(
        F.col("event_type").alias("feed"),
        F.when(i % 131 == 11, F.lit(" ")).otherwise(F.col("user_id").cast("string")).alias("subject_id"),
        event_time.alias("event_time"),
        F.col("ts").alias("source_time"),
        received.alias("received_time"),
        first_seen.alias("first_seen_time"),
        as_of.alias("as_of"),
        payload.alias("payload"),
        i.alias("seq"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as option contracts on their brand, quoted at 2024-01-02 15:00."""
    k = F.col("p_partkey")
    cents = lambda c: (c.cast("decimal(12,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,4)")
    strike = F.lit(90) + (k * 7 % 21) * 5
    is_call = k % 2 == 0
    edge = F.when(is_call, F.lit(200) - strike).otherwise(strike - F.lit(80))
    bid = edge * 8 + k % 40 + 50
    ask = bid + 5 + k % 17
    quote = F.timestamp_seconds(
        F.lit(EPOCH_2024 + 86400 + 54000) - F.when(k % 23 == 0, 7200).otherwise(k % 600)
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.col("p_brand"), F.when(is_call, F.lit("C")).otherwise(F.lit("P")), k.cast("string")).alias(
            "symbol"
        ),
        F.col("p_brand").alias("underlying_symbol"),
        F.when(is_call, F.lit("call")).otherwise(F.lit("put")).alias("option_type"),
        strike.cast("decimal(18,4)").alias("strike"),
        F.when(k % 41 == 0, F.lit(0).cast("decimal(18,4)")).otherwise(cents(bid)).alias("bid"),
        cents(ask).alias("ask"),
        F.date_add(F.lit("2024-01-02").cast("date"), (F.col("p_size") % 4 * 7).cast("int")).alias("expiry"),
        F.when(k % 43 == 0, F.lit(1)).otherwise(F.lit(25)).cast("int").alias("bid_size"),
        F.lit(30).cast("int").alias("ask_size"),
        F.when(k % 47 == 0, F.lit(10)).otherwise(F.lit(100)).cast("int").alias("multiplier"),
        F.when(k % 53 == 0, F.lit(None).cast("decimal(18,8)"))
        .otherwise(
            (F.when(is_call, 1).otherwise(-1) * (F.lit(15) + k % 60)).cast("decimal(12,0)")
            / F.lit(100).cast("decimal(3,0)")
        )
        .cast("decimal(18,8)")
        .alias("delta"),
        quote.alias("quote_time"),
        F.when(k % 59 == 0, F.lit("delayed")).otherwise(F.lit("indicative")).alias("feed"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as order lifecycle events: one subject per user and week of ids."""
    i = F.col("event_id")
    names = ["submitted", "working", "partial", "filled", "cancel_pending", "canceled", "closing", "reconciled"]
    pick = F.element_at(F.array(*[F.lit(n) for n in names]), ((i * 7 + F.col("user_id")) % 8 + 1).cast("int"))
    first = F.when(i % 5 == 0, F.lit("submitted")).otherwise(pick)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("subject_id"),
        i.alias("seq"),
        first.alias("event"),
        F.col("ts").alias("recorded_at"),
    )


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user a running account value in cents: 100,000.00 plus signed event values."""
    signed = F.when(F.col("event_type").isin("error", "view"), -1).otherwise(1)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("account"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("as_of"),
        (F.round(F.col("value") * 100).cast("long") * signed * 10).alias("change_cents"),
    )
