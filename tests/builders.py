from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

START = datetime(2026, 5, 1, 20)
BAR_SCHEMA = (
    "symbol string, feed string, session timestamp, first_seen_time timestamp, open decimal(18,4), "
    "high decimal(18,4), low decimal(18,4), close decimal(18,4), volume bigint"
)


def session(i):
    return START + timedelta(days=i)


def bar(symbol, i, close, o=None, h=None, l=None, volume=1_000_000, seen=None):
    close = Decimal(str(close))
    value = lambda v: close if v is None else Decimal(str(v))
    when = seen or session(i) + timedelta(minutes=15)
    return (symbol, "iex_bars", session(i), when, value(o), value(h), value(l), close, volume)


def bars(spark, rows):
    return spark.createDataFrame(rows, BAR_SCHEMA)


def sectors(spark, names, sector="tech"):
    return spark.createDataFrame([(n, sector) for n in names], "symbol string, sector string")


def price_panel():
    """80 flat sessions of a target and two peers; the target's last bar moves."""
    rows = []
    for i in range(80):
        last = i == 79
        rows.append(
            bar("TARGET", i, 102 if last else 100, 101 if last else 100, 103 if last else 101, 99,
                2_000_000 if last else 1_000_000)
        )
        rows += [bar(p, i, 50, 50, 51, 49) for p in ("PEER1", "PEER2")]
    return rows


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
