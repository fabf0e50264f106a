"""Named queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.exprs import utc_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def stamp(col: str | Column) -> Column:
    """Timestamps leave a query as text, so both engines compare the same thing."""
    return utc_text(F.col(col) if isinstance(col, str) else col)


def joined(col: str | Column) -> Column:
    """Lists leave a query as comma-separated text."""
    return F.array_join(col, ",")


def at(alias: str) -> str:
    """SQL: the text form of a timestamp."""
    return f"strftime({alias}, '%Y-%m-%d %H:%M:%S')"


def r6_sql(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# Common SQL building blocks, written from the definitions rather than from the Spark plans.

TICKS = """
ticks AS (
  SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS week,
         l_shipdate AS traded, l_orderkey * 8 + l_linenumber AS print_no,
         CAST(floor(l_extendedprice / l_quantity * 10000) AS BIGINT) AS px,
         CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

BARS = TICKS + """,
bars AS (
  SELECT symbol, week + INTERVAL 7 DAY AS session,
         week + INTERVAL 7 DAY + INTERVAL 15 MINUTE AS seen,
         first(px ORDER BY traded, print_no, px) AS o, max(px) AS h, min(px) AS l,
         last(px ORDER BY traded, print_no, px) AS c, CAST(sum(qty) AS BIGINT) AS v
  FROM ticks GROUP BY symbol, week)"""

SECTORS = """
sectors AS (
  SELECT DISTINCT p_brand AS symbol,
         'S' || (CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) % 5) AS sector
  FROM part WHERE p_brand <> 'Brand#25')"""

MOVES = BARS + "," + SECTORS + """,
moves AS (
  SELECT b.*, s.sector, row_number() OVER w AS pos, lag(session) OVER w AS prev_session,
         greatest(seen, lag(seen) OVER w) AS move_seen_or_own,
         CASE WHEN lag(c) OVER w IS NOT NULL THEN greatest(seen, lag(seen) OVER w) END AS move_seen,
         CAST(c AS DOUBLE) / lag(c) OVER w - 1 AS ret,
         CAST(o AS DOUBLE) / lag(c) OVER w - 1 AS gap,
         CASE WHEN lag(c) OVER w IS NOT NULL
              THEN greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) END AS tr
  FROM bars b LEFT JOIN sectors s USING (symbol)
  WINDOW w AS (PARTITION BY b.symbol ORDER BY session))"""

# Peers by plain self-join: the sector without the symbol, and everything without it.
RESIDUALS = MOVES + """,
sec AS (
  SELECT a.symbol, a.session, median(b.ret) AS m_ret, median(b.gap) AS m_gap,
         count(b.ret) AS peers, max(b.move_seen) AS peer_seen
  FROM moves a LEFT JOIN moves b
    ON a.session = b.session AND a.sector = b.sector AND a.symbol <> b.symbol
  GROUP BY a.symbol, a.session),
mkt AS (
  SELECT a.symbol, a.session, median(b.ret) AS m_ret, median(b.gap) AS m_gap,
         count(b.ret) AS peers, max(b.move_seen) AS peer_seen
  FROM moves a LEFT JOIN moves b ON a.session = b.session AND a.symbol <> b.symbol
  GROUP BY a.symbol, a.session),
resid AS (
  SELECT m.*, m.ret - coalesce(s.m_ret, 0) AS ret_sec, m.gap - coalesce(s.m_gap, 0) AS gap_sec,
         m.ret - coalesce(k.m_ret, 0) AS ret_mkt, m.gap - coalesce(k.m_gap, 0) AS gap_mkt,
         CASE WHEN m.ret IS NOT NULL THEN CAST(s.peers = 0 AS INT) END AS alone_sec,
         CASE WHEN m.ret IS NOT NULL THEN CAST(k.peers = 0 AS INT) END AS alone_mkt,
         greatest(m.move_seen, s.peer_seen) AS seen_sec, greatest(m.move_seen, k.peer_seen) AS seen_mkt
  FROM moves m JOIN sec s USING (symbol, session) JOIN mkt k USING (symbol, session))"""
