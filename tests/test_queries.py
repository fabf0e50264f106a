"""Registered queries against their SQL on the given tables.

The default set covers every family; TIDEMARK_ALL=1 runs all of them.
"""

import os

import pytest
from pyspark.sql import functions as F

from tests.compare import check, duck
from tidemark.plans import ORACLES, QUERIES, audit

SF = "/root/testdata/sf0.001"
DEFAULT = (
    "residual_returns", "universe_members", "news_features", "prior_story_context", "label_reply_validation",
    "eligibility_gates", "debit_verticals", "entry_rung_prices", "observation_rejects", "broker_order_feed",
    "reconciliation_report", "equity_stops", "order_transition_audit", "trial_registry", "ranked_selection",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("TIDEMARK_ALL") else DEFAULT)
def test_query(spark, con, name):
    text, _, _, same = check(spark, con, SF, name)
    assert same, text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_unexplained_orders_name_closed_ones(spark):
    """Every order at the broker that nobody knows, whatever its status."""
    k = F.col("o_orderkey")
    orders = spark.read.parquet(f"{SF}/orders.parquet").where((k % 11 != 2) & (k % 13 == 1))
    got = {r.client_order_id for r in QUERIES["unexplained_orders"](spark, SF).collect()}
    assert got == {f"x{r.o_orderkey}" for r in orders.collect()}
    assert orders.where("o_orderkey % 7 in (1, 2)").count() > 0


def test_books_join_the_lines_once(spark):
    """Positions and activities of a report read the joined lines from one place."""
    _, _, positions, activities = audit.books(spark, SF, lines_twice=True)
    for df in (positions, activities):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
