import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import spread


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most rows; values repeat."""
    rng = random.Random(3)
    data = []
    for i in range(600):
        key = "hot" if i % 3 else f"k{i % 7}"
        data.append((key, i, float(rng.choice([1, 2, 3, 5, 8, 13])), rng.choice([None, i])))
    # A NULL key, NULL order values and NULL values are groups and values like any other.
    for i in range(600, 640):
        data.append((None, i, float(i % 3) if i % 4 else None, None))
    data += [("hot", None, 1.0, 7), (None, None, 2.0, 8)]
    return spark.createDataFrame(data, "k string, seq long, v double, mark long").repartition(5)


def table(df, *order):
    return sorted(map(tuple, df.select(*order).collect()), key=str)


def test_numbered(spark, rows, small_groups):
    one = spread.numbered(rows, ["k"], ["seq"], False)
    two = spread.numbered(rows, ["k"], ["seq"], True)
    assert table(one, "k", "seq", "pos") == table(two, "k", "seq", "pos")


def test_running(spark, rows, small_groups):
    want = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("min", F.col("mark"))}
    one = spread.running(rows, ["k"], ["seq"], False, want)
    two = spread.running(rows, ["k"], ["seq"], True, want)
    assert table(one, "k", "seq", "s", "m", "n") == table(two, "k", "seq", "s", "m", "n")


def test_last_known(spark, rows, small_groups):
    one = spread.last_known(rows, ["k"], ["seq"], False, "mark")
    two = spread.last_known(rows, ["k"], ["seq"], True, "mark")
    assert table(one, "k", "seq", "mark") == table(two, "k", "seq", "mark")


def test_middle_values_with_many_copies(spark, rows, small_groups):
    one = spread.middle_values(rows, ["k"], "v", False)
    two = spread.middle_values(rows, ["k"], "v", True)
    assert table(one, "k", "n", "low", "mid", "high") == table(two, "k", "n", "low", "mid", "high")


def test_quantiles_match_percentile(spark, rows, small_groups):
    shares = {"a": 0.1, "b": 0.5, "c": 0.9}
    want = rows.groupBy("k").agg(F.expr("percentile(v, array(0.1, 0.5, 0.9))").alias("q")).collect()
    for heavy in (False, True):
        got = {r.k: (r.a, r.b, r.c) for r in spread.quantiles(rows, ["k"], "v", heavy, shares).collect()}
        assert got == {r.k: pytest.approx(tuple(r.q)) for r in want}


def test_blocks_give_complete_frames(spark, rows, small_groups):
    from pyspark.sql import Window as W

    out = []
    for heavy in (False, True):
        placed = spread.numbered(rows, ["k"], ["seq"], heavy)
        laid, part = spread.in_blocks(placed, ["k"], heavy, before=3, after=2)
        w = W.partitionBy(*part).orderBy("pos").rowsBetween(-3, 2)
        out.append(table(laid.withColumn("s", F.sum("v").over(w)).where("_core"), "k", "seq", "s"))
    assert out[0] == out[1]


def test_average_ranks_with_null_keys_and_values(spark, rows, small_groups):
    from tidemark.operators.metrics import average_ranks

    named = rows.withColumn("label_id", F.coalesce("seq", F.lit(-1)))
    one = average_ranks(named, "k", "v", False, "r")
    two = average_ranks(named, "k", "v", True, "r")
    assert one.count() == rows.count()
    assert table(one, "k", "seq", "v", "r") == table(two, "k", "seq", "v", "r")


def test_one_repeated_value(spark, small_groups):
    same = spark.range(50).select(F.lit(None).cast("string").alias("k"), F.lit(1.0).alias("v"), "id")
    for heavy in (False, True):
        assert spread.middle_values(same, ["k"], "v", heavy).collect()[0][1:] == (50, 1.0, 1.0, 1.0)
        assert sorted(r.pos for r in spread.numbered(same, ["k"], ["v", "id"], heavy).collect()) == list(range(1, 51))


def test_leave_one_out_with_a_null_group(spark, rows, small_groups):
    from tidemark.operators.panel import leave_one_out

    one = leave_one_out(rows, ["k"], ["v"], False, "x")
    two = leave_one_out(rows, ["k"], ["v"], True, "x")
    assert table(one, "k", "seq", "v", "v_x", "alone_x") == table(two, "k", "seq", "v", "v_x", "alone_x")


def test_no_column_is_added_to_the_result(spark, rows, small_groups):
    out = spread.last_known(rows, ["k"], ["seq"], True, "mark")
    assert set(out.columns) == set(rows.columns)
