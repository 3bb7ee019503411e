from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import latest
from tidemark.operators.latest import first_value_per_key, latest_per_key, pit_join
from tidemark.operators.features import balance_features
from tidemark.operators.ranks import in_order
from tidemark.settings import MANIFEST

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.mark.parametrize("tolerance", [None, "3 days"])
@pytest.mark.parametrize("ranges", [1, 7])
def test_point_in_time_join_equals_search(spark, tolerance, ranges, monkeypatch):
    monkeypatch.setattr(latest, "in_order", lambda df, keys, order: in_order(df, keys, order, ranges))
    rng = random.Random(2)
    # One hot key, many equal times, points before any fact, keys without facts.
    points = [(i, "hot" if i % 3 else f"k{i % 9}", START + timedelta(hours=rng.randrange(0, 900))) for i in range(300)]
    facts = [(i, "hot" if i % 3 else f"k{i % 6}", START + timedelta(hours=rng.randrange(100, 800)), i * 1.5) for i in range(400)]
    p = spark.createDataFrame(points, "id int, k string, at timestamp").repartition(5)
    f = spark.createDataFrame(facts, "fact int, k string, known timestamp, v double").repartition(3)
    got = {r.id: (r.fact, r.v) for r in pit_join(p, f, ["k"], "at", "known", ["fact", "v"], ["fact"], tolerance).collect()}
    assert len(got) == len(points)
    for i, key, at in points:
        fit = [x for x in facts if x[1] == key and x[2] <= at and (not tolerance or x[2] >= at - timedelta(days=3))]
        best = max(fit, key=lambda x: (x[2], x[0]), default=None)
        assert got[i] == ((best[0], best[3]) if best else (None, None))


def test_a_hot_key_spans_ranges(spark):
    """Most facts of one key within an hour: the order is dealt over several tasks all the same."""
    facts = spark.range(20_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 3600).alias("t"), "id")
    assert in_order(facts, ["k"], [F.col("t"), F.col("id")], 8).select("_slot").distinct().count() > 4


def test_latest_per_key_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), (F.col("id") % 7).alias("w"))
    newest = latest_per_key(df, ["k"], [F.desc("w"), F.asc("v")])
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Partial") > plan.index("Exchange")  # children are printed below
    want = {k: min((v for v in range(k, 1000, 3)), key=lambda v: (-(v % 7), v)) for k in range(3)}
    assert {r.k: r.v for r in newest.collect()} == want
    assert {r.k: r.h for r in first_value_per_key(df, ["k"], [F.desc("w"), F.asc("v")], "v", "h").collect()} == want


def test_latest_status_takes_newest_month_then_smallest_record(spark):
    rows = [(1, 10, -1, "0"), (1, 12, -1, "3"), (1, 9, -2, "5"), (2, 5, 0, "X"), (2, 4, -7, "2"), (3, 7, -1, "0"), (3, 7, -1, "2"),
            (4, 8, 1, "5"), (4, 8, -3, "C")]
    df = spark.createDataFrame([(*r, "m") for r in rows], f"SK_ID_CURR int, SK_ID_BUREAU int, MONTHS_BALANCE int, STATUS string, {MANIFEST} string")
    got = {r.SK_ID_CURR: r for r in balance_features(df).collect()}
    latest = {k: r["bureau_balance.latest_status_delinquent"] for k, r in got.items()}
    assert latest == {1: 0.0, 2: 0.0, 3: 1.0, 4: 0.0}
    assert got[2]["bureau_balance.max_delinquency_level"] == 2.0
    assert got[4]["bureau_balance.month_count"] == 1.0


def test_balance_aggregate_is_a_hash_aggregate(spark):
    df = spark.createDataFrame([(1, 1, 0, "0", "m")], f"SK_ID_CURR int, SK_ID_BUREAU int, MONTHS_BALANCE int, STATUS string, {MANIFEST} string")
    plan = balance_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
