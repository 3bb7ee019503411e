"""Feature states, features as of each prediction, salted joins: against plain Python and the features at one time."""

from __future__ import annotations

import collections
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog, features, salted, states
from tidemark.settings import MANIFEST

BUREAU = "SK_ID_CURR long, SK_ID_BUREAU long, DAYS_CREDIT int, CREDIT_ACTIVE string, AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double, AMT_CREDIT_SUM_OVERDUE double"
BALANCE = "SK_ID_CURR long, SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string"
START = datetime(2000, 1, 1, tzinfo=timezone.utc)
ANCHOR = "timestamp'2000-01-01T00:00:00Z'"


def loans(seed=1, n=600):
    """A third of all rows belongs to one applicant; NULLs in every column but the key."""
    chance = random.Random(seed)
    some = lambda value: value if chance.random() > 0.1 else None
    key = lambda: 1 if chance.random() < 0.33 else chance.randrange(2, 40)
    return [(key(), i, some(chance.randrange(-900, 200)), some(chance.choice(["Active", "Closed", "Sold"])),
             some(float(chance.randrange(1000))), some(float(chance.randrange(9))), None) for i in range(n)]


def months(seed=2, n=600):
    chance = random.Random(seed)
    some = lambda value: value if chance.random() > 0.1 else None
    key = lambda: 1 if chance.random() < 0.33 else chance.randrange(2, 40)
    return [(key(), some(chance.randrange(30)), some(chance.randrange(-30, 10)), some(chance.choice("012345CX?"))) for i in range(n)]


CASES = [("bureau", BUREAU, loans, "DAYS_CREDIT"), ("bureau_balance", BALANCE, months, "MONTHS_BALANCE")]


def at_once(spark, rows, schema, source):
    df = spark.createDataFrame(rows, schema).withColumn(MANIFEST, F.lit("m"))
    found = features.bureau_features(df) if source == "bureau" else features.balance_features(df)
    return {r["SK_ID_CURR"]: tuple(r[2:]) for r in found.collect()}


@pytest.mark.parametrize("source,schema,make,_", CASES)
def test_merged_states_are_those_of_all_rows(spark, source, schema, make, _):
    rows = make()
    parts = [states.partial_states(spark.createDataFrame(rows[i::3], schema), source) for i in range(3)]
    merged = states.merge_states(states.merge_states(parts[0], parts[1], source), parts[2], source)
    got = {r[0]: tuple(r[1:]) for r in states.finish(merged, source).collect()}
    assert got == at_once(spark, rows, schema, source)
    nothing = states.partial_states(spark.createDataFrame([], schema), source)
    assert states.finish(states.merge_states(parts[0], nothing, source), source).count() == parts[0].count()


@pytest.mark.parametrize("source,schema,make,offset", CASES)
def test_features_as_of_each_prediction(spark, source, schema, make, offset):
    """As many predictions per applicant as there are rows: each equals the features at one time of rows moved to it."""
    rows, chance = make(), random.Random(3)
    times = sorted({START - timedelta(days=chance.randrange(1000)) for _ in range(6)} | {START})
    asked = [(key, t) for key in [*range(1, 42), 1] for t in times] + [(None, START), (1, None)]
    points = spark.createDataFrame(asked, "SK_ID_CURR long, prediction_time timestamp")
    run = states.bureau_features_as_of if source == "bureau" else states.balance_features_as_of
    got = run(points, spark.createDataFrame(rows, schema), F.expr(ANCHOR)).collect()
    assert len(got) == len(asked)
    at = [f.name for f in spark.createDataFrame([], schema).schema].index(offset)
    for t in times:
        shift = (START - t).days if source == "bureau" else (START.year - t.year) * 12 + START.month - t.month
        moved = [tuple(v + shift if i == at and v is not None else v for i, v in enumerate(r)) for r in rows]
        want, none = at_once(spark, moved, schema, source), (None,) * sum(f.source == source for f in catalog.FEATURES)
        for r in got:
            if r["prediction_time"] is not None and r["prediction_time"].replace(tzinfo=timezone.utc) == t:
                assert tuple(r[2:]) == pytest.approx(want.get(r["SK_ID_CURR"], none)), (r, t)
    assert all(set(r[2:]) == {None} for r in got if r[0] is None or r[1] is None)


def test_an_applicant_with_a_third_of_all_rows_spans_tasks(spark, monkeypatch):
    seen = {}
    order = states.in_order

    def kept(*args):
        seen["rows"] = order(*args)
        return seen["rows"]

    monkeypatch.setattr(states, "in_order", kept)
    points = spark.createDataFrame([(1, START)], "SK_ID_CURR long, prediction_time timestamp")
    states.bureau_features_as_of(points, spark.createDataFrame(loans(n=3000), BUREAU), F.expr(ANCHOR), ranges=8).collect()
    per_slot = [r["count"] for r in seen["rows"].where("SK_ID_CURR = 1").groupBy("_slot").count().collect()]
    assert len(per_slot) >= 2 and max(per_slot) < sum(per_slot)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, how):
    chance = random.Random(5)
    big = [(1 if chance.random() < 0.34 else chance.randrange(2, 60), "same") for _ in range(2000)] + [(None, "x")] * 300
    other = [(k, f"o{k}") for k in range(0, 50)] + [(1, "twice"), (None, "none")]
    left, right = spark.createDataFrame(big, "k long, v string"), spark.createDataFrame(other, "k long, w string")
    count = lambda df: collections.Counter(map(tuple, df.collect()))
    assert count(salted.salted_join(left, right, ["k"], how, share=0.01)) == count(left.join(right, ["k"], how))
    assert salted.salted_join(left.limit(0), right, ["k"], how).count() == 0


def test_no_task_holds_a_hot_key(spark):
    big = spark.range(3000).select((F.col("id") * F.expr("int(id % 3 > 0)")).alias("k"), F.lit("same").alias("v"))
    other = spark.range(3000).select(F.col("id").alias("k"))
    heavy = salted.heavy_keys(big, ["k"], 0.05).collect()
    assert [(r.k, r.n, r.salts) for r in heavy] == [(0, 1000, 7)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("16", "false", "-1")):
            spark.conf.set(k, v)
        joined = salted.salted_join(big, other, ["k"], share=0.05)
        rows = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("k") == 0).alias("n")).collect()
        joined_rows = [r.n for r in rows]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(joined_rows) == 1000 and max(joined_rows) < 500


def test_a_side_that_is_copied_cannot_be_kept(spark):
    with pytest.raises(ValueError):
        salted.salted_join(spark.range(1), spark.range(1), ["id"], "right")
