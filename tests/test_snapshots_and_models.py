"""Snapshot differences, publication after reruns, stored models, stream audit and open windows."""

from __future__ import annotations

import collections
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import monitor, scorecard, snapshot_diff
from tidemark.settings import MANIFEST
from tidemark.sources import tables
from tidemark.streaming import audit, flow


def stored(spark, folder, rows):
    hashed = [(k, hashlib.sha256(v.encode()).hexdigest()) for k, v in rows]
    return snapshot_diff.store_snapshot(spark.createDataFrame(hashed, "k long, h string"), ["k"], "h", str(folder))


def test_differences_are_those_of_multisets(spark, tmp_path):
    """Changed, removed, added and repeated rows; a third of all rows is equal."""
    chance = random.Random(1)
    old = [(i, f"v{i}") for i in range(400)] + [(0, "same")] * 200
    new = [(k, v + "!" if chance.random() < 0.02 else v) for k, v in old if chance.random() > 0.02] + [(900, "new"), (0, "same")]
    a, b = stored(spark, tmp_path / "a", old), stored(spark, tmp_path / "b", new)
    got = {(r.k, r.change): r.rows for r in snapshot_diff.snapshot_difference(spark, a, b, ["k"]).groupBy("k", "change").agg(F.sum("rows").alias("rows")).collect()}
    one, two = collections.Counter(old), collections.Counter(new)
    want = collections.Counter()
    for (k, _), n in (one - two).items():
        want[k, "removed"] += n
    for (k, _), n in (two - one).items():
        want[k, "added"] += n
    assert got == dict(want)


def test_only_leaves_that_differ_are_read(spark, tmp_path):
    rows = [(i, f"v{i}") for i in range(3000)]
    a, b = stored(spark, tmp_path / "a", rows), stored(spark, tmp_path / "b", rows)
    c = stored(spark, tmp_path / "c", rows[:-1] + [(5000, "x")])
    assert snapshot_diff.differing_prefixes(spark, a, b) == []
    assert snapshot_diff.snapshot_difference(spark, a, b, ["k"]).count() == 0
    opened = snapshot_diff.differing_prefixes(spark, a, c)
    assert sorted({hashlib.sha256(v.encode()).hexdigest()[:2] for v in ("v2999", "x")}) == opened
    read = snapshot_diff.snapshot_difference(spark, a, c, ["k"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and all(f"_prefix" in line for line in plan.splitlines() if "PartitionFilters" in line)
    assert {tuple(r) for r in read.collect()} == {(2999, "removed", 1), (5000, "added", 1)}
    nothing = stored(spark, tmp_path / "d", [])
    assert snapshot_diff.snapshot_difference(spark, nothing, c, ["k"]).count() == 3000


def test_publication_goes_by_the_newest_receipt_of_each_table(spark):
    at = lambda second: __import__("datetime").datetime(2024, 1, 1, 0, 0, second)
    rows = [("s", f"r{i}", status, manifest, None, table, 0, 0, 0, None, at(i)) for i, (manifest, table, status) in enumerate([
        ("ok", "a", "FAILED"), ("ok", "a", "COMPLETE"), ("bad", "a", "COMPLETE"), ("bad", "b", "COMPLETE"), ("bad", "a", "RUNNING")])]
    receipts = spark.createDataFrame(rows + [("other", "r9", "COMPLETE", "none", None, "a", 0, 0, 0, None, at(9))], tables.RECEIPT_SCHEMA)
    df = spark.createDataFrame([("ok",), ("bad",), ("none",), (None,)], f"{MANIFEST} string")
    ids = lambda **more: {r[0] for r in tables.published(df, receipts, "s", **more).collect()}
    assert ids() == {"ok"} and ids(table="b") == {"bad"} and ids(table="a") == {"ok"}


def test_a_stored_scorecard_gives_the_same_scores_and_area(spark, tmp_path):
    chance = random.Random(2)
    features = ["a.x", "a.y"]
    rows = [(f"p{i}", float(chance.random() < 0.3), chance.choice([-1.0, 0.0, 0.5]), chance.choice([0.0, 1.0])) for i in range(400)]
    rows = [(p, float(chance.random() < 0.2 + 0.3 * (x < 0)), x, y) for p, _, x, y in rows] + [("q", None, 0.5, 1.0)]
    wide = spark.createDataFrame(rows, "prediction_id string, label double, woe_a_x double, woe_a_y double")
    model = scorecard.fit_scorecard(wide, features)
    path = str(tmp_path / "model")
    model.write().save(path)
    scored = scorecard.score_snapshot(wide, path, "m1")
    direct = {r.prediction_id: float(r.probability[1]) for r in model.transform(wide).collect()}
    assert {r.prediction_id: r.score for r in scored.collect()} == direct and len(direct) == 401
    ours = monitor.ks_auc_lift(scored.select("label", "score")).first()["auc"]
    assert ours == pytest.approx(scorecard.evaluator_auc(scored), abs=1e-9) and ours > 0.55


def test_wide_weights(spark):
    values = spark.createDataFrame([("p", "a.x", 1.0), ("p", "a.y", None), ("q", "a.x", 9.0), ("p", "b", 1.0)], "prediction_id string, feature_id string, feature_value double")
    rules = spark.createDataFrame([("a.x", 0, 2.0, 0.5), ("a.x", 1, 5.0, -0.5)], "feature_id string, bin int, upper double, woe double")
    got = {r[0]: tuple(r[1:]) for r in scorecard.woe_wide(values, rules, ["a.x", "a.y"]).collect()}
    assert got == {"p": (0.5, 0.0), "q": (-0.5, 0.0)}


def test_audit_of_each_batch(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "id long, v double"
    listener = audit.AuditListener(spark, log)
    assert audit.audit_rows(spark, log).count() == 0
    spark.streams.addListener(listener)
    try:
        for rows in ([(1, None), (2, 1.0)], [(3, -1.0), (None, -2.0), (5, None)]):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            stream = audit.audited(spark.readStream.schema(schema).parquet(source), "in", ["id", "v"], {"negative": F.col("v") < 0})
            stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        until = time.monotonic() + 60
        while audit.audit_rows(spark, log).count() < 8 and time.monotonic() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = {(r.batch, r.metric): r.value for r in audit.audit_rows(spark, log).collect()}
    assert got == {(0, "rows"): 2, (0, "null:id"): 0, (0, "null:v"): 1, (0, "breaks:negative"): 0,
                   (1, "rows"): 3, (1, "null:id"): 1, (1, "null:v"): 1, (1, "breaks:negative"): 2}


def test_an_open_window_is_returned_and_replaced(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "w")
    seen = []
    for n in (1, 2):
        spark.sql(f"select timestamp'2024-01-01T00:10:00Z' as event_time, 'k' as key from range({n})").coalesce(1).write.mode("append").parquet(source)
        stream = flow.with_event_time(spark.readStream.schema("event_time timestamp, key string").parquet(source))
        flow.upsert_windows(flow.windowed(stream, "key", [F.count(F.lit(1)).alias("rows")], size="1 hour"), path).awaitTermination()
        seen.append([r.rows for r in flow.current_windows(spark, path, ["key"]).collect()])
    assert seen == [[1], [3]]
