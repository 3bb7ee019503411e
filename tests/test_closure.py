"""Feature closure against a count in plain Python."""

from __future__ import annotations

from collections import Counter

from tidemark.operators.quality import check_feature_closure


def breaches(values, catalog, points):
    pairs, declared = Counter(values), set(catalog)
    found = [("duplicate_pair", p, f, n) for (p, f), n in pairs.items() if n > 1]
    totals, per_prediction = Counter(f for _, f in values), Counter(p for p, _ in values)
    found += [("unknown_feature", None, f, n) for f, n in totals.items() if f not in declared]
    found += [("absent_feature", None, f, 0) for f in declared if f not in totals]
    had = Counter(p for p, f in pairs if f in declared)
    found += [("incomplete_prediction", p, None, had[p]) for p in set(points) if had[p] < len(declared)]
    return found + [("unknown_prediction", p, None, n) for p, n in per_prediction.items() if p not in points]


def test_every_breach(spark):
    cases = [
        [("a", "x"), ("a", "y"), ("a", "z"), ("b", "x"), ("b", "x"), ("b", "q"), ("b", "q"), ("c", None), ("stray", "x")],
        [("a", "x"), ("a", "y")], [], [("a", "x"), ("a", "y"), ("a", "z"), ("b", "x"), ("b", "y"), ("b", "z"), ("c", "x"), ("c", "y"), ("c", "z")],
    ]
    points = spark.createDataFrame([("a",), ("b",), ("c",)], "prediction_id string")
    catalog = spark.createDataFrame([("x",), ("y",), ("z",)], "feature_id string")
    for rows in cases:
        got = check_feature_closure(spark.createDataFrame(rows, "prediction_id string, feature_id string"), catalog, points)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(breaches(rows, "xyz", "abc"), key=repr), rows


def test_a_feature_declared_twice_hides_nothing(spark):
    """A prediction without y is incomplete, though the catalog names x twice; the y that is absent is named once."""
    values = spark.createDataFrame([("a", "x")], "prediction_id string, feature_id string")
    catalog = spark.createDataFrame([("x",), ("x",), ("y",)], "feature_id string")
    points = spark.createDataFrame([("a",)], "prediction_id string")
    got = {tuple(r) for r in check_feature_closure(values, catalog, points).collect()}
    assert got == {("incomplete_prediction", "a", None, 1), ("absent_feature", None, "y", 0)}


def test_values_are_not_counted_by_pair(spark):
    """What is written between holds a row per prediction, so that no task keeps a pair per value."""
    values = spark.range(4000).selectExpr("string(id % 200) AS prediction_id", "concat('f', id div 200) AS feature_id")
    catalog = spark.createDataFrame([(f"f{i}",) for i in range(20)], "feature_id string")
    points = spark.range(200).selectExpr("string(id) AS prediction_id")
    found = check_feature_closure(values, catalog, points)
    assert found.count() == 0
    assert max(spark.read.parquet(f).count() for f in {f.rsplit("/", 1)[0] for f in found.inputFiles()}) == 200
