"""Rules and scores from a column per feature: no value row is ordered or moved by its prediction."""

from __future__ import annotations

import hashlib
import random

import pytest
from brute import woe as brute_woe
from pyspark.sql import functions as F

from tidemark.operators import ranks, woe
from tidemark.operators.features import to_long
from tidemark.operators.monitor import batch_score, batch_score_wide, batch_scores_by_view

FEATURES = ["a.ties", "a.smooth", "a.same", "b.few", "b.none"]


def sha(i: int) -> str:
    return hashlib.sha256(str(i).encode()).hexdigest()


@pytest.fixture(scope="module")
def wide_rows():
    """Few distinct values with gaps, many with NaN and a negative zero, a single one, too few, none."""
    rng = random.Random(8)
    rows = []
    for i in range(607):
        label = float(rng.random() < 0.3) if i % 50 else None
        smooth = float("nan") if i % 101 == 0 else -0.0 if i % 37 == 0 else 0.0 if i % 41 == 0 else rng.gauss(label or 0.0, 1)
        ties = float(rng.choice([0, 0, 0, 1, 2])) if i % 7 else None
        rows.append((sha(i), "train" if i % 5 else "oot", label, ties, smooth, 3.0, 1.0 if i < 8 else None, None))
    return rows


@pytest.fixture(scope="module")
def wide(spark, wide_rows):
    columns = ", ".join(f"`{f}` double" for f in FEATURES)
    df = spark.createDataFrame(wide_rows, f"prediction_id string, split string, label double, {columns}").repartition(5)
    return woe.placed_points(df)


def fitted(rules):
    return {(r.feature_id, r.bin): (r.good, r.bad, r.lower, r.upper, r.woe) for r in rules.collect()}


@pytest.mark.parametrize("bits", [0, 2, 13])
def test_wide_fit_equals_definition(wide, wide_rows, bits, monkeypatch):
    """Whatever the blocks in which equal values are counted."""
    monkeypatch.setattr(woe, "BLOCK_BITS", bits)
    got = fitted(woe.fit_woe_wide(wide, FEATURES))
    want = {}
    for n, feature in enumerate(FEATURES):
        if feature == "a.smooth":  # Python does not order NaN
            continue
        members = [(r[3 + n], r[0], r[2]) for r in wide_rows if r[1] == "train"]
        want.update({(feature, b): rule for b, rule in brute_woe(members).items()})
    assert {k for k in got if k[0] != "a.smooth"} == set(want) and {k[0] for k in got} == {"a.ties", "a.smooth", "a.same"}
    for key, (good, bad, weight, _, lower, upper) in want.items():
        assert got[key][:4] == (good, bad, lower, upper) and got[key][4] == pytest.approx(weight)


def test_wide_and_long_fit_agree_with_ranks(wide):
    """Counts of the bins are those of all rows in order, NaN last and zeros equal."""
    train = wide.where("split = 'train'")
    rows = to_long(train, ["prediction_id", "label"], FEATURES)
    binned = ranks.equal_count_bins(rows, ["feature_id"], "feature_value", "prediction_id")
    counted = binned.where("feature_id in ('a.ties', 'a.smooth', 'a.same')").groupBy(
        "feature_id", F.coalesce("bin", F.lit(-1)).alias("bin")).agg(F.count_if(F.col("label") == 0).alias("good"), F.count_if(F.col("label") == 1).alias("bad"))
    want = {(r.feature_id, r.bin): (r.good, r.bad) for r in counted.collect()}
    by_column, by_row = fitted(woe.fit_woe_wide(wide, FEATURES)), fitted(woe.fit_woe(to_long(wide, ["prediction_id"], FEATURES), wide.drop("_place", "_slot")))
    assert {k: v[:2] for k, v in by_column.items()} == want == {k: v[:2] for k, v in by_row.items()}
    assert {k: repr(v[2:]) for k, v in by_column.items()} == {k: repr(v[2:]) for k, v in by_row.items()}


def test_values_are_counted_before_they_are_ordered(wide, monkeypatch):
    """Rows that are ordered: one per prediction, and one per feature and distinct value."""
    ordered = []
    plain = ranks.settle
    monkeypatch.setattr(ranks, "settle", lambda df, name: ordered.append(df.count()) or plain(df, name) if name == "ordered" else plain(df, name))
    few = [f for f in FEATURES if f != "a.smooth"]
    woe.fit_woe(to_long(wide, ["prediction_id"], few), wide.drop("_place", "_slot")).collect()
    assert ordered == [wide.where("split = 'train'").count(), 8]


def test_wide_scores_are_those_of_rows(spark, wide):
    """Values on, between and above the bounds, NaN, gaps with and without a missing bin, features without rule."""
    rules = woe.fit_woe_wide(wide, FEATURES)
    columns = ", ".join(f"`{f}` double" for f in FEATURES)
    cases = [(0.0, 0.0, 3.0, 1.0, None), (2.0, float("nan"), 4.0, None, 1.0), (None, None, None, None, None), (9.0, 1e9, -1e9, 2.0, 2.0), (1.0, -0.0, 2.9, 1.0, 0.0)]
    more = spark.createDataFrame([(f"c{i}", *c) for i, c in enumerate(cases)] + [("twice", *cases[0])] * 2 + [(None, *cases[3])], f"prediction_id string, {columns}")
    both = wide.select(more.columns[0], *[F.col(f"`{f}`") for f in FEATURES]).unionByName(more)
    rows = to_long(both, ["prediction_id"], FEATURES)
    for own in (FEATURES, ["a.same", "b.few"], ["b.few"]):
        want = {r.prediction_id: (r.score, r.features) for r in batch_score(rows, rules, own).collect()}
        got = {r.prediction_id: (r.score, r.features) for r in batch_score_wide(both, rules, own).collect()}
        assert set(got) == set(want) and len(got) == (0 if own == ["b.few"] else 614)
        for key, (score, features) in want.items():
            assert got[key][0] == pytest.approx(score, abs=1e-12) and got[key][1] == features
    views = batch_scores_by_view(both, rules, {"all": FEATURES, "some": ["a.same", "b.few"], "none": ["b.few"]})
    by_view = {(r.view, r.prediction_id): r.score for r in views.collect()}
    assert {k[0] for k in by_view} == {"all", "some"} and len(by_view) == 2 * 614
    for r in batch_score(rows, rules, ["a.same"]).collect():
        assert by_view["some", r.prediction_id] == pytest.approx(r.score, abs=1e-12)


def test_scores_without_rules(wide):
    rules = woe.fit_woe_wide(wide, FEATURES).where("false")
    assert batch_score_wide(wide, rules, FEATURES).count() == 0
