from __future__ import annotations

import hashlib
import math
import random

import pytest
from brute import woe as brute_woe
from pyspark.sql import functions as F

from tidemark.operators.monitor import batch_score, feature_view, key_skew, ks_auc_lift, psi
from tidemark.operators.catalog import feature_catalog
from tidemark.operators.ranks import equal_count_bins, global_ranks, running_sums
from tidemark.operators.woe import apply_woe, check_training_closure, entropy, fit_mean_split, fit_woe, woe_summary


def sha(i: int) -> str:
    return hashlib.sha256(str(i).encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows share one key, and half of those one value."""
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        key = "hot" if i % 2 else f"k{i % 14}"
        rows.append((key, 7.0 if rng.random() < 0.5 else rng.random() * 20, sha(i), i))
    df = spark.createDataFrame(rows, "k string, v double, tie string, n long").repartition(9)
    return rows, df


def test_global_ranks_are_exact_under_skew(skewed):
    rows, df = skewed
    want = {}
    for key in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        want.update({r[3]: (i + 1, len(members)) for i, r in enumerate(members)})
    got = {r.n: (r.rank, r.group_rows) for r in global_ranks(df, ["k"], [F.col("v"), F.col("tie")]).collect()}
    assert got == want


def test_running_sums_are_exact_under_skew(skewed):
    rows, df = skewed
    got = {r.n: (r.below_n2, r.total_n2) for r in running_sums(
        df.withColumn("n2", F.col("n") * 2), ["k"], [F.desc("v"), F.col("tie")], ["n2"]).collect()}
    for key in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        below, all_ = 0, sum(2 * r[3] for r in members)
        for r in members:
            assert got[r[3]] == (below, all_)
            below += 2 * r[3]


@pytest.mark.parametrize("rows,want", [(10, [2, 2, 2, 4]), (8, [2, 2, 2, 2]), (3, [1, 1, 1]), (1, [1])])
def test_last_bin_takes_the_remainder(spark, rows, want):
    df = spark.createDataFrame([("k", float(i), sha(i)) for i in range(rows)], "k string, v double, t string")
    got = equal_count_bins(df, ["k"], "v", "t").groupBy("bin").count().orderBy("bin").collect()
    assert [r["count"] for r in got] == want


def woe_input(spark, seed=3):
    """Features with ties at bin edges, gaps, too few values, and only one class."""
    rng = random.Random(seed)
    points, values = [], []
    for i in range(403):
        label = float(rng.random() < 0.3)
        points.append((sha(i), f"SK_ID_CURR:{i}", "train" if i % 5 else "oot", label))
        values.append((sha(i), f"SK_ID_CURR:{i}", "ties", float(rng.choice([0, 0, 0, 1, 2])) if i % 7 else None))
        values.append((sha(i), f"SK_ID_CURR:{i}", "smooth", rng.gauss(label, 1)))
        if i % 5 and i < 12:
            values.append((sha(i), f"SK_ID_CURR:{i}", "few", 1.0 if i < 8 else None))
        if label == 0:
            values.append((sha(i), f"SK_ID_CURR:{i}", "one_class", rng.random()))
    p = spark.createDataFrame(points, "prediction_id string, entity_id string, split string, label double")
    v = spark.createDataFrame(values, "prediction_id string, entity_id string, feature_id string, feature_value double")
    return points, values, p, v


@pytest.fixture(scope="module")
def fitted(spark):
    points, values, p, v = woe_input(spark)
    return points, values, p, v, fit_woe(v, p).cache()


def test_fit_equals_definition(fitted):
    points, values, _, _, rules = fitted
    train = {x[0]: x[3] for x in points if x[2] == "train"}
    want = {}
    for feature in ("ties", "smooth", "few", "one_class"):
        members = [(x[3], x[0], train[x[0]]) for x in values if x[2] == feature and x[0] in train]
        want.update({(feature, b): rule for b, rule in brute_woe(members).items()})
    got = {(r.feature_id, r.bin): r for r in rules.collect()}
    assert set(got) == set(want) and {k[0] for k in got} == {"ties", "smooth"}
    for key, (good, bad, weight, iv, lower, upper) in want.items():
        r = got[key]
        assert (r.good, r.bad, r.lower, r.upper) == (good, bad, lower, upper)
        assert (r.woe, r.iv) == pytest.approx((weight, iv))
    assert check_training_closure(rules, fitted[2]).isEmpty()
    total = {r.feature_id: r.total_iv for r in woe_summary(rules).collect()}
    assert total["ties"] == pytest.approx(sum(r[3] for k, r in want.items() if k[0] == "ties"))


def test_lost_and_doubled_training_rows_are_found(spark, fitted):
    points, _, p, v, _ = fitted
    n = sum(x[2] == "train" for x in points)
    lost = v.where(~((F.col("feature_id") == "ties") & F.col("entity_id").isin("SK_ID_CURR:1", "SK_ID_CURR:2")))
    twice = lost.unionByName(v.where("feature_id = 'smooth' AND entity_id = 'SK_ID_CURR:3'"))
    found = {r.feature_id: (r.binned_rows, r.training_rows) for r in check_training_closure(fit_woe(twice, p), p).collect()}
    assert found == {"ties": (n - 2, n), "smooth": (n + 1, n)}


def test_consistent_weight_of_the_missing_bin(fitted):
    _, _, p, v, _ = fitted
    row = fit_woe(v.where("feature_id = 'ties'"), p, consistent_woe=True).where("bin = -1").first()
    assert row.woe == pytest.approx(math.log(row.good_distribution / row.bad_distribution))


def test_apply_uses_frozen_bounds(spark, fitted):
    *_, rules = fitted
    smooth = {r.bin: r for r in rules.where("feature_id = 'smooth'").collect()}
    cases = [(-1e9, 0), (smooth[0].upper, 0), (smooth[0].upper + 1e-9, 1), (smooth[3].upper, 3), (1e9, 3), (None, -1)]
    df = spark.createDataFrame([(str(i), "smooth", x[0]) for i, x in enumerate(cases)], "prediction_id string, feature_id string, feature_value double")
    got = {r.prediction_id: r for r in apply_woe(df, rules).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[str(i)].bin == want
        assert got[str(i)].woe == (0.0 if want == -1 else smooth[want].woe)
    other = spark.createDataFrame([("a", "unruled", 1.0)], df.schema)
    assert apply_woe(other, rules).first().bin is None


def test_mean_split(fitted):
    points, values, p, v, _ = fitted
    train = {x[0] for x in points if x[2] == "train"}
    got = {r.feature_id: r for r in fit_mean_split(v, p).collect()}
    for feature, row in got.items():
        known = [x[3] for x in values if x[2] == feature and x[0] in train and x[3] is not None]
        assert row.train_sample_count == len(known) >= 2
        assert row.bin_boundary == pytest.approx(sum(known) / len(known))


def test_entropy(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (3, 1), (5, 0)], "a int, b int")
    got = [r[0] for r in df.select(entropy(["a", "b"])).collect()]
    assert got == pytest.approx([1.0, 0.0, -(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25)), 0.0])


def test_ks_auc_against_all_pairs(spark):
    rng = random.Random(11)
    rows = [(round(rng.gauss(0.5 * y, 1), 1), float(y)) for y in (int(rng.random() < 0.4) for _ in range(300))]
    got = ks_auc_lift(spark.createDataFrame(rows, "score double, label double").repartition(5)).first()
    goods, bads = [s for s, y in rows if y == 0], [s for s, y in rows if y == 1]
    auc = sum((b > g) + 0.5 * (b == g) for b in bads for g in goods) / (len(goods) * len(bads))
    ks = max(abs(sum(g <= t for g in goods) / len(goods) - sum(b <= t for b in bads) / len(bads)) for t in {s for s, _ in rows})
    assert (got.auc, got.ks) == pytest.approx((auc, ks))
    assert got.lift > 1


def test_psi_is_zero_between_equal_splits(spark, fitted):
    _, _, p, v, rules = fitted
    same = p.withColumn("split", F.explode(F.array(F.lit("train"), F.lit("again"))))
    assert all(r.psi == pytest.approx(0) for r in psi(v, same, rules).collect())
    assert all(r.psi > 0 for r in psi(v, p, rules).collect())


def test_scores_rank_risk(fitted):
    _, _, p, v, rules = fitted
    scored = batch_score(v, rules).join(p, "prediction_id")
    assert ks_auc_lift(scored).first().auc > 0.6


def test_views(spark):
    catalog = feature_catalog(spark).where("feature_id in ('app.age_years', 'bureau.record_count', 'app.ext_source_mean')")
    catalog = catalog.withColumn("stage", F.when(F.col("feature_id") == "app.age_years", "post_outcome").otherwise(F.col("stage")))
    catalog = catalog.withColumn("owner", F.when(F.col("feature_id") == "bureau.record_count", " ").otherwise("me"))
    values = spark.createDataFrame([("p", "e", f, 1.0) for f in ("app.age_years", "bureau.record_count", "app.ext_source_mean", "x")],
                                   "prediction_id string, entity_id string, feature_id string, feature_value double")
    sizes = {m: feature_view(values, catalog, m).count() for m in ("full", "strict", "governed")}
    assert sizes == {"full": 3, "strict": 2, "governed": 1}
    wide = feature_view(values, catalog, "strict", ["bureau.record_count", "app.ext_source_mean"])
    assert wide.first()["bureau.record_count"] == 1.0


def test_key_skew(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "k string")
    assert [tuple(r) for r in key_skew(df, ["k"], 1).collect()] == [("a", 6, 0.75)]
