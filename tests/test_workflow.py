from __future__ import annotations

import shutil

import pytest
from brute import features as brute_features
from brute import woe as brute_woe
from conftest import applicants, months, records, write_csv
from pyspark.sql import functions as F

from tidemark.operators.catalog import FEATURE_IDS, feature_catalog
from tidemark.operators.quality import check_feature_closure
from tidemark.plans import workflow
from tidemark.settings import BRONZE_COLUMNS, MANIFEST
from tidemark.sources.raw_csv import ContractError
from tidemark.sources.tables import FAILURE_SCHEMA, RECEIPT_SCHEMA, check_table_contract, read_snapshot


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory, credit_files):
    layers = workflow.Layers(str(tmp_path_factory.mktemp("layers")), "e2e")
    manifest = workflow.populate_manifest(spark, str(credit_files)).cache()
    sha = workflow.run_all(spark, layers, str(credit_files), manifest, "run-1")
    return layers, manifest, sha


def values(spark, layers, sha):
    return read_snapshot(spark, layers.name("features", "feature_values"), sha)


def points(spark, layers, sha):
    return read_snapshot(spark, layers.name("points", "prediction_points"), sha)


def test_counts(spark, done):
    layers, _, sha = done
    assert points(spark, layers, sha).count() == 30
    found = values(spark, layers, sha)
    assert found.count() == 600
    wanted = points(spark, layers, sha)
    assert check_feature_closure(found, feature_catalog(spark), wanted).count() == 0
    one = wanted.select("prediction_id").first()[0]
    lost = check_feature_closure(found.where(F.col("prediction_id") != one), feature_catalog(spark), wanted).collect()
    assert [(r.breach, r.prediction_id, r.rows) for r in lost] == [("incomplete_prediction", one, 0)]


def test_every_value_equals_the_definition(spark, done, credit_rows):
    layers, _, sha = done
    want = brute_features(*credit_rows)
    rows = values(spark, layers, sha).collect()
    assert {r.feature_id for r in rows} == set(FEATURE_IDS)
    for r in rows:
        expected = want[int(r.entity_id.split(":")[1])][r.feature_id]
        if expected is None:
            assert r.feature_value is None, r
        else:
            places = 6 if r.feature_id == "app.age_years" else 12
            assert r.feature_value == pytest.approx(expected, abs=10 ** -places, rel=1e-12), r


def test_rules_equal_the_definition(spark, done):
    layers, _, sha = done
    labels = {p.prediction_id: p.label for p in points(spark, layers, sha).where("split = 'train'").collect()}
    rows: dict[str, list] = {f: [] for f in FEATURE_IDS}
    for v in values(spark, layers, sha).collect():
        if v.prediction_id in labels:
            rows[v.feature_id].append((v.feature_value, v.prediction_id, labels[v.prediction_id]))
    want = {(f, b): rule for f, members in rows.items() for b, rule in brute_woe(members).items()}
    rules = read_snapshot(spark, layers.name("rules", "woe_rules"), sha).collect()
    assert {(r.feature_id, r.bin) for r in rules} == set(want)
    for r in rules:
        good, bad, weight, iv, lower, upper = want[r.feature_id, r.bin]
        assert (r.good, r.bad, r.lower, r.upper) == (good, bad, lower, upper)
        assert (r.woe, r.iv) == pytest.approx((weight, iv))


def test_bronze_keeps_text_and_lineage(spark, done, credit_rows):
    layers, _, sha = done
    bronze = read_snapshot(spark, layers.name("bronze", "application_train"), sha)
    assert bronze.count() == len(credit_rows[0])
    assert set(BRONZE_COLUMNS) <= set(bronze.columns)
    assert dict(bronze.dtypes)["AMT_CREDIT"] == "string"
    assert bronze.where("EXT_SOURCE_1 IS NULL").count() == sum(r["EXT_SOURCE_1"] == "" for r in credit_rows[0])


def test_silver_is_typed_and_enriched(spark, done):
    layers, _, sha = done
    balance = read_snapshot(spark, layers.name("silver", "bureau_balance"), sha)
    assert dict(balance.dtypes)["SK_ID_CURR"] == "int"
    assert balance.where("SK_ID_CURR IS NULL").isEmpty()


def test_receipts(spark, done):
    layers, _, sha = done
    receipts = spark.read.schema(RECEIPT_SCHEMA).parquet(layers.receipts).where(F.col("manifest_sha256") == sha)
    rows = {r.table.split(".")[1]: r for r in receipts.where("run_id = 'run-1' and stage = 'bronze'").collect()}
    assert set(rows) == {"application_train", "bureau", "bureau_balance"}
    assert all(r.status == "COMPLETE" and r.growth == 0 and len(r.digest) == 64 for r in rows.values())
    assert receipts.where("run_id = 'run-1'").count() == 9


def test_rerun_changes_nothing_and_a_second_manifest_coexists(spark, done, credit_files, tmp_path):
    layers, manifest, sha = done
    before = sorted(values(spark, layers, sha).collect())
    assert workflow.run_all(spark, layers, str(credit_files), manifest, "run-2") == sha
    assert sorted(values(spark, layers, sha).collect()) == before

    apps = applicants(12)
    loans = records(apps)
    for name, rows in zip(("application_train.csv", "bureau.csv", "bureau_balance.csv"), (apps, loans, months(loans))):
        write_csv(tmp_path, name, rows)
    other = workflow.run_all(spark, layers, str(tmp_path), workflow.populate_manifest(spark, str(tmp_path)), "run-3")
    assert other != sha
    assert values(spark, layers, other).count() == 240
    assert sorted(values(spark, layers, sha).collect()) == before


def test_changed_file_is_refused_and_logged(spark, done, credit_files, tmp_path):
    _, manifest, _ = done
    layers = workflow.Layers(str(tmp_path / "layers"), "refused")
    folder = tmp_path / "csv"
    shutil.copytree(credit_files, folder)
    with open(folder / "bureau.csv", "a") as f:
        f.write("1,2,3,Active,4,5,6,7\n")
    with pytest.raises(ContractError, match="bureau.csv"):
        workflow.ingest_bronze(spark, layers, str(folder), manifest, "run-x")
    assert spark.read.schema(FAILURE_SCHEMA).parquet(layers.failures).first().stage == "bronze"


def test_duplicate_key_stops_silver(spark, tmp_path):
    apps = applicants(8)
    loans = records(apps)
    for name, rows in zip(("application_train.csv", "bureau.csv", "bureau_balance.csv"), (apps + apps[:1], loans, months(loans))):
        write_csv(tmp_path, name, rows)
    layers = workflow.Layers(str(tmp_path / "layers"), "dup")
    manifest = workflow.populate_manifest(spark, str(tmp_path))
    sha = workflow.manifest_sha(manifest)
    workflow.ingest_bronze(spark, layers, str(tmp_path), manifest, "run-d")
    with pytest.raises(ContractError, match="duplicate keys"):
        workflow.ingest_silver(spark, layers, sha, "run-d")
    failure = spark.read.schema(FAILURE_SCHEMA).parquet(layers.failures).first()
    assert (failure.failed_table, failure.completed_tables) == ("application_train", [])
    with pytest.raises(ContractError, match="not COMPLETE"):
        workflow.generate_points(spark, layers, sha, "run-d")


def test_table_contract_sees_drift(spark, done):
    layers, _, _ = done
    name = layers.name("silver", "bureau")
    schema = spark.table(name).schema
    check_table_contract(spark, name, schema, MANIFEST, {"layer": "silver"})
    with pytest.raises(ContractError, match="property"):
        check_table_contract(spark, name, schema, MANIFEST, {"layer": "gold"})
    wider = spark.table(name).withColumn("x", F.lit(1)).schema
    with pytest.raises(ContractError, match="columns"):
        check_table_contract(spark, name, wider)
