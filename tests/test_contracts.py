from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts
from tidemark.operators.catalog import FEATURE_IDS, feature_catalog, feature_specs, group_mapping
from tidemark.sources.topics import source_topics, topics

EVENT = {
    "dataset_id": "d", "event_id": None, "entity_type": "customer", "entity_id": "e", "customer_id": "c",
    "event_type": "loan_application", "event_time": "2000-01-01T00:00:00Z", "available_at": "2000-01-01T01:00:00+01:00",
    "ingested_at": "2000-01-02 00:00:00+0000", "source_system": "s", "schema_version": 1, "source_record_id": "r",
    "source_record_revision": "", "payload_sha256": None, "headers": {"a": "b"},
}
EVENT_SCHEMA = ", ".join(
    f"{k} {'int' if k == 'schema_version' else 'map<string,string>' if k == 'headers' else 'string'}" for k in EVENT
)


def events(spark, **changes):
    rows = [{**EVENT, **changes}]
    df = spark.createDataFrame(rows, EVENT_SCHEMA)
    if "event_id" not in changes:
        df = contracts.with_times(df, ["event_time"]).withColumn("event_id", F.coalesce(contracts.expected_event_id(), F.lit("x")))
    return contracts.validate_events(df)


def fields(quarantine):
    return {e.field for r in quarantine.collect() for e in r.errors}


def test_good_event(spark):
    valid, bad = events(spark)
    assert (valid.count(), bad.count()) == (1, 0)


@pytest.mark.parametrize("changes,field", [
    ({"dataset_id": " "}, "dataset_id"), ({"customer_id": None}, "customer_id"), ({"entity_type": "loan"}, "entity_type"),
    ({"event_type": None}, "event_type"), ({"event_time": "2000-01-01T00:00:00"}, "event_time"), ({"ingested_at": "now"}, "ingested_at"),
    ({"available_at": "1999-12-31T00:00:00Z"}, "event_time"), ({"schema_version": 0}, "schema_version"),
    ({"payload_sha256": "a" * 63}, "payload_sha256"), ({"payload_sha256": "a" * 64 + "\n"}, "payload_sha256"),
    ({"source_record_id": " "}, "source_record_id"), ({"headers": {"a": None}}, "headers"), ({"event_id": "0" * 64}, "event_id"),
])
def test_bad_event(spark, changes, field):
    valid, bad = events(spark, **changes)
    assert valid.count() == 0
    assert field in fields(bad)


def test_all_errors_of_a_row_are_kept_and_hash_is_lowered(spark):
    _, bad = events(spark, dataset_id="", entity_type="x", schema_version=-1)
    assert {"dataset_id", "entity_type", "schema_version"} <= fields(bad)
    valid, _ = events(spark, payload_sha256="AB" * 32)
    assert valid.first().payload_sha256 == "ab" * 32


def test_filter_stays_above_the_rules(spark):
    valid, _ = events(spark)
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter (size(errors") < plan.index("Generate inline")


def test_own_catalog_is_closed(spark):
    catalog = feature_catalog(spark)
    assert contracts.validate_catalog(catalog)[1].isEmpty()
    assert contracts.publishable(catalog)[1].isEmpty()
    assert contracts.catalog_closure(catalog, group_mapping(spark)).isEmpty()
    assert contracts.spec_closure(catalog, feature_specs(spark)).isEmpty()
    assert [len([f for f in FEATURE_IDS if f.startswith(p)]) for p in ("app.", "bureau.", "bureau_balance.")] == [8, 8, 4]
    empty = contracts.catalog_closure(catalog.where("false"), group_mapping(spark).where("false"))
    assert [r.message for r in empty.collect()] == ["the catalog is empty"]


def test_label_columns():
    assert contracts.label_columns_agree(None, None) and contracts.label_columns_agree("y", "t")
    assert not contracts.label_columns_agree("y", None)


def errors(spark, kind, **payload):
    df = spark.createDataFrame([(json.dumps(payload),)], "payload string")
    _, bad = contracts.validate_payloads(df, kind)
    return {(e.field, e.message) for r in bad.collect() for e in r.errors}


@pytest.mark.parametrize("kind,payload,want", [
    ("application_upsert", {"SK_ID_CURR": 1}, set()),
    ("application_upsert", {}, {("SK_ID_CURR", "is required")}),
    ("application_upsert", {"SK_ID_CURR": "1"}, {("SK_ID_CURR", "must be a whole number")}),
    ("application_upsert", {"SK_ID_CURR": True}, {("SK_ID_CURR", "must be a whole number")}),
    ("application_upsert", {"SK_ID_CURR": 1.5}, {("SK_ID_CURR", "must be a whole number")}),
    ("application_upsert", {"SK_ID_CURR": 1, "AMT_CREDIT": True}, {("AMT_CREDIT", "must be a number")}),
    ("application_upsert", {"SK_ID_CURR": 1, "AMT_CREDIT": 3, "DAYS_BIRTH": None, "EXT_SOURCE_1": 0.25}, set()),
    ("application_upsert", {"SK_ID_CURR": 1, "FLAG_DOCUMENT_2": 2, "FLAG_DOCUMENT_3": True, "FLAG_DOCUMENT_4": 1, "FLAG_DOCUMENT_5": None},
     {("FLAG_DOCUMENT_2", "must be 0 or 1"), ("FLAG_DOCUMENT_3", "must be 0 or 1")}),
    ("application_upsert", {"SK_ID_CURR": 1, "colour": 1}, {("payload", "has unknown fields")}),
    ("bureau_upsert", {"SK_ID_CURR": 1, "SK_ID_BUREAU": 2, "CREDIT_ACTIVE": "Active", "AMT_CREDIT_SUM": 1e9}, set()),
    ("bureau_upsert", {"SK_ID_CURR": 1, "SK_ID_BUREAU": 2, "CREDIT_ACTIVE": "Sold"}, {("CREDIT_ACTIVE", "unknown word")}),
    ("bureau_balance_upsert", {"SK_ID_CURR": 1, "SK_ID_BUREAU": 2, "MONTHS_BALANCE": "bad", "STATUS": 1},
     {("MONTHS_BALANCE", "must be a whole number"), ("STATUS", "unknown word")}),
])
def test_payloads(spark, kind, payload, want):
    assert errors(spark, kind, **payload) == want


def test_wider_words_for_batch_like_streams(spark):
    df = spark.createDataFrame([('{"SK_ID_CURR":1,"SK_ID_BUREAU":2,"CREDIT_ACTIVE":"Sold"}',)], "payload string")
    valid, _ = contracts.validate_payloads(df, "bureau_upsert", words={**contracts.TEXT_WORDS, "CREDIT_ACTIVE": ["Active", "Closed", "Sold"]})
    assert valid.count() == 1


def updates(spark, **changes):
    row = {
        "entity_id": "SK_ID_CURR:1", "feature_id": FEATURE_IDS[0], "feature_value": 0.1, "feature_version": 1,
        "event_time": "2000-01-01T12:00:00Z", "computed_at": "2000-01-01T12:00:01Z", "source_event_id": "sha256:" + "b" * 64,
        "source_topic": source_topics()[0], "computation_mode": "stream", "quality_status": "VALID",
    } | changes
    types = {"feature_value": "double", "feature_version": "int"}
    df = spark.createDataFrame([row], ", ".join(f"{k} {types.get(k, 'string')}" for k in row))
    timed = contracts.with_times(df, ["event_time", "computed_at"])
    c = F.col
    own = contracts.feature_update_id(c("entity_id"), c("feature_id"), c("feature_version"), c("event_time"), c("feature_value"))
    if "feature_update_id" not in changes:
        timed = timed.withColumn("feature_update_id", F.coalesce(own, F.lit("sha256:" + "0" * 64)))
    return contracts.validate_updates(timed, source_topics())


@pytest.mark.parametrize("changes,field", [
    ({}, None), ({"feature_value": None}, None), ({"entity_id": "SK_ID_CURR:1\n"}, "entity_id"), ({"feature_id": "x"}, "feature_id"),
    ({"feature_version": 0}, "feature_version"), ({"computed_at": "1999-01-01T00:00:00Z"}, "computed_at"),
    ({"source_event_id": "b" * 64}, "source_event_id"), ({"source_topic": topics()["dlq"].name}, "source_topic"),
    ({"feature_value": math.inf}, "feature_value"), ({"feature_update_id": "sha256:" + "c" * 64}, "feature_update_id"),
    ({"quality_status": "MAYBE"}, "quality_status"),
])
def test_updates(spark, changes, field):
    valid, bad = updates(spark, **changes)
    assert valid.count() == (field is None)
    assert field is None or field in fields(bad)


def test_topics():
    named = topics()
    assert len(named) == 5 and {t.partitions for t in named.values()} == {3}
    assert named["feature_updates"].cleanup == ("compact", "delete")
    assert named["dlq"].name not in source_topics()


def test_document_eligibility(spark):
    base = ("SK_ID_CURR:1", "verified", "s", "v", "u", "2000-01-01T00:00:00Z")
    rows = [base, (" ", *base[1:]), (base[0], "synthetic", *base[2:]), (base[0], "unlinked", *base[2:]), (*base[:3], "", *base[4:]), (*base[:5], None)]
    df = spark.createDataFrame(rows, "entity_id string, linkage_status string, linkage_source string, linkage_version string, "
                                     "linkage_evidence_uri string, linked_at string")
    assert contracts.document_eligible(df).count() == 1
    assert contracts.document_eligible(df, allow_synthetic=True).count() == 2
