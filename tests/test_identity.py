from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import identity as ids
from tidemark.functions.canonical import payload_text, value_text
from tidemark.operators.points import build_points
from tidemark.settings import MANIFEST, Boundary


def values(spark, rows, schema, **columns):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select("*", *[c.alias(k) for k, c in columns.items()]).collect()]


def test_golden_splits_and_prediction_id(spark):
    b = Boundary()
    apps = spark.createDataFrame([(k, "0") for k in ("100001", "100002", "100008", "100050")], "SK_ID_CURR string, TARGET string")
    points = build_points(apps.withColumn(MANIFEST, F.lit("m")), snapshot=F.lit("snap-20260723-001")).collect()
    assert {p.entity_id: p.split for p in points} == {
        "SK_ID_CURR:100001": "train", "SK_ID_CURR:100002": "oot", "SK_ID_CURR:100008": "validation",
        "SK_ID_CURR:100050": "validation",
    }
    first = next(p for p in points if p.entity_id == "SK_ID_CURR:100001")
    assert first.prediction_id == "525b42bfb254fd02fbdcec363c671e5765042a7d0ff521c7b81b24731f86b615"
    assert (first.label, (first.label_time - first.prediction_time).days) == (0.0, 365)
    entity = ids.entity_id(F.col("SK_ID_CURR"))
    buckets = apps.select(ids.hash_bucket(entity, b.seed, b.modulus, b.dataset)).collect()
    assert [r[0] for r in buckets] == [6253, 9759, 8104, 8525]
    other = apps.select(ids.hash_bucket(entity, 99999999, b.modulus, b.dataset)).collect()
    assert buckets != other


@pytest.mark.parametrize("text,want", [
    ("100", "100"), (" 007 ", "7"), ("000", "0"), ("\t5\n", "5"), ("", None), ("-1", None), ("1.0", None), ("1 2", None),
    ("12\n3", None), (None, None),
])
def test_normalize_id(spark, text, want):
    assert values(spark, [(text,)], "t string", x=ids.normalize_id(F.col("t")))[0]["x"] == want


@pytest.mark.parametrize("text,want", [("0", 0.0), (" 1 ", 1.0), ("2", None), ("true", None), ("1.0", None), (None, None)])
def test_parse_label(spark, text, want):
    assert values(spark, [(text,)], "t string", x=ids.parse_label(F.col("t")))[0]["x"] == want


def test_assign_split(spark):
    rows = values(spark, [(0,), (7999,), (8000,), (8999,), (9000,)], "b long", s=ids.assign_split(F.col("b"), Boundary()))
    assert [r["s"] for r in rows] == ["train", "train", "validation", "validation", "oot"]


HARD_TEXTS = ["plain", "é ü 漢", 'quo"te', "back\\slash", "tab\tline\nfeed\r", "\x01\x0b\x1f\x1a", "\\u001F", "\\\x1f", "\x1f\x1f", "a/b", None]


def test_row_hash_is_hash_of_compact_json(spark):
    rows = [(t, str(i)) for i, t in enumerate(HARD_TEXTS)]
    for row in values(spark, rows, "a string, b string", h=ids.row_hash(["a", "b"]), j=ids.canonical_json(F.col("a"), F.col("b"))):
        document = json.dumps({"a": row["a"], "b": row["b"]}, ensure_ascii=False, separators=(",", ":"))
        assert row["h"] == hashlib.sha256(document.encode()).hexdigest()
        assert row["j"] == json.dumps([row["a"], row["b"]], ensure_ascii=False, separators=(",", ":"))


def test_shift_months_clamps_to_month_end(spark):
    got = values(
        spark, [(-1,), (1,), (-11,), (0,)], "m int",
        t=ids.utc_text(ids.shift_months(ids.instant("2000-01-31T00:00:00Z"), F.col("m")), "yyyy-MM-dd"),
    )
    assert [r["t"] for r in got] == ["1999-12-31", "2000-02-29", "1999-02-28", "2000-01-31"]


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        t = ids.instant("2000-01-01T00:00:00Z")
        row = spark.range(1).select(ids.utc_text(t), ids.iso_text(t), ids.iso_text(t + F.expr("interval 5 microseconds"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(row) == ("2000-01-01T00:00:00.000000Z", "2000-01-01T00:00:00+00:00", "2000-01-01T00:00:00.000005+00:00")


def test_event_id_by_record_then_payload(spark):
    columns = "d string, et string, e string, k string, r string, v string, p string"
    rows = [("d", "customer", "e", "k", " r ", " 1 ", None), ("d", "customer", "e", "k", " ", None, "AB" * 32), ("d", "customer", "e", "k", None, None, None)]
    c = F.col
    got = values(spark, rows, columns, x=ids.event_id(c("d"), c("et"), c("e"), c("k"), ids.instant("2000-01-01T00:00:00Z"), c("r"), c("v"), c("p")))
    head = ["d", "customer", "e", "k", "2000-01-01T00:00:00.000000Z"]
    for row, tail in zip(got, (["source_record", "r", "1"], ["payload_sha256", "ab" * 32])):
        assert row["x"] == hashlib.sha256(json.dumps(head + tail, separators=(",", ":")).encode()).hexdigest()
    assert got[2]["x"] is None


def test_number_text(spark):
    numbers = [0.1, 1e7, -0.0, 3.0, 1 / 3, 1e-5, 1.5e300, None]
    got = values(spark, [(v,) for v in numbers], "v double", t=value_text("v"))
    want = ["null" if v is None else "0" if v == 0 else format(v, ".17g") for v in numbers]
    assert [r["t"] for r in got] == want


def test_payload_text(spark):
    rows = [("bureau_upsert", '{"SK_ID_CURR":1,"AMT_CREDIT_SUM":10000000,"CREDIT_ACTIVE":null}'), ("bureau_upsert", "{"),
            ("application_upsert", '{"SK_ID_CURR":1}')]
    got = [r["t"] for r in values(spark, rows, "k string, p string", t=payload_text("k", "p"))]
    assert got[:2] == ['{"AMT_CREDIT_SUM":10000000.0,"SK_ID_CURR":1}', None]
    assert json.loads(got[2])["FLAG_DOCUMENT_21"] == 0
