from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from test_stream import envelopes, loan

from tidemark.operators.contracts import TEXT_WORDS, feature_update_id, mark_envelopes, mark_written
from tidemark.plans import stream_queries
from tidemark.sources.topics import read_events
from tidemark.streaming import state
from tidemark.streaming.flow import mark_messages, parse_messages

AMOUNTS = ["0.0", "12.5", "-0.25", "123456.7891", "0.0001", "12.50", "5", "1.0E7", "1234.5670000000002", "0.00001", "-0.0", '"12.5"', "null"]


FIELDS = ("schema_version", "event_type", "source_table", "source_pk", "entity_id", "op", "event_time", "produced_at", "payload", "event_id")


def as_written(message, payload=None):
    """A message with its fields and times as the queries write them."""
    payload = payload or json.dumps(json.loads(message["payload"]), separators=(",", ":"), ensure_ascii=False)
    message = message | {c: message[c][:19] + ".000000Z" for c in ("event_time", "produced_at")} | {"payload": payload}
    return json.dumps({f: message[f] for f in FIELDS}, separators=(",", ":"), ensure_ascii=False)


def messages_of_all_kinds(spark):
    month = ("bureau_balance_upsert", "1:-1", 7, {"MONTHS_BALANCE": -1, "SK_ID_BUREAU": 1, "SK_ID_CURR": 7, "STATUS": "C"}, "2024-01-01T00:00:00Z")
    rows = [month, (*month[:3], {**month[3], "STATUS": "Q"}, month[4]), (*month[:3], {**month[3], "MONTHS_BALANCE": 10**18}, month[4]),
            loan(1, 7, "2024-01-01T00:00:00Z"), ("application_upsert", 7, 7, {"SK_ID_CURR": 7}, "2024-01-01T00:00:00Z")]
    good = [(r.topic, as_written(json.loads(r.value))) for r in envelopes(spark, rows).collect()]
    loans = []
    for amount in AMOUNTS:
        for word in ("Active", "Sold", "é"):
            payload = (f'{{"SK_ID_CURR":7,"SK_ID_BUREAU":1,"DAYS_CREDIT":-3,"CREDIT_ACTIVE":"{word}","AMT_CREDIT_SUM":{amount}'
                       + (f',"AMT_CREDIT_SUM_DEBT":{amount}' if len(loans) % 2 else "") + ',"AMT_CREDIT_SUM_OVERDUE":0.0}')
            loans.append(("bureau_upsert", "1", 7, json.loads(payload), "2024-01-01T00:00:00Z", payload))
    # Ids by the rule, the payload as its text came.
    made = [(r.topic, json.loads(r.value)) for r in envelopes(spark, [x[:5] for x in loans]).collect()]
    by_payload = {m["payload"]: (t, m) for t, m in made}
    all_good = good + [(by_payload[json.dumps(x[3])][0], as_written(by_payload[json.dumps(x[3])][1], x[5])) for x in loans]
    changes = [("UPSERT", "DELETE"), ("sha256:", "sha256:0"), ("2024-01-01", "2024-02-30"), ("2024-06-01", "0000-01-01"), ("000000Z", "000001Z"), ("SK_ID_CURR:7", "SK_ID_CURR:x"),
               ('"source_table":"bureau"', '"source_table":"bureau_balance"'), ('"event_type":"bureau_upsert"', '"event_type":"bureau_balance_upsert"'),
               ('"schema_version":1', '"schema_version":2'), ('"source_pk":"1', '"source_pk":"ü'), ('"source_pk":"1', '"source_pk":"1,'), ("}", " }"), ('"event_type":"bureau_upsert"', '"event_type":null')]
    broken = [(t, v.replace(a, b)) for t, v in all_good for a, b in changes] + [("t", None), ("t", ""), (None, "no json")]
    return spark.createDataFrame(all_good + broken, "topic string, value string")


@pytest.mark.parametrize("words", [TEXT_WORDS, {"CREDIT_ACTIVE": ["Sold", "é"], "STATUS": ["Q"]}])
def test_written_messages_are_judged_like_parsed_ones(spark, words):
    raw = messages_of_all_kinds(spark)
    new, old = mark_messages(raw, words), mark_envelopes(parse_messages(raw), words)
    assert new.schema.simpleString() == old.select(*new.columns).schema.simpleString()
    key = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*old.columns))).collect())
    assert key(new) == key(old)
    written, others = mark_written(raw, words)
    assert written.count() > 40 and others.count() > 100 and {1, 2} <= {r.n for r in written.select(F.size("errors").alias("n")).collect()}
    # The fields of written messages take neither JSON nor Python, and a filter on the errors does not find them a second time.
    plan = written.where(F.size("errors") > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "parse_json" not in plan and "payload_text" not in plan and plan.count("regexp_replace(") == 1


def test_the_text_of_a_message_is_kept_where_it_is_refused(spark, tmp_path):
    rows = [loan(1, 7, "2024-01-01T00:00:00Z", CREDIT_ACTIVE="Sold"), loan(2, 8, "2024-01-01T00:00:00Z")]
    envelopes(spark, rows).write.parquet(str(tmp_path / "in"))
    tables = state.StreamTables(str(tmp_path / "state"))
    state.start_intake(read_events(spark, str(tmp_path / "in")), tables).awaitTermination()
    marked = spark.read.parquet(tables.path("marked")).collect()
    assert {(r.source_pk, r.accepted, r.value is not None) for r in marked} == {("1", False, True), ("2", True, False)}
    assert [json.loads(r.payload)["source_pk"] for r in state.dead_letters(spark, tables).collect()] == ["1"]


def test_files_of_messages_follow_the_tables(spark, tmp_path, monkeypatch):
    for name in ("customer", "orders", "lineitem"):
        spark.range(1_000).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert stream_queries._files(spark, str(tmp_path)) == 2 * stream_queries.BATCHES
    monkeypatch.setattr(stream_queries, "FILE_MESSAGES", 100)
    assert stream_queries._files(spark, str(tmp_path)) == 30


def test_update_ids_of_plain_and_other_parts(spark):
    """Ids by the rule in plain Python. Where all parts are plain the text of the array is put together, not escaped."""
    cases = [("SK_ID_CURR:7", "bureau.record_count", 2.0), ("SK_ID_CURR:7", "a,b", 0.1), ("é", "f", None), ('q"', "f", -1e-7), ("a\\", "\n", 1e300), ("SK_ID_CURR:1", None, 3.0), (None, "f", -0.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e string, f string, v double")
    time = F.expr("timestamp'2024-01-11T00:00:00Z'")
    got = {r.i: r.id for r in df.select("i", feature_update_id(F.col("e"), F.col("f"), F.lit(1), time, F.col("v")).alias("id")).collect()}
    for i, (e, f, v) in enumerate(cases):
        value = "null" if v is None else "0" if v == 0 else f"{v:.17g}"
        text = json.dumps([e, f, "1", "2024-01-11T00:00:00+00:00", value], separators=(",", ":"))
        assert got[i] == "sha256:" + hashlib.sha256(text.encode()).hexdigest(), cases[i]
