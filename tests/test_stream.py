from __future__ import annotations

import hashlib
import json
import os
from datetime import timedelta
from pathlib import Path

import pytest
from brute import features as brute_features
from pyspark.sql import functions as F

from tidemark.functions.identity import utc_text
from tidemark.operators.contracts import TEXT_WORDS, expected_envelope_id
from tidemark.plans import stream_queries
from tidemark.settings import DOCUMENT_FLAGS
from tidemark.sources.topics import RAW_SCHEMA, as_messages, read_events, source_topics
from tidemark.streaming import state
from tidemark.streaming.flow import parity, parse_events

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = {"application_upsert": "application_train", "bureau_upsert": "bureau", "bureau_balance_upsert": "bureau_balance"}


def envelopes(spark, rows):
    """(kind, key, entity, payload, time) rows as messages with right ids."""
    df = spark.createDataFrame(
        [(1, k, NAMES[k], str(pk), f"SK_ID_CURR:{e}", "UPSERT", t, "2024-06-01T00:00:00Z", json.dumps(p)) for k, pk, e, p, t in rows],
        "schema_version int, event_type string, source_table string, source_pk string, entity_id string, op string, t string, "
        "produced_at string, payload string",
    ).withColumn("event_time", F.col("t").cast("timestamp")).drop("t").withColumn("event_id", expected_envelope_id())
    topic = {"application_upsert": 0, "bureau_upsert": 1, "bureau_balance_upsert": 2}
    parts = [
        as_messages(df.where(F.col("event_type") == k).withColumn("event_time", utc_text(F.col("event_time"))), source_topics()[i])
        for k, i in topic.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def clean(row, *drop):
    return {k: v for k, v in row.items() if v != "" and k not in drop}


def source_rows(credit_rows):
    apps, loans, months = credit_rows
    owner = {r["SK_ID_BUREAU"]: r["SK_ID_CURR"] for r in loans}
    state_of = {"Sold": "Closed"}
    rows = [("application_upsert", a["SK_ID_CURR"], a["SK_ID_CURR"], clean(a, "TARGET"), "2024-01-01T00:00:00Z") for a in apps]
    loans = [{**r, "CREDIT_ACTIVE": state_of.get(r["CREDIT_ACTIVE"], r["CREDIT_ACTIVE"])} for r in loans]
    rows += [("bureau_upsert", r["SK_ID_BUREAU"], r["SK_ID_CURR"], clean(r, "DAYS_CREDIT_ENDDATE"), "2024-01-01T00:00:00Z") for r in loans]
    rows += [
        ("bureau_balance_upsert", f"{r['SK_ID_BUREAU']}:{r['MONTHS_BALANCE']}", owner[r["SK_ID_BUREAU"]],
         {**r, "SK_ID_CURR": owner[r["SK_ID_BUREAU"]]}, "2024-01-01T00:00:00Z") for r in months
    ]
    return rows, brute_features(apps, loans, months)


def want_rows(spark, want):
    flat = [(f"SK_ID_CURR:{e}", f, None if v is None else float(v)) for e, fs in want.items() for f, v in fs.items()]
    return spark.createDataFrame(flat, "entity_id string, feature_id string, feature_value double")


def test_stream_in_batches_equals_the_definition(spark, tmp_path, credit_rows):
    """Wrong early versions, duplicates and out-of-order arrival over several batches, then a replay."""
    rows, want = source_rows(credit_rows)
    early = [(k, pk, e, {**p, "AMT_CREDIT": 1.0} if k == "application_upsert" else {**p, "AMT_CREDIT_SUM": 5.0} if k == "bureau_upsert" else
              {**p, "STATUS": "5"}, "2023-12-01T00:00:00Z") for k, pk, e, p, _ in rows]
    source = str(tmp_path / "topic")
    # Even rows: the newest version comes first, odd rows: last. Some arrive twice.
    first = [r for i, r in enumerate(rows) if i % 2 == 0] + [r for i, r in enumerate(early) if i % 2]
    second = [r for i, r in enumerate(early) if i % 2 == 0] + [r for i, r in enumerate(rows) if i % 2] + rows[:20]
    tables = state.StreamTables(str(tmp_path / "state"))
    for batch in (first, second, first):
        envelopes(spark, batch).coalesce(1).write.mode("append").parquet(source)
        state.run_feature_stream(read_events(spark, source), tables)
    latest = state.latest_values(spark, tables)
    report = parity(want_rows(spark, want).where("feature_value is not null or feature_id like 'app.%'"),
                    latest.where("feature_value is not null or feature_id like 'app.%'"), [], 1e-7)
    assert all((r.different, r.missing, r.extra) == (0, 0, 0) for r in report.collect()), report.collect()
    updates = state.read_batches(spark, tables, "updates", state.UPDATE_COLUMNS)
    assert {r.batch for r in updates.select("batch").distinct().collect()} == {0, 1}  # the third batch repeats ids only
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(state.latest_values(spark, state.compact_updates(spark, tables))) == key(latest)


def loan(pk, entity, time, **more):
    return ("bureau_upsert", pk, entity, {"SK_ID_CURR": entity, "SK_ID_BUREAU": pk, "DAYS_CREDIT": -1} | more, time)


def test_a_batch_hands_on_the_entities_it_changes(spark, tmp_path, monkeypatch):
    """What a batch works on does not grow with the other entities or with the batches before."""
    handed, source = [], str(tmp_path / "topic")
    work = state.process_touched
    monkeypatch.setattr(state, "process_touched", lambda df, n, *args: (handed.append(df.count()), work(df, n, *args)))
    tables = state.StreamTables(str(tmp_path / "state"))
    batches = [[loan(pk, pk % 3, "2024-01-01T00:00:00Z") for pk in range(9)]]
    batches += [[loan(0, 0, f"2024-01-0{day}T00:00:00Z")] for day in range(2, 5)] + [[loan(0, 0, "2024-01-04T00:00:00Z")]]
    for rows in batches:
        envelopes(spark, rows).coalesce(1).write.mode("append").parquet(source)
        state.run_feature_stream(read_events(spark, source), tables)
    # Three rows of entity 0 and the version that a new one replaces; a repeated event changes nothing.
    assert handed == [9, 4, 4, 4, 0]
    newest = state.latest_values(spark, tables).where("entity_id = 'SK_ID_CURR:0'").select("event_time").distinct().collect()
    assert [r.event_time.day for r in newest] == [4]


def test_entities_of_one_group_are_kept_apart(spark, tmp_path, monkeypatch):
    """All entities in one group: a batch hands on those it names only, late rows and old values are those of their entity."""
    handed, source, work = [], str(tmp_path / "topic"), state.process_touched
    monkeypatch.setattr(state, "GROUPS", 1)
    monkeypatch.setattr(state, "_SLICE", 2)
    monkeypatch.setattr(state, "process_touched", lambda df, n, *args: (
        handed.append(sorted((r.entity_id[-1], r.source_pk, r.route, r.was, r.now) for r in df.collect())), work(df, n, *args)))
    tables = state.StreamTables(str(tmp_path / "state"))
    batches = [[loan(pk, pk % 3, "2024-01-05T00:00:00Z", AMT_CREDIT_SUM=1.0) for pk in range(6)],
               [loan(4, 1, "2024-01-06T00:00:00Z", AMT_CREDIT_SUM=7.0)], [loan(8, 2, "2024-01-05T23:00:00Z"), loan(9, 0, "2023-01-01T00:00:00Z")]]
    for rows in batches:
        envelopes(spark, rows).coalesce(1).write.mode("append").parquet(source)
        state.run_feature_stream(read_events(spark, source), tables, lateness=timedelta(days=2))
    assert [len(b) for b in handed] == [6, 3, 4]
    assert handed[1] == [("1", "1", "state", True, True), ("1", "4", "on_time", False, True), ("1", "4", "state", True, False)]
    assert handed[2] == [("0", "9", "too_late", False, False), ("2", "2", "state", True, True), ("2", "5", "state", True, True), ("2", "8", "correction", False, True)]
    sums = state.latest_values(spark, tables).where("feature_id = 'bureau.credit_sum_total'").collect()
    assert {r.entity_id[-1]: r.feature_value for r in sums} == {"0": 2.0, "1": 8.0, "2": 2.0}


def test_refused_files_are_counted_into_the_batches(spark):
    """Five micro-batches or a few more, whatever share of the files holds refused messages."""
    if not Path(FOLDER).exists():
        pytest.skip("tables are not here")
    tables = stream_queries.run_features(spark, FOLDER)
    batches = [f for f in Path(tables.path("features-checkpoint"), "commits").iterdir() if f.name.isdigit()]
    assert stream_queries.BATCHES <= len(batches) <= stream_queries.BATCHES + 1


def test_topics_and_words(spark, tmp_path):
    """Dead letters and updates are sent once; a wider word list accepts what else is a dead letter."""
    rows = [loan(1, 7, "2024-01-01T00:00:00Z", CREDIT_ACTIVE="Sold"), loan(2, 8, "2024-01-01T00:00:00Z")]
    for i, words in enumerate((TEXT_WORDS, {**TEXT_WORDS, "CREDIT_ACTIVE": ["Active", "Closed", "Sold"]})):
        source, outbox = str(tmp_path / f"in{i}"), str(tmp_path / f"out{i}")
        envelopes(spark, rows + rows).write.parquet(source)
        for _ in range(2):  # nothing new the second time
            state.run_feature_stream(read_events(spark, source), state.StreamTables(str(tmp_path / f"s{i}")), words=words, outbox=outbox)
        found = sorted(r.topic.split(".")[1] for r in read_events(spark, outbox, stream=False).collect())
        assert found == (["dlq"] * 2 + ["feature_updates"] * 8 if i == 0 else ["feature_updates"] * 16)


def test_what_was_not_sent_is_sent_again(spark, tmp_path, monkeypatch):
    """The first send of each topic fails; a restart delivers each letter and update, with the ids written before."""
    source, outbox, tables = str(tmp_path / "in"), str(tmp_path / "out"), state.StreamTables(str(tmp_path / "s"))
    envelopes(spark, [loan(1, 7, "2024-01-01T00:00:00Z", CREDIT_ACTIVE="Sold"), loan(2, 8, "2024-01-01T00:00:00Z")]).write.parquet(source)
    send, failed = state.write_updates, set()

    def once_down(df, location, topic, fmt="parquet"):
        if topic not in failed:
            failed.add(topic)
            raise OSError("the broker is away")
        send(df, location, topic, fmt)

    monkeypatch.setattr(state, "write_updates", once_down)
    ids = None
    for attempt in range(3):
        if attempt < 2:
            with pytest.raises(Exception, match="the broker is away"):
                state.run_feature_stream(read_events(spark, source), tables, outbox=outbox)
        else:
            state.run_feature_stream(read_events(spark, source), tables, outbox=outbox)
        written = {r.feature_update_id for r in state.latest_values(spark, tables).collect()}
        assert len(written) == 8 and ids in (None, written)
        ids = written
    sent = read_events(spark, outbox, stream=False).select("topic", F.from_json("value", "feature_update_id string, code string").alias("m")).collect()
    assert {r.m.feature_update_id for r in sent if r.topic.endswith("feature_updates.v1")} == ids and len(sent) == 9
    assert [r.m.code for r in sent if r.topic.endswith("dlq.v1")] == ["contract"]


def test_ids_escape_what_is_not_ascii(spark):
    """Ids by the rule in plain Python: compact JSON with ASCII escapes, hashed."""
    cases = [("bureau_upsert", "é𝒳1", {"SK_ID_BUREAU": 1, "SK_ID_CURR": 7}), ("bureau_upsert", "2", {"AMT_CREDIT_SUM": 5, "CREDIT_ACTIVE": "ü", "SK_ID_CURR": 7}),
             ("bureau_balance_upsert", "3:-1", {"MONTHS_BALANCE": -1, "SK_ID_BUREAU": 3, "SK_ID_CURR": 7, "STATUS": "é"}),
             ("application_upsert", "\u007f", {"SK_ID_CURR": 7})]
    df = spark.createDataFrame([(i, k, NAMES[k], pk, "UPSERT", json.dumps(p, ensure_ascii=False)) for i, (k, pk, p) in enumerate(cases)],
                               "i int, event_type string, source_table string, source_pk string, op string, payload string")
    df = df.withColumn("event_time", F.expr("timestamp'2024-01-01T00:00:00Z'"))
    got = {r.i: r.id for r in df.select("i", expected_envelope_id().alias("id")).collect()}
    for i, (k, pk, p) in enumerate(cases):
        p = {f: float(v) if f == "AMT_CREDIT_SUM" else v for f, v in p.items()} | ({f: 0 for f in DOCUMENT_FLAGS} if k == "application_upsert" else {})
        text = json.dumps([NAMES[k], pk, "2024-01-01T00:00:00+00:00", "UPSERT", json.dumps(p, sort_keys=True, separators=(",", ":"))], separators=(",", ":"))
        assert got[i] == "sha256:" + hashlib.sha256(text.encode()).hexdigest(), cases[i]


def test_dead_letters(spark):
    good = envelopes(spark, [("bureau_upsert", 1, 7, {"SK_ID_CURR": 7, "SK_ID_BUREAU": 1}, "2024-01-01T00:00:00Z")])
    raw = good.unionByName(good.withColumn("value", F.regexp_replace("value", "UPSERT", "DELETE"))).unionByName(
        spark.createDataFrame([("t", "k", "no json")], RAW_SCHEMA))
    valid, dead = parse_events(raw)
    assert valid.count() == 1
    rows = {r.code: r for r in dead.collect()}
    assert set(rows) == {"contract", "not_json"} and rows["not_json"].payload == "no json"
    assert {"op", "event_id"} <= {e.field for e in rows["contract"].errors}


def test_late_rows_and_boundary(spark, tmp_path):
    """The watermark outlives a restart; late rows within the lateness give old and new values, with their predictions."""
    source, tables = str(tmp_path / "in"), state.StreamTables(str(tmp_path / "state"))
    points = spark.sql("select 'SK_ID_CURR:2' as entity_id, timestamp'2024-01-01T12:00:00Z' as prediction_time")
    batches = [[loan(1, 1, "2024-01-02T00:00:00Z", AMT_CREDIT_SUM=5.0), loan(2, 2, "2024-01-01T11:00:00Z")],
               [loan(3, 1, "2024-01-01T23:57:00Z"), loan(6, 2, "2024-01-02T01:00:00Z")],
               [loan(4, 1, "2024-01-01T23:00:00Z", AMT_CREDIT_SUM=2.0), loan(5, 1, "2024-01-01T20:00:00Z")]]
    for rows in batches:
        envelopes(spark, rows).write.mode("append").parquet(source)
        state.run_feature_stream(read_events(spark, source), tables, points=points, lateness=timedelta(hours=2))
    read = lambda name: {(r.source_pk, r.batch) for r in spark.read.parquet(tables.path(name)).collect()}
    assert (read("late_dead_letters"), read("violations")) == ({("5", 2)}, {("6", 1)})
    counts = state.latest_values(spark, tables).where("feature_id = 'bureau.record_count'").collect()
    assert {r.entity_id: r.feature_value for r in counts} == {"SK_ID_CURR:1": 3.0, "SK_ID_CURR:2": 1.0}
    predictions = spark.sql("select 'p' || i as prediction_id, 'SK_ID_CURR:1' as entity_id, timestamp'2024-01-01T22:30:00Z' + make_dt_interval(0, i) as prediction_time from range(3) as t(i)")
    found = state.corrected_predictions(spark, tables, predictions).collect()
    assert {(r.feature_id.split(".")[1], r.old_value, r.new_value, r.batch) for r in found} == {
        ("record_count", 2.0, 3.0, 2), ("recent_12m_count", 2.0, 3.0, 2), ("credit_sum_total", 5.0, 7.0, 2)}
    assert {r.prediction_id for r in found} == {"p1", "p2"}


def test_parity_states(spark):
    schema = "entity_id string, feature_id string, feature_value double"
    batch = spark.createDataFrame([("a", "n", 1.0), ("b", "n", 2.0), ("c", "n", None), ("d", "n", 4.0), ("a", "x", 1.0), ("b", "x", 1.0)], schema)
    stream = spark.createDataFrame([("a", "n", 1.0), ("b", "n", 2.0 + 1e-12), ("c", "n", None), ("e", "n", 4.0), ("a", "x", 1.0 + 1e-12), ("b", "x", None)], schema)
    got = {r.feature_id: tuple(r)[1:] for r in parity(batch, stream, ["n"]).collect()}
    assert got == {"n": (2, 1, 1, 1), "x": (1, 1, 0, 0)}
