"""Streams over files that Spark writes from, or finds in, the given folder."""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identity import shift_days, utc_text
from tidemark.operators.catalog import FEATURE_IDS
from tidemark.operators.contracts import validate_envelopes, with_envelope_ids
from tidemark.plans import credit_sql as sql
from tidemark.plans import credit_tables as credit
from tidemark.plans.checks_queries import balance_envelopes
from tidemark.plans.feature_queries import SECONDS, values
from tidemark.plans.registry import query
from tidemark.session import scratch_folder, settle
from tidemark.settings import DOCUMENT_FLAGS
from tidemark.sources.topics import as_messages, read_events, topics
from tidemark.streaming.audit import AuditListener, audit_rows, audited
from tidemark.streaming.flow import (
    boundary_gate, boundary_gate_between_streams, current_windows, dedupe, feature_updates, parity, route_late, upsert_windows, windowed,
    with_event_time,
)
from tidemark.streaming.state import (
    StreamTables, compact_updates, corrected_predictions, dead_letters, latest_values, run_feature_stream, start_features, start_intake,
    upsert_latest,
)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream; its time column needs a zone to carry a watermark."""
    schema = credit.table(spark, folder, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return rows.withColumn("event_time", F.col("ts").cast("timestamp"))


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, into files."""
    spark, path = stream.sparkSession, scratch_folder(stream.sparkSession, name)
    job = (
        stream.writeStream.format("parquet").option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Every event arrives twice and leaves once."""
    path = scratch_folder(spark, "twice")
    events = credit.table(spark, folder, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    events.write.parquet(path)
    events.write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    return run_to_files(dedupe(stream, "60 days"), "deduplicated").select("event_id", "user_id", "event_type")


def _windows(spark: SparkSession, folder: str, key: str, **frame: str) -> DataFrame:
    stream = with_event_time(event_stream(spark, folder))
    counted = windowed(stream, key, [F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")], **frame)
    return run_to_files(counted, "windows").select(
        utc_text(F.col("window_start"), SECONDS).alias("window_start"), utc_text(F.col("window_end"), SECONDS).alias("window_end"),
        key, "rows", F.round("total", 2).alias("total"),
    )


_CLOSED = "(SELECT max(ts) - INTERVAL 5 MINUTE FROM events)"


@query(f"""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
    event_type, count(*) AS rows, round(sum(value), 2) AS total
  FROM (SELECT *, date_trunc('day', ts) AS s FROM events) GROUP BY s, event_type HAVING s + INTERVAL 1 DAY <= {_CLOSED}""")
def stream_tumbling_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Daily windows per event type; only closed windows are emitted."""
    return _windows(spark, folder, "event_type", size="1 day")


@query(f"""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
    event_type, count(*) AS rows, round(sum(value), 2) AS total
  FROM (SELECT *, unnest([date_trunc('day', ts + INTERVAL 12 HOUR) - INTERVAL 12 HOUR, date_trunc('day', ts)]) AS s FROM events)
  GROUP BY s, event_type HAVING s + INTERVAL 1 DAY <= {_CLOSED}""")
def stream_sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder, "event_type", size="1 day", slide="12 hours")


@query(f"""SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start,
    strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, user_id, count(*) AS rows, round(sum(value), 2) AS total
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR)::INT AS fresh FROM events))
  GROUP BY user_id, coalesce(session, 0) HAVING max(ts) + INTERVAL 6 HOUR <= {_CLOSED}""")
def stream_session_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder, "user_id", gap="6 hours")


@query("""SELECT part + 1 AS batches, metric, value FROM (SELECT 3 AS part, count(*)::DOUBLE AS n, count(*) FILTER (value < 10)::DOUBLE AS small,
    (count(*) - count(nullif(event_type, 'view')))::DOUBLE AS nulls FROM events),
  LATERAL (SELECT unnest(['rows', 'null:event_type', 'null:value', 'breaks:small_value']) AS metric, unnest([n, nulls, 0, small]) AS value)""")
def stream_audit(spark: SparkSession, folder: str) -> DataFrame:
    """NULLs, broken rules and row counts of each of four micro-batches, summed from the audit table. Views lose their type."""
    path = scratch_folder(spark, "audit")
    events = credit.table(spark, folder, "events").withColumn("event_type", F.nullif("event_type", F.lit("view")))
    events.limit(0).write.parquet(f"{path}/events")
    stream = audited(
        spark.readStream.schema(events.schema).parquet(f"{path}/events"), "events", ["event_type", "value"], {"small_value": F.col("value") < 10})
    listener = AuditListener(spark, f"{path}/log")
    spark.streams.addListener(listener)
    try:
        for part in range(4):
            events.where(F.pmod("event_id", F.lit(4)) == part).write.mode("append").parquet(f"{path}/events")
            stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(
                availableNow=True).start().awaitTermination()
        rows = _heard(spark, f"{path}/log", 4)
    finally:
        spark.streams.removeListener(listener)
    return rows.groupBy("metric").agg(F.countDistinct("batch").cast("int").alias("batches"), F.sum("value").alias("value"))


def _heard(spark: SparkSession, path: str, batches: int, seconds: int = 60) -> DataFrame:
    """The audit rows, once the listener, which hears of batches later than the query ends, has written all of them."""
    until = time.monotonic() + seconds
    while True:
        rows = audit_rows(spark, path)
        if rows.select("batch").distinct().count() >= batches or time.monotonic() > until:
            return rows
        time.sleep(0.2)


def _open_windows(spark: SparkSession, folder: str, key: str, **frame: str) -> DataFrame:
    """The same windows, open ones too, over four micro-batches in the order of time."""
    path, sessions = scratch_folder(spark, "open-windows"), "gap" in frame
    events = credit.table(spark, folder, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    events.limit(0).write.parquet(f"{path}/events")
    stream = with_event_time(spark.readStream.schema(events.schema).parquet(f"{path}/events"))
    counted = windowed(stream, key, [F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")], **frame)
    for part in range(4):
        events.where(F.floor((F.dayofmonth("event_time") - 1) / 8) == part).write.mode("append").parquet(f"{path}/events")
        upsert_windows(counted, path, complete=sessions).awaitTermination()
    return current_windows(spark, path, [key], complete=sessions).select(
        utc_text(F.col("window_start"), SECONDS).alias("window_start"), utc_text(F.col("window_end"), SECONDS).alias("window_end"),
        key, "rows", F.round("total", 2).alias("total"))


@query("""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
    event_type, count(*) AS rows, round(sum(value), 2) AS total
  FROM (SELECT *, date_trunc('day', ts) AS s FROM events) GROUP BY s, event_type""")
def stream_open_tumbling_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _open_windows(spark, folder, "event_type", size="1 day")


@query("""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
    event_type, count(*) AS rows, round(sum(value), 2) AS total
  FROM (SELECT *, unnest([date_trunc('day', ts + INTERVAL 12 HOUR) - INTERVAL 12 HOUR, date_trunc('day', ts)]) AS s FROM events)
  GROUP BY s, event_type""")
def stream_open_sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _open_windows(spark, folder, "event_type", size="1 day", slide="12 hours")


@query("""SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start,
    strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, user_id, count(*) AS rows, round(sum(value), 2) AS total
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR)::INT AS fresh FROM events))
  GROUP BY user_id, coalesce(session, 0)""")
def stream_open_session_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _open_windows(spark, folder, "user_id", gap="6 hours")


def _envelope(rows: DataFrame, kind: str, table: str, key: Column, payload: Column, days: Column) -> DataFrame:
    envelope = rows.select(
        F.lit(1).alias("schema_version"), F.lit(kind).alias("event_type"), F.lit(table).alias("source_table"),
        key.cast("string").alias("source_pk"), F.concat(F.lit("SK_ID_CURR:"), F.col("SK_ID_CURR").cast("string")).alias("entity_id"),
        F.lit("UPSERT").alias("op"), shift_days(F.expr("timestamp'2024-01-01T00:00:00Z'"), days).alias("event_time"),
        F.expr("timestamp'2024-06-01T00:00:00Z'").alias("produced_at"), payload.alias("payload"),
    )
    return with_envelope_ids(envelope)


def messages(spark: SparkSession, folder: str, files: Sequence[int] | None = None) -> DataFrame:
    """All three credit tables as messages. A sold record has a state the stream does not accept.

    ``files`` says over how many each table is dealt, before its rows become text.
    """
    dealt = [lambda df, n=n: df.repartition(n, *df.columns) for n in files] if files else [lambda df: df] * 2
    apps = dealt[0](credit.application(spark, folder))
    fields = ["SK_ID_CURR", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_BIRTH", "EXT_SOURCE_1",
              "EXT_SOURCE_2", "EXT_SOURCE_3", *DOCUMENT_FLAGS]
    loans = dealt[1](credit.bureau(spark, folder))
    loan_fields = ["SK_ID_CURR", "SK_ID_BUREAU", "DAYS_CREDIT", "CREDIT_ACTIVE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT",
                   "AMT_CREDIT_SUM_OVERDUE"]
    named = topics()
    parts = [
        (_envelope(apps, "application_upsert", "application_train", F.col("SK_ID_CURR"), F.to_json(F.struct(*fields)), F.lit(0)),
         named["application"].name),
        (_envelope(loans, "bureau_upsert", "bureau", F.col("SK_ID_BUREAU"), F.to_json(F.struct(*loan_fields)), F.col("DAYS_CREDIT")),
         named["bureau"].name),
        (balance_envelopes(spark, folder, files[2] if files else None).drop("MONTHS_BALANCE"), named["bureau_balance"].name),
    ]
    found = [as_messages(_payload_as_json(df), topic) for df, topic in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"""WITH {sql.BUREAU}, written AS (SELECT id, '{{"AMT_CREDIT_SUM":' || amount || coalesce(',"AMT_CREDIT_SUM_DEBT":' || debt, '')
    || ',"AMT_CREDIT_SUM_OVERDUE":' || overdue || ',"CREDIT_ACTIVE":"' || active || '","DAYS_CREDIT":' || days || ',"SK_ID_BUREAU":' || id
    || ',"SK_ID_CURR":' || curr || '}}' AS payload, strftime(TIMESTAMP '2024-01-01' + to_days(days::INT), '%Y-%m-%dT%H:%M:%S+00:00') AS t
    FROM (SELECT * REPLACE (amount::DOUBLE AS amount, debt::DOUBLE AS debt, overdue::DOUBLE AS overdue) FROM bureau WHERE active <> 'Sold'))
  SELECT id::VARCHAR AS source_pk, 'sha256:' || sha256('["bureau","' || id || '","' || t || '","UPSERT",' || to_json(payload) || ']') AS event_id FROM written""")
def record_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Valid envelopes of records: their ids hold amounts as fractions and leave out what is missing."""
    loans = credit.bureau(spark, folder)
    fields = ["SK_ID_CURR", "SK_ID_BUREAU", "DAYS_CREDIT", "CREDIT_ACTIVE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE"]
    rows = _envelope(loans, "bureau_upsert", "bureau", F.col("SK_ID_BUREAU"), F.to_json(F.struct(*fields)), F.col("DAYS_CREDIT"))
    return validate_envelopes(rows)[0].select("source_pk", "event_id")


def _payload_as_json(df: DataFrame) -> DataFrame:
    times = {c: utc_text(F.col(c)) for c in ("event_time", "produced_at")}
    return df.withColumns(times)


#: Micro-batches that the messages of a query are dealt over, at least.
BATCHES = 5
#: Messages to a file, about.
FILE_MESSAGES = 250_000


def _rows(spark: SparkSession, folder: str) -> list[int]:
    return [credit.table(spark, folder, name).count() for name in ("customer", "orders", "lineitem")]


def _files(spark: SparkSession, folder: str) -> int:
    """Files to deal all messages over. Their number follows the tables, whose footers give the counts."""
    return max(2 * BATCHES, -(-sum(_rows(spark, folder)) // FILE_MESSAGES))


def _files_of_tables(spark: SparkSession, folder: str) -> list[int]:
    """The same, of each table by its share of the rows."""
    rows, files = _rows(spark, folder), _files(spark, folder)
    return [max(1, -(-n * files // max(1, sum(rows)))) for n in rows]


def _intake(spark: SparkSession, folder: str, batches: int = 1) -> StreamTables:
    path = scratch_folder(spark, "stream")
    # By the hash of their values: dealt in turn, Spark would first sort all of them. As text they would be ten times as large.
    messages(spark, folder, _files_of_tables(spark, folder)).write.option("compression", "zstd").parquet(f"{path}/messages")
    tables, files = StreamTables(f"{path}/state"), len(spark.read.parquet(f"{path}/messages").inputFiles())
    # In several batches, few cores too give files enough to deal on. The files of a batch that is done go.
    raw = read_events(spark, f"{path}/messages", maxFilesPerTrigger=str(-(-files // batches)), cleanSource="delete")
    start_intake(raw, tables).awaitTermination()
    return tables


def run_features(spark: SparkSession, folder: str) -> StreamTables:
    tables = _intake(spark, folder, BATCHES)
    marked = spark.read.parquet(tables.path("marked")).inputFiles()  # a batch takes refused files into its count too
    # Rounded up for one batch more, so that no count of files leaves a rest of several batches.
    start_features(spark, tables, files=max(1, -(-len(marked) // (BATCHES + 1)))).awaitTermination()
    return tables


# What the stream keeps: records in a known state, of each month of a record the row whose id is greatest.
_STREAM_SQL = f"""{sql.APPLICATION.replace(' AS flags', ' AS all_flags')}, {sql.BUREAU}, {sql.BALANCE}, streamed_balance AS (
    SELECT id, curr, months, arg_max(status, 'sha256:' || sha256('["bureau_balance","' || pk || '","'
      || strftime(TIMESTAMP '2024-01-01' + to_days(months::INT), '%Y-%m-%dT%H:%M:%S+00:00') || '","UPSERT",' || to_json(
        '{{"MONTHS_BALANCE":' || months || ',"SK_ID_BUREAU":' || id || ',"SK_ID_CURR":' || curr || ',"STATUS":"' || status || '"}}') || ']')) AS status
    FROM (SELECT *, id || ':' || months AS pk FROM balance WHERE curr IS NOT NULL) GROUP BY id, curr, months),
  app_s AS (SELECT curr, {sql._columns(sql.APP_SQL)} FROM (SELECT *, coalesce(all_flags, 0) AS flags FROM application)),
  bureau_s AS (SELECT curr, {sql._columns(sql.BUREAU_SQL)} FROM bureau WHERE days <= 0 AND active <> 'Sold' GROUP BY curr),
  balance_s AS (SELECT curr, {sql._columns(sql.BALANCE_SQL)} FROM streamed_balance WHERE months <= 0 GROUP BY curr),
  streamed AS (
    SELECT curr, unnest([{', '.join(f"'{f}'" for f in sql.APP_SQL)}]) AS feature_id, unnest([{', '.join(map(sql.short, sql.APP_SQL))}]) AS feature_value FROM app_s
    UNION ALL SELECT curr, unnest([{', '.join(f"'{f}'" for f in sql.BUREAU_SQL)}]), unnest([{', '.join(map(sql.short, sql.BUREAU_SQL))}])
    FROM (SELECT DISTINCT curr FROM bureau WHERE active <> 'Sold') LEFT JOIN bureau_s USING (curr)
    UNION ALL SELECT curr, unnest([{', '.join(f"'{f}'" for f in sql.BALANCE_SQL)}]), unnest([{', '.join(map(sql.short, sql.BALANCE_SQL))}])
    FROM (SELECT DISTINCT curr FROM balance WHERE curr IS NOT NULL) LEFT JOIN balance_s USING (curr))"""


@query(f"""WITH {_STREAM_SQL} SELECT 'SK_ID_CURR:' || curr AS entity_id, feature_id, round(feature_value, 4) AS feature_value FROM streamed""")
def stream_feature_values(spark: SparkSession, folder: str) -> DataFrame:
    """Features kept up to date by a stream of all three tables, read as latest values."""
    latest = latest_values(spark, run_features(spark, folder), ["feature_value"])
    return latest.select("entity_id", "feature_id", F.round("feature_value", 4).alias("feature_value"))


_COUNTS = [f for f in FEATURE_IDS if f.endswith(("count", "level", "delinquent"))]
_BATCH_SQL = ", ".join([sql.APP_FEATURES, sql.BUREAU_FEATURES, sql.BALANCE_FEATURES, sql.POINTS, sql.VALUES])


@query(f"""WITH {_STREAM_SQL}, application_b AS (SELECT *, all_flags AS flags FROM application),
    {_BATCH_SQL.replace('FROM application)', 'FROM application_b)')}
  SELECT feature_id, count(*) FILTER (state = 'equal') AS equal, count(*) FILTER (state = 'different') AS different,
    count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'extra') AS extra
  FROM (SELECT coalesce(b.feature_id, s.feature_id) AS feature_id, CASE WHEN s.entity_id IS NULL THEN 'missing'
      WHEN b.entity_id IS NULL THEN 'extra' WHEN b.feature_value IS NOT DISTINCT FROM s.feature_value
        OR abs(b.feature_value - s.feature_value) <= greatest(1, abs(b.feature_value)) * 1e-9 THEN 'equal' ELSE 'different' END AS state
    FROM vals b FULL JOIN (SELECT 'SK_ID_CURR:' || curr AS entity_id, * EXCLUDE (curr) FROM streamed) s
      ON b.entity_id = s.entity_id AND b.feature_id = s.feature_id) GROUP BY feature_id""")
def stream_batch_parity(spark: SparkSession, folder: str) -> DataFrame:
    """Stream against batch: they differ where the stream refuses a record or merges a month."""
    latest = latest_values(spark, run_features(spark, folder), ["feature_value"])
    return parity(values(spark, folder), latest, _COUNTS)


@query("""SELECT 'contract' AS code, 'credit.bureau.v1' AS origin, 'payload' AS field, 'does not fit the event type' AS message,
    count(*) AS rows FROM orders WHERE o_orderstatus = 'P'""")
def stream_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    dead = dead_letters(spark, _intake(spark, folder))
    return dead.select("code", "origin", F.explode("errors").alias("e")).groupBy(
        "code", "origin", F.col("e.field").alias("field"), F.col("e.message").alias("message")
    ).agg(F.count(F.lit(1)).alias("rows"))


def _records(loans: DataFrame, days: Column) -> DataFrame:
    """Records as messages of the time that ``days`` after the start of 2024 gives."""
    fields = ["SK_ID_CURR", "SK_ID_BUREAU", "DAYS_CREDIT", "CREDIT_ACTIVE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE"]
    rows = _envelope(loans, "bureau_upsert", "bureau", F.col("SK_ID_BUREAU"), F.to_json(F.struct(*fields)), days)
    return as_messages(_payload_as_json(rows), topics()["bureau"].name)


def _parts_sql(name: str, parts: str) -> str:
    columns = ", ".join(f"({e})::DOUBLE AS {sql.short(f)}" for f, e in sql.BUREAU_SQL.items())
    names, values = (", ".join(t) for t in ([f"'{f}'" for f in sql.BUREAU_SQL], [sql.short(f) for f in sql.BUREAU_SQL]))
    return f"""{name} AS (SELECT curr, unnest([{names}]) AS feature_id, unnest([{values}]) AS v FROM (
      SELECT curr, {columns} FROM parts WHERE days <= 0 AND part IN ({parts}) GROUP BY curr))"""


@query(f"""WITH {sql.BUREAU}, parts AS (SELECT *, CASE WHEN id % 4 <> 0 THEN 'first' WHEN id % 8 <> 0 THEN 'late' ELSE 'lost' END AS part
    FROM bureau WHERE active <> 'Sold'), {_parts_sql('old', "'first'")}, {_parts_sql('new', "'first', 'late'")}
  SELECT 'SK_ID_CURR:' || new.curr AS entity_id, feature_id, round(old.v, 4) AS old_value, round(new.v, 4) AS new_value, 'late-' || new.curr AS prediction_id
  FROM new LEFT JOIN old USING (curr, feature_id) WHERE new.curr IN (SELECT curr FROM parts WHERE part = 'late')
    AND old.v IS DISTINCT FROM new.v AND coalesce(abs(old.v - new.v) > greatest(1, abs(old.v)) * 1e-9, true)""")
def stream_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the records comes after a restart: half of it late, half too late. What the late ones correct,
    and the predictions that had used the old values: of an applicant's two, the one made after the late rows."""
    path, key = scratch_folder(spark, "late"), F.col("SK_ID_BUREAU")
    days, late = F.when(key % 4 != 0, 19).when(key % 8 != 0, 7).otherwise(-200), key % 4 == 0
    tables = StreamTables(f"{path}/state")
    for part in (~late, late):
        _records(credit.bureau(spark, folder).where(part), days).write.mode("append").option("compression", "zstd").parquet(f"{path}/messages")
        run_feature_stream(read_events(spark, f"{path}/messages"), tables, lateness=timedelta(days=30))
    entity = F.concat(F.lit("SK_ID_CURR:"), F.col("c_custkey").cast("string")).alias("entity_id")
    customer = credit.table(spark, folder, "customer")
    predictions = [
        customer.select(entity, F.concat(F.lit(name), F.col("c_custkey").cast("string")).alias("prediction_id"), F.expr(f"timestamp'{time}'").alias("prediction_time"))
        for name, time in (("early-", "2024-01-02T00:00:00Z"), ("late-", "2024-01-25T00:00:00Z"))
    ]
    found = corrected_predictions(spark, tables, predictions[0].unionByName(predictions[1]))
    return found.select("entity_id", "feature_id", F.round("old_value", 4).alias("old_value"), F.round("new_value", 4).alias("new_value"), "prediction_id")


_COUNTED = ["bureau.record_count", "bureau.active_count", "bureau.closed_count", "bureau.recent_12m_count"]


@query(f"""WITH {sql.BUREAU}, counted AS (SELECT curr, {sql._columns({f: sql.BUREAU_SQL[f] for f in _COUNTED})} FROM bureau WHERE days <= 0 AND active <> 'Sold' GROUP BY curr),
    named AS (SELECT curr, unnest([{', '.join(f"'{f}'" for f in _COUNTED)}]) AS feature_id, unnest([{', '.join(map(sql.short, _COUNTED))}]) AS v
      FROM (SELECT DISTINCT curr FROM bureau WHERE active <> 'Sold') LEFT JOIN counted USING (curr))
  SELECT 'credit.feature_updates.v1' AS topic, feature_id AS detail, 1::BIGINT AS sent, 'sha256:' || sha256('["SK_ID_CURR:' || curr || '","' || feature_id
    || '","1","2024-01-11T00:00:00+00:00","' || coalesce(v::BIGINT::VARCHAR, 'null') || '"]') AS id FROM named
  UNION ALL SELECT 'credit.dlq.v1', 'contract', 2 * count(*), NULL FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0""")
def stream_outgoing_topics(spark: SparkSession, folder: str) -> DataFrame:
    """All messages come again after a restart: each update is sent once, each refused message has its letter."""
    path = scratch_folder(spark, "outgoing")
    records = settle(_records(credit.bureau(spark, folder), F.lit(10)), "records")  # sent twice, written once
    tables, outbox = StreamTables(f"{path}/state"), f"{path}/outbox"
    for _ in range(2):
        records.write.mode("append").option("compression", "zstd").parquet(f"{path}/messages")
        run_feature_stream(read_events(spark, f"{path}/messages"), tables, outbox=outbox)
    sent = read_events(spark, outbox, stream=False).select(
        "topic", F.from_json("value", "feature_update_id string, feature_id string, code string").alias("m"))
    of_interest = F.col("m.code").isNotNull() | F.col("m.feature_id").isin(_COUNTED)
    return sent.where(of_interest).groupBy(
        "topic", F.col("m.feature_update_id").alias("id"), F.coalesce("m.code", "m.feature_id").alias("detail")).agg(F.count(F.lit(1)).alias("sent"))


@query("""SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'on_time' WHEN ts >= TIMESTAMP '2024-01-10' THEN 'correction'
    ELSE 'too_late' END AS route FROM events""")
def late_routing(spark: SparkSession, folder: str) -> DataFrame:
    events = credit.table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("event_time"))
    routes = route_late(events, datetime(2024, 1, 20, tzinfo=timezone.utc), timedelta(days=10))
    on_time, corrections, too_late = [
        df.select("event_id", F.lit(name).alias("route")) for df, name in zip(routes, ("on_time", "correction", "too_late"))
    ]
    return on_time.unionByName(corrections).unionByName(too_late)


@query("""SELECT event_id, coalesce(ts > b.cut, false) AS violation FROM events LEFT JOIN (
    SELECT o_custkey, TIMESTAMP '2024-01-01' + to_days((count(*) % 30)::INT) AS cut FROM orders GROUP BY o_custkey) b ON o_custkey = user_id""")
def stream_boundary_gate(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of events against one prediction time per entity."""
    start = F.expr("timestamp'2024-01-01T00:00:00Z'")
    points = credit.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(
        F.count(F.lit(1)).alias("n")
    ).select("entity_id", shift_days(start, F.col("n") % 30).alias("prediction_time"))
    stream = event_stream(spark, folder).withColumnRenamed("user_id", "entity_id")
    passed, violations = [run_to_files(df.select("event_id"), "gate") for df in boundary_gate(stream, points)]
    return passed.withColumn("violation", F.lit(False)).unionByName(violations.withColumn("violation", F.lit(True)))


@query("""SELECT event_id, strftime(b.cut, '%Y-%m-%d %H:%M:%S') AS predicted_at, coalesce(ts > b.cut, false) AS violation FROM events LEFT JOIN (
    SELECT o_custkey, TIMESTAMP '2024-01-01' + to_days((count(*) % 30)::INT) AS cut FROM orders GROUP BY o_custkey) b
  ON o_custkey = user_id AND b.cut >= ts - INTERVAL 10 DAY AND b.cut <= ts + INTERVAL 10 DAY""")
def stream_boundary_gate_between_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions arrive as a stream, after the events that they judge; those further than ten days apart do not meet.

    The last batch holds a far later row on both sides, which lets the watermarks pass and is left out.
    """
    path, start = scratch_folder(spark, "two-streams"), F.expr("timestamp'2024-01-01T00:00:00Z'")
    points = credit.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.count(F.lit(1)).alias("n")).select(
        "entity_id", shift_days(start, F.col("n") % 30).alias("prediction_time"))
    events = credit.table(spark, folder, "events").select("event_id", F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("event_time"))
    late = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("entity_id"), F.expr("timestamp'2030-01-01T00:00:00Z'").alias("event_time"))
    last_point = late.select("entity_id", F.col("event_time").alias("prediction_time"))
    last_point = last_point.select(*[F.col(c).cast(points.schema[c].dataType).alias(c) for c in points.columns])
    last_event = late.select(*[F.col(c).cast(events.schema[c].dataType).alias(c) for c in events.columns])
    events.limit(0).write.parquet(f"{path}/events")
    points.limit(0).write.parquet(f"{path}/points")
    gated = boundary_gate_between_streams(
        spark.readStream.schema(events.schema).parquet(f"{path}/events"), spark.readStream.schema(points.schema).parquet(f"{path}/points"), "10 days", "40 days")
    # A restarted query knows the watermark of both sides together, so the last rows come on both sides at once.
    last = {"events": last_event, "points": last_point}
    for batch in ({"events": events}, {"points": points}, last, last):
        for name, rows in batch.items():
            rows.write.mode("append").parquet(f"{path}/{name}")
        gated.writeStream.format("parquet").option("path", f"{path}/gated").option("checkpointLocation", f"{path}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.schema(gated.schema).parquet(f"{path}/gated").where("event_id >= 0").select(
        "event_id", utc_text(F.col("prediction_time"), SECONDS).alias("predicted_at"), "violation")


@query("""SELECT 'SK_ID_CURR:' || user_id AS entity_id, event_type AS feature_id, arg_max(v, (ts, batch)) AS feature_value
  FROM (SELECT user_id, event_type, ts, value AS v, 0 AS batch FROM events
    UNION ALL SELECT user_id, event_type, ts - INTERVAL 1 DAY, value * 2, 1 FROM events WHERE value < 10
    UNION ALL SELECT user_id, event_type, ts, value * 4, 1 FROM events WHERE value >= 10) GROUP BY ALL""")
def latest_value_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of updates, the second replayed: an older time never wins, an equal one is replaced."""
    c = F.col
    events = credit.table(spark, folder, "events").select(
        F.concat(F.lit("SK_ID_CURR:"), c("user_id").cast("string")).alias("entity_id"), c("event_type").alias("feature_id"),
        c("value").alias("feature_value"), c("ts").cast("timestamp").alias("event_time"),
        F.concat(F.lit("sha256:"), F.sha2(c("event_id").cast("string"), 256)).alias("source_event_id"), F.lit("events").alias("source_topic"),
    )
    small = c("feature_value") < 10
    second = events.withColumn("event_time", F.when(small, c("event_time") - F.expr("interval 1 day")).otherwise(c("event_time")))
    second = second.withColumn("feature_value", c("feature_value") * F.when(small, 2).otherwise(4))
    tables = StreamTables(scratch_folder(spark, "upsert"))
    for batch_id, rows in ((0, events), (1, second), (1, second)):
        upsert_latest(feature_updates(rows), batch_id, tables)
    return latest_values(spark, compact_updates(spark, tables)).select("entity_id", "feature_id", "feature_value")
