"""Feature state of a stream: the newest source rows of every entity, in Spark's own state store.

Two queries, each with its checkpoint. The first one parses and judges messages once and writes all of them,
accepted or not. The second one reads what was accepted. It keeps the newest row per source key, grouped by
entity; a micro-batch hands on the rows of the entities that it changed, and their features are computed
with the batch definitions. So a batch costs what its entities hold, however long the stream has run.

The watermark is the query's own, of the largest event time seen so far. State is told it, and late rows are
not dropped before it: within ``lateness`` they are merged and what they change is a correction, beyond it they
are letters of their own. An event that arrives again, in whatever batch, is not newer than the row that it
gave, so it changes nothing and nothing is sent for it.

What a batch gives is written under its number, then sent. A batch that fails, in a send as well, is done again
by Spark from the same rows and the same state, so it is written over and sent with the same ids.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import timedelta
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.catalog import FEATURES
from tidemark.operators.contracts import TEXT_WORDS
from tidemark.operators.features import run_specs, to_long
from tidemark.settings import DOCUMENT_FLAGS, MANIFEST, STREAM_TABLES
from tidemark.sources.topics import topics, write_updates
from tidemark.streaming.flow import WATERMARK_DELAY, feature_updates, mark_messages, past_boundary, split_messages

PAYLOAD_SCHEMAS = {
    "application_train": T.StructType(
        [T.StructField("SK_ID_CURR", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in (
            "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE")]
        + [T.StructField("DAYS_BIRTH", T.IntegerType())]
        + [T.StructField(f"EXT_SOURCE_{i}", T.DoubleType()) for i in (1, 2, 3)]
        + [T.StructField(c, T.IntegerType()) for c in DOCUMENT_FLAGS]
    ),
    "bureau": T.StructType([
        T.StructField("SK_ID_CURR", T.LongType()), T.StructField("SK_ID_BUREAU", T.LongType()),
        T.StructField("DAYS_CREDIT", T.IntegerType()), T.StructField("CREDIT_ACTIVE", T.StringType()),
        T.StructField("AMT_CREDIT_SUM", T.DoubleType()), T.StructField("AMT_CREDIT_SUM_DEBT", T.DoubleType()),
        T.StructField("AMT_CREDIT_SUM_OVERDUE", T.DoubleType()),
    ]),
    "bureau_balance": T.StructType([
        T.StructField("SK_ID_CURR", T.LongType()), T.StructField("SK_ID_BUREAU", T.LongType()),
        T.StructField("MONTHS_BALANCE", T.IntegerType()), T.StructField("STATUS", T.StringType()),
    ]),
}

UPDATE_COLUMNS = (
    "feature_update_id string, entity_id string, feature_id string, feature_value double, "
    "feature_version int, event_time timestamp, computed_at timestamp, source_event_id string, "
    "source_topic string, computation_mode string, feature_catalog_version string, quality_status string, batch bigint"
)
#: What the keyed state hands on: a source row, how it came, and whether it counted before the batch and counts now.
TOUCHED_COLUMNS = (
    "entity_id string, source_table string, source_pk string, event_id string, topic string, at bigint, payload string, "
    "route string, was boolean, now boolean"
)
CORRECTION_COLUMNS = (
    "entity_id string, feature_id string, old_value double, new_value double, late_event_id string, late_time timestamp, "
    "feature_update_id string, batch bigint"
)
#: Groups that entities are kept in; it holds for the life of a checkpoint.
GROUPS = 8_192
#: Rows that the state hands on at a time, and those in one text.
_SLICE, _TOGETHER = 10_000, 10
#: Ids that are kept as bytes.
_PREFIX, _ID = "sha256:", re.compile("sha256:[0-9a-f]{64}")


class StreamTables(NamedTuple):
    """Where a stream keeps its tables and checkpoints, below one shared folder."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def _write_batch(rows: DataFrame, tables: StreamTables, name: str, batch_id: int) -> None:
    """Write the rows of a micro-batch under its number; a batch that is done again replaces them."""
    (
        rows.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(tables.path(name))
    )


def _written_batch(rows: DataFrame, tables: StreamTables, name: str, batch_id: int, schema: str) -> DataFrame:
    """The rows of a micro-batch, written under its number and read back: they lie on disk once."""
    _write_batch(rows, tables, name, batch_id)
    return read_batches(rows.sparkSession, tables, name, schema).where(F.col("batch") == batch_id).drop("batch")


def read_batches(spark: SparkSession, tables: StreamTables, name: str, schema: str) -> DataFrame:
    """A table of the stream; before the first write it is an empty folder."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch").parquet(tables.path(name))
    return spark.read.schema(schema).parquet(tables.path(name))


def start_intake(raw: DataFrame, tables: StreamTables, words: dict[str, list[str]] = TEXT_WORDS, **trigger):
    """Parse and judge a stream of messages, each once, into the table ``marked``.

    The text of a message is kept where it is refused; what is accepted is in the fields. ``accepted`` is a column: as
    folders Spark would sort all rows by it.
    """
    marked = mark_messages(raw, words).withColumn("accepted", F.size("errors") == 0)
    marked = marked.withColumn("value", F.when(~F.col("accepted"), F.col("value")))
    return marked.writeStream.option("compression", "zstd").option("checkpointLocation", tables.path("intake-checkpoint")).trigger(
        **(trigger or {"availableNow": True})).start(tables.path("marked"), format="parquet")


def _marked_schema(spark: SparkSession) -> T.StructType:
    text = F.lit("").cast("string")
    nothing = spark.readStream.format("rate").load().select(text.alias("topic"), text.alias("value"))  # a stream, of which nothing is written
    return T.StructType([T.StructField(f.name, f.dataType) for f in mark_messages(nothing).withColumn("accepted", F.lit(True)).schema])


def dead_letters(spark: SparkSession, tables: StreamTables) -> DataFrame:
    """What the intake refused, with code, errors, origin and payload."""
    return split_messages(spark.read.schema(_marked_schema(spark)).parquet(tables.path("marked")).where("NOT accepted"))[1]


def _kept(held: dict[str, dict[str, list]]) -> bytes:
    """The rows of an entity as one text: values of a kind lie together, and ids as bytes behind it, which nothing makes smaller."""
    tables, ids = {}, []
    for table, rows in held.items():
        at, events, topic, payload = zip(*rows.values())
        plain = [_ID.fullmatch(e) is not None for e in events]
        ids += [bytes.fromhex(e[len(_PREFIX):]) for e, p in zip(events, plain) if p]
        tables[table] = [list(rows), at, topic, payload, [None if p else e for e, p in zip(events, plain)]]
    text = zlib.compress(json.dumps(tables).encode())
    return len(text).to_bytes(8, "little") + text + b"".join(ids)


def _held(blob: bytes | None) -> dict[str, dict[str, list]]:
    if not blob:
        return {}
    end = 8 + int.from_bytes(blob[:8], "little")
    ids = (_PREFIX + blob[i : i + 32].hex() for i in range(end, len(blob), 32))
    return {
        table: {pk: [at, next(ids) if event is None else event, topic, payload] for pk, at, topic, payload, event in zip(*columns)}
        for table, columns in json.loads(zlib.decompress(blob[8:end])).items()}


def keep_newest(events: DataFrame, lateness: timedelta | None = None) -> DataFrame:
    """A stream of events with a watermark on ``event_time`` -> the source rows of the entities that each batch changes.

    ``events`` has entity_id, source_table, source_pk, event_id, topic, event_time, payload and ``blocked`` (not to
    be merged). The state of an entity is the newest row per table and key, by event time and id; its size is that
    of the entity, so one entity should not hold more rows than fit a task. Entities are kept in ``GROUPS`` groups, each
    entity as a compressed text of its own; the texts of entities that a batch does not name are not opened.
    """
    allowed = None if lateness is None else lateness // timedelta(microseconds=1)

    def merge(entity: str, rows: list[list], held: dict[str, dict[str, list]], mark: int) -> tuple[list[tuple], bool]:
        before, routes, out = {}, {}, []
        for _, table, pk, event, topic, at, payload, blocked in rows:
            at = int(at)
            if blocked == "true" or (allowed is not None and at < mark - allowed):
                out.append((entity, table, pk, event, topic, at, payload, "violation" if blocked == "true" else "too_late", False, False))
                continue
            own = held.setdefault(table, {})
            row = own.get(pk)
            if row is None or (at, event) > (row[0], row[1]):
                before.setdefault((table, pk), row)
                own[pk] = [at, event, topic, payload]
                routes[table, pk] = "correction" if allowed is not None and at < mark else "on_time"
        for table in {t for t, _ in routes}:
            for pk, row in held[table].items():
                route = routes.get((table, pk))
                out.append((entity, table, pk, row[1], row[2], row[0], row[3], route or "state", route is None, True))
                old = before.get((table, pk))
                if old is not None:
                    out.append((entity, table, pk, old[1], old[2], old[0], old[3], "state", True, False))
        return out, bool(routes)

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, blobs = state.getCurrentWatermarkMs() * 1000, dict(zip(*state.get)) if state.exists else {}
        came, out, changed = {}, [], False
        for frame in frames:
            for row in map(json.loads, frame["row"].tolist()):
                came.setdefault(row[0], []).append(row)
        for entity, rows in came.items():
            held = _held(blobs.get(entity))
            found, merged = merge(entity, rows, held, mark)
            out += found
            if merged:
                blobs[entity], changed = _kept(held), True
            if len(out) >= _SLICE:
                yield _packed(out)
                out = []
        if changed:
            state.update((list(blobs), list(blobs.values())))
        if out:
            yield _packed(out)

    # A call costs pandas a millisecond and a column a good part of one. So a call gets a group of entities, and rows
    # come and go as text in one column.
    packed = F.to_json(F.array(
        "entity_id", "source_table", "source_pk", "event_id", "topic", F.unix_micros("event_time").cast("string"), "payload",
        F.col("blocked").cast("string")))
    rows = events.select(F.pmod(F.xxhash64("entity_id"), F.lit(GROUPS)).alias("group"), packed.alias("row"), "event_time")
    handed = rows.groupBy("group").applyInPandasWithState(
        run, "rows string", "entities array<string>, held array<binary>", "append", GroupStateTimeout.NoTimeout)
    columns = F.from_json("rows", ", ".join(f"{c.split(' ')[0]} array<{c.split(' ')[1]}>" for c in TOUCHED_COLUMNS.split(", ")))
    zipped = handed.select(columns.alias("c")).select(F.arrays_zip(*[F.col(f"c.{c}").alias(c) for c in _TOUCHED]).alias("rows"))
    return zipped.select(F.inline("rows"))


def _packed(rows: list[tuple]) -> pd.DataFrame:
    """A few rows to a text: what is sent at a time is limited by the number of texts."""
    parts = (rows[i : i + _TOGETHER] for i in range(0, len(rows), _TOGETHER))
    return pd.DataFrame({"rows": [json.dumps(dict(zip(_TOUCHED, zip(*part)))) for part in parts]})


_TOUCHED = [c.split(" ")[0] for c in TOUCHED_COLUMNS.split(", ")]


def _source_features(state: DataFrame, source: str) -> DataFrame:
    """Long features of one source from the newest rows of the entities at hand."""
    own = state.where(F.col("source_table") == source)
    rows = own.select(F.from_json("payload", PAYLOAD_SCHEMAS[source]).alias("p")).select("p.*").withColumn(
        MANIFEST, F.lit("stream")
    )
    if source == "application_train":
        rows = rows.fillna(0, DOCUMENT_FLAGS)
    members = [f for f in FEATURES if f.source == source]
    wide = run_specs({source: rows}, members)[0]
    # The time of a value is that of the newest row behind it, so a late row of an older time still
    # replaces the value it corrects.
    entities = own.groupBy("entity_id").agg(
        F.max_by(F.struct("event_time", "event_id", "topic"), F.struct("event_time", "event_id")).alias("_newest")
    ).select(
        "entity_id", F.col("_newest.event_time").alias("event_time"),
        F.col("_newest.event_id").alias("source_event_id"), F.col("_newest.topic").alias("source_topic"),
    )
    # An entity whose rows were all filtered out still gets its NULLs.
    keyed = wide.withColumn("entity_id", F.concat(F.lit("SK_ID_CURR:"), F.col("SK_ID_CURR").cast("string")))
    ids = ["entity_id", "event_time", "source_event_id", "source_topic"]
    return to_long(entities.join(keyed, "entity_id", "left"), ids, [f.feature_id for f in members])


def recompute(rows: DataFrame, sources: Iterable[str] = tuple(STREAM_TABLES.values())) -> DataFrame:
    """Features of the sources and entities in ``rows``, from all their newest rows."""
    return reduce(DataFrame.unionByName, [_source_features(rows, source) for source in sources])


def corrections_of(rows: DataFrame, updates: DataFrame, sources: Iterable[str] = tuple(STREAM_TABLES.values()), tolerance: float = 1e-9) -> DataFrame:
    """The values that late rows change: old and new value, the late event, and the update that asserts the new one.

    ``rows`` is what the state handed on. Values are compared for the entities and tables with a late row only;
    sums may differ by ``tolerance`` relative to the value, for they depend on the order of rows.
    """
    late = rows.where("route = 'correction'").groupBy("source_table", "entity_id").agg(
        F.min_by("event_id", F.struct("event_time", "event_id")).alias("late_event_id"), F.min("event_time").alias("late_time"))
    was = recompute(rows.where("was").join(late, ["source_table", "entity_id"], "left_semi"), sources).select(
        "entity_id", "feature_id", F.col("feature_value").alias("old_value"))
    source_of = F.create_map(*[F.lit(x) for f in FEATURES for x in (f.feature_id, f.source)])
    now = updates.withColumn("source_table", source_of[F.col("feature_id")]).join(late, ["source_table", "entity_id"])
    old, new = F.col("old_value"), F.col("feature_value")
    same = old.eqNullSafe(new) | F.coalesce(F.abs(old - new) <= F.greatest(F.lit(1.0), F.abs(old)) * tolerance, F.lit(False))
    both = now.join(was, ["entity_id", "feature_id"], "left").where(~same)
    return both.select("entity_id", "feature_id", "old_value", F.col("feature_value").alias("new_value"), "late_event_id", "late_time", "feature_update_id")


def process_touched(
    rows: DataFrame, batch_id: int, tables: StreamTables, outbox: str | None = None, fmt: str = "parquet", topic_prefix: str = "credit",
) -> None:
    """What one micro-batch changed: updates, corrections, violations, letters of rows that came too late."""
    # Read by every branch. Each batch writes over what the one before left there.
    rows, touched = rows.withColumn("event_time", F.timestamp_micros("at")), tables.path("touched")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(touched)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(touched)
    kinds = rows.select("route", "source_table", "now").distinct().collect()  # five routes, three tables
    routes, named = {k.route for k in kinds}, topics(topic_prefix)
    for route, name in (("too_late", "late_dead_letters"), ("violation", "violations")):
        if route in routes:
            _write_batch(rows.where(F.col("route") == route).drop("was", "now", "at"), tables, name, batch_id)
    sources = sorted({k.source_table for k in kinds if k.now})
    if not sources:
        return
    updates = _written_batch(feature_updates(recompute(rows.where("now"), sources)), tables, "updates", batch_id, UPDATE_COLUMNS)
    sent = [(updates, "feature_updates")]
    if "correction" in routes:
        late = sorted({k.source_table for k in kinds if k.route == "correction"})
        corrections = _written_batch(corrections_of(rows, updates, late), tables, "corrections", batch_id, CORRECTION_COLUMNS)
        sent.append((corrections, "corrections"))
    for messages, topic in sent if outbox else []:
        write_updates(messages, outbox, named[topic].name, fmt)


def start_features(
    spark: SparkSession, tables: StreamTables, points: DataFrame | None = None, lateness: timedelta | None = None,
    delay: str = WATERMARK_DELAY, files: int | None = None, outbox: str | None = None, fmt: str = "parquet", topic_prefix: str = "credit", **trigger,
):
    """Keep features up to date from what the intake accepted, at most ``files`` files of it per micro-batch.

    Without ``lateness`` every time is accepted, without ``points`` there is no boundary.
    """
    reader = spark.readStream.schema(_marked_schema(spark))
    accepted = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(tables.path("marked")).where("accepted")
    accepted = past_boundary(accepted, points) if points is not None else accepted.withColumn("blocked", F.lit(False))
    touched = keep_newest(accepted.withWatermark("event_time", delay), lateness)
    return touched.writeStream.option("checkpointLocation", tables.path("features-checkpoint")).foreachBatch(
        lambda df, batch_id: process_touched(df, batch_id, tables, outbox, fmt, topic_prefix)).trigger(**(trigger or {"availableNow": True})).start()


def start_letters(spark: SparkSession, tables: StreamTables, outbox: str, fmt: str = "parquet", topic_prefix: str = "credit", **trigger):
    """Send what the intake refused to the topic of dead letters; a batch whose send fails is sent again."""
    refused = spark.readStream.schema(_marked_schema(spark)).parquet(tables.path("marked")).where("NOT accepted")

    def send(df: DataFrame, _: int) -> None:
        letters = split_messages(df)[1].withColumn("entity_id", F.lit(None).cast("string"))
        identity = F.sha2(F.concat_ws("\n", "origin", "payload"), 256)
        write_updates(letters.withColumn("letter_id", F.concat(F.lit("sha256:"), identity)), outbox, topics(topic_prefix)["dlq"].name, fmt)

    return refused.writeStream.option("checkpointLocation", tables.path("letters-checkpoint")).foreachBatch(send).trigger(
        **(trigger or {"availableNow": True})).start()


def run_feature_stream(raw: DataFrame, tables: StreamTables, words: dict[str, list[str]] = TEXT_WORDS, outbox: str | None = None, **options) -> None:
    """All that is there now, through intake, features and letters."""
    spark = raw.sparkSession
    start_intake(raw, tables, words).awaitTermination()
    start_features(spark, tables, outbox=outbox, **options).awaitTermination()
    if outbox:
        start_letters(spark, tables, outbox).awaitTermination()


def upsert_latest(updates: DataFrame, batch_id: int, tables: StreamTables) -> None:
    """Add a batch of updates; done again it replaces itself."""
    _write_batch(updates, tables, "updates", batch_id)


def latest_values(spark: SparkSession, tables: StreamTables, columns: Iterable[str] | None = None) -> DataFrame:
    """The newest update per entity and feature, or ``columns`` of it; of equal event times that of the later batch.

    Partial aggregation keeps one row per key and task. Spark reads and moves the whole of it where no columns are named.
    """
    updates = read_batches(spark, tables, "updates", UPDATE_COLUMNS)
    keys = ["entity_id", "feature_id"]
    row = F.struct(*[c for c in columns or updates.columns if c not in keys])
    newest = updates.groupBy(*keys).agg(F.max_by(row, F.struct("event_time", "batch")).alias("_row"))
    return newest.select(*keys, "_row.*").drop("batch")


def compact_updates(spark: SparkSession, tables: StreamTables) -> StreamTables:
    """Only the newest update per entity and feature, as a new set of tables beside these, for those who read them."""
    compacted = StreamTables(tables.path("compacted"))
    _write_batch(latest_values(spark, tables), compacted, "updates", 0)
    return compacted


def corrected_predictions(spark: SparkSession, tables: StreamTables, predictions: DataFrame) -> DataFrame:
    """Corrections with the predictions that had used the old value, one row each; the predictions stay as they are.

    ``predictions`` has prediction_id, entity_id and prediction_time. One made at or after the late row's time
    would have seen that row; one made before does not depend on it.
    """
    corrections = read_batches(spark, tables, "corrections", CORRECTION_COLUMNS)
    made = predictions.select("prediction_id", F.col("entity_id").alias("_entity"), "prediction_time")
    on = (F.col("entity_id") == F.col("_entity")) & (F.col("prediction_time") >= F.col("late_time"))
    return corrections.join(made, on, "left").drop("_entity")
