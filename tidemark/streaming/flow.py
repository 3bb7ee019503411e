"""Stream operators: parse, deduplicate, window, route late rows, gate by prediction time, compare."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import checks
from tidemark.operators.contracts import TEXT_WORDS, feature_update_id, mark_mixed, mark_written
from tidemark.session import broadcast_if_small, settle
from tidemark.settings import FEATURES_VERSION

# Delay of the watermark, fixed value.
WATERMARK_DELAY = "5 minutes"

ENVELOPE_FIELDS = (
    "event_id string, schema_version int, event_type string, source_table string, source_pk string, "
    "entity_id string, op string, event_time string, produced_at string, payload string"
)


def parse_messages(raw: DataFrame) -> DataFrame:
    """Messages with the fields of their envelopes.

    The fields come out of a generator of one row, so that no filter on them parses the message again.
    """
    return raw.select("topic", "value", F.inline(F.array(F.from_json("value", ENVELOPE_FIELDS))))


def mark_messages(raw: DataFrame, words: dict[str, list[str]] = TEXT_WORDS) -> DataFrame:
    """Messages as envelopes, with the errors of each. Only those that are not in the form of their writers are parsed."""
    rows = raw.select("topic", "value")
    written, others = mark_written(rows if raw.isStreaming else settle(rows, "messages"), words)
    return written.unionByName(mark_mixed(parse_messages(others), words))


def split_messages(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid envelopes, and dead letters with code, origin and payload."""
    valid, broken = checks.split(marked)
    code = F.when(F.try_parse_json("value").isNull(), "not_json").otherwise("contract")
    dead = broken.select(code.alias("code"), "errors", F.col("topic").alias("origin"), F.col("value").alias("payload"))
    return valid.drop("value"), dead


def parse_events(raw: DataFrame, words: dict[str, list[str]] = TEXT_WORDS) -> tuple[DataFrame, DataFrame]:
    """Messages to envelopes; what breaks a rule becomes a dead letter."""
    return split_messages(mark_messages(raw, words))


def with_event_time(df: DataFrame, delay: str = WATERMARK_DELAY, column: str = "event_time") -> DataFrame:
    return df.withWatermark(column, delay)


def dedupe(df: DataFrame, delay: str = WATERMARK_DELAY, column: str = "event_time", key: str = "event_id") -> DataFrame:
    """The first row per id. Ids older than the watermark are forgotten, so sinks stay keyed by id."""
    if not df.isStreaming:
        return df.dropDuplicates([key])
    return with_event_time(df, delay, column).dropDuplicatesWithinWatermark([key])


def windowed(
    df: DataFrame, key: str, aggregates: list[Column], size: str | None = None, slide: str | None = None,
    gap: str | None = None, time: str = "event_time",
) -> DataFrame:
    """Aggregates per key and event-time window: tumbling, sliding with ``slide``, session with ``gap``."""
    frame = F.session_window(time, gap) if gap else F.window(time, size, slide or size)
    grouped = df.groupBy(frame.alias("_frame"), key).agg(*aggregates)
    return grouped.select(
        F.col("_frame.start").alias("window_start"), F.col("_frame.end").alias("window_end"),
        *[c for c in grouped.columns if c != "_frame"],
    )


def upsert_windows(aggregated: DataFrame, path: str, complete: bool = False, **trigger):
    """Run windowed aggregates so that open windows are returned too, each time that they change.

    Every micro-batch writes the windows it changed under its number (Spark has no such mode for sessions: with
    ``complete`` a batch writes all windows). ``current_windows`` reads them; a batch that is done again replaces itself.
    """
    def put(rows: DataFrame, batch_id: int) -> None:
        mode = rows.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
        mode.option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/windows")

    writer = aggregated.writeStream.outputMode("complete" if complete else "update").foreachBatch(put)
    return writer.option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def current_windows(spark: SparkSession, path: str, keys: list[str], complete: bool = False) -> DataFrame:
    """The newest state of each window and key, closed or open."""
    written = spark.read.parquet(f"{path}/windows")
    if complete:
        last = written.agg(F.max("batch").alias("batch"))
        return written.join(F.broadcast(last), "batch", "left_semi").drop("batch")
    keys = ["window_start", "window_end", *keys]
    row = F.struct(*[c for c in written.columns if c not in keys])
    return written.groupBy(*keys).agg(F.max_by(row, "batch").alias("_row")).select(*keys, "_row.*").drop("batch")


def route_late(
    batch: DataFrame, watermark: datetime | None, lateness: timedelta
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """On time, late within ``lateness`` (a correction), and too late.

    Stateful operators drop late rows silently, so this runs before them, against the largest event
    time of earlier batches minus the delay.
    """
    if watermark is None:
        nothing = batch.where(F.lit(False))
        return batch, nothing, nothing
    time = F.col("event_time")
    mark, limit = F.lit(watermark), F.lit(watermark - lateness)
    return batch.where(time >= mark), batch.where((time < mark) & (time >= limit)), batch.where(time < limit)


def boundary_gate(
    df: DataFrame, points: DataFrame, available: str = "event_time", keys: tuple[str, ...] = ("entity_id",), unknown: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Rows known by the prediction they feed, and the violations.

    Rows that name their prediction are judged by it (``keys`` entity and prediction); others by the
    earliest prediction of their entity, since they would feed that one too. ``unknown`` says whether a
    row without a point passes. ``points`` is static.
    """
    marked = past_boundary(df, points, available, keys, unknown, keep_time=True)
    return marked.where("NOT blocked").drop("prediction_time", "blocked"), marked.where("blocked").drop("blocked")


def past_boundary(
    df: DataFrame, points: DataFrame, available: str = "event_time", keys: tuple[str, ...] = ("entity_id",), unknown: bool = True,
    keep_time: bool = False,
) -> DataFrame:
    """Rows with ``blocked``: whether they were not known by the prediction they feed (see ``boundary_gate``)."""
    times = points.groupBy(*keys).agg(F.min("prediction_time").alias("prediction_time"))
    timed = df.join(broadcast_if_small(times), list(keys), "left")
    late = F.coalesce(F.col(available) > F.col("prediction_time"), F.lit(not unknown))
    marked = timed.withColumn("blocked", late)
    return marked if keep_time else marked.drop("prediction_time")


def boundary_gate_between_streams(
    events: DataFrame, points: DataFrame, horizon: str, delay: str = WATERMARK_DELAY, key: str = "entity_id",
) -> DataFrame:
    """Events with ``prediction_time`` and ``violation``, where the predictions are a stream of their own.

    An event meets the predictions of its entity within ``horizon`` of its time, on either side and whichever comes
    first; there is one row for each. Both sides carry a watermark, so Spark drops an event or a prediction
    from its state when no partner can come any more. An event without one passes when that is certain.
    """
    left = with_event_time(events, delay)
    right = points.select(F.col(key).alias("_key"), "prediction_time").withWatermark("prediction_time", delay)
    near = F.expr(
        f"{key} = _key AND prediction_time >= event_time - interval {horizon} AND prediction_time <= event_time + interval {horizon}")
    joined = left.join(right, near, "leftOuter").drop("_key")
    return joined.withColumn("violation", F.coalesce(F.col("event_time") > F.col("prediction_time"), F.lit(False)))


def feature_updates(features: DataFrame, version: int = 1) -> DataFrame:
    """Streamed feature values as updates.

    ``features`` is long: entity_id, feature_id, feature_value, event_time, source_event_id,
    source_topic.
    """
    c = F.col
    return features.select(
        feature_update_id(c("entity_id"), c("feature_id"), F.lit(version), c("event_time"), c("feature_value"))
        .alias("feature_update_id"),
        "entity_id", "feature_id", "feature_value", F.lit(version).alias("feature_version"), "event_time",
        F.greatest(F.current_timestamp(), c("event_time")).alias("computed_at"), "source_event_id", "source_topic",
        F.lit("stream").alias("computation_mode"), F.lit(FEATURES_VERSION).alias("feature_catalog_version"),
        F.lit("VALID").alias("quality_status"),
    )


def parity(batch: DataFrame, stream: DataFrame, exact: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Per feature: values that agree, differ, are missing on the stream, or exist there only.

    Features in ``exact`` must be equal, others may differ by ``tolerance`` relative to the value.
    """
    keys = ["entity_id", "feature_id"]
    left = batch.select(*keys, F.col("feature_value").alias("b"), F.lit(True).alias("in_batch"))
    right = stream.select(*keys, F.col("feature_value").alias("s"), F.lit(True).alias("in_stream"))
    b, s = F.col("b"), F.col("s")
    close = F.abs(b - s) <= F.greatest(F.lit(1.0), F.abs(b)) * tolerance
    same = b.eqNullSafe(s) | (~F.col("feature_id").isin(exact) & F.coalesce(close, F.lit(False)))
    state = (
        F.when(F.col("in_stream").isNull(), "missing").when(F.col("in_batch").isNull(), "extra")
        .when(same, "equal").otherwise("different")
    )
    marked = left.join(right, keys, "full_outer").withColumn("state", state)
    return marked.groupBy("feature_id").agg(*[
        F.count_if(F.col("state") == k).alias(k) for k in ("equal", "different", "missing", "extra")
    ])
