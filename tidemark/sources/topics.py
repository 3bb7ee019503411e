"""Event topics as streaming or batch tables: Kafka where its connector is present, files otherwise."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.readwriter import DataStreamWriter


class Topic(NamedTuple):
    name: str
    partitions: int = 3
    cleanup: tuple[str, ...] = ("delete",)


def topics(prefix: str = "credit") -> dict[str, Topic]:
    """The topics of a deployment: three sources, feature updates, corrections, dead letters."""
    named = {k: Topic(f"{prefix}.{k}.v1") for k in ("application", "bureau", "bureau_balance", "corrections", "dlq")}
    return named | {"feature_updates": Topic(f"{prefix}.feature_updates.v1", cleanup=("compact", "delete"))}


def source_topics(prefix: str = "credit") -> list[str]:
    return [topics(prefix)[k].name for k in ("application", "bureau", "bureau_balance")]


RAW_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])


def read_events(spark: SparkSession, location: str, fmt: str = "parquet", names: list[str] | None = None,
                stream: bool = True, **options: str) -> DataFrame:
    """Raw messages: topic, key, value.

    ``location`` is a folder of files with these columns, or the broker list for ``fmt="kafka"``.
    """
    reader = spark.readStream if stream else spark.read
    reader = reader.format(fmt).options(**options)
    if fmt == "kafka":
        raw = reader.option("kafka.bootstrap.servers", location).option(
            "subscribe", ",".join(names or source_topics())
        ).load()
        return raw.select("topic", F.col("key").cast("string"), F.col("value").cast("string"))
    raw = reader.schema(RAW_SCHEMA).load(location)
    return raw.where(F.col("topic").isin(names)) if names else raw


def as_messages(df: DataFrame, topic: str) -> DataFrame:
    """Rows as messages keyed by entity, so that one entity stays in order."""
    return df.select(
        F.lit(topic).alias("topic"), F.col("entity_id").alias("key"),
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"),
    )


def write_updates(df: DataFrame, location: str, topic: str, fmt: str = "parquet", checkpoint: str | None = None,
                  **options: str) -> DataStreamWriter | None:
    """Send rows to a topic. A batch is written at once; for a stream the writer is returned."""
    messages = as_messages(df, topic)
    target = {"kafka.bootstrap.servers": location} if fmt == "kafka" else {"path": location}
    if df.isStreaming:
        writer = messages.writeStream.format(fmt).options(**target, **options)
        return writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    packed = {"compression": "zstd"} if fmt == "parquet" else {}
    messages.write.format(fmt).mode("append").options(**packed | target | options).save()
    return None
