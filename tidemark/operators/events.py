"""Source rows to events, one per row."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.checks import blank, route, rule
from tidemark.functions.identity import (
    event_id,
    instant,
    normalize_id,
    shift_days,
    shift_months,
)
from tidemark.settings import ADAPTER_VERSION, Boundary


class EventSource(NamedTuple):
    """What every event of a run has in common."""

    snapshot_id: str
    manifest_sha: str
    ingested_at: str
    system: str = "source-adapter"
    adapter_version: str = ADAPTER_VERSION
    boundary: Boundary = Boundary()


def _event(rows: DataFrame, source: EventSource, table: str, kind: str, time: Column, record: Column) -> DataFrame:
    boundary = source.boundary
    anchor = instant(boundary.anchor)
    dataset, loan, sha = F.lit(boundary.dataset), F.lit("loan_application"), F.lit(source.manifest_sha)
    headers = {
        "snapshot_id": source.snapshot_id, "adapter_version": source.adapter_version,
        "boundary_version": boundary.version, "source_table": table,
        "availability_semantics": "application_snapshot",
    }
    # Everything the id is made of is a column first, so that it is evaluated once.
    parts = rows.select(
        normalize_id(F.col("SK_ID_CURR")).alias("number"), time.alias("event_time"), record.alias("source_record_id")
    )
    named = parts.select(
        F.concat(F.lit("SK_ID_CURR:"), "number").alias("entity_id"), F.concat(F.lit("customer:"), "number").alias("customer_id"),
        "event_time", "source_record_id",
    )
    no_text = F.lit(None).cast("string")
    identity = event_id(
        dataset, loan, F.col("entity_id"), F.lit(kind), F.col("event_time"), F.col("source_record_id"), sha, no_text
    )
    return named.select(
        dataset.alias("dataset_id"),
        identity.alias("event_id"),
        loan.alias("entity_type"),
        "entity_id",
        "customer_id",
        F.lit(kind).alias("event_type"),
        "event_time",
        anchor.alias("available_at"),
        instant(source.ingested_at).alias("ingested_at"),
        F.lit(source.system).alias("source_system"),
        F.lit(1).alias("schema_version"),
        "source_record_id",
        sha.alias("source_record_revision"),
        no_text.alias("payload_uri"),
        no_text.alias("payload_sha256"),
        F.create_map(*[F.lit(x) for pair in headers.items() for x in pair]).alias("headers"),
    )


def _bad_id(column: str) -> Column:
    return rule(normalize_id(F.col(column)).isNull(), column, "must be a decimal id")


def _bad_offset(column: str) -> list[Column]:
    return [
        rule(F.col(column).isNull(), column, "must be a whole number"),
        rule(F.col(column) > 0, column, "must not be after the prediction"),
    ]


def to_events(
    application: DataFrame, bureau: DataFrame, balance: DataFrame, source: EventSource
) -> tuple[DataFrame, DataFrame]:
    """Events of all three tables, and the rows that make none with their errors."""
    anchor = instant(source.boundary.anchor)
    apps, bad_apps = route(application.select("SK_ID_CURR"), [_bad_id("SK_ID_CURR")])
    loans, bad_loans = route(
        bureau.select("SK_ID_CURR", "SK_ID_BUREAU", "DAYS_CREDIT"),
        [_bad_id("SK_ID_CURR"), _bad_id("SK_ID_BUREAU"), *_bad_offset("DAYS_CREDIT")],
    )
    months, bad_months = route(
        balance.select("SK_ID_CURR", "SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS"),
        [
            _bad_id("SK_ID_CURR"), _bad_id("SK_ID_BUREAU"), *_bad_offset("MONTHS_BALANCE"),
            rule(blank(F.col("STATUS")), "STATUS", "must be non-empty"),
        ],
    )

    def record(table: str, *parts: Column) -> Column:
        return F.concat_ws(":", F.lit(table), *parts)

    bureau_id = normalize_id(F.col("SK_ID_BUREAU"))
    events = [
        _event(apps, source, "application_train", "loan_application", anchor,
               record("application_train", normalize_id(F.col("SK_ID_CURR")))),
        _event(loans, source, "bureau", "bureau_snapshot", shift_days(anchor, F.col("DAYS_CREDIT")),
               record("bureau", bureau_id)),
        _event(months, source, "bureau_balance", "bureau_snapshot", shift_months(anchor, F.col("MONTHS_BALANCE")),
               record("bureau_balance", bureau_id, F.col("MONTHS_BALANCE").cast("string"))),
    ]
    rejects = [
        df.select(F.lit(table).alias("source_table"), F.to_json(F.struct(*[c for c in df.columns if c != "errors"]))
                  .alias("row"), "errors")
        for table, df in (("application_train", bad_apps), ("bureau", bad_loans), ("bureau_balance", bad_months))
    ]
    return union_events(*events), union_events(*rejects)


def union_events(*frames: DataFrame) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
