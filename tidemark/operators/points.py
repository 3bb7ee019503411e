"""Prediction points: who is predicted, when, in which split, with which label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import (
    assign_split,
    canonical_id,
    entity_id,
    hash_bucket,
    instant,
    parse_label,
    shift_days,
)
from tidemark.settings import MANIFEST, POINTS_VERSION, Boundary


def points_snapshot_id(manifest: F.Column, boundary: Boundary, version: str = POINTS_VERSION) -> F.Column:
    return canonical_id(manifest, F.lit(version), F.lit(boundary.version))


def build_points(
    application: DataFrame, boundary: Boundary = Boundary(), version: str = POINTS_VERSION,
    snapshot: F.Column | None = None,
) -> DataFrame:
    """One point per application row, as one projection without a shuffle.

    A row with a bad id or label gives NULL there; ``validate_points`` routes such rows.
    """
    snapshot = points_snapshot_id(F.col(MANIFEST), boundary, version) if snapshot is None else snapshot
    anchor = instant(boundary.anchor)
    rows = application.select(
        entity_id(F.col("SK_ID_CURR")).alias("entity_id"),
        parse_label(F.col("TARGET")).alias("label"),
        MANIFEST,
        snapshot.alias("snapshot_id"),
    )
    bucket = hash_bucket(F.col("entity_id"), boundary.seed, boundary.modulus, boundary.dataset)
    return rows.select(
        F.when(
            F.col("entity_id").isNotNull(),
            canonical_id(F.lit(boundary.dataset), F.col("entity_id"), F.col("snapshot_id"), F.lit(boundary.version)),
        ).alias("prediction_id"),
        "entity_id",
        anchor.alias("prediction_time"),
        assign_split(bucket, boundary).alias("split"),
        "snapshot_id",
        F.lit(boundary.version).alias("boundary_version"),
        "label",
        shift_days(anchor, F.lit(boundary.maturity_days)).alias("label_time"),
        MANIFEST,
        F.col("snapshot_id").alias("_silver_snapshot_id"),
    )
