"""Feature computation: one aggregate per source, joined one-to-one, then turned long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import entity_number
from tidemark.operators.catalog import FEATURE_IDS, FEATURES, Feature
from tidemark.settings import MANIFEST

KEY = "SK_ID_CURR"


def run_specs(sources: dict[str, DataFrame], specs: list[Feature]) -> list[DataFrame]:
    """Evaluate specs; those with the same source, filter and key share one scan and one aggregate.

    Aggregates are keyed by snapshot and entity. The first shuffle carries partial aggregates, so an
    entity that owns a third of the rows costs no more than any other.
    """
    plans: dict[tuple, list[Feature]] = {}
    for spec in specs:
        plans.setdefault((spec.source, spec.input_filter, spec.key), []).append(spec)
    results = []
    for (source, condition, key), members in plans.items():
        rows = sources[source]
        if condition:
            rows = rows.where(condition)
        columns = [F.expr(m.expression).cast("double").alias(m.feature_id) for m in members]
        if key is None:
            results.append(rows.select(MANIFEST, F.col(KEY).cast("bigint").alias(KEY), *columns))
        else:
            results.append(rows.groupBy(MANIFEST, F.col(key).cast("bigint").alias(KEY)).agg(*columns))
    return results


def _one_source(rows: DataFrame, source: str) -> DataFrame:
    return run_specs({source: rows}, [f for f in FEATURES if f.source == source])[0]


def app_features(app: DataFrame) -> DataFrame:
    return _one_source(app, "application_train")


def bureau_features(bureau: DataFrame) -> DataFrame:
    return _one_source(bureau, "bureau")


def balance_features(balance: DataFrame) -> DataFrame:
    return _one_source(balance, "bureau_balance")


def assemble(points: DataFrame, *groups: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Wide features per prediction point; an entity without child rows keeps NULLs.

    ``carry`` names further columns of the points that stay.

    The join key is the numeric id, which is how the groups are already partitioned, so their
    aggregates are not shuffled again.
    """
    wide = points.select(
        "prediction_id", "entity_id", "prediction_time", MANIFEST, *(carry or []), entity_number(F.col("entity_id")).alias(KEY)
    )
    for group in groups:
        wide = wide.join(group, [MANIFEST, KEY], "left")
    return wide.drop(KEY)


def to_long(wide: DataFrame, ids: list[str], features: list[str] = FEATURE_IDS) -> DataFrame:
    """One row per id columns and feature, NULL values kept."""
    values = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
    return wide.select(*ids, *values).unpivot(ids, [f"`{f}`" for f in features], "feature_id", "feature_value")


def feature_values(points: DataFrame, app: DataFrame, bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Long feature values of all catalog features."""
    wide = assemble(points, app_features(app), bureau_features(bureau), balance_features(balance))
    ids = ["prediction_id", "entity_id", "prediction_time", MANIFEST]
    return to_long(wide, ids).select(
        "prediction_id", "entity_id", "prediction_time", "feature_id", "feature_value", MANIFEST
    )


def to_wide(values: DataFrame, features: list[str] = FEATURE_IDS) -> DataFrame:
    """Training view: one row per prediction, one column per feature."""
    return values.groupBy("prediction_id", "entity_id").pivot("feature_id", features).agg(F.first("feature_value"))
