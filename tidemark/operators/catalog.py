"""The feature catalog: one declaration per feature, used by batch, stream and validation alike."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.settings import (
    APPLICATION_AFFORDABILITY, APPLICATION_DEMOGRAPHICS, APPLICATION_DOCUMENTS, APPLICATION_EXTERNAL_SCORES, BALANCE_GROUP,
    BUREAU_GROUP, DOCUMENT_FLAGS,
)


class Feature(NamedTuple):
    feature_id: str
    name: str
    source: str  # application_train, bureau or bureau_balance
    kind: str  # ROW, AGGREGATE or LATEST
    group: str
    stage: str
    risk: str
    expression: str  # Spark SQL over the silver columns
    key: str | None = None
    input_filter: str | None = None


SCORES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
_PRESENT = " + ".join(f"int({s} IS NOT NULL)" for s in SCORES)
DELINQUENT = "STATUS IN ('1', '2', '3', '4', '5')"
# Newest month first, then the smallest bureau id; should one record have several rows for a month, a
# delinquent one wins. Month (INT), id (BIGINT) and the delinquency bit fit one DECIMAL(38), whatever their
# values, so the newest status is a plain maximum with a fixed-width buffer.
NEWEST_STATUS = (
    "CASE WHEN MONTHS_BALANCE IS NOT NULL AND SK_ID_BUREAU IS NOT NULL THEN "
    "CAST(MONTHS_BALANCE AS DECIMAL(10,0)) * 100000000000000000000BD "
    "+ (9223372036854775807BD - CAST(SK_ID_BUREAU AS DECIMAL(19,0))) * 2BD "
    f"+ CAST(int(coalesce({DELINQUENT}, false)) AS DECIMAL(1,0)) END"
)
# C and X count as level 0; any other text is no level.
LEVEL = f"CASE WHEN STATUS IN ('0', 'C', 'X') THEN 0 WHEN {DELINQUENT} THEN int(STATUS) END"


def _name(feature_id: str) -> str:
    """What people read: the words of the id."""
    return feature_id.replace("_", " ")


def _app(feature_id: str, group: str, expression: str) -> Feature:
    return Feature(f"app.{feature_id}", _name(feature_id), "application_train", "ROW", group,
                   "application", "none", expression)


def _bureau(feature_id: str, expression: str) -> Feature:
    return Feature(f"bureau.{feature_id}", f"bureau {_name(feature_id)}", "bureau", "AGGREGATE", BUREAU_GROUP,
                   "pre_application", "temporal", expression, "SK_ID_CURR", "DAYS_CREDIT <= 0")


def _balance(feature_id: str, expression: str, kind: str = "AGGREGATE") -> Feature:
    return Feature(f"bureau_balance.{feature_id}", f"balance {_name(feature_id)}", "bureau_balance", kind,
                   BALANCE_GROUP, "pre_application", "temporal", expression,
                   "SK_ID_CURR", "MONTHS_BALANCE <= 0")


FEATURES = [
    _app("credit_income_ratio", APPLICATION_AFFORDABILITY,
         "try_divide(AMT_CREDIT, AMT_INCOME_TOTAL)"),
    _app("annuity_income_ratio", APPLICATION_AFFORDABILITY,
         "try_divide(AMT_ANNUITY, AMT_INCOME_TOTAL)"),
    _app("credit_annuity_ratio", APPLICATION_AFFORDABILITY,
         "try_divide(AMT_CREDIT, AMT_ANNUITY)"),
    _app("goods_credit_ratio", APPLICATION_AFFORDABILITY,
         "try_divide(AMT_GOODS_PRICE, AMT_CREDIT)"),
    _app("age_years", APPLICATION_DEMOGRAPHICS,
         # Division by a decimal: the quotient keeps six places.
         "double(int(DAYS_BIRTH) / -365.25BD)"),
    _app("ext_source_mean", APPLICATION_EXTERNAL_SCORES,
         f"try_divide({' + '.join(f'coalesce({s}, 0D)' for s in SCORES)}, double({_PRESENT}))"),
    _app("ext_source_missing_count", APPLICATION_EXTERNAL_SCORES,
         f"double({len(SCORES)} - ({_PRESENT}))"),
    _app("document_flag_count", APPLICATION_DOCUMENTS,
         f"double({' + '.join(DOCUMENT_FLAGS)})"),
    _bureau("record_count", "double(count(1))"),
    _bureau("active_count", "double(count_if(CREDIT_ACTIVE = 'Active'))"),
    _bureau("closed_count", "double(count_if(CREDIT_ACTIVE = 'Closed'))"),
    _bureau("credit_sum_total", "sum(AMT_CREDIT_SUM)"),
    _bureau("debt_sum_total", "sum(AMT_CREDIT_SUM_DEBT)"),
    _bureau("overdue_sum_total", "sum(AMT_CREDIT_SUM_OVERDUE)"),
    _bureau("days_credit_mean", "avg(DAYS_CREDIT)"),
    _bureau("recent_12m_count", "double(count_if(DAYS_CREDIT BETWEEN -365 AND 0))"),
    _balance("month_count", "double(count(1))"),
    _balance("delinquent_month_count", f"double(count_if({DELINQUENT}))"),
    _balance("max_delinquency_level", f"double(max({LEVEL}))"),
    _balance("latest_status_delinquent", f"double(pmod(max({NEWEST_STATUS}), 2BD))", "LATEST"),
]

FEATURE_IDS = [f.feature_id for f in FEATURES]

CATALOG_SCHEMA = T.StructType([
    T.StructField("feature_id", T.StringType()),
    T.StructField("feature_name", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("feature_group", T.StringType()),
    T.StructField("source_system", T.StringType()),
    T.StructField("event_time_rule", T.StringType()),
    T.StructField("availability_rule", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("online_available", T.BooleanType()),
    T.StructField("ttl", T.LongType()),
    T.StructField("owner", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("leakage_risk", T.StringType()),
    T.StructField("semantic_group_id", T.StringType()),
    T.StructField("cost_unit", T.DoubleType()),
    T.StructField("lineage_expression", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

SPEC_SCHEMA = T.StructType([
    T.StructField("feature_id", T.StringType()),
    T.StructField("source_table", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("group_key", T.StringType()),
    T.StructField("batch_ref", T.StringType()),
    T.StructField("expression_sql", T.StringType()),
    T.StructField("input_filter_sql", T.StringType()),
    T.StructField("freshness_sla_seconds", T.IntegerType()),
    T.StructField("null_semantics", T.StringType()),
])

# Seconds a streamed value may lag, and what a missing source means. Fixed values.
FRESHNESS_SECONDS = 60
NULL_SEMANTICS = "NULL_IF_MISSING"


def feature_catalog(spark: SparkSession, owner: str = "feature-owners") -> DataFrame:
    """The catalog as a small table."""
    rows = [
        (
            f.feature_id, f.name, "application", f.group, f.source,
            f"{f.source} rows with {f.input_filter}" if f.input_filter else "application at prediction time",
            "known at prediction time", f.stage, False, None, owner, 1, f.risk, f.group, 1.0,
            f.expression, f.name, [],
        )
        for f in FEATURES
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def feature_specs(spark: SparkSession) -> DataFrame:
    """How each feature is computed, in batch and on the stream."""
    rows = [
        (
            f.feature_id, f.source, f.kind, f.key, "tidemark.operators.features:run_specs", f.expression,
            f.input_filter, FRESHNESS_SECONDS, NULL_SEMANTICS,
        )
        for f in FEATURES
    ]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def group_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f.feature_id, f.group) for f in FEATURES], "feature_id string, group_id string")
