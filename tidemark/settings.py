"""Fixed values shared by every job.

The names, seeds, limits and word lists below are part of the data contract: changing one changes
ids, splits or accepted values, so they are stated once, here.
"""

from __future__ import annotations

from typing import NamedTuple

DATASET = "home_credit"

# Prediction boundary, fixed values.
ANCHOR_UTC = "2000-01-01T00:00:00Z"
LABEL_MATURITY_DAYS = 365
BOUNDARY_VERSION = "hc-boundary-v1"
POINTS_VERSION = "hc-pp-v1"
BRONZE_VERSION = "hc-bronze-v1"
FEATURES_VERSION = "hc-features-v1"
ADAPTER_VERSION = "1.0.0"
SPLIT_SEED = 20260723
SPLIT_MODULUS = 10000
TRAIN_UPPER = 8000
VALIDATION_UPPER = 9000

# Ids of the feature groups, fixed values.
APPLICATION_AFFORDABILITY = "application_affordability"
APPLICATION_DEMOGRAPHICS = "application_demographics"
APPLICATION_DOCUMENTS = "application_documents"
APPLICATION_EXTERNAL_SCORES = "application_external_scores"
BUREAU_GROUP = "bureau_credit_history"
BALANCE_GROUP = "bureau_delinquency_history"

# Source files and the columns each must have, fixed values.
REQUIRED_COLUMNS = {
    "application_train.csv": ["SK_ID_CURR", "TARGET"],
    "bureau.csv": ["SK_ID_CURR", "SK_ID_BUREAU"],
    "bureau_balance.csv": ["SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS"],
}

# Lineage columns, fixed values.
MANIFEST = "_source_manifest_sha256"
BRONZE_COLUMNS = [
    "_source_file_name",
    "_source_file_sha256",
    "_source_header_sha256",
    "_source_manifest_sha256",
    "_source_snapshot_id",
    "_bronze_schema_version",
    "_raw_row_sha256",
]

DOCUMENT_FLAGS = [f"FLAG_DOCUMENT_{i}" for i in range(2, 22)]

# Silver types by table, fixed values. The scores and document flags are typed here as well, because
# ANSI arithmetic on strings fails.
SILVER_TYPES = {
    "application_train": {
        "SK_ID_CURR": "INT", "TARGET": "INT",
        "AMT_INCOME_TOTAL": "DOUBLE", "AMT_CREDIT": "DOUBLE", "AMT_ANNUITY": "DOUBLE",
        "AMT_GOODS_PRICE": "DOUBLE", "CNT_CHILDREN": "INT", "DAYS_BIRTH": "INT",
        "DAYS_EMPLOYED": "INT", "FLAG_OWN_CAR": "INT", "FLAG_OWN_REALTY": "INT",
        "EXT_SOURCE_1": "DOUBLE", "EXT_SOURCE_2": "DOUBLE", "EXT_SOURCE_3": "DOUBLE",
        **{flag: "INT" for flag in DOCUMENT_FLAGS},
    },
    "bureau": {
        "SK_ID_CURR": "INT", "SK_ID_BUREAU": "INT", "DAYS_CREDIT": "INT",
        "CREDIT_DAY_OVERDUE": "INT", "DAYS_CREDIT_ENDDATE": "INT",
        "AMT_CREDIT_MAX_OVERDUE": "DOUBLE", "AMT_CREDIT_SUM": "DOUBLE",
        "AMT_CREDIT_SUM_DEBT": "DOUBLE", "AMT_CREDIT_SUM_OVERDUE": "DOUBLE",
        "CNT_CREDIT_PROLONG": "INT",
    },
    "bureau_balance": {
        "SK_ID_BUREAU": "INT", "SK_ID_CURR": "INT", "MONTHS_BALANCE": "INT",
    },
}

# Accepted words, fixed values.
SPLITS = ["train", "validation", "oot", "online"]
TRAINING_SPLITS = ["train", "validation", "oot"]
EVENT_TYPES = [
    "loan_application", "bureau_snapshot", "prev_application", "installment_payment",
    "credit_card_balance", "pos_cash_balance", "document_uploaded", "document_parsed",
    "prediction_request", "prediction_result", "label_feedback", "feature_correction",
]
ENTITY_TYPES = ["customer", "loan_application", "transaction", "document"]
STAGES = [
    "pre_application", "application", "decision", "post_decision", "post_outcome", "label_derived",
]
LEAKAGE_RISKS = ["none", "temporal", "post_outcome", "label_derived", "unknown"]
LINKAGES = ["unlinked", "verified", "synthetic"]
BALANCE_STATUSES = ["0", "1", "2", "3", "4", "5", "C", "X"]
CREDIT_STATES = ["Active", "Closed"]

# Stream event type, the table it updates, fixed values.
STREAM_TABLES = {
    "application_upsert": "application_train",
    "bureau_upsert": "bureau",
    "bureau_balance_upsert": "bureau_balance",
}
STREAM_SCHEMA_VERSION = 1


class Boundary(NamedTuple):
    """Where a prediction stands in time and how entities are split."""

    dataset: str = DATASET
    anchor: str = ANCHOR_UTC
    maturity_days: int = LABEL_MATURITY_DAYS
    version: str = BOUNDARY_VERSION
    seed: int = SPLIT_SEED
    modulus: int = SPLIT_MODULUS
    train_upper: int = TRAIN_UPPER
    validation_upper: int = VALIDATION_UPPER
