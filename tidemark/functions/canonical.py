"""The only Python in the engine: number text that the JVM formats differently.

Both functions get Arrow batches and return one string per row.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.settings import DOCUMENT_FLAGS

# Payload columns that are numbers with a fraction, fixed values.
FRACTION_FIELDS = {
    "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE",
    "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
    "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE",
}


@F.pandas_udf(T.StringType())
def value_text(values: pd.Series) -> pd.Series:
    """17 significant digits, ``0`` for both zeros, ``null`` for a missing value."""

    def one(v: float) -> str | None:
        if v is None or v != v:
            return "null"
        if math.isinf(v):
            return None
        return "0" if v == 0 else f"{v:.17g}"

    return values.map(one)


@F.pandas_udf(T.StringType())
def payload_text(kinds: pd.Series, payloads: pd.Series) -> pd.Series:
    """A payload with sorted keys, NULLs left out, amounts as fractions, absent flags as 0."""

    def one(kind: str, text: str | None) -> str | None:
        if text is None:
            return None
        try:
            fields = json.loads(text)
            if kind == "application_upsert":
                for flag in DOCUMENT_FLAGS:
                    if fields.get(flag) is None:
                        fields[flag] = 0
            kept = {
                k: float(v) if k in FRACTION_FIELDS else v for k, v in fields.items() if v is not None
            }
            return json.dumps(kept, sort_keys=True, separators=(",", ":"), allow_nan=False)
        except (ValueError, TypeError, AttributeError):
            return None

    return pd.Series([one(k, t) for k, t in zip(kinds, payloads)], dtype="object")
