"""Rules over rows: each rule yields an error struct where it is broken, rows are then routed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import trimmed

ENTITY_PATTERN = r"^SK_ID_CURR:[0-9]+\z"
PREFIXED_SHA_PATTERN = r"^sha256:[0-9a-f]{64}\z"
SHA_PATTERN = r"^[0-9a-fA-F]{64}\z"
ERRORS = "array<struct<field:string,message:string>>"


def rule(broken: Column, field: str, message: str) -> Column:
    """An array with the error, empty when the rule is kept.

    A condition that is NULL counts as kept, so test for NULL explicitly.
    """
    error = F.array(F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))
    return F.when(F.coalesce(broken, F.lit(False)), error).otherwise(F.array().cast(ERRORS))


def errors_of(rules: list[Column]) -> Column:
    """The errors of all rules. Behind a ``filter`` Spark evaluates them as expressions: as generated code they are one
    method, which with many rules is too long for the JVM to compile."""
    return F.flatten(F.filter(F.array(*rules), lambda e: F.size(e) > 0))


def blank(c: Column) -> Column:
    return c.isNull() | (F.length(trimmed(c)) == 0)


def with_errors(df: DataFrame, rules: list[Column]) -> DataFrame:
    """Add ``errors``.

    The column comes out of a generator of one row: a filter on it stays above, so that no rule and no
    parsing behind it is evaluated a second time inside the filter.
    """
    return df.select("*", F.inline(F.array(F.struct(errors_of(rules).alias("errors")))))


def split(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = F.size("errors") == 0
    return marked.where(kept).drop("errors"), marked.where(~kept)


def route(df: DataFrame, rules: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Split into rows that keep every rule and rows that break some, the latter with all errors."""
    return split(with_errors(df, rules))


def error_counts(quarantine: DataFrame) -> DataFrame:
    """Broken rules by field and message. Partial aggregation keeps a common error cheap."""
    return (
        quarantine.select(F.explode("errors").alias("e"))
        .groupBy(F.col("e.field").alias("field"), F.col("e.message").alias("message"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
