"""Silver rows: typed columns, enrichment from a mapping table, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.settings import BRONZE_COLUMNS, MANIFEST


def business_columns(df: DataFrame) -> DataFrame:
    """Without the bronze lineage columns."""
    return df.drop(*BRONZE_COLUMNS)


def with_lineage(df: DataFrame, manifest_sha: str) -> DataFrame:
    return df.withColumn(MANIFEST, F.lit(manifest_sha))


def cast_by_map(df: DataFrame, types: dict[str, str], truncate: bool = True) -> DataFrame:
    """Typed by name; a value that does not fit becomes NULL; columns not named stay as they are.

    ``truncate`` lets ``12.5`` become the INT 12, as a lenient cast does.
    """
    def typed(name: str, kind: str) -> F.Column:
        c = F.col(f"`{name}`")
        if kind == "INT" and truncate:
            # Out-of-range numbers are NULL, and so are the special values.
            return F.coalesce(c.try_cast("int"), c.try_cast("double").try_cast("int"))
        return c.try_cast(kind.lower())

    return df.withColumns({c: typed(c, k) for c, k in types.items() if c in df.columns})


def enrich(df: DataFrame, mapping: DataFrame, key: str, adds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Left join to a mapping, with the evidence that it was safe to do.

    Returns the rows and one row of problems: keys that map to more than one value, and rows left
    without a value. ``df`` keeps its row count, because a key that maps twice contributes its
    smallest value only; the caller refuses to publish while either number is not 0.
    """
    pairs = mapping.select(key, *adds).where(F.col(key).isNotNull()).distinct()
    value = F.struct(*adds)
    one = pairs.groupBy(key).agg(F.min(value).alias("_value"), F.count(F.lit(1)).alias("_copies"))
    joined = df.join(one, key, "left")
    rows = joined.select(*df.columns, *[F.col(f"_value.{a}").alias(a) for a in adds])
    ambiguous = one.where("_copies > 1").agg(F.count(F.lit(1)).alias("ambiguous_keys"))
    missing = F.lit(False)
    for a in adds:
        missing = missing | F.col(a).isNull()
    # The keys without a value are counted on distinct keys, so a hot key is joined once only.
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).join(one, key, "left").select(
        "_rows", *[F.col(f"_value.{a}").alias(a) for a in adds]
    )
    unmatched = per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(missing, F.col("_rows"))), F.lit(0)).alias("unmatched_rows"),
    )
    problems = unmatched.select("rows", "unmatched_rows", ambiguous.scalar().alias("ambiguous_keys"))
    return rows, problems
