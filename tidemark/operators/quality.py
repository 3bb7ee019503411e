"""Data-quality checks. Each returns its findings as a DataFrame and counts before it joins."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle


def check_pk(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, rows with a NULL in the key, keys that occur more than once."""
    is_null = reduce(or_, [F.col(c).isNull() for c in columns])
    keys = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return keys.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(is_null, F.col("_n"))), F.lit(0)).alias("null_rows"),
        F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
    )


def check_fk(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """Child keys without a parent and how many rows carry them; NULL keys are no reference."""
    keys = child.where(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count(F.lit(1)).alias("rows"))
    parents = parent.select(F.col(parent_key or child_key).alias("_parent")).distinct()
    return keys.join(parents, F.col(child_key) == F.col("_parent"), "left_anti")


def check_closure(source: DataFrame, written: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows in, rows out and growth, per ``keys`` or overall."""
    keys = keys or []
    sides = source.select(*keys, F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        written.select(*keys, F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    return sides.groupBy(*keys).agg(
        F.coalesce(F.sum("i"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("written_rows"),
    ).withColumn("growth", F.col("written_rows") - F.col("source_rows"))


def as_of(df: DataFrame, offset: str) -> DataFrame:
    """Facts at or before the prediction; an unknown offset is not admitted."""
    return df.where(F.col(offset) <= 0)


def split_rows(points: DataFrame, split: str = "train") -> DataFrame:
    return points.where(F.col("split") == split)


def check_feature_closure(values: DataFrame, catalog: DataFrame, points: DataFrame) -> DataFrame:
    """Breaches of "every prediction has exactly the catalog's features, once each".

    One row per breach: a pair that occurs twice, a feature nobody declared, a prediction of ``points``
    with too few declared features (0 rows if it has none), a declared feature without any value row, a
    prediction that is no point.
    """
    declared = sorted(r.feature_id for r in catalog.select("feature_id").where("feature_id is not null").distinct().collect())
    # One row per prediction with a counter per declared feature: a map task holds predictions, not their values. Values of
    # other features, null ones too, are counted apart; a partial sum over all pairs would not make them fewer.
    is_known = F.coalesce(F.col("feature_id").isin(declared), F.lit(False))
    counters = [f"_n{i}" for i in range(len(declared))]
    counted = settle(values.groupBy("prediction_id").agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("feature_id") == f).alias(n) for f, n in zip(declared, counters)]), "counted")
    known_rows = sum((F.col(n) for n in counters), F.lit(0))
    odd = values.where(~is_known).groupBy("prediction_id", "feature_id").agg(F.count(F.lit(1)).alias("_n"))
    # Without such values the rows are not read again.
    odd = odd.limit(0) if counted.where(F.col("_all") > known_rows).isEmpty() else settle(odd, "unknown")
    had = sum((F.col(n).cast("boolean").cast("int") for n in counters), F.lit(0)).cast("bigint")
    nothing = F.lit(None).cast("string")

    def breach(name: str, prediction: Column, feature: Column, rows: Column) -> list[Column]:
        return [F.lit(name).alias("breach"), prediction.alias("prediction_id"), feature.alias("feature_id"), rows.alias("rows")]

    own, feature = F.col("prediction_id"), F.col("feature_id")
    pairs = counted.select(own, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature_id"), F.col(n).alias("_n")) for f, n in zip(declared, counters)
    ]))) if declared else odd.limit(0)
    twice = pairs.unionByName(odd).where("_n > 1").select(*breach("duplicate_pair", own, feature, F.col("_n")))
    extra = odd.groupBy("feature_id").agg(F.sum("_n").alias("rows")).select(*breach("unknown_feature", nothing, feature, F.col("rows")))
    seen = pairs.where("_n > 0").select("feature_id").distinct()
    absent = catalog.select("feature_id").join(seen, "feature_id", "left_anti").select(
        *breach("absent_feature", nothing, feature, F.lit(0).cast("bigint")))
    wanted = points.select("prediction_id").distinct()
    short = wanted.join(counted.select("prediction_id", had.alias("_had")), "prediction_id", "left").select(
        *breach("incomplete_prediction", own, nothing, F.coalesce("_had", F.lit(0)))).where(F.col("rows") < len(declared))
    stray = counted.join(wanted, "prediction_id", "left_anti").select(*breach("unknown_prediction", own, nothing, F.col("_all")))
    return twice.unionByName(extra).unionByName(absent).unionByName(short).unionByName(stray)


def set_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, marked with the side."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(
        right.join(left, keys, "left_anti").withColumn("side", F.lit("right"))
    )
