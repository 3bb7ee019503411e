"""Newest row per key and newest-known-at-the-time joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import in_order


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in ``order``.

    Spark prunes a ``row_number() = 1`` filter before the shuffle, so every task sends at most one
    row per key and a hot key stays small.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def first_value_per_key(df: DataFrame, keys: list[str], order: list[Column], column: str, name: str) -> DataFrame:
    """One row per key with ``column`` of its first row in ``order``."""
    return latest_per_key(df, keys, order).select(*keys, F.col(column).alias(name))


def top_rows(df: DataFrame, order: list[Column], n: int = 1) -> DataFrame:
    """Each task keeps its own best ``n`` rows before they are merged."""
    return df.orderBy(*order).limit(n)


def pit_join(
    points: DataFrame, facts: DataFrame, keys: list[str], point_time: str, fact_time: str,
    values: list[str], tie: list[str], tolerance: str | None = None,
) -> DataFrame:
    """For each point the newest fact of its keys at or before the point's time.

    Among facts of the same time the one with the greatest ``tie`` wins. ``tolerance`` (an interval,
    ``"90 days"``) drops older facts. Points without a fact keep NULLs.

    Pairs of points and facts are never formed: both sides are merged into one sequence in the order of
    key and time, dealt over tasks by ranges of both. The last fact is carried forward inside a range, and
    the last fact of the key's earlier ranges comes from a table of one row per key and range. So a hot key
    is spread over tasks however close its times are.
    """
    payload = F.struct(fact_time, *values)
    order = F.struct(*tie) if tie else F.lit(1)
    # One row per key and time on both sides, however many points or facts share it.
    fact_rows = facts.where(F.col(fact_time).isNotNull()).groupBy(*keys, F.col(fact_time).alias("_time")).agg(
        F.max_by(payload, order).alias("_fact")
    )
    point_rows = points.where(F.col(point_time).isNotNull()).select(*keys, F.col(point_time).alias("_time")).distinct()
    merged = fact_rows.withColumn("_is_point", F.lit(0)).unionByName(
        point_rows.withColumn("_is_point", F.lit(1)), allowMissingColumns=True
    )
    merged = in_order(merged, keys, [F.col("_time"), F.col("_is_point")])

    inside = Window.partitionBy(*keys, "_slot").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = merged.withColumn("_last", F.last("_fact", ignorenulls=True).over(inside)).where("_is_point = 1")

    per_slot = merged.groupBy(*keys, "_slot").agg(F.max_by("_fact", F.when(F.col("_is_point") == 0, F.col("_place")))
                                                  .alias("_newest"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = per_slot.select(*keys, "_slot", F.last("_newest", ignorenulls=True).over(earlier).alias("_carry"))

    found = carried.join(before, [*keys, "_slot"], "left").select(
        *keys, F.col("_time").alias(point_time), F.coalesce("_last", "_carry").alias("_hit")
    )
    if tolerance:
        fresh = F.col(f"_hit.{fact_time}") >= F.col(point_time) - F.expr(f"interval {tolerance}")
        found = found.withColumn("_hit", F.when(fresh, F.col("_hit")))
    return points.join(found, [*keys, point_time], "left").select(
        *points.columns, *[F.col(f"_hit.{c}").alias(c) for c in [fact_time, *values]]
    )
