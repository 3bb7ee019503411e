"""Exact ranks and running sums over a total order, with no task that holds a whole group.

Rows are range-partitioned by key, value and tie-break, so one key, or one value of it, may span many
partitions. Each partition knows its place in the order; a table of one row per key and partition
turns places inside a partition into ranks inside the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import broadcast_if_small, settle

_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def in_order(df: DataFrame, keys: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """Sorted and written once, each row with its partition and its place in the whole order.

    ``ranges`` asks for a number of partitions; without it the session decides.
    """
    by = [F.col(k) for k in keys] + order
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    ordered = dealt.sortWithinPartitions(*by).withColumn("_place", place)
    return settle(ordered.withColumn("_slot", F.shiftright("_place", _SLOT_BITS)), "ordered")


def _before(per_slot: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """For each key and slot the sums over all earlier slots of the key, and over the whole key.

    The window runs over one row per key and partition.
    """
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return per_slot.select(
        *keys, "_slot", *[c for c in per_slot.columns if c not in {*keys, "_slot", *sums}],
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"_all_{s}") for s in sums],
    )


def global_ranks(df: DataFrame, keys: list[str], order: list[Column], counted: str | None = None) -> DataFrame:
    """Add ``rank`` (from 1) and ``group_rows`` within ``keys``. ``order`` must be total.

    With ``counted`` the group counts only rows where that column is not NULL.
    """
    ordered = in_order(df, keys, order)
    counted_rows = F.count(counted) if counted else F.count(F.lit(1))
    per_slot = ordered.groupBy(*keys, "_slot").agg(
        F.count(F.lit(1)).alias("n"), counted_rows.alias("c"), F.min("_place").alias("_first")
    )
    slots = broadcast_if_small(settle(_before(per_slot, keys, ["n", "c"]), "slots"))
    # Rows of one key are adjacent inside a slot, so the distance from the first one is the rank.
    return ordered.join(slots, [*keys, "_slot"]).select(
        *df.columns,
        (F.col("_before_n") + F.col("_place") - F.col("_first") + 1).alias("rank"),
        F.col("_all_c").alias("group_rows"),
    )


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """Add ``below_<s>`` (sum over earlier rows of the key) and ``total_<s>`` for each of ``sums``."""
    ordered = in_order(df, keys, order)
    per_slot = ordered.groupBy(*keys, "_slot").agg(*[F.sum(s).alias(s) for s in sums])
    slots = broadcast_if_small(settle(_before(per_slot, keys, sums), "slots"))
    # One window group is what one partition held, not what a key holds.
    inside = Window.partitionBy(*keys, "_slot").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    local = ordered.select(
        *df.columns, "_slot", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_local_{s}") for s in sums]
    )
    return local.join(slots, [*keys, "_slot"]).select(
        *df.columns,
        *[(F.col(f"_before_{s}") + F.col(f"_local_{s}")).alias(f"below_{s}") for s in sums],
        *[F.col(f"_all_{s}").alias(f"total_{s}") for s in sums],
    )


def equal_count_bins(df: DataFrame, keys: list[str], value: str, tie: str, bins: int = 4) -> DataFrame:
    """Add ``bin``: all bins hold ``max(n div bins, 1)`` values, the last one also the remainder.

    Rows without a value come last in the order, are not counted, and get a NULL bin.
    """
    size = F.greatest(F.floor(F.col("group_rows") / bins), F.lit(1))
    number = F.least(F.floor((F.col("rank") - 1) / size), F.lit(bins - 1)).cast("int")
    ranked = global_ranks(df, keys, [F.asc_nulls_last(value), F.col(tie)], value)
    return ranked.withColumn("bin", F.when(F.col(value).isNotNull(), number)).drop("rank")
