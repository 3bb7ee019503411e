"""Features from partial states: what rows of a source add up to, kept apart from what is read off it.

A state holds sums and maxima only, so states of any disjoint sets of rows merge into that of all of them:
those of two snapshots into the features of both without a second look at the old rows, and those of all
times up to a prediction into the features as of that prediction.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.catalog import DELINQUENT, FEATURES, LEVEL, NEWEST_STATUS
from tidemark.operators.features import KEY
from tidemark.operators.ranks import in_order
from tidemark.session import settle


class Part(NamedTuple):
    """One number of a state: the ``sum`` or ``max`` of a value that each row has."""

    name: str
    value: str  # Spark SQL over the silver columns
    how: str = "sum"

    def of(self, column: Column | str) -> Column:
        return F.sum(column) if self.how == "sum" else F.max(column)

    def both(self, one: Column, two: Column) -> Column:
        return F.coalesce(one, F.lit(0)) + F.coalesce(two, F.lit(0)) if self.how == "sum" else F.greatest(one, two)


def _money(name: str, column: str) -> list[Part]:
    return [Part(name, f"coalesce({column}, 0D)"), Part(f"{name}_rows", f"bigint({column} IS NOT NULL)")]


def _counted(name: str, condition: str) -> Part:
    return Part(name, f"bigint(coalesce({condition}, false))")


PARTS = {
    "bureau": [
        Part("rows", "1L"), _counted("active", "CREDIT_ACTIVE = 'Active'"), _counted("closed", "CREDIT_ACTIVE = 'Closed'"),
        *_money("credit", "AMT_CREDIT_SUM"), *_money("debt", "AMT_CREDIT_SUM_DEBT"), *_money("overdue", "AMT_CREDIT_SUM_OVERDUE"),
        Part("days", "bigint(DAYS_CREDIT)"), _counted("recent", "DAYS_CREDIT BETWEEN -365 AND 0"),
    ],
    "bureau_balance": [
        Part("rows", "1L"), _counted("delinquent", DELINQUENT), Part("level", LEVEL, "max"), Part("newest", NEWEST_STATUS, "max"),
    ],
}

#: Each feature from the parts of its source.
FINISH = {
    "bureau.record_count": "double(rows)",
    "bureau.active_count": "double(active)",
    "bureau.closed_count": "double(closed)",
    "bureau.credit_sum_total": "CASE WHEN credit_rows > 0 THEN credit END",
    "bureau.debt_sum_total": "CASE WHEN debt_rows > 0 THEN debt END",
    "bureau.overdue_sum_total": "CASE WHEN overdue_rows > 0 THEN overdue END",
    "bureau.days_credit_mean": "double(days) / rows",
    "bureau.recent_12m_count": "double(recent)",
    "bureau_balance.month_count": "double(rows)",
    "bureau_balance.delinquent_month_count": "double(delinquent)",
    "bureau_balance.max_delinquency_level": "double(level)",
    "bureau_balance.latest_status_delinquent": "double(pmod(newest, 2BD))",
}


def partial_states(rows: DataFrame, source: str, keys: list[str] | None = None) -> DataFrame:
    """The state per key (the applicant) of the rows that the source's features read."""
    condition = next(f.input_filter for f in FEATURES if f.source == source)
    keys = keys or [KEY]
    return rows.where(condition).groupBy(*keys).agg(*[p.of(F.expr(p.value)).alias(p.name) for p in PARTS[source]])


def merge_states(old: DataFrame, delta: DataFrame, source: str, keys: list[str] | None = None) -> DataFrame:
    """The states of two disjoint sets of rows as one; no row is read again."""
    keys = keys or [KEY]
    both = old.unionByName(delta)
    return both.groupBy(*keys).agg(*[p.of(p.name).alias(p.name) for p in PARTS[source]])


def finish(states: DataFrame, source: str, keys: list[str] | None = None) -> DataFrame:
    """The features of a source, read off its states; a state of no rows gives NULLs."""
    names = [f.feature_id for f in FEATURES if f.source == source]
    some = F.col("rows") > 0
    return states.select(*(keys or [KEY]), *[F.when(some, F.expr(FINISH[n])).cast("double").alias(n) for n in names])


def states_as_of(
    points: DataFrame, facts: DataFrame, keys: list[str], times: dict[str, Column], fact_time: str, parts: list[Part],
    ranges: int | None = None,
) -> DataFrame:
    """Points with the state of all facts of their keys up to and including each of ``times``.

    ``times`` names columns of the points by a prefix for the parts; all of them are answered in one ordered
    pass. Facts of one time are merged first, then times of facts and points stand in one sequence per key,
    dealt over tasks by ranges of key and time. Sums run inside a range, and a table of one row per key
    and range holds what the key's earlier ranges add up to. So neither pairs of points and facts are formed
    nor does a key need a task of its own.
    """
    asked = settle(points.select("*", *[t.alias(f"_at_{name}") for name, t in times.items()]), "points")
    states = facts.where(F.col(fact_time).isNotNull()).groupBy(*keys, F.col(fact_time).alias("_time")).agg(
        *[p.of(F.expr(p.value)).alias(p.name) for p in parts])
    marks = asked.select(*keys, F.explode(F.array(*[F.col(f"_at_{name}") for name in times])).alias("_time")).where("_time IS NOT NULL").distinct()
    merged = settle(states.withColumn("_mark", F.lit(False)).unionByName(marks.withColumn("_mark", F.lit(True)), allowMissingColumns=True), "sequence")
    ordered = in_order(merged, keys, [F.col("_time"), F.col("_mark")], ranges)

    inside = Window.partitionBy(*keys, "_slot").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ordered.select(*keys, "_slot", "_time", "_mark", *[p.of(p.name).over(inside).alias(p.name) for p in parts]).where("_mark")
    per_slot = settle(ordered.groupBy(*keys, "_slot").agg(*[p.of(p.name).alias(p.name) for p in parts]), "slots")
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = per_slot.select(*keys, "_slot", *[p.of(p.name).over(earlier).alias(f"_before_{p.name}") for p in parts])
    found = local.join(before, [*keys, "_slot"]).select(
        *keys, "_time", *[p.both(F.col(p.name), F.col(f"_before_{p.name}")).alias(p.name) for p in parts])
    found = settle(found, "as-of")
    for name in times:
        own = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_time").alias("_found"), *[F.col(p.name).alias(f"{name}{p.name}") for p in parts])
        on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(f"_at_{name}") == F.col("_found")]
        asked = asked.join(own, on, "left").drop("_found", *[f"_{k}" for k in keys])
    return asked.drop(*[f"_at_{name}" for name in times])


def _day(time: Column) -> Column:
    return F.datediff(time, F.lit("1970-01-01").cast("date"))


def bureau_features_as_of(points: DataFrame, bureau: DataFrame, anchor: Column, time: str = "prediction_time", ranges: int | None = None) -> DataFrame:
    """Points (with SK_ID_CURR and ``time``) with the bureau features of the records known by each.

    DAYS_CREDIT counts from ``anchor``, a time that each record has; a record is known from its day on. At
    the anchor itself the values are those of ``bureau_features``.
    """
    parts = [p for p in PARTS["bureau"] if p.name != "recent"]
    facts = bureau.withColumn("DAYS_CREDIT", (_day(anchor) + F.col("DAYS_CREDIT")).cast("bigint"))
    today = _day(F.col(time)).cast("bigint")
    known = states_as_of(points, facts, [KEY], {"": today, "_old_": today - 366}, "DAYS_CREDIT", parts, ranges)
    known = known.withColumn("days", F.col("days") - F.col("rows") * today).withColumn("recent", F.col("rows") - F.coalesce("_old_rows", F.lit(0)))
    return finish(known, "bureau", points.columns)


def balance_features_as_of(points: DataFrame, balance: DataFrame, anchor: Column, time: str = "prediction_time", ranges: int | None = None) -> DataFrame:
    """The same with the balance features; MONTHS_BALANCE counts calendar months from the anchor's."""
    def month(t: Column) -> Column:
        return F.year(t) * 12 + F.month(t)

    facts = balance.withColumn("MONTHS_BALANCE", (month(anchor) + F.col("MONTHS_BALANCE")).cast("int"))
    known = states_as_of(points, facts, [KEY], {"": month(F.col(time))}, "MONTHS_BALANCE", PARTS["bureau_balance"], ranges)
    return finish(known, "bureau_balance", points.columns)
