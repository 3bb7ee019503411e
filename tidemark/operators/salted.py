"""Joins on skewed keys: the heaviest keys are split over salts, and the other side is copied for those keys only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

#: A key is heavy from this share of the rows on, so there are at most ``1 / SHARE`` heavy keys.
SHARE = 1e-3


def heavy_keys(df: DataFrame, keys: list[str], share: float = SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the rows, with their rows ``n`` and the ``salts`` that split them.

    A part of a key holds at most that share. Partial counts come before the shuffle, and the result has fewer
    than ``1 / share`` rows whatever the table holds, so it may be broadcast.
    """
    counts = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(F.col("n") > F.lit(share * rows)).dropna(subset=keys)
    return heavy.withColumn("salts", F.ceil(F.col("n") / F.lit(max(share * rows, 1.0))).cast("int"))


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", share: float = SHARE) -> DataFrame:
    """``big`` joined with ``other`` on equal ``keys``, where some keys hold very many rows of ``big``.

    ``how`` is inner, left, left_semi or left_anti. A row's salt comes from its place in the written table, so a task
    that runs again deals it alike, and equal rows are split too. Rows of ``other`` are copied once for each salt of
    their key. NULL keys match nothing.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the side that is not salted cannot be the one that is kept")
    rows = settle(big, "salted-side").withColumn("_row", F.monotonically_increasing_id())
    heavy = F.broadcast(settle(heavy_keys(rows, keys, share).select(*keys, F.col("salts").alias("_salts")), "heavy-keys"))
    salted = rows.join(heavy, keys, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_row"), F.col("_salts"))).cast("int"))
    copies = other.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    joined = salted.drop("_row", "_salts").join(copies.drop("_salts"), [*keys, "_salt"], how)
    return joined.drop("_salt")
