"""What changed between two snapshots, found by descending two digest trees from the root.

A stored snapshot is its row hashes with their keys, in folders by the first hexadecimal digits of the hash,
and a digest for every prefix up to that many digits. Two trees are compared one digit at a time, and only
prefixes whose digests differ are opened further; at the leaves only the folders of these prefixes are read.
So equal snapshots cost one comparison, and others what their changes touch.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits of the folders: at most 16 ** DIGITS prefixes, whatever the table holds.
DIGITS = 2


class StoredSnapshot(NamedTuple):
    root: str
    columns: str  # of the rows

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.columns).parquet(f"{self.root}/rows")

    def tree(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_TREE).parquet(f"{self.root}/tree")


_TREE = "depth int, prefix string, digest string, rows bigint"


def _digest(part: str) -> F.Column:
    return F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(part))), 256)


def store_snapshot(df: DataFrame, keys: list[str], hash_column: str, root: str, digits: int = DIGITS) -> StoredSnapshot:
    """Write a snapshot's hashes and keys, and its tree.

    A leaf's digest is that of the sorted hashes of finer groups of about equal size, so no task holds a leaf as a
    whole. Equal hashes are counted first, so copies of one row are one line.
    """
    rows = df.select(*keys, F.col(hash_column).alias("_hash"), F.substring(hash_column, 1, digits).alias("_prefix"))
    stored = StoredSnapshot(root, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
    rows.repartition("_prefix", F.substring("_hash", digits + 1, 1)).write.partitionBy("_prefix").parquet(f"{root}/rows")
    counted = stored.rows(df.sparkSession).groupBy(F.col("_hash")).agg(F.count(F.lit(1)).alias("n"))
    lines = counted.select(F.substring("_hash", 1, digits).alias("prefix"), F.substring("_hash", 1, digits + 3).alias("fine"),
                           F.concat("_hash", F.lit(":"), F.col("n").cast("string")).alias("line"), "n")
    fine = lines.groupBy("prefix", "fine").agg(_digest("line").alias("line"), F.sum("n").alias("n"))
    level = fine.groupBy("prefix").agg(_digest("line").alias("digest"), F.sum("n").alias("rows"))
    levels = [level.withColumn("depth", F.lit(digits))]
    for depth in range(digits - 1, -1, -1):
        named = levels[-1].select(F.substring("prefix", 1, depth).alias("prefix"), F.concat("prefix", F.lit("="), "digest").alias("line"), "rows")
        levels.append(named.groupBy("prefix").agg(_digest("line").alias("digest"), F.sum("rows").alias("rows")).withColumn("depth", F.lit(depth)))
    tree = levels[0]
    for more in levels[1:]:
        tree = tree.unionByName(more)
    tree.select("depth", "prefix", "digest", "rows").coalesce(1).write.parquet(f"{root}/tree")  # at most 2 * 16 ** digits rows
    return stored


def differing_prefixes(spark: SparkSession, old: StoredSnapshot, new: StoredSnapshot, digits: int = DIGITS) -> list[str]:
    """The leaves whose digests differ, by one comparison per digit; at most ``16 ** digits`` of them."""
    one, two = old.tree(spark), new.tree(spark)
    opened = [""]
    for depth in range(digits + 1):
        def level(tree: DataFrame, name: str) -> DataFrame:
            return tree.where((F.col("depth") == depth) & F.substring("prefix", 1, max(depth - 1, 0)).isin(opened)).select(
                "prefix", F.col("digest").alias(name))

        both = level(one, "a").join(level(two, "b"), "prefix", "full_outer")
        opened = [r.prefix for r in both.where("NOT a <=> b").select("prefix").collect()]
        if not opened:
            return []
    return sorted(opened)


def snapshot_difference(spark: SparkSession, old: StoredSnapshot, new: StoredSnapshot, keys: list[str], digits: int = DIGITS) -> DataFrame:
    """``keys``, ``change`` (removed or added) and ``rows``: how many rows of these values the new snapshot has less or more.

    A changed row is a removed and an added one. Only folders of leaves that differ are read.
    """
    opened = differing_prefixes(spark, old, new, digits)
    parts = [s.rows(spark).where(F.col("_prefix").isin(opened)).withColumn("_side", F.lit(side)) for s, side in ((old, -1), (new, 1))]
    net = parts[0].unionByName(parts[1]).groupBy(*keys, "_hash").agg(F.sum("_side").alias("net")).where("net <> 0")
    return net.select(*keys, F.when(F.col("net") < 0, "removed").otherwise("added").alias("change"), F.abs("net").alias("rows"))
