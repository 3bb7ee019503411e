"""Content digest of a multiset of row hashes, without gathering the rows anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

# Rows per leaf the tree aims at, hex digits folded per level (16 ** 3 children) and levels. Fixed
# values: they decide the digest. Four levels reach 16 ** 9 leaves.
LEAF_LINES = 1024
FOLD_DIGITS = 3
LEVELS = 4
DIGEST_PATTERN = r"^[0-9a-f]{64}\z"


def _counted(df: DataFrame, hash_column: str) -> DataFrame:
    """Distinct hashes with their rows. A SHA-256 text travels as its 32 bytes (``b``), any other text as it is (``t``)."""
    h = F.col(hash_column)
    digest = F.coalesce(h.rlike(DIGEST_PATTERN), F.lit(False))
    return df.groupBy(F.when(digest, F.unhex(h)).alias("b"), F.when(~digest, h).alias("t")).agg(F.count(F.lit(1)).alias("n"))


def _text(b: F.Column, t: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.hex(b)), t)


def _hashed(lines: F.Column) -> F.Column:
    return F.sha2(F.concat_ws("", F.sort_array(lines)), 256)


def fingerprint(df: DataFrame, hash_column: str = "_raw_row_sha256", rows: int | None = None) -> DataFrame:
    """One row: digest, rows, distinct hashes, duplicates.

    Equal hashes are counted first. The sorted ``hash:count`` lines are hashed in leaves that share a
    prefix, then prefixes are folded three digits at a time. The prefix length follows from the number
    of rows, so a leaf holds about a thousand lines at any scale. Counts travel up with the digests. Without
    ``rows``, the number of rows, the counted hashes are written once and read twice.
    """
    counted = _counted(df, hash_column)
    counted = settle(counted, "hashes") if rows is None else counted
    known = F.sum("n") if rows is None else F.lit(rows)
    leaves = F.greatest(F.coalesce(known, F.lit(0)), F.lit(1)) / LEAF_LINES
    depth = F.greatest(F.lit(0), F.ceil(F.log(16.0, leaves) - 1e-9)).cast("int")
    found = counted.agg(depth).scalar() if rows is None else depth
    lines = F.transform(F.collect_list(F.struct("b", "t", "n")), lambda x: F.concat(
        _text(x["b"], x["t"]), F.lit(":"), x["n"].cast("string"), F.lit("\n")))
    digests = counted.withColumn("depth", found).select("*", _text(F.col("b"), F.col("t")).alias("h")).groupBy(
        F.expr("substring(h, 1, depth)").alias("prefix"), "depth").agg(
        _hashed(lines).alias("digest"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("hashes"))
    for _ in range(LEVELS - 1):
        shorter = F.greatest(F.col("depth") - FOLD_DIGITS, F.lit(0))
        parts = digests.select(
            F.substring("prefix", F.lit(1), shorter).alias("prefix"), shorter.alias("depth"),
            F.concat("prefix", F.lit("="), "digest", F.lit("\n")).alias("part"), "rows", "hashes",
        )
        digests = parts.groupBy("prefix", "depth").agg(
            _hashed(F.collect_list("part")).alias("digest"), F.sum("rows").alias("rows"), F.sum("hashes").alias("hashes")
        )
    # One row is left, none for an empty input. More than one would mean that the levels did not reach
    # the root; then no digest is given.
    root = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("the digest tree has more than one root"))).otherwise(F.max("digest"))
    return digests.agg(
        F.coalesce(root, F.sha2(F.lit(""), 256)).alias("digest"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce(F.sum("hashes"), F.lit(0)).cast("bigint").alias("distinct_count"),
    ).withColumn("duplicate_count", F.col("row_count") - F.col("distinct_count"))
