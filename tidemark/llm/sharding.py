"""Shards that each match the mixture of sources: proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; rank ``r`` of ``n`` stands at ``(r - 1/2) / n``.
All rows sorted by that fraction are cut into shards whose row counts are at most one apart. So every
run of rows holds each source in its proportion, to within a row or so per source.

Both orders are range partitions with ranks from per-partition counts, so a source of any size, and the
whole table, spread over all tasks; only narrow rows are sorted.

Defined results: a NULL text has no bytes and checksum 0; rows without a source are one source; rows with
equal ids are ordered by checksum and size, and wholly equal rows are interchangeable; an empty table
gives an empty result; of a very long text only size and checksum are kept; columns that are not named stay unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import whole
from tidemark.operators.ranks import global_ranks
from tidemark.session import settle

#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def shards(
    docs: DataFrame, count: int, keep: list[str], id_column: str = "doc_id", source: str = "source", text: str = "text", seed: int = 11
) -> DataFrame:
    """``keep``, size, text_crc32, shard (from 0) and slot (from 0 within the shard) for each row of ``docs``."""
    raw = whole(text).cast("binary")
    rows = settle(docs.select(
        *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.xxhash64(F.lit(seed), F.col(id_column)).alias("h"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), F.col(source).isNull().alias("none"),
        (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
    ), "narrow").withColumn("row", F.monotonically_increasing_id())
    # Wholly equal rows go by their place in the written table, so they may span tasks.
    tie = [F.col("h"), *[F.col(f"_keep{i}") for i in range(len(keep))], F.col("text_crc32"), F.col("size"), F.col("row")]
    ranked = global_ranks(rows, ["s", "none"], tie)
    at = ranked.withColumn("at", (F.col("rank") - 0.5) / F.col("group_rows")).drop("rank", "group_rows")
    placed = global_ranks(at, [], [F.col("at"), F.col("s"), F.col("none"), *tie])
    place = F.col("rank") - 1
    # The first place of a shard is the least p with p * count >= shard * rows.
    exact = placed.withColumn("shard", F.expr(f"(rank - 1) * {count} div group_rows")).withColumn(
        "first", F.expr(f"(shard * group_rows + {count - 1}) div {count}"))
    return exact.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "size", "text_crc32",
        F.col("shard").cast("int").alias("shard"), (place - F.col("first")).alias("slot"))
