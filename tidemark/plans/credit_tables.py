"""The credit schema as a view of order tables.

A customer is an applicant, an order a bureau record, an order line a monthly balance. Offsets are
measured from the first day of 1999, so that many rows lie after the prediction and must be left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.points import build_points
from tidemark.settings import DOCUMENT_FLAGS, MANIFEST

ORIGIN = "1999-01-01"
SNAPSHOT = "snapshot-a"
# The event type that answers for a document flag, by position modulo five. Fixed values.
FLAG_TYPES = ["click", "view", "purchase", "signup", "error"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _snapshot(df: DataFrame) -> DataFrame:
    return df.withColumn(MANIFEST, F.lit(SNAPSHOT))


def bureau(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as bureau records; the third order status is neither active nor closed."""
    status = F.col("o_orderstatus")
    return _snapshot(table(spark, folder, "orders").select(
        F.col("o_custkey").alias("SK_ID_CURR"), F.col("o_orderkey").alias("SK_ID_BUREAU"),
        F.datediff("o_orderdate", F.lit(ORIGIN).cast("date")).alias("DAYS_CREDIT"),
        F.when(status == "O", "Active").when(status == "F", "Closed").otherwise("Sold").alias("CREDIT_ACTIVE"),
        F.col("o_totalprice").alias("AMT_CREDIT_SUM"),
        F.when(status != "F", F.col("o_totalprice") * 0.5).alias("AMT_CREDIT_SUM_DEBT"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") * 0.1).otherwise(0.0)
        .alias("AMT_CREDIT_SUM_OVERDUE"),
    ))


def raw_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as monthly balances, without the applicant."""
    ship = F.col("l_shipdate")
    level = (F.col("l_linenumber") % 6).cast("string")
    return _snapshot(table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("SK_ID_BUREAU"),
        ((F.year(ship) - 1999) * 12 + F.month(ship) - 1).alias("MONTHS_BALANCE"),
        F.when(F.col("l_returnflag") == "N", "C").when(F.col("l_linestatus") == "O", "X").otherwise(level)
        .alias("STATUS"),
    ))


def balance(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly balances with their applicant."""
    owners = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("SK_ID_BUREAU"), F.col("o_custkey").alias("SK_ID_CURR")
    )
    return raw_balance(spark, folder).join(owners, "SK_ID_BUREAU", "left")


def _first(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The first row per key by columns that are never NULL: a minimum over structs."""
    return df.groupBy(key).agg(F.min(F.struct(*order, *values)).alias("_row")).select(key, "_row.*")


def application(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as applicants: amounts from their first order and its first line.

    The presence of an event type answers for document flags; a customer without events has NULL.
    """
    orders = _first(table(spark, folder, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"])
    # Only lines of first orders are compared: a row of all values cannot be merged in place, so its minimum sorts what it reads.
    wanted = orders.select(F.col("o_orderkey").alias("l_orderkey"))
    lines = _first(
        table(spark, folder, "lineitem").join(wanted, "l_orderkey", "left_semi"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
        ["l_discount", "l_tax", "l_quantity"],
    )
    seen = table(spark, folder, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(*[
        F.max((F.col("event_type") == t).cast("int")).alias(f"has_{t}") for t in FLAG_TYPES
    ])
    customer = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    joined = (
        customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(seen, "c_custkey", "left")
    )
    flags = [F.col(f"has_{FLAG_TYPES[i % 5]}").alias(flag) for i, flag in enumerate(DOCUMENT_FLAGS)]
    return _snapshot(joined.select(
        F.col("c_custkey").alias("SK_ID_CURR"), (F.col("c_acctbal") < 0).cast("int").alias("TARGET"),
        F.col("c_acctbal").alias("AMT_INCOME_TOTAL"), F.col("o_totalprice").alias("AMT_CREDIT"),
        F.col("l_extendedprice").alias("AMT_ANNUITY"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("AMT_GOODS_PRICE"),
        (-(7000 + F.col("c_custkey") * 37 % 18000)).cast("int").alias("DAYS_BIRTH"),
        F.nullif("l_discount", F.lit(0.0)).alias("EXT_SOURCE_1"),
        F.nullif("l_tax", F.lit(0.0)).alias("EXT_SOURCE_2"),
        (F.col("l_quantity") / 50).alias("EXT_SOURCE_3"),
        *flags,
    ))


def applicants(spark: SparkSession, folder: str) -> DataFrame:
    """Applicant and label only."""
    return _snapshot(table(spark, folder, "customer").select(
        F.col("c_custkey").alias("SK_ID_CURR"), (F.col("c_acctbal") < 0).cast("int").alias("TARGET")
    ))


def points(spark: SparkSession, folder: str) -> DataFrame:
    return build_points(applicants(spark, folder))
