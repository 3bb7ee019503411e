"""Snapshot tables: parquet partitioned by manifest, overwritten one snapshot at a time.

A table of the catalog or a folder works as a target. Audit rows (commits, receipts, failures) are
append-only tables of their own.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.settings import MANIFEST
from tidemark.sources.raw_csv import ContractError

OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"

COMMIT_SCHEMA = T.StructType([
    T.StructField("table", T.StringType()),
    T.StructField("manifest_sha256", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("committed_at", T.TimestampType()),
])
RECEIPT_SCHEMA = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("manifest_sha256", T.StringType()),
    T.StructField("snapshot_id", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("rows_before", T.LongType()),
    T.StructField("rows_after", T.LongType()),
    T.StructField("growth", T.LongType()),
    T.StructField("digest", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
FAILURE_SCHEMA = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("completed_tables", T.ArrayType(T.StringType())),
    T.StructField("failed_table", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])


def ensure_table(
    spark: SparkSession, name: str, schema: T.StructType, partition: str = MANIFEST,
    properties: dict[str, str] | None = None, location: str | None = None,
) -> None:
    """Create database and table where absent."""
    if "." in name:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.rsplit('.', 1)[0]}")
    if spark.catalog.tableExists(name):
        return
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    props = ", ".join(f"'{k}'='{v}'" for k, v in (properties or {}).items())
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (`{partition}`)"
        + (f" LOCATION '{location}'" if location else "")
        + (f" TBLPROPERTIES ({props})" if props else "")
    )


def check_table_contract(
    spark: SparkSession, name: str, schema: T.StructType, partition: str = MANIFEST,
    properties: dict[str, str] | None = None,
) -> None:
    """Raise unless names, order, types, properties and the one partition column are as declared."""
    # Partition columns always come last in a parquet table.
    want = [f for f in schema if f.name != partition] + [schema[partition]]
    found = spark.table(name).schema
    problems = []
    if [f.name for f in found] != [f.name for f in want]:
        problems.append(f"columns {[f.name for f in found]} != {[f.name for f in want]}")
    elif [f.dataType for f in found] != [f.dataType for f in want]:
        problems.append("column types differ")
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    if parts != [partition]:
        problems.append(f"partitioned by {parts}, not by {partition}")
    have = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    for key, value in (properties or {}).items():
        if have.get(key) != value:
            problems.append(f"property {key} is {have.get(key)!r}, not {value!r}")
    if problems:
        raise ContractError(f"{name}: " + "; ".join(problems))


def write_snapshot(df: DataFrame, target: str, partition: str = MANIFEST, files: int | None = None) -> int:
    """Replace the partitions present in ``df`` and leave all others; return the rows written.

    ``target`` is a table name, or a folder when it holds a slash. The rows are counted while they
    are written. ``files`` spreads them over that many files; by default every task writes its own.
    """
    if files:
        df = df.repartition(files)
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if "/" in target:
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(partition).parquet(target)
    else:
        spark = df.sparkSession
        # A table insert reads the mode from the session only.
        usual = spark.conf.get(OVERWRITE_MODE)
        spark.conf.set(OVERWRITE_MODE, "dynamic")
        try:
            df.select(*spark.table(target).columns).write.insertInto(target, overwrite=True)
        finally:
            spark.conf.set(OVERWRITE_MODE, usual)
    return seen.get["rows"]


def read_snapshot(spark: SparkSession, target: str, manifest_sha: str, partition: str = MANIFEST) -> DataFrame:
    """Rows of one snapshot; the filter prunes partitions."""
    table = spark.read.parquet(target) if "/" in target else spark.table(target)
    return table.where(F.col(partition) == manifest_sha)


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _append(spark: SparkSession, row: tuple, schema: T.StructType, log: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(log)


def append_commit(spark: SparkSession, log: str, table: str, manifest_sha: str, rows: int) -> None:
    _append(spark, (table, manifest_sha, rows, _now()), COMMIT_SCHEMA, log)


def latest_commit(spark: SparkSession, log: str, table: str) -> DataFrame:
    """The newest commit of a table; none is an error, since every write leaves one."""
    newest = (
        spark.read.schema(COMMIT_SCHEMA).parquet(log).where(F.col("table") == table)
        .orderBy(F.desc("committed_at"), F.desc("manifest_sha256")).limit(1)
    )
    if newest.isEmpty():
        raise ContractError(f"{table}: no commit")
    return newest


def receipt_row(
    spark: SparkSession, log: str, stage: str, run_id: str, manifest_sha: str, snapshot_id: str,
    table: str, rows_before: int, rows_after: int, growth: int = 0, digest: str | None = None,
    status: str = "COMPLETE",
) -> None:
    row = (
        stage, run_id, status, manifest_sha, snapshot_id, table, rows_before, rows_after, growth,
        digest, _now(),
    )
    _append(spark, row, RECEIPT_SCHEMA, log)


def failure_row(
    spark: SparkSession, log: str, stage: str, run_id: str, completed: list[str], failed: str | None,
    error: str,
) -> None:
    _append(spark, (stage, run_id, completed, failed, error, _now()), FAILURE_SCHEMA, log)


def require_complete(spark: SparkSession, log: str, stage: str, manifest_sha: str, tables: list[str]) -> None:
    """Raise unless the newest receipt of every table of the stage is COMPLETE for this manifest."""
    newest = (
        spark.read.schema(RECEIPT_SCHEMA).parquet(log)
        .where((F.col("stage") == stage) & (F.col("manifest_sha256") == manifest_sha))
        .groupBy("table").agg(F.max_by("status", "created_at").alias("status"))
        .where("status = 'COMPLETE'")
    )
    wanted = spark.createDataFrame([(t,) for t in tables], "table string")
    open_tables = [r.table for r in wanted.join(newest, "table", "left_anti").collect()]
    if open_tables:
        raise ContractError(f"{stage} is not COMPLETE for {sorted(open_tables)}")


def published(df: DataFrame, receipts: DataFrame, stage: str, partition: str = MANIFEST, table: str | None = None) -> DataFrame:
    """Rows of ``df`` whose snapshot the stage has published: the newest receipt of each of its tables is COMPLETE.

    A rerun that is running or failed takes the snapshot back until one completes. With ``table`` only the receipts of that
    table count.
    """
    own = receipts.where(F.col("stage") == stage)
    own = own.where(F.col("table") == table) if table else own
    newest = own.groupBy("manifest_sha256", "table").agg(F.max_by("status", F.struct("created_at", "run_id")).alias("status"))
    complete = newest.groupBy(F.col("manifest_sha256").alias(partition)).agg(F.every(F.col("status") == "COMPLETE").alias("complete"))
    return df.join(complete.where("complete").select(partition), partition, "left_semi")
