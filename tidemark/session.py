"""Session settings and the two places where a job meets the cluster: shared scratch, broadcast size."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have before it is broadcast. The rows of every caller are narrow (under 1 kB), so
# the broadcast stays far below executor memory.
BROADCAST_ROWS = 100_000


def build_session(master: str = "local[8]", app: str = "tidemark", **extra: str) -> SparkSession:
    """A session with the settings the jobs are designed for; on a cluster pass them by submit."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names.

    Where that setting is absent, a session of one machine uses its warehouse folder, and a cluster is
    refused: there every executor would write to a disk of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{shared.rstrip('/')}/tidemark-{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, so later steps all see the same rows even when an executor is lost, and later scans
    read only the columns they need. Ids and hashes are hex text, of which zstd saves nearly half and the usual codec nothing.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when a count proves it small; otherwise leave the join strategy to Spark."""
    small = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if small else df
