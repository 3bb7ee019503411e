"""Audit of a running stream: what each micro-batch held, by observed metrics that a listener appends to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

AUDIT_COLUMNS = "stream string, run_id string, batch bigint, metric string, value double"


def audited(df: DataFrame, name: str, columns: list[str], violations: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with metrics on its way: rows, NULLs per column, and rows that break each of ``violations``.

    The metrics are part of the query's own pass, so nothing is read a second time.
    """
    metrics = [F.count(F.lit(1)).alias("rows")]
    metrics += [F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in columns]
    metrics += [F.count_if(F.coalesce(bad, F.lit(False))).alias(f"breaks:{rule}") for rule, bad in (violations or {}).items()]
    return df.observe(name, *metrics)


class AuditListener(StreamingQueryListener):
    """Appends the observed metrics of every micro-batch to a table, a row for each.

    A batch that runs again appends again; ``audit_rows`` keeps one value for each run, batch and metric.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.createDataFrame([], AUDIT_COLUMNS).write.mode("ignore").parquet(path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        rows = [
            (stream, str(progress.id), int(progress.batchId), metric, float(value))
            for stream, found in progress.observedMetrics.items() for metric, value in found.asDict().items()
        ]
        if rows:
            self.spark.createDataFrame(rows, AUDIT_COLUMNS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def audit_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_COLUMNS).parquet(path).groupBy("stream", "run_id", "batch", "metric").agg(F.max("value").alias("value"))
