"""Bronze rows: all columns as text, stamped with where they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import canonical_id, row_hash
from tidemark.settings import BRONZE_COLUMNS, BRONZE_VERSION, DATASET

SCHEMA_VERSION = 1


def source_snapshot_id(manifest_sha: str, version: str = BRONZE_VERSION, dataset: str = DATASET) -> F.Column:
    return canonical_id(F.lit(dataset), F.lit(manifest_sha), F.lit(version))


def stamp_bronze(
    df: DataFrame, file_name: str, file_sha: str, header_sha: str, manifest_sha: str,
    version: str = BRONZE_VERSION, dataset: str = DATASET,
) -> DataFrame:
    """Source columns first, then the seven lineage columns in their fixed order."""
    source = df.columns
    return df.withColumns({
        "_source_file_name": F.lit(file_name),
        "_source_file_sha256": F.lit(file_sha),
        "_source_header_sha256": F.lit(header_sha),
        "_source_manifest_sha256": F.lit(manifest_sha),
        "_source_snapshot_id": source_snapshot_id(manifest_sha, version, dataset),
        "_bronze_schema_version": F.lit(SCHEMA_VERSION),
        "_raw_row_sha256": row_hash(source),
    }).select(*[F.col(f"`{c}`") for c in source], *BRONZE_COLUMNS)
