"""The chain of stages: raw files, bronze, silver, prediction points, features, rules.

Every stage writes one snapshot, checks what it wrote and leaves a receipt; the next stage starts
only where the receipts of the one before are complete.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import silver
from tidemark.operators.bronze import source_snapshot_id, stamp_bronze
from tidemark.operators.features import feature_values
from tidemark.operators.fingerprint import fingerprint
from tidemark.operators.points import build_points, points_snapshot_id
from tidemark.operators.contracts import validate_points
from tidemark.operators.catalog import feature_catalog
from tidemark.operators.quality import check_feature_closure, check_fk, check_pk
from tidemark.operators.woe import check_training_closure, fit_woe
from tidemark.session import settle
from tidemark.settings import MANIFEST, REQUIRED_COLUMNS, SILVER_TYPES, Boundary
from tidemark.sources.raw_csv import (
    MANIFEST_SCHEMA,
    ContractError,
    check_manifest,
    check_manifest_rows,
    profile_folder,
    read_header,
    scan_raw_csv,
)
from tidemark.sources.tables import (
    append_commit,
    check_table_contract,
    ensure_table,
    failure_row,
    latest_commit,
    read_snapshot,
    receipt_row,
    require_complete,
    write_snapshot,
)

SOURCES = [f.removesuffix(".csv") for f in REQUIRED_COLUMNS]
PRIMARY_KEYS = {
    "application_train": ["SK_ID_CURR"],
    "bureau": ["SK_ID_BUREAU"],
    "bureau_balance": ["SK_ID_BUREAU", "MONTHS_BALANCE"],
}
# Column and the source whose key it must be.
FOREIGN_KEYS = {"bureau": ("SK_ID_CURR", "application_train"), "bureau_balance": ("SK_ID_BUREAU", "bureau")}


class Layers(NamedTuple):
    """Databases of the layers and the folder that holds their files."""

    root: str
    prefix: str = "credit"

    def name(self, layer: str, table: str) -> str:
        return f"{self.prefix}_{layer}.{table}"

    def folder(self, layer: str, table: str) -> str:
        return f"{self.root.rstrip('/')}/{layer}/{table}"

    @property
    def commits(self) -> str:
        return self.folder("audit", "commits")

    @property
    def receipts(self) -> str:
        return self.folder("audit", "receipts")

    @property
    def failures(self) -> str:
        return self.folder("audit", "failures")


def manifest_sha(manifest: DataFrame) -> str:
    """Identity of a manifest: the digest of its rows in name order. A manifest lists few files."""
    line = F.to_json(F.struct(*MANIFEST_SCHEMA.names), {"ignoreNullFields": "false"})
    return manifest.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256)).first()[0]


def populate_manifest(spark: SparkSession, data_dir: str) -> DataFrame:
    """The manifest of the required sources as they are, each a file or a folder of parts."""
    return profile_folder(spark, data_dir, list(REQUIRED_COLUMNS)).withColumn("required", F.lit(True)).select(
        *[F.col(f.name).cast(f.dataType) for f in MANIFEST_SCHEMA]
    )


def _publish(
    spark: SparkSession, layers: Layers, layer: str, table: str, df: DataFrame, sha: str, snapshot: str,
    run_id: str, expected: int | None, digest: bool = False,
) -> DataFrame:
    """Write one snapshot of one table, verify it, and log commit and receipt."""
    name = layers.name(layer, table)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    properties = {"layer": layer}
    ensure_table(spark, name, schema, MANIFEST, properties, layers.folder(layer, table))
    check_table_contract(spark, name, schema, MANIFEST, properties)
    before = read_snapshot(spark, name, sha).count()
    written = write_snapshot(df, name)
    stored = read_snapshot(spark, name, sha)
    after = stored.count()
    if after != written or (expected is not None and after != expected):
        raise ContractError(f"{name}: {expected} expected, {written} written, {after} stored")
    append_commit(spark, layers.commits, name, sha, after)
    latest_commit(spark, layers.commits, name)
    receipt_row(
        spark, layers.receipts, layer, run_id, sha, snapshot, name, before, after,
        after - (written if expected is None else expected),
        fingerprint(stored, rows=after).first().digest if digest else None,
    )
    return stored


def _stage(spark: SparkSession, layers: Layers, stage: str, run_id: str, work: dict) -> dict[str, DataFrame]:
    """Run the tables of a stage in order; a failure is logged with what was done before it."""
    done: dict[str, DataFrame] = {}
    for table, build in work.items():
        try:
            done[table] = build()
        except Exception as error:
            failure_row(spark, layers.failures, stage, run_id, list(done), table, str(error))
            raise
    return done


def ingest_bronze(
    spark: SparkSession, layers: Layers, data_dir: str, manifest: DataFrame, run_id: str
) -> dict[str, DataFrame]:
    problems = check_manifest_rows(manifest, strict=True).collect()
    if not problems:
        names = [r.name for r in manifest.select("name").collect()]
        problems = check_manifest(manifest, profile_folder(spark, data_dir, names)).collect()
    if problems:
        # One row per problem; a manifest lists few files.
        for problem in problems:
            failure_row(spark, layers.failures, "bronze", run_id, [], problem.name, f"{problem.field}: {problem.message}")
        raise ContractError(f"manifest: {problems}")
    sha = manifest_sha(manifest)
    snapshot = spark.range(1).select(source_snapshot_id(sha)).first()[0]
    files = {r.name: r for r in manifest.collect()}

    def build(table: str) -> DataFrame:
        file = files[f"{table}.csv"]
        path = f"{data_dir}/{file.name}"
        rows = scan_raw_csv(spark, path, read_header(spark, path, file.name))
        stamped = stamp_bronze(rows, file.name, file.sha256, file.header_sha256, sha)
        return _publish(spark, layers, "bronze", table, stamped, sha, snapshot, run_id, file.row_count, True)

    return _stage(spark, layers, "bronze", run_id, {t: lambda t=t: build(t) for t in SOURCES})


def _refuse(table: str, problems: dict[str, int]) -> None:
    found = {k: v for k, v in problems.items() if v}
    if found:
        raise ContractError(f"{table}: {found}")


def ingest_silver(spark: SparkSession, layers: Layers, sha: str, run_id: str) -> dict[str, DataFrame]:
    require_complete(spark, layers.receipts, "bronze", sha, [layers.name("bronze", t) for t in SOURCES])

    def bronze(table: str) -> DataFrame:
        return read_snapshot(spark, layers.name("bronze", table), sha)

    def build(table: str) -> DataFrame:
        types = SILVER_TYPES[table]
        rows = silver.cast_by_map(silver.business_columns(bronze(table)), types)
        key = check_pk(rows, PRIMARY_KEYS[table]).first()
        _refuse(table, {"null keys": key.null_rows, "duplicate keys": key.duplicate_keys})
        if table == "bureau_balance":
            mapping = silver.cast_by_map(bronze("bureau").select("SK_ID_BUREAU", "SK_ID_CURR"), types)
            rows, problems = silver.enrich(rows, mapping, "SK_ID_BUREAU", ["SK_ID_CURR"])
            found = problems.first()
            _refuse(table, {"ambiguous": found.ambiguous_keys, "unmatched": found.unmatched_rows})
        if table in FOREIGN_KEYS:
            column, parent = FOREIGN_KEYS[table]
            parents = silver.cast_by_map(bronze(parent).select(column), SILVER_TYPES[parent])
            _refuse(table, {f"{column} without {parent}": check_fk(rows, parents, column).count()})
        return _publish(
            spark, layers, "silver", table, silver.with_lineage(rows, sha), sha, sha, run_id, key.rows
        )

    return _stage(spark, layers, "silver", run_id, {t: lambda t=t: build(t) for t in SOURCES})


def generate_points(
    spark: SparkSession, layers: Layers, sha: str, run_id: str, boundary: Boundary = Boundary()
) -> DataFrame:
    require_complete(spark, layers.receipts, "silver", sha, [layers.name("silver", "application_train")])

    def build() -> DataFrame:
        applications = read_snapshot(spark, layers.name("silver", "application_train"), sha)
        points, quarantine = validate_points(build_points(applications, boundary))
        _refuse("prediction_points", {"invalid": quarantine.count()})
        snapshot = spark.range(1).select(points_snapshot_id(F.lit(sha), boundary)).first()[0]
        return _publish(spark, layers, "points", "prediction_points", points, sha, snapshot, run_id, None)

    return _stage(spark, layers, "points", run_id, {"prediction_points": build})["prediction_points"]


def compute_features(spark: SparkSession, layers: Layers, sha: str, run_id: str) -> DataFrame:
    require_complete(spark, layers.receipts, "points", sha, [layers.name("points", "prediction_points")])

    def build() -> DataFrame:
        tables = [read_snapshot(spark, layers.name("silver", t), sha) for t in SOURCES]
        points = read_snapshot(spark, layers.name("points", "prediction_points"), sha)
        values = settle(feature_values(points, *tables), "feature-values")
        breaches = check_feature_closure(values, feature_catalog(spark), points)
        _refuse("feature_values", {r.breach: r["count"] for r in breaches.groupBy("breach").count().collect()})
        return _publish(spark, layers, "features", "feature_values", values, sha, sha, run_id, None)

    return _stage(spark, layers, "features", run_id, {"feature_values": build})["feature_values"]


def fit_rules(spark: SparkSession, layers: Layers, sha: str, run_id: str) -> DataFrame:
    require_complete(spark, layers.receipts, "features", sha, [layers.name("features", "feature_values")])

    def build() -> DataFrame:
        values = read_snapshot(spark, layers.name("features", "feature_values"), sha)
        points = read_snapshot(spark, layers.name("points", "prediction_points"), sha)
        rules = settle(fit_woe(values, points), "rules")
        _refuse("woe_rules", {"open bins": check_training_closure(rules, points).count()})
        return _publish(spark, layers, "rules", "woe_rules", silver.with_lineage(rules, sha), sha, sha, run_id, None)

    return _stage(spark, layers, "rules", run_id, {"woe_rules": build})["woe_rules"]


def run_all(spark: SparkSession, layers: Layers, data_dir: str, manifest: DataFrame, run_id: str) -> str:
    """All stages for one manifest; returns its identity."""
    sha = manifest_sha(manifest)
    ingest_bronze(spark, layers, data_dir, manifest, run_id)
    ingest_silver(spark, layers, sha, run_id)
    generate_points(spark, layers, sha, run_id)
    compute_features(spark, layers, sha, run_id)
    fit_rules(spark, layers, sha, run_id)
    return sha
