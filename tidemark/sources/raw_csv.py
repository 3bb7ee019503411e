"""Raw CSV files: scan, header, profile, and the manifest they must agree with."""

from __future__ import annotations

import csv
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.checks import blank, errors_of, rule, with_errors
from tidemark.settings import REQUIRED_COLUMNS
from tidemark.sources.files import locate

MANIFEST_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("required", T.BooleanType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("header_sha256", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("columns", T.IntegerType()),
])

# A plain file hash, or the digest of the hashes of several parts.
DIGEST_PATTERN = r"^(parts:)?[0-9a-fA-F]{64}\z"
READ_BYTES = 8 << 20


class ContractError(ValueError):
    """A source, table or stage breaks its contract; nothing downstream may run."""


def scan_raw_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as text. A malformed line fails the job that reads it."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (
        spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
        .option("encoding", "UTF-8").option("multiLine", False).option("enforceSchema", False)
        .csv(path)
    )


def _cells(header: bytes) -> list[str]:
    """Column names of a header line, quotes and all, as CSV has them."""
    csv.field_size_limit(max(csv.field_size_limit(), len(header) + 1))
    return next(csv.reader([header.decode("utf-8").removesuffix("\r")]), [])


def _facts(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Paths -> name, header and, with ``whole``, hash and data rows of each file.

    A file streams through its task once, a few megabytes at a time; without ``whole`` only its first
    line is read. Lines end at "\\n" alone, so a carriage return stays part of the header hash. Empty
    lines are no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                digest, header, done, lines, newline = hashlib.sha256(), b"", False, 0, True
                system, inside = locate(path)
                with system.open_input_stream(inside) as stream:
                    while (data := stream.read(READ_BYTES)) and (whole or not done):
                        if not done:
                            head, end, _ = data.partition(b"\n")
                            header, done = header + head, bool(end)
                        if whole:
                            digest.update(data)
                            breaks = np.frombuffer(data, np.uint8) == 10
                            lines += int(np.count_nonzero(~breaks & np.concatenate([[newline], breaks[:-1]])))
                            newline = bool(breaks[-1])
                name = path.rsplit("/", 1)[-1]
                sha = hashlib.sha256(header + b"\n").hexdigest()
                rows.append((name, digest.hexdigest() if whole else None, sha, max(lines - 1, 0), _cells(header), bool(header)))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _FACT_NAMES)

    return run


_FACT_NAMES = ["name", "sha256", "header_sha256", "row_count", "names", "filled"]


def _files(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """One row per file that is not empty; only the list of paths comes from the reader."""
    paths = spark.read.format("binaryFile").load(path).select("path")
    kinds = "name string, sha256 string, header_sha256 string, row_count bigint, names array<string>, filled boolean"
    return paths.mapInArrow(_facts(whole), kinds).where("filled").drop("filled")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: the names in its first line, and the hash of that line."""
    return _files(spark, path, False).select("name", "header_sha256", "names")


def check_columns(found: DataFrame, required: dict[str, list[str]] = REQUIRED_COLUMNS) -> DataFrame:
    """Errors per file of ``headers``: names used twice, required names that are absent."""
    wanted = F.coalesce(
        *[F.when(F.col("name") == f, F.array(*map(F.lit, cols))) for f, cols in required.items()],
        F.array().cast("array<string>"),
    )
    return (
        found.withColumn("missing", F.sort_array(F.array_except(wanted, "names")))
        .transform(with_errors_of_header)
        .select("name", "names", "missing", "errors")
    )


def with_errors_of_header(df: DataFrame) -> DataFrame:
    return with_errors(df, [
        rule(F.size(F.array_distinct("names")) < F.size("names"), "header", "duplicate column names"),
        rule(F.size("missing") > 0, "header", "missing required columns"),
    ])


def read_header(spark: SparkSession, path: str, source: str | None = None) -> list[str]:
    """The checked column names of a source: one file, or a folder of parts with equal headers.

    ``source`` names the contract when the file name does not. At most two headers reach the driver.
    """
    found = headers(spark, path).dropDuplicates(["header_sha256"] if source else ["name", "header_sha256"])
    if source:
        found = found.withColumn("name", F.lit(source))
    rows = check_columns(found).limit(2).collect()
    if len(rows) != 1 or rows[0].errors:
        raise ContractError(f"{path}: {[(r.names, r.missing, r.errors) for r in rows] or 'no header'}")
    return rows[0].names


def profile_sources(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: content hash, header hash, data rows, columns; every file is read once."""
    return _files(spark, path, True).select("name", "sha256", "header_sha256", "row_count", F.size("names").alias("columns"))


def present_sources(spark: SparkSession, data_dir: str, names: list[str]) -> list[str]:
    """Which of ``names`` exist in ``data_dir``, as a file or as a folder of parts."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(data_dir).select("path")
    folder = re.escape(data_dir.rstrip("/").rsplit("/", 1)[-1])
    found = paths.agg(*[
        F.bool_or(F.col("path").rlike(rf"/{folder}/{re.escape(n)}(/|\z)")).alias(str(i)) for i, n in enumerate(names)
    ]).first()
    return [n for i, n in enumerate(names) if found[i]]


def profile_source(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One row for a source that is a file or a folder of part files.

    The hash of several parts is that of their sorted hashes, marked ``parts:``. Parts with different
    headers have the header hash ``mixed``, which no manifest accepts.
    """
    parts = profile_sources(spark, path)
    shas = F.sort_array(F.collect_list("sha256"))
    several = F.concat(F.lit("parts:"), F.sha2(F.concat_ws("\n", shas), 256))
    same = F.min("header_sha256") == F.max("header_sha256")
    # One short hash per part file is gathered here, never content.
    return parts.agg(
        F.lit(name).alias("name"), F.when(F.count(F.lit(1)) == 1, F.max("sha256")).otherwise(several).alias("sha256"),
        F.when(same, F.max("header_sha256")).otherwise("mixed").alias("header_sha256"),
        F.sum("row_count").cast("bigint").alias("row_count"), F.max("columns").alias("columns"),
    )


def profile_folder(spark: SparkSession, data_dir: str, names: list[str]) -> DataFrame:
    """Profiles of those of the named sources that exist."""
    profiles = [profile_source(spark, f"{data_dir}/{n}", n) for n in present_sources(spark, data_dir, names)]
    empty = spark.createDataFrame([], "name string, sha256 string, header_sha256 string, row_count bigint, columns int")
    for profile in profiles:
        empty = empty.unionByName(profile)
    return empty


def check_manifest_rows(
    expected: DataFrame, required: dict[str, list[str]] = REQUIRED_COLUMNS, strict: bool = False
) -> DataFrame:
    """Errors inside a manifest: names, duplicates, the required flag, absent required files.

    ``strict`` also asks for complete and well-formed metadata of the required files.
    """
    must = F.col("name").isin(list(required))
    least = F.coalesce(
        *[F.when(F.col("name") == f, F.lit(len(cols))) for f, cols in required.items()], F.lit(1)
    )
    rules = [
        rule(blank(F.col("name")), "name", "must be a non-empty string"),
        rule(F.col("name").rlike(r"[/\\]"), "name", "must be a plain file name"),
        rule(F.col("name").isin(".", ".."), "name", "must not be a folder"),
        rule(F.col("copies") > 1, "name", "duplicate file name"),
        rule(F.col("required").isNull(), "required", "must be a boolean"),
        rule(must & ~F.coalesce("required", F.lit(False)), "required", "must be true for a required file"),
    ]
    if strict:
        for sha in ("sha256", "header_sha256"):
            bad = F.col(sha).isNull() | ~F.col(sha).rlike(DIGEST_PATTERN)
            rules.append(rule(must & bad, sha, "must be 64 hexadecimal characters"))
        rows, columns = F.col("row_count"), F.col("columns")
        rules.append(rule(must & (rows.isNull() | (rows < 0)), "row_count", "must be non-negative"))
        rules.append(rule(must & (columns.isNull() | (columns < least)), "columns", "too few columns"))
    copies = expected.groupBy("name").agg(F.count(F.lit(1)).alias("copies"))
    marked = with_errors(_with_copies(expected, copies), rules)
    broken = marked.select("name", F.explode("errors").alias("e")).select("name", "e.field", "e.message")
    wanted = expected.sparkSession.createDataFrame([(f,) for f in required], "name string")
    absent = wanted.join(expected, "name", "left_anti").select(
        "name", F.lit("name").alias("field"), F.lit("required file missing").alias("message")
    )
    return broken.unionByName(absent)


def _with_copies(expected: DataFrame, copies: DataFrame) -> DataFrame:
    other = copies.withColumnRenamed("name", "copy_name")
    return expected.join(other, F.col("name").eqNullSafe(F.col("copy_name")), "left").drop("copy_name")


def check_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per difference between the manifest and the files found.

    An optional file may be absent; a file the manifest does not list is not looked at.
    """
    e, a = expected.alias("e"), actual.withColumn("present", F.lit(True)).alias("a")
    both = e.join(a, F.col("e.name") == F.col("a.name"), "full_outer").where("e.name is not null")
    present = F.col("a.present").isNotNull()
    must = F.coalesce("e.required", F.lit(False))

    def differs(field: str, message: str) -> list:
        want, got = F.col(f"e.{field}"), F.col(f"a.{field}")
        return [
            rule(must & present & want.isNull(), field, "is null, profile the sources first"),
            rule(present & (want != got), field, message),
        ]

    rules = [rule(must & ~present, "name", "required file not found")]
    for field in ("sha256", "header_sha256"):
        bad = ~F.col(f"e.{field}").rlike(DIGEST_PATTERN)
        rules.append(rule(must & present & bad, field, "must be 64 hexadecimal characters"))
    rules.append(rule(must & present & (F.col("e.row_count") < 0), "row_count", "must be non-negative"))
    rules.append(rule(must & present & (F.col("e.columns") < 1), "columns", "must be positive"))
    rules += differs("sha256", "content changed")
    rules += differs("header_sha256", "header changed")
    rules += differs("row_count", "row count changed")
    rules += differs("columns", "column count changed")
    return (
        both.select(F.col("e.name").alias("name"), F.explode(errors_of(rules)).alias("x"))
        .select("name", "x.field", "x.message")
    )
