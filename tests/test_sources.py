from __future__ import annotations

import hashlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.operators import silver
from tidemark.operators.bronze import stamp_bronze
from tidemark.operators import fingerprint as digests
from tidemark.session import scratch_folder
from tidemark.sources import raw_csv
from tidemark.operators.fingerprint import fingerprint
from tidemark.operators.monitor import document_features, latency, quality_profile
from tidemark.operators.quality import check_fk, check_pk
from tidemark.settings import BRONZE_COLUMNS
from tidemark.sources.raw_csv import (
    ContractError,
    check_columns,
    check_manifest,
    check_manifest_rows,
    headers,
    present_sources,
    profile_folder,
    profile_sources,
    read_header,
    scan_raw_csv,
)
from tidemark.sources.tables import append_commit, latest_commit, read_snapshot, write_snapshot


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_profile_equals_hashlib(spark, tmp_path):
    files = {
        "a.csv": b"x,y\n1,2\n3,4\n", "b.csv": b"x,y,z\r\n1,,\r\n", "c.csv": b"only\n", "d.csv": b"p,q\nno,end",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: r for r in profile_sources(spark, str(tmp_path)).collect()}
    assert {n: (r.sha256, r.header_sha256, r.row_count, r["columns"]) for n, r in got.items()} == {
        n: (sha(d), sha(d.split(b"\n")[0] + b"\n"), len([x for x in d.split(b"\n") if x]) - 1, d.split(b"\n")[0].count(b",") + 1)
        for n, d in files.items()
    }


def test_files_of_any_size_have_one_identity(spark, tmp_path):
    """Files longer than what is read at a time, with line breaks at the seams."""
    size = raw_csv.READ_BYTES
    files = {
        "a.csv": b"x" * (size - 1) + b"\n" + b"1\n" * 50, "b.csv": b"x" * size + b"\n\n\n" + b"2" * size, "c.csv": b"x\n" + b"y" * (size - 3) + b"\n\nz",
        "d e.csv": b"h" * (size + 5),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.sha256, r.header_sha256, r.row_count) for r in profile_sources(spark, str(tmp_path)).collect()}
    assert got == {
        n: (sha(d), sha(d.split(b"\n")[0] + b"\n"), len([x for x in d.split(b"\n") if x]) - 1) for n, d in files.items()}


def test_header_with_quoted_commas(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"x,1","say ""y""",z\r\n1,2,3\n')
    assert read_header(spark, str(tmp_path / "a.csv")) == ["x,1", 'say "y"', "z"]


def test_source_is_scanned_by_one_job_over_its_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    plan = profile_sources(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_source_of_many_parts(spark, tmp_path):
    folder = tmp_path / "bureau.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_bytes(b"SK_ID_CURR,SK_ID_BUREAU\n1,2\n")
    (folder / "part-1.csv").write_bytes(b"SK_ID_CURR,SK_ID_BUREAU\n3,4\n5,6\n")
    (tmp_path / "other.csv").write_bytes(b"a\n1\n")
    names = ["bureau.csv", "other.csv", "absent.csv"]
    assert present_sources(spark, str(tmp_path), names) == names[:2]
    rows = {r.name: r for r in profile_folder(spark, str(tmp_path), names).collect()}
    shas = sorted(sha(f.read_bytes()) for f in folder.iterdir() if f.suffix == ".csv")
    assert rows["bureau.csv"].sha256 == "parts:" + sha("\n".join(shas).encode())
    assert (rows["bureau.csv"].row_count, rows["bureau.csv"]["columns"]) == (3, 2)
    assert rows["other.csv"].sha256 == sha(b"a\n1\n")
    assert read_header(spark, str(folder), "bureau.csv") == ["SK_ID_CURR", "SK_ID_BUREAU"]
    assert scan_raw_csv(spark, str(folder), ["SK_ID_CURR", "SK_ID_BUREAU"]).count() == 3
    (folder / "part-2.csv").write_bytes(b"SK_ID_BUREAU,SK_ID_CURR\n3,4\n")
    assert profile_folder(spark, str(tmp_path), names).where("name = 'bureau.csv'").first().header_sha256 == "mixed"
    with pytest.raises(ContractError):
        read_header(spark, str(folder), "bureau.csv")


def test_header_contract(spark, tmp_path):
    (tmp_path / "application_train.csv").write_text("SK_ID_CURR,x,x\n1,2,3\n")
    (tmp_path / "bureau.csv").write_text('"SK_ID_CURR",SK_ID_BUREAU\n1,2\n')
    found = {r.name: r for r in check_columns(headers(spark, str(tmp_path))).collect()}
    assert {e.message for e in found["application_train.csv"].errors} == {"duplicate column names", "missing required columns"}
    assert found["application_train.csv"].missing == ["TARGET"] and not found["bureau.csv"].errors
    assert read_header(spark, str(tmp_path / "bureau.csv")) == ["SK_ID_CURR", "SK_ID_BUREAU"]
    with pytest.raises(ContractError, match="TARGET"):
        read_header(spark, str(tmp_path / "application_train.csv"))


def test_malformed_line_fails_the_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        scan_raw_csv(spark, str(tmp_path / "a.csv"), ["a", "b"]).collect()


def test_empty_cell_is_null_and_hashes_as_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,\n")
    row = stamp_bronze(scan_raw_csv(spark, str(tmp_path / "a.csv"), ["a", "b"]), "a.csv", "f", "h", "m").first()
    assert row.b is None and row._raw_row_sha256 == sha(b'{"a":"1","b":null}')
    assert row.__fields__ == ["a", "b", *BRONZE_COLUMNS]


MANIFEST = "name string, required boolean, sha256 string, header_sha256 string, row_count long, columns int"


def messages(df):
    return sorted((r.name or "", r.field, r.message) for r in df.collect())


def test_manifest_structure(spark):
    good = [(f, True, "a" * 64, "b" * 64, 1, 3) for f in ("application_train.csv", "bureau.csv", "bureau_balance.csv")]
    assert check_manifest_rows(spark.createDataFrame(good, MANIFEST), strict=True).isEmpty()
    bad = [("x.csv", None, None, None, None, None), ("x.csv", True, None, None, None, None), ("../y", False, None, None, None, None),
           (None, True, None, None, None, None), ("bureau.csv", False, "a" * 63, "b" * 64 + "\n", -1, 1), ("..", True, None, None, None, None)]
    found = {(n, f, m) for n, f, m in messages(check_manifest_rows(spark.createDataFrame(bad, MANIFEST), strict=True))}
    assert {
        ("x.csv", "name", "duplicate file name"), ("x.csv", "required", "must be a boolean"), ("../y", "name", "must be a plain file name"),
        ("..", "name", "must not be a folder"), ("", "name", "must be a non-empty string"),
        ("bureau.csv", "required", "must be true for a required file"), ("bureau.csv", "sha256", "must be 64 hexadecimal characters"),
        ("bureau.csv", "header_sha256", "must be 64 hexadecimal characters"), ("bureau.csv", "row_count", "must be non-negative"),
        ("bureau.csv", "columns", "too few columns"), ("application_train.csv", "name", "required file missing"),
    } <= found


def test_manifest_against_files(spark):
    expected = spark.createDataFrame([("a", True, "1" * 64, "2" * 64, 5, 2), ("b", False, None, None, None, None),
                                      ("c", True, "1" * 64, None, 5, 2), ("d", True, "1" * 64, "2" * 64, 5, 2)], MANIFEST)
    actual = spark.createDataFrame([("a", "1" * 64, "2" * 64, 5, 2), ("c", "3" * 64, "2" * 64, 6, 2), ("z", "1" * 64, "1" * 64, 1, 1)],
                                   "name string, sha256 string, header_sha256 string, row_count long, columns int")
    assert messages(check_manifest(expected, actual)) == [
        ("c", "header_sha256", "is null, profile the sources first"), ("c", "row_count", "row count changed"),
        ("c", "sha256", "content changed"), ("d", "name", "required file not found"),
    ]


def test_snapshot_folder_overwrite(spark, tmp_path):
    target = str(tmp_path / "t")
    for manifest, n in (("a", 5), ("b", 7), ("a", 3)):
        assert write_snapshot(spark.range(n).withColumn("_source_manifest_sha256", F.lit(manifest)), target) == n
    assert (read_snapshot(spark, target, "a").count(), read_snapshot(spark, target, "b").count()) == (3, 7)
    plan = read_snapshot(spark, target, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_source_manifest_sha256" in plan


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    def session(master, folder):
        values = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "file:/warehouse"}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: values.get(k) or d), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_folder(session(master, None), "x")
        assert scratch_folder(session(master, "hdfs://a/b/"), "x").startswith("hdfs://a/b/tidemark-")
    assert scratch_folder(session("local[4]", None), "x").startswith("file:/warehouse/_scratch/")


def test_commit_log(spark, tmp_path):
    log = str(tmp_path / "log")
    for rows in (1, 2, 3):
        append_commit(spark, log, "t", "m", rows)
    assert latest_commit(spark, log, "t").first().rows == 3
    with pytest.raises(ContractError, match="no commit"):
        latest_commit(spark, log, "other")


def test_fingerprints(spark):
    rows = [(sha(str(i % 900).encode()),) for i in range(1000)]
    df = spark.createDataFrame(rows, "_raw_row_sha256 string")
    one, two = fingerprint(df).first(), fingerprint(df.repartition(7)).first()
    assert one == two and (one.row_count, one.distinct_count, one.duplicate_count) == (1000, 900, 100)
    assert fingerprint(df.limit(999)).first().digest != one.digest
    assert fingerprint(df.where("false")).first().row_count == 0


def test_deep_fingerprint_tree_sees_single_changes(spark):
    df = spark.range(300_000).select(F.sha2(F.col("id").cast("string"), 256).alias("_raw_row_sha256"))
    changed = df.where("_raw_row_sha256 != sha2('77', 256)").unionByName(df.where("_raw_row_sha256 = sha2('78', 256)"))
    assert fingerprint(df).first().digest == fingerprint(df.repartition(3)).first().digest
    assert fingerprint(df).first().digest != fingerprint(changed).first().digest


def test_fingerprint_without_a_root_is_refused(spark, monkeypatch):
    monkeypatch.setattr(digests, "LEVELS", 1)
    df = spark.range(300_000).select(F.sha2(F.col("id").cast("string"), 256).alias("_raw_row_sha256"))
    with pytest.raises(Exception, match="more than one root"):
        fingerprint(df).first()


def test_casts(spark):
    df = spark.createDataFrame([("12",), ("12.5",), ("-3.9",), ("x",), ("",), (None,), ("99999999999",), ("NaN",)], "a string").withColumn("b", F.col("a"))
    rows = silver.cast_by_map(df, {"a": "INT", "b": "DOUBLE", "missing": "INT"}).collect()
    assert [r.a for r in rows] == [12, 12, -3, None, None, None, None, None]
    assert [r.b for r in rows][:4] == [12.0, 12.5, -3.9, None]
    assert silver.cast_by_map(df, {"a": "INT"}, truncate=False).collect()[1].a is None


def test_enrich(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, v string")
    mapping = spark.createDataFrame([(1, 10), (1, 10), (2, 20), (2, 21)], "k int, x int")
    out, problems = silver.enrich(rows, mapping, "k", ["x"])
    assert {r.v: r.x for r in out.collect()} == {"a": 10, "b": 10, "c": 20, "d": None, "e": None}
    assert problems.first().asDict() == {"rows": 5, "unmatched_rows": 2, "ambiguous_keys": 1}


def test_key_checks(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3)], "a int, b int")
    assert check_pk(df, ["a", "b"]).first().asDict() == {"rows": 4, "null_rows": 1, "duplicate_keys": 1}
    parent = spark.createDataFrame([(1,)], "p int")
    assert [tuple(r) for r in check_fk(df, parent, "b", "p").orderBy("b").collect()] == [(2, 1), (3, 1)]


def test_reports(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert {r.column: (r.null_rows, r.null_rate) for r in quality_profile(df).collect()} == {"a": (0, 0.0), "b": (1, 0.5)}
    times = spark.range(100).select(F.timestamp_seconds(F.col("id")).alias("a"), F.timestamp_seconds(F.col("id") * 2).alias("b"))
    row = latency(times, ["a", "b"], []).first()
    assert (row.step, row.rows, row.mean, row.p50) == ("a to b", 100, 49.5, 49.0)
    fields = spark.createDataFrame(
        [("d", 1, "name", "Ann", 0.9), ("d", 2, "name", "Anne", 0.5), ("d", 1, "id", "12", 0.7), ("d", 1, "expiry_date", "2020-01-01", None)],
        "document_id string, page int, field string, value string, confidence double")
    got = document_features(fields, ["name", "id", "birth", "city"], {"id": r"^\d+\z", "name": r"^[A-Z][a-z]+\z"}, "2024-01-01").first()
    assert (got.field_coverage, got.confidence_min, got.expired, got.format_validity) == (0.5, 0.5, True, 1.0)
    assert got.confidence_mean == pytest.approx(0.7) and got.page_agreement == pytest.approx(2 / 3)
