"""Files, snapshots and typed layers, written from the order tables into the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identity import row_hash
from tidemark.operators import silver
from tidemark.operators.bronze import stamp_bronze
from tidemark.operators.fingerprint import fingerprint
from tidemark.operators.quality import check_closure
from tidemark.operators.snapshot_diff import snapshot_difference, store_snapshot
from tidemark.plans import credit_sql as sql
from tidemark.plans import credit_tables as credit
from tidemark.plans import workflow
from tidemark.plans.registry import query
from tidemark.session import scratch_folder, settle
from tidemark.settings import MANIFEST
from tidemark.sources.raw_csv import (
    check_columns,
    check_manifest,
    check_manifest_rows,
    headers,
    profile_sources,
    scan_raw_csv,
)
from tidemark.sources.tables import (
    FAILURE_SCHEMA,
    RECEIPT_SCHEMA,
    append_commit,
    check_table_contract,
    ensure_table,
    failure_row,
    latest_commit,
    published,
    read_snapshot,
    receipt_row,
    write_snapshot,
)
from tidemark.sources.topics import read_events, topics, write_updates

#: All columns of the orders.
ORDER_TEXT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _json_sql(columns: list[str]) -> str:
    """A row as a JSON object of texts, columns that are never NULL."""
    return "'{' || " + " || ',' || ".join(f"""'"{c}":' || to_json({c}::VARCHAR)""" for c in columns) + " || '}'"


def _texts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


def _csv(df: DataFrame, name: str) -> str:
    path = scratch_folder(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


@query(f"SELECT {', '.join(f'{c}::VARCHAR AS {c}' for c in ORDER_TEXT)} FROM orders")
def raw_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = _csv(_texts(credit.table(spark, folder, "orders"), ORDER_TEXT), "orders.csv")
    return scan_raw_csv(spark, path, ORDER_TEXT)


@query(f"""SELECT 'orders' AS source, count(*) AS row_count, {len(ORDER_TEXT)} AS columns,
    sha256('{','.join(ORDER_TEXT)}' || chr(10)) AS header_sha256, '' AS missing FROM orders
  UNION ALL SELECT 'customer', count(*), 2, sha256('SK_ID_CURR,c_name' || chr(10)), 'TARGET' FROM customer
  UNION ALL SELECT 'lineitem', count(*), 3, sha256('SK_ID_BUREAU,l_shipdate,STATUS' || chr(10)), 'MONTHS_BALANCE' FROM lineitem""")
def source_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Profile and header contract of CSV copies of three tables; a copy may have many part files."""
    orders = _texts(credit.table(spark, folder, "orders"), ORDER_TEXT)
    customer = credit.table(spark, folder, "customer").select(F.col("c_custkey").alias("SK_ID_CURR"), "c_name")
    lines = credit.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("SK_ID_BUREAU"), "l_shipdate", F.col("l_returnflag").alias("STATUS")
    )
    parts = []
    for source, df, kind in (
        ("orders", orders, ""), ("customer", customer, "application_train.csv"), ("lineitem", lines, "bureau_balance.csv"),
    ):
        path = _csv(df, f"{source}.csv")
        profile = profile_sources(spark, path).agg(
            F.sum("row_count").alias("row_count"), F.max("columns").alias("columns"),
            F.max("header_sha256").alias("header_sha256"),
        )
        found = check_columns(headers(spark, path).withColumn("name", F.lit(kind)))
        missing = found.agg(F.max(F.array_join("missing", ",")))
        parts.append(profile.select(F.lit(source).alias("source"), "*", missing.scalar().alias("missing")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH lines AS (SELECT c_nationkey, c_custkey, c_custkey || ',' || c_name || ',' || c_mktsegment || chr(10) AS line FROM customer)
  SELECT sha256('c_custkey,c_name,c_mktsegment' || chr(10) || string_agg(line, '' ORDER BY c_custkey)) AS sha256,
    sha256('c_custkey,c_name,c_mktsegment' || chr(10)) AS header_sha256, count(*) AS row_count, 3 AS columns FROM lines GROUP BY c_nationkey""")
def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """A file of customers per nation, in order, so that its bytes are known."""
    customers = credit.table(spark, folder, "customer").select("c_nationkey", "c_custkey", "c_name", "c_mktsegment")
    path = scratch_folder(spark, "by-nation")
    ordered = customers.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    ordered.write.option("header", True).partitionBy("c_nationkey").csv(path)
    return profile_sources(spark, f"{path}/*").drop("name")


def _file_list(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a listed file."""
    return credit.table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        (F.col("doc_id") % 3 != 0).alias("required"), F.sha2("text", 256).alias("sha256"),
        F.sha2("lang", 256).alias("header_sha256"), F.col("n_chars").alias("row_count"),
        F.size(F.split("source", "c")).alias("columns"),
    )


_FILES = """files AS (SELECT doc_id, 'doc-' || doc_id || '.txt' AS name, doc_id % 3 <> 0 AS required, sha256(text) AS sha,
    n_chars FROM documents)"""


@query(f"""WITH {_FILES}
  SELECT name, 'name' AS field, 'required file not found' AS message FROM files WHERE required AND doc_id % 7 = 1
  UNION ALL SELECT name, 'sha256', 'content changed' FROM files WHERE doc_id % 7 <> 1 AND doc_id % 11 = 2
  UNION ALL SELECT name, 'row_count', 'row count changed' FROM files WHERE doc_id % 7 <> 1 AND doc_id % 13 = 3
  UNION ALL SELECT name, 'header_sha256', 'is null, profile the sources first' FROM files
    WHERE required AND doc_id % 7 <> 1 AND doc_id % 17 = 4""")
def manifest_differences(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of all documents against files of which some are gone or changed."""
    files = _file_list(spark, folder)
    expected = files.withColumn("header_sha256", F.when(F.col("doc_id") % 17 != 4, F.col("header_sha256")))
    actual = files.where("doc_id % 7 != 1").select(
        "name",
        F.when(F.col("doc_id") % 11 == 2, F.sha2(F.col("sha256"), 256)).otherwise(F.col("sha256")).alias("sha256"),
        "header_sha256",
        (F.col("row_count") + F.when(F.col("doc_id") % 13 == 3, 1).otherwise(0)).alias("row_count"), "columns",
    )
    return check_manifest(expected.drop("doc_id"), actual)


@query(f"""WITH {_FILES}, named AS (SELECT *, CASE WHEN doc_id % 7 = 1 THEN ' ' WHEN doc_id % 7 = 2 THEN 'in/' || name
      WHEN doc_id % 7 = 3 THEN 'same.txt' ELSE name END AS n FROM files)
  SELECT field, message, count(*) AS rows FROM (
    SELECT 'name' AS field, 'must be a non-empty string' AS message FROM named WHERE trim(n) = ''
    UNION ALL SELECT 'name', 'must be a plain file name' FROM named WHERE n LIKE '%/%'
    UNION ALL SELECT 'name', 'duplicate file name' FROM named WHERE n IN (SELECT n FROM named GROUP BY n HAVING count(*) > 1)
    UNION ALL SELECT 'required', 'must be a boolean' FROM named WHERE doc_id % 5 = 0
    UNION ALL SELECT 'required', 'must be true for a required file' FROM named WHERE n = 'same.txt' AND doc_id % 5 = 0
    UNION ALL SELECT 'required', 'must be true for a required file' FROM named WHERE n = 'same.txt' AND doc_id % 5 <> 0 AND NOT required
    UNION ALL SELECT 'name', 'required file missing') GROUP BY ALL""")
def manifest_rule_breaks(spark: SparkSession, folder: str) -> DataFrame:
    kind, own = F.col("doc_id") % 7, F.col("name")
    manifest = _file_list(spark, folder).withColumn(
        "name", F.when(kind == 1, " ").when(kind == 2, F.concat(F.lit("in/"), own)).when(kind == 3, "same.txt").otherwise(own)
    ).withColumn("required", F.when(F.col("doc_id") % 5 != 0, F.col("required")))
    found = check_manifest_rows(manifest.drop("doc_id"), {"same.txt": ["a"], "absent.txt": ["a"]})
    return found.groupBy("field", "message").agg(F.count(F.lit(1)).alias("rows"))


@query(f"""SELECT {', '.join(f'{c}::VARCHAR AS {c}' for c in ORDER_TEXT)}, 'orders.csv' AS _source_file_name, 1 AS _bronze_schema_version,
    sha256('["home_credit","m1","hc-bronze-v1"]') AS _source_snapshot_id, sha256({_json_sql(ORDER_TEXT)}) AS _raw_row_sha256 FROM orders""")
def bronze_rows(spark: SparkSession, folder: str) -> DataFrame:
    raw = _texts(credit.table(spark, folder, "orders"), ORDER_TEXT)
    return stamp_bronze(raw, "orders.csv", "f", "h", "m1").select(
        *ORDER_TEXT, "_source_file_name", "_bronze_schema_version", "_source_snapshot_id", "_raw_row_sha256"
    )


@query("""SELECT doc_id, sha256('{"doc_id":"' || doc_id || '","text":' || to_json(text) || ',"lang":"' || lang
    || '","source":' || to_json(source) || ',"n_chars":"' || n_chars || '","label":' || coalesce('"' || quality || '"', 'null') || '}') AS row_sha FROM documents LEFT JOIN labels USING (doc_id)""")
def document_row_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Row hashes over whole texts, with line breaks, quotes, accents and NULLs."""
    labels = credit.table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = credit.table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars").join(labels, "doc_id", "left")
    return rows.select("doc_id", row_hash(["doc_id", "text", "lang", "source", "n_chars", "label"]).alias("row_sha"))


_TREE = """counted AS (SELECT h, count(*) AS n FROM hashed GROUP BY h),
  sized AS (SELECT greatest(0, ceil(ln(greatest(sum(n), 1) / 1024.0) / ln(16) - 1e-9))::INT AS depth,
    coalesce(sum(n), 0)::BIGINT AS row_count, count(*) AS distinct_count FROM counted),
  l1 AS (SELECT substr(h, 1, depth) AS p, depth, sha256(string_agg(h || ':' || n || chr(10), '' ORDER BY h)) AS d
    FROM counted, sized GROUP BY 1, 2),
  l2 AS (SELECT substr(p, 1, greatest(depth - 3, 0)) AS p, greatest(depth - 3, 0) AS depth,
    sha256(string_agg(p || '=' || d || chr(10), '' ORDER BY p)) AS d FROM l1 GROUP BY 1, 2),
  l3 AS (SELECT substr(p, 1, greatest(depth - 3, 0)) AS p, greatest(depth - 3, 0) AS depth,
    sha256(string_agg(p || '=' || d || chr(10), '' ORDER BY p)) AS d FROM l2 GROUP BY 1, 2),
  l4 AS (SELECT substr(p, 1, greatest(depth - 3, 0)) AS p, greatest(depth - 3, 0) AS depth,
    sha256(string_agg(p || '=' || d || chr(10), '' ORDER BY p)) AS d FROM l3 GROUP BY 1, 2)
  SELECT d AS digest, row_count, distinct_count, row_count - distinct_count AS duplicate_count FROM l4, sized"""
_HASHED = "hashed AS (SELECT sha256(l_orderkey || '|' || l_linenumber) AS h FROM lineitem)"


def _line_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return credit.table(spark, folder, "lineitem").select(F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber"), 256).alias("h"))


@query(f"WITH {_HASHED}, {_TREE}")
def content_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint(_line_hashes(spark, folder), "h")


@query("""SELECT o_orderkey, o_orderkey::INT AS whole, o_orderkey::INT AS cut, o_orderkey + 0.5 AS fraction,
    NULL::INT AS word, NULL::DOUBLE AS word_fraction FROM orders""")
def lenient_casts(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    half = F.concat(key, F.lit(".5"))
    texts = credit.table(spark, folder, "orders").select(
        "o_orderkey", key.alias("whole"), half.alias("cut"), half.alias("fraction"),
        F.col("o_orderpriority").alias("word"), F.col("o_orderstatus").alias("word_fraction"),
    )
    return silver.cast_by_map(
        texts, {"whole": "INT", "cut": "INT", "fraction": "DOUBLE", "word": "INT", "word_fraction": "DOUBLE"}
    )


@query(f"""WITH {sql.BALANCE} SELECT id AS "SK_ID_BUREAU", months AS "MONTHS_BALANCE", status AS "STATUS", curr AS "SK_ID_CURR" FROM balance""")
def enriched_balance(spark: SparkSession, folder: str) -> DataFrame:
    owners = credit.bureau(spark, folder).select("SK_ID_BUREAU", "SK_ID_CURR")
    rows, _ = silver.enrich(credit.raw_balance(spark, folder), owners, "SK_ID_BUREAU", ["SK_ID_CURR"])
    return rows.drop(MANIFEST)


@query("""SELECT (SELECT count(*) FROM orders) AS rows,
    (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)) AS unmatched_rows,
    (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1)) AS ambiguous_keys""")
def enrichment_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Orders enriched with the event type of their customer: many have none, others several."""
    orders = credit.table(spark, folder, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    mapping = credit.table(spark, folder, "events").select(F.col("user_id").alias("k"), "event_type")
    return silver.enrich(orders, mapping, "k", ["event_type"])[1]


def _snapshot(spark: SparkSession, folder: str, manifest: str, factor: int) -> DataFrame:
    return credit.table(spark, folder, "orders").select(
        "o_orderkey", F.round(F.col("o_totalprice") * 100 * factor).cast("bigint").alias("cents"),
        F.lit(manifest).alias(MANIFEST),
    )


@query("""SELECT manifest, count(*) AS rows, sum(cents * f)::BIGINT AS cents, count(*) AS committed
  FROM (SELECT round(o_totalprice * 100)::BIGINT AS cents FROM orders), (VALUES ('m1', 3), ('m2', 2)) AS v(manifest, f)
  GROUP BY manifest""")
def snapshot_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """Two snapshots, the first rewritten with other rows: its partition is replaced, the other stays."""
    target, log = scratch_folder(spark, "orders"), scratch_folder(spark, "commits")
    for manifest, factor in (("m1", 1), ("m2", 2), ("m1", 3)):
        rows = write_snapshot(_snapshot(spark, folder, manifest, factor), target)
        append_commit(spark, log, manifest, manifest, rows)
    parts = []
    for manifest in ("m1", "m2"):
        commit = latest_commit(spark, log, manifest).select("rows")
        parts.append(read_snapshot(spark, target, manifest).agg(
            F.lit(manifest).alias("manifest"), F.count(F.lit(1)).alias("rows"), F.sum("cents").alias("cents"),
            F.max(commit.scalar()).alias("committed"),
        ))
    return parts[0].unionByName(parts[1])


@query("""SELECT 'm1' AS manifest, count(*) AS rows FROM orders UNION ALL SELECT 'm3', count(*) FROM orders""")
def published_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Of three snapshots the two with a COMPLETE receipt are readable downstream."""
    target, receipts = scratch_folder(spark, "orders"), scratch_folder(spark, "receipts")
    for manifest, status in (("m1", "COMPLETE"), ("m2", "RUNNING"), ("m3", "COMPLETE")):
        rows = write_snapshot(_snapshot(spark, folder, manifest, 1), target)
        receipt_row(spark, receipts, "bronze", "run-1", manifest, manifest, target, 0, rows, status=status)
    readable = published(spark.read.parquet(target), spark.read.schema(RECEIPT_SCHEMA).parquet(receipts), "bronze")
    return readable.groupBy(F.col(MANIFEST).alias("manifest")).agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT 'm1' AS manifest, count(*) AS rows FROM orders UNION ALL SELECT 'm3', count(*) FROM orders""")
def published_after_reruns(spark: SparkSession, folder: str) -> DataFrame:
    """Four snapshots of two tables: a rerun of the second one failed, of the fourth one table never came; the third
    one failed first and completed later."""
    target, receipts = scratch_folder(spark, "orders"), scratch_folder(spark, "receipts")
    runs = [("m1", "a", "COMPLETE"), ("m1", "b", "COMPLETE"), ("m2", "a", "COMPLETE"), ("m2", "b", "COMPLETE"), ("m2", "b", "FAILED"),
            ("m3", "a", "COMPLETE"), ("m3", "b", "FAILED"), ("m3", "b", "COMPLETE"), ("m4", "a", "COMPLETE"), ("m4", "b", "RUNNING")]
    written = {m: write_snapshot(_snapshot(spark, folder, m, 1), target) for m in ("m1", "m2", "m3", "m4")}
    for i, (manifest, table, status) in enumerate(runs):
        receipt_row(spark, receipts, "silver", f"run-{i}", manifest, manifest, table, 0, written[manifest], status=status)
    readable = published(spark.read.parquet(target), spark.read.schema(RECEIPT_SCHEMA).parquet(receipts), "silver")
    return readable.groupBy(F.col(MANIFEST).alias("manifest")).agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT 'bronze' AS stage, 'run-1' AS run_id, 'part' AS failed_table, 'orders,customer' AS completed_tables,
    'part: ' || count(*) || ' rows' AS error FROM part
  UNION ALL SELECT 'silver', 'run-2', NULL, '', 'orders: ' || count(*) || ' rows' FROM orders""")
def stage_failures(spark: SparkSession, folder: str) -> DataFrame:
    """What failed stages leave behind: the tables that were done, the one that broke, and why."""
    log = scratch_folder(spark, "failures")
    for stage, run, done, table, failed in (("bronze", "run-1", ["orders", "customer"], "part", "part"), ("silver", "run-2", [], "orders", None)):
        failure_row(spark, log, stage, run, done, failed, f"{table}: {credit.table(spark, folder, table).count()} rows")
    return spark.read.schema(FAILURE_SCHEMA).parquet(log).select(
        "stage", "run_id", "failed_table", F.array_join("completed_tables", ",").alias("completed_tables"), "error")


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_NEW_ORDERS = """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 997 NOT IN (1, 2)
  UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 997 = 1
  UNION ALL SELECT -o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 997 = 3"""


@query(f"""SELECT o_orderkey, 'removed' AS change, count(*) AS rows FROM (SELECT o_orderkey, o_totalprice FROM orders EXCEPT ALL ({_NEW_ORDERS})) GROUP BY 1
  UNION ALL SELECT o_orderkey, 'added', count(*) FROM (({_NEW_ORDERS}) EXCEPT ALL SELECT o_orderkey, o_totalprice FROM orders) GROUP BY 1""")
def snapshot_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Orders against the same with some changed, removed and added rows, by descending two digest trees."""
    orders, kind = credit.table(spark, folder, "orders").select(*_ORDER_COLUMNS), F.col("o_orderkey") % 997
    changed = orders.where(kind != 2).withColumn("o_totalprice", F.when(kind == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    new = changed.unionByName(orders.where(kind == 3).withColumn("o_orderkey", -F.col("o_orderkey")))
    stored = [
        store_snapshot(df.withColumn("_sha", row_hash(_ORDER_COLUMNS)), ["o_orderkey"], "_sha", scratch_folder(spark, name))
        for df, name in ((orders, "old"), (new, "new"))
    ]
    return snapshot_difference(spark, stored[0], stored[1], ["o_orderkey"])


@query("""SELECT l_returnflag, count(*) AS source_rows, count(*) FILTER (l_linestatus = 'O') AS written_rows,
    -count(*) FILTER (l_linestatus <> 'O') AS growth FROM lineitem GROUP BY l_returnflag""")
def row_count_closure(spark: SparkSession, folder: str) -> DataFrame:
    lines = credit.table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus")
    return check_closure(lines, lines.where("l_linestatus = 'O'"), ["l_returnflag"])


@query("""SELECT 'credit.application.v1' AS topic, 'SK_ID_CURR:' || user_id AS key, event_id FROM events""")
def topic_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Events written to a topic of files and read back as messages keyed by entity."""
    events = credit.table(spark, folder, "events").select(
        F.concat(F.lit("SK_ID_CURR:"), F.col("user_id").cast("string")).alias("entity_id"), "event_id", "value"
    )
    path, name = scratch_folder(spark, "topic"), topics()["application"].name
    write_updates(events, path, name)
    messages = read_events(spark, path, names=[name], stream=False)
    return messages.select("topic", "key", F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"))


@query("""SELECT manifest, count(*) AS rows, sum(cents * f)::BIGINT AS cents
  FROM (SELECT round(o_totalprice * 100)::BIGINT AS cents FROM orders), (VALUES ('m1', 3), ('m2', 2)) AS v(manifest, f) GROUP BY manifest""")
def catalog_table_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """The same through a catalog table with a checked contract."""
    location = scratch_folder(spark, "orders")
    name = f"credit_tables.orders_{uuid.uuid4().hex}"
    for manifest, factor in (("m1", 1), ("m2", 2), ("m1", 3)):
        rows = _snapshot(spark, folder, manifest, factor)
        ensure_table(spark, name, rows.schema, MANIFEST, {"layer": "bronze"}, location)
        check_table_contract(spark, name, rows.schema, MANIFEST, {"layer": "bronze"})
        write_snapshot(rows, name)
    return spark.table(name).groupBy(F.col(MANIFEST).alias("manifest")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("cents").alias("cents")
    )


_ONE_STATUS = sql.BALANCE.replace("balance AS (", "all_balance AS (", 1) + """,
  balance AS (SELECT id, curr, months, max(status) AS status FROM all_balance GROUP BY ALL)"""
_ALL = ", ".join([sql.POINTS, sql.BUREAU, _ONE_STATUS, sql.APPLICATION, sql.APP_FEATURES, sql.BUREAU_FEATURES,
                  sql.BALANCE_FEATURES, sql.VALUES])


@query(f"WITH {_ALL} SELECT entity_id, feature_id, round(feature_value, 4) AS feature_value FROM vals")
def files_to_features(spark: SparkSession, folder: str) -> DataFrame:
    """All stages from CSV part files to stored feature values, with manifest, receipts and checks."""
    root = scratch_folder(spark, "workflow")
    months = credit.raw_balance(spark, folder).groupBy("SK_ID_BUREAU", "MONTHS_BALANCE").agg(F.max("STATUS").alias("STATUS"))
    for name, df in (
        ("application_train", credit.application(spark, folder).drop(MANIFEST)),
        ("bureau", credit.bureau(spark, folder).drop(MANIFEST)), ("bureau_balance", months),
    ):
        df.write.option("header", True).csv(f"{root}/csv/{name}.csv")
    layers = workflow.Layers(f"{root}/layers", f"credit_{uuid.uuid4().hex}")
    manifest = settle(workflow.populate_manifest(spark, f"{root}/csv"), "manifest")
    sha = workflow.run_all(spark, layers, f"{root}/csv", manifest, "run-1")
    values = read_snapshot(spark, layers.name("features", "feature_values"), sha)
    return values.select("entity_id", "feature_id", F.round("feature_value", 4).alias("feature_value"))
