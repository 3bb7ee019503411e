"""Quality checks and validation jobs over rows derived from the given tables.

The derivations break one rule or another for some rows, so that both sides of every job are seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.checks import error_counts
from tidemark.functions.identity import shift_days
from tidemark.operators import contracts
from tidemark.operators.catalog import FEATURE_IDS, feature_catalog, feature_specs
from tidemark.operators.features import app_features, assemble, balance_features, bureau_features, to_long
from tidemark.operators.quality import check_feature_closure, check_fk, check_pk
from tidemark.plans import credit_sql as sql
from tidemark.plans import credit_tables as credit
from tidemark.plans.feature_queries import values
from tidemark.plans.registry import query
from tidemark.sources.topics import source_topics


@query("""SELECT (SELECT count(*) FROM orders) AS rows, (SELECT count(*) FROM orders WHERE o_orderkey IS NULL) AS null_rows,
    (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys""")
def primary_key_check(spark: SparkSession, folder: str) -> DataFrame:
    return check_pk(credit.table(spark, folder, "orders"), ["o_orderkey"])


@query("""WITH k AS (SELECT l_orderkey AS a, nullif(l_linenumber, 7) AS b FROM lineitem)
  SELECT (SELECT count(*) FROM k) AS rows, (SELECT count(*) FROM k WHERE a IS NULL OR b IS NULL) AS null_rows,
    (SELECT count(*) FROM (SELECT a, b FROM k GROUP BY a, b HAVING count(*) > 1)) AS duplicate_keys""")
def composite_key_check(spark: SparkSession, folder: str) -> DataFrame:
    lines = credit.table(spark, folder, "lineitem")
    return check_pk(lines.select("l_orderkey", F.nullif("l_linenumber", F.lit(7)).alias("n")), ["l_orderkey", "n"])


@query("""SELECT o_custkey, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY 1""")
def foreign_key_check(spark: SparkSession, folder: str) -> DataFrame:
    return check_fk(credit.table(spark, folder, "orders"), credit.table(spark, folder, "events"), "o_custkey", "user_id")


_KEPT = FEATURE_IDS[:-1]


@query(f"""WITH {sql.ALL_VALUES}, changed AS (
    SELECT prediction_id, CASE WHEN feature_id = '{FEATURE_IDS[-1]}' AND label = 1 THEN 'app.unknown' ELSE feature_id END AS feature_id
    FROM vals UNION ALL SELECT prediction_id, feature_id FROM vals WHERE feature_id = '{FEATURE_IDS[0]}' AND split = 'oot')
  SELECT breach, prediction_id, feature_id, rows FROM (
    SELECT 'duplicate_pair' AS breach, prediction_id, feature_id, count(*) AS rows FROM changed GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'unknown_feature', NULL, feature_id, count(*) FROM changed WHERE feature_id = 'app.unknown' GROUP BY feature_id
    UNION ALL SELECT 'incomplete_prediction', prediction_id, NULL, count(DISTINCT feature_id) FROM changed
      WHERE feature_id <> 'app.unknown' GROUP BY prediction_id HAVING count(DISTINCT feature_id) < {len(FEATURE_IDS)})""")
def feature_closure_check(spark: SparkSession, folder: str) -> DataFrame:
    """Feature values with one feature renamed for defaulters and another doubled out of time."""
    points = credit.points(spark, folder)
    # Label and split come along from the points, so that no value is shuffled for them.
    wide = assemble(points, *_groups(spark, folder), carry=["label", "split"])
    marked = to_long(wide, ["prediction_id", "label", "split"])
    renamed = (F.col("feature_id") == FEATURE_IDS[-1]) & (F.col("label") == 1)
    doubled = (F.col("feature_id") == FEATURE_IDS[0]) & (F.col("split") == "oot")
    changed = marked.select(
        "prediction_id", F.when(renamed, "app.unknown").otherwise(F.col("feature_id")).alias("feature_id"),
        F.explode(F.array_repeat(F.lit(0), F.when(doubled, 2).otherwise(1))).alias("copy"))
    return check_feature_closure(changed.drop("copy"), feature_catalog(spark), points)


def _groups(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [app_features(credit.application(spark, folder)), bureau_features(credit.bureau(spark, folder)),
            balance_features(credit.balance(spark, folder))]


@query(f"""WITH {sql.ALL_VALUES}
  SELECT 'incomplete_prediction' AS breach, prediction_id, NULL AS feature_id, 0 AS rows FROM vals WHERE split = 'oot' GROUP BY prediction_id
  UNION ALL SELECT 'unknown_prediction', prediction_id, NULL, count(*) FROM vals WHERE split = 'validation' GROUP BY prediction_id""")
def lost_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """All values of one split are lost, and one split's predictions are no points."""
    points = credit.points(spark, folder)
    kept = to_long(assemble(points.where("split <> 'oot'"), *_groups(spark, folder)), ["prediction_id"])
    return check_feature_closure(kept, feature_catalog(spark), points.where("split <> 'validation'"))


def _case(kind: Column, cases: dict[int, object], otherwise: Column) -> Column:
    result = otherwise
    for k, v in cases.items():
        result = F.when(kind == k, v if isinstance(v, Column) else F.lit(v)).otherwise(result)
    return result


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as contract rows; the kind decides what is wrong with a row. Kind 9 breaks the id only."""
    kind = F.col("event_id") % 12
    source = credit.table(spark, folder, "events").select(
        kind.alias("kind"), F.col("event_id").alias("n"), "user_id", "value",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"), "event_type",
    )
    kind, n = F.col("kind"), F.col("n").cast("string")
    text = F.col("t")
    rows = source.select(
        "n", "kind", F.lit("home_credit").alias("dataset_id"),
        _case(kind, {1: "loan"}, F.lit("customer")).alias("entity_type"),
        _case(kind, {2: " "}, F.concat(F.lit("customer:"), F.col("user_id").cast("string"))).alias("entity_id"),
        F.concat(F.lit("customer:"), F.col("user_id").cast("string")).alias("customer_id"),
        _case(kind, {3: F.col("event_type")}, F.lit("label_feedback")).alias("event_type"),
        _case(kind, {4: text}, F.concat(text, F.lit("Z"))).alias("event_time"),
        _case(kind, {5: "1999-01-01T00:00:00+00:00"}, F.concat(text, F.lit("Z"))).alias("available_at"),
        F.concat(text, F.lit("+00:00")).alias("ingested_at"), F.lit("web").alias("source_system"),
        _case(kind, {6: 0}, F.lit(1)).cast("int").alias("schema_version"),
        _case(kind, {7: "", 8: ""}, F.concat(F.lit("event:"), n)).alias("source_record_id"),
        F.lit("r1").alias("source_record_revision"),
        _case(kind, {8: F.upper(F.sha2(n, 256)), 10: F.concat(F.sha2(n, 256), F.lit("\n"))}, F.lit(None).cast("string"))
        .alias("payload_sha256"),
        F.create_map(F.lit("k"), _case(kind, {11: F.lit(None).cast("string")}, F.lit("v"))).alias("headers"),
    )
    typed = contracts.with_times(rows, ["event_time"])
    # The id is computed from the row as it is, so only kind 9 has a wrong one.
    right = contracts.expected_event_id()
    ids = typed.select("n", _case(F.col("kind"), {9: F.lit("0")}, F.coalesce(right, F.lit("none"))).alias("event_id"))
    return rows.join(ids, "n").drop("kind")


_EVENT_ID = """CASE WHEN k = 8 THEN sha256('["home_credit","customer","customer:' || user_id || '","label_feedback","'
    || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","payload_sha256","' || sha256(event_id::VARCHAR) || '"]')
  ELSE sha256('["home_credit","customer","customer:' || user_id || '","label_feedback","'
    || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","source_record","event:' || event_id || '","r1"]') END"""


@query(f"""SELECT event_id AS n, {_EVENT_ID} AS event_id, CASE WHEN k = 8 THEN sha256(event_id::VARCHAR) END AS payload_sha256
  FROM (SELECT *, event_id % 12 AS k FROM events) WHERE k IN (0, 8)""")
def valid_events(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.validate_events(_events(spark, folder))[0].select("n", "event_id", "payload_sha256")


_EVENT_ERRORS = """(1, 'entity_type', 'unknown entity type'), (2, 'entity_id', 'must be non-empty'),
  (3, 'event_type', 'unknown event type'), (4, 'event_time', 'must be a time with zone'),
  (5, 'event_time', 'must not be after available_at'), (6, 'schema_version', 'must be >= 1'),
  (7, 'source_record_id', 'record id or payload hash required'), (9, 'event_id', 'does not follow from the content'),
  (10, 'payload_sha256', 'must be 64 hexadecimal characters'), (11, 'headers', 'values must be strings')"""


@query(f"""SELECT field, message, count(*) AS rows FROM events
  JOIN (VALUES {_EVENT_ERRORS}) AS e(k, field, message) ON event_id % 12 = k GROUP BY ALL""")
def event_errors(spark: SparkSession, folder: str) -> DataFrame:
    return error_counts(contracts.validate_events(_events(spark, folder))[1])


def _points(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("SK_ID_CURR") % 11
    rows = credit.applicants(spark, folder).select("SK_ID_CURR")
    good = credit.points(spark, folder).withColumn("SK_ID_CURR", F.substring_index("entity_id", ":", -1).cast("bigint"))
    df = good.join(rows, "SK_ID_CURR")
    nothing, text = F.lit(None), F.lit(None).cast("string")
    return df.select(
        _case(kind, {1: ""}, F.col("prediction_id")).alias("prediction_id"), "entity_id", "prediction_time",
        _case(kind, {2: "test", 3: "online", 4: "online"}, F.lit("train")).alias("split"),
        _case(kind, {5: text}, F.col("snapshot_id")).alias("snapshot_id"),
        _case(kind, {4: text, 6: " "}, F.col("boundary_version")).alias("boundary_version"),
        _case(kind, {4: nothing.cast("double"), 7: F.lit(1.5), 8: nothing.cast("double")}, F.col("label")).alias("label"),
        _case(kind, {4: nothing.cast("timestamp"), 9: nothing.cast("timestamp"), 10: F.col("prediction_time")},
              F.col("label_time")).alias("label_time"),
    )


_POINT_ERRORS = """(1, 'prediction_id', 'must be non-empty'), (2, 'split', 'unknown split'), (3, 'label', 'not allowed online'),
  (4, 'boundary_version', 'required online'), (5, 'snapshot_id', 'required for a training split'),
  (6, 'boundary_version', 'required for a training split'), (7, 'label', 'must be in [0, 1]'),
  (8, 'label', 'required with a label time'), (9, 'label_time', 'required with a label'),
  (10, 'label_time', 'must be after prediction_time')"""


@query(f"""SELECT field, message, count(*) AS rows FROM customer
  JOIN (VALUES {_POINT_ERRORS}) AS e(k, field, message) ON c_custkey % 11 = k GROUP BY ALL""")
def prediction_point_errors(spark: SparkSession, folder: str) -> DataFrame:
    return error_counts(contracts.validate_points(_points(spark, folder))[1])


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as catalog rows."""
    kind = F.col("p_partkey") % 9
    key = F.col("p_partkey").cast("string")
    return credit.table(spark, folder, "part").select(
        F.concat(F.lit("part."), key).alias("feature_id"), F.col("p_name").alias("feature_name"), F.lit("part").alias("entity_type"),
        F.col("p_brand").alias("feature_group"), F.lit("part").alias("source_system"), F.lit("now").alias("event_time_rule"),
        _case(kind, {1: " "}, F.lit("now")).alias("availability_rule"),
        _case(kind, {2: "later"}, F.lit("decision")).alias("stage"), (kind == 8).alias("online_available"),
        _case(kind, {3: 0}, F.lit(None).cast("bigint")).cast("bigint").alias("ttl"),
        _case(kind, {4: ""}, F.lit("team")).alias("owner"), _case(kind, {5: 0}, F.lit(1)).cast("int").alias("version"),
        _case(kind, {6: "unknown"}, F.lit("temporal")).alias("leakage_risk"),
        _case(kind, {7: F.lit(None).cast("string")}, F.col("p_brand")).alias("semantic_group_id"),
        (F.col("p_retailprice") - F.when(kind == 6, 1e9).otherwise(0.0)).alias("cost_unit"),
        F.lit("p_size + 1").alias("lineage_expression"), F.lit("").alias("description"), F.array(F.lit("x")).alias("tags"),
    )


@query("""SELECT field, message, count(*) AS rows FROM part JOIN (VALUES (1, 'availability_rule', 'must be non-empty'),
    (2, 'stage', 'unknown stage'), (3, 'ttl', 'must be positive'), (5, 'version', 'must be >= 1'),
    (6, 'cost_unit', 'must be non-negative')) AS e(k, field, message) ON p_partkey % 9 = k GROUP BY ALL""")
def catalog_errors(spark: SparkSession, folder: str) -> DataFrame:
    return error_counts(contracts.validate_catalog(_catalog(spark, folder))[1])


@query("""SELECT 'part.' || p_partkey AS feature_id FROM part WHERE p_partkey % 9 NOT IN (4, 6, 7, 8)""")
def publishable_features(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.publishable(_catalog(spark, folder))[0].select("feature_id")


@query("""SELECT message, count(*) AS rows FROM (
    SELECT CASE p_partkey % 9 WHEN 4 THEN 'owner must be non-empty' WHEN 6 THEN 'leakage_risk must be known'
      WHEN 7 THEN 'semantic_group_id must be set' ELSE 'ttl required for an online feature' END AS message
    FROM part WHERE p_partkey % 9 IN (4, 6, 7, 8)
    UNION ALL SELECT 'has no group' FROM part WHERE p_size <= 10
    UNION ALL SELECT 'belongs to another group' FROM part WHERE p_size > 40 AND p_partkey % 9 <> 7
    UNION ALL SELECT 'is not in the catalog' FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part WHERE false)) GROUP BY message""")
def catalog_closure_breaches(spark: SparkSession, folder: str) -> DataFrame:
    """Parts against a mapping that lacks the small ones, misplaces the large ones and adds suppliers."""
    mapping = credit.table(spark, folder, "part").where("p_size > 10").select(
        F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("feature_id"),
        F.when(F.col("p_size") > 40, "other").otherwise(F.col("p_brand")).alias("group_id"),
    ).unionByName(credit.table(spark, folder, "supplier").select(
        F.concat(F.lit("supplier."), F.col("s_suppkey").cast("string")).alias("feature_id"), F.lit("s").alias("group_id")
    ))
    breaches = contracts.catalog_closure(_catalog(spark, folder), mapping)
    return breaches.groupBy("message").agg(F.count(F.lit(1)).alias("rows"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as parse results, linked or not."""
    kind = F.col("doc_id") % 10
    docs = credit.table(spark, folder, "documents").join(credit.table(spark, folder, "labels"), "doc_id", "left")
    text = F.lit(None).cast("string")
    return docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("document_id"),
        _case(kind, {1: ""}, F.concat(F.lit("store://"), F.col("source"))).alias("object_uri"),
        _case(kind, {2: F.lit("ab")}, F.upper(F.sha2("text", 256))).alias("content_sha256"), F.col("lang").alias("document_type"),
        _case(kind, {3: " ", 6: text}, F.concat(F.lit("SK_ID_CURR:"), F.col("doc_id").cast("string"))).alias("entity_id"),
        _case(kind, {3: "verified", 4: "guessed", 6: "unlinked", 7: "synthetic"}, F.lit("verified")).alias("linkage_status"),
        F.lit("crm").alias("linkage_source"), _case(kind, {8: " "}, F.lit("v1")).alias("linkage_version"),
        F.lit("store://link").alias("linkage_evidence_uri"), F.lit("2024-01-01T00:00:00Z").alias("linked_at"),
        F.least(F.col("n_chars") / 10000, F.lit(1.0)).alias("ocr_confidence"),
        F.col("quality").cast("double").alias("field_coverage"),
        _case(kind, {9: F.lit(1.5)}, F.lit(0.5)).alias("image_quality_score"), (F.col("toxic") == 1).alias("tamper_signal"),
        _case(kind, {5: F.lit("2024-01-01T00:00:00")}, F.lit("2024-01-02 10:00:00+01:00")).alias("processed_at"),
    )


@query("""SELECT field, message, count(*) AS rows FROM documents JOIN (VALUES (1, 'object_uri', 'must be non-empty'),
    (2, 'content_sha256', 'must be 64 hexadecimal characters'), (3, 'entity_id', 'required for a linked document'),
    (4, 'linkage_status', 'unknown linkage'), (5, 'processed_at', 'must be a time with zone'),
    (9, 'image_quality_score', 'must be in [0, 1]')) AS e(k, field, message) ON doc_id % 10 = k GROUP BY ALL""")
def document_errors(spark: SparkSession, folder: str) -> DataFrame:
    return error_counts(contracts.validate_documents(_documents(spark, folder))[1])


@query("""SELECT doc_id, sha256(text) AS content_sha256, strict FROM (
    SELECT doc_id, text, unnest([true, false]) AS strict FROM documents WHERE doc_id % 10 IN (0, 7))
  WHERE NOT (strict AND doc_id % 10 = 7)""")
def eligible_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents a model may use, without and with synthetic links."""
    valid, _ = contracts.validate_documents(_documents(spark, folder))
    parts = [
        contracts.document_eligible(valid, allow).select("doc_id", "content_sha256", F.lit(not allow).alias("strict"))
        for allow in (False, True)
    ]
    return parts[0].unionByName(parts[1])


@query("""SELECT field, message, count(*) AS rows FROM (
    SELECT 'CREDIT_ACTIVE' AS field, 'unknown word' AS message FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 <> 4
    UNION ALL SELECT 'AMT_CREDIT_SUM', 'must be a number' FROM orders WHERE o_orderkey % 5 = 1
    UNION ALL SELECT 'payload', 'has unknown fields' FROM orders WHERE o_orderkey % 5 = 2
    UNION ALL SELECT 'SK_ID_BUREAU', 'must be a whole number' FROM orders WHERE o_orderkey % 5 = 3
    UNION ALL SELECT 'payload', 'must be a JSON object' FROM orders WHERE o_orderkey % 5 = 4) GROUP BY ALL""")
def bureau_payload_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as payloads of which some have wrong fields and some are no JSON; the latter have no state to judge."""
    kind = F.col("o_orderkey") % 5
    state = F.when(F.col("o_orderstatus") == "O", "Active").when(F.col("o_orderstatus") == "F", "Closed").otherwise("Sold")
    orders = credit.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", state.alias("state"))

    def document(**changes: Column) -> Column:
        fields = {
            "SK_ID_CURR": F.col("o_custkey"), "SK_ID_BUREAU": F.col("o_orderkey"), "CREDIT_ACTIVE": F.col("state"),
            "AMT_CREDIT_SUM": F.col("o_totalprice"),
        } | changes
        return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))

    payload = _case(kind, {
        1: document(AMT_CREDIT_SUM=F.col("o_totalprice").cast("string")), 2: document(COLOUR=F.lit("red")),
        3: document(SK_ID_BUREAU=F.col("o_orderkey") + 0.5), 4: F.concat(F.lit("{"), document()),
    }, document())
    rows = orders.select(payload.alias("payload"))
    return error_counts(contracts.validate_payloads(rows, "bureau_upsert")[1])


@query("""SELECT field, message, count(*) AS rows FROM (
    SELECT 'STATUS' AS field, 'unknown word' AS message FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') AND l_returnflag <> 'X'
    UNION ALL SELECT 'SK_ID_CURR', 'is required' FROM lineitem WHERE l_linenumber = 7
    UNION ALL SELECT 'MONTHS_BALANCE', 'must be a whole number' FROM lineitem WHERE l_linenumber = 6) GROUP BY ALL""")
def balance_payload_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines whose return flag is no balance status, with gaps."""
    number = F.col("l_linenumber")
    fields = [
        F.when(number != 7, F.col("l_suppkey")).alias("SK_ID_CURR"), F.col("l_orderkey").alias("SK_ID_BUREAU"),
        F.when(number == 6, "soon").otherwise(F.lit(None).cast("string")).alias("MONTHS_BALANCE"), F.col("l_returnflag").alias("STATUS"),
    ]
    rows = credit.table(spark, folder, "lineitem").select(F.to_json(F.struct(*fields)).alias("payload"))
    return error_counts(contracts.validate_payloads(rows, "bureau_balance_upsert")[1])


@query("""SELECT field, message, count(*) AS rows FROM (
    SELECT 'FLAG_DOCUMENT_2' AS field, 'must be 0 or 1' AS message FROM customer WHERE c_nationkey > 1
    UNION ALL SELECT 'AMT_CREDIT', 'must be a number' FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL""")
def application_payload_errors(spark: SparkSession, folder: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    fields = [
        F.col("c_custkey").alias("SK_ID_CURR"), F.col("c_acctbal").alias("AMT_INCOME_TOTAL"),
        F.when(segment == "BUILDING", segment).alias("AMT_CREDIT"), F.col("c_nationkey").alias("FLAG_DOCUMENT_2"),
        F.lit(1).alias("FLAG_DOCUMENT_3"), F.lit(-9000).alias("DAYS_BIRTH"),
    ]
    rows = credit.table(spark, folder, "customer").select(F.to_json(F.struct(*fields)).alias("payload"))
    return error_counts(contracts.validate_payloads(rows, "application_upsert")[1])


def balance_envelopes(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """One envelope per order line, with a right id; times differ by line so that keys are updated.

    A line without an applicant has an envelope too, which breaks the rules on entity and payload. With ``files`` lines are
    dealt over so many by their values, equal ones to one file: they are a tenth of their text.
    """
    rows = credit.balance(spark, folder).select(
        F.col("SK_ID_CURR").cast("bigint").alias("curr"), "SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS"
    )
    rows = rows.repartition(files, *rows.columns) if files else rows
    payload = F.to_json(F.struct(
        F.col("MONTHS_BALANCE"), F.col("SK_ID_BUREAU"), F.col("curr").alias("SK_ID_CURR"), F.col("STATUS")
    ))
    envelope = rows.select(
        F.lit(1).alias("schema_version"), F.lit("bureau_balance_upsert").alias("event_type"),
        F.lit("bureau_balance").alias("source_table"),
        F.concat_ws(":", "SK_ID_BUREAU", "MONTHS_BALANCE").alias("source_pk"),
        F.concat(F.lit("SK_ID_CURR:"), F.col("curr").cast("string")).alias("entity_id"), F.lit("UPSERT").alias("op"),
        shift_days(F.expr("timestamp'2024-01-01T00:00:00Z'"), F.col("MONTHS_BALANCE")).alias("event_time"),
        F.expr("timestamp'2024-06-01T00:00:00Z'").alias("produced_at"), payload.alias("payload"), "MONTHS_BALANCE",
    )
    return envelope.withColumn("event_id", contracts.expected_envelope_id(True))


_ENVELOPE_SQL = f"""WITH {sql.BALANCE}, envelopes AS (
    SELECT *, id || ':' || months AS pk, '{{"MONTHS_BALANCE":' || months || ',"SK_ID_BUREAU":' || id || ',"SK_ID_CURR":' || curr
      || ',"STATUS":"' || status || '"}}' AS payload, strftime(TIMESTAMP '2024-01-01' + to_days(months::INT), '%Y-%m-%dT%H:%M:%S+00:00') AS t
    FROM balance WHERE curr IS NOT NULL)
  SELECT 'sha256:' || sha256('["bureau_balance","' || pk || '","' || t || '","UPSERT",' || to_json(payload) || ']') AS event_id, pk AS source_pk
  FROM envelopes"""


@query(_ENVELOPE_SQL)
def valid_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.validate_envelopes(balance_envelopes(spark, folder))[0].select("event_id", "source_pk")


@query(f"""WITH {sql.BALANCE}, b AS (SELECT pmod, lost, count(*) AS n FROM (SELECT ((months % 7) + 7) % 7 AS pmod, curr IS NULL AS lost FROM balance) GROUP BY 1, 2)
  SELECT field, message, sum(n)::BIGINT AS rows FROM (SELECT DISTINCT pmod, lost, n, field, message FROM b JOIN (VALUES (-1, 'entity_id', 'must be SK_ID_CURR: and digits'),
    (-1, 'payload', 'does not fit the event type'), (1, 'schema_version', 'unknown version'),
    (2, 'entity_id', 'must be SK_ID_CURR: and digits'), (3, 'event_type', 'does not fit the table'),
    (3, 'payload', 'does not fit the event type'), (4, 'event_id', 'does not follow from the content'),
    (5, 'event_id', 'must be sha256: and 64 hexadecimal characters'), (5, 'event_id', 'does not follow from the content'),
    (6, 'payload', 'does not fit the event type'), (6, 'event_id', 'does not follow from the content')) AS e(k, field, message) ON pmod = k OR (k = -1 AND lost)) AS x GROUP BY ALL""")
def envelope_errors(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.pmod("MONTHS_BALANCE", F.lit(7))
    rows = balance_envelopes(spark, folder)
    rows = rows.withColumns({
        "schema_version": _case(kind, {1: 2}, F.col("schema_version")).cast("int"),
        "entity_id": _case(kind, {2: F.concat("entity_id", F.lit("\n"))}, F.col("entity_id")),
        "event_type": _case(kind, {3: "bureau_upsert"}, F.col("event_type")),
        "source_pk": _case(kind, {4: F.concat("source_pk", F.lit("x"))}, F.col("source_pk")),
        "event_id": _case(kind, {5: F.upper(F.col("event_id"))}, F.col("event_id")),
        "payload": _case(kind, {6: F.regexp_replace("payload", '"STATUS":"', '"STATUS":"9')}, F.col("payload")),
    })
    return error_counts(contracts.validate_envelopes(rows)[1])


@query("""SELECT field, message, count(*) AS rows FROM (SELECT event_id % 6 AS k, value FROM events)
  JOIN (VALUES (1, 'feature_id', 'not in the catalog'), (2, 'feature_version', 'must be positive'),
    (2, 'feature_update_id', 'does not follow from the content'), (3, 'computed_at', 'must not be before event_time'),
    (4, 'source_topic', 'unknown topic'), (5, 'feature_value', 'must be finite or missing')) AS e(k, field, message) USING (k) GROUP BY ALL""")
def feature_update_errors(spark: SparkSession, folder: str) -> DataFrame:
    return error_counts(contracts.validate_updates(_updates(spark, folder), source_topics())[1])


@query("""SELECT event_id, 'SK_ID_CURR:' || user_id AS entity_id FROM events WHERE event_id % 6 = 0""")
def valid_feature_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Updates with ids over seventeen-digit values; SQL checks which rows pass, not the id text."""
    return contracts.validate_updates(_updates(spark, folder), source_topics())[0].select("event_id", "entity_id")


@query(f"""SELECT event_id, 'sha256:' || sha256('["SK_ID_CURR:' || user_id || '","{FEATURE_IDS[0]}","1","' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00","' || CASE WHEN value IS NULL THEN 'null'
    WHEN round(value * 2)::BIGINT % 2 = 0 THEN (round(value * 2)::BIGINT // 2)::VARCHAR ELSE (round(value * 2) / 2)::VARCHAR END || '"]') AS feature_update_id
  FROM events""")
def feature_update_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of updates whose values are whole or half numbers."""
    c = F.col
    entity = F.concat(F.lit("SK_ID_CURR:"), c("user_id").cast("string"))
    identity = contracts.feature_update_id(entity, F.lit(FEATURE_IDS[0]), F.lit(1), c("ts").cast("timestamp"), F.round(c("value") * 2) / 2)
    return credit.table(spark, folder, "events").select("event_id", identity.alias("feature_update_id"))


def _updates(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_id") % 6
    events = credit.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    c = F.col
    rows = events.select(
        "event_id", kind.alias("kind"), F.concat(F.lit("SK_ID_CURR:"), c("user_id").cast("string")).alias("entity_id"),
        _case(kind, {1: "app.unknown"}, F.lit(FEATURE_IDS[0])).alias("feature_id"),
        _case(kind, {5: F.lit(float("inf"))}, c("value") / 3).alias("feature_value"), F.lit(1).alias("feature_version"),
        c("ts").alias("event_time"), F.when(kind == 3, c("ts") - F.expr("interval 1 day")).otherwise(c("ts")).alias("computed_at"),
        F.concat(F.lit("sha256:"), F.sha2(c("event_id").cast("string"), 256)).alias("source_event_id"),
        _case(kind, {4: "other"}, F.lit(source_topics()[0])).alias("source_topic"), F.lit("stream").alias("computation_mode"),
        F.lit("VALID").alias("quality_status"),
    )
    identity = contracts.feature_update_id(
        c("entity_id"), c("feature_id"), c("feature_version"), c("event_time"), c("feature_value")
    )
    some = F.coalesce(identity, F.concat(F.lit("sha256:"), F.sha2(F.lit(""), 256)))
    return rows.withColumn("feature_update_id", some).withColumn(
        "feature_version", F.when(F.col("kind") == 2, 0).otherwise(c("feature_version"))
    )


@query("""SELECT message, count(*) AS rows FROM (
    SELECT 'has no spec' AS message FROM part WHERE p_size <= 5
    UNION ALL SELECT 'has no stream expression' FROM part WHERE p_size > 5 AND p_partkey % 4 = 1
    UNION ALL SELECT 'has an unknown source' FROM part WHERE p_size > 5 AND p_partkey % 4 = 2
    UNION ALL SELECT 'has no temporal filter' FROM part WHERE p_size > 5 AND p_partkey % 4 = 3) GROUP BY message""")
def spec_closure_breaches(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as specs: small ones are absent, the rest lack one thing or another."""
    kind = F.col("p_partkey") % 4
    specs = credit.table(spark, folder, "part").where("p_size > 5").select(
        F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("feature_id"),
        _case(kind, {2: "part"}, F.lit("bureau")).alias("source_table"), F.lit("batch").alias("batch_ref"),
        _case(kind, {1: " "}, F.lit("count(1)")).alias("expression_sql"),
        _case(kind, {3: F.lit(None).cast("string")}, F.lit("DAYS_CREDIT <= 0")).alias("input_filter_sql"),
    )
    breaches = contracts.spec_closure(_catalog(spark, folder), specs)
    own = contracts.spec_closure(feature_catalog(spark), feature_specs(spark))
    return breaches.unionByName(own).groupBy("message").agg(F.count(F.lit(1)).alias("rows"))
