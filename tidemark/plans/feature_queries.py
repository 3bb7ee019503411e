"""Prediction points, features and rules over the credit view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identity import (
    assign_split,
    entity_id,
    hash_bucket,
    instant,
    normalize_id,
    parse_label,
    shift_days,
    shift_months,
    utc_text,
)
from tidemark.operators.catalog import FEATURE_IDS, FEATURES
from tidemark.operators.events import EventSource, to_events
from tidemark.operators.features import (
    app_features,
    assemble,
    balance_features,
    bureau_features,
    feature_values,
    run_specs,
    to_long,
    to_wide,
)
from tidemark.operators.latest import first_value_per_key, latest_per_key, pit_join, top_rows
from tidemark.operators.quality import as_of, set_diff
from tidemark.operators.ranks import equal_count_bins
from tidemark.operators.salted import salted_join
from tidemark.operators.states import balance_features_as_of, bureau_features_as_of, finish, merge_states, partial_states
from tidemark.operators.woe import (
    apply_woe, check_training_closure, entropy, fit_mean_split, fit_woe, fit_woe_wide, placed_points, woe_summary,
)
from tidemark.plans import credit_sql as sql
from tidemark.plans import credit_tables as credit
from tidemark.plans.registry import query
from tidemark.session import settle
from tidemark.settings import Boundary

SECONDS = "yyyy-MM-dd HH:mm:ss"


def values(spark: SparkSession, folder: str) -> DataFrame:
    return feature_values(
        credit.points(spark, folder), credit.application(spark, folder), credit.bureau(spark, folder),
        credit.balance(spark, folder),
    )


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _short(df: DataFrame, source: str) -> DataFrame:
    names = [f.feature_id for f in FEATURES if f.source == source]
    return df.select("SK_ID_CURR", *[F.round(f"`{n}`", 4).alias(sql.short(n)) for n in names])


def _wide_sql(view: str, expressions: dict[str, str]) -> str:
    columns = ", ".join(f"round({sql.short(f)}, 4) AS {sql.short(f)}" for f in expressions)
    return f'SELECT curr AS "SK_ID_CURR", {columns} FROM {view}'


@query(f"""WITH {sql.POINTS}
  SELECT prediction_id, entity_id, '2000-01-01 00:00:00' AS prediction_time, split, {sql.POINTS_SNAPSHOT} AS snapshot_id,
    'hc-boundary-v1' AS boundary_version, label, '2000-12-31 00:00:00' AS label_time FROM points""")
def prediction_points(spark: SparkSession, folder: str) -> DataFrame:
    points = credit.points(spark, folder)
    return points.select(
        "prediction_id", "entity_id", utc_text(F.col("prediction_time"), SECONDS).alias("prediction_time"), "split",
        "snapshot_id", "boundary_version", "label", utc_text(F.col("label_time"), SECONDS).alias("label_time"),
    )


@query(f"""SELECT o_orderkey, {sql.bucket("'SK_ID_CURR:' || o_orderkey")} AS bucket,
    {sql.split("'SK_ID_CURR:' || o_orderkey")} AS split FROM orders""")
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    boundary = Boundary()
    orders = credit.table(spark, folder, "orders").select("o_orderkey")
    bucket = hash_bucket(entity_id(F.col("o_orderkey")), boundary.seed, boundary.modulus, boundary.dataset)
    return orders.withColumn("bucket", bucket).withColumn("split", assign_split(F.col("bucket"), boundary))


_MESSY_ID = """CASE o_orderkey % 5 WHEN 0 THEN '  00' || o_orderkey || ' ' WHEN 1 THEN '-' || o_orderkey
  WHEN 2 THEN o_orderkey || '.0' WHEN 3 THEN '000' ELSE o_orderkey::VARCHAR END"""


@query(f"""SELECT o_orderkey, id, 'customer:' || id AS customer FROM (
    SELECT o_orderkey, CASE WHEN regexp_full_match(trim(m), '[0-9]+')
      THEN coalesce(nullif(ltrim(trim(m), '0'), ''), '0') END AS id
    FROM (SELECT o_orderkey, {_MESSY_ID} AS m FROM orders))""")
def normalized_ids(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 5
    messy = (
        F.when(kind == 0, F.concat(F.lit("  00"), key, F.lit(" "))).when(kind == 1, F.concat(F.lit("-"), key))
        .when(kind == 2, F.concat(key, F.lit(".0"))).when(kind == 3, "000").otherwise(key)
    )
    orders = credit.table(spark, folder, "orders").select("o_orderkey", messy.alias("m"))
    return orders.select("o_orderkey", normalize_id(F.col("m")).alias("id"), entity_id(F.col("m"), "customer").alias("customer"))


@query("""SELECT o_orderpriority, label, count(*) AS rows FROM (
    SELECT o_orderpriority, CASE WHEN trim(t) IN ('0', '1') THEN trim(t)::DOUBLE END AS label
    FROM (SELECT o_orderpriority, ' ' || substr(o_orderpriority, 1, 1) AS t FROM orders
      UNION ALL SELECT l_linestatus, (l_linenumber % 2)::VARCHAR FROM lineitem)) GROUP BY ALL""")
def parsed_labels(spark: SparkSession, folder: str) -> DataFrame:
    orders = credit.table(spark, folder, "orders").select(
        "o_orderpriority", F.concat(F.lit(" "), F.substring("o_orderpriority", 1, 1)).alias("t")
    )
    lines = credit.table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("o_orderpriority"), (F.col("l_linenumber") % 2).cast("string").alias("t")
    )
    return orders.unionByName(lines).groupBy("o_orderpriority", parse_label(F.col("t")).alias("label")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(f"""WITH {sql.BALANCE}, {sql.BUREAU}
  SELECT 'month' AS unit, months::BIGINT AS shift, count(*) AS rows,
    strftime(TIMESTAMP '2000-01-31' + to_months(months::INT), '%Y-%m-%d %H:%M:%S') AS moved FROM balance GROUP BY months
  UNION ALL SELECT 'day', days, count(*), strftime(TIMESTAMP '2000-01-31' + to_days(days::INT), '%Y-%m-%d %H:%M:%S')
  FROM bureau GROUP BY days""")
def shifted_times(spark: SparkSession, folder: str) -> DataFrame:
    anchor = instant("2000-01-31T00:00:00Z")

    def moved(df: DataFrame, unit: str, column: str, shift) -> DataFrame:
        counted = df.groupBy(F.col(column).alias("shift")).agg(F.count(F.lit(1)).alias("rows"))
        return counted.select(
            F.lit(unit).alias("unit"), F.col("shift").cast("bigint").alias("shift"), "rows",
            utc_text(shift(anchor, F.col("shift")), SECONDS).alias("moved"),
        )

    months = moved(credit.raw_balance(spark, folder), "month", "MONTHS_BALANCE", shift_months)
    return months.unionByName(moved(credit.bureau(spark, folder), "day", "DAYS_CREDIT", shift_days))


@query(f"WITH {sql.APPLICATION}, {sql.APP_FEATURES} {_wide_sql('app_f', sql.APP_SQL)}")
def application_features(spark: SparkSession, folder: str) -> DataFrame:
    return _short(app_features(credit.application(spark, folder)), "application_train")


@query(f"WITH {sql.BUREAU}, {sql.BUREAU_FEATURES} {_wide_sql('bureau_f', sql.BUREAU_SQL)}")
def bureau_history_features(spark: SparkSession, folder: str) -> DataFrame:
    return _short(bureau_features(credit.bureau(spark, folder)), "bureau")


@query(f"WITH {sql.BALANCE}, {sql.BALANCE_FEATURES} {_wide_sql('balance_f', sql.BALANCE_SQL)}")
def bureau_balance_features(spark: SparkSession, folder: str) -> DataFrame:
    return _short(balance_features(credit.balance(spark, folder)), "bureau_balance")


@query(f"""WITH {sql.ALL_VALUES}
  SELECT prediction_id, entity_id, feature_id, round(feature_value, 4) AS feature_value FROM vals""")
def feature_values_long(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        values(spark, folder).select("prediction_id", "entity_id", "feature_id", "feature_value"), ["feature_value"], 4
    )


_BUREAU_IDS = [f for f in FEATURE_IDS if f.startswith("bureau.")]


@query(f"""WITH {sql.POINTS}, {sql.BUREAU}, {sql.BUREAU_FEATURES}
  SELECT prediction_id, split, unnest([{', '.join(f"'{f}'" for f in _BUREAU_IDS)}]) AS feature_id,
    unnest([{', '.join(f'round({sql.short(f)}, 4)' for f in _BUREAU_IDS)}]) AS feature_value
  FROM points LEFT JOIN bureau_f ON curr = c_custkey""")
def point_in_time_bureau(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: as-of bureau history per prediction point, split by hash, in long form."""
    points = credit.points(spark, folder)
    wide = assemble(points, bureau_features(credit.bureau(spark, folder)), carry=["split"])
    return rounded(to_long(wide, ["prediction_id", "split"], _BUREAU_IDS), ["feature_value"], 4)


@query(f"""WITH {sql.ALL_VALUES}
  SELECT prediction_id, entity_id, {', '.join(
    f"max(round(feature_value, 4)) FILTER (feature_id = '{f}') AS {sql.short(f)}" for f in FEATURE_IDS)}
  FROM vals GROUP BY prediction_id, entity_id""")
def training_view(spark: SparkSession, folder: str) -> DataFrame:
    wide = to_wide(values(spark, folder))
    return wide.select("prediction_id", "entity_id", *[
        F.round(f"`{f}`", 4).alias(sql.short(f)) for f in FEATURE_IDS
    ])


@query(f"""WITH {sql.APPLICATION}, {sql.BUREAU}, {sql.BALANCE}, {sql.APP_FEATURES}, {sql.BUREAU_FEATURES}, {sql.BALANCE_FEATURES}
  {' UNION ALL '.join(
    f"SELECT '{f}' AS feature_id, count({sql.short(f)}) AS present, round(avg({sql.short(f)}), 4) AS mean FROM {view}"
    for view, names in (('app_f', sql.APP_SQL), ('bureau_f', sql.BUREAU_SQL), ('balance_f', sql.BALANCE_SQL))
    for f in names)}""")
def registry_run(spark: SparkSession, folder: str) -> DataFrame:
    """All specs through the registry, summarised per feature."""
    sources = {
        "application_train": credit.application(spark, folder), "bureau": credit.bureau(spark, folder),
        "bureau_balance": credit.balance(spark, folder),
    }
    parts = []
    for wide in run_specs(sources, FEATURES):
        names = [c for c in wide.columns if "." in c]
        parts.append(to_long(wide, ["SK_ID_CURR"], names).groupBy("feature_id").agg(
            F.count("feature_value").alias("present"), F.round(F.avg("feature_value"), 4).alias("mean")
        ))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {sql.BUREAU} SELECT active, count(*) AS rows, sum(days)::BIGINT AS days, round(sum(amount), 2) AS amount
  FROM bureau WHERE days <= 0 GROUP BY active""")
def as_of_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = as_of(credit.bureau(spark, folder), "DAYS_CREDIT")
    return rows.groupBy(F.col("CREDIT_ACTIVE").alias("active")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("DAYS_CREDIT").alias("days"), F.round(F.sum("AMT_CREDIT_SUM"), 2).alias("amount")
    )


_RULE_NUMBERS = ["lower", "upper", "good_distribution", "bad_distribution", "woe", "iv"]


def rules(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Values (a column per feature), points and the rules fitted on them. All are settled once: the fit and every
    use of the rules read the values, and ordering the points reads its input twice."""
    points = placed_points(settle(credit.points(spark, folder), "points"))
    wide = settle(assemble(
        points, app_features(credit.application(spark, folder)), bureau_features(credit.bureau(spark, folder)),
        balance_features(credit.balance(spark, folder)), carry=["split", "label", "_place"],
    ), "values")
    return wide, points, settle(fit_woe_wide(wide, FEATURE_IDS), "rules")


@query(f"""WITH {sql.FITTED} SELECT feature_id, bin, round(lower, 4) AS lower, round(upper, 4) AS upper, good, bad,
    round(gd, 6) AS good_distribution, round(bd, 6) AS bad_distribution, round(woe, 6) AS woe, round(iv, 6) AS iv,
    n AS training_sample_count, tg AS total_good, tb AS total_bad FROM rules""")
def woe_rules(spark: SparkSession, folder: str) -> DataFrame:
    fitted = rules(spark, folder)[2]
    return rounded(rounded(fitted, _RULE_NUMBERS[2:]), _RULE_NUMBERS[:2], 4)


@query(f"""WITH {sql.FITTED} SELECT feature_id, round(sum(iv), 6) AS total_iv, count(*) AS bins, max(n) AS training_sample_count,
    max(tg) AS total_good, max(tb) AS total_bad FROM rules GROUP BY feature_id""")
def woe_totals(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(woe_summary(rules(spark, folder)[2]), ["total_iv"])


@query(f"""WITH {sql.ALL_VALUES}, n AS (SELECT count(DISTINCT prediction_id) AS n FROM vals WHERE split = 'train'), kept AS (
    SELECT feature_id, prediction_id FROM vals WHERE split = 'train' AND NOT (
      feature_id = '{FEATURE_IDS[0]}' AND substr(prediction_id, 1, 1) = '7')
    UNION ALL SELECT feature_id, prediction_id FROM vals WHERE split = 'train' AND feature_id = '{FEATURE_IDS[1]}' AND substr(prediction_id, 1, 1) = '3')
  SELECT feature_id, count(*)::BIGINT AS binned_rows, any_value(n.n)::BIGINT AS training_rows FROM kept, n
  GROUP BY feature_id HAVING count(*) <> any_value(n.n)""")
def training_closure_breaches(spark: SparkSession, folder: str) -> DataFrame:
    """Rules fitted on values of which one feature lost some training rows and another has some twice."""
    points = settle(credit.points(spark, folder), "points")
    found = settle(values(spark, folder), "values")
    own, first = F.col("feature_id"), F.substring("prediction_id", 1, 1)
    lost = found.where(~((own == FEATURE_IDS[0]) & (first == "7")))
    twice = found.where((own == FEATURE_IDS[1]) & (first == "3"))
    return check_training_closure(settle(fit_woe(lost.unionByName(twice), points), "rules"), points)


@query(f"""WITH {sql.ALL_VALUES} SELECT feature_id, round(avg(feature_value), 4) AS bin_boundary, 2 AS bin_count,
    count(*) AS train_sample_count FROM vals WHERE split = 'train' AND feature_value IS NOT NULL
  GROUP BY feature_id HAVING count(*) >= 2""")
def mean_split_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(fit_mean_split(values(spark, folder), credit.points(spark, folder)), ["bin_boundary"], 4)


@query("""SELECT o_custkey, round(-(coalesce(f / n * log2(nullif(f, 0) / n), 0) + coalesce(o / n * log2(nullif(o, 0) / n), 0)
    + coalesce(p / n * log2(nullif(p, 0) / n), 0)), 6) + 0.0 AS entropy FROM (
    SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
      count(*) FILTER (o_orderstatus = 'P') AS p, count(*)::DOUBLE AS n FROM orders GROUP BY o_custkey)""")
def status_entropy(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    counted = credit.table(spark, folder, "orders").groupBy("o_custkey").agg(*[
        F.count_if(status == s).alias(s) for s in "FOP"
    ])
    return counted.select("o_custkey", (F.round(entropy(["F", "O", "P"]), 6) + 0.0).alias("entropy"))


@query("""SELECT o_orderkey, o_orderstatus, n AS group_rows, least((rn - 1) // greatest(n // 4, 1), 3)::INT AS bin FROM (
    SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n, row_number() OVER (
      PARTITION BY o_orderstatus ORDER BY o_totalprice, sha256(o_orderkey::VARCHAR)) AS rn FROM orders)""")
def equal_count_price_bins(spark: SparkSession, folder: str) -> DataFrame:
    orders = credit.table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("tie")
    )
    return equal_count_bins(orders, ["o_orderstatus"], "o_totalprice", "tie").select(
        "o_orderkey", "o_orderstatus", "group_rows", "bin"
    )


@query(f"""WITH {sql.FITTED}, {sql.APPLIED} SELECT prediction_id, feature_id, bin::INT AS bin, round(woe, 6) AS woe FROM weighed""")
def applied_woe(spark: SparkSession, folder: str) -> DataFrame:
    wide, _, fitted = rules(spark, folder)
    return rounded(apply_woe(to_long(wide, ["prediction_id"]), fitted).where("bin is not null").select("prediction_id", "feature_id", "bin", "woe"), ["woe"])


_FIRST_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("""SELECT l_orderkey, l_shipdate::DATE::VARCHAR AS shipped, l_partkey, l_quantity FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1""")
def latest_line_per_order(spark: SparkSession, folder: str) -> DataFrame:
    lines = credit.table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity", *_FIRST_LINE)
    newest = latest_per_key(lines, ["l_orderkey"], [F.desc("l_shipdate"), *map(F.asc, _FIRST_LINE)])
    return newest.select("l_orderkey", F.col("l_shipdate").cast("date").cast("string").alias("shipped"), "l_partkey", "l_quantity")


@query("""SELECT DISTINCT o_custkey, first_value(o_orderstatus) OVER (
    PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS status FROM orders""")
def first_value_status(spark: SparkSession, folder: str) -> DataFrame:
    orders = credit.table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return first_value_per_key(orders, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], "o_orderstatus", "status")


@query("""SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS ordered FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""")
def newest_order(spark: SparkSession, folder: str) -> DataFrame:
    orders = credit.table(spark, folder, "orders")
    return top_rows(orders, [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(
        "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("ordered")
    )


@query("""SELECT coalesce(o_custkey, c_custkey) AS id, CASE WHEN c_custkey IS NULL THEN 'left' ELSE 'right' END AS side
  FROM (SELECT DISTINCT user_id AS o_custkey FROM events) FULL JOIN (SELECT c_custkey FROM customer) ON o_custkey = c_custkey
  WHERE o_custkey IS NULL OR c_custkey IS NULL""")
def entities_on_one_side(spark: SparkSession, folder: str) -> DataFrame:
    users = credit.table(spark, folder, "events").select(F.col("user_id").alias("id"))
    return set_diff(users, credit.table(spark, folder, "customer").select(F.col("c_custkey").alias("id")), ["id"])


@query("""SELECT p.event_id AS point, v.event_id AS fact, CASE WHEN v.event_id IS NOT NULL THEN v.value END AS fact_value
  FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
    ON p.user_id = v.user_id AND p.ts >= v.ts""")
def newest_view_before_purchase(spark: SparkSession, folder: str) -> DataFrame:
    return _point_in_time(spark, folder, None)


@query("""SELECT p.event_id AS point, CASE WHEN v.ts >= p.ts - INTERVAL 1 DAY THEN v.event_id END AS fact,
    CASE WHEN v.ts >= p.ts - INTERVAL 1 DAY THEN v.value END AS fact_value
  FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
    ON p.user_id = v.user_id AND p.ts >= v.ts""")
def newest_view_within_a_day(spark: SparkSession, folder: str) -> DataFrame:
    return _point_in_time(spark, folder, "1 day")


def _point_in_time(spark: SparkSession, folder: str, tolerance: str | None) -> DataFrame:
    events = credit.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    purchases = events.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("point"), F.col("ts").alias("prediction_time")
    )
    views = events.where("event_type = 'view'").select(
        "user_id", F.col("event_id").alias("fact"), F.col("value").alias("fact_value"), F.col("ts").alias("available_at")
    )
    return pit_join(
        purchases, views, ["user_id"], "prediction_time", "available_at", ["fact", "fact_value"], ["fact"], tolerance,
    ).select("point", "fact", "fact_value")


SOURCE = EventSource("snap-1", "a" * 64, "2000-06-01T00:00:00Z")


def _id_sql(kind: str, time: str, record: str) -> str:
    head = '\'["home_credit","loan_application","SK_ID_CURR:\' || curr || \'","' + kind + '","\' || '
    tail = ' || \'","source_record","\' || ' + record + ' || \'","' + "a" * 64 + '"]\''
    return f"sha256({head}strftime({time}, '%Y-%m-%dT%H:%M:%S.%fZ'){tail})"


_DAY, _MONTH = "TIMESTAMP '2000-01-01' + to_days(days::INT)", "TIMESTAMP '2000-01-01' + to_months(months::INT)"


@query(f"""WITH {sql.BUREAU}, {sql.BALANCE}, all_events AS (
    SELECT curr, 'loan_application' AS event_type, TIMESTAMP '2000-01-01' AS t, r AS record,
      {_id_sql('loan_application', "TIMESTAMP '2000-01-01'", 'r')} AS event_id
    FROM (SELECT c_custkey AS curr, 'application_train:' || c_custkey AS r FROM customer)
    UNION ALL SELECT curr, 'bureau_snapshot', {_DAY}, r, {_id_sql('bureau_snapshot', _DAY, 'r')}
    FROM (SELECT *, 'bureau:' || id AS r FROM bureau WHERE days <= 0)
    UNION ALL SELECT curr, 'bureau_snapshot', {_MONTH}, r, {_id_sql('bureau_snapshot', _MONTH, 'r')}
    FROM (SELECT *, 'bureau_balance:' || id || ':' || months AS r FROM balance WHERE months <= 0))
  SELECT event_id, 'SK_ID_CURR:' || curr AS entity_id, 'customer:' || curr AS customer_id, event_type,
    strftime(t, '%Y-%m-%d %H:%M:%S') AS event_time, record AS source_record_id FROM all_events""")
def source_events(spark: SparkSession, folder: str) -> DataFrame:
    events, _ = to_events(credit.applicants(spark, folder), credit.bureau(spark, folder), credit.balance(spark, folder), SOURCE)
    return events.select(
        "event_id", "entity_id", "customer_id", "event_type", utc_text(F.col("event_time"), SECONDS).alias("event_time"),
        "source_record_id",
    )


@query(f"""WITH {sql.BUREAU}, {sql.BALANCE}
  SELECT 'bureau' AS source_table, 'DAYS_CREDIT' AS field, count(*) AS rows FROM bureau WHERE days > 0
  UNION ALL SELECT 'bureau_balance', 'MONTHS_BALANCE', count(*) FROM balance WHERE months > 0""")
def rejected_source_rows(spark: SparkSession, folder: str) -> DataFrame:
    _, rejects = to_events(credit.applicants(spark, folder), credit.bureau(spark, folder), credit.balance(spark, folder), SOURCE)
    return rejects.select("source_table", F.explode("errors.field").alias("field")).groupBy("source_table", "field").agg(
        F.count(F.lit(1)).alias("rows")
    )


# Two predictions per applicant: at the anchor of the offsets, and one to four years before it.
_TIMES_SQL = """times AS (SELECT c_custkey AS curr, DATE '1999-01-01' AS day FROM customer
    UNION ALL SELECT c_custkey, DATE '1997-12-31' - (c_custkey * 37 % 1000)::INT FROM customer)"""


def _times(spark: SparkSession, folder: str) -> DataFrame:
    key, anchor = F.col("c_custkey").alias("SK_ID_CURR"), F.expr("timestamp'1999-01-01T00:00:00Z'")
    customer = credit.table(spark, folder, "customer")
    early = shift_days(F.expr("timestamp'1997-12-31T00:00:00Z'"), -(F.col("c_custkey") * 37 % 1000))
    return customer.select(key, anchor.alias("prediction_time")).unionByName(customer.select(key, early.alias("prediction_time")))


def _as_of_sql(expressions: dict[str, str], view: str, known: str) -> str:
    columns = ", ".join(f"CASE WHEN count(h.curr) > 0 THEN round(({e})::DOUBLE, 4) END AS {sql.short(f)}" for f, e in expressions.items())
    return f"""SELECT t.curr AS "SK_ID_CURR", strftime(day, '%Y-%m-%d') AS predicted_on, {columns}
  FROM times t LEFT JOIN (SELECT * FROM {view}) h ON h.curr = t.curr AND {known} GROUP BY t.curr, day"""


def _predicted(df: DataFrame, source: str) -> DataFrame:
    day = utc_text(F.col("prediction_time"), "yyyy-MM-dd").alias("predicted_on")
    return df.select("SK_ID_CURR", day, *[F.round(f"`{f.feature_id}`", 4).alias(sql.short(f.feature_id)) for f in FEATURES if f.source == source])


_BUREAU_AS_OF = {
    **sql.BUREAU_SQL, "bureau.days_credit_mean": "avg(days - (day - DATE '1999-01-01'))",
    "bureau.recent_12m_count": "count(*) FILTER (days - (day - DATE '1999-01-01') BETWEEN -365 AND 0)",
}


@query(f"""WITH {sql.BUREAU}, {_TIMES_SQL} {_as_of_sql(_BUREAU_AS_OF, 'bureau', "DATE '1999-01-01' + days::INT <= day")}""")
def bureau_features_at_each_prediction(spark: SparkSession, folder: str) -> DataFrame:
    """Each of an applicant's predictions sees the records known by then, counted from its own time."""
    found = bureau_features_as_of(_times(spark, folder), credit.bureau(spark, folder), F.expr("timestamp'1999-01-01T00:00:00Z'"))
    return _predicted(found, "bureau")


@query(f"""WITH {sql.BALANCE}, {_TIMES_SQL}
  {_as_of_sql(sql.BALANCE_SQL, 'balance', "months <= (year(day) - 1999) * 12 + month(day) - 1")}""")
def balance_features_at_each_prediction(spark: SparkSession, folder: str) -> DataFrame:
    found = balance_features_as_of(_times(spark, folder), credit.balance(spark, folder), F.expr("timestamp'1999-01-01T00:00:00Z'"))
    return _predicted(found, "bureau_balance")


def _in_two_snapshots(spark: SparkSession, rows: DataFrame, source: str, late) -> DataFrame:
    """The features of all rows from the states of an old snapshot and of what came with the next one."""
    old = settle(partial_states(rows.where(~late), source), "old-states")
    delta = settle(partial_states(rows.where(late), source), "delta-states")
    return finish(merge_states(old, delta, source), source)


@query(f"WITH {sql.BUREAU}, {sql.BUREAU_FEATURES} {_wide_sql('bureau_f', sql.BUREAU_SQL)}")
def bureau_features_in_two_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    rows = credit.bureau(spark, folder)
    return _short(_in_two_snapshots(spark, rows, "bureau", F.col("SK_ID_BUREAU") % 5 == 0), "bureau")


@query(f"WITH {sql.BALANCE}, {sql.BALANCE_FEATURES} {_wide_sql('balance_f', sql.BALANCE_SQL)}")
def balance_features_in_two_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    rows = credit.balance(spark, folder)
    return _short(_in_two_snapshots(spark, rows, "bureau_balance", F.col("MONTHS_BALANCE") >= -6), "bureau_balance")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def lines_with_orders_salted(spark: SparkSession, folder: str) -> DataFrame:
    """Lines joined with their orders; an order that holds more than a ten-thousandth of all lines is split."""
    lines = credit.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = credit.table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    return salted_join(lines, orders, ["l_orderkey"], share=1e-4)
