"""The credit view of the order tables in SQL, for the statements that check the queries."""

from __future__ import annotations

from tidemark.operators.catalog import FEATURE_IDS
from tidemark.plans.credit_tables import FLAG_TYPES
from tidemark.settings import DOCUMENT_FLAGS

POINTS_SNAPSHOT = """sha256('["snapshot-a","hc-pp-v1","hc-boundary-v1"]')"""


def bucket(entity: str) -> str:
    document = f"""'["home_credit","' || {entity} || '",20260723]'"""
    return f"(('0x' || substr(sha256({document}), 1, 8))::UBIGINT % 10000)::BIGINT"


def split(entity: str) -> str:
    b = bucket(entity)
    return f"CASE WHEN {b} < 8000 THEN 'train' WHEN {b} < 9000 THEN 'validation' ELSE 'oot' END"


POINTS = f"""points AS (
  SELECT sha256('["home_credit","' || entity_id || '","' || {POINTS_SNAPSHOT} || '","hc-boundary-v1"]') AS prediction_id,
    c_custkey, entity_id, {split('entity_id')} AS split, (c_acctbal < 0)::INT::DOUBLE AS label
  FROM (SELECT *, 'SK_ID_CURR:' || c_custkey AS entity_id FROM customer))"""

BUREAU = """bureau AS (
  SELECT o_custkey AS curr, o_orderkey AS id, datediff('day', DATE '1999-01-01', o_orderdate::DATE) AS days,
    CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed' ELSE 'Sold' END AS active,
    o_totalprice AS amount, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice * 0.5 END AS debt,
    CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 0.1 ELSE 0.0 END AS overdue
  FROM orders)"""

BALANCE = """balance AS (
  SELECT l_orderkey AS id, o_custkey AS curr,
    (year(l_shipdate) - 1999) * 12 + month(l_shipdate) - 1 AS months,
    CASE WHEN l_returnflag = 'N' THEN 'C' WHEN l_linestatus = 'O' THEN 'X'
      ELSE (l_linenumber % 6)::VARCHAR END AS status
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey)"""

_SEEN = ", ".join(f"max((event_type = '{t}')::INT) AS has_{t}" for t in FLAG_TYPES)
_FLAGS = " + ".join(f"has_{FLAG_TYPES[i % 5]}" for i in range(len(DOCUMENT_FLAGS)))

APPLICATION = f"""application AS (
  SELECT c_custkey AS curr, c_acctbal AS income, o_totalprice AS credit, l_extendedprice AS annuity,
    l_extendedprice * (1 - l_discount) AS goods, -(7000 + c_custkey * 37 % 18000) AS birth,
    nullif(l_discount, 0) AS s1, nullif(l_tax, 0) AS s2, l_quantity / 50 AS s3, {_FLAGS} AS flags
  FROM customer
  LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (
    PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON o_custkey = c_custkey
  LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1) ON l_orderkey = o_orderkey
  LEFT JOIN (SELECT user_id, {_SEEN} FROM events GROUP BY user_id) ON user_id = c_custkey)"""

_DELINQUENT = "status IN ('1', '2', '3', '4', '5')"

# Expression of each feature over the grouped or plain view, by feature.
APP_SQL = {
    "app.credit_income_ratio": "credit / nullif(income, 0)",
    "app.annuity_income_ratio": "annuity / nullif(income, 0)",
    "app.credit_annuity_ratio": "credit / nullif(annuity, 0)",
    "app.goods_credit_ratio": "goods / nullif(credit, 0)",
    "app.age_years": "round(birth / -365.25::DOUBLE, 6)",
    "app.ext_source_mean": "(coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0)) / "
                           "nullif((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT, 0)",
    "app.ext_source_missing_count": "(s1 IS NULL)::INT + (s2 IS NULL)::INT + (s3 IS NULL)::INT",
    "app.document_flag_count": "flags",
}
BUREAU_SQL = {
    "bureau.record_count": "count(*)",
    "bureau.active_count": "count(*) FILTER (active = 'Active')",
    "bureau.closed_count": "count(*) FILTER (active = 'Closed')",
    "bureau.credit_sum_total": "sum(amount)",
    "bureau.debt_sum_total": "sum(debt)",
    "bureau.overdue_sum_total": "sum(overdue)",
    "bureau.days_credit_mean": "avg(days)",
    "bureau.recent_12m_count": "count(*) FILTER (days BETWEEN -365 AND 0)",
}
BALANCE_SQL = {
    "bureau_balance.month_count": "count(*)",
    "bureau_balance.delinquent_month_count": f"count(*) FILTER ({_DELINQUENT})",
    "bureau_balance.max_delinquency_level": "max(CASE WHEN status IN ('0', 'C', 'X') THEN 0 "
                                            f"WHEN {_DELINQUENT} THEN status::INT END)",
    # Lines of one order and month may differ in status; a delinquent one wins.
    "bureau_balance.latest_status_delinquent": f"arg_max(({_DELINQUENT})::INT, (months * 1000000000000 - id) * 2 + ({_DELINQUENT})::INT)",
}


def short(feature: str) -> str:
    return feature.split(".")[1]


def _columns(expressions: dict[str, str]) -> str:
    return ", ".join(f"({e})::DOUBLE AS {short(f)}" for f, e in expressions.items())


APP_FEATURES = f"app_f AS (SELECT curr, {_columns(APP_SQL)} FROM application)"
BUREAU_FEATURES = f"bureau_f AS (SELECT curr, {_columns(BUREAU_SQL)} FROM bureau WHERE days <= 0 GROUP BY curr)"
BALANCE_FEATURES = f"balance_f AS (SELECT curr, {_columns(BALANCE_SQL)} FROM balance WHERE months <= 0 GROUP BY curr)"

_NAMES = ", ".join(f"'{f}'" for f in FEATURE_IDS)
_VALUES = ", ".join(short(f) for f in FEATURE_IDS)

VALUES = f"""vals AS (
  SELECT prediction_id, entity_id, split, label, unnest([{_NAMES}]) AS feature_id, unnest([{_VALUES}]) AS feature_value
  FROM points LEFT JOIN app_f a ON a.curr = c_custkey LEFT JOIN bureau_f b ON b.curr = c_custkey
  LEFT JOIN balance_f m ON m.curr = c_custkey)"""

ALL_VALUES = ", ".join([
    POINTS, BUREAU, BALANCE, APPLICATION, APP_FEATURES, BUREAU_FEATURES, BALANCE_FEATURES, VALUES
])

RULES = """fitted AS (
    SELECT v.*, count(feature_value) OVER f AS n, count(*) FILTER (label = 0) OVER f AS tg,
      count(*) FILTER (label = 1) OVER f AS tb,
      row_number() OVER (PARTITION BY feature_id ORDER BY feature_value NULLS LAST, prediction_id) AS rn
    FROM vals v WHERE split = 'train' WINDOW f AS (PARTITION BY feature_id)),
  binned AS (
    SELECT *, CASE WHEN feature_value IS NULL THEN -1
      ELSE least((rn - 1) // greatest(n // 4, 1), 3) END::INT AS bin
    FROM fitted WHERE n >= 8 AND tg > 0 AND tb > 0),
  counted AS (
    SELECT feature_id, bin, min(feature_value) AS lower, max(feature_value) AS upper,
      count(*) FILTER (label = 0) AS good, count(*) FILTER (label = 1) AS bad,
      any_value(n) AS n, any_value(tg) AS tg, any_value(tb) AS tb
    FROM binned GROUP BY feature_id, bin),
  rules AS (
    SELECT *, (gd - bd) * woe AS iv FROM (
      SELECT *, CASE WHEN bin = -1 THEN ln((good + 0.5) / (bad + 0.5)) ELSE ln(gd / bd) END AS woe FROM (
        SELECT *, (good + 0.5) / (tg + 2.0) AS gd, (bad + 0.5) / (tb + 2.0) AS bd FROM counted)))"""

FITTED = f"{ALL_VALUES}, {RULES}"

# The first bin whose upper bound reaches the value, else the last one.
APPLIED = """applied AS (
    SELECT v.prediction_id, v.entity_id, v.split, v.label, v.feature_id, v.feature_value,
      CASE WHEN feature_value IS NULL THEN -1 ELSE coalesce(
        (SELECT min(bin) FROM rules r WHERE r.feature_id = v.feature_id AND bin >= 0 AND upper >= v.feature_value),
        (SELECT max(bin) FROM rules r WHERE r.feature_id = v.feature_id)) END AS bin
    FROM vals v WHERE v.feature_id IN (SELECT feature_id FROM rules)),
  weighed AS (
    SELECT a.*, coalesce(r.woe, 0) AS woe FROM applied a LEFT JOIN rules r USING (feature_id, bin))"""
