"""Views, scores, stability and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import monitor, scorecard
from tidemark.operators.catalog import FEATURE_IDS, feature_catalog
from tidemark.operators.features import to_long
from tidemark.plans import credit_sql as sql
from tidemark.plans import credit_tables as credit
from tidemark.plans.feature_queries import rounded, rules, values
from tidemark.plans.registry import query
from tidemark.session import scratch_folder, settle

_APPLIED = f"WITH {sql.FITTED}, {sql.APPLIED}"
_SCORED = f"""{_APPLIED}, scored AS (
    SELECT prediction_id, any_value(split) AS split, any_value(label) AS label, count(*) AS features,
      round(-sum(woe), 9) + 0.0 AS score FROM weighed GROUP BY prediction_id)"""


@query(f"""WITH {sql.ALL_VALUES}, flagged AS (SELECT *, feature_id = 'app.age_years' AS late, feature_id = 'bureau.record_count' AS leaks,
      feature_id = 'app.document_flag_count' AS orphan FROM vals)
  SELECT mode, feature_id, count(*) AS rows FROM flagged, (VALUES ('full'), ('strict'), ('governed')) AS m(mode)
  WHERE (mode = 'full' OR NOT (late OR leaks)) AND NOT (mode = 'governed' AND orphan) GROUP BY ALL""")
def feature_views(spark: SparkSession, folder: str) -> DataFrame:
    """Full, strict and governed views under a catalog with a late, a leaking and an ownerless feature."""
    found = values(spark, folder).select("prediction_id", "feature_id", "feature_value")
    own = F.col("feature_id")
    catalog = feature_catalog(spark).withColumns({
        "stage": F.when(own == "app.age_years", "post_decision").otherwise(F.col("stage")),
        "leakage_risk": F.when(own == "bureau.record_count", "label_derived").otherwise(F.col("leakage_risk")),
        "owner": F.when(own == "app.document_flag_count", "").otherwise(F.col("owner")),
    })
    parts = [
        monitor.feature_view(found, catalog, mode).groupBy("feature_id").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("mode", F.lit(mode))
        for mode in ("full", "strict", "governed")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""{_APPLIED}, n AS (SELECT feature_id, split, bin, count(*) AS n FROM weighed GROUP BY ALL),
  t AS (SELECT feature_id, split, sum(n) AS total FROM n GROUP BY ALL),
  shares AS (SELECT t.feature_id, t.split, r.bin, (coalesce(n.n, 0) + 0.5) / (total + 2.0) AS share FROM t
    JOIN rules r USING (feature_id) LEFT JOIN n ON n.feature_id = t.feature_id AND n.split = t.split AND n.bin = r.bin)
  SELECT b.feature_id, b.split, round(sum((b.share - a.share) * ln(b.share / a.share)), 6) AS psi
  FROM shares b JOIN shares a ON a.feature_id = b.feature_id AND a.bin = b.bin AND a.split = 'train'
  WHERE b.split <> 'train' GROUP BY ALL""")
def population_stability(spark: SparkSession, folder: str) -> DataFrame:
    wide, points, fitted = rules(spark, folder)
    return rounded(monitor.psi(to_long(wide, ["prediction_id"]), points, fitted), ["psi"])


@query(f"""{_APPLIED} SELECT prediction_id, round(-sum(woe), 6) + 0.0 AS score, count(*) AS features FROM weighed GROUP BY 1""")
def batch_scores(spark: SparkSession, folder: str) -> DataFrame:
    wide, _, fitted = rules(spark, folder)
    return rounded(monitor.batch_score_wide(wide, fitted, FEATURE_IDS), ["score"])


def _ks_sql(scored: str, name: str) -> str:
    return f"""{name} AS (
    SELECT split, max(tg) AS good, max(tb) AS bad, max(abs(cg / tg - cb / tb)) AS ks,
      sum(b * (cg - g + g / 2) / (tg * tb)) AS auc,
      (sum(b) FILTER (tg + tb - cg - cb < (tg + tb) * 0.1) / sum(g + b) FILTER (tg + tb - cg - cb < (tg + tb) * 0.1))
        / (max(tb) / max(tg + tb)) AS lift
    FROM (SELECT *, sum(g) OVER w AS cg, sum(b) OVER w AS cb, sum(g) OVER a AS tg, sum(b) OVER a AS tb FROM (
        SELECT split, score, count(*) FILTER (label = 0)::DOUBLE AS g, count(*) FILTER (label = 1)::DOUBLE AS b
        FROM {scored} GROUP BY split, score)
      WINDOW w AS (PARTITION BY split ORDER BY score), a AS (PARTITION BY split)) GROUP BY split)"""


def _scored(wide: DataFrame, points: DataFrame, fitted: DataFrame) -> DataFrame:
    scores = monitor.batch_score_wide(wide, fitted, FEATURE_IDS).join(points.select("prediction_id", "split", "label"), "prediction_id")
    return scores.withColumn("score", F.round("score", 9) + 0.0)


@query(f"""{_SCORED}, {_ks_sql('scored', 'k')} SELECT split, good::BIGINT AS good, bad::BIGINT AS bad, round(ks, 6) AS ks,
    round(auc, 6) AS auc, round(lift, 6) AS lift FROM k""")
def ranking_power(spark: SparkSession, folder: str) -> DataFrame:
    wide, points, fitted = rules(spark, folder)
    return rounded(monitor.ks_auc_lift(_scored(wide, points, fitted), ["split"]), ["ks", "auc", "lift"])


_APP = list(sql.APP_SQL)
_STRICT = ", ".join(f"'{f}'" for f in _APP)


@query(f"""{_SCORED}, strict_scored AS (
    SELECT prediction_id, any_value(split) AS split, any_value(label) AS label, round(-sum(woe), 9) + 0.0 AS score
    FROM weighed WHERE feature_id IN ({_STRICT}) GROUP BY prediction_id),
  {_ks_sql('scored', 'f')}, {_ks_sql('strict_scored', 's')}
  SELECT split, round(f.ks, 6) AS ks_full, round(s.ks, 6) AS ks_strict, round(f.ks - s.ks, 6) AS ks_inflation FROM f JOIN s USING (split)""")
def ks_inflation_by_split(spark: SparkSession, folder: str) -> DataFrame:
    """What the KS of all features gains over application features alone."""
    wide, points, fitted = rules(spark, folder)
    scores = monitor.batch_scores_by_view(wide, fitted, {"full": FEATURE_IDS, "strict": _APP}).join(points.select("prediction_id", "split", "label"), "prediction_id")
    power = settle(monitor.ks_auc_lift(scores.withColumn("score", F.round("score", 9) + 0.0), ["split", "view"]), "power")
    full, strict = [power.where(F.col("view") == view).drop("view") for view in ("full", "strict")]
    return rounded(monitor.ks_inflation(full, strict, ["split"]), ["ks_full", "ks_strict", "ks_inflation"])


@query()
def scorecard_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every prediction of the snapshot scored by a stored logistic model on weights, which the training split alone fitted."""
    values_wide, points, fitted = rules(spark, folder)
    features = sorted(r.feature_id for r in fitted.select("feature_id").distinct().collect())  # those of the catalog that have rules
    labelled = points.select("prediction_id", "split", "label")
    wide = settle(scorecard.woe_wide(to_long(values_wide, ["prediction_id"]), fitted, features).join(labelled, "prediction_id"), "weights")
    path = scratch_folder(spark, "model")
    scorecard.fit_scorecard(wide.where("split = 'train'"), features).write().save(path)
    scored = scorecard.score_snapshot(wide, path, credit.SNAPSHOT)
    return scored.select("prediction_id", "split", "label", F.round("score", 6).alias("score"), "snapshot_id")


@query("""SELECT l_orderkey, count(*) AS rows, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS share
  FROM lineitem GROUP BY l_orderkey ORDER BY rows DESC, l_orderkey LIMIT 20""")
def heaviest_orders(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(monitor.key_skew(credit.table(spark, folder, "lineitem"), ["l_orderkey"]), ["share"], 9)


_STEP = "CASE WHEN step = 'ts to available_at' THEN value WHEN step = 'available_at to ingested_at' THEN value + 1 ELSE value * 2 + 1 END"


@query(f"""SELECT event_type, step, count(*) AS rows, round(avg(s), 4) AS mean, round(quantile_disc(s, 0.5), 4) AS p50,
    round(quantile_disc(s, 0.95), 4) AS p95, round(quantile_disc(s, 0.99), 4) AS p99 FROM (
    SELECT event_type, step, {_STEP} AS s FROM events,
      (VALUES ('ts to available_at'), ('available_at to ingested_at'), ('ts to ingested_at')) AS t(step)) GROUP BY ALL""")
def latency_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Events that become available after `value` seconds and are ingested as long again and one second."""
    def later(c: str, seconds: Column) -> Column:
        return F.timestamp_micros(F.unix_micros(c) + F.round(seconds * 1_000_000).cast("bigint"))

    events = credit.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    timed = events.withColumn("available_at", later("ts", F.col("value"))).withColumn(
        "ingested_at", later("available_at", F.col("value") + 1)
    )
    report = monitor.latency(timed, ["ts", "available_at", "ingested_at"], ["event_type"])
    return rounded(report, ["mean", "p50", "p95", "p99"], 4)


_PROFILED = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS null_rows,
      round((count(*) - count({c})) / count(*), 6) AS null_rate FROM documents LEFT JOIN labels USING (doc_id)"""
    for c in _PROFILED))
def null_profile(spark: SparkSession, folder: str) -> DataFrame:
    documents = credit.table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    joined = documents.join(credit.table(spark, folder, "labels"), "doc_id", "left")
    return rounded(monitor.quality_profile(joined), ["null_rate"])


@query("""SELECT o_orderkey, 'SK_ID_CURR:' || o_custkey AS entity_id FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderdate > TIMESTAMP '2000-01-01'""")
def known_after_prediction(spark: SparkSession, folder: str) -> DataFrame:
    orders = credit.table(spark, folder, "orders").select(
        "o_orderkey", F.concat(F.lit("SK_ID_CURR:"), F.col("o_custkey").cast("string")).alias("entity_id"),
        F.col("o_orderdate").cast("timestamp").alias("available_at"),
    )
    return monitor.boundary_violations(orders, credit.points(spark, folder)).select("o_orderkey", "entity_id")


@query("""WITH e AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey),
  p AS (SELECT c_custkey, n, CASE n WHEN 1 THEN TIMESTAMP '1995-01-01' ELSE TIMESTAMP '1997-01-01' END AS t FROM customer, (VALUES (1), (2)) AS v(n))
  SELECT o_orderkey, 'any' AS judged FROM e WHERE o_orderdate > TIMESTAMP '1995-01-01'
  UNION ALL SELECT o_orderkey, 'own' FROM e JOIN p ON c_custkey = o_custkey AND n = 1 + o_orderkey % 2 WHERE o_orderdate > t""")
def known_after_a_prediction(spark: SparkSession, folder: str) -> DataFrame:
    """Two predictions per customer: orders judged by either of them, and by the one that they name."""
    customers = credit.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"))
    points = customers.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "entity_id", F.col("n").cast("string").alias("prediction_id"),
        F.when(F.col("n") == 1, F.expr("timestamp'1995-01-01T00:00:00Z'")).otherwise(F.expr("timestamp'1997-01-01T00:00:00Z'")).alias("prediction_time"))
    orders = credit.table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("entity_id"),
        (1 + F.col("o_orderkey") % 2).cast("string").alias("prediction_id"), F.col("o_orderdate").cast("timestamp").alias("available_at"))
    by_any = monitor.boundary_violations(orders, points).select("o_orderkey", F.lit("any").alias("judged"))
    by_own = monitor.boundary_violations(orders, points, ("entity_id", "prediction_id"))
    return by_any.unionByName(by_own.select("o_orderkey", F.lit("own").alias("judged")))


@query("""WITH base AS (SELECT doc_id, lang, source, quality, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
  fields AS (
    SELECT doc_id, 1 AS page, 'language' AS field, lang AS value, 0.9 AS c FROM base
    UNION ALL SELECT doc_id, 2, 'language', CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END, 0.8 FROM base
    UNION ALL SELECT doc_id, 1, 'number', CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'D-' || doc_id END, 0.5 + quality / 4 FROM base
    UNION ALL SELECT doc_id, 1, 'expiry_date', strftime(DATE '2024-01-01' + to_days((n_chars % 900)::INT - 450), '%Y-%m-%d'), 0.7 FROM base
      WHERE doc_id % 3 <> 0),
  per_field AS (
    SELECT doc_id, field, max((trim(value) <> '')::INT) AS found, min(value) = max(value) AS agrees, min(c) AS low, sum(c) AS total, count(c) AS n,
      count(*) FILTER (field = 'number' AND regexp_full_match(value, 'D-[0-9]+')) AS well, count(*) FILTER (field = 'number') AS judged,
      max(CASE WHEN field = 'expiry_date' THEN value::DATE END) AS expiry
    FROM fields GROUP BY doc_id, field)
  SELECT doc_id AS document_id, round(sum(CASE WHEN field IN ('number', 'expiry_date') THEN found ELSE 0 END) / 2, 6) AS field_coverage,
    round(min(low), 6) AS confidence_min, round(sum(total) / sum(n), 6) AS confidence_mean, round(sum(well) / nullif(sum(judged), 0), 6) AS format_validity,
    max(expiry) < DATE '2024-01-01' AS expired, round(avg(agrees::INT), 6) AS page_agreement FROM per_field GROUP BY doc_id""")
def document_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a language on two pages, a number, and for some an expiry date."""
    base = credit.table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars").join(
        credit.table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    key = F.col("doc_id")

    def field(page: int, name: str, value: Column, confidence: Column) -> Column:
        return F.struct(F.lit(page).alias("page"), F.lit(name).alias("field"), value.alias("value"), confidence.alias("confidence"))

    number = F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit("D-"), key.cast("string")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 900).cast("int") - 450)
    expiry = F.when(key % 3 != 0, day.cast("string"))
    pages = F.array(
        field(1, "language", F.col("lang"), F.lit(0.9)),
        field(2, "language", F.when(key % 7 == 0, "xx").otherwise(F.col("lang")), F.lit(0.8)),
        field(1, "number", number, 0.5 + F.col("quality") / 4), field(1, "expiry_date", expiry, F.lit(0.7)),
    )
    fields = base.select(key.alias("document_id"), F.inline(pages)).where("value is not null")
    report = monitor.document_features(fields, ["number", "expiry_date"], {"number": r"^D-[0-9]+\z"}, "2024-01-01")
    return rounded(report, ["field_coverage", "confidence_min", "confidence_mean", "format_validity", "page_agreement"])
