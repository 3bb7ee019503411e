"""Views, stability and quality reports over points, features, rules and documents."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.checks import blank
from tidemark.operators.features import to_wide
from tidemark.operators.ranks import running_sums
from tidemark.operators.woe import COUNT_SMOOTHING, TOTAL_SMOOTHING, apply_woe, apply_woe_wide
from tidemark.session import broadcast_if_small

# Stages and risks a view leaves out, fixed values.
LATE_STAGES = ["decision", "post_decision", "post_outcome", "label_derived"]
LEAKING_RISKS = ["post_outcome", "label_derived", "unknown"]


def feature_view(
    values: DataFrame, catalog: DataFrame, mode: str = "strict", features: list[str] | None = None
) -> DataFrame:
    """Long values a view may use, or wide ones when ``features`` names the columns.

    full: all catalog features. strict: without features known only after the decision or with a
    leaking risk. governed: strict and publishable.
    """
    allowed = catalog
    if mode != "full":
        allowed = allowed.where(~F.col("stage").isin(LATE_STAGES) & ~F.col("leakage_risk").isin(LEAKING_RISKS))
    if mode == "governed":
        allowed = allowed.where(~blank(F.col("owner")) & ~blank(F.col("lineage_expression"))
                                & ~blank(F.col("semantic_group_id")))
    kept = values.join(broadcast_if_small(allowed.select("feature_id").distinct()), "feature_id", "left_semi")
    return to_wide(kept, features) if features else kept


def psi(values: DataFrame, points: DataFrame, rules: DataFrame, base: str = "train") -> DataFrame:
    """Population stability of every feature between the base split and each other split.

    Bins are those of the frozen rules. Counts are smoothed like the rules, so an empty bin is finite.
    """
    splits = points.select("prediction_id", "split")
    counted = (
        apply_woe(values, rules).where("bin is not null").join(splits, "prediction_id")
        .groupBy("feature_id", "split", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    # From here on one row per feature, split and bin. Bins come from the rules, so that a bin no
    # row of a split falls into still counts.
    totals = counted.groupBy("feature_id", "split").agg(F.sum("n").alias("total"))
    bins = rules.select("feature_id", "bin")
    grid = totals.join(bins, "feature_id").join(counted, ["feature_id", "split", "bin"], "left")
    share = (F.coalesce("n", F.lit(0)) + COUNT_SMOOTHING) / (F.col("total") + TOTAL_SMOOTHING)
    shares = grid.select("feature_id", "split", "bin", share.alias("share"))
    a = shares.where(F.col("split") == base).select("feature_id", "bin", F.col("share").alias("a"))
    b = shares.where(F.col("split") != base).withColumnRenamed("share", "b")
    return b.join(a, ["feature_id", "bin"]).groupBy("feature_id", "split").agg(
        F.sum((F.col("b") - F.col("a")) * F.ln(F.col("b") / F.col("a"))).alias("psi")
    )


def batch_score(values: DataFrame, rules: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Score of a prediction: minus the sum of its weights, so that a higher score is a higher risk."""
    used = values.where(F.col("feature_id").isin(features)) if features else values
    return (
        apply_woe(used, rules).where("woe is not null").groupBy("prediction_id")
        .agg((-F.sum("woe")).alias("score"), F.count(F.lit(1)).alias("features"))
    )


def batch_score_wide(wide: DataFrame, rules: DataFrame, features: list[str]) -> DataFrame:
    """The same from a column per feature: weights are summed inside a row, so one row per prediction is shuffled, not its values."""
    weights = [F.col(f"`{f}`") for f in features]
    rows = apply_woe_wide(wide.select("prediction_id", *weights), rules, features).select(
        "prediction_id", reduce(add, [F.coalesce(w, F.lit(0.0)) for w in weights]).alias("woe"),
        reduce(add, [w.isNotNull().cast("bigint") for w in weights]).alias("n"),
    )
    # Filtered after the sums: a filter on the rows would make every weight twice.
    sums = rows.groupBy("prediction_id").agg((-F.sum("woe")).alias("score"), F.sum("n").alias("features"))
    return sums.where("features > 0")


def batch_scores_by_view(wide: DataFrame, rules: DataFrame, views: dict[str, list[str]]) -> DataFrame:
    """prediction_id, view and score: several sets of features scored in one pass over the weights."""
    features = list(dict.fromkeys(f for own in views.values() for f in own))
    weighed = apply_woe_wide(wide.select("prediction_id", *[F.col(f"`{f}`") for f in features]), rules, features)

    def total(own: list[str]) -> Column:
        known = reduce(or_, [F.col(f"`{f}`").isNotNull() for f in own])
        return F.when(known, reduce(add, [F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) for f in own]))

    rows = weighed.select("prediction_id", *[total(own).alias(f"_{i}") for i, own in enumerate(views.values())])
    sums = rows.groupBy("prediction_id").agg(*[(-F.sum(f"_{i}")).alias(f"_{i}") for i in range(len(views))])
    scores = F.array(*[F.struct(F.lit(view).alias("view"), F.col(f"_{i}").alias("score")) for i, view in enumerate(views)])
    return sums.select("prediction_id", F.inline(scores)).where("score IS NOT NULL")


def ks_auc_lift(scores: DataFrame, keys: list[str] | None = None, top: float = 0.1) -> DataFrame:
    """KS, AUC and lift of ``score`` against a 0/1 ``label``, per ``keys``. Exact, ties counted half.

    Rows are first counted per distinct score; running sums then go over scores, spread over tasks.
    Lift looks at the scores that have fewer than ``top`` of the rows above them.
    """
    keys = keys or []
    group = keys or ["_all"]
    rows = scores if keys else scores.withColumn("_all", F.lit(0))
    counted = rows.where("score is not null and label is not null").groupBy(*group, "score").agg(
        F.count_if(F.col("label") == 0).alias("good"), F.count_if(F.col("label") == 1).alias("bad")
    )
    sums = running_sums(counted, group, [F.col("score")], ["good", "bad"])
    good, bad = F.col("total_good").cast("double"), F.col("total_bad").cast("double")
    cumulative_good = F.col("below_good") + F.col("good")
    cumulative_bad = F.col("below_bad") + F.col("bad")
    n = F.col("total_good") + F.col("total_bad")
    above = n - cumulative_good - cumulative_bad
    in_top = above < n * top
    result = sums.groupBy(*group).agg(
        F.max("total_good").alias("good"), F.max("total_bad").alias("bad"),
        F.max(F.abs(F.try_divide(cumulative_good, good) - F.try_divide(cumulative_bad, bad))).alias("ks"),
        F.sum(F.try_divide(F.col("bad") * (F.col("below_good") + F.col("good") / 2), good * bad)).alias("auc"),
        F.try_divide(
            F.try_divide(F.sum(F.when(in_top, F.col("bad"))), F.sum(F.when(in_top, F.col("good") + F.col("bad")))),
            F.try_divide(F.max("total_bad"), F.max(n)),
        ).alias("lift"),
    )
    return result if keys else result.drop("_all")


def ks_inflation(full: DataFrame, strict: DataFrame, keys: list[str]) -> DataFrame:
    """How much KS a view gains from features the strict view leaves out."""
    return full.select(*keys, F.col("ks").alias("ks_full")).join(
        strict.select(*keys, F.col("ks").alias("ks_strict")), keys
    ).withColumn("ks_inflation", F.col("ks_full") - F.col("ks_strict"))


def key_skew(df: DataFrame, keys: list[str], top: int = 20) -> DataFrame:
    """The heaviest keys with their share of all rows; look at it before a join."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    total = counted.agg(F.sum("rows")).scalar()
    return counted.withColumn("share", F.col("rows") / total).orderBy(F.desc("rows"), *keys).limit(top)


def quality_profile(df: DataFrame) -> DataFrame:
    """Null count and rate of every column, in one pass."""
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *nulls)
    return counted.unpivot(["_rows"], [f"`{c}`" for c in df.columns], "column", "null_rows").select(
        "column", F.col("_rows").alias("rows"), "null_rows",
        F.try_divide(F.col("null_rows").cast("double"), F.col("_rows")).alias("null_rate"),
    )


def boundary_violations(
    events: DataFrame, points: DataFrame, keys: tuple[str, ...] = ("entity_id",), unknown: bool = True
) -> DataFrame:
    """Events that became known after a prediction they would feed.

    With entity and prediction as ``keys`` an event is judged by the prediction it names, otherwise by
    the earliest of its entity. Points are reduced to one row per key before they meet the events. Events
    without a point are violations unless ``unknown`` lets them pass.
    """
    times = points.groupBy(*keys).agg(F.min("prediction_time").alias("prediction_time"))
    late = F.coalesce(F.col("available_at") > F.col("prediction_time"), F.lit(not unknown))
    return events.join(times, list(keys), "inner" if unknown else "left").where(late)


def latency(df: DataFrame, stages: list[str], keys: list[str]) -> DataFrame:
    """Seconds between neighbouring time columns and end to end: count, mean, p50, p95, p99.

    A percentile is the smallest value that so large a share of the rows does not exceed, exact at any
    size: rows are counted per distinct value, and running sums go over the values, spread over tasks.
    """
    pairs = list(zip(stages, stages[1:])) + ([(stages[0], stages[-1])] if len(stages) > 2 else [])

    def seconds(a: str, b: str) -> Column:
        return (F.unix_micros(b) - F.unix_micros(a)) / 1_000_000.0

    steps = F.array(*[
        F.struct(F.lit(f"{a} to {b}").alias("step"), seconds(a, b).alias("seconds")) for a, b in pairs
    ])
    counted = df.select(*keys, F.inline(steps)).where("seconds is not null").groupBy(*keys, "step", "seconds").agg(
        F.count(F.lit(1)).alias("n")
    )
    sums = running_sums(counted, [*keys, "step"], [F.col("seconds")], ["n"])
    reached = (F.col("below_n") + F.col("n")).cast("double")

    def cut(share: float) -> Column:
        return F.min(F.when(reached >= F.ceil(F.lit(share) * F.col("total_n")), F.col("seconds")))

    return sums.groupBy(*keys, "step").agg(
        F.sum("n").alias("rows"), (F.sum(F.col("seconds") * F.col("n")) / F.sum("n")).alias("mean"),
        cut(0.5).alias("p50"), cut(0.95).alias("p95"), cut(0.99).alias("p99"),
    )


DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}\z"


def document_features(
    fields: DataFrame, required: list[str], patterns: dict[str, str], as_of_date: str
) -> DataFrame:
    """Scalar features of parsed documents.

    ``fields`` has one row per extracted field: document_id, page, field, value, confidence. Per
    document: share of required fields found, lowest and mean confidence, share of well-formed
    values among fields with a pattern, whether its ``expiry_date`` has passed, and the share of
    fields that read the same on every page.
    """
    value = F.col("value")
    shaped = F.lit(None).cast("boolean")
    for field, pattern in patterns.items():
        shaped = F.when(F.col("field") == field, value.rlike(pattern)).otherwise(shaped)
    expiry = F.when((F.col("field") == "expiry_date") & value.rlike(DATE_PATTERN), F.try_to_date(value))
    per_field = fields.groupBy("document_id", "field").agg(
        F.max(F.when(~blank(value), 1).otherwise(0)).alias("found"),
        # Distinct readings are told apart by their extremes; NULL is no reading.
        (F.min("value") == F.max("value")).alias("agrees"),
        F.min("confidence").alias("low"), F.sum("confidence").alias("total"), F.count("confidence").alias("n"),
        F.count_if(shaped).alias("well_formed"), F.count(shaped).alias("judged"), F.max(expiry).alias("expiry"),
    )
    return per_field.groupBy("document_id").agg(
        (F.sum(F.when(F.col("field").isin(required), F.col("found")).otherwise(0)) / float(len(required)))
        .alias("field_coverage"),
        F.min("low").alias("confidence_min"),
        F.try_divide(F.sum("total"), F.sum("n")).alias("confidence_mean"),
        F.try_divide(F.sum("well_formed").cast("double"), F.sum("judged")).alias("format_validity"),
        (F.max("expiry") < F.lit(as_of_date).cast(T.DateType())).alias("expired"),
        F.avg(F.col("agrees").cast("double")).alias("page_agreement"),
    )
