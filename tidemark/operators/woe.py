"""Weight of evidence and information value: fitted on the training split, applied frozen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import to_long
from tidemark.operators.quality import split_rows
from tidemark.operators.ranks import in_order, running_sums
from tidemark.session import broadcast_if_small, settle

# Fixed values of the fit.
MIN_VALUES = 8
COUNT_SMOOTHING = 0.5
TOTAL_SMOOTHING = 2.0
MISSING_BIN = -1
# Neighbours in the order of ids that are counted together where a bin ends among equal values: 2^13.
BLOCK_BITS = 13


def placed_points(points: DataFrame) -> DataFrame:
    """Points with ``_place``, their place in the order of prediction ids, in which equal values are dealt to bins."""
    return in_order(points, [], [F.col("prediction_id")])


def training_rows(values: DataFrame, points: DataFrame) -> DataFrame:
    """Feature values of the training split with labels and places."""
    labels = placed_points(split_rows(points).select("prediction_id", "label")).select("prediction_id", "label", "_place")
    return values.join(labels, "prediction_id").select("feature_id", "feature_value", "label", "_place")


def fit_woe(values: DataFrame, points: DataFrame, bins: int = 4, consistent_woe: bool = False) -> DataFrame:
    """One row per feature and bin; bin -1 holds the missing values.

    A feature with fewer than eight values, or with one class only, gets no rule. The missing bin
    takes its weight from smoothed counts, the others from distributions; ``consistent_woe`` uses
    distributions for all.
    """
    return _rules(settle(training_rows(values, points), "training"), bins, consistent_woe)


def fit_woe_wide(wide: DataFrame, features: list[str], bins: int = 4, consistent_woe: bool = False) -> DataFrame:
    """The same from a column per feature; ``wide`` has split, label and ``_place`` of its points too, and is read three times."""
    train = split_rows(wide).where("prediction_id is not null")
    return _rules(to_long(train, ["label", "_place"], features), bins, consistent_woe)


def _counts() -> list[Column]:
    return [
        F.count("feature_value").alias("n"),
        F.count_if(F.col("label") == 0).alias("good"), F.count_if(F.col("label") == 1).alias("bad"),
    ]


def _dealt(groups: DataFrame, bins: int) -> DataFrame:
    """Add the bins of the first and of the last of ``n`` rows, of which ``below_n`` come before: all bins hold
    ``max(total_n div bins, 1)`` rows, the last one also the remainder."""
    size = F.greatest(F.floor(F.col("total_n") / bins), F.lit(1))

    def number(before: Column) -> Column:
        return F.least(F.floor(before / size), F.lit(bins - 1)).cast("int")

    return groups.withColumns({"_first": number(F.col("below_n")), "_last": number(F.col("below_n") + F.col("n") - 1)})


def bin_counts(rows: DataFrame, bins: int) -> DataFrame:
    """Feature and bin with bounds and counts of ``rows`` in the order of value and ``_place``; parts of a bin are rows of their own.

    Rows are counted per value, and counts are ordered instead of rows. A bin can end inside a value, at most ``bins - 1``
    of a feature; their rows are counted per block of places, and only the blocks in which a bin ends are ordered.
    """
    feature, value = ["feature_id"], ["feature_id", "feature_value"]
    per_value = rows.groupBy(*value).agg(*_counts())
    ranked = _dealt(running_sums(per_value, feature, [F.asc_nulls_last("feature_value")], ["n"]), bins)
    missing = F.col("feature_value").isNull()
    ranked = ranked.withColumns({
        "_first": F.when(missing, MISSING_BIN).otherwise(F.col("_first")),
        "_last": F.when(missing, MISSING_BIN).otherwise(F.col("_last")),
    })
    ends = F.col("_first") != F.col("_last")
    # A handful of rows per feature: its bins, and the values in which bins end.
    values = settle(
        ranked.groupBy("feature_id", "_first", "_last", F.when(ends, F.col("feature_value")).alias("_cut")).agg(
            F.min("feature_value").alias("lower"), F.max("feature_value").alias("upper"),
            *[F.sum(c).alias(c) for c in ("good", "bad", "n")], F.min("below_n").alias("below_n"), F.max("total_n").alias("total_n"),
        ), "values")
    cuts = values.where(ends).select("feature_id", F.col("_cut").alias("feature_value"), "below_n", "total_n")
    block = F.shiftright("_place", BLOCK_BITS).alias("_block")
    known = rows.select("*", block).where("feature_value is not null")
    earlier = Window.partitionBy(*value).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = known.join(broadcast_if_small(cuts), value).groupBy(*value, "_block", "below_n", "total_n").agg(*_counts())
    blocks = settle(_dealt(per_block.withColumn(  # one row per value and block, not a row per prediction
        "below_n", F.col("below_n") + F.coalesce(F.sum("n").over(earlier), F.lit(0))), bins), "blocks")
    split = blocks.where(ends).select(*value, "_block", "below_n", "total_n")
    inside = Window.partitionBy(*value, "_block").orderBy("_place")
    single = _dealt(known.join(broadcast_if_small(split), [*value, "_block"]).select(
        *value, F.lit(1).cast("bigint").alias("n"), (F.col("label") == 0).cast("bigint").alias("good"),
        (F.col("label") == 1).cast("bigint").alias("bad"), "total_n",
        (F.col("below_n") + F.row_number().over(inside) - 1).alias("below_n"),
    ), bins)
    parts = [
        part.where(~ends).select(
            "feature_id", F.col("_first").alias("bin"), F.col(lower).alias("lower"), F.col(upper).alias("upper"), "good", "bad",
            F.col("n").alias("present"))
        for part, lower, upper in (
            (values, "lower", "upper"), (blocks, "feature_value", "feature_value"), (single, "feature_value", "feature_value"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _rules(rows: DataFrame, bins: int, consistent_woe: bool) -> DataFrame:
    counted = bin_counts(rows, bins).groupBy("feature_id", "bin").agg(
        F.min("lower").alias("lower"), F.max("upper").alias("upper"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "bad", "present")],
    )
    # From here on a handful of rows per feature.
    feature = Window.partitionBy("feature_id")
    totals = counted.withColumns({
        "training_sample_count": F.sum("present").over(feature),
        "total_good": F.sum("good").over(feature), "total_bad": F.sum("bad").over(feature),
    }).where(
        (F.col("training_sample_count") >= MIN_VALUES) & (F.col("total_good") > 0) & (F.col("total_bad") > 0)
    )

    g, b = F.col("good") + COUNT_SMOOTHING, F.col("bad") + COUNT_SMOOTHING
    gd, bd = F.col("good_distribution"), F.col("bad_distribution")
    by_distribution = F.ln(gd / bd)
    woe = by_distribution if consistent_woe else F.when(F.col("bin") == MISSING_BIN, F.ln(g / b)).otherwise(
        by_distribution
    )
    return (
        totals.withColumn("good_distribution", g / (F.col("total_good") + TOTAL_SMOOTHING))
        .withColumn("bad_distribution", b / (F.col("total_bad") + TOTAL_SMOOTHING))
        .withColumn("woe", woe)
        .withColumn("iv", (gd - bd) * F.col("woe"))
        .select(
            "feature_id", "bin", "lower", "upper", "good", "bad", "good_distribution", "bad_distribution",
            "woe", "iv", "training_sample_count", "total_good", "total_bad",
        )
    )


def woe_summary(rules: DataFrame) -> DataFrame:
    """Total information value and bins per feature."""
    return rules.groupBy("feature_id").agg(
        F.sum("iv").alias("total_iv"), F.count(F.lit(1)).alias("bins"),
        F.max("training_sample_count").alias("training_sample_count"),
        F.max("total_good").alias("total_good"), F.max("total_bad").alias("total_bad"),
    )


def check_training_closure(rules: DataFrame, points: DataFrame) -> DataFrame:
    """Features whose bins do not hold every training prediction once.

    The training predictions are counted from ``points`` alone, so rows that were lost or doubled before
    the fit are found too.
    """
    wanted = split_rows(points).where("label in (0, 1)").agg(F.countDistinct("prediction_id"))
    return rules.groupBy("feature_id").agg(F.sum(F.col("good") + F.col("bad")).alias("binned_rows")).withColumn(
        "training_rows", wanted.scalar()
    ).where("binned_rows != training_rows")


def fit_mean_split(values: DataFrame, points: DataFrame) -> DataFrame:
    """Two bins at the mean of the training values; features with fewer than two values are left out."""
    entities = split_rows(points).select("entity_id").distinct()
    return (
        values.where(F.col("feature_value").isNotNull()).join(entities, "entity_id", "left_semi")
        .groupBy("feature_id")
        .agg(F.avg("feature_value").alias("bin_boundary"), F.count(F.lit(1)).alias("train_sample_count"))
        .where("train_sample_count >= 2")
        .select("feature_id", "bin_boundary", F.lit(2).alias("bin_count"), "train_sample_count")
    )


def entropy(columns: list[str]) -> F.Column:
    """Base-2 entropy of non-negative class counts; 0 when all are 0."""
    total = sum((F.col(c) for c in columns), F.lit(0))
    terms = F.lit(0.0)
    for c in columns:
        share = F.try_divide(F.col(c), total)
        terms = terms - F.when(F.col(c) > 0, share * F.log2(share)).otherwise(0.0)
    return terms


def _frozen(rules: DataFrame) -> DataFrame:
    """One row per feature: its bins in order and the weight of its missing bin. A handful of bins, by construction of the rules."""
    bounds = F.array_sort(F.collect_list(F.when(
        F.col("bin") != MISSING_BIN, F.struct("bin", "upper", "woe")
    )))
    return rules.groupBy("feature_id").agg(
        bounds.alias("_bins"), F.max(F.when(F.col("bin") == MISSING_BIN, F.col("woe"))).alias("_missing")
    )


def _hit(value: Column, bins: Column) -> Column:
    """The first bin whose upper bound reaches the value, above all bounds the last bin."""
    return F.when(
        value.isNotNull(),
        F.coalesce(F.try_element_at(F.filter(bins, lambda b: b["upper"] >= value), F.lit(1)), F.element_at(bins, -1)),
    )


def _weight(value: Column, hit: Column, bins: Column, missing: Column) -> Column:
    return F.when(bins.isNotNull(), F.when(value.isNull(), F.coalesce(missing, F.lit(0.0))).otherwise(hit["woe"]))


def apply_woe(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``bin`` and ``woe`` from frozen rules.

    A value belongs to the first bin whose upper bound reaches it, above all bounds to the last bin;
    a missing value to the missing bin, without such a bin its weight is 0. A value of a feature
    without rule keeps NULLs.
    """
    value, bins, hit = F.col("feature_value"), F.col("_bins"), F.col("_hit")
    return (
        values.join(broadcast_if_small(_frozen(rules)), "feature_id", "left")
        .withColumn("_hit", _hit(value, bins))
        .withColumn("bin", F.when(bins.isNotNull(), F.coalesce("_hit.bin", F.lit(MISSING_BIN))))
        .withColumn("woe", _weight(value, hit, bins, F.col("_missing")))
        .drop("_bins", "_missing", "_hit")
    )


def apply_woe_wide(wide: DataFrame, rules: DataFrame, features: list[str]) -> DataFrame:
    """Every column of ``features`` as its weight, NULL for a feature without rule; no row is moved.

    The rules of the columns, a handful of rows per feature, become comparisons with literals.
    """
    named = rules.where(F.col("feature_id").isin(features)).select("feature_id", "bin", "upper", "woe")
    own: dict[str, list] = {}
    for rule in sorted(named.collect(), key=lambda r: r["bin"]):
        own.setdefault(rule["feature_id"], []).append(rule)

    def literal(number: float | None) -> Column:
        return F.lit(number).cast("double")

    def weight(feature: str) -> Column:
        if feature not in own:
            return literal(None).alias(feature)
        value = F.col(f"`{feature}`").cast("double")
        missing = [r["woe"] for r in own[feature] if r["bin"] == MISSING_BIN and r["woe"] is not None]
        bins = [r for r in own[feature] if r["bin"] != MISSING_BIN]
        chosen = F.when(value.isNull(), literal(missing[0] if missing else 0.0))
        for rule in bins:
            chosen = chosen.when(value <= literal(rule["upper"]), literal(rule["woe"]))
        return chosen.otherwise(literal(bins[-1]["woe"] if bins else None)).alias(feature)

    kept = [F.col(f"`{c}`") for c in wide.columns if c not in features]
    return wide.select(*kept, *[weight(f) for f in features])
