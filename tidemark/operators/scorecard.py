"""A frozen model on weights of evidence: fitted on training predictions, stored, loaded and applied to a snapshot."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.woe import apply_woe


def woe_columns(features: list[str]) -> list[str]:
    """Column names without dots, in the order of the features."""
    return [f"woe_{f.replace('.', '_')}" for f in features]


def woe_wide(values: DataFrame, rules: DataFrame, features: list[str]) -> DataFrame:
    """One row per prediction with the weight of each feature; 0 where a feature has no rule or no value."""
    weighed = apply_woe(values.where(F.col("feature_id").isin(features)), rules)
    wide = weighed.groupBy("prediction_id").agg(*[
        F.coalesce(F.max(F.when(F.col("feature_id") == f, F.col("woe"))), F.lit(0.0)).alias(c) for f, c in zip(features, woe_columns(features))
    ])
    return wide


def fit_scorecard(train: DataFrame, features: list[str], label: str = "label", regularised: float = 0.01) -> PipelineModel:
    """Logistic regression on the weights of labelled predictions; ``train`` holds training predictions only."""
    stages = [
        VectorAssembler(inputCols=woe_columns(features), outputCol="_weights"),
        LogisticRegression(featuresCol="_weights", labelCol=label, regParam=regularised, maxIter=100, tol=1e-9),
    ]
    return Pipeline(stages=stages).fit(train.where(F.col(label).isNotNull()))


def score_snapshot(wide: DataFrame, path: str, snapshot: str) -> DataFrame:
    """Scores of a snapshot by the model stored at ``path``: the probability of the bad outcome and where it comes from."""
    scored = PipelineModel.load(path).transform(wide)
    own = [c for c in wide.columns if not c.startswith("woe_")]
    return scored.select(*own, vector_to_array("probability")[1].alias("score"), F.lit(snapshot).alias("snapshot_id"), "rawPrediction")


def evaluator_auc(scored: DataFrame, label: str = "label") -> float:
    """The area under the curve by Spark's evaluator, without bins."""
    return BinaryClassificationEvaluator(labelCol=label, numBins=0).evaluate(scored.where(F.col(label).isNotNull()))
