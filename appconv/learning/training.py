"""Weighted logistic regression on one-hot features."""

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appconv.learning.features import expand_instances, known_categories
from appconv.names import FEATURES

# Fixed value: iteration limit of the optimiser.
MAX_ITER = 2000

# The optimiser stops when its steps change the likelihood by less than this share. Below that its line search ends, with
# probabilities within 1e-6 of the maximum of the likelihood.
TOLERANCE = 1e-12


def training_cells(rows: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Instances with equal categories and label merged, weights summed. The weighted likelihood is the same sum with
    fewer terms, so every pass of the optimiser reads one row per cell instead of one per cell and day."""
    return expand_instances(rows).groupBy(*columns, "label").agg(F.sum("weight").alias("weight"))


def fit_logistic(
    train: DataFrame, features: PipelineModel, max_iter: int = MAX_ITER, columns: list[str] = FEATURES
) -> LogisticRegressionModel:
    """No regularisation, with intercept."""
    cells = features.transform(training_cells(train, columns)).select("features", "label", "weight")
    return LogisticRegression(weightCol="weight", maxIter=max_iter, tol=TOLERANCE).fit(cells)


def score(rows: DataFrame, features: PipelineModel, model: LogisticRegressionModel, known_only: bool = False) -> DataFrame:
    """Add P(label = 1) as ``logistic_prediction``.

    A category that the indexes keep as unknown has no weight, and what the model says about it depends on how the optimiser
    shared the intercept; with ``known_only`` such rows get NULL."""
    scored = model.transform(features.transform(rows))
    prediction = vector_to_array("probability")[1]
    if known_only:
        prediction = F.when(known_categories(features), prediction)
    return scored.select(*rows.columns, prediction.alias("logistic_prediction"))
