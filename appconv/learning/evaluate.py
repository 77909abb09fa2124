"""User-weighted errors and the binning baseline."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appconv.names import BINNING, FEATURES


def binning_rates(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Downloads, users and their ratio per feature cell, over all days of ``df``."""
    return (
        df.groupBy(*columns)
        .agg(F.sum("downloads").alias("downloads"), F.sum("user_count").alias("user_count"))
        .withColumn("CVU", F.try_divide(F.col("downloads").cast("double"), F.col("user_count").cast("double")))
    )


def binning_cells(train: DataFrame, test: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Test cells that were seen in training: the training ratio is the prediction for the test ratio."""
    predicted = binning_rates(train, columns).select(*columns, F.col("CVU").alias(BINNING))
    return predicted.join(binning_rates(test, columns).select(*columns, "user_count", "CVU"), columns)


def _error(actual: str, predicted: str, weight: str) -> Column:
    return F.col(weight) * (F.col(actual) - F.col(predicted)) * (F.col(actual) - F.col(predicted))


def weighted_rmse(df: DataFrame, actual: str, predicted: str, weight: str) -> DataFrame:
    """One row: weighted squared error, total weight and the root of their ratio."""
    return (
        df.agg(F.sum(_error(actual, predicted, weight)).alias("weighted_error"), F.sum(weight).alias("weight"))
        .withColumn("rmse", F.sqrt(F.try_divide(F.col("weighted_error"), F.col("weight").cast("double"))))
    )


def common_cells(cells: DataFrame, scores: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Test cells with both predictions."""
    return cells.join(scores.select(*columns, "logistic_prediction").distinct(), columns)


def compare_models(cells: DataFrame, scores: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Weighted RMSE of both models over the same test cells, one row per model, from one pass."""
    both = common_cells(cells, scores, columns).select(
        "user_count",
        "CVU",
        F.inline(
            F.array(
                F.struct(F.lit("logistic").alias("model"), F.col("logistic_prediction").alias("predicted")),
                F.struct(F.lit("binning").alias("model"), F.col(BINNING).alias("predicted")),
            )
        ),
    )
    return (
        both.groupBy("model")
        .agg(
            F.count("*").alias("cells"),
            F.sum(_error("CVU", "predicted", "user_count")).alias("weighted_error"),
            F.sum("user_count").alias("weight"),
        )
        .withColumn("rmse", F.sqrt(F.try_divide(F.col("weighted_error"), F.col("weight").cast("double"))))
    )
