"""From CVU tables to weighted training instances and feature vectors."""

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appconv.functions import empty_to_na, in_window
from appconv.names import DATE, FEATURES


def fill_missing(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Empty category names become ``NA``; one-hot encoding does not take empty names."""
    return df.withColumns({c: empty_to_na(c) for c in columns if c in df.columns})


def temporal_split(df: DataFrame, train: tuple[str, str], test: str) -> tuple[DataFrame, DataFrame]:
    return in_window(df, DATE, *train), df.filter(F.col(DATE) == test)


def expand_instances(df: DataFrame) -> DataFrame:
    """Two instances per row in one pass: label 1 weighted by the downloads, label 0 by the users without one.

    Where downloads exceed users (possible with an app-free user count) the weight is 0; see ``clamped_rows``."""
    negative = F.greatest(F.col("user_count") - F.col("downloads"), F.lit(0)).cast("double")
    instances = F.array(
        F.struct(F.lit(0).alias("label"), negative.alias("weight")),
        F.struct(F.lit(1).alias("label"), F.col("downloads").cast("double").alias("weight")),
    )
    return df.select(*df.columns, F.inline(instances))


def clamped_rows(df: DataFrame) -> DataFrame:
    """Rows whose label-0 weight would be negative."""
    return df.filter(F.col("downloads") > F.col("user_count"))


def index_names(columns: list[str] = FEATURES) -> list[str]:
    return [f"{c}_index" for c in columns]


def vector_names(columns: list[str] = FEATURES) -> list[str]:
    return [f"{c}_vec" for c in columns]


def string_indexer(columns: list[str] = FEATURES, unseen: str = "keep") -> StringIndexer:
    """Index by descending frequency, ties alphabetical."""
    return StringIndexer(inputCols=columns, outputCols=index_names(columns), handleInvalid=unseen)


def feature_pipeline(columns: list[str] = FEATURES, unseen: str = "keep") -> Pipeline:
    """Index, one-hot encode and assemble, in the fixed order of ``columns``. All columns are indexed in one fit."""
    return Pipeline(
        stages=[
            string_indexer(columns, unseen),
            OneHotEncoder(inputCols=index_names(columns), outputCols=vector_names(columns)),
            VectorAssembler(inputCols=vector_names(columns), outputCol="features"),
        ]
    )


def fit_features(train: DataFrame, everything: DataFrame, fit_on: str = "train", columns: list[str] = FEATURES):
    """Fit the category indexes on the training rows, keeping later categories as unknown, or on all rows."""
    if fit_on == "train":
        return feature_pipeline(columns, unseen="keep").fit(train)
    if fit_on == "all":
        return feature_pipeline(columns, unseen="error").fit(everything)
    raise ValueError(f"fit_on must be 'train' or 'all', not {fit_on!r}")


def known_categories(fitted: PipelineModel) -> Column:
    """Of rows with indexes: whether all their categories were there when the indexes were fitted."""
    indexer = fitted.stages[0]
    pairs = zip(indexer.getOutputCols(), indexer.labelsArray, strict=True)
    return reduce(Column.__and__, [F.col(index) < len(labels) for index, labels in pairs])


def vector_width(vector: Column) -> Column:
    parts = F.unwrap_udt(vector)
    return F.coalesce(parts["size"], F.size(parts["values"]))


def vector_ones(vector: Column) -> Column:
    """Places of a vector that are not zero, as an array. A sparse vector's own list of places is read; only what the assembler
    left dense is looked through."""
    parts = F.unwrap_udt(vector)
    places = F.coalesce(parts["indices"], F.sequence(F.lit(0), F.size(parts["values"]) - 1))
    pairs = F.filter(F.arrays_zip(places.alias("place"), parts["values"].alias("value")), lambda p: p["value"] != 0)
    return F.transform(pairs, lambda p: p["place"])
