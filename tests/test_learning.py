import math

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from appconv.learning.evaluate import binning_cells, compare_models, weighted_rmse
from appconv.learning.features import (
    clamped_rows,
    expand_instances,
    feature_pipeline,
    fill_missing,
    temporal_split,
    vector_ones,
    vector_width,
)
from appconv.learning.training import fit_logistic, training_cells
from appconv.names import FEATURES
from appconv.plans.jobs import train_and_compare

SCHEMA = (
    "request_date string, display_marketing_name string, os_version_id string, market_id string, app_id string, "
    "appOwnCVUEnc string, user_count long, downloads long"
)
TRAIN, TEST = ("2018-05-01", "2018-05-07"), "2018-05-08"


def _rows():
    out = []
    for day in range(1, 9):
        for i in range(30):
            users = 5 + (i * 7 + day) % 11
            out.append(
                (
                    f"2018-05-0{day}",
                    ["p", "q", ""][i % 3],
                    f"v{i % 2}",
                    f"m{i % 5}",
                    "new" if day == 8 and i == 0 else f"a{i % 4}",
                    "Array(1)" if i % 2 else "Array(0)",
                    users,
                    (i * 5 + day * 3) % (users // 2 + 1),
                )
            )
    return out


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    return df.withColumn("CVU", F.col("downloads") / F.col("user_count")).cache()


@pytest.fixture(scope="module", params=["train", "all"])
def trained(request, rows):
    return train_and_compare(rows, TRAIN, TEST, fit_on=request.param)


def test_fill_missing(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "market_id string")
    assert [r[0] for r in fill_missing(df).collect()] == ["NA", None, "x"]


def test_split(rows):
    train, test = temporal_split(rows, TRAIN, TEST)
    assert train.count() == 210 and test.count() == 30


def test_instances(spark, rows):
    instances = expand_instances(rows)
    assert dict(instances.dtypes)["label"] == "int" and dict(instances.dtypes)["weight"] == "double"
    assert instances.count() == 480
    assert instances.agg(F.sum("weight")).first()[0] == rows.agg(F.sum("user_count")).first()[0]
    over = rows.limit(1).withColumn("downloads", F.col("user_count") + 2)
    weights = {r["label"]: r["weight"] for r in expand_instances(over).collect()}
    assert weights[0] == 0.0 and clamped_rows(over).count() == 1 and clamped_rows(rows).count() == 0


def test_calibration(trained, rows):
    """The expected downloads of every category equal the observed ones."""
    for feature in FEATURES:
        sums = trained.train_scores.groupBy(feature).agg(
            F.sum(F.col("logistic_prediction") * F.col("user_count")).alias("expected"),
            F.sum("downloads").alias("seen"),
        )
        for r in sums.collect():
            assert r["expected"] == pytest.approx(r["seen"], abs=0.05)


def test_unseen_category_is_scored(trained):
    new = trained.test_scores.filter("app_id = 'new'").collect()
    assert len(new) == 1 and 0 < new[0]["logistic_prediction"] < 1
    assert trained.test_scores.count() == 30


def test_comparison(trained, rows):
    train, test = temporal_split(fill_missing(rows), TRAIN, TEST)
    cells = binning_cells(train, test)
    result = {r["model"]: r for r in trained.comparison.collect()}
    alone = weighted_rmse(cells, "CVU", "bining_prediction", "user_count").first()
    assert result["binning"]["rmse"] == pytest.approx(alone["rmse"])
    assert result["binning"]["cells"] == result["logistic"]["cells"] == cells.count()


def test_merged_cells_give_the_same_model(rows):
    train = temporal_split(fill_missing(rows), TRAIN, TEST)[0]
    features = feature_pipeline().fit(train)
    from pyspark.ml.classification import LogisticRegression

    plain = features.transform(expand_instances(train))
    apart = LogisticRegression(weightCol="weight", maxIter=2000).fit(plain)
    merged = fit_logistic(train, features)
    assert training_cells(train).count() < plain.count()
    scored = [
        {tuple(r[c] for c in FEATURES): r["probability"][1] for r in m.transform(features.transform(train)).collect()}
        for m in (apart, merged)
    ]
    assert max(abs(scored[0][k] - scored[1][k]) for k in scored[0]) < 1e-3


def test_rmse(spark):
    df = spark.createDataFrame([(0.3, 0.1, 2), (0.1, 0.5, 4)], "y double, p double, w long")
    row = weighted_rmse(df, "y", "p", "w").first()
    assert row["rmse"] == pytest.approx(math.sqrt(0.12)) and row["weight"] == 6
    other = RegressionEvaluator(labelCol="y", predictionCol="p", weightCol="w").evaluate(df.withColumn("w", F.col("w") * 1.0))
    assert row["rmse"] == pytest.approx(other)
    assert weighted_rmse(df.limit(0), "y", "p", "w").first()["rmse"] is None


def test_compare_models_on_known_numbers(spark):
    keys = ("d", "o", "m", "a", "v")
    cells = spark.createDataFrame([(*keys, 0.5, 10, 0.3)], ", ".join(f"{c} string" for c in FEATURES) + ", bining_prediction double, user_count long, CVU double")
    scores = spark.createDataFrame([(*keys, 0.4)] * 2, ", ".join(f"{c} string" for c in FEATURES) + ", logistic_prediction double")
    got = {r["model"]: r["rmse"] for r in compare_models(cells, scores).collect()}
    assert got == {"binning": pytest.approx(0.2), "logistic": pytest.approx(0.1)}


def newton(cells, steps=50):
    """Probabilities of the cells (categories, downloads, users) by iteratively reweighted least squares on dense dummies."""
    labels = [sorted({c[0][k] for c in cells}) for k in range(len(cells[0][0]))]
    x = np.array([[1.0, *(float(c[0][k] == v) for k, own in enumerate(labels) for v in own)] for c in cells])
    y, w = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.lstsq((x.T * (w * p * (1 - p))) @ x, x.T @ (y - w * p), rcond=1e-10)[0]
    return 1 / (1 + np.exp(-x @ beta))


def test_scores_equal_those_of_newton_steps(trained, rows):
    """All five categories, another solver on the merged cells."""
    train = temporal_split(fill_missing(rows), TRAIN, TEST)[0]
    cells = train.groupBy(*FEATURES).agg(F.sum("downloads").alias("d"), F.sum(F.greatest("user_count", "downloads")).alias("w")).collect()
    cells = [(tuple(r[c] for c in FEATURES), r["d"], r["w"]) for r in cells]
    want = dict(zip((c[0] for c in cells), newton(cells), strict=True))
    got = {tuple(r[c] for c in FEATURES): r["logistic_prediction"] for r in trained.train_scores.collect()}
    assert max(abs(got[k] - want[k]) for k in want) < 1e-5


def test_unknown_categories_get_no_score_on_request(rows):
    scores = train_and_compare(rows, TRAIN, TEST, known_only=True).test_scores.collect()
    assert {r["app_id"]: r["logistic_prediction"] is None for r in scores} == {"new": True, **{f"a{k}": False for k in range(4)}}


def test_places_of_vectors(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import StructField, StructType

    vectors = [Vectors.sparse(6, [1, 4], [1.0, 1.0]), Vectors.dense([0, 2, 0, 1]), Vectors.sparse(3, [], []), Vectors.sparse(5, [0, 2], [0.0, 1.0])]
    df = spark.createDataFrame([(v,) for v in vectors], StructType([StructField("v", VectorUDT())]))
    got = df.select(vector_width(F.col("v")).alias("n"), vector_ones(F.col("v")).alias("ones")).collect()
    assert [(r.n, r.ones) for r in got] == [(6, [1, 4]), (4, [1, 3]), (3, []), (5, [2])]
