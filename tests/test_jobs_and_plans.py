import pytest
from pyspark.sql import functions as F

from appconv.catalogue import windows as W
from appconv.catalogue.queries import CATALOGUE, Inputs
from appconv.plans.jobs import build_cvu, build_feed
from appconv.sources.order_tables import CUSTOM, DOWNLOAD, PURCHASE, OrderTables

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("app_free, compact", [(False, False), (True, False), (False, True), (True, True)])
def test_jobs_give_what_the_queries_give(spark, tmp_path, app_free, compact):
    t = OrderTables(spark, FOLDER)
    feed = build_feed(
        *[t.event_lines((k,)) for k in (DOWNLOAD, CUSTOM, PURCHASE)],
        t.app_map(),
        t.requests(),
        ("0000-01-01", W.OWNED_END),
        (W.TARGET_START, W.TARGET_END),
        str(tmp_path / "feed"),
        W.MIN_USERS,
        compact=compact,
    )
    cvu = build_cvu(
        t.requests(), t.event_lines((DOWNLOAD,)), t.app_map(), feed, (W.TRAIN_START, W.TEST_DAY),
        str(tmp_path / "cvu"), W.MIN_ROWS, app_free,
    )
    inputs = Inputs(spark, FOLDER)
    name = "cvu_encoded_appfree" if app_free else "cvu_encoded"
    want = CATALOGUE[name](inputs)
    assert cvu.exceptAll(want).count() == 0 and want.exceptAll(cvu).count() == 0
    pairs = inputs.staged_feed.count()
    assert (feed.feed.full() if compact else feed.feed).count() == pairs
    assert feed.counts is None if compact else feed.counts["pairs"] == pairs


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, FOLDER)


# Queries that fit a model call Spark ML, whose transformers use its own functions.
ML = {"string_index", "feature_slots", "lr_scores", "lr_calibration", "lr_train_rmse", "compare_models"}


@pytest.mark.parametrize("name", sorted(set(CATALOGUE) - ML))
def test_no_cross_join_and_no_python(inputs, name):
    plan = _plan(CATALOGUE[name](inputs))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "ExistingRDD"):
        assert word not in plan


def test_window_and_kind_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # shows the pushed filters in full
    plan = _plan(OrderTables(spark, FOLDER).event_lines((DOWNLOAD,), W.TARGET_START, W.TARGET_END))
    assert "GreaterThanOrEqual(o_orderdate,1999-01-01" in plan and "LessThan(o_orderdate,2000-01-01" in plan
    assert "EqualTo(l_returnflag,N)" in plan
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


def test_pairs_are_spread_over_all_partitions(spark):
    """One cohort holding everything still occupies every task of the pair step."""
    from appconv.operators import lift

    own = spark.range(40).select(
        F.lit("94").alias("country_id"), F.lit("3").alias("device_os_id"), F.lit("1").alias("device_type_id"),
        F.lit("u").alias("request_uid"), F.col("id").cast("string").alias("app_id"),
    )
    pairs = lift.eligible_pairs(own, own, 1)
    busy = pairs.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in busy) == 40 * 39 and len(busy) >= 4
