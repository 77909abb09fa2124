import pytest
from pyspark.sql import functions as F

from appconv.names import COHORT, REQUEST_COLUMNS
from appconv.operators import bags, encode
from appconv.operators.skew import hot_keys, lookup


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [1, 7, 50, 10_000])
def test_lookup_equals_join(spark, how, hot_rows):
    """A third of the rows belong to one key, some keys are unknown, some NULL."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    rows = spark.range(600).select(key.alias("k"), F.lit("x").alias("c"), F.col("id").alias("v"))
    table = spark.createDataFrame([("hot", "x", 1)] + [(f"k{i}", "x", i) for i in range(30)], "k string, c string, w int")
    want = sorted((tuple(r) for r in rows.join(table, ["k", "c"], how).collect()), key=str)
    assert sorted((tuple(r) for r in lookup(rows, table, ["k", "c"], how, hot_rows).collect()), key=str) == want


def test_hot_keys_are_split_evenly(spark):
    rows = spark.range(1000).select(F.lit("hot").alias("k"), "id")
    assert [tuple(r) for r in hot_keys(rows, ["k"], 100).collect()] == [("hot", 10)]
    assert hot_keys(rows, ["k"], 1000).count() == 0


def test_operators_are_whole_for_a_hot_user(spark):
    rows = [(f"2018-05-{d:02d}", "u0" if n % 2 else f"u{n}", f"p{n}", "v", "m", "3", "94", "1") for d in range(1, 9) for n in range(20)]
    requests = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in REQUEST_COLUMNS))
    owned = spark.createDataFrame([("u0", "a"), ("u0", "b"), ("u2", "a")], "request_uid string, app_id string")
    owners = sum(r[1] in ("u0", "u2") for r in rows)
    bag_df = bags.app_bags(owned)
    for hot_rows in (3, 10_000):
        got = bags.requests_with_bags(requests, bag_df, hot_rows=hot_rows)
        assert got.count() == 160 and got.filter("appsbag is not null").count() == owners
    hits = spark.createDataFrame(
        [("94", "3", "1", "u0", [(0, 5)])], "country_id string, device_os_id string, device_type_id string, request_uid string, hits array<struct<word:int,bits:bigint>>"
    )
    targets = spark.createDataFrame([(f"t{i}",) for i in range(10)], "app_id string")
    for hot_rows in (3, 10_000):
        words = encode.with_target_words(requests, targets, hits, hot_rows)
        assert words.count() == 160 * 2
        assert words.filter("bits = 5").count() == sum(r[1] == "u0" for r in rows)
    assert set(COHORT) <= set(hits.columns)
