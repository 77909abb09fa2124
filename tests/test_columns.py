import math

from pyspark.sql import functions as F

from appconv.functions import clip_slot, cohort_filter, day_list, known_ids, log_bin, mask_to_array, mask_to_text, shift_day


def _column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_log_bin_edges(spark):
    below_one = math.nextafter(1.0, 0.0)
    values = [0.0, None, float("nan"), -1.0, 2.0**-3, 0.2499, 0.25, 1.0, below_one, 31.99, 32.0, 64.0]
    assert _column(spark, values, log_bin) == [None, None, None, None, -3, -3, -2, 0, -1, 4, 5, 6]


def test_log_bin_is_exact_at_every_power_of_two(spark):
    powers = list(range(-60, 61))
    assert _column(spark, [2.0**k for k in powers], log_bin) == powers
    assert _column(spark, [math.nextafter(2.0**k, 0.0) for k in powers], log_bin) == [k - 1 for k in powers]


def test_slots(spark):
    assert _column(spark, [-999, -4, -3, -2, 0, 4, 5, 6, None], clip_slot, "long") == [0, 0, 0, 1, 3, 7, 8, 8, None]


def test_mask_renderings(spark):
    assert _column(spark, [0, 0b100000101], mask_to_text, "int") == [
        "Array(0, 0, 0, 0, 0, 0, 0, 0, 0)",
        "Array(1, 0, 1, 0, 0, 0, 0, 0, 1)",
    ]
    assert _column(spark, [0b10], mask_to_array, "int") == [[0, 1, 0, 0, 0, 0, 0, 0, 0]]


def test_known_ids_drops_both_spellings(spark):
    df = spark.createDataFrame([("a", "x"), ("NULL", "x"), ("b", None), (None, "x"), ("c", "NULL")], "k string, v string")
    assert [tuple(r) for r in known_ids(df, "k", "v").collect()] == [("a", "x")]


def test_cohort_filter(spark):
    rows = [(c, o, t) for c in ("94", "1") for o in ("3", "4", "5") for t in ("1", "2", "3")]
    df = spark.createDataFrame(rows, "country_id string, device_os_id string, device_type_id string")
    kept = {tuple(r) for r in cohort_filter(df, ["94"], ["3", "5"], ["1", "3"]).collect()}
    assert kept == {("94", o, t) for o in ("3", "5") for t in ("1", "3")}


def test_days():
    assert shift_day("2018-03-01", -1) == "2018-02-28"
    assert day_list("2018-06-01", 3) == ["2018-06-01", "2018-05-31", "2018-05-30"]
    assert day_list("2018-05-01", 2, "%Y/%m/%d") == ["2018/05/01", "2018/04/30"]
