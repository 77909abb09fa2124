"""Bucketed and daily staging, counts of staged tables, windows that slide."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from appconv.names import APP, DATE, REQUEST_COLUMNS, UID
from appconv.operators import events, sliding
from appconv.sources.staging import preview, read_days, redo_days, stage_bucketed, stage_counted, stage_days

NO_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get(NO_BROADCAST)
    spark.conf.set(NO_BROADCAST, "-1")
    yield spark
    spark.conf.set(NO_BROADCAST, before)


def requests(spark, n, seed=1):
    draw = random.Random(seed)
    rows = {(f"2018-05-0{draw.randint(1, 4)}", "u0" if k % 3 == 0 else f"u{draw.randrange(40)}", "d", f"v{k % 7}", "m", "3", "94", "1") for k in range(n)}
    return spark.createDataFrame(sorted(rows), ", ".join(f"{c} string" for c in REQUEST_COLUMNS))


def test_buckets_meet_without_a_shuffle(no_broadcast, tmp_path):
    spark = no_broadcast
    draw = random.Random(2)
    owned = spark.createDataFrame([(f"u{draw.randrange(50)}", f"a{draw.randrange(20)}") for _ in range(400)], f"{UID} string, {APP} string").distinct()
    members = events.cohort_members(requests(spark, 300))
    want = rows_of(events.cohort_apps(owned, members))
    left = stage_bucketed(owned, f"{tmp_path}/owned", UID, 4)
    right = stage_bucketed(members, f"{tmp_path}/members", UID, 4)
    joined = events.cohort_apps(left, right, distinct=True)
    assert rows_of(joined) == want
    bags = left.groupBy(UID).agg(F.sort_array(F.collect_list(APP)).alias("bag"))
    for df in (joined, right.join(bags, UID, "left")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    files = [f for f in Path(f"{tmp_path}/owned").glob("part-*")]
    assert len(files) <= 4


def test_one_day_is_redone_alone(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = requests(spark, 400)
    late = "2018-05-02"
    staged = stage_days(rows.filter((F.col(DATE) != late) | (F.col(UID) == "u0")), path)
    assert staged.columns == rows.columns and staged.count() < rows.count()
    before = {f.name for f in Path(path).rglob("part-*.parquet") if late not in str(f)}
    redone = redo_days(rows, path, [late])
    assert rows_of(redone) == rows_of(rows)
    assert before == {f.name for f in Path(path).rglob("part-*.parquet") if late not in str(f)}
    plan = redone.filter(F.col(DATE) == late)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(request_date" in plan


def test_a_day_may_become_empty_or_new(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = requests(spark, 200)
    stage_days(rows.filter(F.col(DATE) != "2018-05-04"), path)
    new = rows.filter(F.col(DATE) != "2018-05-01")
    got = redo_days(new, path, ["2018-05-01", "2018-05-04"])
    assert rows_of(got) == rows_of(new)
    assert rows_of(read_days(spark, path, rows)) == rows_of(new)


def test_a_full_day_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(20000).select(F.lit("2018-05-01").alias(DATE), F.col("id").cast("string").alias(UID))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # of small partitions, as these are
    spark.conf.set(merging, "false")
    stage_days(rows, str(tmp_path / "days"))
    spark.conf.set(merging, "true")
    assert len(list(Path(tmp_path).rglob("part-*.parquet"))) > 1


def test_windows_that_slide(spark):
    draw = random.Random(5)
    days = [f"2018-04-{d:02d}" for d in range(1, 21)]
    seen = [(f"u{draw.randrange(15)}", f"s{draw.randrange(12)}", draw.choice(days)) for _ in range(500)]
    seen += [("hot", "s1", d) for d in days for _ in range(20)]
    lines = spark.createDataFrame(seen, f"{UID} string, app_gpm_id string, {DATE} string")
    app_map = spark.createDataFrame([(f"s{k}", f"a{k // 2}") for k in range(11)], f"app_gpm_id string, {APP} string")
    state = None
    for end in range(7, 20):
        start = days[end - 7]
        new = lines.filter(F.col(DATE) == days[end]) if state else lines.filter(F.col(DATE).between(start, days[end]))
        day = sliding.day_state(new, app_map)
        state = sliding.advance(state, day, start) if state else day
        state = spark.createDataFrame(state.collect(), state.schema)
        window = lines.filter(F.col(DATE).between(start, days[end]))
        assert rows_of(sliding.owned_since(state, start)) == rows_of(events.owned_apps(window, app_map))
        assert state.count() == sliding.owned_since(state, start).count()


def test_states_merge_in_any_order(spark):
    rows = [("u", "a", "2018-01-03", "2018-01-05"), ("u", "a", "2018-01-01", "2018-01-02"), ("v", "a", "2018-01-09", "2018-01-09")]
    parts = [spark.createDataFrame([r], f"{UID} string, {APP} string, first_day string, last_day string") for r in rows]
    one = sliding.merge(sliding.merge(parts[0], parts[1]), parts[2])
    other = sliding.merge(parts[2], sliding.merge(parts[1], parts[0]))
    assert rows_of(one) == rows_of(other) == [("u", "a", "2018-01-01", "2018-01-05"), ("v", "a", "2018-01-09", "2018-01-09")]


def test_counts_of_a_staged_table(spark, tmp_path):
    counts = {"rows": F.count("*"), "even": F.count_if(F.col("id") % 2 == 0)}
    staged, seen = stage_counted(spark.range(1001), f"{tmp_path}/t", counts)
    assert seen == {"rows": 1001, "even": 501} and staged.count() == 1001
    _, none = stage_counted(spark.range(0), f"{tmp_path}/none", counts)
    assert none == {"rows": 0, "even": 0}


def test_ordered_preview(spark):
    df = spark.range(500).repartition(7)
    top = preview(df, 3, [F.col("id").desc()])
    assert [r.id for r in top.collect()] == [499, 498, 497]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
