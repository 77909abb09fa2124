"""Steps that once grew with rows of (cohort, user, app): distinct inputs are not made distinct again, users meet as bags, words
are or-ed in blocks."""

import pytest
from pyspark.sql import functions as F

from appconv.catalogue.queries import CATALOGUE, Inputs
from appconv.names import BIN, COHORT
from appconv.operators import encode, events, lift, skew

FOLDER = "/root/testdata/sf0.001"
MEMBER = "country_id string, device_os_id string, device_type_id string, request_uid string, app_id string"


@pytest.mark.parametrize("name", ["app_users", "target_users"])
def test_members_are_counted_as_they_leave_the_join(spark, name):
    """One aggregate above the join: the counts. Members and apps are distinct before they meet."""
    plan = CATALOGUE[name](Inputs(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert above.count("Aggregate") == 1


def _cohort(rows):
    return rows.select(*[F.lit("1").alias(c) for c in COHORT], "*")


def test_bags_are_split_into_slices(spark):
    rows = spark.createDataFrame([("bot", list(range(60)), list(range(50))), ("u", [1, 2, 3], [4]), ("v", [], [4])], "u string, o array<int>, t array<int>")
    parts = skew.split_bags(rows, "o", "t", 100).collect()
    assert all(len(r.o) * len(r.t) <= 100 for r in parts)
    assert sorted(k for r in parts if r.u == "bot" for k in r.o) == list(range(60))
    assert [r.o for r in parts if r.u == "u"] == [[1, 2, 3]]


def test_pairs_are_counted_by_cohort_ranges(spark):
    """Numbers are paired in tasks of few cohorts; users without a name and repeats count for nothing."""
    own = [("1", "1", "1", u, a) for u in ("u1", "u2", None) for a in ("a", "b", None)]
    tgt = [("1", "1", "1", u, "b") for u in ("u1", "u2", "u3", None)]
    own, tgt = spark.createDataFrame(own + own, MEMBER), spark.createDataFrame(tgt + tgt, MEMBER)
    pairs = lift.co_users(own, tgt, min_users=1)
    assert "rangepartitioning(country_id" in pairs._jdf.queryExecution().executedPlan().toString()
    assert [(r.app_a0, r.app_a1, r.A1A0users) for r in pairs.collect()] == [("b", "a", 2)]
    assert {r.RONusers for r in lift.pair_counts(own, tgt, 1).collect()} == {2}


def test_words_are_ored_in_blocks(spark):
    """130 targets fill 19 words, which are three blocks of an app and not 19 rows; the vectors are those of the definition."""
    apps, targets = [f"a{k}" for k in range(6)], [f"t{k:03}" for k in range(130)]
    table = {(t, a): (i * 7 + j) % 9 for i, t in enumerate(targets) for j, a in enumerate(apps) if (i + j) % 4}
    slots = _cohort(spark.createDataFrame([(t, a, s) for (t, a), s in table.items()], f"app_a0 string, app_a1 string, {BIN} int"))
    owned = [("u", "a0"), ("u", "a3"), ("v", "a5"), ("w", "none")]
    members = _cohort(spark.createDataFrame(owned, "request_uid string, app_id string"))
    popular = spark.createDataFrame([(t,) for t in targets], "app_id string")
    packed = encode.pack_feed(slots, popular)
    assert {len(r.blocks) for r in packed.collect()} == {3}
    want = {}
    for u, a in owned:
        for t in targets:
            if (t, a) in table:
                want[u, t] = want.get((u, t), 0) | 1 << table[t, a]
    for options in ({}, {"broadcast_bytes": 0}):
        got = encode.target_hits(members, popular, slots, **options).collect()
        assert {(r.request_uid, r.app_a0): r["mask"] for r in got} == want and len(got) == len(want)


def test_feed_of_staged_members_is_not_made_distinct_again(spark):
    """Repeats stay in the union, as owned apps drop them; staged members are joined as they are."""
    log = spark.createDataFrame([("u", "s", "2018-05-01")] * 3, "request_uid string, app_gpm_id string, request_date string")
    assert events.union_events(log, log, repeats=True).count() == 6 and events.union_events(log, log).count() == 1
    inputs = Inputs(spark, FOLDER)
    members = encode.members_by_user(inputs.staged_owned, events.cohort_members(inputs.staged_requests))
    assert "Aggregate [app_id" not in members._jdf.queryExecution().optimizedPlan().toString()
    assert members.exceptAll(events.cohort_apps(inputs.owned(), inputs.window_requests())).count() == 0
