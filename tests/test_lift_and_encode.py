import random

import pytest
from pyspark.sql import functions as F

from appconv.names import APP, BIN, COHORT, REQUEST_COLUMNS, SEGMENT, UID, VECTOR
from appconv.operators import bags, encode, events, lift, rates
from tests import brute

MEMBER = "country_id string, device_os_id string, device_type_id string, request_uid string, app_id string"


def _members(spark, rows):
    return spark.createDataFrame([(*c, u, a) for c, u, a in rows], MEMBER)


def _random_members(seed, users, apps, rows, hot):
    """One user holds every app, one app sits with every user, one cohort takes most of the rows."""
    rnd = random.Random(seed)
    cohorts = [("94", "3", "1")] * 4 + [("94", "5", "1"), ("94", "5", "3")]
    out = {(rnd.choice(cohorts), f"u{rnd.randrange(users)}", f"a{rnd.randrange(apps)}") for _ in range(rows)}
    out |= {(cohorts[0], "u0", f"a{a}") for a in range(apps)}
    out |= {(cohorts[0], f"u{u}", hot) for u in range(users)}
    return out


@pytest.fixture(scope="module")
def data(spark):
    own = _random_members(1, 60, 12, 500, "a1")
    tgt = _random_members(2, 60, 12, 120, "a2")
    return own, tgt, _members(spark, own), _members(spark, tgt)


@pytest.fixture(scope="module")
def slots(spark, data):
    return lift.feed_slots(lift.lift_feed(data[2], data[3], 3)).cache()


@pytest.mark.parametrize("distinct", [False, True])
def test_feed_matches_definition(data, distinct):
    own, tgt, own_df, tgt_df = data
    if not distinct:
        own_df, tgt_df = own_df.union(own_df), tgt_df.union(tgt_df).repartition(3)
    rows = lift.lift_feed(own_df, tgt_df, 3, missing=None, distinct=distinct).collect()
    got = {(tuple(r[c] for c in COHORT), r["app_a0"], r["app_a1"]): (r["A1A0users"], r["A1users"], r["nCVU"]) for r in rows}
    want = {k: v[:3] for k, v in brute.feed(own, tgt, 3).items()}
    assert got.keys() == want.keys() and len(rows) == len(got)
    for key, (co, users, value) in want.items():
        assert got[key][:2] == (co, users)
        assert got[key][2] == (None if value is None else pytest.approx(value, rel=1e-14))


def test_weighted_mean_lift(data):
    """Over the partners of a target, user-weighted lift averages to one."""
    feed = lift.lift_feed(data[2], data[3], 3, missing=None).filter("A1A0usersAggTarget > 0")
    sums = feed.groupBy(*COHORT, "app_a0").agg(
        F.sum(F.col("A1users") * F.col("nCVU")).alias("weighted"), F.first("A1usersAggTarget").alias("total")
    )
    for row in sums.collect():
        assert row["weighted"] == pytest.approx(row["total"], rel=1e-12)


C = ("94", "3", "1")


def test_targets_without_shared_users(spark):
    own = _members(spark, [(C, "u1", "x"), (C, "u2", "y"), (C, "u3", "z")])
    tgt = _members(spark, [(C, "u9", "t"), (C, "u1", "s")])
    rows = {(r["app_a0"], r["app_a1"]): r for r in lift.lift_feed(own, tgt, 1).collect()}
    assert (rows["t", "x"]["nCVU"], rows["t", "x"][BIN]) == (-999.0, -999)
    assert (rows["s", "y"]["nCVU"], rows["s", "y"][BIN]) == (0.0, -999)
    assert (rows["s", "x"]["nCVU"], rows["s", "x"][BIN]) == (3.0, 1)
    legacy = {(r["app_a0"], r["app_a1"]): r[BIN] for r in lift.lift_feed(own, tgt, 1, legacy_nan=True).collect()}
    assert legacy["t", "x"] == 0 and legacy["s", "y"] == -999
    slot = {(r["app_a0"], r["app_a1"]): r[BIN] for r in lift.feed_slots(lift.lift_feed(own, tgt, 1, legacy_nan=True)).collect()}
    assert slot["t", "x"] == 3 and slot["s", "y"] == 0


def test_rows_without_cohort_or_app_make_no_pair(spark):
    own = spark.createDataFrame([(*C, "u1", "x"), (None, "3", "1", "u1", "q"), (*C, "u1", None)], MEMBER)
    tgt = _members(spark, [(C, "u1", "x"), (C, "u1", "t")])
    assert [(r["app_a0"], r["app_a1"]) for r in lift.lift_feed(own, tgt, 1).collect()] == [("t", "x")]


def test_stats_count_pairs_without_building_them(data):
    stats = {tuple(r[c] for c in COHORT): r["pairs"] for r in lift.lift_stats(data[2], data[3], 3).collect()}
    pairs = lift.eligible_pairs(data[2], data[3], 3).groupBy(*COHORT).count().collect()
    assert {k: v for k, v in stats.items() if v} == {tuple(r[c] for c in COHORT): r["count"] for r in pairs}


def _requests(spark, data, seed=3):
    rnd = random.Random(seed)
    rows = set()
    for n in range(200):
        cohort = rnd.choice([("94", "3", "1"), ("94", "5", "1"), ("94", "5", "3"), (None, "5", "3")])
        uid = "u0" if n % 3 == 0 else f"u{rnd.randrange(70)}"
        rows.add((f"2018-05-0{rnd.randrange(1, 4)}", uid, rnd.choice(["p", ""]), f"v{rnd.randrange(20)}", "m", cohort[1], cohort[0], cohort[2]))
    return rows, spark.createDataFrame(sorted(rows, key=str), ", ".join(f"{c} string" for c in REQUEST_COLUMNS))


def _owned(data):
    owned = {(u, a) for _, u, a in data[0] if u != "u5"}
    by_user = {}
    for uid, app in owned:
        by_user.setdefault(uid, set()).add(app)
    return owned, by_user


@pytest.mark.parametrize("names", [["a0", "a2", "a3"], [f"a{i}" for i in range(12)] + ["unknown"], []])
def test_encode_all_targets(spark, data, slots, names):
    feed = brute.feed(data[0], data[1], 3)
    rows, requests = _requests(spark, data)
    owned, by_user = _owned(data)
    bag_df = bags.app_bags(spark.createDataFrame(sorted(owned), "request_uid string, app_id string"))
    targets = spark.createDataFrame([(n,) for n in names], "app_id string")
    got = encode.encode_all_targets(bags.requests_with_bags(requests, bag_df), targets, slots)
    want = {
        (*r, a, brute.vector(feed, (r[6], r[5], r[7]), a, by_user.get(r[1]))) for r in rows for a in names
    }
    got = [tuple(r[c] for c in [*REQUEST_COLUMNS, APP, VECTOR]) for r in got.collect()]
    assert len(got) == len(want) and set(got) == want


def test_encode_own_target(spark, data, slots):
    feed = brute.feed(data[0], data[1], 3)
    _, by_user = _owned(data)
    rows = [(*C, "u0", "a3", sorted(by_user["u0"])), (*C, "u5", "a3", None), (*C, "u6", "unknown", ["a1"]), (*C, "u7", "a2", [])]
    got = encode.encode_own_target(spark.createDataFrame(rows, MEMBER + ", appsbag array<string>"), slots)
    assert {(r[UID], r[APP]): r[VECTOR] for r in got.collect()} == {
        (r[3], r[4]): brute.vector(feed, C, r[4], r[5]) for r in rows
    }


def test_broadcast_and_shuffle_agree(spark, data, slots):
    targets = spark.createDataFrame([(f"a{i}",) for i in range(12)], "app_id string")
    small = {tuple(r) for r in encode.target_hits(data[2], targets, slots).collect()}
    large = {tuple(r) for r in encode.target_hits(data[2], targets, slots, broadcast_bytes=-1).collect()}
    assert small == large and small


def _cvu(spark, data, slots, table, **options):
    _, requests = _requests(spark, data)
    owned, _ = _owned(data)
    owned = spark.createDataFrame(sorted(owned), "request_uid string, app_id string")
    downloads = [(r[1], f"a{i % 12}", r[0]) for i, r in enumerate(sorted(_requests(spark, data)[0], key=str)) if i % 2]
    downloads = spark.createDataFrame(downloads, "request_uid string, app_id string, request_date string")
    targets = encode.popular_targets(downloads, 5)
    return table(requests, owned, downloads, targets, slots, **options), requests, downloads, targets


def test_sparse_equals_dense(spark, data, slots):
    dense, requests, _, targets = _cvu(spark, data, slots, rates.cvu_encoded)
    sparse = _cvu(spark, data, slots, rates.cvu_encoded, sparse=True)[0]
    rows = sorted((tuple(r) for r in dense.collect()), key=str)
    assert rows == sorted((tuple(r) for r in sparse.collect()), key=str)
    total = dense.agg(F.sum("user_count")).first()[0]
    assert total == requests.count() * targets.count()
    assert dense.filter("downloads > user_count or CVU > 1").count() == 0


def test_null_dimensions(spark, data, slots):
    """A NULL dimension keeps its users; its downloads count only with null_safe."""
    plain = _cvu(spark, data, slots, rates.cvu_encoded)[0].filter("country_id is null")
    safe = _cvu(spark, data, slots, rates.cvu_encoded, null_safe=True)[0].filter("country_id is null")
    assert plain.agg(F.sum("user_count")).first()[0] == safe.agg(F.sum("user_count")).first()[0] > 0
    assert plain.agg(F.sum("downloads")).first()[0] == 0 < safe.agg(F.sum("downloads")).first()[0]


def test_appfree_against_encoded_rows(spark, data, slots):
    table, requests, downloads, targets = _cvu(spark, data, slots, rates.cvu_encoded_appfree)
    owned, by_user = _owned(data)
    feed = brute.feed(data[0], data[1], 3)
    names = [r[APP] for r in targets.collect()]
    users, got_dl = {}, {}
    reqs = [tuple(r) for r in requests.collect()]
    for r in reqs:
        if r[1] in by_user:
            for a in names:
                key = (r[0], r[2], r[3], r[4], brute.vector(feed, (r[6], r[5], r[7]), a, by_user[r[1]]))
                users[key] = users.get(key, 0) + 1
    for uid, app, day in {(d[UID], d[APP], d["request_date"]) for d in downloads.collect()}:
        for r in reqs:
            if (r[0], r[1]) == (day, uid):
                vec = brute.vector(feed, (r[6], r[5], r[7]), app, by_user.get(uid))
                key = (r[0], r[2], r[3], r[4], app, vec)
                got_dl[key] = got_dl.get(key, 0) + 1
    want = {k: (users[(*k[:4], k[5])], n) for k, n in got_dl.items() if (*k[:4], k[5]) in users}
    got = {tuple(r)[:6]: (r["user_count"], r["downloads"]) for r in table.collect()}
    assert got == want and want


def test_segments_without_downloads(spark, data):
    _, requests = _requests(spark, data)
    none = spark.createDataFrame([], "request_uid string, app_id string, request_date string")
    rows = rates.cvu_plain(requests, none).collect()
    assert {(r[APP], r["downloads"], r["CVU"]) for r in rows} == {(None, 0, 0.0)}
    assert sum(r["user_count"] for r in rows) == requests.count()
    empty_bags = bags.app_bags(spark.createDataFrame([], "request_uid string, app_id string"))
    assert rates.cvu_by_bag(requests, none, empty_bags).count() == 0


def test_repeated_lines_change_nothing(spark, data):
    _, requests = _requests(spark, data)
    log = spark.createDataFrame([("u0", "g1", "2018-05-01"), ("u1", "g2", "2018-05-02")], "request_uid string, app_gpm_id string, request_date string")
    app_map = spark.createDataFrame([("g1", "a1"), ("g2", "a2")], "app_gpm_id string, app_id string")
    once = events.targets(log, app_map, requests, ("2018-05-01", "2018-05-02"))
    twice = events.targets(log.union(log), app_map, requests.union(requests), ("2018-05-01", "2018-05-02"))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert events.targets(log, app_map, requests, ("2018-05-02", "2018-05-02")).select(APP).distinct().count() == 1
    assert events.union_events(log, log, log.limit(0), window=("2018-05-01", "2018-05-01")).count() == 1


def test_market_bags(spark, data):
    _, requests = _requests(spark, data)
    got = bags.app_bags(requests, item="market_id").collect()
    assert all(r["appsbag"] == ["m"] for r in got)
    assert bags.bag_stats(bags.app_bags(requests, item="market_id")).first()["avg_apps"] == 1.0
    assert set(SEGMENT) == set(REQUEST_COLUMNS) - {UID}
