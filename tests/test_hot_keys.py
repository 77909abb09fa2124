"""Apps that everybody owns, users with very many apps, and where staged tables go."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from appconv.names import COHORT
from appconv.operators import encode, lift
from appconv.operators.ranking import ranked
from appconv.operators.skew import heavy_users
from appconv.session import checkpoint_dir

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cohort(rows):
    return rows.select(*[F.lit("1").alias(c) for c in COHORT], "*")


def test_hot_app_is_split_in_the_shuffled_encode(small_partitions):
    spark = small_partitions
    ids = spark.range(30000)
    everybody = ids.select(F.col("id").cast("string").alias("request_uid"), F.lit("hot").alias("app_id"))
    others = ids.select(F.col("id").cast("string").alias("request_uid"), F.concat(F.lit("a"), F.col("id") % 50).alias("app_id"))
    members = cohort(everybody.union(others)).repartition(8)
    apps = ["hot", *[f"a{k}" for k in range(50)]]
    slots = cohort(spark.createDataFrame([("t", a, 4) for a in apps], f"app_a0 string, app_a1 string, {lift.BIN} int"))
    targets = spark.createDataFrame([("t",)], "app_id string")
    hits = encode.packed_hits(members, targets, slots, broadcast_bytes=0)
    assert len(hits.collect()) == 30000
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin(skew=true)" in plan
    broadcast = encode.packed_hits(members, targets, slots)
    assert broadcast.count() == 30000


def test_heavy_user_is_split(spark):
    def rows(uid, prefix, n, start=0):
        return [("1", "1", "1", uid, f"{prefix}{k}") for k in range(start, start + n)]

    schema = "country_id string, device_os_id string, device_type_id string, request_uid string, app_id string"
    own = rows("bot", "a", 60) + rows("u1", "a", 3) + rows("u2", "b", 4) + rows("u3", "a", 60)
    tgt = rows("bot", "a", 50) + rows("u1", "a", 2, 1) + rows("u2", "b", 2) + rows("u4", "a", 9)
    own, tgt = spark.createDataFrame(own, schema), spark.createDataFrame(tgt, schema)
    whole = lift.co_users(own, tgt, min_users=1)
    split = lift.co_users(own, tgt, min_users=1, user_pairs=100)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))
    parts = heavy_users(own, tgt, [*COHORT, "request_uid"], 100).collect()
    assert [(r.request_uid, r.parts) for r in parts] == [("bot", 30)]


def test_heavy_user_of_own_targets_is_split(spark):
    """A bot with many downloads and many owned apps: the same vectors from parts, and parts of bounded size."""
    user = lambda name, apps: [("1", "1", "1", name, a) for a in apps]
    schema = "country_id string, device_os_id string, device_type_id string, request_uid string, app_id string"
    wanted = spark.createDataFrame(user("bot", [f"t{k}" for k in range(40)]) + user("u", ["t1", "t2"]) + user("v", ["t3"]), schema)
    owned = [("bot", f"a{k}") for k in range(50)] + [("u", "a1"), ("u", "a2"), ("w", "a3")]
    owned = spark.createDataFrame(owned, "request_uid string, app_id string")
    slots = cohort(spark.createDataFrame([(f"t{t}", f"a{a}", (t * a) % 9) for t in range(40) for a in range(50)], f"app_a0 string, app_a1 string, {lift.BIN} int"))
    whole, split = (encode.own_target_hits(wanted, owned, slots, user_pairs=n) for n in (10**6, 50))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))
    assert whole.count() == 42
    assert [tuple(r) for r in heavy_users(owned, wanted, ["request_uid"], 50).collect()] == [("bot", 40)]


def test_pair_slices_follow_the_pair_count(spark):
    def apps(name, n):
        return cohort(spark.createDataFrame([(f"x{k}",) for k in range(n)], f"{name} string"))

    owned, wanted = apps("app_a1", 40), apps("app_a0", 30)
    pairs = {n: lift._pair_universe(owned, wanted, n) for n in (10, 1200, 10**6)}
    want = sorted((a, b) for a in (f"x{k}" for k in range(40)) for b in (f"x{k}" for k in range(30)) if a != b)
    for rows in pairs.values():
        assert sorted((r.app_a1, r.app_a0) for r in rows.collect()) == want


def test_places_in_order(spark):
    names = [f"n{k}" for k in range(500)]
    got = ranked(spark.createDataFrame([(n,) for n in reversed(names)], "name string"), [F.col("name")]).collect()
    assert {r.name: r.place for r in got} == {n: k for k, n in enumerate(sorted(names))}


def test_clusters_need_a_shared_folder():
    nothing = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: nothing, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(conf=nothing, sparkContext=context))
