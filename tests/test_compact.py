"""The compact feed against the whole one, and the label dictionary against the indexer."""

import pytest
from pyspark.sql import functions as F

from appconv.learning.dictionary import label_dictionary, with_indexes, with_slots
from appconv.learning.features import string_indexer
from appconv.names import APP, BIN, COHORT, OWNED, TARGET
from appconv.operators import compact, encode, lift
from tests.test_lift_and_encode import MEMBER, _members, _random_members


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def sides(spark):
    """Apps that are owned, wanted or both, one on every user, and targets that share no user with anyone."""
    own = _random_members(11, 50, 25, 300, "a1")
    tgt = _random_members(12, 50, 25, 90, "a2")
    tgt |= {(("94", "3", "1"), f"lone{k}", "alone") for k in range(3)}
    return _members(spark, own), _members(spark, tgt)


@pytest.mark.parametrize("legacy_nan", [False, True])
def test_compact_feed_is_the_feed(sides, legacy_nan):
    own, tgt = sides
    small = compact.compact_feed(own, tgt, 3, legacy_nan=legacy_nan)
    whole = lift.lift_feed(own, tgt, 3, legacy_nan=legacy_nan)
    assert rows_of(small.full(), *whole.columns) == rows_of(whole, *whole.columns)
    listed = whole.filter("A1A0users > 0")
    assert small.rows().count() == listed.count() + small.targets.count() < whole.count()
    assert rows_of(small.listed(), *COHORT, TARGET, OWNED, BIN) == rows_of(lift.feed_slots(listed), *COHORT, TARGET, OWNED, BIN)


@pytest.mark.parametrize("legacy_nan", [False, True])
def test_vectors_of_the_compact_feed(spark, sides, legacy_nan):
    own, tgt = sides
    small = compact.compact_feed(own, tgt, 3, legacy_nan=legacy_nan)
    slots = lift.feed_slots(lift.lift_feed(own, tgt, 3, legacy_nan=legacy_nan))
    members = own.unionByName(_members(spark, [(("94", "3", "1"), "few", "a3"), (("94", "3", "1"), "none", "rare"), (("1", "1", "1"), "far", "a3")]))
    for names in ([f"a{k}" for k in range(25)] + ["alone", "unknown"], ["a2"], []):
        targets = spark.createDataFrame([(n,) for n in names], f"{APP} string")
        want = encode.target_hits(members, targets, slots)
        got = encode.target_hits(members, targets, small)
        assert rows_of(got, *want.columns) == rows_of(want, *want.columns)
    owned = members.select("request_uid", APP).distinct()
    wanted = members.unionByName(tgt)
    want, got = (encode.own_target_hits(wanted, owned, s, user_pairs=40) for s in (slots, small))
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)


def test_no_eligible_pair(spark):
    none = _members(spark, [(("1", "1", "1"), "u", "a")])
    small = compact.compact_feed(none, none, 5)
    assert small.rows().count() == 0 and small.full().count() == 0
    targets = spark.createDataFrame([("a",)], f"{APP} string")
    assert encode.target_hits(none, targets, small).count() == 0
    assert spark.createDataFrame([], MEMBER).count() == 0


def test_dictionary_equals_indexer(spark):
    rows = [(f"x{k % 7}", f"y{k * k % 11}", None if k % 5 == 0 else "z") for k in range(200)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    columns = ["a", "b"]
    fitted = string_indexer(columns, "error").fit(df)
    found = {(r.feature, r.label): r["index"] for r in label_dictionary(df, ["a", "b", "c"]).collect()}
    for column, labels in zip(columns, fitted.labelsArray, strict=True):
        assert [found[column, x] for x in labels] == list(range(len(labels)))
    assert found["c", "z"] == 0 and ("c", None) not in found
    new = df.unionByName(spark.createDataFrame([("new", "y1", "z")], df.schema))
    indexed = with_indexes(new, label_dictionary(df, columns), columns)
    assert indexed.count() == 201 and indexed.filter("a_index is null").count() == 1


def test_slots_of_rows(spark):
    df = spark.createDataFrame([("p", "u"), ("p", "v"), ("q", "u"), ("p", "u"), ("r", "w")], "a string, b string")
    got = {(r.a, r.b): (r.width, r.ones) for r in with_slots(df.distinct(), label_dictionary(df, ["a", "b"]), ["a", "b"]).collect()}
    assert got == {("p", "u"): (4, [0, 2]), ("p", "v"): (4, [0, 3]), ("q", "u"): (4, [1, 2]), ("r", "w"): (4, [])}
    empty = label_dictionary(df.limit(0), ["a", "b"])
    assert empty.count() == 0 and with_slots(df.filter(F.lit(False)), empty, ["a", "b"]).count() == 0
