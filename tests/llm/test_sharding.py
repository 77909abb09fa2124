"""Feistel shards: a permutation, both directions, even shards, edge cases."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from appconv.llm import sharding
from appconv.llm.order import numbered, sorted_rows

DOCUMENTS = "doc_id long, text string, shard string, row int, at int"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 100, 101, 997])
def test_permutation_and_back(spark, n):
    shuffle = sharding.Shuffle.of(spark, n, "s")
    rows = spark.range(n).select("id", shuffle.place(F.col("id")).alias("place"))
    rows = rows.withColumn("back", shuffle.number(F.col("place"))).collect()
    assert sorted(r.place for r in rows) == list(range(n))
    assert all(r.id == r.back for r in rows)
    assert shuffle.left * shuffle.right >= n


def test_long_walks_are_followed(spark):
    """Among many seeds some need more than one step beyond n."""
    walks = {seed: sharding.Shuffle.of(spark, 11, str(seed)).walk for seed in range(12)}
    assert max(walks.values()) > 1
    seed = max(walks, key=walks.get)
    shuffle = sharding.Shuffle.of(spark, 11, str(seed))
    assert sorted(r.p for r in spark.range(11).select(shuffle.place(F.col("id")).alias("p")).collect()) == list(range(11))


def test_seeds_and_order(spark):
    rows = spark.range(500).withColumnRenamed("id", "doc_id")
    placed = lambda d, seed: {r.doc_id: (r.shard, r.slot) for r in sharding.sharded(d, [F.col("doc_id")], 7, seed).collect()}
    first = placed(rows, "a")
    assert first == placed(rows.repartition(5, "doc_id"), "a")
    assert first != placed(rows, "b")
    assert sum(first[k][0] == first[k + 1][0] for k in range(499)) < 150


def test_edge_cases(spark):
    long = "wörd " * 30_000
    texts = [(None, None), (None, None), (3, ""), (4, None), (5, long), (6, "é"), (6, "é"), (6, "z"), (1, "x"), (-2, "y")]
    rows = spark.createDataFrame([(i, t, "old", 1, 2) for i, t in texts], DOCUMENTS).repartition(3)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    got = sharding.sharded(rows, [F.col("doc_id"), size, F.crc32(F.col("text").cast("binary"))], 4)
    assert got.columns == ["doc_id", "text", "row", "at", "shard", "slot"]
    got = got.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(texts)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [2, 2, 3, 3]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(rows.limit(0), [F.col("doc_id")]).count() == 0


def test_query_on_nulls(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "né")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sharding.op11_feistel_shards(spark, str(tmp_path)).collect()}
    assert [(got[k].size, got[k].text_crc32) for k in (1, 2, 3)] == [(8, 0), (8, 0), (11, zlib.crc32("né".encode()))]
    assert all(r.law == "rows" and r.grown_shard is None for r in got.values())


def test_slots_lead_back_to_rows(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id")
    placed = sharding.sharded(rows, [F.col("doc_id")], 6)
    back = sharding.source_numbers(placed, 200, 6).collect()
    assert all(r.number == r.doc_id for r in back)


def test_written_shards(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(rows, f"{tmp_path}/shards", [F.col("doc_id")], 5)
    again = spark.read.parquet(f"{tmp_path}/shards").collect()
    want = {r.doc_id: (r.shard, r.slot) for r in sharding.sharded(rows, [F.col("doc_id")], 5).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in again} == want


def test_equal_rows_are_spread_over_the_ranges(spark):
    """One value on all rows still fills all ranges."""
    rows = spark.range(4000, numPartitions=8).select(F.lit(1).alias("doc_id"))
    placed = sorted_rows(rows, [F.col("doc_id")])
    sizes = [r["count"] for r in placed.groupBy("range").count().collect()]
    assert sum(sizes) == 4000
    assert sorted(r.number for r in numbered(placed).collect()) == list(range(4000))
