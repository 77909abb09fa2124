"""Joins against a table with one row per key, safe for keys that fill a large share of the rows.

Adaptive execution splits skewed partitions only where both sides of a join come straight from a shuffle. A table that was
just aggregated per user does not, so its hot users are split here."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appconv.sources.staging import cut_lineage

# A key with more rows than this is split into parts of about this size.
HOT_ROWS = 1_000_000

# Pairs that one key makes in a join of two tables; keys with more are split into parts of about this size.
USER_PAIRS = 1_000_000

# Rows with a NULL key match nothing and go anywhere.
_NULL_PARTS = 1024


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of parts to split them into; there are fewer of them than
    rows divided by ``hot_rows``."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
    return counts.select(*keys, F.ceil(F.col("n") / hot_rows).cast("int").alias("parts"))


def heavy_users(dealt: DataFrame, copied: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Keys that make more than ``most`` pairs of rows and the parts to split them into; at most one row of ``dealt`` each."""
    n = dealt.groupBy(*keys).agg(F.count("*").alias("n"))
    m = copied.groupBy(*keys).agg(F.count("*").alias("m"))
    heavy = n.join(m, keys).filter(F.col("n") * F.col("m") > most)
    parts = F.least(F.ceil(F.col("n") * F.col("m") / most), F.col("n")).cast("int")
    return cut_lineage(heavy.select(*keys, parts.alias("parts")))


def split_bags(rows: DataFrame, dealt: str, copied: str, most: int) -> DataFrame:
    """Rows with two arrays, whose pairs are wanted, with ``part``: a row with more than ``most`` pairs becomes several, with a
    slice of ``dealt`` each and all of ``copied``."""
    n, m = F.size(dealt).cast("long"), F.size(copied).cast("long")
    parts = F.when(n * m > most, F.least(F.ceil(n * m / most), n)).otherwise(1).cast("int")
    each = F.ceil(F.size(dealt) / F.col("parts")).cast("int")
    split = rows.withColumn("parts", parts).withColumn("each", each)
    split = split.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return split.withColumn(dealt, F.slice(dealt, F.col("part") * F.col("each") + 1, F.col("each"))).drop("parts", "each")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``rows``, which are read twice and should be staged, with a ``table`` that is unique on ``keys``. Rows of a hot key are dealt over its parts, and the one
    record of the key is copied to each part; other keys have one part."""
    # Staged, so that its size is known and neither side is shuffled to meet a table that is mostly empty.
    hot = cut_lineage(hot_keys(rows, keys, hot_rows))
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    # The task is dealt by too, as equal rows would all go to one part.
    dealt = F.xxhash64(*rows.columns, F.spark_partition_id())
    part = (
        F.when(no_key, F.pmod(dealt, F.lit(_NULL_PARTS)))
        .when(F.col("parts").isNotNull(), F.pmod(dealt, F.col("parts")))
        .otherwise(F.lit(0))
        .cast("int")
    )
    left = rows.join(hot, keys, "left").withColumn("part", part).drop("parts")
    copies = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    right = table.join(hot, keys, "left").withColumn("part", F.explode(copies)).drop("parts")
    return left.join(right, [*keys, "part"], how).drop("part")
