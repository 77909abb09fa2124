"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in a total order. A number x below n is written as two digits (left, right) to the bases a and b with
a * b >= n, both about the square root of n; each round adds a hash of one digit to the other, modulo its base, which can be
undone. Results of n or more are enciphered again until they lie below n, so that the whole is a permutation of the n numbers.
Fewer than a values lie beyond n; their walks are followed beforehand, which gives the longest walk and with it the exact
number of steps that the column expression needs. The new place of a row gives its shard (place modulo shards) and slot
(place divided by shards): counts of shards differ by one at most, slots have no gaps, and both directions can be computed
for any row or slot without looking at the others. The law is therefore ``rows``; ``grown_shard`` is null.

Defined cases: rows are numbered by doc_id, null first, then size, then CRC-32; rows equal in all three are interchangeable in
the result. A null or empty text has no bytes: size 8, CRC-32 0. Repeated rows each get a slot of their own. Columns of
the input called shard or slot give way to the new ones, all others are kept by ``sharded``. An empty table gives no rows."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.llm.common import table
from appconv.llm.order import numbered, sorted_rows

SHARDS = 24
ROUNDS = 6
SEED = "shards"
OVERHEAD = 8


def _hashed(seed: str, turn: Column, digit: Column) -> Column:
    """52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), turn.cast("string"), digit.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


@dataclass(frozen=True)
class Shuffle:
    """A permutation of the numbers below ``n``."""

    n: int
    seed: str
    walk: int = 1

    @classmethod
    def of(cls, spark: SparkSession, n: int, seed: str = SEED) -> "Shuffle":
        """With the longest walk, followed from the values beyond n to which a value below n leads."""
        plain = cls(n, seed)
        beyond = spark.range(n, plain.left * plain.right).select(F.col("id").alias("v"))
        beyond, walk = beyond.filter(plain._undone(F.col("v")) < n), 1
        while not beyond.isEmpty():
            beyond, walk = beyond.select(plain._done(F.col("v")).alias("v")).filter(F.col("v") >= n), walk + 1
        return cls(n, seed, walk)

    @property
    def left(self) -> int:
        return max(1, math.isqrt(max(0, self.n - 1)) + 1)

    @property
    def right(self) -> int:
        return max(1, -(-self.n // self.left))

    def _rounds(self, value: Column, turns: list[int], sign: int) -> Column:
        right = F.lit(self.right).cast("long")
        start = F.struct(((value - value % right) / right).cast("long").alias("l"), (value % right).alias("r"))

        def turned(digits: Column, turn: Column) -> Column:
            even = turn % 2 == 0
            other = _hashed(self.seed, turn, F.when(even, digits["r"]).otherwise(digits["l"]))
            moved = lambda digit, base: F.pmod(digit + sign * (other % base), F.lit(base).cast("long"))
            return F.struct(
                F.when(even, moved(digits["l"], self.left)).otherwise(digits["l"]).alias("l"),
                F.when(even, digits["r"]).otherwise(moved(digits["r"], self.right)).alias("r"),
            )

        return F.aggregate(F.array(*[F.lit(t) for t in turns]), start, turned, lambda d: d["l"] * right + d["r"])

    def _done(self, value: Column) -> Column:
        return self._rounds(value, list(range(ROUNDS)), 1)

    def _undone(self, value: Column) -> Column:
        return self._rounds(value, list(reversed(range(ROUNDS))), -1)

    def _walked(self, value: Column, step) -> Column:
        steps = F.array(*[F.lit(k) for k in range(self.walk)])
        return F.aggregate(steps, value.cast("long"), lambda v, k: F.when((k == 0) | (v >= self.n), step(v)).otherwise(v))

    def place(self, number: Column) -> Column:
        return self._walked(number, self._done)

    def number(self, place: Column) -> Column:
        return self._walked(place, self._undone)


def sharded(rows: DataFrame, order: list[Column], shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``rows`` with shard and slot; ``order`` is the total order of the rows before the shuffle."""
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    keys = [f"k{k}" for k in range(len(order))]
    packed = rows.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    counted = numbered(sorted_rows(packed, [F.col(k) for k in keys]).drop(*keys))
    shuffle = Shuffle.of(rows.sparkSession, counted.count(), seed)
    placed = counted.withColumn("place", shuffle.place(F.col("number")))
    shard = F.col("place") % shards
    return placed.select("row.*", shard.cast("int").alias("shard"), ((F.col("place") - shard) / shards).cast("long").alias("slot"))


def source_numbers(slots: DataFrame, rows: int, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """shard, slot -> number: which row of the order a slot holds."""
    shuffle = Shuffle.of(slots.sparkSession, rows, seed)
    place = F.col("slot").cast("long") * shards + F.col("shard")
    return slots.withColumn("number", shuffle.number(place))


def write_shards(rows: DataFrame, folder: str, order: list[Column], shards: int = SHARDS, seed: str = SEED) -> None:
    """Parquet by shard, the rows of its files in the order of their slots."""
    placed = sharded(rows, order, shards, seed).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").parquet(folder)


def op11_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    rows = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharded(rows, [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# CRC-32 of the UTF-8 bytes of a column, by the table of its 256 remainders.
CRC_TABLE = """crc_steps(i, c, k) as (
            select i::bigint, i::bigint, 0 from range(256) t(i) union all
            select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_steps where k < 8
        ), crc as (select list(c order by i) as t from crc_steps where k = 8)"""


def crc_of(value: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({value})), '..'), lambda h: ('0x' || h)::bigint)"
    start = "4294967295::bigint"
    return f"xor(list_reduce(list_prepend({start}, {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), {start})"


def _rounds_sql(rows: str) -> str:
    """The cipher of v, as nested selects over l and r."""
    sql = f"select * exclude (v), v // b as l, v % b as r from ({rows})"
    for turn in range(ROUNDS):
        digit, other, base = ("l", "r", "a") if turn % 2 == 0 else ("r", "l", "b")
        add = f"('0x' || substr(md5('{SEED}:{turn}:' || {other}), 1, 13))::bigint"
        sql = f"select * replace ((({digit} + {add} % {base}) % {base})::bigint as {digit}) from ({sql})"
    return f"select * exclude (l, r), l * b + r as v from ({sql})"


ORACLE = {
    "op11_feistel_shards": f"""
        with recursive {CRC_TABLE}, docs as (
            select doc_id, octet_length(encode(coalesce(text, ''))) + 8 as size, {crc_of("coalesce(text, '')")} as text_crc32
            from documents, crc
        ), counts as (
            select count(*) as n, ceil(sqrt(count(*)))::bigint as a from docs
        ), numbers as (
            select doc_id, size, text_crc32, n, a, ((n + a - 1) // a)::bigint as b,
                row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as v
            from docs, counts
        ), walks as (
            {_rounds_sql("select * from numbers")}
            union all
            {_rounds_sql("select * from walks where v >= n")}
        )
        select doc_id, size::bigint as size, text_crc32, 'rows' as law, (v % {SHARDS})::int as shard, (v // {SHARDS})::bigint as slot,
            null::int as grown_shard
        from walks where v < n
    """
}
