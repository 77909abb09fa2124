"""URL rules judged by Bloom filter cascades.

A rule is a host and a path prefix; it fits its host and all subdomains if the url's path starts with the rule's path. What
rules could fit a url is known from the url alone: for each shape a rule has (labels of the host, length of the path) there
is one candidate key. The universe of a cascade is every candidate key of the corpus. Level one is a Bloom filter of the
listed keys, level two one of the other keys of the universe that pass level one, level three one of the listed keys that
pass level two, and so on until no key passes wrongly; so every key of the universe is answered exactly, without a join.
The first level's error rate is listed / (others * sqrt 2), which keeps the later levels as small as the list: a cascade
takes about 1.44 * listed * log2(others / listed) bits. Where its first level would take more than ``max_bytes``, the keys are
dealt into shards by a hash and each shard has a cascade of its own; the urls ask one shard's filters after the other's.

Defined cases: a null url and a url without ``://`` have an empty host and path, fit no rule and get the method's verdict:
``allow``, as no key of theirs is listed. Of fitting rules the longest wins; a rule listed both ways blocks. Rules with a
null or empty host are left out. Repeated urls are judged row by row, other columns are ignored, an empty table or an empty
list gives no rules."""

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.llm.common import lower_ascii, slices, staged, table

MAX_BYTES = 64 << 20

RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

_AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LOWER_LEVELS = 0.5


class Level(NamedTuple):
    """One Bloom filter; ``words`` has a single row with all its 64-bit words."""

    number: int
    bits: int
    hashes: int
    words: DataFrame


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, _AFTER_SCHEME, i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def _positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(64 * number + i)), F.lit(bits)) for i in range(hashes)]


def _passes(key: Column, level: Level) -> Column:
    words, found = level.words.scalar(), F.lit(True)
    for position in _positions(key, level.number, level.bits, level.hashes):
        word = F.get(words, F.floor(position / 64).cast("int"))
        found = found & (F.getbit(word, F.pmod(position, F.lit(64)).cast("int")) == 1)
    return found


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed."""
    answer = F.lit(False)
    for level in reversed(levels):
        answer = _passes(key, level) & ~answer
    return answer


def filter_bits(count: int, rate: float) -> int:
    return 64 * max(1, math.ceil(count * math.log2(1 / rate) * math.log2(math.e) / 64))


def _level(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    bits, hashes = filter_bits(count, rate), max(1, round(math.log2(1 / rate)))
    position = F.explode(F.array(*_positions(F.col("key"), number, bits, hashes)))
    words = (
        keys.select(position.alias("position"))
        .select(F.floor(F.col("position") / 64).alias("word"), F.expr("shiftleft(1L, cast(position % 64 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    # One row with bits / 64 words, which the bound on a shard's filters keeps small.
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    cells = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits"))))
    row = every.agg(F.transform(cells, lambda c: c["bits"]).alias("words"))
    return Level(number, bits, hashes, staged(row))


def _first_rate(n_wanted: int, n_others: int) -> float:
    return min(_LOWER_LEVELS, n_wanted / (max(1, n_others) * math.sqrt(2)))


def build_cascade(universe: DataFrame) -> list[Level]:
    """universe (key, listed), every key once -> the levels. What still passes wrongly is written for each level."""
    wanted, others = universe.filter("listed").select("key"), universe.filter(~F.col("listed")).select("key")
    n_wanted, n_others = wanted.count(), others.count()
    levels = []
    while n_wanted:
        rate = _LOWER_LEVELS if levels else _first_rate(n_wanted, n_others)
        levels.append(_level(wanted, len(levels) + 1, n_wanted, rate))
        wrongly = staged(others.filter(_passes(F.col("key"), levels[-1])))
        wanted, others = wrongly, wanted
        n_wanted, n_others = wanted.count(), n_wanted
    return levels


def shard_count(universe: DataFrame, max_bytes: int) -> int:
    """universe (key, block, allow) -> shards, so that the first filter of each takes at most about ``max_bytes``."""
    n, *listed = universe.agg(F.count("*"), F.count_if("block"), F.count_if("allow")).first()
    return max(slices(filter_bits(k, _first_rate(k, n - k)) // 8, max_bytes) if k else 1 for k in listed)


def _candidates(shapes: list[tuple[int, int]]) -> list[Column]:
    labels = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    return [
        F.when(
            (F.col("host") != "") & (labels >= n) & (F.length("path") >= length),
            F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, length)),
        )
        for n, length in shapes
    ]


def judge(pages: DataFrame, rules: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """pages (page_id, url), rules (host, path, verdict) -> page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.filter("host != '' and path is not null").select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
    n_labels = F.size(F.split("host", r"\."))
    shapes = [tuple(r) for r in rules.select(n_labels, F.length("path")).distinct().collect()]
    if not shapes:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keys = _candidates(shapes)
    listed = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.min(F.col("verdict") == "allow").alias("allow"))
    universe = (
        urls.select(F.explode(F.array_compact(F.array(*keys))).alias("key"))
        .distinct()
        .join(listed, "key", "left")
        .select("key", F.coalesce(~F.col("allow"), F.lit(False)).alias("block"), F.coalesce("allow", F.lit(False)).alias("allow"))
    )
    universe = staged(universe)
    found = urls.select("*", *[k.alias(f"key{i}") for i, k in enumerate(keys)])
    shards = shard_count(universe, max_bytes)
    shard = lambda key: F.pmod(F.xxhash64(key), F.lit(shards))
    for s in range(shards):
        own = universe.filter(shard("key") == s)
        blocked = build_cascade(own.select("key", F.col("block").alias("listed")))
        allowed = build_cascade(own.select("key", F.col("allow").alias("listed")))
        for i in range(len(keys)):
            key = F.col(f"key{i}")
            answer = F.when(member(key, blocked), "block").when(member(key, allowed), "allow")
            before = F.col(f"answer{i}") if s else F.lit(None)
            found = found.withColumn(f"answer{i}", F.when(key.isNotNull() & (shard(key) == s), answer).otherwise(before))
        # One shard's filters at a time are in memory.
        found = staged(found) if shards > 1 else found
    fitting = [F.col(f"answer{i}") for i in range(len(keys))]
    best = F.array_max(
        F.array(
            *[
                F.when(v.isNotNull(), F.struct(F.length(f"key{i}").alias("size"), F.col(f"key{i}").alias("rule"), v.alias("verdict")))
                for i, v in enumerate(fitting)
            ]
        )
    )
    return found.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")
    )


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


ORACLE = {
    "op2_url_rules": r"""
        with parts as (
            select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest
            from pages
        ), urls as (
            select page_id,
                translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
            from parts
        ), rules(rule_host, rule_path, kind) as (
            values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), fitting as (
            select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
                arg_max(kind, length(rule_host || rule_path)) as kind
            from urls join rules
                on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
            group by page_id
        )
        select page_id, host, path, rule, coalesce(kind, 'allow') as verdict from urls left join fitting using (page_id)
    """
}
